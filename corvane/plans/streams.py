"""Streaming queries over the events table: all that is there, then stop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators.tables import shared_folder
from corvane.sources import files as op_files
from corvane.streaming import events as op

from .base import ORACLES, QUERIES, query, view


def _places(spark) -> tuple[str, str]:
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return op.event_stream(spark, f"{sf_dir}/event[s].parquet", schema)  # a glob may be a file, too


def dedupe(spark, sf_dir):
    """A-05 as a stream: every seventh event comes again within the watermark, in the same
    batch or in the next."""
    out, state = _places(spark)
    base, events = out.removesuffix("/out"), view(spark, sf_dir, "select event_id, event_type, ts from {events}")
    top = events.agg(F.max("ts").alias("top"))
    latest = events.crossJoin(F.broadcast(top)).where("ts > top - interval 5 minutes").drop("top")
    for rows in (events.union(events.where("event_id % 7 = 0")), latest):
        rows.write.mode("append").parquet(f"{base}/events")
        found = op.run_once(op.dedupe_stream(op.event_stream(spark, f"{base}/events", events.schema, 10_000)), out, state)
    return found.select("event_id", "event_type")


def seal(spark, sf_dir):
    """A-06 as a stream; the chains verify like the batch ones."""
    return op.run_once(op.seal_stream(_stream(spark, sf_dir)), *_places(spark)).select("chain", "seq", "event_id", "content", "prev_hash", "hash")


def windows(spark, sf_dir):
    """W-01 and W-09 as a stream; windows that the watermark has not closed stay out."""
    out = op.run_once(op.window_metrics(_stream(spark, sf_dir)), *_places(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("windows"))


QUERIES["a05_dedupe_stream"] = dedupe
ORACLES["a05_dedupe_stream"] = "select event_id, event_type from events"
QUERIES["a06_seal_stream"] = seal
ORACLES["a06_seal_stream"] = """
with recursive s as (
  select user_id as chain, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_id, event_type as content from events),
h as (
  select chain, seq, event_id, content, '' as prev_hash, sha256('|' || content) as hash from s where seq = 0
  union all select s.chain, s.seq, s.event_id, s.content, h.hash, sha256(h.hash || '|' || s.content) from h
  join s on s.chain = h.chain and s.seq = h.seq + 1)
select * from h"""
QUERIES["w09_window_stream"] = windows


#: A trace is four events in a row. Every 97th event arrives with the last batch only, the
#: others by the day; events lie minutes apart, so a decision waits for ten minutes.
_SPANS = (
    "event_id, event_id div 4 as trace_id, cast(ts as timestamp) as ts, event_type = 'error' as failed, value as latency,"
    " case when event_id % 97 = 0 then 3 when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end as arrival"
)


def tail_stream(spark, sf_dir):
    """W-08 as a stream, in four runs as spans arrive: LATE ones apart, the others KEPT or
    DROPPED with their trace once its session has closed. Open sessions stay out."""
    base = _places(spark)[0].removesuffix("/out")
    spans = view(spark, sf_dir, f"select {_SPANS} from {{events}}")
    for arrival in range(4):
        spans.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(f"{base}/spans")
        arrived = spark.readStream.schema(spans.drop("arrival").schema).parquet(f"{base}/spans")
        op.split_late(arrived, f"{base}/on_time", f"{base}/late", f"{base}/tops", f"{base}/split-state", "10 minutes")
    on_time = spark.readStream.schema(spans.drop("arrival").schema).option("recursiveFileLookup", "true").parquet(f"{base}/on_time")
    decided = op.run_once(op.session_traces(on_time, 10, "10 minutes", 150.0), f"{base}/out", f"{base}/state")
    late = spark.read.parquet(f"{base}/late").select("event_id", "trace_id", F.lit("LATE").alias("status"))
    return decided.select("event_id", "trace_id", F.when(F.col("kept"), "KEPT").otherwise("DROPPED").alias("status")).union(late)


QUERIES["w08_tail_stream"] = tail_stream
ORACLES["w08_tail_stream"] = """
with s as (
  select event_id, event_id // 4 as trace_id, ts, event_type = 'error' as failed, value as latency,
    case when event_id % 97 = 0 then 3 when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end as arrival
  from events),
tops as (select a.arrival, max(s.ts) - interval 10 minute as horizon from (select distinct arrival from s) a
  join s on s.arrival < a.arrival group by 1),
told as (select s.*, coalesce(ts + interval 10 minute <= horizon, false) as late from s left join tops using (arrival)),
g as (
  select *, sum(opens) over (partition by trace_id order by ts, event_id rows unbounded preceding) as session
  from (
    select *, coalesce(ts - lag(ts) over (partition by trace_id order by ts, event_id) > interval 10 minute, true)::int as opens
    from told where not late)),
closed as (
  select trace_id, session, bool_or(failed) or max(latency) > 150
    or cast(concat('0x', left(sha256(cast(trace_id as varchar)), 8)) as bigint) % 100 < 10 as kept
  from g group by 1, 2 having max(ts) + interval 10 minute <= (select max(ts) - interval 10 minute from told where not late))
select event_id, trace_id, case when kept then 'KEPT' else 'DROPPED' end as status from g join closed using (trace_id, session)
union all select event_id, trace_id, 'LATE' from told where late
"""


def audit_sinks(spark, sf_dir):
    """I-18: planted wrong partitions, times and keys; both sinks as they are read back,
    valid events with their place in the chain's file."""
    base = _places(spark)[0].removesuffix("/out")
    planted = view(spark, sf_dir, f"select {_AUDIT} from {{events}}")
    planted.write.parquet(f"{base}/topic")
    op_files.consume_audit(op_files.read_audit_stream(spark, f"{base}/topic", planted.schema, files_per_batch=10_000), f"{base}/valid", f"{base}/dead", f"{base}/state")
    valid = op_files.read_in_order(spark.read.schema(planted.drop("ts").schema).option("recursiveFileLookup", "true").parquet(f"{base}/valid"))
    first = valid.groupBy("user_id").agg(F.min("place").alias("first"))
    valid = valid.join(first, "user_id").selectExpr("event_id", "user_id", "cast(null as string) as reason", "place - first as place")
    dead = spark.read.parquet(f"{base}/dead").selectExpr("event_id", "user_id", "reason", "cast(null as bigint) as place")
    return valid.union(dead)


_AUDIT = (
    "event_id, user_id, event_type, case when event_id % 31 = 0 then null else ts end as ts,"
    " case when event_id % 13 = 0 then 'other' when event_id % 17 = 0 then null else cast(event_id as varchar(20)) end as key,"
    " case when event_id % 29 = 0 then 1 when event_id % 37 = 0 then null else 0 end as partition"
)
QUERIES["i18_audit_sinks"] = audit_sinks
ORACLES["i18_audit_sinks"] = f"""
with t as (select {_AUDIT} from events),
r as (
  select *, case when partition is distinct from 0 then 'PARTITION' when ts is null then 'UNDECODABLE'
    when key is distinct from cast(event_id as varchar) then 'KEY' end as reason from t)
select event_id, user_id, reason,
  case when reason is null then row_number() over (partition by reason is null, user_id order by ts, event_id) - 1 end as place
from r
"""


#: Every 53rd event comes an hour after its time, so some rows are late.
_LATE = "select event_id, case when event_id % 53 = 0 then ts - interval '1' hour else ts end as ts from {events}"


@query(
    "w08_late_rows",
    """with s as (select *, max(ts) over (order by event_id rows unbounded preceding) as latest from e)
select event_id, ts from s where cast(floor(epoch(latest)) as bigint) - cast(floor(epoch(ts)) as bigint) > 600""",
    e=_LATE,
)
def _(e):
    return op.late_rows(e)
