"""A: events are audit events; a chain is a user."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import audit as op

from .base import query

_ACTION = (
    "case event_type when 'error' then 'authn_failed' when 'signup' then 'authz.decide' when 'purchase' then "
    "'record_export' else event_type end"
)
_RESOURCE = "case event_id % 5 when 0 then 'policy' when 1 then 'dataset' when 2 then 'Document' when 3 then 'audit log' else 'queue' end"
_COMMON = f"event_id, user_id as actor, {_ACTION} as action, {_RESOURCE} as resource_type, cast(event_id % 100 as varchar(9)) as resource_id, concat('r', cast(user_id % 3 as varchar(3))) as role, case when value > 50 then 'DENIED' else 'OK' end as outcome, ts"
EVENTS = "select " + _COMMON + " from {events}"
_VALUE = "case when event_id % 10 = 0 then ' ' when event_id % 9 = 0 then concat('a', chr(13), 'b') else concat('s\"', event_type) end"
_KEY2 = "case when event_id % 6 = 0 then 'unknown' else 'entityType' end"
PAYLOADS = (
    "select " + _COMMON + f", map('requestId', get_json_object(props, '$.k'), {_KEY2}, {_VALUE}) as payload, concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') as occurred_at from {{events}}",
    "select " + _COMMON + f", json_extract_string(props, '$.k') as k, {_KEY2} as k2, {_VALUE} as v2, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z') as occurred_at from {{events}}",
)
_CATEGORY = (
    "case when action = 'authn_failed' then 'AUTHENTICATION' when action = 'authz.decide' then 'AUTHORIZATION' when action "
    "= 'record_export' then 'PHI_SAFETY' when resource_type in ('policy', 'audit log') then 'GOVERNANCE' when "
    "resource_type in ('dataset', 'Document') then 'DATA_ACCESS' else 'SYSTEM' end"
)
SEALED = (PAYLOADS[0].replace("event_id, user_id", "event_id, event_id as seq, user_id", 1), PAYLOADS[1].replace("event_id, user_id", "event_id, event_id as seq, user_id", 1))


@query("a01_classify_event", f"select event_id, {_CATEGORY} as category from events_", events_=EVENTS)
def _(events_):
    return op.classify_event(events_).select("event_id", "category")


@query("a02_validate_payload", "select event_id, case when k2 = 'unknown' then 1 else 2 end as n_kept, k2 <> 'unknown' and trim(v2) <> '' and not "
    "contains(v2, chr(13)) as valid from payloads", payloads=PAYLOADS)
def _(payloads):
    return op.validate_payload(payloads).select("event_id", F.size("kept").alias("n_kept"), "valid")


_V2 = "replace(replace(v2, '\"', '\\\"'), chr(13), '\\r')"
_CANON = f"""with j as (select *, {_CATEGORY} as category, case when k2 < 'requestId' then concat('{{"', k2, '":"', {_V2}, '","requestId":"', k, '"}}') else concat('{{"requestId":"', k, '","', k2, '":"', {_V2}, '"}}') end as payload_json from payloads),
u as (select *, sha256(payload_json) as payload_hash, concat('{{"eventId":"', event_id, '","timestamp":"', occurred_at, '","actor":"', actor, '","category":"', category, '","role":"', role, '","action":"', action, '","resourceType":"', resource_type, '","resourceId":"', resource_id, '","outcome":"', outcome, '""payload":', payload_json, ',"payloadHash":"', sha256(payload_json), '"') as unsealed from j),
c as (select event_id, payload_hash, sha256(concat(unsealed, ',"previousHash":""}}')) as event_hash from u)
"""


def _canonical(payloads):
    return op.canonical_hash(op.classify_event(payloads))


@query("a03_canonical_hash", _CANON + "select * from c", payloads=PAYLOADS)
def _(payloads):
    return _canonical(payloads).select("event_id", "payload_hash", "event_hash")


@query("a04_transport_check", _CANON + "select event_id, case when event_id % 13 = 0 then 'PAYLOAD_HASH' when event_id % 17 = 0 then 'CHAIN_FIELDS' end as "
    "reason from c", payloads=PAYLOADS)
def _(payloads):
    sent = _canonical(payloads).withColumn("sent_hash", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("payload_hash")))
    sent = sent.withColumn("prev_hash", F.lit(None).cast("string")).withColumn("hash", F.when(F.col("event_id") % 17 == 0, "y"))
    return op.transport_check(sent).select("event_id", "reason")


@query("a05_dedupe_events", "select event_id, min(ts) as occurred_at, arg_min(action, ts) as action from rows_ group by 1", rows_="select event_id % 4000 as event_id, ts, event_type as action from {events}")
def _(rows_):
    return op.dedupe_events(rows_.withColumnRenamed("ts", "occurred_at"))


def _sealed(rows):
    return op.seal_chain(_canonical(rows).select("actor", "seq", "unsealed"), "actor")


_FIRST = _CANON.replace("from payloads)", "from sealed)") + (
    ", f as (select actor, seq, unsealed, lag(unsealed) over w as before, row_number() over w as place from u window w as "
    "(partition by actor order by seq))"
)


@query("a06_seal_chain", sealed=SEALED)
def _(sealed):
    return _sealed(sealed).select("actor", "seq", "prev_hash", "hash")


@query("a06_first_links", _FIRST + """, h as (select actor, place, seq, unsealed, case when place = 2 then sha256(concat(before, ',"previousHash":""}')) else '' end as
  prev_hash from f where place <= 2)
select actor, seq, prev_hash, sha256(concat(unsealed, ',"previousHash":"', prev_hash, '"}')) as hash from h""", sealed=SEALED)
def _(sealed):
    """The first two events of each chain, whose hashes SQL can follow."""
    place = F.row_number().over(Window.partitionBy("actor").orderBy("seq"))
    return _sealed(sealed).withColumn("place", place).where("place <= 2").select("actor", "seq", "prev_hash", "hash")


@query("a07_verify_chain", "select actor, count(*) as checked, min(seq) filter (seq % 97 = 0) as broken_at, case when count(*) filter (seq % 97 = "
    "0) > 0 then 'HASH' end as reason from sealed group by 1", sealed=SEALED)
def _(sealed):
    tampered = _sealed(sealed).withColumn("unsealed", F.concat("unsealed", F.when(F.col("seq") % 97 == 0, "x").otherwise("")))
    return op.verify_chain(tampered, "actor")


@query("a08_anchors", "select actor, count(*) as length from sealed group by 1", sealed=SEALED)
def _(sealed):
    return op.anchors(_sealed(sealed), "actor").select("actor", "length")


@query("a09_integrity_edges", "select * exclude (before) from (select *, lag(ok) over (partition by chain order by checked_at) as before from "
    "checks) where not ok and coalesce(before, true)", checks="select user_id as chain, event_id as checked_at, event_type <> 'error' as ok from {events}")
def _(checks):
    return op.integrity_edges(checks)


@query("a10_transport_metrics", "select date_trunc('hour', ts) as window_start, count(*) filter (reason is null) as processed, count(event_id) - "
    "count(distinct event_id) as duplicates, count(*) filter (reason is not null) as dead_letters, max(lag_s) as max_lag_s "
    "from rows_ group by 1", rows_="select event_id % 9000 as event_id, ts, value as lag_s, case when event_type = 'error' then 'BAD' end as reason from "
    "{events}")
def _(rows_):
    return op.transport_metrics(rows_)


@query("a11_replay_after", "with c as (select session, event_id, row_number() over w as place, sum(bytes) over (w rows unbounded preceding) as "
    "total from rows_ join seen using (session) where event_id > last_id window w as (partition by session order by "
    "event_id)) select session, event_id, place from c where place <= 20 and total <= 500",
       rows_="select user_id as session, event_id, cast(floor(value) as bigint) + 10 as bytes from {events}", seen="select user_id as session, min(event_id) + 300 as last_id from {events} group by 1")
def _(rows_, seen):
    return op.replay_after(rows_, seen, 20, 500)
