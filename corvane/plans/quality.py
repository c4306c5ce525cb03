"""Q: batches are sources, acceptance and residuals come from the labels."""

from pyspark.sql import functions as F

from corvane.operators import quality as op

from .base import query

ITEMS = """select d.source as batch_id, d.doc_id, coalesce(l.quality, 1) = 1 as accepted, coalesce(l.toxic, 0) = 1 as residual,
 case when d.doc_id % 5 = 0 then 'EMAIL' when d.doc_id % 7 = 0 then 'PHONE' end as entity_type, md5(d.text) as content_hash
  from {documents} d left join {labels} l on d.doc_id = l.doc_id"""
RULES = """select * from (values ('Q1', 'BLOCKING', 'ACCEPTANCE_RATE', 'AT_LEAST', 0.85), ('Q2', 'WARNING', 'RESIDUAL_PHI_COUNT', 'AT_MOST',
  2.0), ('Q3', 'WARNING', 'TOTAL_RECORD_COUNT', 'AT_LEAST', 50.0),
 ('Q4', 'BLOCKING', 'REJECTION_RATE', 'AT_MOST', 0.15), ('Q5', 'WARNING', 'UNIQUE_CONTENT_HASH_COUNT', 'AT_LEAST', cast(null as
  double))) as r(code, severity, metric, comparison, threshold)"""
_SNAP = (
    "s as (select batch_id, count(*) as total, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as "
    "rejected, count(*) filter (residual) as residual_phi, count(distinct content_hash) as unique_hashes from items group "
    "by 1)"
)
_MET = _SNAP + """, m as (select batch_id, 'TOTAL_RECORD_COUNT' as metric, total::double as value from s union all
  select batch_id, 'ACCEPTANCE_RATE', accepted / total from s union all
 select batch_id, 'REJECTION_RATE', rejected / total from s union all select batch_id, 'RESIDUAL_PHI_COUNT', residual_phi from s
  union all select batch_id, 'UNIQUE_CONTENT_HASH_COUNT', unique_hashes from s)"""
_RES = _MET + (
    ", r as (select batch_id, code, severity, metric, value, coalesce(case comparison when 'AT_LEAST' then value >= "
    "threshold else value <= threshold end, false) as passed from m join rules using (metric))"
)


@query("q01_quality_snapshot", "with " + _SNAP + ", t as (select batch_id, string_agg(concat(entity_type, ':', n), ',' order by entity_type) as types from (select "
    "batch_id, entity_type, count(*) as n from items where entity_type is not null group by 1, 2) group by 1) select s.*, "
    "types from s left join t using (batch_id)", items=ITEMS)
def _(items):
    out = op.quality_snapshot(items)
    return out.withColumn("types", F.expr("array_join(transform(map_entries(entity_type_counts), e -> concat(e.key, ':', e.value)), ',')")).drop("entity_type_counts")


def _metrics(items):
    return op.quality_metrics(op.quality_snapshot(items))


@query("q02_quality_metrics", "with " + _MET + " select batch_id, metric, round(value, 9) as value from m", items=ITEMS)
def _(items):
    return _metrics(items).withColumn("value", F.round("value", 9))


@query("q03_evaluate_assertions", "with " + _RES + " select batch_id, code, severity, metric, round(value, 9) as value, passed from r", items=ITEMS, rules=RULES)
def _(items, rules):
    return op.evaluate_assertions(_metrics(items), rules).withColumn("value", F.round("value", 9))


@query("q04_batch_decision", "with " + _RES + " select batch_id, case when bool_or(not passed and severity = 'BLOCKING') then 'REJECTED' else 'ACCEPTED' end as "
    "decision, coalesce(string_agg(code, ',' order by code) filter (not passed and severity = 'WARNING'), '') as warnings "
    "from r group by 1", items=ITEMS, rules=RULES)
def _(items, rules):
    return op.batch_decision(op.evaluate_assertions(_metrics(items), rules)).withColumn("warnings", F.array_join("warnings", ","))


@query("q05_quality_trend", "with " + _RES + " select batch_id, code, round(value - lag(value) over w, 9) as delta, coalesce(lag(passed) over w and not passed, "
    "false) as newly_failed, coalesce(not lag(passed) over w and passed, false) as recovered from r window w as (partition "
    "by code order by batch_id)", items=ITEMS, rules=RULES)
def _(items, rules):
    return op.quality_trend(op.evaluate_assertions(_metrics(items), rules)).select("batch_id", "code", F.round("delta", 9).alias("delta"), "newly_failed", "recovered")


RUNS = (
    "select user_id as run_id, case event_id % 7 when 0 then 'DISCOVERED' when 1 then 'PARSED' when 2 then 'DEIDENTIFIED' "
    "when 3 then 'CHUNKED' when 4 then 'EMBEDDED' when 5 then 'INDEXED' else 'SKIPPED' end as stage, cast(event_id % 1000 "
    "as bigint) as duration_ms from {events}"
)


@query("q07_run_summary", "select run_id, " + ", ".join(f"count(*) filter (stage = '{s}') as {s.lower()}" for s in op.STEPS) + ", cast(sum(duration_ms) as bigint) as duration_ms from runs group by 1", runs=RUNS)
def _(runs):
    return op.run_summary(runs)


STAGED = (
    "select user_id % 40 as item_id, event_id as seq, case event_type when 'view' then 'DISCOVERED' when 'click' then "
    "'DEIDENTIFIED' when 'signup' then 'INDEX_READY' when 'purchase' then 'INDEXED' else 'QUARANTINED' end as status from "
    "{events}"
)
_PAIRS = ", ".join(f"'{a}>{b}'" for a, b in op.ALLOWED)


@query("q08_stage_transitions", f"with b as (select *, lag(status) over (partition by item_id order by seq) as before from staged) select item_id, seq, status, before, case when before is null then status = 'DISCOVERED' else concat(before, '>', status) in ({_PAIRS}) end as allowed from b", staged=STAGED)
def _(staged):
    return op.stage_transitions(staged)


STAGE_ROWS = """select doc_id as item_id, doc_id % 5 as run_id, source as source_id, doc_id as version_id, case doc_id % 6
  when 0 then 'DISCOVERED' when 1 then 'DEIDENTIFIED' when 2 then 'INDEX_READY' when 3 then 'INDEXED'
  when 4 then 'QUARANTINED' else 'LOST' end as status,
 cast(doc_id % 4 - 1 as int) as chunk_count, case when doc_id % 3 = 0 then left(text, 300)
  when doc_id % 3 = 1 then 'no content' end as safe_reason from {documents}"""


@query("q08_stage_violations", """with c as (select item_id, status = 'LOST' as s, coalesce(chunk_count, 0) < 0 or (status = 'INDEXED' and coalesce(chunk_count <= 0, true)) as n,
 (status = 'QUARANTINED' and coalesce(length(safe_reason), 0) = 0) or coalesce(length(safe_reason) > 256, false) or
  coalesce(contains(safe_reason, chr(10)), false) as r from rows_)
select item_id, concat_ws(',', case when s then 'STATUS' end, case when n then 'COUNTS' end, case
  when r then 'REASON' end) as broken from c where s or n or r""", rows_=STAGE_ROWS)
def _(rows_):
    return op.stage_violations(rows_).select("item_id", F.array_join("broken", ",").alias("broken"))


@query("q09_pending_stage", "select item_id, row_number() over (order by source_id, version_id) as position from rows_ where run_id = 3 and status "
    "= 'INDEX_READY'", rows_=STAGE_ROWS)
def _(rows_):
    return op.pending_stage(rows_, 3, "INDEX_READY").select("item_id", "position")


REJECTS = (
    "select doc_id as id, source as uri, md5(left(text, 3)) as content_hash, case when doc_id % 2 = 0 then 'PARSE' else "
    "'CHUNK' end as stage, case when doc_id % 9 = 0 then 'bad code' else concat('CODE_', cast(doc_id % 4 as varchar(9))) "
    "end as code, case when doc_id % 10 = 0 then left(text, 300) else 'no content' end as reason from {documents}"
)


@query("q10_quarantine", "select uri, content_hash, stage, reason, min(id) as id, arg_min(code, id) as code from rows_ where "
    "regexp_full_match(code, '[A-Z][A-Z0-9_]{0,63}') and length(reason) <= 256 and not contains(reason, chr(10)) group by "
    "1, 2, 3, 4", rows_=REJECTS)
def _(rows_):
    return op.quarantine(rows_)


CHUNKS = (
    "select doc_id as chunk_id, source as batch_id, case when doc_id % 10 = 3 then 'SUSPECT' when doc_id % 25 = 7 then "
    "'FAILED' else 'CLEAN' end as phi_scan_status, case when doc_id % 10 = 3 then array['PHONE', 'EMAIL'] else "
    "array['AGE'] end as phi_entity_types, length(text) as length, contains(text, '@') as warned, source, text, lang from "
    "{documents}"
)
CHUNKS = (CHUNKS.replace("array['PHONE', 'EMAIL']", "array('PHONE', 'EMAIL')").replace("array['AGE']", "array('AGE')"), CHUNKS)


@query("q11_phi_review", "select chunk_id, phi_scan_status, array_to_string(list_sort(phi_entity_types), ',') as types from chunks where "
    "phi_scan_status <> 'CLEAN'", chunks=CHUNKS)
def _(chunks):
    return op.phi_review(chunks).select("chunk_id", "phi_scan_status", F.array_join("phi_entity_types", ",").alias("types"))


@query("q12_list_queue", "select id, row_number() over (order by created_at, id) as place from queue where status = 'error'", queue="select event_id as id, event_type as status, ts as created_at from {events}")
def _(queue):
    return op.list_queue(queue, "error").select("id", "place")


@query("q13_completeness", "with c as (select batch_id, count(*) as total, count(*) filter (coalesce(trim(lang), '') = '') as lang, count(*) "
    "filter (coalesce(trim(kind), '') = '') as kind from rows_ group by 1) select batch_id, total, 'lang' as field, lang "
    "as missing, lang = 0 as passed from c union all select batch_id, total, 'kind', kind, kind = 0 from c", rows_="select source as batch_id, lang, case when doc_id % 40 = 0 then ' ' when doc_id % 41 = 0 then null else 'page' end as "
    "kind from {documents}")
def _(rows_):
    return op.completeness(rows_, ["lang", "kind"])


VECTORS = "select vec_id as chunk_id, embedding from {embeddings}"


@query("q14_embedding_coverage", "select batch_id, count(*) as chunks, count(v.chunk_id) as covered, count(*) = count(v.chunk_id) as passed from chunks "
    "c left join (select distinct chunk_id from vectors where len(embedding) = 64) v using (chunk_id) where "
    "phi_scan_status = 'CLEAN' group by 1", chunks=CHUNKS, vectors=VECTORS)
def _(chunks, vectors):
    return op.embedding_coverage(chunks, vectors, 64)


@query("q15_orphan_vectors", "select chunk_id from vectors where chunk_id not in (select chunk_id from chunks)", chunks="select doc_id as chunk_id from {documents} where doc_id % 3 <> 0", vectors=VECTORS)
def _(chunks, vectors):
    return op.orphan_vectors(vectors, chunks)


@query("q16_distribution_checks", "with p as (select batch_id, count(*) as n, quantile_cont(length, 0.5) as p50, quantile_cont(length, 0.95) as p95, "
    "avg(warned::int) as warned_share from chunks group by 1), c as (select *, n / lag(n) over (order by batch_id) as "
    "change from p) select batch_id, n, round(p50, 6) as p50, round(p95, 6) as p95, round(warned_share, 9) as "
    "warned_share, round(change, 9) as change, coalesce(change between 0.5 and 2.0, true) as in_range from c", chunks=CHUNKS)
def _(chunks):
    out = op.distribution_checks(chunks)
    return out.select("batch_id", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("warned_share", 9).alias("warned_share"), F.round("change", 9).alias("change"), "in_range")


@query("q17_residual_sample", "select chunk_id from chunks where cast(concat('0x', left(sha256(cast(chunk_id as varchar)), 8)) as bigint) % 100 < 5", chunks=CHUNKS)
def _(chunks):
    return op.residual_sample(chunks, 5).select("chunk_id")


_FUNNEL_SQL = " union all ".join(f"select batch_id, '{s}' as stage, count(*) as rows_in, count(*) filter (reached > {i}) as rows_out, count(*) filter (reached = {i}) as rows_lost, coalesce(string_agg(distinct reason, ',' order by reason) filter (reached = {i}), '') as reasons from items where reached >= {i} group by 1" for i, s in enumerate(op.FUNNEL))


@query("q18_ingestion_funnel", _FUNNEL_SQL, items="select source as batch_id, doc_id as item_id, doc_id % 9 as reached, concat('R', cast(doc_id % 3 as varchar(3))) as "
    "reason from {documents}")
def _(items):
    return op.ingestion_funnel(items).withColumn("reasons", F.array_join("reasons", ","))
