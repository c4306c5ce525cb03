"""E: records are documents and benchmark items, spans are cut from texts."""

from pyspark.sql import functions as F

from corvane.operators import evaluation as op

from .base import query

SPANS = "select o_orderkey as record_id, o_custkey % 5 as version_id, o_orderkey % 50 as start, o_orderkey % 50 + 20 as stop from {orders}"
HITS = (
    "select l_orderkey as record_id, l_suppkey % 5 as version_id, l_partkey % 60 as start, l_partkey % 60 + 15 as stop, "
    "l_linenumber as rank from {lineitem}"
)
RECORDS = (
    "select o_orderkey as record_id, case when o_orderkey % 3 = 0 then cast(null as bigint) else o_orderkey % 10 end as "
    "relevant_count, substr(o_orderpriority, 3) as category, case when o_orderkey % 6 = 0 then 'abstain' else 'answer' end "
    "as expected, o_orderkey % 5 = 0 as abstained, o_orderkey % 4 as citations, o_orderkey % 4 - o_orderkey % 2 * (case "
    "when o_orderkey % 4 > 0 then 1 else 0 end) as valid_citations, case when o_orderkey % 100 = 0 then 1 else 0 end as "
    "unauthorized from {orders}"
)
_RANKS = (
    "r as (select distinct record_id, rank from spans s join hits h using (record_id, version_id) where greatest(s.start, "
    "h.start) < least(s.stop, h.stop))"
)
_RM = _RANKS + """, p as (select record_id, count(*) filter (rank <= 8) as found, sum(1 / log2(rank + 1)) filter (rank <= 8) as dcg, min(rank) as
  best, count(*) as seen from r group by 1),
n as (select *, least(greatest(coalesce(relevant_count, seen, 0), 0), 8) as n from records left join p using (record_id)),
i as (select k, (select sum(1 / log2(j + 1)) from range(1, k + 1) t(j)) as ideal from range(1, 9) q(k)),
m as (select n.*, coalesce(found, 0) / 8 as precision_8, case
  when n = 0 then 0 else least(coalesce(dcg, 0) / ideal, 1) end as ndcg_8, coalesce(best <= 5, false) as recall_5, coalesce(best
  <= 10, false) as recall_10, coalesce(1 / best, 0) as reciprocal_rank from n left join i on i.k = n.n)"""


@query("e01_relevant_ranks", "with " + _RANKS + " select * from r", spans=SPANS, hits=HITS)
def _(spans, hits):
    return op.relevant_ranks(spans, hits)


def _per_record(spans, hits, records):
    return records.join(op.retrieval_metrics(records, op.relevant_ranks(spans, hits)), "record_id")


@query("e02_retrieval_metrics", "with " + _RM + " select record_id, round(precision_8, 6) as precision_8, round(ndcg_8, 6) as ndcg_8, recall_5, recall_10, "
    "round(reciprocal_rank, 6) as reciprocal_rank from m", spans=SPANS, hits=HITS, records=RECORDS)
def _(spans, hits, records):
    out = op.retrieval_metrics(records, op.relevant_ranks(spans, hits))
    return out.withColumns({c: F.round(c, 6) for c in ("precision_8", "ndcg_8", "reciprocal_rank")})


_OVER = """count(*) as records, round(sum(valid_citations) / sum(citations), 6) as citation_validity, round(count(*) filter (expected = 'abstain' and abstained) / count(*) filter (expected = 'abstain'), 6) as abstain_when_expected,
 round(count(*) filter (expected <> 'abstain' and abstained) / count(*) filter (expected <> 'abstain'), 6) as false_abstain, cast(sum(unauthorized) as bigint) as unauthorized, round(avg(recall_5::int), 6) as recall_5, round(avg(recall_10::int), 6) as recall_10,
 round(avg(reciprocal_rank), 6) as mrr, round(avg(precision_8), 6) as precision_8, round(avg(ndcg_8), 6) as ndcg_8"""
_ROUNDED = ("citation_validity", "abstain_when_expected", "false_abstain", "recall_5", "recall_10", "mrr", "precision_8", "ndcg_8")


def _rounded(df, columns=_ROUNDED):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("e03_overall_metrics", "with " + _RM + f" select {_OVER} from m", spans=SPANS, hits=HITS, records=RECORDS)
def _(spans, hits, records):
    return _rounded(op.overall_metrics(_per_record(spans, hits, records)))


@query("e04_category_metrics", "with " + _RM + f" select category, {_OVER} from m group by 1", spans=SPANS, hits=HITS, records=RECORDS)
def _(spans, hits, records):
    return _rounded(op.category_metrics(_per_record(spans, hits, records)))


@query("e05_worst_cases", "with " + _RM + """, f as (select record_id, list_filter([case when expected = 'abstain' and not abstained then 'abstain_when_expected' end, case
  when valid_citations < citations then 'citation_validity' end, case when expected <> 'abstain' and abstained then 'false_abstain_rate' end,
case when not recall_10 then 'recall_at_10' end, case when not recall_5 then 'recall_at_5' end, case
  when unauthorized > 0 then 'unauthorized_violations' end], lambda x: x is not null) as failed from m)
select record_id, array_to_string(failed, ',') as failed from f where len(failed) > 0 order by len(failed) desc, cast(record_id as varchar) limit 10""", spans=SPANS, hits=HITS, records=RECORDS)
def _(spans, hits, records):
    return op.worst_cases(_per_record(spans, hits, records)).withColumn("failed", F.array_join("failed", ","))


@query("e06_judge_metrics", "select judge, round(avg(score), 6) as mean, count(score) as n, case when count(score) = 0 then 'UNAVAILABLE' else "
    "'AVAILABLE' end as status from scores group by 1", scores="select event_type as judge, case when event_type = 'signup' then null else value end as score from {events}")
def _(scores):
    return _rounded(op.judge_metrics(scores), ("mean",))


@query("e07_record_summary", "select doc_id as record_id, source as category, doc_id % 4 as citations, (doc_id % 4 + 1) // 2 as valid_citations, "
    "doc_id % 3 as spans, doc_id % 6 as retrieved from docs", docs="select doc_id, source from {documents}")
def _(docs):
    nested = docs.selectExpr("doc_id as record_id", "source as category", "transform(slice(array(0, 1, 2), 1, cast(doc_id % 4 as int)), i -> named_struct('valid', i % 2 = 0)) as citations", "slice(array(0, 1, 2), 1, cast(doc_id % 3 as int)) as supporting_spans", "slice(array(0, 1, 2, 3, 4), 1, cast(doc_id % 6 as int)) as retrieved_chunks")
    return op.record_summary(nested)


DATASET = (
    "select case when doc_id % 50 = 0 then 1 else doc_id end as record_id, case when doc_id % 40 = 1 then ' ' else text "
    "end as question, source as category, case when doc_id % 5 = 0 then 'holdout' else 'dev' end as split, doc_id % 30 - 1 "
    "as span_start, doc_id % 29 as span_stop from {documents}"
)


@query("e08_validate_dataset", """with t as (select count(*) as total, count(*) filter (split = 'holdout') as held from d)
select 'MISSING_QUESTION' as code, cast(record_id as varchar) as subject from d where trim(question) = '' union all
  select 'DUPLICATE_ID', cast(record_id as varchar) from d group by record_id having count(*) > 1
union all select 'SPAN_BOUNDS', cast(record_id as varchar) from d where span_start < 0 or span_stop <= span_start union all
  select 'CATEGORY_SHARE', category from d, t group by category, total having abs(count(*) / total - case category
  when 'src0' then 0.3 when 'src1' then 0.05 else 0 end) > 0.02
union all select 'HOLDOUT_SHARE', 'holdout' from t where abs(held / total - 0.3) > 0.02""", d=DATASET)
def _(d):
    return op.validate_dataset(d, {"src0": 0.3, "src1": 0.05})


SUBSETS = ("select label as subset_id, case when label % 3 = 0 then 'CONSUMED' else 'AVAILABLE' end as status, cast(label % 4 as "
    "int) as uses, collect_list(vec_id) as record_ids from {embeddings} group by label", "select label as subset_id, case when label % 3 = 0 then 'CONSUMED' else 'AVAILABLE' end as status, cast(label % 4 as "
    "int) as uses, list(vec_id) as record_ids from {embeddings} group by label")


@query("e09_validate_holdout", """with ids as (select record_id from d where split = 'holdout'), l as (select subset_id, unnest(record_ids) as record_id from subsets)
select 'NOT_COVERED' as code, cast(record_id as varchar) as subject from ids where record_id not in (select record_id from l)
  union all select 'COVERED_TWICE', cast(record_id as varchar) from l group by record_id having count(*) > 1
union all select 'UNKNOWN_ID', cast(record_id as varchar) from l where record_id not in (select record_id from ids) union all
  select 'STATUS', cast(subset_id as varchar) from subsets where (status = 'CONSUMED') <> (uses > 0) or uses > 1""", d="select doc_id as record_id, case when doc_id % 2 = 0 then 'holdout' else 'dev' end as split from {documents}", subsets=SUBSETS)
def _(d, subsets):
    return op.validate_holdout(d, subsets)


@query("e09_consume_holdout", "select subset_id, case when subset_id = 4 and status = 'AVAILABLE' then 'CONSUMED' else status end as status, uses + "
    "case when subset_id = 4 then 1 else 0 end as uses, subset_id = 4 as granted from subsets", subsets=SUBSETS)
def _(subsets):
    return op.consume_holdout(subsets, 4)


GATE = (
    "select * from (values ('recall@5', 0.5, cast(null as double)), ('MRR', 0.2, 0.9), ('unauthorized', cast(null as "
    "double), 0.0), ('faithfulness', 0.5, cast(null as double))) as g(metric, low, high)"
)


@query("e10_evaluate_gate", "with " + _RM + ", v as (select 'recall@5' as metric, avg(recall_5::int) as value from m union all select 'MRR', avg(reciprocal_rank) "
    "from m union all select 'unauthorized', sum(unauthorized)::double from m) select g.metric, round(value, 6) as value, "
    "coalesce(value >= coalesce(low, -1e300), false) and coalesce(value <= coalesce(high, 1e300), false) as passed from "
    "rules g left join v using (metric)", spans=SPANS, hits=HITS, records=RECORDS, rules=GATE)
def _(spans, hits, records, rules):
    overall = op.overall_metrics(_per_record(spans, hits, records))
    long = overall.selectExpr("stack(3, 'recall_5', recall_5, 'mrr', mrr, 'unauthorized', cast(unauthorized as double)) as (metric, value)")
    return _rounded(op.evaluate_gate(long, rules), ("value",))


@query("e12_evaluation_trend", "with l as (select * from runs where model = 'view' order by created_at desc, run_id limit 50) select run_id, "
    "created_at, 'k' as metric, json_extract_string(metrics, '$.k')::double as value from l", runs="select event_id as run_id, ts as created_at, event_type as model, props as metrics from {events}")
def _(runs):
    return op.evaluation_trend(runs, "view", 50)


GOLD = (
    "select l_orderkey as document_id, l_returnflag as entity_type, l_partkey % 100 as start, l_partkey % 100 + l_suppkey "
    "% 9 + 1 as stop from {lineitem} where l_linenumber <= 4"
)
PRED = (
    "select l_orderkey as document_id, case when l_partkey % 6 = 0 then 'X' else l_returnflag end as entity_type, "
    "l_partkey % 100 as start, l_partkey % 100 + l_suppkey % 9 + 1 as stop from {lineitem} where l_linenumber <= 4 and "
    "l_partkey % 4 <> 0"
)
_MATCH = (
    "mt as (select *, g.h as gh, p.h as ph from (select distinct *, 1 as h from gold) g full join (select distinct *, 1 as "
    "h from pred) p using (document_id, entity_type, start, stop))"
)


@query("e13_deid_prf", "with " + _MATCH + """, c as (select coalesce(entity_type, 'ALL') as entity_type, count(*) filter (gh is not null
  and ph is not null) as tp, count(*) filter (gh is null) as fp, count(*) filter (ph is null) as fn from mt group by rollup(entity_type)),
s as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0 else tp / (tp + fn) end as r from c)
select entity_type, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case
  when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from s""", gold=GOLD, pred=PRED)
def _(gold, pred):
    return _rounded(op.deid_prf(gold, pred), ("precision", "recall", "f1"))


@query("e14_deid_confusion", "select g.entity_type, p.entity_type as predicted_type, count(*) as count from gold g join pred p using (document_id, "
    "start, stop) where g.entity_type <> p.entity_type group by 1, 2", gold=GOLD, pred=PRED)
def _(gold, pred):
    return op.deid_confusion(gold, pred)


@query("e14_deid_missed", "select * from gold g where not exists (select 1 from pred p where p.document_id = g.document_id and p.entity_type = "
    "g.entity_type and p.start = g.start and p.stop = g.stop)", gold=GOLD, pred=PRED)
def _(gold, pred):
    return op.deid_missed(gold, pred)


@query("e14_deid_direct_recall", "select coalesce(entity_type, 'ALL') as entity_type, count(*) as direct, count(h) as found, round(count(h) / count(*), "
    "6) as recall from gold g left join (select distinct document_id, entity_type, start, stop, 1 as h from pred) p using "
    "(document_id, entity_type, start, stop) where entity_type in ('A', 'R') group by rollup (entity_type)", gold=GOLD, pred=PRED)
def _(gold, pred):
    return _rounded(op.deid_direct_recall(gold, pred, ("A", "R")), ("recall",))


@query("e15_validate_spans", "with c as (select *, count(*) over (partition by document_id, entity_type, start, stop) as same, count(*) over "
    "(partition by document_id, start, stop) as ranges from spans) select document_id, entity_type, start, stop, case when "
    "start < 0 or stop <= start or stop > text_length then 'OFFSETS' when same > 1 then 'DUPLICATE_SPAN' else "
    "'DUPLICATE_RANGE' end as problem from c where start < 0 or stop <= start or stop > text_length or same > 1 or ranges "
    "> 1", spans="select l_orderkey as document_id, l_returnflag as entity_type, l_partkey % 9 - 1 as start, l_partkey % 9 + l_suppkey "
    "% 3 as stop, 10 as text_length from {lineitem}")
def _(spans):
    return op.validate_spans(spans)


TRAJ = (
    "select event_id as trace_id, case when event_id % 4 = 0 then cast(null as boolean) else event_id % 3 = 0 end as "
    "route_correct, event_id % 5 as candidate_citations, event_id % 5 - case when event_id % 5 > 2 then 1 else 0 end as "
    "valid_citations, event_type = 'error' as abstained, case when event_id % 500 = 0 then 1 else 0 end as unauthorized, "
    "cast(floor(value * 10) as bigint) as latency_ms from {events}"
)


@query("e16_trajectory_metrics", "select count(*) as n, round(count(*) filter (route_correct) / count(route_correct), 6) as route_accuracy, "
    "round(sum(valid_citations) / sum(candidate_citations), 6) as citation_ratio, round(avg(abstained::int), 6) as "
    "abstain_rate, cast(sum(unauthorized) as bigint) as unauthorized, quantile_disc(latency_ms, 0.95) as p95_latency_ms "
    "from traj", traj=TRAJ)
def _(traj):
    return _rounded(op.trajectory_metrics(traj), ("route_accuracy", "citation_ratio", "abstain_rate"))


@query("e17_trajectory_gate", "select bool_and(unauthorized = 0) as passed from traj", traj=TRAJ)
def _(traj):
    return op.trajectory_gate(traj)


@query("e20_ablation_merge", """with p as (select run_id, count(*) as n, min(config_hash) as rh, min(metric_text) as mt from results group by 1)
select run_id, case when config_hash is null then 'UNKNOWN_RUN' when n is null then 'MISSING_RUN' when n > 1 then 'DUPLICATE_RUN'
  when config_hash <> rh then 'HASH_DRIFT' when try_cast(mt as double) is null then 'NOT_NUMERIC' else 'OK' end as code from plan
  full join p using (run_id)""",
       plan="select o_orderkey as run_id, md5(o_orderpriority) as config_hash from {orders} where o_orderkey % 11 <> 0", results="select case when o_orderkey % 17 = 0 then o_orderkey + 1 else o_orderkey end as run_id, case when o_orderkey % 7 = 0 "
           "then 'x' else md5(o_orderpriority) end as config_hash, case when o_orderkey % 13 = 0 then 'n/a' else cast(o_orderkey "
           "as varchar(20)) end as metric_text from {orders}")
def _(plan, results):
    return op.ablation_merge(plan, results)


@query("e21_control_drift", "select id, field, a.value as before, b.value as after from (select *, 1 as x from a) a full join (select *, 1 as y "
    "from b) b using (id, field) where a.value is distinct from b.value",
       a="select o_orderkey as id, 'priority' as field, o_orderpriority as value from {orders} union all select o_orderkey, "
           "'status', o_orderstatus from {orders} where o_orderkey % 9 > 0", b="select o_orderkey as id, 'priority' as field, case when o_orderkey % 10 = 0 then null else o_orderpriority end as "
           "value from {orders} union all select o_orderkey, 'status', o_orderstatus from {orders} where o_orderkey % 8 > 0")
def _(a, b):
    return op.control_drift(a, b)


TRACE_EVENTS = (
    "select user_id as trace_id, case when event_id % 2 = 0 then 'EXIT' else 'ENTER' end as phase, event_id % 100 as "
    "duration_ms, event_type as tool from {events} where event_id % 20 = 0 or event_id % 7 = 0"
)
_ENDING = (
    "case user_id % 8 when 0 then 'TIMEOUT' when 1 then 'ABSTAINED' when 2 then 'MAX_STEPS' when 3 then 'DEIDENTIFICATION_FAILED'"
    " when 4 then 'RECOVERY_REJECTED' when 5 then 'EXECUTION_ERROR' when 6 then 'COMPLETED' end as termination"
)
_EXPECTED = "case when user_id % 4 = 0 then null when user_id % 4 = 1 then 'A' else 'B' end as expected_class"
_STATE = f"select distinct user_id as trace_id, {_EXPECTED}, case when user_id % 3 = 0 then 'A' else 'B' end as actual_class, {_ENDING}"
STATES = (_STATE + ", array('view', 'click', 'purchase') as allowed_tools from {events}", _STATE + " from {events}")


@query(
    "e22_assemble_trajectories",
    """with p as (
  select trace_id, coalesce(sum(duration_ms) filter (phase = 'EXIT'), 0) as latency_ms,
    coalesce(string_agg(tool, ',' order by tool) filter (tool not in ('view', 'click', 'purchase')), '') as unauthorized
  from te group by 1)
select trace_id, cast(coalesce(latency_ms, 0) as bigint) as latency_ms, coalesce(unauthorized, '') as unauthorized,
  case when expected_class is not null then expected_class = actual_class end as route_correct,
  case coalesce(termination, 'COMPLETED') when 'TIMEOUT' then 'timeout' when 'ABSTAINED' then 'insufficient_evidence'
  when 'MAX_STEPS' then 'max_steps'
    when 'DEIDENTIFICATION_FAILED' then 'deidentification_failed' when 'RECOVERY_REJECTED' then 'recovery_rejected'
    when 'EXECUTION_ERROR' then 'execution_error' when 'COMPLETED' then '' end as abstain_reason
from states left join p using (trace_id)""",
    te=TRACE_EVENTS,
    states=STATES,
)
def _(te, states):
    return op.assemble_trajectories(te, states).withColumn("unauthorized", F.array_join("unauthorized", ","))
