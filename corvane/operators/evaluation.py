"""Evaluation of retrieval, de-identification and trajectories."""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def relevant_ranks(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """spans (record_id, version_id, start, stop), hits (the same, with rank): distinct
    ranks of hits that overlap a span of the same record and version."""
    both = spans.join(hits.select("record_id", "version_id", F.col("start").alias("_a"), F.col("stop").alias("_b"), "rank"), ["record_id", "version_id"])
    return both.where(F.greatest("start", "_a") < F.least("stop", "_b")).select("record_id", "rank").distinct()


def retrieval_metrics(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """records (record_id, relevant_count), ranks (record_id, rank): precision@8,
    nDCG@8 (at most 1), recall hits at 5 and 10, reciprocal rank."""
    gain = 1 / F.log2(F.col("rank") + 1)
    per = ranks.groupBy("record_id").agg(
        F.count_if(F.col("rank") <= 8).alias("found"), F.sum(F.when(F.col("rank") <= 8, gain)).alias("dcg"), F.min("rank").alias("best"), F.count("*").alias("seen"))
    out = records.join(per, "record_id", "left").withColumn("n", F.least(F.greatest(F.coalesce("relevant_count", "seen", F.lit(0)), F.lit(0)), F.lit(8)).cast("int"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return out.select(
        "record_id", (F.coalesce("found", F.lit(0)) / 8).alias("precision_8"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.coalesce("dcg", F.lit(0.0)) / ideal, F.lit(1.0))).alias("ndcg_8"),
        F.coalesce(F.col("best") <= 5, F.lit(False)).alias("recall_5"), F.coalesce(F.col("best") <= 10, F.lit(False)).alias("recall_10"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def _overall() -> list[Column]:
    abstain = F.col("expected") == "abstain"
    return [
        F.count("*").alias("records"), _share(F.sum("valid_citations"), F.sum("citations")).alias("citation_validity"),
        _share(F.count_if(abstain & F.col("abstained")), F.count_if(abstain)).alias("abstain_when_expected"), _share(F.count_if(~abstain & F.col("abstained")), F.count_if(~abstain)).alias("false_abstain"),
        F.sum("unauthorized").alias("unauthorized"), F.avg(F.col("recall_5").cast("int")).alias("recall_5"), F.avg(F.col("recall_10").cast("int")).alias("recall_10"),
        F.avg("reciprocal_rank").alias("mrr"), F.avg("precision_8").alias("precision_8"), F.avg("ndcg_8").alias("ndcg_8"),
    ]


def overall_metrics(df: DataFrame) -> DataFrame:
    """One row over per-record rows (expected, abstained, citations, valid_citations,
    unauthorized and the retrieval metrics); ratios over nothing are 0."""
    return df.agg(*_overall()).na.fill(0)


def category_metrics(df: DataFrame) -> DataFrame:
    """The same by category."""
    return df.groupBy("category").agg(*_overall())


def failed_checks(df: DataFrame) -> DataFrame:
    tests = {
        "abstain_when_expected": (F.col("expected") == "abstain") & ~F.col("abstained"), "citation_validity": F.col("valid_citations") < F.col("citations"), "false_abstain_rate": (F.col("expected") != "abstain") & F.col("abstained"),
        "recall_at_10": ~F.col("recall_10"), "recall_at_5": ~F.col("recall_5"), "unauthorized_violations": F.col("unauthorized") > 0,
    }
    return df.withColumn("failed", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))))


def worst_cases(df: DataFrame, n: int = 10) -> DataFrame:
    """The n records with most failed checks, ties by id as text."""
    bad = failed_checks(df).where(F.size("failed") > 0)
    return bad.orderBy(F.size("failed").desc(), F.col("record_id").cast("string")).limit(n).select("record_id", "failed")


def judge_metrics(df: DataFrame) -> DataFrame:
    """Mean of supplied judge scores per judge, or unavailable."""
    return df.groupBy("judge").agg(F.avg("score").alias("mean"), F.count("score").alias("n")).withColumn("status", F.when(F.col("n") == 0, "UNAVAILABLE").otherwise("AVAILABLE"))


def record_summary(df: DataFrame) -> DataFrame:
    """A record (citations, supporting_spans, retrieved_chunks as arrays) as numbers only."""
    valid = F.size(F.filter("citations", lambda c: c["valid"]))
    return df.select("record_id", "category", F.size("citations").alias("citations"), valid.alias("valid_citations"), F.size("supporting_spans").alias("spans"), F.size("retrieved_chunks").alias("retrieved"))


def validate_dataset(df: DataFrame, targets: dict[str, float], tolerance: float = 0.02, holdout: float = 0.3) -> DataFrame:
    """Error rows (code, subject): missing fields, repeated ids, bad span bounds, and
    shares of categories and of the holdout out of range."""
    required = ("record_id", "question", "category", "split")
    missing = [df.where(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).select(F.lit(f"MISSING_{c.upper()}").alias("code"), F.coalesce(F.col("record_id").cast("string"), F.lit("?")).alias("subject")) for c in required]
    repeated = df.groupBy("record_id").count().where("count > 1").select(F.lit("DUPLICATE_ID").alias("code"), F.col("record_id").cast("string").alias("subject"))
    bounds = df.where("span_start < 0 or span_stop <= span_start").select(F.lit("SPAN_BOUNDS").alias("code"), F.col("record_id").cast("string").alias("subject"))
    total = df.agg(F.count("*").alias("total"), F.count_if(F.col("split") == "holdout").alias("held"))
    goal = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(v))))
    shares = df.groupBy("category").count().join(F.broadcast(total.select("total"))).where(F.abs(F.col("count") / F.col("total") - F.coalesce(goal[F.col("category")], F.lit(0.0))) > tolerance)
    off = shares.select(F.lit("CATEGORY_SHARE").alias("code"), F.col("category").alias("subject"))
    held = total.where(F.abs(F.col("held") / F.col("total") - holdout) > tolerance).select(F.lit("HOLDOUT_SHARE").alias("code"), F.lit("holdout").alias("subject"))
    out = repeated.union(bounds).union(off).union(held)
    for frame in missing:
        out = out.union(frame)
    return out


def validate_holdout(records: DataFrame, subsets: DataFrame) -> DataFrame:
    """subsets (subset_id, status, uses, record_ids): holdout ids in no or several
    subsets, unknown ids, and subsets whose status does not fit their use."""
    ids = records.where("split = 'holdout'").select("record_id")
    listed = subsets.select("subset_id", F.explode("record_ids").alias("record_id"))
    times = listed.groupBy("record_id").count()
    missing = ids.join(times, "record_id", "left_anti").selectExpr("'NOT_COVERED' as code", "cast(record_id as string) as subject")
    twice = times.where("count > 1").selectExpr("'COVERED_TWICE' as code", "cast(record_id as string) as subject")
    unknown = listed.join(ids, "record_id", "left_anti").selectExpr("'UNKNOWN_ID' as code", "cast(record_id as string) as subject")
    status = subsets.where("(status = 'CONSUMED') <> (uses > 0) or uses > 1").selectExpr("'STATUS' as code", "cast(subset_id as string) as subject")
    return missing.union(twice).union(unknown).union(status)


def consume_holdout(subsets: DataFrame, subset_id) -> DataFrame:
    """The ledger after one use of a subset; a consumed one is not used again."""
    chosen = (F.col("subset_id") == F.lit(subset_id)) & (F.col("status") == "AVAILABLE")
    return subsets.select("subset_id", F.when(chosen, "CONSUMED").otherwise(F.col("status")).alias("status"), (F.col("uses") + chosen.cast("int")).alias("uses"), chosen.alias("granted"))


ALIASES = {"recall@5": "recall_5", "recall@10": "recall_10", "ndcg@8": "ndcg_8", "p@8": "precision_8"}


def evaluate_gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics (metric, value), rules (metric, low, high): a metric that is not there,
    or has no value, fails."""
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    named = rules.withColumn("name", F.coalesce(alias[F.lower("metric")], F.lower("metric")))
    joined = named.join(metrics.select(F.col("metric").alias("name"), "value"), "name", "left")
    ok = F.coalesce(F.col("value") >= F.coalesce("low", F.lit(float("-inf"))), F.lit(False)) & F.coalesce(F.col("value") <= F.coalesce("high", F.lit(float("inf"))), F.lit(False))
    return joined.select("metric", "value", ok.alias("passed"))


def evaluation_trend(runs: DataFrame, model: str | None = None, limit: int = 100) -> DataFrame:
    """Latest runs, newest first, with the numeric metrics of their JSON in long form."""
    chosen = runs if model is None else runs.where(F.col("model") == model)
    latest = chosen.orderBy(F.col("created_at").desc(), "run_id").limit(min(limit, 100))
    return latest.select("run_id", "created_at", F.explode(F.from_json("metrics", "map<string,string>")).alias("metric", "text")).withColumn("value", F.expr("try_cast(text as double)")).where("value is not null").drop("text")


_SPAN = ["document_id", "entity_type", "start", "stop"]


def _matched(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    g, p = gold.select(*_SPAN).distinct().withColumn("g", F.lit(1)), predicted.select(*_SPAN).distinct().withColumn("p", F.lit(1))
    return g.join(p, _SPAN, "full_outer")


def deid_prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact-match precision, recall and F1 per entity type and overall (ALL)."""
    sums = [F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")]
    out = _matched(gold, predicted).rollup("entity_type").agg(*sums).withColumn("entity_type", F.coalesce("entity_type", F.lit("ALL")))
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def deid_confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Spans with equal ranges and another type, by gold and predicted type."""
    p = predicted.select("document_id", "start", "stop", F.col("entity_type").alias("predicted_type"))
    return gold.join(p, ["document_id", "start", "stop"]).where("entity_type <> predicted_type").groupBy("entity_type", "predicted_type").count()


def deid_missed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold spans that were not predicted exactly."""
    return gold.select(*_SPAN).join(predicted.select(*_SPAN), _SPAN, "left_anti")


def deid_direct_recall(gold: DataFrame, predicted: DataFrame, direct: tuple[str, ...]) -> DataFrame:
    """Share of direct identifiers that were found with their type, by type and overall
    (ALL)."""
    hit = predicted.select(*_SPAN).distinct().withColumn("hit", F.lit(1))
    joined = gold.where(F.col("entity_type").isin(*direct)).join(hit, _SPAN, "left")
    out = joined.rollup("entity_type").agg(F.count("*").alias("direct"), F.count("hit").alias("found"))
    return out.withColumn("entity_type", F.coalesce("entity_type", F.lit("ALL"))).withColumn("recall", _share(F.col("found"), F.col("direct")))


def validate_spans(df: DataFrame) -> DataFrame:
    """spans with text_length: rows with bad offsets, repeated spans or ranges."""
    w, r = Window.partitionBy(*_SPAN), Window.partitionBy("document_id", "start", "stop")
    out = df.withColumn("same", F.count("*").over(w)).withColumn("ranges", F.count("*").over(r))
    problem = F.when((F.col("start") < 0) | (F.col("stop") <= F.col("start")) | (F.col("stop") > F.col("text_length")), "OFFSETS").when(F.col("same") > 1, "DUPLICATE_SPAN").when(F.col("ranges") > 1, "DUPLICATE_RANGE")
    return out.withColumn("problem", problem).where("problem is not null").select(*_SPAN, "problem")


def trajectory_metrics(df: DataFrame) -> DataFrame:
    """Route accuracy (over rows with an expectation), citation ratio, abstain rate,
    unauthorised calls, p95 latency by nearest rank."""
    return df.agg(
        F.count("*").alias("n"), _share(F.count_if("route_correct"), F.count("route_correct")).alias("route_accuracy"), _share(F.sum("valid_citations"), F.sum("candidate_citations")).alias("citation_ratio"),
        F.avg(F.col("abstained").cast("int")).alias("abstain_rate"), F.sum("unauthorized").alias("unauthorized"), F.expr("cast(percentile_disc(0.95) within group (order by latency_ms) as long)").alias("p95_latency_ms"),
    )


def trajectory_gate(df: DataFrame) -> DataFrame:
    """passed only without any unauthorised call."""
    return df.agg(F.coalesce(F.bool_and(F.col("unauthorized") == 0), F.lit(True)).alias("passed"))


#: Endings of a trace and the reason each stands for.
_REASONS = {
    "ABSTAINED": "insufficient_evidence", "MAX_STEPS": "max_steps", "TIMEOUT": "timeout", "DEIDENTIFICATION_FAILED": "deidentification_failed",
    "RECOVERY_REJECTED": "recovery_rejected", "EXECUTION_ERROR": "execution_error",
}


def assemble_trajectories(events: DataFrame, states: DataFrame) -> DataFrame:
    """events (trace_id, phase, duration_ms, tool), states (trace_id, expected_class,
    actual_class, allowed_tools, termination): one row per trace. A trace that was ended
    otherwise than COMPLETED has the reason of its ending; empty if it was."""
    per = events.groupBy("trace_id").agg(F.coalesce(F.sum(F.when(F.col("phase") == "EXIT", F.col("duration_ms"))), F.lit(0)).alias("latency_ms"), F.array_sort(F.collect_list("tool")).alias("tools"))
    out = states.join(per, "trace_id", "left").withColumn("unauthorized", F.filter(F.coalesce("tools", F.array().cast("array<string>")), lambda t: ~F.array_contains("allowed_tools", t)))
    ended = F.create_map(*(F.lit(x) for pair in _REASONS.items() for x in pair))
    reason = F.when(F.coalesce("termination", F.lit("COMPLETED")) == "COMPLETED", "").otherwise(ended[F.col("termination")])
    return out.select("trace_id", F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), "unauthorized", F.when(F.col("expected_class").isNotNull(), F.col("expected_class").eqNullSafe(F.col("actual_class"))).alias("route_correct"), reason.alias("abstain_reason"))


#: The grid of the chunking experiment.
ABLATION = {"strategy": ("fixed", "structure", "semantic"), "targetTokens": (256, 512, 1024), "overlapTokens": (0, 50, 128)}


def ablation_plan(spark, controls: dict) -> DataFrame:
    """run_id, strategy, target, overlap, config_hash of the 27 runs: all settings of
    ABLATION. The hash is that of the sorted setting with its controls as JSON, so a run
    keeps its id as long as neither changes."""
    rows = []
    for strategy, target, overlap in itertools.product(*ABLATION.values()):
        if overlap >= target:
            raise ValueError(f"overlap must be below target: {overlap} >= {target}")
        setting = {"strategy": strategy, "targetTokens": target, "overlapTokens": overlap, "controls": controls}
        digest = hashlib.sha256(json.dumps(setting, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append((f"m25-{strategy}-{target}-{overlap}-{digest[:12]}", f"{strategy}-v1", target, overlap, digest))
    return spark.createDataFrame(rows, "run_id string, strategy string, target int, overlap int, config_hash string")


def ablation_grid(strategies: list[str], targets: list[int], overlaps: list[int]) -> str:
    """SQL of the run grid: overlap below target; the id hashes the sorted setting."""
    rows = [f"('{s}', {t}, {o})" for s in strategies for t in targets for o in overlaps if o < t]
    return (
        "select concat('run-', substring(sha2(concat('{\"overlap\":', o, ',\"strategy\":\"', s, '\",\"target\":', t, '}'), "
        "256), 1, 16)) as run_id, s as strategy, t as target, o as overlap from (values "
    ) + ", ".join(rows) + ") as g(s, t, o)"


def ablation_merge(plan: DataFrame, results: DataFrame) -> DataFrame:
    """plan (run_id, config_hash), results (run_id, config_hash, metric_text): OK or
    the first of UNKNOWN_RUN, MISSING_RUN, DUPLICATE_RUN, HASH_DRIFT, NOT_NUMERIC."""
    per = results.groupBy("run_id").agg(F.count("*").alias("n"), F.min("config_hash").alias("result_hash"), F.min("metric_text").alias("metric_text"))
    both = plan.select("run_id", F.col("config_hash").alias("plan_hash")).join(per, "run_id", "full_outer")
    code = (
        F.when(F.col("plan_hash").isNull(), "UNKNOWN_RUN").when(F.col("n").isNull(), "MISSING_RUN").when(F.col("n") > 1, "DUPLICATE_RUN")
        .when(F.col("plan_hash") != F.col("result_hash"), "HASH_DRIFT").when(F.expr("try_cast(metric_text as double)").isNull(), "NOT_NUMERIC").otherwise("OK")
    )
    return both.select("run_id", code.alias("code"))


def control_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields (id, field, value) that differ between two sides, nulls being a value."""
    x, y = a.select("id", "field", F.struct("value").alias("x")), b.select("id", "field", F.struct("value").alias("y"))
    both = x.join(y, ["id", "field"], "full_outer").where(~F.col("x.value").eqNullSafe(F.col("y.value")))
    return both.select("id", "field", F.col("x.value").alias("before"), F.col("y.value").alias("after"))
