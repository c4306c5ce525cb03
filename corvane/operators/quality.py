"""Batch quality gates, run accounting, quarantine and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def quality_snapshot(df: DataFrame) -> DataFrame:
    """Rows (batch_id, accepted, residual, entity_type, content_hash) per batch:
    totals, residual findings, counts by entity type as a map, distinct hashes."""
    totals = df.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if("residual").alias("residual_phi"), F.countDistinct("content_hash").alias("unique_hashes"),
    )
    types = df.where("entity_type is not null").groupBy("batch_id", "entity_type").count()
    types = types.groupBy("batch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "count")))).alias("entity_type_counts"))
    return totals.join(types, "batch_id", "left")


def quality_metrics(snapshot: DataFrame) -> DataFrame:
    """Long form (batch_id, metric, value): five metrics, 0 when nothing was seen."""
    rates = snapshot.select("batch_id", F.col("total").cast("double").alias("total"), _ratio(F.col("accepted"), F.col("total")).alias("acc"), _ratio(F.col("rejected"), F.col("total")).alias("rej"), F.col("residual_phi").cast("double").alias("res"), F.col("unique_hashes").cast("double").alias("uniq"))
    return rates.selectExpr("batch_id", "stack(5, 'TOTAL_RECORD_COUNT', total, 'ACCEPTANCE_RATE', acc, 'REJECTION_RATE', rej, 'RESIDUAL_PHI_COUNT', res, "
        "'UNIQUE_CONTENT_HASH_COUNT', uniq) as (metric, value)")


def evaluate_assertions(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (code, severity, metric, comparison, threshold): AT_LEAST and AT_MOST
    include the threshold; a rule without one fails."""
    joined = metrics.join(F.broadcast(rules), "metric")  # rules are a configuration table
    passed = F.when(F.col("comparison") == "AT_LEAST", F.col("value") >= F.col("threshold")).when(F.col("comparison") == "AT_MOST", F.col("value") <= F.col("threshold"))
    return joined.withColumn("passed", F.coalesce(passed, F.lit(False))).select("batch_id", "code", "severity", "metric", "value", "passed")


def batch_decision(results: DataFrame) -> DataFrame:
    """A batch is rejected if a BLOCKING assertion fails; failed WARNINGs are listed."""
    failed = ~F.col("passed")
    return results.groupBy("batch_id").agg(
        F.when(F.bool_or(failed & (F.col("severity") == "BLOCKING")), "REJECTED").otherwise("ACCEPTED").alias("decision"),
        F.array_sort(F.collect_set(F.when(failed & (F.col("severity") == "WARNING"), F.col("code")))).alias("warnings"),
    )


def quality_trend(results: DataFrame) -> DataFrame:
    """Against the batch before (by batch_id): change of value, newly failed, recovered."""
    w = Window.partitionBy("code").orderBy("batch_id")
    before = F.lag("passed").over(w)
    return (
        results.withColumn("delta", F.col("value") - F.lag("value").over(w))
        .withColumn("newly_failed", F.coalesce(before & ~F.col("passed"), F.lit(False)))
        .withColumn("recovered", F.coalesce(~before & F.col("passed"), F.lit(False)))
    )


STEPS = ("DISCOVERED", "PARSED", "DEIDENTIFIED", "CHUNKED", "EMBEDDED", "INDEXED", "SKIPPED")


def run_summary(items: DataFrame) -> DataFrame:
    """items (run_id, stage, duration_ms): one row per run with a count per step and
    the total duration."""
    counts = items.groupBy("run_id").pivot("stage", list(STEPS)).agg(F.count(F.lit(1))).na.fill(0)
    total = items.groupBy("run_id").agg(F.sum("duration_ms").alias("duration_ms"))
    return counts.join(total, "run_id").toDF("run_id", *(s.lower() for s in STEPS), "duration_ms")


ALLOWED = (("DISCOVERED", "DEIDENTIFIED"), ("DEIDENTIFIED", "INDEX_READY"), ("INDEX_READY", "INDEXED"), ("DISCOVERED", "QUARANTINED"), ("DEIDENTIFIED", "QUARANTINED"), ("INDEX_READY", "QUARANTINED"))


def stage_transitions(events: DataFrame) -> DataFrame:
    """events (item_id, seq, status): each with the status before and whether that
    step is allowed; the first must be DISCOVERED."""
    before = F.lag("status").over(Window.partitionBy("item_id").orderBy("seq"))
    step = F.concat_ws(">", "before", "status")
    out = events.withColumn("before", before)
    return out.withColumn("allowed", F.when(F.col("before").isNull(), F.col("status") == "DISCOVERED").otherwise(step.isin([">".join(p) for p in ALLOWED])))


def stage_violations(df: DataFrame) -> DataFrame:
    """Rows that break a stage table's checks, with the names of the broken ones."""
    checks = {
        "STATUS": ~F.col("status").isin("DISCOVERED", "DEIDENTIFIED", "INDEX_READY", "INDEXED", "QUARANTINED"),
        "COUNTS": (F.coalesce("chunk_count", F.lit(0)) < 0) | ((F.col("status") == "INDEXED") & F.coalesce(F.col("chunk_count") <= 0, F.lit(True))),
        "REASON": (F.col("status") == "QUARANTINED") & (F.coalesce(F.length("safe_reason"), F.lit(0)) == 0) | (F.length("safe_reason") > 256) | F.coalesce(F.col("safe_reason").contains("\n"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def pending_stage(df: DataFrame, run_id, state: str) -> DataFrame:
    """Rows of a run in a state, numbered in (source_id, version_id) order by ranges of it."""
    rows = df.where((F.col("run_id") == F.lit(run_id)) & (F.col("status") == state))
    return numbered(rows, [F.col("source_id").asc(), F.col("version_id").asc()], "position")


def quarantine(df: DataFrame) -> DataFrame:
    """Valid reject rows (code in capitals, one-line reason up to 256), one per
    (uri, content_hash, stage, reason): the earliest id."""
    valid = df.where(F.col("code").rlike("^[A-Z][A-Z0-9_]{0,63}$") & (F.length("reason") <= 256) & ~F.col("reason").contains("\n"))
    return valid.groupBy("uri", "content_hash", "stage", "reason").agg(F.min(F.struct("id", "code")).alias("first")).select("uri", "content_hash", "stage", "reason", "first.id", "first.code")


def phi_review(chunks: DataFrame) -> DataFrame:
    """Chunks whose scan is not CLEAN: ids, status and labels, never the text."""
    return chunks.where("phi_scan_status <> 'CLEAN'").select("chunk_id", "phi_scan_status", F.array_sort("phi_entity_types").alias("phi_entity_types"))


def list_queue(df: DataFrame, status: str) -> DataFrame:
    """Queue entries of a status with their place, oldest first, by ranges of time."""
    return numbered(df.where(F.col("status") == status), [F.col("created_at").asc(), F.col("id").asc()], "place")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per batch and column: rows, missing rows, passed (none missing)."""
    counts = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns]
    wide = df.groupBy("batch_id").agg(F.count("*").alias("total"), *counts)
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return wide.selectExpr("batch_id", "total", f"stack({len(columns)}, {pairs}) as (field, missing)").withColumn("passed", F.col("missing") == 0)


def embedding_coverage(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Per batch of CLEAN chunks: with a vector of the right dimension; passed at 100 %."""
    good = vectors.where(F.size("embedding") == dimension).select("chunk_id").distinct().withColumn("has", F.lit(1))
    joined = chunks.where("phi_scan_status = 'CLEAN'").join(good, "chunk_id", "left")
    return joined.groupBy("batch_id").agg(F.count("*").alias("chunks"), F.count("has").alias("covered")).withColumn("passed", F.col("chunks") == F.col("covered"))


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors without a chunk."""
    return vectors.join(chunks, "chunk_id", "left_anti").select("chunk_id")


def distribution_checks(df: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Batches (batch_id, length, warned): rows against the batch before, length
    percentiles, share of rows with warnings."""
    per = df.groupBy("batch_id").agg(F.count("*").alias("n"), F.expr("percentile(length, 0.5)").alias("p50"), F.expr("percentile(length, 0.95)").alias("p95"), F.avg(F.col("warned").cast("int")).alias("warned_share"))
    change = F.col("n") / F.lag("n").over(Window.orderBy("batch_id"))  # one row for each batch
    return per.withColumn("change", change).withColumn("in_range", F.coalesce(F.col("change").between(low, high), F.lit(True)))


def residual_sample(df: DataFrame, percent: int, id_column: str = "chunk_id") -> DataFrame:
    """A stable share of rows, by the hash of the id."""
    part = F.conv(F.substring(F.sha2(F.col(id_column).cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return df.where(part < percent)


FUNNEL = ("DISCOVER", "PARSE", "DEIDENTIFY", "CHUNK", "EMBED", "INDEX")


def ingestion_funnel(df: DataFrame) -> DataFrame:
    """items (batch_id, item_id, reached: number of stages passed, reason): rows in,
    out and lost per stage, with the reasons; in = out + lost."""
    stages = df.select("*", F.posexplode(F.array(*map(F.lit, FUNNEL))).alias("step", "stage")).where("reached >= step")
    lost = F.col("reached") == F.col("step")
    out = stages.groupBy("batch_id", "step", "stage").agg(F.count("*").alias("rows_in"), F.count_if(~lost).alias("rows_out"), F.count_if(lost).alias("rows_lost"), F.array_sort(F.collect_set(F.when(lost, F.col("reason")))).alias("reasons"))
    return out.drop("step")
