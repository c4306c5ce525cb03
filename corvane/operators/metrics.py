"""Service-level metrics over event time. Trailing windows run over counts that are
first binned (a row per minute or hour), never over raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(events: DataFrame, bin_s: int, keys: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """events with epoch: per bin (its first second) and keys, n rows and named sums."""
    slot = (F.col("epoch") - F.col("epoch") % bin_s).alias("bin")
    return events.groupBy(slot, *keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def _trailing(column: str, width_s: int, keys: tuple[str, ...] = ()) -> Column:
    return F.sum(column).over(Window.partitionBy(*keys).orderBy("bin").rangeBetween(-width_s + 1, 0))


def error_ratio(events: DataFrame, widths: dict[str, int], bin_s: int = 3600, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of failed rows in trailing windows that end with each bin; long form
    (bin, width, ratio)."""
    bins = binned(events, bin_s, keys, bad=F.col("failed").cast("long"))
    ratios = {w: _trailing("bad", s, keys) / _trailing("n", s, keys) for w, s in widths.items()}
    wide = bins.select("bin", *keys, *(r.alias(f"r_{w}") for w, r in ratios.items()))
    pairs = ", ".join(f"'{w}', r_{w}" for w in widths)
    return wide.selectExpr("bin", *keys, f"stack({len(widths)}, {pairs}) as (width, ratio)")


def latency_error_ratio(events: DataFrame, threshold: float, widths: dict[str, int], bin_s: int = 3600) -> DataFrame:
    """1 - share of rows within the threshold, in trailing windows."""
    return error_ratio(events.withColumn("failed", F.col("latency") > threshold), widths, bin_s)


def burn_alerts(ratios: DataFrame, budget: float, rules: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """(bin, rule) where both widths of a rule (short, long, factor) burn faster than
    budget * factor."""
    wide = ratios.groupBy("bin").pivot("width", sorted({w for r in rules for w in r[:2]})).agg(F.first("ratio"))
    hits = [wide.where((F.col(f"`{a}`") > budget * x) & (F.col(f"`{b}`") > budget * x)).select("bin", F.lit(f"{a}/{b}").alias("rule")) for a, b, x in rules]
    out = hits[0]
    for other in hits[1:]:
        out = out.union(other)
    return out


def histogram_p95(events: DataFrame, edges: tuple[float, ...], keys: tuple[str, ...], q: float = 0.95) -> DataFrame:
    """Quantile from bucket counts, linear within the bucket; beyond the last edge, the
    last edge."""
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(F.col("value") <= edges[i], i).otherwise(bucket)
    counts = events.groupBy(*keys, bucket.alias("bucket")).count()
    w = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("count").over(w.orderBy("bucket"))).withColumn("rank", F.sum("count").over(w) * q)
    first = run.where(F.col("upto") >= F.col("rank")).groupBy(*keys).agg(F.min(F.struct("bucket", "upto", "count", "rank")).alias("b"))
    high = F.element_at(F.array(*(F.lit(float(e)) for e in (*edges, edges[-1]))), F.col("b.bucket") + 1)
    low = F.element_at(F.array(*(F.lit(float(e)) for e in (0, *edges))), F.col("b.bucket") + 1)
    inside = low + (high - low) * (F.col("b.rank") - (F.col("b.upto") - F.col("b.count"))) / F.col("b.count")
    return first.select(*keys, F.when(F.col("b.bucket") == len(edges), float(edges[-1])).otherwise(inside).alias("p95"))


def budget_remaining(ratios: DataFrame, budget: float) -> DataFrame:
    """Per cent of the error budget left, at most 100."""
    return ratios.withColumn("remaining", F.least(F.lit(100.0), 100 * (1 - F.col("ratio") / budget)))


def sustained(df: DataFrame, bins: int, bin_s: int) -> DataFrame:
    """df (key, bin, holds): stretches of neighbouring bins in which a condition held
    for at least `bins` bins, by gaps and islands."""
    on = df.where("holds").withColumn("island", F.col("bin") / bin_s - F.row_number().over(Window.partitionBy("key").orderBy("bin")))
    out = on.groupBy("key", "island").agg(F.min("bin").alias("since"), F.max("bin").alias("until"), F.count("*").alias("bins"))
    return out.where(F.col("bins") >= bins).drop("island")


def absent(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected signals that never came."""
    return expected.join(seen, keys, "left_anti")


def lag_growth(df: DataFrame, width_s: int, level: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """df (bin, lag): bins whose trailing mean is above the level while the slope of lag
    over time is positive."""
    w = Window.partitionBy(*keys).orderBy("bin").rangeBetween(-width_s + 1, 0)
    out = df.withColumns({"mean": F.avg("lag").over(w), "slope": F.regr_slope("lag", F.col("bin").cast("double")).over(w)})
    return out.where((F.col("mean") > level) & (F.col("slope") > 0))


def tail_sample(spans: DataFrame, percent: int, slow: float = 1.0) -> DataFrame:
    """All spans of traces that have an error, are slow, or fall in a stable share."""
    part = F.conv(F.substring(F.sha2(F.col("trace_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    keep = spans.groupBy("trace_id").agg(F.bool_or("failed").alias("failed"), F.max("latency").alias("latency")).where(F.col("failed") | (F.col("latency") > slow) | (part < percent))
    return spans.join(keep.select("trace_id"), "trace_id", "left_semi")


def span_metrics(spans: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls and durations per service, span and window."""
    out = spans.groupBy(F.window("ts", width).alias("w"), "service", "span").agg(F.count("*").alias("calls"), F.sum("latency").alias("total"), F.max("latency").alias("longest"))
    return out.select(F.col("w.start").alias("window_start"), "service", "span", "calls", "total", "longest")


def dashboard_snapshot(df: DataFrame, kind: str, start: str, end: str, alert_above: float) -> DataFrame:
    """One row of a range: count, mean, worst, alerts; status EMPTY without rows."""
    inside = df.where((F.col("kind") == kind) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    out = inside.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("worst"), F.count_if(F.col("value") > alert_above).alias("alerts"))
    return out.select(F.lit(kind).alias("kind"), F.when(F.col("n") == 0, "EMPTY").otherwise("OK").alias("status"), "n", "mean", "worst", "alerts")


#: Attribute keys that may leave a service.
SPAN_ATTRIBUTES = (
    "app.role", "batch.size", "client.address", "db.system.name", "degradation.code", "degradation.fallback_mode", "degradation.stage", "error.type", "exception.type", "gen_ai.operation.name", "gen_ai.provider.name",
    "gen_ai.request.model", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "http.request.method", "http.response.status_code", "http.route", "model.name", "network.protocol.name", "network.protocol.version",
    "outcome", "process.model", "queue.capacity", "queue.name", "retrieval.mode", "retrieval.result_count", "rpc.grpc.status_code", "rpc.method", "rpc.service", "rpc.system", "server.address", "server.port",
    "session.state", "url.scheme", "worker.count", "workload",
)
#: Keys and values that never leave, whatever the list says.
BLOCKED_KEYS = r"(?i).*(authorization|cookie|token|secret|password|query|prompt|content|document|chunk|patient|user\.id|session\.id).*"
BLOCKED_VALUES = r"(?i).*bearer\s+[a-z0-9._~+/=-]+.*"


def redact_attributes(spans: DataFrame, keys: tuple[str, ...] = SPAN_ATTRIBUTES) -> DataFrame:
    """attributes (map): only allowed keys of which none is blocked; a value that holds a
    bearer token becomes asterisks."""
    allowed = ", ".join(f"'{k}'" for k in keys)
    key, value = BLOCKED_KEYS.replace("\\", "\\\\"), BLOCKED_VALUES.replace("\\", "\\\\")
    kept = f"map_filter(attributes, (k, v) -> k in ({allowed}) and not k rlike '{key}')"
    return spans.withColumn("attributes", F.expr(f"transform_values({kept}, (k, v) -> regexp_replace(v, '{value}', '****'))"))


def governance_metrics(frames: dict[str, DataFrame], grain: str) -> DataFrame:
    """frames: name -> (ts, label, hit); per period, metric and label: rows, hits, rate."""
    out = None
    for name, df in frames.items():
        part = df.groupBy(F.date_trunc(grain, "ts").alias("period"), F.lit(name).alias("metric"), "label").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
        out = part if out is None else out.union(part)
    return out.withColumn("rate", F.col("hits") / F.col("n"))


def quality_trend_metrics(runs: DataFrame, grain: str) -> DataFrame:
    """runs (ts, path, stage, latency): percentiles per period, stage and path, normal
    and degraded paths apart."""
    return runs.groupBy(F.date_trunc(grain, "ts").alias("period"), "stage", "path").agg(F.count("*").alias("n"), F.expr("percentile(latency, 0.5)").alias("p50"), F.expr("percentile(latency, 0.95)").alias("p95"))


def cost_metrics(usage: DataFrame) -> DataFrame:
    """usage (day, model, role, tokens, cost, cached, retries): all combinations of
    model and role per day, what the cache saved and what retries added."""
    out = usage.groupingSets([["day", "model", "role"], ["day", "model"], ["day", "role"], ["day"]], "day", "model", "role").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum(F.when(F.col("cached"), F.col("cost")).otherwise(0)).alias("cache_saving"), F.sum(F.col("cost") * F.col("retries")).alias("retry_cost"))
    return out
