"""W: events are requests and spans; value is the latency."""

from pyspark.sql import functions as F

from corvane.operators import metrics as op

from .base import query

EV = (
    "select event_id, ts, {epoch_} as epoch, event_type = 'error' as failed, value as latency, value, user_id, event_type, "
    "props from {events}"
)
EV = (EV.replace("{epoch_}", "unix_timestamp(cast(ts as timestamp))"), EV.replace("{epoch_}", "cast(floor(epoch(ts)) as bigint)"))
WIDTHS = {"1h": 3600, "6h": 21600, "1d": 86400}
_B = (
    "b as (select epoch - epoch % 3600 as bin, count(*) as n, sum((failed)::int) as bad, sum((latency > 50)::int) as slow, "
    "avg(latency) as lag from ev group by 1)"
)
_RATIO = _B + ", r as (" + " union all ".join(f"select bin, '{w}' as width, sum({{bad}}) over (order by bin range between {s - 1} preceding and current row) / sum(n) over (order by bin range between {s - 1} preceding and current row) as ratio from b" for w, s in WIDTHS.items()) + ")"
_ERR, _LAT = _RATIO.replace("{bad}", "bad"), _RATIO.replace("{bad}", "slow")


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("w01_error_ratio", "with " + _ERR + " select bin, width, round(ratio, 6) as ratio from r", ev=EV)
def _(ev):
    return _r(op.error_ratio(ev, WIDTHS), "ratio")


@query("w02_latency_error_ratio", "with " + _LAT + " select bin, width, round(ratio, 6) as ratio from r", ev=EV)
def _(ev):
    return _r(op.latency_error_ratio(ev, 50.0, WIDTHS), "ratio")


@query("w03_burn_alerts", "with " + _ERR + " select a.bin, '1h/1d' as rule from r a join r b on a.bin = b.bin and a.width = '1h' and b.width = '1d' where a.ratio "
    "> 0.2 and b.ratio > 0.2 union all select a.bin, '6h/1d' from r a join r b on a.bin = b.bin and a.width = '6h' and "
    "b.width = '1d' where a.ratio > 0.21 and b.ratio > 0.21", ev=EV)
def _(ev):
    return op.burn_alerts(op.error_ratio(ev, WIDTHS), 0.02, (("1h", "1d", 10.0), ("6h", "1d", 10.5)))


EDGES = (10.0, 25.0, 50.0, 75.0)


@query("w04_histogram_p95", """with b as (select event_type, case when value <= 10 then 0 when value <= 25 then 1 when value <= 50 then 2
  when value <= 75 then 3 else 4 end as bucket, count(*) as n from ev group by 1, 2),
c as (select *, sum(n) over (partition by event_type order by bucket) as upto, 0.8 * sum(n) over (partition by event_type) as rank
  from b), f as (select * from c where upto >= rank qualify row_number() over (partition by event_type order by bucket) = 1)
select event_type, round(case when bucket = 4 then 75 else [0, 10, 25, 50][bucket + 1] + ([10, 25, 50, 75][bucket + 1] - [0, 10,
  25, 50][bucket + 1]) * (rank - (upto - n)) / n end, 4) as p95 from f""", ev=EV)
def _(ev):
    return op.histogram_p95(ev, EDGES, ("event_type",), 0.8).withColumn("p95", F.round("p95", 4))


@query("w05_budget_remaining", "with " + _ERR + " select bin, width, round(least(100.0, 100 * (1 - ratio / 0.3)), 4) as remaining from r", ev=EV)
def _(ev):
    return op.budget_remaining(op.error_ratio(ev, WIDTHS), 0.3).select("bin", "width", F.round("remaining", 4).alias("remaining"))


@query("w06_sustained", "with b as (select event_type as key, epoch - epoch % 3600 as bin, count(*) > 2 as holds from ev group by 1, 2), i as "
    "(select *, bin // 3600 - row_number() over (partition by key order by bin) as island from b where holds) select key, "
    "min(bin) as since, max(bin) as until, count(*) as bins from i group by key, island having count(*) >= 3", ev=EV)
def _(ev):
    bins = op.binned(ev.withColumn("key", F.col("event_type")), 3600, ("key",)).withColumn("holds", F.col("n") > 2)
    return op.sustained(bins, 3, 3600)


@query("w06_absent", "select distinct event_id // 5 as key from ev where event_id // 5 not in (select event_id // 5 from ev where value > "
    "60)", ev=EV)
def _(ev):
    keyed = ev.withColumn("key", F.expr("event_id div 5"))
    return op.absent(keyed.select("key").distinct(), keyed.where("value > 60").select("key"), ["key"])


@query("w07_lag_growth", "with " + _B + ", g as (select bin, avg(lag) over w as mean, regr_slope(lag, bin - 1704067200) over w as slope from b window w as "
    "(order by bin range between 10799 preceding and current row)) select bin, round(mean, 6) as mean from g where mean > "
    "45 and slope > 1e-9 and isfinite(slope)", ev=EV)
def _(ev):
    bins = op.binned(ev, 3600, (), total=F.col("latency")).select((F.col("bin") - 1704067200).alias("bin"), (F.col("total") / F.col("n")).alias("lag"))
    out = op.lag_growth(bins, 10800, 45.0).where("slope > 1e-9")
    return out.select((F.col("bin") + 1704067200).alias("bin"), F.round("mean", 6).alias("mean"))


TRACES = "select event_id, event_id % 3000 as trace_id, event_type = 'error' as failed, value as latency from {events}"


@query("w08_tail_sample", "with k as (select trace_id from spans group by 1 having bool_or(failed) or max(latency) > 150 or cast(concat('0x', "
    "left(sha256(cast(trace_id as varchar)), 8)) as bigint) % 100 < 10) select event_id, trace_id from spans where "
    "trace_id in (select trace_id from k)", spans=TRACES)
def _(spans):
    return op.tail_sample(spans, 10, 150.0).select("event_id", "trace_id")


@query("w09_span_metrics", "select date_trunc('hour', ts) as window_start, user_id % 4 as service, event_type as span, count(*) as calls, "
    "round(sum(latency), 4) as total, max(latency) as longest from ev group by 1, 2, 3", ev=EV)
def _(ev):
    return op.span_metrics(ev.withColumn("service", F.col("user_id") % 4).withColumn("span", F.col("event_type"))).withColumn("total", F.round("total", 4))


@query("w10_dashboard_snapshot", "select 'view' as kind, 'OK' as status, count(*) as n, round(avg(value), 6) as mean, max(value) as worst, count(*) "
    "filter (value > 90) as alerts from ev where event_type = 'view' and ts >= timestamp '2024-01-05' and ts < timestamp "
    "'2024-01-12' union all select 'ghost', 'EMPTY', 0, null, null, 0", ev=EV)
def _(ev):
    kinds = ev.withColumn("kind", F.col("event_type"))
    parts = [op.dashboard_snapshot(kinds, k, "2024-01-05 00:00:00", "2024-01-12 00:00:00", 90.0) for k in ("view", "ghost")]
    return parts[0].union(parts[1]).withColumn("mean", F.round("mean", 6))


@query("w11_redact_attributes", "select event_id, case when event_id % 3 = 0 then 'app.role=****,outcome=web' else concat('app.role=', event_type, "
    "',outcome=web') end as kept from ev", ev=EV)
def _(ev):
    attributes = (
        "map('app.role', if(event_id % 3 = 0, 'Bearer x', event_type), 'outcome', 'web', 'gen_ai.usage.input_tokens', '7', "
        "'auth.token', 'y', 'k', 'z', 'source', 's')"
    )
    redacted = op.redact_attributes(ev.withColumn("attributes", F.expr(attributes)))
    return redacted.select("event_id", F.expr("array_join(transform(array_sort(map_entries(attributes)), e -> concat(e.key, '=', e.value)), ',')").alias("kept"))


@query("w12_governance_metrics", "select date_trunc('day', ts) as period, 'egress_blocked' as metric, event_type as label, count(*) as n, count(*) "
    "filter (failed) as hits, round(count(*) filter (failed) / count(*), 6) as rate from ev group by 1, 3 union all select "
    "date_trunc('day', ts), 'slow', cast(user_id % 5 as varchar), count(*), count(*) filter (value > 50), round(count(*) "
    "filter (value > 50) / count(*), 6) from ev group by 1, 3", ev=EV)
def _(ev):
    frames = {"egress_blocked": ev.select("ts", F.col("event_type").alias("label"), F.col("failed").alias("hit")), "slow": ev.select("ts", (F.col("user_id") % 5).cast("string").alias("label"), (F.col("value") > 50).alias("hit"))}
    return _r(op.governance_metrics(frames, "day"), "rate")


@query("w13_quality_trend_metrics", "select date_trunc('week', ts) as period, event_type as stage, case when user_id % 4 = 0 then 'degraded' else 'normal' "
    "end as path, count(*) as n, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as "
    "p95 from ev group by 1, 2, 3", ev=EV)
def _(ev):
    runs = ev.withColumn("stage", F.col("event_type")).withColumn("path", F.expr("if(user_id % 4 = 0, 'degraded', 'normal')"))
    return _r(op.quality_trend_metrics(runs, "week"), "p50", "p95")


USAGE = (
    "select cast(ts as date) as day, event_type as model, user_id % 3 as role, event_id % 500 as tokens, cast(floor(value) "
    "as bigint) as cost, event_id % 4 = 0 as cached, event_id % 3 as retries from {events}"
)


@query("w14_cost_metrics", "select day, model, role, cast(sum(tokens) as bigint) as tokens, cast(sum(cost) as bigint) as cost, cast(sum(case when "
    "cached then cost else 0 end) as bigint) as cache_saving, cast(sum(cost * retries) as bigint) as retry_cost from "
    "usage_ group by grouping sets ((day, model, role), (day, model), (day, role), (day))", usage_=USAGE)
def _(usage_):
    return op.cost_metrics(usage_)
