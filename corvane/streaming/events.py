"""Streaming twins of event operators. Watermark 10 minutes: later rows are counted by
late_rows, not merged. Each works on any streaming frame with an event time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive; zone-less times are cast, as watermarks need zones."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe_stream(events: DataFrame, key: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """First row of each key; state is dropped behind the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def seal_stream(events: DataFrame, chain_key: str = "user_id", content: str = "event_type") -> DataFrame:
    """prev_hash and hash per event of a chain, carried on from batch to batch in the
    chain's state; within a batch in order of (ts, event_id)."""

    def seal(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prev, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before, after = [], []
        for value in rows[content]:
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{value}".encode()).hexdigest()
            after.append(prev)
        state.update((prev, n + len(rows)))
        yield pd.DataFrame({"chain": key[0], "seq": range(n, n + len(rows)), "event_id": rows["event_id"].to_numpy(), "content": rows[content].to_numpy(), "prev_hash": before, "hash": after})

    schema = "chain long, seq long, event_id long, content string, prev_hash string, hash string"
    return events.groupBy(chain_key).applyInPandasWithState(seal, schema, "prev string, n long", "append", "NoTimeout")


def window_metrics(events: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Rows, failures and latency sums per tumbling or sliding window and type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "failed", "total")


def split_late(spans: DataFrame, on_time: str, late: str, tops: str, checkpoint: str, wait: str = "10 seconds", delay: str = WATERMARK) -> None:
    """One pass over a stream of spans into two sinks: those whose decision is still open,
    and those that come after it. A span is late if it lies `wait` and more behind the
    watermark: `delay` before the latest time of the batches before its own, which `tops`
    keeps. Batches are written by number, so a repeated one takes its first try's place."""

    def both(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        known = spark.createDataFrame([], "number long, top timestamp") if number == 0 else spark.read.parquet(tops)
        horizon = known.where(F.col("number") < number).agg(F.max("top").alias("top")).select(F.expr(f"top - interval {delay}").alias("horizon"))
        told = batch.crossJoin(F.broadcast(horizon)).withColumn("late", F.coalesce(F.expr(f"ts + interval {wait} <= horizon"), F.lit(False))).drop("horizon")
        told.where("not late").drop("late").write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        told.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        top = batch.agg(F.max("ts").alias("top")).select(F.lit(number).cast("long").alias("number"), "top")
        top.write.mode("overwrite").parquet(f"{tops}/batch={number}")
        batch.unpersist()

    spans.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_traces(spans: DataFrame, percent: int = 0, wait: str = "10 seconds", slow: float = 1.0, delay: str = WATERMARK) -> DataFrame:
    """spans (trace_id, event_id, ts, failed, latency), a stream -> trace_id, since,
    event_id, kept. A trace's spans are decided together once `wait` has passed without
    another: all are kept if one failed, was slower than `slow`, or the trace falls in a
    stable share. A session of one trace is small; sessions that are not closed stay in
    the state."""
    part = F.conv(F.substring(F.sha2(F.col("trace_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    closed = spans.withWatermark("ts", delay).groupBy(F.session_window("ts", wait).alias("w"), "trace_id").agg(
        F.collect_list("event_id").alias("spans"), F.max("latency").alias("latency"), F.bool_or("failed").alias("failed")
    )
    kept = F.col("failed") | (F.col("latency") > slow) | (part < percent)
    return closed.select("trace_id", F.col("w.start").alias("since"), F.explode("spans").alias("event_id"), F.coalesce(kept, F.lit(False)).alias("kept"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and stop; the result as a table."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def late_rows(events: DataFrame, watermark_s: int = 600) -> DataFrame:
    """Rows of a table in order of arrival (event_id) that a watermark would not merge:
    older than the latest time so far by more than it. By day of arrival, so no window
    holds all rows; the latest time of the days before comes from an aggregate."""
    from pyspark.sql import Window

    day = events.withColumn("part", F.floor(F.col("event_id") / 10_000))
    tops = day.groupBy("part").agg(F.max("ts").alias("top"))
    before = tops.withColumn("before", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "before")
    w = Window.partitionBy("part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = day.join(F.broadcast(before), "part").withColumn("latest", F.greatest(F.max("ts").over(w), "before"))
    return seen.where(F.unix_timestamp(F.col("latest").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) > watermark_s).select("event_id", "ts")
