"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: sources take shares of `budget` times all words in proportion to their
weights; a source's target stops at `most` times its size and the excess is shared
again by weight. That is min(most * size, theta * weight) with one theta, found from
running sums over the sources in order of size / weight.

Rates: each document gets the rate most like its base rate (by length, or a column) under
which its source's words come to the target: the entropy of the rates relative to
the base rates is maximal under the token constraints, with rates between 0 and
`most`. The solution is an exponential tilt, rate = most * w / (1 + w) with
w = base / (most - base) * exp(lambda of the source), and the lambdas maximise a
concave dual whose gradient and curvature are sums over documents. Newton steps
compute these sums with one aggregate each, first collapsed to (source, base rate).

Rounding to copies: within a source, documents are taken in classes of falling size.
In each class the running sum of rates is rounded, so that after any prefix the
copies are within one of it; then the rates of the smaller classes are solved again
for what is left of the target. The error left over is in the order of the smallest
documents. Running sums are kept within hash buckets of a source, so no window holds
a whole hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, keep

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Classes of size, by the least number of words in each, in falling order.
CLASSES = (4096, 1024, 256, 64, 16, 0)
#: Documents of one source that share a window.
BUCKET = 4096
#: Newton steps before the fit is given up with an error.
NEWTON_STEPS = 90
_WORD = r"[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> with target. One row for each source, so the
    windows are over sources, not documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    weighted = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighted.withColumn("all", F.sum("source_size").over(everything) * F.lit(budget))
    filled = filled.withColumn("theta", (F.col("all") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that theta does not fill sets theta for itself and all behind it
    fits = F.min_by("theta", F.when(F.col("theta") * F.col("weight") <= F.col("stop"), F.col("stop") / F.col("weight"))).over(everything)
    return filled.withColumn("theta", fits).select("source", "source_size", F.coalesce(F.least("stop", F.col("theta") * F.col("weight")), "stop").alias("target"))


def _join_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on source, nulls being one source. right is small, but its size is
    not known here: the optimizer broadcasts it if it may."""
    renamed = right.withColumnRenamed("source", "_s")
    return left.join(renamed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _rate(base: Column, tilt: Column, most: int) -> Column:
    w = base / (F.lit(float(most)) - base) * F.exp(tilt)
    return F.lit(float(most)) * w / (1 + w)


def solve_tilts(histogram: DataFrame, needs: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """histogram(source, base, words), needs(source, need) -> (source, tilt); null
    where all documents get the full rate or none. Newton's method on the dual until
    every source's words are within a millionth of its need; a start from the mean base
    rate is near already if base rates differ little. A step is at most 4, halved each
    time that the gradient changes its sign, so steps cannot swing for ever; if they have
    not met after `steps`, an error says so."""
    totals = histogram.groupBy("source").agg(F.sum("words").alias("words"), F.try_divide(F.sum(F.col("base") * F.col("words")), F.sum("words")).alias("mean"))
    state = _join_source(totals, needs)
    share, mean = F.try_divide("need", F.col("words") * F.lit(float(most))), F.col("mean") / float(most)
    inside = (F.col("words") > 0) & (share > 1e-12) & (share < 1 - 1e-12)
    start = F.when(inside, F.ln(share / (1 - share)) - F.ln(mean / (1 - mean)))
    state = state.select("source", "need", start.alias("tilt"), F.lit(4.0).alias("most_move"), F.lit(0.0).alias("sign"))
    for step in range(steps):
        rated = _join_source(histogram, state).withColumn("rate", _rate(F.col("base"), F.col("tilt"), most))
        sums = rated.groupBy("source").agg(
            *(F.first(c).alias(c) for c in ("need", "tilt", "most_move", "sign")), F.sum(F.col("rate") * F.col("words")).alias("got"),
            F.sum(F.col("words") * F.col("rate") * (1 - F.col("rate") / most)).alias("curve"),
        )
        sums = sums.withColumn("now", F.signum(F.col("need") - F.col("got")))
        sums = sums.withColumn("most_move", F.when(F.col("now") * F.col("sign") < 0, F.col("most_move") / 2).otherwise(F.col("most_move")))
        move = F.greatest(-F.col("most_move"), F.least("most_move", (F.col("need") - F.col("got")) / F.greatest("curve", F.lit(1e-12))))
        off = F.try_divide(F.abs(F.col("need") - F.col("got")), "need")
        state = sums.select("source", "need", (F.col("tilt") + move).alias("tilt"), "most_move", F.col("now").alias("sign"), off.alias("off"))
        if step % 3 == 2:
            state = keep(state, "tilts")
            if state.where("off > 1e-6").isEmpty():
                return state.select("source", "tilt")
    raise ArithmeticError(f"sources are not within a millionth of their targets after {steps} steps")


def length_rate(words: Column) -> Column:
    """Base rate by length in sixteenths: half a copy for fragments, rising to one and a
    half for long texts, which carry more context for a word taken."""
    return F.round((F.lit(0.5) + words / (words + F.lit(64.0))) * 16) / 16


def row_key(id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> Column:
    """Digest of a row's id, source and text, nulls told from other values."""
    parts = [F.coalesce(F.col(text_column), F.lit(""))]
    for c in (id_column, source_column):
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", base_column: str | None = None) -> DataFrame:
    """Per row: id, size (words), source_size, target (both of its source), taken
    (words taken, repeats counted), copies (taken = copies * size), source, row_key.

    Null and wordless texts have size 0 and one copy. A null source is a source of
    its own, last in order. Repeated rows are documents of their own, told apart by
    nothing but their place among equals, so reruns agree. Base rates must lie
    between 0 and `most`, both excluded. An empty table gives an empty result.
    """
    words = F.expr(f"cast(regexp_count(coalesce({text_column}, ''), '{_WORD}') as long)")
    base = F.col(base_column).cast("double") if base_column else F.lit(1.0)
    slim = documents.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words.alias("size"), base.alias("base"), row_key(id_column, text_column, source_column).alias("row_key"))
    slim = keep(slim if base_column else slim.withColumn("base", length_rate(F.col("size"))), "sizes")
    # sizes of a hot source are summed before the shuffle
    sizes = keep(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    targets = keep(source_targets(sizes.select("source", "source_size"), weights, budget, most), "targets")
    buckets = sizes.select("source", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    class_of = F.expr("case " + " ".join(f"when size >= {least} then {i}" for i, least in enumerate(CLASSES)) + " end")
    open_rows = _join_source(slim, buckets).withColumn("class", class_of).withColumn("bucket", F.pmod(F.xxhash64("id", "row_key"), "buckets"))
    open_rows = keep(open_rows.drop("buckets"), "classes")
    histogram = keep(open_rows.groupBy("source", "class", "base").agg(F.sum("size").alias("words")), "histogram")
    needs, rounded = targets.select("source", F.col("target").alias("need")), None
    within = Window.partitionBy("source", "bucket").orderBy(F.col("size").desc(), "id", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, _ in enumerate(CLASSES):
        tilts = keep(solve_tilts(histogram.where(F.col("class") >= i).groupBy("source", "base").agg(F.sum("words").alias("words")), needs, most), "tilts")
        rows = _join_source(open_rows.where(F.col("class") == i), tilts.join(needs.withColumnRenamed("source", "_n"), F.col("source").eqNullSafe(F.col("_n"))).drop("_n"))
        rate = F.when(F.col("tilt").isNotNull(), _rate(F.col("base"), F.col("tilt"), most)).when(F.col("need") > 0.5, F.lit(float(most))).otherwise(F.lit(0.0))
        rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
        rows = rows.withColumn("rate", rate)
        # running sums start at a fixed place between 0 and 1 in each bucket
        start = F.pmod(F.xxhash64("source", "bucket"), F.lit(1000)) / 1000.0
        upto = F.floor(F.sum("rate").over(within) + start + 1e-9)
        before = F.floor(F.sum("rate").over(within) - F.col("rate") + start + 1e-9)
        done = rows.withColumn("copies", F.when(F.col("tilt").isNull() | (F.col("size") == 0), F.col("rate").cast("long")).otherwise(F.least(upto - before, F.lit(most).cast("long"))))
        done = keep(done.select("id", "source", "size", "row_key", "copies"), "rounded")
        rounded = done if rounded is None else rounded.union(done)
        taken = done.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"))
        left = needs.join(taken.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        needs = keep(left.select("source", F.greatest(F.col("need") - F.coalesce("t", F.lit(0)), F.lit(0.0)).alias("need")), "needs")
    forget(slim)
    out = _join_source(rounded, targets)
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "row_key")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 3, 1, 2 and 150 % of all words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
