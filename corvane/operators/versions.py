"""Document versions: metadata checks, supersession chains, history, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _newest() -> tuple:
    return F.col("effective_date").desc(), F.col("version").desc(), F.col("version_id").asc()


def version_metadata(df: DataFrame) -> DataFrame:
    """Strings publisher, version, effective_date -> status with missing and invalid
    field lists; CONFIRMED only if all three are present and the date is strict ISO."""
    fields = ("publisher", "version", "effective_date")
    blank = {c: F.coalesce(F.trim(c), F.lit("")) == "" for c in fields}
    dated = F.col("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("try_to_date(effective_date, 'yyyy-MM-dd')").isNotNull()
    missing = F.array_compact(F.array(*(F.when(blank[c], F.lit(c)) for c in fields)))
    invalid = F.when(~blank["effective_date"] & ~dated, F.array(F.lit("effective_date"))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("missing", missing).withColumn("invalid", invalid)
    return out.withColumn("status", F.when((F.size("missing") == 0) & (F.size("invalid") == 0), "CONFIRMED").otherwise("UNKNOWN"))


def _chain(df: DataFrame, takes_part, order) -> DataFrame:
    w = Window.partitionBy("document_id", "_in").orderBy(*order)
    out = df.withColumn("_in", takes_part)
    first, earlier = F.row_number().over(w) == 1, F.lag("version_id").over(w)
    out = out.withColumn("new_status", F.when(~F.col("_in"), F.col("status")).when(first, "ACTIVE").otherwise("SUPERSEDED"))
    return out.withColumn("superseded_by", F.when(F.col("_in"), earlier)).drop("_in")


def version_chain(df: DataFrame) -> DataFrame:
    """Confirmed versions of a document, newest first: the first is ACTIVE, each
    other SUPERSEDED by the one before. WITHDRAWN and UNKNOWN rows keep their status."""
    return _chain(df, F.col("status").isin("CONFIRMED", "ACTIVE", "SUPERSEDED"), _newest())


def reconcile_chain(df: DataFrame) -> DataFrame:
    """As version_chain over dated rows only; ties also go by the latest retrieval."""
    date, version, last = _newest()
    order = (date, version, F.col("retrieved_at").desc(), last)
    return _chain(df, F.col("status").isin("CONFIRMED", "ACTIVE", "SUPERSEDED") & F.col("effective_date").isNotNull(), order)


def chain_checks(df: DataFrame) -> DataFrame:
    """Version ids that occur more than once, or under several documents."""
    grouped = df.groupBy("version_id").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))
    return grouped.where("n > 1").withColumn("problem", F.when(F.col("documents") > 1, "SEVERAL_DOCUMENTS").otherwise("DUPLICATE_VERSION"))


def metadata_review(df: DataFrame) -> DataFrame:
    """Queue of UNKNOWN rows; the reason names the date first, then version, publisher."""
    bad = F.array_union("missing", "invalid")
    reason = F.when(F.array_contains(bad, "effective_date"), "EFFECTIVE_DATE").when(F.array_contains(bad, "version"), "VERSION").when(F.array_contains(bad, "publisher"), "PUBLISHER")
    return version_metadata(df).where("status = 'UNKNOWN'").withColumn("reason", reason)


def staleness(df: DataFrame, asof: str, years: int = 3, column: str = "effective_date") -> DataFrame:
    """stale: dated before asof less that many years; a null date is not stale."""
    return df.withColumn("stale", F.coalesce(F.col(column) < F.add_months(F.lit(asof).cast("date"), -12 * years), F.lit(False)))


def version_history(df: DataFrame, asof: str, years: int = 3) -> DataFrame:
    """Position in a document's history, newest first and undated last; staleness of
    an undated version stays null."""
    w = Window.partitionBy("document_id").orderBy(F.col("effective_date").desc_nulls_last(), F.col("version").desc(), "version_id")
    stale = F.col("effective_date") < F.add_months(F.lit(asof).cast("date"), -12 * years)
    return df.withColumn("position", F.row_number().over(w)).withColumn("stale", stale)


def chunk_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("document_id",), width: int = 240) -> DataFrame:
    """Chunks (keys, ordinal, section, text) of an older and a newer version:
    ADDED, REMOVED or CHANGED rows with a one-line summary of the text."""
    on = [*keys, "ordinal"]
    old, new = (x.select(*on, F.struct("section", "text").alias(n)) for x, n in ((a, "old"), (b, "new")))
    both = old.join(new, on, "full_outer")
    kind = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(~F.col("old").eqNullSafe(F.col("new")), "CHANGED")
    text = F.coalesce(F.col("new.text"), F.col("old.text"))
    summary = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, width)
    return both.withColumn("change", kind).where("change is not null").select(*on, "change", summary.alias("summary"))
