"""Corpus pipeline: toxic texts out, one text of each near-duplicate group, no
benchmark passages, personal data masked, sources mixed to their weights.

Each stage works on all that the one before kept and returns the columns that it
got; `run` writes each stage's result to the shared folder and reads it back, as a
stage makes several passes. The last stage repeats documents by their copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, jaccard_join, mixing, pii, toxicity
from corvane.llm.shared import checked_broadcast, forget, keep
from corvane.operators.tables import numbered


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the labels,
    without the held-out fold; null texts are kept."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as a struct row, doc_id, text and key, a digest of the text: ids may be null
    or shared by texts, so verdicts go by text and never by id alone."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (a null id is
    last); of rows that repeat an id and its text, one. Wordless texts group with none."""
    rows = _keyed(docs)
    groups = jaccard_join.near_duplicates(rows.select("_key", "text"), id_column="_key").where("n_shingles > 0").select("_key", "component_id").distinct()
    texts = rows.groupBy("_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), F.count("*").alias("n"))
    texts = keep(texts.join(groups, "_key").select("_key", "component_id", "n", "least.none", "least.doc_id"), "texts")
    heads = texts.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "_key")).alias("head"))
    told = texts.join(heads, "component_id").select("_key", (F.col("head._key") == F.col("_key")).alias("_first"), F.col("head.doc_id").alias("_id"), "n")
    told = keep(told.where("not _first or n > 1").drop("n"), "told")
    kept = rows.join(checked_broadcast(told, told.count()), "_key", "left").where("_first is null or (_first and doc_id <=> _id)").select("row.*")
    repeated = not rows.groupBy("doc_id", "_key").count().where("count > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    rows = _keyed(docs)
    found = decontamination.contamination(rows.select("_key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="_key")
    found = keep(found.where("contaminated").select("_key").distinct(), "contaminated")
    return rows.join(checked_broadcast(found, found.count()), "_key", "left_anti").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars is counted anew."""
    masked = pii.masked_texts(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: the columns of documents,
    copies and copy (from 1); columns of these names are replaced. Rows that repeat
    id, source and text share the copies of all of them evenly."""
    mixed = mixing.mix(docs).groupBy("row_key").agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).where("total > 0")
    docs = docs.drop("copies", "copy")
    keyed = docs.select(F.struct("*").alias("row"), mixing.row_key().alias("row_key"))
    mixed = keep(mixed, "copies")
    dealt = keyed.join(mixed, "row_key")
    if mixed.where("rows > 1").isEmpty():
        dealt = dealt.withColumn("nth", F.lit(1))
    else:  # equal rows take places by ranges, so no task holds them all
        again = keep(dealt.where("rows > 1").withColumn("_row", F.monotonically_increasing_id()), "repeated")
        again = numbered(again, [F.col("row_key").asc(), F.col("_row").asc()], "nth", ["row_key"]).drop("_row")
        dealt = dealt.where("rows = 1").withColumn("nth", F.lit(1).cast("long")).unionByName(again)
    dealt = dealt.withColumn("copies", F.expr("(total * nth) div rows - (total * (nth - 1)) div rows")).where("copies > 0")
    return dealt.select("row.*", "copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]
#: A trained classifier and shingle components take part, which SQL does not express;
#: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
