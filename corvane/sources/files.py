"""Sources and sinks: discovery, change detection, records, upserts, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.tables import numbered


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """uri, size, modified, mime of the files below a path, without reading them; a
    repeated uri has error DUPLICATE_URI."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.create_map(*(F.lit(x) for p in {"html": "text/html", "md": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "parquet": "application/vnd.apache.parquet"}.items() for x in p))[suffix], F.lit("application/octet-stream"))
    listed = files.select(F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), mime.alias("mime"))
    repeated = listed.groupBy("uri").count().where("count > 1").select("uri", F.lit("DUPLICATE_URI").alias("error"))
    return listed.join(repeated, "uri", "left")


def fingerprint(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("fingerprint", F.sha2(F.col(column), 256))


def latest_fingerprint(versions: DataFrame) -> DataFrame:
    """Per (source, uri): the fingerprint retrieved last, ties by the largest id."""
    return versions.groupBy("source", "uri").agg(F.max_by("fingerprint", F.struct("retrieved_at", "id")).alias("fingerprint"))


def classify_changes(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """NEW, CHANGED or UNCHANGED against the previous fingerprint, case ignored."""
    joined = current.join(previous.select("source", "uri", F.col("fingerprint").alias("_p")), ["source", "uri"], "left")
    change = F.when(F.col("_p").isNull(), "NEW").when(F.lower("_p") != F.lower("fingerprint"), "CHANGED").otherwise("UNCHANGED")
    return joined.withColumn("change", change).withColumn("should_process", F.lit(force) | (F.col("change") != "UNCHANGED")).drop("_p")


def validate_files(df: DataFrame, max_bytes: int, types: tuple[str, ...]) -> DataFrame:
    """df (uri, size, mime, fingerprint, expected): status OK or the first problem."""
    problem = F.when(F.col("size") == 0, "EMPTY").when(F.col("size") > max_bytes, "TOO_LARGE").when(~F.col("mime").isin(*types), "TYPE").when(F.lower("expected") != F.lower("fingerprint"), "FINGERPRINT")
    return df.withColumn("status", F.coalesce(problem, F.lit("OK")))


def file_manifest(df: DataFrame) -> DataFrame:
    """df (source, uri, size, fingerprint): files, bytes, first and last uri and a digest
    per source. The digest adds up 60 bits of each record's SHA-256, so it does not
    depend on an order and no task gathers a source's records."""
    record = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("uri").cast("string"), "fingerprint"), 256), 1, 15), 16, 10)
    return df.groupBy("source").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("uri").alias("first_uri"), F.max("uri").alias("last_uri"),
        F.sum(record.cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def file_records(df: DataFrame) -> DataFrame:
    """The manifest's records (source, uri, size, fingerprint) with their place in the
    order of source and uri, nulls first."""
    slim = df.select("source", "uri", "size", "fingerprint")
    return numbered(slim, [F.col(c).asc_nulls_first() for c in ("source", "uri", "fingerprint")], "place")


def dedupe_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clean_names(names: list[str]) -> list[str]:
    """Lower case, other characters as underscores; empty or repeated names are errors."""
    import re

    out = [re.sub(r"[^a-z0-9]+", "_", n.strip().lower()).strip("_") for n in names]
    if "" in out or len(set(out)) < len(out):
        raise ValueError(f"empty or repeated column names: {names}")
    return out


CONTAINERS = ("records", "rows", "items", "patients", "data")


def read_records(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """CSV, TSV, JSON or JSONL with cleaned names. Lines that do not parse are kept in
    _corrupt. JSON files may hold their records in one of CONTAINERS."""
    if fmt in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("mode", "PERMISSIVE").csv(path, schema=schema)
    elif fmt == "jsonl":
        df = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path, schema=schema)
        return df.toDF(*(n if n == "_corrupt" else c for n, c in zip(df.columns, clean_names(df.columns), strict=True)))
    elif fmt == "json":
        df = spark.read.option("multiLine", True).json(path, schema=schema)
        held = next((c for c in df.columns if c.lower() in CONTAINERS and df.schema[c].dataType.typeName() == "array"), None)
        if held:
            df = df.select(F.explode(held).alias("r")).select("r.*")
    else:
        raise ValueError(f"unknown format {fmt}")
    return df.toDF(*clean_names(df.columns))


def normalise_records(df: DataFrame, aliases: dict[str, tuple[str, ...]], stem: str = "records") -> DataFrame:
    """First non-empty of each alias list as text, id, title, date, language; fallbacks
    record-%06d, "<stem> record <id>" and en. df has a column record_index."""
    def first(field: str) -> Column:
        there = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in aliases.get(field, ()) if c in df.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    rid = F.coalesce(first("id"), F.format_string("record-%06d", F.col("record_index")))
    title = F.coalesce(first("title"), F.concat(F.lit(f"{stem} record "), rid))
    return df.select("record_index", rid.alias("id"), first("text").alias("text"), title.alias("title"), first("date").alias("date"), F.coalesce(first("language"), F.lit("en")).alias("language"))


def assign_document_ids(df: DataFrame) -> DataFrame:
    """document_id from source, path, record and index; content_hash of the text."""
    key = F.concat(F.col("source"), F.lit(":"), F.col("path"), F.lit("#record="), F.col("id"), F.lit("#index="), F.col("record_index").cast("string"))
    return df.withColumn("document_id", F.substring(F.sha2(key, 256), 1, 32)).withColumn("content_hash", F.sha2("text", 256))


def read_text_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "md", "html")) -> DataFrame:
    """A document per file; other suffixes give a RAW_ONLY row without text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes)
    return files.select(F.col("path").alias("uri"), F.when(known, F.decode("content", "UTF-8")).alias("text"), F.when(known, "PARSED").otherwise("RAW_ONLY").alias("status"), F.sha2("content", 256).alias("fingerprint"))


def limit_per_source(df: DataFrame, n: int, source: str = "source", order: str = "record_index") -> DataFrame:
    """The first n records of each source."""
    return dedupe_by_key(df, [source, order], [F.col(order)]).withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def license_gate(df: DataFrame, specs: DataFrame, purpose: str) -> DataFrame:
    """Rows of sources whose license opens them to a purpose (use or model)."""
    return df.join(F.broadcast(specs.where(F.array_contains("purposes", purpose)).select("source")), "source", "left_semi")


def _filesystem(spark: SparkSession, path: str):
    """(file system, Path maker) of a path, whatever store it is in."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines in canonical order (path, record_index, document_id): the order runs over
    the files by their names and within each. Rows are dealt by ranges, so files are written
    side by side. The set is staged beside path and takes its place when it is whole; a
    failed write leaves the old set."""
    spark, order = df.sparkSession, ("path", "record_index", "document_id")
    staged, before = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "before"))
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(staged)
    fs, at = _filesystem(spark, path)
    if fs.exists(at(path)) and not fs.rename(at(path), at(before)):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(before), at(path))
        raise OSError(f"{staged} could not take the place of {path}")
    fs.delete(at(before), True)


def read_in_order(df: DataFrame, out: str = "place") -> DataFrame:
    """df read from files, with each row's place over the files in order of their names."""
    at = df.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return numbered(at, [F.col("_f").asc(), F.col("_b").asc(), F.col("_i").asc()], out).drop("_f", "_b", "_i")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with the new rows whose key is not there yet (the first of each key)."""
    first = dedupe_by_key(new, keys, [F.col(c) for c in sorted(new.columns)])
    return target.unionByName(first.join(target, keys, "left_anti").select(*target.columns))


def upsert_checked(target: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): a known key with equal values is left; with other values it
    is a conflict; unknown keys are added. Nulls are values."""
    t = target.select(*keys, F.struct(*compare).alias("_t"))
    n = new.select(*keys, F.struct(*compare).alias("_n"))
    both = t.join(n, keys, "full_outer")
    merged = both.withColumn("_m", F.coalesce("_t", "_n")).select(*keys, "_m.*")
    conflicts = both.where("_t is not null and _n is not null and not (_t <=> _n)").select(*keys, F.to_json("_t").alias("stored"), F.to_json("_n").alias("offered"))
    return merged, conflicts


def published_version(spark: SparkSession, out: str) -> tuple[int, str | None]:
    """Number and folder of the set that readers see; 0 and None before the first."""
    fs, at = _filesystem(spark, out)
    if not fs.exists(at(f"{out}/pointers")):
        return 0, None
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(f"{out}/pointers")))
    if not names:
        return 0, None
    number, _, snapshot = names[-1].partition("=")
    return int(number), f"{out}/{snapshot}"


def publish_index(spark: SparkSession, frames: dict[str, DataFrame], conflicts: list[DataFrame], out: str, after: int | None = None) -> str:
    """All frames as one new snapshot below out, then a pointer to it: readers see the
    old set or the new one. Any conflict row stops it before anything is written.

    A pointer is an empty file whose name holds a number and the snapshot, so it is there
    at once or not at all, and the largest number counts. Each number is taken once: a
    writer claims it by creating a file that must not exist yet. With `after` the set is
    published only if that number is still the latest; else it lost to another writer."""
    if any(not c.isEmpty() for c in conflicts):
        raise ValueError("conflicting rows; nothing is published")
    latest = published_version(spark, out)[0] if after is None else after
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, df in frames.items():
        df.write.parquet(f"{out}/{name}/{table}")
    fs, at = _filesystem(spark, out)
    fs.mkdirs(at(f"{out}/claims"))
    fs.mkdirs(at(f"{out}/pointers"))
    while published_version(spark, out)[0] == latest or after is None:
        latest += 1
        if fs.createNewFile(at(f"{out}/claims/{latest:012d}")):
            fs.createNewFile(at(f"{out}/pointers/{latest:012d}={name}"))
            return f"{out}/{name}"
        if after is not None:
            break
    fs.delete(at(f"{out}/{name}"), True)
    raise ValueError(f"another set was published after number {after}; nothing is published")


def read_published(spark: SparkSession, out: str, name: str) -> DataFrame:
    snapshot = published_version(spark, out)[1]
    if snapshot is None:
        raise FileNotFoundError(f"nothing is published below {out}")
    return spark.read.parquet(f"{snapshot}/{name}")


def _audit_reason(columns: list[str]):
    """Why an event is no valid one: the first of PARTITION (all of a chain's events come
    through partition 0), UNDECODABLE (no id or no time) and KEY (not the id)."""
    nothing = F.lit(None).cast("string")
    elsewhere = F.when(F.coalesce(F.col("partition") != 0, F.lit(True)), "PARTITION") if "partition" in columns else nothing
    broken = F.when(F.col("event_id").isNull() | F.col("ts").isNull(), "UNDECODABLE")
    foreign = F.when(~F.col("key").eqNullSafe(F.col("event_id").cast("string")), "KEY") if "key" in columns else nothing
    return F.coalesce(elsewhere, broken, foreign)


def read_audit_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """An event stream with `reason`, null for valid events. Times are cast from zone-less ones."""
    raw = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return raw.withColumn("reason", _audit_reason(raw.columns))


def consume_audit(events: DataFrame, valid: str, dead: str, checkpoint: str, chain: str = "user_id") -> None:
    """One pass over the events of read_audit_stream into two sinks. A chain's valid
    events stay in one file of each batch, in order of time and id; the others go to the
    dead letters with their reason. Batches are written by number, so one that is done
    again after a failure takes the place of its first try."""

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where("reason is null").drop("reason").repartition(F.col(chain)).sortWithinPartitions(chain, "ts", "event_id")
        good.write.mode("overwrite").parquet(f"{valid}/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
