"""Set-similarity join on word n-grams with rare-first prefix filtering.

Two texts link when the Jaccard likeness of their sets of k-word shingles is at
least a threshold. Equal sets are one class (an "entity"), so copies are never
expanded. Among entities:

1. Every shingle gets a rank: its frequency as counted over all documents in a
   fixed number of counters, then its hash. Any fixed order is exact; the counts
   only make it rare-first, so frequent shingles leave the prefixes.
2. The first n - ceil(t n) + 1 shingles of an entity are its prefix. Linked
   entities share a prefix shingle, so entities meet in the lists of such shingles.
3. A list is never paired with itself. Its head is the member in which the list's
   shingle stands earliest: the one with the fewest rarer shingles of its own, as a
   group's original has. Each entity is first compared with one head of its lists,
   then with all heads that lie in another component; the links found are contracted
   into components. Then only members of different components still have to meet:
   those outside a list's most common component against the others. The filters that
   pairs must pass depend on size and position alone, so a list is first collapsed to
   its classes of equal size and position; classes are compared, by ranges of size, and
   only the members of classes that pass meet. A list whose members are too unlike to
   link, as of texts around one template, costs its classes and no pairs.
4. Pairs pass a length filter, a positional filter (what is left behind the common
   position) and a suffix filter (shingles counted in classes by hash), all upper
   bounds, and are then compared exactly, once per pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import Words, blocks, bounded_batches, checked_broadcast, distinct_per_row, forget, keep, mix64, shingles

#: Frequency counters: a power of two, about one for SHARE shingles, within bounds. A
#: byte of each is broadcast (32 MB at most); beyond that counters are shared by more
#: shingles, which costs candidates but no links.
LEAST_COUNTERS, MOST_COUNTERS, SHARE = 1 << 20, 1 << 25, 8
_CHUNK = 1 << 16
#: Classes of the suffix filter.
CLASSES = 64

_FACTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ent", T.LongType()),
        T.StructField("classes", T.ArrayType(T.IntegerType())),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("counts", T.BinaryType()),
    ]
)


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    values, doc = shingles(Words(batch.column("text")), k)
    return distinct_per_row(values, doc, batch.num_rows)


def _entity(values: np.ndarray) -> int:
    """Signature of a set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        return int((np.sum(mix64(values + np.uint64(77))) ^ mix64(np.uint64([len(values)]))[0]).astype(np.int64))


def _n_counters(source: DataFrame) -> int:
    """From the number of characters, at six or so for a word."""
    words = (source.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // 6
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (words // SHARE).bit_length()))


def _facts(k: int, n_counters: int):
    """A row of id, text key, set size, entity and class counts per document; then,
    per task, the shingle counters in compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, waiting = np.zeros(n_counters, np.uint32), []
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ent", pa.int64()), ("classes", pa.list_(pa.int32())), ("chunk", pa.int32()), ("counts", pa.binary())])
        for batch in blocks(batches, "text"):
            sets = _sets(batch, k)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            waiting.append((every & np.uint64(n_counters - 1)).astype(np.uint32))
            if sum(map(len, waiting)) > 1 << 20:
                _add(counters, waiting)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            by_class = np.bincount(owner * CLASSES + (every >> np.uint64(58)).astype(np.int64), minlength=CLASSES * len(sets)).reshape(-1, CLASSES)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(pa.int64()),
                    batch.column("key").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_entity(s) if len(s) else None for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * CLASSES, pa.int32()), pa.array(by_class.ravel(), pa.int32())).cast(pa.list_(pa.int32())),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                schema=schema,
            )
        _add(counters, waiting)
        chunks = [c for c in range(n_counters // _CHUNK) if counters[c * _CHUNK : (c + 1) * _CHUNK].any()]
        none = len(chunks)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(none, pa.int64()) for _ in range(4)),
                pa.nulls(none, pa.list_(pa.int32())),
                pa.array(chunks, pa.int32()),
                pa.array([zlib.compress(np.minimum(counters[c * _CHUNK : (c + 1) * _CHUNK], 65535).astype(np.uint16).tobytes(), 1) for c in chunks], pa.binary()),
            ],
            schema=schema,
        )

    return run


def _add(counters: np.ndarray, waiting: list[np.ndarray]) -> None:
    if waiting:
        places, counts = np.unique(np.concatenate(waiting), return_counts=True)
        counters[places] += counts.astype(np.uint32)
        waiting.clear()


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counters of each chunk of this task and round them to 1/8 of a doubling."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            add = np.frombuffer(zlib.decompress(counts), np.uint16)
            totals[chunk] = totals.get(chunk, np.zeros(_CHUNK, np.uint64)) + add
    levels = [np.minimum(8 * np.log2(t.astype(float) + 1), 255).astype(np.uint8).tobytes() for t in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])


def _rank_levels(facts: DataFrame, n_counters: int) -> np.ndarray:
    """One byte per counter, at most MOST_COUNTERS bytes, whatever the input's size."""
    chunks = facts.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk")
    levels = np.zeros(n_counters, np.uint8)
    for row in chunks.mapInArrow(_add_chunks, "chunk int, levels binary").collect():
        levels[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(bytes(row.levels), np.uint8)
    return levels


def prefix_length(n: int, threshold: Fraction) -> int:
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def _postings(k: int, threshold: Fraction, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in blocks(batches, "text"):
            parts = []
            for values in _sets(batch, k):
                if not len(values) or (ent := _entity(values)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(ent)
                size = prefix_length(len(values), threshold)
                level = levels.value[(values & np.uint64(len(levels.value) - 1)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:size]  # values ascend, so ties go by hash
                parts.append((values[order].astype(np.int64), np.full(len(order), ent), np.full(len(order), len(values)), np.arange(len(order))))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["token", "ent", "n", "pos"])

    return run


def _set_bytes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sets = _sets(batch, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_entity(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["ent", "shingles"]
            )

    return run


def _verify(threshold: Fraction):
    """Keep pairs whose sets reach the threshold: exact integers, one merge each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_rows = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep_rows.append(both * threshold.denominator >= (len(p) + len(q) - both) * threshold.numerator)
            mask = pa.array(keep_rows, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _filters(threshold: Fraction) -> str:
    """Length and positional filter on rows with (na, pa) and (nb, pb). At the first
    shingle that a pair has in common, no more than the shorter rest can be common;
    every linked pair passes in the list of that shingle, others need not be met."""
    p, q = threshold.numerator, threshold.denominator
    most = "least(na - pa, nb - pb)"
    return f"least(na, nb) * {q} >= greatest(na, nb) * {p} and {most} * {p + q} >= (na + nb) * {p}"


def _links(pairs: DataFrame, facts: DataFrame, documents: DataFrame, k: int, threshold: Fraction) -> DataFrame | None:
    """pairs(a, b), distinct, of entities -> those that link, kept as a table; None
    without a job over the texts if no pair passes the suffix filter."""
    of = facts.where("ent is not null").groupBy("ent").agg(F.first("classes").alias("classes"), F.min(F.struct("key", "id")).alias("rep"))
    a, b = (of.select(F.col("ent").alias(x), F.col("classes").alias(f"classes_{x}")) for x in "ab")
    lo, hi = (f"aggregate(zip_with(classes_a, classes_b, (x, y) -> {f}(x, y)), 0, (s, x) -> s + x)" for f in ("least", "greatest"))
    near = (
        pairs.join(a, "a").join(b, "b")
        .where(F.expr(f"{lo} * {threshold.denominator} >= {hi} * {threshold.numerator}"))
        .select("a", "b")
    )
    near = keep(near, "pairs")
    if near.isEmpty():
        forget(near)
        return None
    needed = keep(near.select(F.col("a").alias("ent")).union(near.select("b")).distinct(), "needed")
    rows = needed.count()
    # one row of each set is read again, told by its text's key and its id, which may be null
    reps = needed.join(of.select("ent", "rep"), "ent").select(F.col("rep.key").alias("rkey"), F.col("rep.id").alias("rid")).distinct()
    texts = documents.join(checked_broadcast(reps, rows), F.expr("key = rkey and id <=> rid"), "left_semi").select("id", "text")
    sets = texts.mapInArrow(_set_bytes(k), "ent long, shingles binary").join(checked_broadcast(needed, rows), "ent", "left_semi").dropDuplicates(["ent"])
    sets = keep(sets, "sets")
    both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    links = keep(both.mapInArrow(_verify(threshold), "a long, b long"), "links")
    for table in (near, needed, sets):
        forget(table)
    return links


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("e", "h").alias("a"), F.greatest("e", "h").alias("b")).distinct()


def _placed(lists: DataFrame, components: DataFrame) -> DataFrame:
    """The lists with each entity's component c, itself at least."""
    return lists.join(components.withColumnRenamed("node", "ent"), "ent", "left").withColumn("c", F.coalesce("component", "ent")).drop("component")


def _mixed(placed: DataFrame) -> DataFrame:
    """Lists that hold several components, with the most common one."""
    sizes = placed.groupBy("token", "c").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("token").agg(F.max(F.struct("size", "c")).alias("most"), F.count("*").alias("kinds"))
    return sizes.where("kinds > 1").select("token", F.col("most.c").alias("main"))


def _against_heads(placed: DataFrame, threshold: Fraction) -> DataFrame:
    """Each list's members e against its head h, if that is in another component."""
    heads = placed.groupBy("token").agg(F.min(F.struct("pos", "ent", "n", "c")).alias("head"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    heads = heads.select("token", F.col("head.n").alias("nb"), F.col("head.ent").alias("h"), F.col("head.pos").alias("pb"), F.col("head.c").alias("ch"))
    return placed.withColumnsRenamed({"ent": "e", "n": "na", "pos": "pa"}).join(heads, "token").where("c <> ch").where(_filters(threshold))


def _class_pairs(open_lists: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (token, na, pa, nb, pb) of a list's classes of size n and position pos that
    pass the filters and hold more than one component. Sizes are dealt to ranges a
    threshold wide, so that a class meets those of its own range and the two beside it."""
    classes = open_lists.groupBy("token", "n", "pos").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    width = F.log(F.lit(threshold.denominator / threshold.numerator)) if threshold < 1 else F.lit(1.0)
    ranged = classes.withColumn("range", F.floor(F.log("n") / width))
    a = ranged.select("token", "range", F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("lo").alias("loa"), F.col("hi").alias("hia"))
    b = ranged.select("token", F.explode(F.array(*(F.col("range") + i for i in (-1, 0, 1)))).alias("range"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("lo").alias("lob"), F.col("hi").alias("hib"))
    met = a.join(b, ["token", "range"]).where(_filters(threshold)).where("least(loa, lob) <> greatest(hia, hib)")
    return met.select("token", "na", "pa", "nb", "pb")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of documents: id, n_shingles (size of its set) and
    component_id (the smallest id that links reach, its own included).

    Null and wordless texts have size 0, link with nothing and are their own
    component. Rows with the same text are one class, whatever their ids; an id
    that occurs on several rows has a row for each. A null id takes part, but a
    component's id is its smallest non-null one (null if there is none). Other columns are not read. An
    empty table gives an empty result.
    """
    exact = Fraction(str(threshold))
    spark = documents.sparkSession
    bounded_batches(spark)
    source = documents.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))
    n_counters = _n_counters(source)
    told = keep(source.mapInArrow(_facts(k, n_counters), _FACTS), "facts")
    facts = told.where("chunk is null").select("id", "key", "n", "ent", "classes")
    levels = spark.sparkContext.broadcast(_rank_levels(told, n_counters))
    postings = keep(source.mapInArrow(_postings(k, exact, levels), "token long, ent long, n long, pos long"), "postings")
    heads = postings.groupBy("token").agg(F.min("ent").alias("lo"), F.max("ent").alias("hi")).where("lo <> hi").select("token")
    lists = keep(postings.join(heads, "token").distinct(), "lists")
    forget(postings)

    def contracted(known: DataFrame | None, links: DataFrame | None) -> DataFrame:
        """Components of the links and of those known before."""
        if links is None:
            return spark.createDataFrame([], "node long, component long") if known is None else known
        found = links.toDF("u", "v") if known is None else known.toDF("u", "v").union(links.toDF("u", "v"))
        found = keep(connected_components(found), "components")
        forget(links)
        return found

    # Round 1: every entity against one head, that of its earliest list.
    alone = lists.withColumn("c", F.col("ent"))
    star = _against_heads(alone, exact).groupBy("e").agg(F.min(F.struct("pa", "pb", "h")).alias("head")).select("e", F.col("head.h").alias("h"))
    tried = keep(_pairs(star), "tried")
    components = contracted(None, _links(tried, facts, source, k, exact))

    # Round 2: against all heads that lie in another component.
    placed = keep(_placed(lists, components), "placed")
    second = keep(_pairs(_against_heads(placed, exact)).join(tried, ["a", "b"], "left_anti"), "tried")
    more = _links(second, facts, source, k, exact)
    joined = contracted(components, more)

    # Round 3: what still lies in different components of a list.
    if more is not None:
        forget(placed)
        placed = keep(_placed(lists, joined), "placed")
    open_lists = keep(placed.join(_mixed(placed), "token"), "open")
    classes = keep(_class_pairs(open_lists, exact), "classes")
    few = open_lists.where("c <> main").select("token", F.col("ent").alias("e"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ce"))
    others = open_lists.select("token", F.col("ent").alias("h"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("ch"), "main")
    met = few.join(classes, ["token", "na", "pa"]).join(others, ["token", "nb", "pb"])
    rest = met.where("ce <> ch and (ch = main or e < h)")
    rest = _pairs(rest).join(tried.union(second), ["a", "b"], "left_anti")
    final = contracted(joined, _links(rest, facts, source, k, exact))
    for table in (placed, tried, second, open_lists, classes, lists):
        forget(table)

    classes = facts.where("ent is not null").groupBy("ent").agg(F.min("id").alias("least_id"))
    classes = classes.join(final.withColumnRenamed("node", "ent"), "ent", "left").withColumn("c", F.coalesce("component", "ent"))
    smallest = classes.groupBy("c").agg(F.min("least_id").alias("component_id"))
    named = classes.join(smallest, "c").select("ent", "component_id")
    linked = facts.where("ent is not null").join(named, "ent").select("id", "n", "component_id")
    alone = facts.where("ent is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).toDF(id_column, "n_shingles", "component_id")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five words, likeness 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
