"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its distinct lower-cased words with their counts. For each
of the `samples` positions every term draws, from its hash alone, two gamma(2, 1)
values r, c and a uniform value b; with weight S it offers

    t = floor(ln S / r + b),   ln a = ln c - r (t - b) - r

and the term with the least a gives the sample (term, t). Two texts agree at a
position with a probability equal to the generalised Jaccard likeness of their
weighted sets, so the share of equal positions estimates it. Draws are made once for
each distinct term of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, blocks, bounded_batches, keep, mix64

SAMPLES = 64
#: Rows that one row is repeated to at a time.
_REPEATS = 4096
_STEP = 0x9E3779B97F4A7C15


def _uniform(bits: np.ndarray) -> np.ndarray:
    """From 32 bits, never 0 or 1."""
    return (bits.astype(np.float64) + 0.5) / 2.0**32


def _draws(terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c, b of each term at position k."""
    x, y, z = (mix64(terms + np.uint64((3 * k + j + 1) * _STEP % 2**64)) for j in range(3))
    low = np.uint64(0xFFFFFFFF)
    r = -np.log(_uniform(x >> np.uint64(32)) * _uniform(x & low))
    c = np.log(-np.log(_uniform(y >> np.uint64(32)) * _uniform(y & low)))
    return r, c, _uniform(z >> np.uint64(32))


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """Row by sample; 0 throughout for a text without words, never 0 otherwise."""
    words = Words(texts)
    out = np.zeros((len(texts), samples), np.uint32)
    if not len(words.doc):
        return out
    terms, index = np.unique(words.hashes(), return_inverse=True)
    pairs, counts = np.unique(words.doc.astype(np.int64) * len(terms) + index, return_counts=True)
    term, row = pairs % len(terms), pairs // len(terms)
    rows, first = np.unique(row, return_index=True)
    place = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(row))))
    weight = np.log(counts)
    for k in range(samples):
        r, c, b = _draws(terms, k)
        rate, shift = r[term], b[term]
        t = np.floor(weight / rate + shift)
        a = (c - r)[term] - rate * (t - shift)
        least = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == least[place])
        at = at[np.append(True, place[at][1:] != place[at][:-1])]  # ties: the least term
        mixed = mix64(terms[term[at]] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(_STEP) + np.uint64(k))
        out[rows, k] = (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal positions, row by row; two texts without words are alike."""
    return (x == y).mean(axis=1)


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: id and fingerprint (hex, 8 digits for each sample). One narrow pass.

    Null texts are empty; all texts without words share the fingerprint of zeros.
    Repeated rows and null ids each keep a row; other columns are not read.
    """
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = signatures(batch.column("text"), samples)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.astype(">u4").tobytes().hex() for s in found], pa.string())], names=["id", "fingerprint"])

    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return source.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_column)


def _cut_parts(cuts: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Part of each row. cuts ascend; a key that stands there m times holds about m
    parts' rows, which are split further into m ranges of the text's hash."""
    low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    m = high - low
    step = np.array([2**64 // x if x > 1 else 2**64 - 1 for x in range(int(m.max(initial=1)) + 1)], np.uint64)[m]
    nth = (hashes.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) // step
    return (low + np.where(m > 0, np.minimum(nth.astype(np.int64), m - 1) + 1, 0)).astype(np.int32)


def _slim(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    slim = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return slim.withColumn("key", F.coalesce("id", F.lit(2**63 - 1)))


def id_cuts(documents: DataFrame, id_column: str, parts: int) -> np.ndarray:
    """Ends of ranges of the id with about as many rows each, from approximate quantiles;
    an id that holds more rows than a part is there several times."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1))
    found = documents.agg(F.percentile_approx(key, shares, 20 * parts).alias("cuts")).first().cuts
    return np.sort(np.array(found or [], np.int64))


def with_next(documents: DataFrame, id_column: str, text_column: str, parts: int, ends: np.ndarray | None = None, collapse: bool = False) -> DataFrame:
    """Rows (part, copy, key, id, text, times) dealt by ranges of the id, so that each
    part, sorted by (copy, key, tie), holds consecutive rows and ends in a copy of
    the row that follows: the first of the next part, or of the first part. times is how
    many equal rows a row stands for: 1, but with `collapse` equal rows of an id that
    holds more rows than a part are counted together.

    Ranges come from id_cuts; only they and each part's least row (`parts` pairs of
    numbers) reach the driver. Null ids come last. An id that holds more rows than a
    part, as null may, is dealt by ranges of its texts' hashes.
    """
    spark = documents.sparkSession
    source = _slim(documents, id_column, text_column).withColumn("times", F.lit(1).cast("long"))
    own, repeats = np.unique(id_cuts(documents, id_column, parts) if ends is None else ends, return_counts=True)
    frequent = own[repeats > 1].tolist()
    tie = F.when(F.col("key").isin(frequent), F.xxhash64("text")).otherwise(F.lit(0)) if frequent else F.lit(0)
    if frequent and collapse:
        equal = source.where(F.col("key").isin(frequent)).groupBy("id", "text", "key").agg(F.count("*").alias("times"))
        source = source.where(~F.col("key").isin(frequent)).unionByName(keep(equal, "equal"))
    source = source.withColumn("tie", tie.cast("long"))
    cuts = spark.sparkContext.broadcast(np.repeat(own, repeats))

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            order = np.lexsort((ties, keys))
            keys, ties = keys[order], ties[order]
            part, first = np.unique(_cut_parts(cuts.value, keys, ties), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(keys[first]), pa.array(ties[first])], names=["part", "head", "tie"])

    heads = source.select("key", "tie").mapInArrow(heads_of, "part int, head long, tie long").groupBy("part").agg(F.min(F.struct("head", "tie")).alias("head")).collect()
    heads = sorted((r.part, tuple(r.head)) for r in heads)
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the first part follows the last
    before = spark.sparkContext.broadcast(before)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            part = _cut_parts(cuts.value, keys, ties)
            ahead = [before.value.get(row) for row in zip(keys.tolist(), ties.tolist(), strict=True)]
            again = batch.filter(pa.array([x is not None for x in ahead], pa.bool_()))
            for rows, own, copy in ((batch, part, 0), (again, np.array([x for x in ahead if x is not None], np.int32), 1)):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), copy, np.int32)), rows.column("key"), rows.column("id"), rows.column("text"), rows.column("times")], names=["part", "copy", "key", "id", "text", "times"])

    dealt = source.select("key", "tie", "id", "text", "times").mapInArrow(deal, "part int, copy int, key long, id long, text string, times long")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "copy", "key", F.xxhash64("text"), "text")


def edited_fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last half of the code points replaced by the first as
    many of the next row's text, in ascending id (after the last: the first); rows
    with the same id follow by text, null ids come last, a single row follows itself.
    Equal rows of an id that holds more rows than a part are fingerprinted once, as the
    next row of all but the last is one that equals them. Null texts are empty. The texts
    are shuffled once, by ranges of the id.
    """
    bounded_batches(documents.sparkSession)
    parts = 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row that waits for its next one
        for batch in blocks(batches, "text"):
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "id", "text", "times")), strict=True))
            pairs = [(row, rows[i + 1][3]) for i, row in enumerate(rows[:-1]) if row[1] == 0]
            done = [(row, row[3], row[4] - 1) for row, _ in pairs if row[4] > 1] + [(*pair, 1) for pair in pairs]
            held = rows[-1:]
            if not done:
                continue
            texts = [row[3] for row, _, _ in done]
            nexts = [following for _, following, _ in done]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
            own = signatures(pa.array(texts + nexts[-1:], pa.string()), samples)
            other = signatures(pa.array(edited, pa.string()), samples)
            after = own[1:].copy()
            for i in [i for i in range(len(done) - 1) if nexts[i] is not texts[i + 1]]:  # ends of parts, equal rows
                after[i] = signatures(pa.array([nexts[i]], pa.string()), samples)[0]
            own = own[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[2] for row, _, _ in done], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([s.astype(">u4").tobytes().hex() for s in own]),
                    pa.array([s.astype(">u4").tobytes().hex() for s in other]),
                    pa.array(likeness(own, other)),
                    pa.array(likeness(own, after)),
                    pa.array([times for _, _, times in done], pa.int64()),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"],
            )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long"
    ends = id_cuts(documents, id_column, parts)
    made = with_next(documents, id_column, text_column, parts, ends, True).mapInArrow(run, schema).withColumnRenamed("id", id_column)
    if len(np.unique(ends)) < len(ends):  # rows that stand for many are dealt out before they are repeated
        blocks_of = F.explode(F.expr(f"sequence(0L, (times - 1) div {_REPEATS})"))
        made = made.withColumn("_b", blocks_of).repartition(parts)
        made = made.withColumn("_b", F.explode(F.expr(f"array_repeat(0, cast(least({_REPEATS}, times - _b * {_REPEATS}) as int))"))).drop("_b")
    return made.drop("times")


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
