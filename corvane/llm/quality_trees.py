"""Quality: histogram gradient-boosted trees over statistics of a document.

The statistics (STATISTICS) are read from a batch's bytes in vectorised steps. Trees of
one depth are grown level by level: values are binned once by quantiles, a level's
gradient and curvature sums are one weighted count per statistic, and each node takes the
bin edge with the most gain of the logistic loss. The trees are flattened into arrays in
heap order - statistic, threshold, leaf value - and all rows of a batch walk down a tree
at once: the next node is 2 * node + 1, plus 1 where the statistic is over the threshold.

The fit takes at most `sample` labelled ids (a documented bound: those with the least
hash), one row of statistics each, so the broadcast of ids, the one fitting task and the
model are bounded whatever repeats. Scoring is one narrow pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, blocks, bounded_batches, mix64, shingles

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Penalty on leaf values, and the least curvature (rows' p (1 - p)) of a child.
PENALTY, LEAST_CURVATURE = 1.0, 2.0

STATISTICS = (
    "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "mark_share", "other_share", "distinct_words", "repeated_words",
    "symbol_ends", "mark_ends", "bare_symbols", "capital_words", "upper_words", "short_words", "long_words", "log_lines", "line_words", "distinct_lines", "distinct_triples",
)


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_UPPER, _DIGIT, _OTHER = _table((0x41, 0x5A)), _table((0x30, 0x39)), _table((0x80, 0xFF))
_MARK = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_LETTER = _UPPER | _table((0x61, 0x7A)) | _OTHER
_SYMBOL = _table((0x21, 0x7E)) & ~_LETTER & ~_DIGIT & ~_MARK


def statistics(array: pa.Array) -> np.ndarray:
    """Row by STATISTICS; a text without words has zeros (distinct shares: ones)."""
    rows = len(array)
    words = Words(array, lower=False)
    n = np.diff(words.first)
    some, doc = np.maximum(n, 1), words.doc

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, rows) / some

    def within(table: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each word."""
        upto = np.concatenate([[0], np.cumsum(table[words.data])])
        return upto[words.ends] - upto[words.starts]

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct among all values of a row; 1 without any."""
        order = np.lexsort((values, owner))
        fresh = np.append(True, (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(order) else np.zeros(0, bool)
        total = np.bincount(owner, minlength=rows)
        return np.where(total > 0, np.bincount(owner[order], fresh, rows) / np.maximum(total, 1), 1.0)

    size, letters, upper, digits = words.ends - words.starts, within(_LETTER), within(_UPPER), within(_DIGIT)
    held = np.maximum(np.bincount(doc, size, rows), 1)

    def share(counts: np.ndarray) -> np.ndarray:
        return np.bincount(doc, counts, rows) / held

    hashes = words.hashes()
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    first, last = words.data[words.starts], words.data[words.ends - 1]
    # a line is the words between two line feeds; its hash adds up theirs by place
    feeds = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    line = feeds[words.starts]
    opens = np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])) if len(line) else np.zeros(0, bool)
    begins = np.flatnonzero(opens)
    place = np.arange(len(line)) - np.repeat(begins, np.diff(np.append(begins, len(line))))
    mixed = mix64(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lines = np.add.reduceat(mixed, begins) if len(begins) else np.zeros(0, np.uint64)
    n_lines = np.bincount(doc[begins], minlength=rows)
    triples, of = shingles(words, 3)
    columns = [
        np.log1p(n), per_word(size), share(upper), share(digits), share(within(_SYMBOL)), share(within(_MARK)), share(within(_OTHER)), distinct(hashes, doc), per_word(again),
        per_word(_SYMBOL[last]), per_word(_MARK[last]), per_word(letters + digits == 0), per_word(_UPPER[first]), per_word((upper > 1) & (upper + within(_OTHER) == letters)), per_word(size <= 3), per_word(size > 20),
        np.log1p(n_lines), n / np.maximum(n_lines, 1), distinct(lines, doc[begins]), distinct(triples, of),
    ]
    return np.stack(columns, axis=1)


class Trees(NamedTuple):
    """Log-odds before any tree; statistic and threshold of each tree's inner nodes and
    value of its leaves, in heap order."""

    base: float
    statistic: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """At most bins - 1 distinct values of each column; a value is in the bin of the
    number of edges below it."""
    if not len(x):
        return [np.zeros(0)] * x.shape[1]
    return [np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees of the logistic loss; without rows, or with one class, no split has
    a gain and the smoothed share of ones is the score."""
    edges = bin_edges(x, bins)
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    margin, inner = np.full(len(y), base), (1 << depth) - 1
    statistic, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            count = 1 << level
            best, at, cut = np.full(count, 1e-9), np.zeros(count, np.int64), np.full(count, bins)
            for f in range(x.shape[1]):
                key = node * bins + binned[:, f]
                g, h = (np.cumsum(np.bincount(key, v, count * bins).reshape(count, bins), axis=1) for v in (slope, curve))
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
                gain[(h < LEAST_CURVATURE) | (h_all - h < LEAST_CURVATURE)] = 0
                gain[:, len(edges[f]) :] = 0  # no edge there
                place = gain.argmax(axis=1)
                top = gain[np.arange(count), place]
                more = top > best
                best[more], at[more], cut[more] = top[more], f, place[more]
            heap = count - 1 + np.arange(count)
            statistic[t, heap] = at
            threshold[t, heap] = [edges[f][c] if c < bins else np.inf for f, c in zip(at, cut, strict=True)]
            node = 2 * node + (binned[np.arange(len(y)), at[node]] > cut[node])
        g, h = (np.bincount(node, v, inner + 1) for v in (slope, curve))
        leaf[t] = -rate * g / (h + PENALTY)
        margin = margin + leaf[t, node]
    return Trees(base, statistic, threshold, leaf)


def margins(model: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row: all rows walk down one tree after the other."""
    out, rows = np.full(len(x), model.base), np.arange(len(x))
    inner = model.statistic.shape[1]
    depth = (inner + 1).bit_length() - 1
    for statistic, threshold, leaf in zip(model.statistic, model.threshold, model.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, statistic[node]] > threshold[node])
        out += leaf[node - inner]
    return out


def probabilities(model: Trees, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(model, x), -500, 500)))


def held_out(id_column: str, folds: int, fold: int) -> str:
    return f"crc32(cast({id_column} as string)) % {folds} = {fold}"


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, fold: int = 1, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Trees:
    """Trees of the labelled rows outside the held-out fold. Null ids and labels are not
    used; an id with several labels takes the largest, one with several texts the least
    row of statistics."""
    spark = documents.sparkSession
    bounded_batches(spark)
    chosen = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label"))
        .where("id is not null and label is not null").where(f"not ({held_out('id', folds, fold)})")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = statistics(batch.column("text"))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(STATISTICS), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), cells], names=["id", "label", "row"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))  # not as they arrive
        model = fit(np.array([r[2] for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r[1] == 1 for r in rows], float))
        packed = [model.statistic.tobytes(), model.threshold.tobytes(), model.leaf.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([model.base]), *(pa.array([b]) for b in packed)], names=["base", "statistic", "threshold", "leaf"])

    rows = texts.mapInArrow(read, "id long, label int, row array<double>").groupBy("id").agg(F.first("label").alias("label"), F.min("row").alias("row"))
    made = rows.repartition(1).mapInArrow(solve, "base double, statistic binary, threshold binary, leaf binary").first()
    inner = (1 << DEPTH) - 1
    return Trees(made.base, np.frombuffer(bytes(made.statistic), np.int32).reshape(-1, inner), np.frombuffer(bytes(made.threshold)).reshape(-1, inner), np.frombuffer(bytes(made.leaf)).reshape(-1, inner + 1))


def quality_scores(documents: DataFrame, model: Trees, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1, higher: better), predicted (score >= 0.5).

    Null texts are empty; a text without words has the score of its zero statistics.
    Repeated rows and null ids each keep a row; other columns are not read. A model of no
    training rows scores 0.5 throughout.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            score = probabilities(shared.value, statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return source.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_column)


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by trees of the labels outside the held-out third."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(documents, train(documents, labels))
    return scored.select("doc_id", F.coalesce(F.expr(held_out("doc_id", 3, 1)), F.lit(False)).alias("held_out"), "score", "predicted")
