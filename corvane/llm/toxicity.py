"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

A feature is a hashed n-gram of a word with its edges marked; its value in a text is
the number of distinct words of the text that hold it, so a repeated word counts
once and long texts need no cut. Values are multiplied with the n-gram's log-count
ratio between toxic and clean training texts, and a logistic regression with an L2
penalty is fitted on the scaled values. N-grams that favour the toxic side add up; those
that favour the clean side enter as their mean in the text, for the clean words of a long
text would outweigh a few insults by their number alone.

The fit uses at most `sample` labelled rows (a documented bound: those with the
least hash of doc_id), which is what the broadcast of their ids, the one fitting
task and the weights are bounded by. Scoring is one narrow pass over all texts.
Characters are UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, blocks, bounded_batches

SAMPLE = 6000
BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
SMOOTHING = 1.0
PENALTY = 1e-4
#: Log-likelihood ratio by which counts must favour a side (chance exceeds it once in a
#: hundred); the others are noise.
LEAST_EVIDENCE = 6.63
#: An n-gram must occur in this many training texts.
LEAST_TEXTS = 3


def word_grams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the chosen words, and the place of each word in which."""
    sizes = words.ends[which] - words.starts[which] + 2
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text = np.full(begins[-1], 0x5E, np.uint64)  # both edges
    owner = np.repeat(np.arange(len(which)), sizes)
    inner = np.arange(begins[-1]) - begins[owner]
    body = (inner > 0) & (inner < sizes[owner] - 1)
    text[body] = words.data[words.starts[which][owner[body]] + inner[body] - 1]
    buckets, owners = [], []
    for n in SIZES:
        if len(text) < n:
            break
        value = np.full(len(text) - n + 1, n, np.uint64)
        for j in range(n):
            value = (value + text[j : len(text) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        inside = owner[: len(value)] == owner[n - 1 :]
        buckets.append((value[inside] >> np.uint64(11)) & np.uint64(BUCKETS - 1))
        owners.append(owner[: len(value)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def distinct_words(array: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; one place of each distinct word; distinct (row, word) pairs by row."""
    words = Words(array)
    _, place, index = np.unique(words.hashes(), return_index=True, return_inverse=True)
    pairs = np.unique(words.doc.astype(np.int64) * max(len(place), 1) + index)
    return words, place, pairs // max(len(place), 1), pairs % max(len(place), 1)


def text_scores(array: pa.Array, weights: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's toxic features and mean of its clean ones."""
    words, place, row, word = distinct_words(array)
    buckets, owner = word_grams(words, place)
    if not len(place):
        return np.zeros(len(array))

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, np.bincount(owner, values[buckets], len(place))[word], len(array))

    return total(np.where(clean, 0.0, weights)) + total(np.where(clean, weights, 0.0)) / np.maximum(total(clean.astype(float)), 1)


def text_features(array: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text."""
    words, place, row, word = distinct_words(array)
    buckets, owner = word_grams(words, place)
    order = np.argsort(owner, kind="stable")
    buckets, first = buckets[order], np.searchsorted(owner[order], np.arange(len(place) + 1))
    out, ends = [], np.searchsorted(row, np.arange(len(array) + 1))
    for d in range(len(array)):
        own = [buckets[first[w] : first[w + 1]] for w in word[ends[d] : ends[d + 1]]]
        out.append(np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def evidence(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each n-gram's counts in the two classes against one rate
    for both; a count may be 0, so it asks for no size of the sample."""
    share = toxic.sum() / max(toxic.sum() + clean.sum(), 1)
    out, both = np.zeros(len(toxic)), toxic + clean
    for count, part in ((toxic, share), (clean, 1 - share)):
        some = count > 0
        out[some] += 2 * count[some] * np.log(count[some] / (both[some] * part))
    return out


def minimise(loss, size: int, steps: int) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving; loss gives value and gradient."""
    w, memory = np.zeros(size), []
    value, grad = loss(w)
    for _ in range(steps):
        direction, kept = grad.copy(), []
        for s, y in reversed(memory):
            a = s @ direction / (s @ y)
            kept.append(a)
            direction -= a * y
        if memory:
            s, y = memory[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(memory, reversed(kept), strict=True):
            direction += (a - y @ direction / (s @ y)) * s
        step = 1.0 if memory else min(1.0, 1 / (np.abs(grad).sum() + 1e-12))
        for _ in range(20):
            after = w - step * direction
            now, slope = loss(after)
            if now <= value - 1e-4 * step * (grad @ direction):
                break
            step /= 2
        else:
            break
        s, y = after - w, slope - grad
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y)]
        done = value - now < 1e-7
        w, value, grad = after, now, slope
        if done:
            break
    return w


Model = tuple[np.ndarray, np.ndarray, float]


def fit(buckets: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, steps: int = 60) -> Model:
    """Weights per bucket (ratio included), which of them favour the clean side, bias."""
    weights, clean = np.zeros(BUCKETS), np.zeros(BUCKETS, bool)
    if not len(labels):
        return weights, clean, -np.inf
    if labels.min() == labels.max():
        return weights, clean, 20.0 if labels[0] else -20.0
    texts = np.zeros(BUCKETS)
    p, q = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for own, value, label in zip(buckets, values, labels, strict=True):  # a bucket occurs once in a text
        texts[own] += 1
        (p if label == 1 else q)[own] += value
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio = np.where((texts >= LEAST_TEXTS) & (evidence(p - SMOOTHING, q - SMOOTHING) >= LEAST_EVIDENCE), ratio, 0.0)
    clean = ratio < 0
    chosen = [ratio[own] != 0 for own in buckets]
    row = np.repeat(np.arange(len(labels)), [int(c.sum()) for c in chosen])
    col = np.concatenate([own[c] for own, c in zip(buckets, chosen, strict=True)]).astype(np.int64)
    val = np.concatenate([value[c] for value, c in zip(values, chosen, strict=True)]).astype(float)
    calm = np.maximum(np.bincount(row, val * clean[col], len(labels)), 1)
    val = val * ratio[col] / np.where(clean[col], calm[row], 1.0)
    columns, col = np.unique(col, return_inverse=True)
    n, size = len(labels), len(columns)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(row, val * w[col], n) + w[-1]
        sign = np.where(labels == 1, 1.0, -1.0)
        slope = -sign / (1 + np.exp(np.clip(sign * margin, -500, 500)))
        own = np.append(w[:-1], 0.0)
        grad = np.append(np.bincount(col, val * slope[row], size), slope.sum()) / n + PENALTY * own
        return float(np.logaddexp(0, -sign * margin).mean() + PENALTY / 2 * own @ own), grad

    w = minimise(loss, size + 1, steps)
    weights[columns] = w[:-1] * ratio[columns]
    return weights, clean, float(w[-1])


def held_out(id_column: str, folds: int) -> str:
    return f"crc32(cast({id_column} as string)) % {folds} = 0"


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Weights, clean sides and bias. documents, labels: id and text, id and 0/1. Rows of the
    held-out fold, null ids and null labels are not used; an id with several labels
    takes the largest, one with several texts the least of their features. The sample's
    features meet in one task: at most `sample` rows of six bytes for each n-gram of a
    text, of which there are BUCKETS at most."""
    chosen = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label"))
        .where("id is not null and label is not null").where(f"not ({held_out('id', folds)})")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([np.minimum(v, 65535).astype(np.uint16).tobytes() for _, v in found], pa.binary())], names=["id", "label", "buckets", "counts"]
            )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort()  # the order of arrival must not matter
        labels_, buckets, counts = zip(*rows, strict=True) if rows else ((), (), ())
        weights, clean, bias = fit([np.frombuffer(b, np.int32) for b in buckets], [np.frombuffer(c, np.uint16) for c in counts], np.array(labels_))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32).tobytes()]), pa.array([weights[used].tobytes()]), pa.array([clean[used].tobytes()]), pa.array([bias])], names=["used", "weights", "clean", "bias"])

    rows = texts.mapInArrow(features, "id long, label int, buckets binary, counts binary")
    rows = rows.groupBy("id").agg(F.first("label").alias("label"), F.min(F.struct("buckets", "counts")).alias("f")).select("label", "f.*")
    model = rows.repartition(1).mapInArrow(solve, "used binary, weights binary, clean binary, bias double").first()
    weights, clean, used = np.zeros(BUCKETS), np.zeros(BUCKETS, bool), np.frombuffer(bytes(model.used), np.int32)
    weights[used], clean[used] = np.frombuffer(bytes(model.weights)), np.frombuffer(bytes(model.clean), bool)
    return weights, clean, model.bias


def _scored(array: pa.Array, model: Model) -> np.ndarray:
    weights, clean, bias = model
    if np.isinf(bias):
        return np.zeros(len(array))
    return 1 / (1 + np.exp(-np.clip(text_scores(array, weights, clean) + bias, -700, 700)))


def toxicity_scores(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts get the score of no feature at all. Repeated rows and null
    ids each keep a row; other columns are not read. Without any training row every
    score is 0.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            score = _scored(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return source.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_column)


def without_toxic(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below 0.5; rows without
    text stay."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_column):
            texts = batch.column(text_column)
            yield batch.filter(pa.array((_scored(texts, shared.value) < 0.5) | texts.is_null().to_numpy(zero_copy_only=False)))

    return documents.mapInArrow(run, documents.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fifth."""
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_scores(documents, train(documents, labels))
    return scored.select("doc_id", F.coalesce(F.expr(held_out("doc_id", 5)), F.lit(False)).alias("held_out"), "score", "predicted")
