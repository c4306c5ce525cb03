"""Target-distribution importance resampling over hashed word runs.

A feature is a run of 1 to `most_run` consecutive words, joined by one space; its bucket
is the crc32 of its bytes modulo `buckets`. A bucket's gain is the logarithm of how much
likelier a feature of the target falls into it than one of the corpus; a document's
weight is the mean gain of its features, and a Gumbel draw fixed by its id turns weights
into a sample without replacement.

Head and tail: the frequent words are broadcast with their crc32 states, from which a run
goes on with its next word, and the frequent pairs of them with their buckets. Every
other feature of a batch takes its crc32 directly, once for each distinct one. What is in
the head changes the speed, never a result: both ways give the same bucket, and the bucket
totals count every feature of every text. So each task may put its own most frequent
words forward.

Bounds: the head holds HEAD words of at most LONGEST bytes and HEAD_PAIRS pairs of
numbers (3 MB); totals and gains are `buckets` numbers; the ranking's histogram has a row
for each whole score, of which the logarithms allow fewer than 300,000.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.tables import numbered

from .shared import Words, blocks, bounded_batches, forget, keep

HEAD, HEAD_PAIRS, LONGEST = 16_384, 65_536, 64
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Head:
    """Frequent words with their crc32 states; frequent pairs of them, as the first's
    number times HEAD plus the second's, with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[int]):
        self.words = pa.array(words, pa.large_binary())
        self.states = np.array([zlib.crc32(w) for w in words], np.int64)
        self.pairs = np.sort(np.array(pairs, np.int64))
        states, left, right = self.states.tolist(), *np.divmod(self.pairs, HEAD)
        spaced = [b" " + w for w in words]
        self.pair_states = np.array([zlib.crc32(spaced[j], states[i]) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)


class Runs:
    """The words of a batch: their texts' rows, distinct words, each word's number among
    them, and the distinct words' numbers in the head (-1: none)."""

    def __init__(self, array: pa.Array, head: Head):
        words = Words(array, separators=_GAPS)
        sizes = words.ends - words.starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        body = np.ascontiguousarray(words.data[~_GAPS[words.data]])
        packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
        coded = packed.dictionary_encode()
        self.doc, self.first = words.doc, words.first
        self.distinct, self.word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.head = pc.fill_null(pc.index_in(self.distinct, value_set=head.words), -1).to_numpy().astype(np.int64)

    def states(self, head: Head, most_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: the rows of the runs and their crc32."""
        known = self.head >= 0
        state = np.zeros(len(self.distinct), np.int64)
        state[known] = head.states[self.head[known]]
        texts = self.distinct.to_pylist() if most_run > 1 else None
        for i, w in zip(np.flatnonzero(~known).tolist(), self.distinct.filter(pa.array(~known)).to_pylist(), strict=True):
            state[i] = zlib.crc32(w)
        run = self.word
        yield self.doc, state[run]
        for n in range(2, most_run + 1):
            if len(self.word) < n:
                return
            doc = self.doc[: len(self.doc) - n + 1]
            inside = doc == self.doc[n - 1 :]
            kinds, at = np.unique((run[:-1] * len(self.distinct) + self.word[n - 1 :])[inside], return_inverse=True)
            before, after = np.divmod(kinds, len(self.distinct))
            longer, rest = np.zeros(len(kinds), np.int64), np.ones(len(kinds), bool)
            if n == 2 and len(head.pairs):
                key = np.where(known[before] & known[after], self.head[before] * HEAD + self.head[after], -1)
                place = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
                rest = head.pairs[place] != key
                longer[~rest] = head.pair_states[place[~rest]]
            some = np.flatnonzero(rest)
            longer[some] = [zlib.crc32(b" " + texts[j], s) for s, j in zip(state[before[some]].tolist(), after[some].tolist(), strict=True)]
            state, run = longer, np.zeros(len(inside), np.int64)
            run[inside] = at
            yield doc[inside], state[at]


def _texts(df: DataFrame, text_column: str) -> DataFrame:
    return df.select(F.coalesce(text_column, F.lit("")).alias("text"))


def _most(counts: Counter, n: int) -> Counter:
    return Counter(dict(counts.most_common(n)))


def frequent_head(texts: DataFrame, most_run: int, size: int = HEAD, pairs: int = HEAD_PAIRS) -> Head:
    """The head of the texts. A task counts its words and puts its `size` most frequent
    forward; their counts are summed and the `size` most frequent words taken."""
    empty = Head([], [])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in blocks(batches, "text"):
            runs = Runs(batch.column("text"), empty)
            short = np.flatnonzero(pc.binary_length(runs.distinct).to_numpy() <= LONGEST)
            often = np.bincount(runs.word, minlength=len(runs.distinct))
            counts.update(dict(zip(runs.distinct.take(pa.array(short)).to_pylist(), often[short].tolist(), strict=True)))
            if len(counts) > 16 * size:
                counts = _most(counts, 8 * size)
        counts = _most(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = texts.mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = [bytes(r.word) for r in found.orderBy(F.col("n").desc(), "word").limit(size).collect()]
    if most_run < 2:
        return Head(chosen, [])
    shared = texts.sparkSession.sparkContext.broadcast(Head(chosen, []))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in blocks(batches, "text"):
            runs = Runs(batch.column("text"), shared.value)
            number = runs.head[runs.word]
            inside = (runs.doc[:-1] == runs.doc[1:]) & (number[:-1] >= 0) & (number[1:] >= 0)
            kinds, often = np.unique((number[:-1] * HEAD + number[1:])[inside], return_counts=True)
            counts.update(dict(zip(kinds.tolist(), often.tolist(), strict=True)))
            if len(counts) > 16 * pairs:
                counts = _most(counts, 8 * pairs)
        counts = _most(counts, pairs)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    found = texts.mapInArrow(both, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return Head(chosen, [r.pair for r in found.orderBy(F.col("n").desc(), "pair").limit(pairs).collect()])


def bucket_totals(texts: DataFrame, head, most_run: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in blocks(batches, "text"):
            for _, state in Runs(batch.column("text"), head.value).states(head.value, most_run):
                totals += np.bincount(state % buckets, minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    size = len(corpus)
    up, down = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, ident: int | None) -> int:
    """floor(-1000 ln(-ln u)), u from the sha256 of seed and id; a null id is empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_weights(documents: DataFrame, target: DataFrame, most_run: int = 2, buckets: int = 10_000, seed: int = 2024, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_features, weight and score. Three narrow passes."""
    spark: SparkSession = documents.sparkSession
    bounded_batches(spark)
    texts = _texts(documents, text_column)
    head = spark.sparkContext.broadcast(frequent_head(texts, most_run))
    corpus = bucket_totals(texts, head, most_run, buckets)
    gains = spark.sparkContext.broadcast(bucket_gains(corpus, bucket_totals(_texts(target, target_text), head, most_run, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows, runs = batch.num_rows, Runs(batch.column("text"), head.value)
            total, n = np.zeros(rows), np.zeros(rows, np.int64)  # sums are whole numbers below 2^53
            for doc, state in runs.states(head.value, most_run):
                n += np.bincount(doc, minlength=rows)
                total += np.bincount(doc, gains.value[state % buckets], rows)
            weight = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
            drawn = np.array([noise(seed, i) for i in batch.column("id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(runs.first), pa.int64()), pa.array(n), pa.array(weight), pa.array(weight + drawn)],
                names=["id", "n_words", "n_features", "weight", "score"],
            )

    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return source.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_column)


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, id_column: str = "doc_id", **options) -> DataFrame:
    """importance_weights with rank: 1, 2, 3 in falling score, ties to the smaller id,
    for floor(percent * N / 100) of the N rows with at least `least_words` words; null
    for the others.

    Null and wordless texts have no features and weight 0. Repeated rows are rows of
    their own; of equal scores null ids come last, and rows equal in all of it follow
    in any order. Other columns are not read. Empty tables give an empty result, an
    empty target no features.
    """
    scored = keep(importance_weights(documents, target, id_column=id_column, **options).withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    levels = sorted(((r.score, r.n) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in levels) // 100
    lowest, above = None, 0
    for score, n in levels:
        if above >= wanted:
            break
        lowest, above = score, above + n
    chosen = fit & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    placed = numbered(scored.where(chosen), [F.col("score").desc(), F.col(id_column).asc_nulls_last(), F.col("_row").asc()], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~F.coalesce(chosen, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("_row")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """The tenth of all documents drawn after the benchmark texts, by single words."""
    documents, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(documents, target, most_run=1).select("doc_id", "n_features", "weight", "score", "rank")


_OP11_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
#: crc32 by its table of 256 states, folded over the UTF-8 bytes of each distinct word.
OP11_SQL = f"""
with steps as (
  select i, list_reduce(list_concat([i::ubigint], [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c
  from range(256) r(i)),
crc_table as (select list(c order by i) as t from steps),
d as (select doc_id, {_OP11_WORDS} as w from documents),
dw as (select doc_id, unnest(w) as word from d),
bw as (select unnest({_OP11_WORDS}) as word from benchmark),
words as (select distinct word from (select word from dw union all select word from bw)),
bytes as (
  select word, list_transform(range(1, length(hex(word)) // 2 + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::ubigint) as b
  from words),
hashed as (
  select word, xor(list_reduce(list_concat([4294967295::ubigint], b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::bigint + 1])), 4294967295::ubigint) % 10000 as bucket
  from bytes, crc_table),
s as (select bucket, count(*) as s from dw join hashed using (word) group by 1),
t as (select bucket, count(*) as t from bw join hashed using (word) group by 1),
totals as (select (select coalesce(sum(s), 0) from s)::double as s_all, (select coalesce(sum(t), 0) from t)::double as t_all),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain
  from s left join t using (bucket), totals),
sums as (select doc_id, count(*) as n, sum(gain)::bigint as total from dw join hashed using (word) join gains using (bucket) group by 1),
scored as (
  select doc_id, coalesce(n, 0) as n_features, coalesce(floor(total::double / n)::bigint, 0) as weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from d left join sums using (doc_id)),
drawn as (
  select doc_id, n_features::bigint as n_features, weight, n_features >= 20 as fit,
    weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
ranked as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as place, count(*) over (partition by fit) as n from drawn)
select doc_id, n_features, weight, score, case when fit and place <= (10 * n) // 100 then place end as rank from ranked
"""
