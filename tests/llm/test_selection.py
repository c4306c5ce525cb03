"""Importance resampling, the quality classifier and the filter audit: brute force, odd
rows and hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import filter_audit, importance, quality_trees
from corvane.operators import tables

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, score string, weight string, _row string"
LABELS = "doc_id long, quality int, toxic int, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, repeated rows and ids, ties, clashing columns."""
    long = " ".join(f"word{i % 913}" for i in range(30_000))
    texts = [
        (1, "alpha beta gamma " * 9), (2, "alpha beta gamma " * 9), (2, "alpha beta gamma " * 9), (3, None), (4, ""), (5, " \n\t"), (None, "alpha beta gamma " * 9), (None, None),
        (6, long), (7, "A B C D $ " * 20), (8, "x" * 5000), (9, "Éa éa zebra " * 10), (2, "other text | with pipe"), (10, "one"), (11, "cost is 5 % & more " * 12), (12, "alpha-beta_gamma 12x " * 15),
    ]
    rows = [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", "clash", "clash", "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def hashed_words(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))]


def runs(text, most):
    words = hashed_words(text)
    return [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute_weights(texts, target, most, buckets):
    corpus, wanted = (Counter(zlib.crc32(r) % buckets for t in side for r in runs(t, most)) for side in (texts, target))
    up, down = float(sum(corpus.values()) + buckets), float(sum(wanted.values()) + buckets)
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * up / ((corpus[b] + 1.0) * down))) for b in range(buckets)]
    out = []
    for t in texts:
        found = [gain[zlib.crc32(r) % buckets] for r in runs(t, most)]
        out.append((len(found), sum(found) // len(found) if found else 0))
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_importance_weights(spark, odd, most):
    texts = [r.text for r in odd.collect()]
    target = ["alpha beta with pipe", None, "zebra Éa"]
    found = importance.importance_weights(odd, spark.createDataFrame([(1, t) for t in target], "item_id int, text string"), most_run=most, buckets=997)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score) for r in found.collect())
    expected = []
    for r, (n, weight) in zip(odd.collect(), brute_weights(texts, target, most, 997), strict=True):
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        expected.append((r.doc_id is None, r.doc_id or 0, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert got == sorted(expected)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab cÉ-1", max_size=20), max_size=6), st.integers(1, 4), st.integers(0, 6))
def test_head_and_tail_agree(texts, most, size):
    """Whatever the head holds, runs have the crc32 of their bytes."""
    words = sorted({w for t in texts for w in hashed_words(t)})[:size]
    pairs = [i * importance.HEAD + j for i in range(len(words)) for j in range(len(words)) if (i + j) % 2 == 0]
    head = importance.Head(words, pairs)
    found = importance.Runs(pa.array(texts, pa.string()), head)
    got = sorted((int(d), int(s)) for docs, states in found.states(head, most) for d, s in zip(docs, states, strict=True))
    assert got == sorted((d, zlib.crc32(r)) for d, t in enumerate(texts) for r in runs(t, most))


def test_resample_ranks(spark, odd):
    target = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    rows = importance.resample(odd, target, percent=50, least_words=20, most_run=1).collect()
    assert len(rows) == odd.count()
    fit = [r for r in rows if r.n_words >= 20]
    drawn = sorted((r for r in rows if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, len(fit) // 2 + 1))
    best = sorted(fit, key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))[: len(drawn)]
    assert [(r.score, r.doc_id) for r in drawn] == [(r.score, r.doc_id) for r in best]
    assert importance.resample(odd.limit(0), target).collect() == []
    assert all(r.rank is None for r in importance.resample(odd, target.limit(0), percent=0).collect())


def test_resample_many_ties(spark, monkeypatch):
    """A null id on most rows: one score, ranks without a gap, no file with all rows."""
    text, written = " ".join(f"w{i}" for i in range(25)), []
    monkeypatch.setattr(tables, "keep", lambda df, name, keep=tables.keep: written.append(keep(df, name)) or written[-1])
    docs = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = importance.resample(docs, docs.limit(1), percent=100, most_run=1)
        assert sorted(r.rank for r in rows.select("rank").collect()) == list(range(1, 20_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = written[0].where("doc_id is null").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) < 8000


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_audit(docs, labels):
    least = {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    good, bad = ({x.doc_id for x in labels if getattr(x, k) == 1 and x.doc_id is not None} for k in ("quality", "toxic"))
    facts = []
    for r in docs:
        t, w = r.text or "", words_of(r.text)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": r.doc_id is not None and least[t] < r.doc_id,
        }
        facts.append((r.source or "", {k for k, v in fails.items() if v}, r.doc_id in good, r.doc_id in bad))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step in range(1, 6):
            letter, before = order[step - 1], set(order[: step - 1])
            row = defaultdict(lambda: [0] * 6)
            for part, fails, is_good, is_bad in facts:
                own, gone = letter in fails, bool(fails & before)
                add = [not gone and not own, own and not gone, own and gone, fails == {letter}, own and not gone and is_good, own and not gone and is_bad]
                row[part] = [x + y for x, y in zip(row[part], add, strict=True)]
            for part, values in row.items():
                out[part, order, step] = values
                shapley[part, letter] += values[1]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_filter_audit(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 1, None, "x"), (7, 0, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (10, 1, 1, "x")], LABELS)
    rows = filter_audit.audit(odd, labels).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    assert got == brute_audit(odd.collect(), labels.collect())
    assert filter_audit.audit(odd.limit(0), labels).collect() == []
    assert filter_audit.audit(odd, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 5), st.data())
def test_gray_states(n, data):
    cells = np.array(data.draw(st.lists(st.integers(0, 9), min_size=1 << n, max_size=1 << n)))[None, :, None]
    states = filter_audit.gray_states(cells)
    for on in range(1 << n):
        assert states[0, on, 0] == sum(c for mask, c in enumerate(cells[0, :, 0].tolist()) if mask & on == 0)


def test_audit_of_copies_has_no_hot_task(spark):
    """A text on 20,000 rows: whatever is dealt by text is aggregated before."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([], LABELS)
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(docs, labels).collect()}
    assert rows["EABCD", 1].removed == 19_999 and rows["EABCD", 1].kept == 1 and rows["AEBCD", 2].redundant == 19_999
    cells = filter_audit.failure_cells(docs, labels, filter_audit.contract_filters())
    assert sorted((r["mask"], r.n) for r in cells.collect()) == [(1, 1), (17, 19_999)]


def plain_statistics(text):
    """Some of the statistics, in plain Python."""
    w = words_of(text)
    body = "".join(w).encode()
    symbols = set(b"#$%&*+/<=>@[\\]^_`{|}~")
    lines = [tuple(words_of(x)) for x in (text or "").split("\n") if words_of(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
    return {
        "log_words": math.log1p(len(w)), "word_bytes": len(body) / max(len(w), 1), "upper_share": sum(65 <= b <= 90 for b in body) / max(len(body), 1),
        "symbol_share": sum(b in symbols for b in body) / max(len(body), 1), "distinct_words": len(set(w)) / len(w) if w else 1.0,
        "repeated_words": sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1), "symbol_ends": sum(x.encode()[-1] in symbols for x in w) / max(len(w), 1),
        "log_lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines) if lines else 1.0, "distinct_triples": len(set(triples)) / len(triples) if triples else 1.0,
    }


def test_statistics():
    texts = ["a b a b a b", "", None, "Same line\nSame line\nother | $x# $x#\n\n", "Ünïcode É É w1 22", "one", " \n", "b\na b", "x " * 50 + "END%"]
    found = quality_trees.statistics(pa.array([t or "" for t in texts]))
    for row, text in zip(found, texts, strict=True):
        for name, value in plain_statistics(text).items():
            assert row[quality_trees.STATISTICS.index(name)] == pytest.approx(value), (text, name)
    assert quality_trees.statistics(pa.array([], pa.string())).shape == (0, len(quality_trees.STATISTICS))


def walk(model, row):
    total, inner = model.base, model.statistic.shape[1]
    for statistic, threshold, leaf in zip(model.statistic, model.threshold, model.leaf, strict=True):
        node = 0
        while node < inner:
            node = 2 * node + (2 if row[statistic[node]] > threshold[node] else 1)
        total += leaf[node - inner]
    return total


def brute_root(x, y):
    """Best first split by trying every observed value, with the module's penalties."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    slope, curve, best = p - y, np.full(len(y), p * (1 - p)), 0.0
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            h = curve[left].sum(), curve[~left].sum()
            if min(h) >= quality_trees.LEAST_CURVATURE:
                gain = sum(s.sum() ** 2 / (c + quality_trees.PENALTY) for s, c in ((slope[left], h[0]), (slope[~left], h[1])))
                best = max(best, gain - slope.sum() ** 2 / (curve.sum() + quality_trees.PENALTY))
    return best


def test_trees_against_plain_ones():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality_trees.fit(x, y, trees=20, depth=3, bins=256)
    assert quality_trees.margins(model, x) == pytest.approx([walk(model, row) for row in x])
    assert ((quality_trees.probabilities(model, x) >= 0.5) == (y == 1)).mean() > 0.97
    p, left = (y.sum() + 0.5) / (len(y) + 1), x[:, model.statistic[0, 0]] <= model.threshold[0, 0]
    slope, curve = p - y, p * (1 - p)
    own = sum((slope[s].sum()) ** 2 / (curve * s.sum() + quality_trees.PENALTY) for s in (left, ~left)) - slope.sum() ** 2 / (curve * len(y) + quality_trees.PENALTY)
    assert own == pytest.approx(brute_root(x, y))


def test_trees_of_few_rows():
    none = quality_trees.fit(np.zeros((0, 3)), np.zeros(0))
    assert quality_trees.probabilities(none, np.ones((2, 3))).tolist() == [0.5, 0.5]
    one = quality_trees.fit(np.ones((5, 3)), np.ones(5))
    assert (quality_trees.probabilities(one, np.ones((1, 3))) > 0.9).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = quality_trees.op12_quality_classifier(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for label in (0, 1):
        own = [r.predicted == label for r in rows if r.quality == label]
        assert len(own) > 10 and sum(own) / len(own) >= 0.95


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "x"), (2, 1, 0, "x"), (7, 0, 0, "x"), (None, 0, 0, "x"), (4, None, 0, "x")], LABELS)
    model = quality_trees.train(odd, labels)
    rows = quality_trees.quality_scores(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_trees.train(odd, labels.limit(0)).base == 0
    assert quality_trees.quality_scores(odd.limit(0), model).collect() == []


def test_fit_is_bounded_by_ids(spark):
    """An id on 20,000 rows is one row of the fit."""
    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.union(spark.createDataFrame([(4, "clean words here"), (5, "# $ %")], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 0)], "doc_id long, quality int")
    model = quality_trees.train(docs, labels, folds=1000, fold=999)
    assert model.base == pytest.approx(math.log(2.5 / 1.5))
