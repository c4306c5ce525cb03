"""The operators on documents: odd rows, and brute force where SQL cannot check."""

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontamination, fingerprints, jaccard_join, language_id, lm_scoring, mixing, pii, toxicity
from corvane.llm.components import connected_components
from corvane.llm.elias_fano import EliasFano, encode

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, repeated rows, repeated ids, clashing columns."""
    base = " ".join(f"w{i % 97}x{i}" for i in range(120))
    near = base.replace("w5x5 ", "other ")
    texts = [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE two"), (None, base), (9, "a " * 4000 + "end"), (10, "x" * 300), (11, "Éa éa ÉA"),
        (7, "something else entirely with more than five words here"), (12, "mail a.b@c.org or +1 (212) 555-1234, card 4111 1111 1111 1111 at 10.0.0.1"),
    ]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, "clash", "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    expected = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_components(rows, threshold=80):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            least[group[k]] = min(i, least.get(group[k], i))
    return sorted(((i, len(s), least.get(group[k]) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def test_near_duplicates(spark, odd, data):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, jaccard_join.near_duplicates(odd).collect()), key=str) == brute_components(rows)
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str) == brute_components(rows)


def test_prefix_lengths():
    from fractions import Fraction

    for n in range(1, 200):
        assert jaccard_join.prefix_length(n, Fraction("0.8")) == n - math.ceil(Fraction(4, 5) * n) + 1


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, got))


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 200 and got[None] == 100 and abs(sum(got.values()) - 1875) < 1e-6 and got["b"] <= 200


def test_tilts_meet_their_needs(spark):
    rows = [("a", 0.5, 100), ("a", 1.5, 300), ("b", 1.0, 10), ("c", 0.2, 50), ("c", 1.9, 50)]
    hist = spark.createDataFrame(rows, "source string, base double, words long")
    needs = spark.createDataFrame([("a", 450.0), ("b", 20.0), ("c", 30.0)], "source string, need double")
    tilt = {r.source: r.tilt for r in mixing.solve_tilts(hist, needs).collect()}
    assert tilt["b"] is None
    for source, need in (("a", 450.0), ("c", 30.0)):
        w = [(b / (2 - b) * math.exp(tilt[source]), n) for s, b, n in rows if s == source]
        assert abs(sum(2 * x / (1 + x) * n for x, n in w) - need) < 1e-6


def test_fingerprints(spark, odd):
    got = fingerprints.edited_fingerprints(odd).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is None, r[0]))
    assert len(got) == len(rows)
    same = {}
    for r in fingerprints.fingerprints(odd).collect():
        same.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert same[1] == same[2] and same[4] == same[5] == same[6] == {"0" * 8 * fingerprints.SAMPLES}
    unique = [(i, t) for k, (i, t) in enumerate(rows) if [x for x, _ in rows].count(i) == 1]
    by_id = {r.doc_id: r for r in got}
    for i, t in unique:
        k = rows.index((i, t))
        n, following = len(t), rows[(k + 1) % len(rows)]
        if following in unique:
            edited = t[: n - n // 2] + following[1][: n // 2]
            assert by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by_id[i].n_chars == n
    single = fingerprints.edited_fingerprints(odd.where("doc_id = 3")).first()
    assert single.near_next == 1.0
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0


def test_next_rows_of_a_frequent_id(spark):
    """Most rows without an id, one id on many: all parts together are one ring."""
    rows = [(None, f"none {i} words of {i % 7}") for i in range(300)] + [(7, f"seven {i}") for i in range(200)] + [(i, f"own {i}") for i in range(100, 200)] + [(None, "again")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = fingerprints.with_next(df, "doc_id", "text", 16)
    sizes = [r["count"] for r in parts.where("copy = 0").groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 130
    order = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text").collect()]
    want, edited = Counter(), {}
    signed = dict(zip((t for _, t in order), fingerprints.signatures(pa.array([t for _, t in order]))))
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        change = edited.setdefault(new, fingerprints.signatures(pa.array([new]))[0])
        likeness = [float((signed[t] == other).mean()) for other in (change, signed[n])]
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), *likeness] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprints.edited_fingerprints(df).collect())
    assert got == want


def test_collision_rate_is_generalised_jaccard():
    import pyarrow as pa

    a, b = "x x x y z " + "k " * 7, "x y y w " + "k " * 5
    x, y = Counter(words(a)), Counter(words(b))
    truth = sum((x & y).values()) / sum((x | y).values())
    s = fingerprints.signatures(pa.array([a, b]), 4000)
    assert abs(fingerprints.likeness(s[:1], s[1:])[0] - truth) < 0.04


def test_contamination(spark, odd):
    bench = spark.createDataFrame([("i1", "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15"), ("i2", "Two"), ("i3", None), ("i4", "!!"), (None, "one"), ("i5", "éa éa")], "item_id string, text string")
    got = {}
    for r in decontamination.contamination(odd, bench).collect():
        got.setdefault(r.doc_id, []).append((r.n_hit, r.n_items, r.contaminated))
    assert got[1] == [(11, 1, True)] and got[2] == [(11, 1, True)] * 2 and got[3] == [(10, 1, True)]
    assert (1, 1, True) in got[7] and got[8] == [(1, 1, True)] and got[4] == got[5] == [(0, 0, False)]
    assert got[11] == [(0, 0, False)]  # É is not é: only A-Z is lower-cased
    greek = spark.createDataFrame([(1, "a b c d ΟΔΟΣ.Α e f g h")], "doc_id long, text string")  # a capital sigma's lower form depends on what follows
    spaced = spark.createDataFrame([("g", "a b c d ΟΔΟΣ Α e f g h")], "item_id string, text string")
    assert decontamination.contamination(greek, spaced).first().n_hit == 10
    assert decontamination.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(odd.limit(0), bench).count() == 0


def brute_hits(text, items, span=10):
    """Hit words and items of a text, window by window."""
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    mine, hit, named = cut(text), set(), set()
    for item, other in items:
        theirs = cut(other)
        size = min(span, len(theirs))
        windows = {tuple(theirs[s : s + size]) for s in range(len(theirs) - size + 1)} if theirs else set()
        for start in range(len(mine) - size + 1):
            if tuple(mine[start : start + size]) in windows:
                named.add(item)
                hit |= set(range(start, start + size))
    return len(mine), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


def test_contamination_against_windows(spark):
    """Few different words, so that items repeat their own k-grams and texts hold many diagonals;
    lengths about the window's, a block's borders, and long runs of one word."""
    rng = np.random.default_rng(5)

    def text(n, kinds):
        return " ".join("abcdefgh"[i] for i in rng.integers(0, kinds, n))

    items = [(f"i{j}", text(n, kinds)) for j, (n, kinds) in enumerate([(0, 1), (1, 1), (3, 2), (9, 2), (10, 2), (11, 2), (40, 2), (200, 3), (70, 1)])]
    items += [("i7", text(30, 2)), ("i4", items[4][1]), ("far", " ".join(f"u{i}" for i in range(150)))]
    texts = [text(n, kinds) for n in (0, 1, 9, 10, 13, 63, 64, 65, 140) for kinds in (1, 2, 3, 8)]
    far = items[-1][1].split()
    texts += [" ".join(["x"] * pad + far[start : start + n] + ["y"] * 70) for pad in (0, 1, 55, 61, 64, 127) for start, n in ((0, 10), (3, 9), (60, 12), (140, 10), (0, 150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_repeated_words_are_linear(spark):
    """One word over and over on both sides: a match a place, not one for each pair of places."""
    docs = spark.createDataFrame([(1, "spam " * 100_000)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "spam " * 10_000)], "item_id string, text string")
    start = time.time()
    row = decontamination.contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row.n_items) == (100_000, 100_000, 1) and time.time() - start < 60


def test_pii(spark, odd):
    got = {r.doc_id: r for r in pii.personal_data(odd).collect()}
    r = got[12]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert got[4].spans == got[5].spans == "" and pii.personal_data(odd.limit(0)).count() == 0
    text = pii.masked_texts(odd).where("doc_id = 12").first().text
    assert text == "mail [email] or [phone], card [card] at [ip]"
    assert pii.masked_texts(odd).columns == odd.columns


@pytest.mark.parametrize("text", ["a@b@c.d.e", "x@y", "@@a.b@c.de", "1.2.3.4.5", "001.2.3.256", "1.2.3.4 5.6.7.8", "+1 2", "+12 (3) 4567890-", "4111-1111 1111 1111", "4111 1111 1111 11112", "a" * 5000 + "@", "1" * 5000, "é@a.b ü.x@y.z"])
def test_base_rules(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and pii._luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    assert pii.base_spans(text) == {k: [m.span() for m in re.finditer(p, text) if ok(k, m[0])] for k, p in rules.items()}


def test_long_runs_are_linear():
    """Digits beyond what int() takes, and long words before, in and behind brackets."""
    assert pii.base_spans("0" * 5000 + ".1.2.3")["ip"] == [(0, 5006)] and pii.base_spans("9" * 5000 + ".1.2.3")["ip"] == []
    assert pii.candidates("0" * 5000 + ".1.2.3")[0][:4] == (1, 0, 5006, True)
    for text in ("(" + "a" * 1_000_000, "a(at)" * 100_000, "a(at)" + "b" * 500_000, "1." * 300_000, "+1" * 300_000):
        pii.candidates(text)
    assert pii._spelt("mail joe.b (at) ex (dot) org now") == [(5, 28)]


def test_repeated_rows_share_their_copies(spark):
    """Rows equal in id, source and text: all copies of theirs are dealt to them."""
    rows = [(1, "a b c d", "s0", "x", "y")] * 3 + [(i, f"w{i} v", "s0", "x", "y") for i in range(2, 40)] + [(None, "n n", "s1", "x", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string, copies string")
    want = {r.row_key: r.total for r in mixing.mix(docs).groupBy("row_key").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "total").collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    got = {r.row_key: r["count"] for r in mixed.withColumn("row_key", mixing.row_key()).groupBy("row_key").count().collect()}
    assert got == {k: v for k, v in want.items() if v} and mixed.columns == ["doc_id", "text", "source", "_row", "copies", "copy"]


def test_reliabilities_follow_the_votes():
    rows = np.array([[0, 1, 1, 1, 0, 0, 2], [0, 1, 1, 1, 1, 0, 2], [0, 1, -1, -1, -1, 0, 2], [0, -1, -1, -1, 0, 1, 1]])
    model = pii.SpanModel(rows, np.array([400, 300, 200, 100]))
    p = model.probability(rows)
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.3 and p[3] < 0.2
    assert pii.SpanModel(np.zeros((0, 7), int), np.zeros(0)).probability(rows).shape == (4,)


def test_toxicity(spark, odd, data):
    docs, labels = spark.read.parquet(data.replace("0.001", "0.1") + "/documents.parquet"), spark.read.parquet(data.replace("0.001", "0.1") + "/labels.parquet")
    model = toxicity.train(docs, labels)
    out = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id", 5)).toPandas()
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.99 and (out[out.toxic == 1].predicted == 1).mean() > 0.85
    assert toxicity.toxicity_scores(odd, model).count() == odd.count()
    assert toxicity.without_toxic(odd, model).columns == odd.columns and toxicity.without_toxic(odd, model).where("text is null").count() == 1
    empty = toxicity.train(odd, labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(odd, empty).collect()} == {0.0}


def test_toxicity_of_a_small_sample(spark, data):
    """Insults that a few toxic and no clean texts hold are features in a small sample."""
    small = data.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels)
    for word in ("trash", "idiot", "stupid", "moron"):
        buckets, _ = toxicity.word_grams(toxicity.Words(pa.array([word])), np.array([0]))
        assert (model[0][buckets] != 0).mean() > 0.5, word
    out = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id", 5)).toPandas()
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.98 and (out[out.toxic == 1].predicted == 1).mean() > 0.8


def test_evidence():
    toxic, clean = np.array([17.0, 93.0, 96.0, 0.0, 1.0, 0.0]), np.array([0.0, 0.0, 56.0, 9.0, 9.0, 2000.0])
    got = toxicity.evidence(toxic, clean)
    share = toxic.sum() / (toxic.sum() + clean.sum())
    assert np.allclose(got[:2], -2 * toxic[:2] * math.log(share)) and got[0] > 6.63 and got[1] > got[2] > got[4]


@pytest.mark.parametrize(("n", "bound"), [(0, 10), (1, 1), (5, 6), (1000, 3000), (1000, 10**15), (5000, 2**63), (300, 200)])
def test_elias_fano(n, bound):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, bound, n, dtype=np.uint64))
    e = EliasFano(encode(v, bound))
    q = np.concatenate([rng.integers(0, bound, 500, dtype=np.uint64), v, v + np.uint64(1)])
    assert (e.get(np.arange(n)) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()


def brute_lm(train, texts):
    """Tokens, known tokens, training tokens, base score, score from all pairs and triples."""
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        s = ["</s>", *words(t), "</s>"]
        one.update(s[1:]), two.update(zip(s, s[1:])), three.update(zip(s, s[1:], s[2:]))
    n, v = sum(one.values()), len(one)
    g2, g3 = Counter(), Counter()
    for (a, _), c in two.items():
        g2[a] += (c - 0.75) / one[a]
    for (a, b, _), c in three.items():
        g3[a, b] += (c - 0.75) / two[a, b]
    out = []
    for t in texts:
        s, base, full = ["</s>", *words(t), "</s>"], 0.0, 0.0
        for i in range(1, len(s)):
            p = (one[s[i]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            p = max(two[s[i - 1], s[i]] - 0.75, 0) / max(one[s[i - 1]], 1) + (1 - g2[s[i - 1]]) * p
            if i > 1:
                k = s[i - 2], s[i - 1]
                p = max(three[*k, s[i]] - 0.75, 0) / max(two[k], 1) + (1 - g3[k]) * p
            full += math.log10(p)
        out.append((len(s) - 1, sum(one[w] > 0 for w in s[1:]), n, base, full))
    return out


def assert_scores(got, want):
    """Two codes meet in a product, each rounded down by 0.03 in log10 at most."""
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and -1e-6 <= b[4] - a[4] <= 0.061 * a[0] + 1e-6


@pytest.mark.parametrize("slot_tokens", [2_000_000, 40])
def test_lm_scores(spark, odd, monkeypatch, slot_tokens):
    """With few tokens a slot, frequent words are split over several."""
    monkeypatch.setattr(lm_scoring, "SLOT_TOKENS", slot_tokens)
    texts = [r.text for r in odd.collect()]
    others = ["", "a a a", "w1x1 w2x2 unknown w3x3", "unknown unknown", "a end a " * 50]
    model = lm_scoring.train(odd)
    assert_scores([tuple(r)[1:] for r in lm_scoring.scores(odd, model).collect()], brute_lm(texts, texts))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(others)], "doc_id long, text string")
    assert_scores([tuple(r)[1:] for r in lm_scoring.scores(asked, model).collect()], brute_lm(texts, others))
    none = lm_scoring.train(odd.limit(0))
    assert {round(r.base_score, 9) for r in lm_scoring.scores(odd, none).collect()} == {0.0}
    assert lm_scoring.scores(odd.limit(0), model).count() == 0


def test_lm_query(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.text, r.doc_id) for r in odd.collect()]
    aside = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for _, i in rows]
    train = [t for (t, _), x in zip(rows, aside, strict=True) if not x]
    got = lm_scoring.op6_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for _, i in rows) and sum(r.held_out for r in got) == sum(aside)
    assert_scores([tuple(r)[2:] for r in got], brute_lm(train, [t for t, _ in rows]))


def test_lm_successors_of_a_frequent_context():
    """A share below 10^-4 is present, with its value, and not a 0."""
    context, word, count, total = np.array([5, 5, 5, 6]), np.array([1, 2, 4, 1]), np.array([2, 3, 10**8 - 9, 2]), np.array([10**8] * 3 + [10**18])
    before = np.array([3, 3, 3, 0])
    level = lm_scoring.Level(lm_scoring.Level.build(context, before, word, count, total, 10))
    p, _ = level.find(np.append(context, [5, 7]), np.append(before, [3, 0]), np.append(word, [3, 1]))
    assert (p[:4] > 0).all() and p[4:].tolist() == [0, 0]
    low = np.log10((count - 0.75) / total) - np.log10(p[:4])
    assert (low > -1e-9).all() and (low < 0.1251).all()


def test_packed_columns():
    columns = np.array([5, -7, 2**40]), np.arange(1000, dtype=np.int32), np.zeros(0, np.int16)
    for x, y in zip(columns, lm_scoring.unpack(lm_scoring.pack(*columns)), strict=True):
        assert x.tolist() == y.tolist() and x.dtype == y.dtype


def test_languages(spark, odd):
    docs = spark.createDataFrame([("the and of this that", "en")] * 5 + [("der die das und nicht", "de")] * 5 + [(None, "xx"), ("zz", None)], "text string, lang string")
    pages = [(1, "http://a.b.de/x", '<html lang="de"><p>das ist nicht der'), (2, "http://a.b.de/y", None), (3, None, "<p>this and that"), (None, "bad", ""), (4, "http://a.b.de/z", "<html lang='en'><b>und die das der nicht")]
    got = {r.page_id: r for r in language_id.languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got[1].lang == "de" and got[2].lang == "de" and got[3].lang == "en" and got[4].lang == "de" and got[3].host is None
    assert all(0 < r.probability <= 1 for r in got.values())
    none = language_id.languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0))
    assert none.where("lang is null").count() == 5


_PIECES = ["<", ">", "<script", "</script>", "</SCRIPT  >", "<style>", "</style>", "<!--", "-->", "-", "!", "<html", " lang = 'de'", "lang=en", " ", "a", "&#65;", "&amp;", "/"]


@given(st.lists(st.sampled_from(_PIECES), max_size=14).map("".join))
def test_markup_by_one_expression(markup):
    plain = html.unescape(re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", markup, flags=re.S | re.I))
    assert language_id.page_text(markup) == plain
    found = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", markup, re.I)
    assert language_id.declared_language(markup) == (found and found[1].lower())


def test_long_markup_is_linear():
    began = time.time()
    for piece in ("<script>", "<style ", "<!--", "<", "<html ", "<html lang", "</script ", "<script></style>"):
        language_id.page_text(piece * (1_000_000 // len(piece)))
        language_id.declared_language(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20
    assert language_id.page_text("&#" + "0" * 6000 + "65; &#" + "9" * 6000 + ";") == "A \ufffd"


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    every = {r.doc_id: r.text for r in docs.collect()}
    deduped = corpus_pipeline.one_of_each_group(spark, docs, data)
    assert sorted(r.doc_id for r in deduped.collect()) == sorted({c for _, n, c in brute_components(list(every.items()))})
    clean = corpus_pipeline.drop_contaminated(spark, docs, data)
    flags = {r.doc_id for r in decontamination.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == set(every) - flags
    masked = corpus_pipeline.mask_personal_data(spark, docs, data)
    assert masked.columns == docs.columns and all(r.n_chars == len(r.text) for r in masked.collect())
    mixed = corpus_pipeline.mix_sources(spark, docs, data)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}


def _prose(seed, n=60):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_near_duplicates_of_null_ids(spark):
    """A set that only null ids hold is compared as any other."""
    text = _prose(1)
    docs = spark.createDataFrame([(None, text), (20, text + " more"), (None, _prose(2))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(20, 57, 20), (None, 56, 20), (None, 56, None)], key=str)


def test_pipeline_verdicts_go_by_row(spark, tmp_path):
    """Null ids and shared ids: a verdict on one row does not remove another."""
    import corpus_pipeline

    spark.createDataFrame([(1, _prose(3, 30)), (2, _prose(4, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaks = {(None, _prose(3)), (7, _prose(4))}
    clean = {(1, _prose(5)), (None, _prose(6)), (7, _prose(7)), (None, None), (8, "")}
    copies = {(None, _prose(5) + " more"), (9, _prose(5)), (7, _prose(5) + " again")}
    nulls = {(None, _prose(8)), (None, _prose(8) + " more")}
    docs = spark.createDataFrame([*leaks, *clean, *clean, *copies, *nulls], "doc_id long, text string")
    one = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect())
    assert set(one.values()) == {1} and len(set(one) & nulls) == 1 and set(one) - nulls == leaks | clean
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == clean | copies | nulls
