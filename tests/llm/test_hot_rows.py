"""Hot lists, equal rows and boilerplate: results as of brute force, work that is spread."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontamination, fingerprints, jaccard_join, mixing, toxicity


def _write(df, spark, name):
    return corpus_pipeline.keep(df, name)


def test_template_costs_no_pairs(spark, monkeypatch):
    """Texts around one template that do not link: a hot list, and no pair of it is made."""
    kept = {}
    monkeypatch.setattr(jaccard_join, "forget", lambda df: None)
    monkeypatch.setattr(jaccard_join, "keep", lambda df, name, keep=jaccard_join.keep: kept.setdefault((name, len(kept)), keep(df, name)))
    own = F.concat_ws(" ", *(F.concat(F.lit("o"), F.col("id"), F.lit(f"z{j}")) for j in range(3)))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(f"t{i}" for i in range(25))), own).alias("text"))
    assert jaccard_join.near_duplicates(docs).select("component_id").distinct().count() == 5000
    sizes = {name: df.count() for (name, _), df in kept.items() if name in ("open", "classes", "pairs")}
    assert sizes["open"] >= 5000 and sizes["classes"] == 0 and sizes["pairs"] == 0


def test_mixed_lists_against_brute_force(spark):
    """Families of near copies of many sizes around shared templates."""
    rng, texts = random.Random(4), []
    for family in range(12):
        base = [f"f{family % 4}w{i}" for i in range(rng.randint(8, 60))]
        for _ in range(rng.randint(2, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words[: rng.randint(len(words) - 3, len(words))]))
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (t.split() for t in texts)]
    component = list(range(len(texts)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                component[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {i: root(i) for i in range(len(texts))}


def brute_edits(rows):
    """Sorted rows -> (id, n_chars, sha256 of the edited text)."""
    out = []
    for i, (ident, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((ident is None, ident or 0, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


def test_fingerprints_of_equal_rows(spark):
    rows = [(i, f"text number {i} of many") for i in range(400)] + [(None, "same words again")] * 20_000 + [(None, None)] * 500 + [(None, "other")]
    docs = _write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark, "equal")
    found = fingerprints.edited_fingerprints(docs).cache()
    nulls = [(None, t) for t in ["same words again"] * 20_000 + [""] * 500 + ["other"]]
    order = {r.text: r.h for r in docs.where("doc_id is null").select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    expected = brute_edits(rows[:400] + sorted(nulls, key=lambda r: order[r[1]]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in found.collect()) == expected
    alike = found.where("doc_id is null and n_chars = 16").groupBy("near_next").count().orderBy(F.desc("count")).first()
    assert alike.near_next == 1.0 and alike["count"] >= 19_999
    dealt = fingerprints.with_next(docs, "doc_id", "text", 8, collapse=True)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert max(sizes) < 20_900 / 8


def test_toxicity_fit_is_bounded_by_ids(spark, monkeypatch):
    """An id on 20,000 rows is one row of the fit."""
    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    docs = docs.union(spark.createDataFrame([(4, "you idiot moron"), (9, "fine words here")], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 0), (4, 1), (9, 0)], "doc_id long, toxic int")
    weights, clean, bias = toxicity.train(docs, labels, folds=1000)
    assert math.isfinite(bias) and len(weights) == toxicity.BUCKETS


def hits_of(docs, items, span=10):
    """n_hit and the sorted items of each text, by comparing all windows."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for ident, text in docs:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            v = words(t)
            size = min(span, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    named.add(str(item))
        out[ident] = (len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
    return out


def test_boilerplate_in_items_and_texts(spark):
    """One line in most items and texts: matches grow with the texts' places, not with
    items times texts."""
    line = "this line stands in every item and in every text as boiler plate"
    items = [(i, f"{line} own{i} part{i}" if i % 3 else f"item{i} " + " ".join(f"u{i}v{j}" for j in range(12))) for i in range(60)] + [(0, "two words"), (None, line)]
    docs = [(i, f"a{i} b{i} {line if i % 2 else ''} own{i} part{i} c{i} two Words") for i in range(60)]
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in found.collect()}
    assert got == hits_of(docs, [x for x in items if x[0] is not None])
    many = spark.range(1000).select(F.col("id").alias("item_id"), F.concat(F.lit(line + " "), F.col("id")).alias("text"))
    texts = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.col("id"), F.lit(" "), F.lit(line)).alias("text"))
    row = decontamination.contamination(texts, many).agg(F.min("n_items"), F.max("n_items"), F.min("n_hit"), F.countDistinct("items_sha256")).first()
    assert tuple(row)[:2] == (1000, 1000) and row[2] >= 13 and row[3] == 1


def test_newton_steps_until_met(spark):
    """Base rates far apart need many steps; the tilt is that of a bisection."""
    parts = [(1e-8, 990), (1.9, 10)]
    histogram = spark.createDataFrame([("s", b, n) for b, n in parts] + [(None, 0.5, 100), (None, 1.5, 50)], "source string, base double, words long")
    needs = spark.createDataFrame([("s", 1500.0), (None, 60.0)], "source string, need double")
    got = {r.source: r.tilt for r in mixing.solve_tilts(histogram, needs).collect()}

    def taken(tilt, parts):
        odds = [(b / (2 - b) * math.exp(tilt), n) for b, n in parts]
        return sum(2 * w / (1 + w) * n for w, n in odds)

    for source, own, need in (("s", parts, 1500), (None, [(0.5, 100), (1.5, 50)], 60)):
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if taken(middle, own) < need else (low, middle)
        assert got[source] == pytest.approx(low, abs=1e-3)
    with pytest.raises(ArithmeticError):
        mixing.solve_tilts(histogram, needs, steps=3)


def test_copies_keep_to_targets(spark):
    """Copies taken document by document: targets by water filling, computed apart."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), f"s{i % 5}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    weight, left, target = {f"s{i}": (3, 1, 2)[i % 3] for i in range(5)}, 1.5 * sum(sizes.values()), {}
    open_ = set(sizes)
    while open_:
        theta = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if theta * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else theta * weight[s]
        left -= sum(target[s] for s in (full or open_))
        open_ -= full or open_
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 45 for s in sizes)


def test_mixing_stage_of_equal_rows(spark, tmp_path):
    """20,000 equal rows share the copies of all: as many rows in all as `mix` says."""
    rows = [(None, "the same words here", "en", "s0", 19)] * 20_000 + [(i, f"own words {i} and more of them", "en", f"s{i % 3}", 9) for i in range(300)]
    docs = _write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(6), spark, "docs")
    mixed = mixing.mix(docs).cache()
    out = corpus_pipeline.mix_sources(spark, docs, "").cache()
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    total = mixed.where("doc_id is null").agg(F.sum("copies")).first()[0]
    same = out.where("doc_id is null")
    assert same.count() == total
    spread = {r.copies: r.n for r in same.groupBy("copies").agg(F.count("*").alias("n")).collect()}
    assert max(spread) - min(spread) <= 1
