"""Votes, reliabilities, added spans and language posteriors recomputed in plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import language_id, pii

TEXTS = [
    "write to ann.lee@example.org or bob [at] sample.com today", "call (212) 555-0187 or 212-555-0199 now", "phone: +44 20 7946 0958, fax 020 7946 0111",
    "card 4111-1111-1111-1111 and order 1234 5678 9012 3456", "host 10.1.2.3, version 1.2.3.4, net fe80:0:0:0:1:2:3:4", "id 555 123 4567 is no phone", "mail me at x (at) y dot org please", "", None,
    "account 4000 1234 5678 9010 and 378282246310005", "ip 300.1.2.3 and 8.8.8.8", "see +1 (212) 555-1234 or 555.867.5309",
]


def plain_em(patterns, counts, rounds=30):
    """Shares and reliabilities by kind, one pattern at a time."""
    share, right = {k: 0.5 for k in range(4)}, {(k, v): 0.8 for k in range(4) for v in range(4)}

    def truth(p):
        odds = math.log(share[p[0]] / (1 - share[p[0]])) + sum(p[1 + v] * math.log(right[p[0], v] / (1 - right[p[0], v])) for v in range(4))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        t = [truth(p) for p in patterns]
        sums, total = defaultdict(float), defaultdict(float)
        agree, cast = defaultdict(float), defaultdict(float)
        for p, n, q in zip(patterns, counts, t, strict=True):
            sums[p[0]] += n * q
            total[p[0]] += n
            for v in range(4):
                if p[1 + v]:
                    cast[p[0], v] += n
                    agree[p[0], v] += n * (q if p[1 + v] == 1 else 1 - q)
        for k in total:
            share[k] = (sums[k] + 1) / (total[k] + 2)
            for v in range(4):
                right[k, v] = min(max((agree[k, v] + 8) / (cast[k, v] + 10), 0.55), 0.99)
    return share, right, [truth(p) for p in patterns]


def test_reliabilities_of_plain_expectation_maximisation():
    rng = random.Random(6)
    patterns = sorted({(rng.randrange(3), *(rng.choice([-1, 0, 1]) for _ in range(4)), rng.randrange(4), rng.randrange(6)) for _ in range(60)})
    counts = [rng.randrange(1, 50) for _ in patterns]
    model = pii.SpanModel(np.array(patterns), np.array(counts))
    share, right, soft = plain_em(patterns, counts)
    assert model.share == pytest.approx([share[k] for k in range(4)])
    assert model.reliability.ravel() == pytest.approx([right[k, v] for k in range(4) for v in range(4)])
    assert model.posterior(np.array(patterns)) == pytest.approx(soft)
    # the classifier is where the gradient of the soft logistic loss with its ridge is 0
    x, n = model._features(np.array(patterns)), np.array(counts) / sum(counts)
    assert np.abs(x.T @ (n * (np.array(soft) - model.probability(np.array(patterns)))) - 1e-4 * model.weights).max() < 1e-8


def test_added_spans(spark):
    """Candidates that touch no base span, earliest and longest first, at 0.9 or more."""
    texts = TEXTS * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = Counter()
    listed = {t: pii.candidates(t or "") for t in set(texts)}
    for t in texts:
        for row in listed[t]:
            every[(row[0], *row[4:])] += 1
    rows = sorted(every)
    model = pii.SpanModel(np.array(rows), np.array([every[r] for r in rows]))
    for r in pii.personal_data(docs).collect():
        text, kept = r.text if "text" in r else texts[r.doc_id], []
        base = [(pii.KINDS.index(k), a, b) for k, spans in pii.base_spans(text or "").items() for a, b in spans]
        for kind, a, b, is_base, *rest in listed[text]:
            assert is_base or not any(x < b and a < y for _, x, y in base)
            if is_base or model.probability(np.array([[kind, *rest]]))[0] >= pii.ACCEPT:
                kept.append((kind, a, b))
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(kept))
        assert r.n_added == len(kept) - len(base)


def bucket_of(three: bytes) -> int:
    return ((three[0] << 16 | three[1] << 8 | three[2]) * 2654435761 % 2**32) >> 18


def lower(text: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def plain_posteriors(pages, docs):
    """(lang, probability) of each page, by loops over all pages and documents."""
    L = language_id
    counts = defaultdict(Counter)
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang.lower()].update(bucket_of(lower(text)[i : i + 3]) for i in range(len(lower(text)) - 2))
    langs = sorted(k for k in counts if counts[k])
    log = {x: {b: math.log((counts[x][b] + L.SEQUENCE_PRIOR) / (sum(counts[x].values()) + L.BUCKETS * L.SEQUENCE_PRIOR)) for b in range(L.BUCKETS)} for x in langs}
    seen = []
    for url, markup in pages:
        body, host = lower(L.page_text(markup)), L.host_of(url)
        found = [bucket_of(body[i : i + 3]) for i in range(len(body) - 2)]
        scale = min(len(found), L.EFFECTIVE) / max(len(found), 1)
        support = {x: scale * sum(log[x][b] for b in found) for x in langs}
        said = max(langs, key=lambda x: (support[x], -langs.index(x))) if found else None
        labels = host.split(".") if host else []
        seen.append((support, said, L.declared_language(markup), host, ".".join(labels[-2:]) or None, labels[-1] if labels else None))
    pages_of = {x: 1.0 + sum(s[1] == x for s in seen) for x in langs}
    prior = {x: pages_of[x] / sum(pages_of.values()) for x in langs}
    out = []
    for support, said, declared, *keys in seen:
        of = []
        for place, key in zip((3, 4, 5), keys, strict=True):
            of.append({x: max(sum(s[1] == x and s[place] == key for s in seen) - (said == x), 0) if key else 0 for x in langs})
        host, domain, suffix = of
        post = {}
        for x in langs:
            by_domain = (domain[x] + L.HOST_PRIOR * prior[x]) / (sum(domain.values()) + L.HOST_PRIOR)
            by_host = (host[x] + L.HOST_PRIOR * by_domain) / (sum(host.values()) + L.HOST_PRIOR)
            post[x] = support[x] + math.log(by_host)
            if keys[2]:
                share = (sum(suffix.values()) + 1) / (sum(pages_of.values()) + 1)
                post[x] += math.log((suffix[x] + L.SUFFIX_PRIOR * share) / (pages_of[x] + L.SUFFIX_PRIOR))
            if declared in langs:
                stated = [s for s in seen if s[1] == x and s[2] in langs]
                same = sum(s[2] == declared for s in stated)
                guess = 0.9 if x == declared else 0.1 / max(1, len(langs) - 1)
                post[x] += math.log((same + L.DECLARED_PRIOR * guess) / (len(stated) + L.DECLARED_PRIOR))
        top = max(post.values())
        best = next(x for x in langs if post[x] == top)
        out.append((best, 1 / sum(math.exp(v - top) for v in post.values())))
    return out


def test_language_posteriors(spark):
    rng = random.Random(9)
    words = {"en": "the and of this that with are for".split(), "de": "der die das und nicht mit ist ein".split(), "fr": "le la les des une est pas dans".split()}
    docs = [(" ".join(rng.choices(words[x], k=12)), x) for x in words for _ in range(6)] + [(None, "en"), ("text", None)]
    pages = []
    for i in range(70):
        lang = rng.choice(list(words))
        host = rng.choice(["a.example.de", "b.example.de", "www.site.fr", "shop.site.fr", "x.org", "y.org", None])
        said = rng.choice([lang, lang, "en", "zz", None])
        text = " ".join(rng.choices(words[lang], k=rng.choice([0, 2, 9])))
        pages.append((f"https://{host}/p{i}" if host else rng.choice([None, "no host"]), (f"<html lang='{said}'>" if said else "<html>") + f"<p>{text}"))
    pages += pages[:5]  # repeated rows
    df = spark.createDataFrame([(i, *p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language_id.languages(df, spark.createDataFrame(docs, "text string, lang string")).collect()}
    for i, (lang, probability) in enumerate(plain_posteriors(pages, docs)):
        assert got[i].lang == lang and got[i].probability == pytest.approx(probability, rel=1e-6), i
    none = language_id.languages(df.limit(0), spark.createDataFrame(docs, "text string, lang string"))
    assert none.collect() == [] and none.columns[0] == "page_id"


def test_run_of_the_pipeline(spark, tmp_path):
    """`run` is its stages one after the other; an empty table passes through all of them."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").limit(60)
    for name, df in (("full", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    kept = corpus_pipeline.run(spark, f"{tmp_path}/full")
    step = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.keep(stage(spark, step, f"{tmp_path}/full"), name)
    columns = [F.col(c).cast("string").alias(c) for c in sorted(kept.columns)]
    assert sorted(map(str, kept.select(columns).collect())) == sorted(map(str, step.select(columns).collect()))
