"""Chunks of all documents against a sequential reading of the rules, text by text."""

import hashlib
import json
import re

import numpy as np
import pytest

from corvane.operators import chunking, evaluation

TOKENS = re.compile(r"[^\W_]+|[^\s]", re.U)


def count(text):
    """Letters and digits in a row are one; \\w also takes marks, which the texts lack."""
    return len(TOKENS.findall(text))


def spans(text, pattern):
    """Trimmed pieces between matches, with their places."""
    out, start = [], 0
    for stop in [m.end() for m in re.finditer(pattern, text)] + [len(text)]:
        piece = text[start:stop]
        if piece.strip():
            low = start + len(piece) - len(piece.lstrip())
            out.append((low, low + len(piece.strip())))
        start = stop
    return out


def sentence_spans(text, offset=0):
    return [(a + offset, b + offset) for a, b in spans(text, r"[.!?](?=\s)")]


def units_of(text, strategy, most):
    if strategy != "structure":
        return sentence_spans(text)
    out, start = [], 0
    for gap in [*re.finditer(r"\n[^\S\n]*(?=\n)", text), None]:
        stop = gap.start() if gap else len(text)
        piece = text[start:stop]
        if piece.strip():
            low = start + len(piece) - len(piece.lstrip())
            own = (low, low + len(piece.strip()))
            out += [own] if count(piece) <= most else sentence_spans(piece, start)
        start = stop
    return out


def group(text, units, target, most, overlap):
    """Cursor, end and overlap as the rules say, counting the text between units anew."""
    between = lambda a, b: count(text[units[a][0] : units[b - 1][1]])
    out, cursor = [], 0
    while cursor < len(units):
        first = end = cursor
        while end < len(units) and between(first, end + 1) <= most:
            end += 1
            if between(first, end) >= target:
                break
        out.append((first, end))
        following = end
        if overlap and end < len(units):
            used, start = 0, end
            for i in range(end - 1, first - 1, -1):
                if used + between(i, i + 1) > overlap:
                    break
                used, start = used + between(i, i + 1), i
            if start > first:
                following = start
        cursor = following
    return out


def embed(text, dim=64):
    v = np.zeros(dim)
    for word in f"passage:{text}".lower().split():
        d = hashlib.sha256(word.encode()).digest()
        v[int.from_bytes(d[:4], "big") % dim] += 1 if d[4] % 2 == 0 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def semantic(text, units, threshold, least, most, overlap):
    between = lambda a, b: count(text[units[a][0] : units[b - 1][1]])
    if not units:
        return []
    vectors, groups, start = [embed(text[a:b]) for a, b in units], [], 0
    for i in range(1, len(units)):
        if between(start, i + 1) > most or (vectors[i - 1] @ vectors[i] < threshold and between(start, i) >= least):
            groups.append((start, i))
            start = i
    groups.append((start, len(units)))
    out = []
    for n, (a, b) in enumerate(groups):
        back, used = a, 0
        while n and overlap and back > groups[n - 1][0] and used + between(back - 1, back) <= overlap:
            back -= 1
            used += between(back, back + 1)
        out.append((back if between(back, b) <= most else a, b))
    return out


def expected(text, strategy, target, least, most, overlap, threshold=0.05):
    units = units_of(text, strategy, most)
    if any(count(text[a:b]) > most for a, b in units):
        return None
    ranges = semantic(text, units, threshold, least, most, overlap) if strategy == "semantic" else group(text, units, target, most, overlap)
    return [text[units[a][0] : units[b - 1][1]] for a, b in ranges]


ODD = [
    (900_001, "One. Two! Three? Four.\n\nFive six seven.\n \n\nEight.  Nine ten."), (900_002, ""), (900_003, None), (900_004, " \n\n "), (900_005, "word " * 400 + "."),
    (900_006, "a. " * 300), (900_007, "No end here"), (900_008, "x.\n\n\ny.\n\nz " * 30),
]


@pytest.fixture(scope="module")
def sections(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id as section_id", "text")
    return docs.union(spark.createDataFrame(ODD, "section_id long, text string"))


@pytest.mark.parametrize("strategy,target,least,most,overlap", [
    ("fixed", 60, 10, 120, 25), ("fixed", 512, 100, 1024, 50), ("structure", 60, 10, 120, 25), ("structure", 40, 0, 200, 0), ("semantic", 60, 20, 120, 25), ("semantic", 512, 100, 1024, 50),
])
def test_chunks_of_all_documents(sections, strategy, target, least, most, overlap):
    make = {"fixed": chunking.chunk_fixed, "structure": chunking.chunk_structure, "semantic": lambda s, **o: chunking.chunk_semantic(s, 0.05, **o)}[strategy]
    got = {}
    for r in make(sections, target=target, least=least, most=most, overlap=overlap).collect():
        got.setdefault(r.section_id, []).append(r)
    for r in sections.collect():
        want, own = expected(r.text or "", strategy, target, least, most, overlap), sorted(got.get(r.section_id, []), key=lambda c: c.ordinal)
        if want is None:
            assert [c.status for c in own] == ["UNCHUNKABLE"] and own[0].text is None
        else:
            assert [c.text for c in own] == want, r.section_id
            assert [c.tokens for c in own] == [count(t) for t in want] and [c.ordinal for c in own] == list(range(len(own)))


def test_overlap_never_goes_back_to_the_first_unit():
    assert chunking.group_sizes([40] * 4, 80, 100, 200) == [(0, 2), (2, 4)]
    assert chunking.group_sizes([40] * 4, 80, 100, 45) == [(0, 2), (1, 3), (2, 4)]


def test_ablation_of_all_settings(spark, sections):
    plan = evaluation.ablation_plan(spark, {"seed": 1})
    rows = plan.collect()
    assert len(rows) == len({r.run_id for r in rows}) == 27
    setting = {"controls": {"seed": 1}, "overlapTokens": 50, "strategy": "fixed", "targetTokens": 512}
    digest = hashlib.sha256(json.dumps(setting, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert f"m25-fixed-512-50-{digest[:12]}" in {r.run_id for r in rows}
    got = {r.run_id: r for r in chunking.ablation(sections, plan, most=1024, least=100).collect()}
    texts = [r.text or "" for r in sections.collect()]
    for r in rows:
        name = r.strategy.removesuffix("-v1")
        made = [expected(t, name, r.target, 100, 1024, r.overlap) for t in texts if t.strip()]
        sizes = [count(c) for chunks in made if chunks is not None for c in chunks]
        own = got[r.run_id]
        assert (own.sections, own.chunks, own.max_tokens) == (len(made), len(sizes), max(sizes))
        assert own.mean_tokens == pytest.approx(np.mean(sizes)) and own.unchunkable_share == pytest.approx(np.mean([m is None for m in made]))
