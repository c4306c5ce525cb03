"""Web-style search against a plain evaluation of the same rules."""

import random
import re

from corvane.operators import websearch


def tokens_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def plain_clauses(query):
    """Groups of (negated, tokens), by a walk over the query's characters."""
    groups, rest = [[]], query.lower()
    while rest:
        if m := re.match(r'(-?)"([^"]*)"', rest):
            words, negated = tokens_of(m[2]), m[1] == "-"
        elif m := re.match(r'[^\s"]+', rest):
            if m[0] == "or":
                groups.append([])
                rest = rest[2:]
                continue
            words, negated = tokens_of(m[0]), m[0][0] == "-"
        else:
            rest = rest[1:]
            continue
        if words and (negated, words) not in groups[-1]:
            groups[-1].append((negated, words))
        rest = rest[m.end() :]
    return [g for g in groups if g]


def plain_score(query, text):
    """None, or the sum over groups of 0.1 / (1 + noise) of all shortest stretches."""
    words, total, any_group = tokens_of(text), 0.0, False
    for group in plain_clauses(query):
        places = {}
        for i, (_, run) in enumerate(group):
            places[i] = [s for s in range(len(words)) if words[s : s + len(run)] == run]
        asked = [i for i, (negated, _) in enumerate(group) if not negated]
        if not asked or any(not places[i] for i in asked) or any(places[i] for i, (negated, _) in enumerate(group) if negated):
            continue
        any_group = True
        own = sum(len(group[i][1]) for i in asked)

        def holds(low, high, asked=asked, group=group, places=places):
            return all(any(low <= s and s + len(group[i][1]) - 1 <= high for s in places[i]) for i in asked)

        for low in range(len(words)):
            for high in range(low, len(words)):
                if holds(low, high) and not holds(low + 1, high) and not holds(low, high - 1):
                    total += 0.1 / (1 + max(high - low + 1 - own, 0))
    return round(total, 9) if any_group else None


QUERIES = [
    "a b", '"a b" c', "a -b", '-"b a" c', "a or b c", "OR a or OR b or", '"a a" b', "c-a", '"or" b', '"b c', "-a", "zz a", "zz or c d", "A a a", '"a b a"', "é -É", "", '"" -', '"a b" "b a"', "d -a -b or a d",
]


def test_web_search(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "or", "É"]) for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["", None, "c-a b", "a " * 300 + "b c"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in websearch.web_topk(queries, chunks, 1000).collect()}
    expected = {(q, c): s for q, query in enumerate(QUERIES) for c, text in enumerate(texts) if text and (s := plain_score(query, text)) is not None}
    assert {k for k in got} == {k for k in expected}
    assert all(abs(got[k] - expected[k]) < 1e-8 for k in got)


def test_ranks_and_empty_tables(spark):
    chunks = spark.createDataFrame([(3, "a b"), (1, "a b"), (2, "a x b")], "chunk_id long, text string")
    queries = spark.createDataFrame([(7, "a b")], "query_id long, query string")
    rows = websearch.web_topk(queries, chunks, 2).collect()
    assert [(r.chunk_id, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1), (3, 2)]
    assert websearch.web_topk(queries.limit(0), chunks, 2).collect() == []
    assert websearch.web_topk(queries, chunks.limit(0), 2).collect() == []


def shuffled(spark):
    """Records that all stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_words_of_a_phrase_that_stand_apart_are_not_met(spark):
    n = 4000
    chunks = spark.range(n).selectExpr("id as chunk_id", "if(id = 7, 'a b c', 'a c b d') as text")
    queries = spark.createDataFrame([(q, '"a b" c') for q in range(5)], "query_id long, query string")
    before = shuffled(spark)
    rows = websearch.web_topk(queries, chunks, 10).collect()
    assert {(r.query_id, r.chunk_id) for r in rows} == {(q, 7) for q in range(5)}
    assert shuffled(spark) - before < 4 * n


def test_long_phrases(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("aabc") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    phrase = lambda low, high: '"' + " ".join(rng.choice("abc") for _ in range(rng.randint(low, high))) + '"'
    asked = [f"{phrase(3, 6)} {phrase(1, 4)} -{phrase(3, 5)} or -{phrase(1, 1)} {phrase(2, 3)} {phrase(2, 5)} {phrase(1, 2)}" for _ in range(40)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in websearch.web_topk(queries, chunks, 1000).collect()}
    expected = {(q, c): s for q, query in enumerate(asked) for c, text in enumerate(texts) if (s := plain_score(query, text)) is not None}
    assert expected and set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-8 for k in got)


def test_scores_of_neighbouring_rows_stay_apart(spark):
    found = [[(0, 10, [5])], [(0, 3, [5])], [(0, 1, [9, 0]), (1, 2, [1, 10])]]
    schema = "query_id long, chunk_id long, found array<struct<clause: int, width: int, starts: array<int>>>"
    matches = spark.createDataFrame([(0, i, f) for i, f in enumerate(found)], schema).coalesce(1)
    assert {r.chunk_id: r.score for r in websearch.cover_score(matches).collect()} == {0: 0.1, 1: 0.1, 2: round(0.1 + 0.1 / 7 + 0.1, 9)}
