"""Rules whose expected values are written out, and jobs that leave files behind."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import audit, budget, clinical, deid, search, tables
from corvane.plans.registry import QUERIES
from corvane.sources import files


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    got = {r.i: r.n for r in tables.numbered(df, [F.col("v").asc(), F.col("i").asc()]).collect()}
    assert got == {r[2]: n + 1 for n, r in enumerate(order)}
    own, seen = {}, {}
    for k, _, i in order:
        seen[k] = own[i] = seen.get(k, 0) + 1
    assert {r.i: r.n for r in tables.numbered(df, [F.col("v").asc(), F.col("i").asc()], within=["k"]).collect()} == own
    assert tables.numbered(df.limit(0), [F.col("v").asc()]).collect() == []


def test_python_gets_batches_in_slices(spark):
    size = tables.sliced("long")(lambda *columns: columns[0] * 0 + len(columns[0]))
    df = spark.range(0, 1300, 1, 1).select("id", size("id").alias("one"), size("id", F.col("id") + 1).alias("two"))
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert [r[0] for r in got] == list(range(1300)) and max(max(r[1:]) for r in got) == tables.SLICE
    assert size("id") is not None and spark.range(0).select(size("id")).collect() == []


def test_nul_is_escaped(spark):
    row = spark.createDataFrame([("a\0b\x1f\"\\",)], "t string").select(F.expr(audit._json("t"))).first()[0]
    assert row == '"a\\u0000b\\u001f\\"\\\\"' and json.loads(row) == 'a\0b\x1f"\\'


def test_areas_are_cut_to_three_digits(spark):
    got = spark.createDataFrame([("03601",), ("89312-1",), ("1 2",), (None,)], "z string").select(clinical.safe_zip3(F.col("z"))).collect()
    assert [r[0] for r in got] == ["036", "893", None, None]


def test_every_zip_is_cut_by_its_own_digits(spark, data):
    """Of all orders, with no id left out; what has no five digits is 000."""
    got = {r.id: r.zip for r in QUERIES["d08_zip3"](spark, data).collect()}
    ids = [r.o_orderkey for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()]
    area = {i: f"{i * 7 % 99999:05d}"[:3] for i in ids}
    assert got == {i: "000" if a in deid.SMALL_ZIPS else a for i, a in area.items()}
    assert spark.createDataFrame([("9021",)], "z string").select(deid.zip3("z")).first()[0] == "000"


def test_zips_without_five_digits_are_no_area(spark, data):
    """Each order's number as it is: fewer than five digits are 000, as are the reference's twelve areas."""
    got = {r.id: r.unpadded for r in QUERIES["d08_zip3"](spark, data).collect()}
    small = {"036", "059", "063", "102", "203", "556", "692", "821", "823", "878", "879", "884"}
    ids = [r.o_orderkey for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()]
    number = {i: str(i * 7 % 99999) for i in ids}
    assert got == {i: "000" if len(n) < 5 or n[:3] in small else n[:3] for i, n in number.items()}
    assert set(deid.SMALL_ZIPS) == small and {len(n) for n in number.values()} > {4, 5}


def test_assertions_keep_their_digits(spark):
    """The part at place 1 begins and ends with 1, that at place 2 with 2."""
    got = spark.createDataFrame([(7, " Zero. 148.9 is 11\n2 of 22\n\n ")], "id long, answer string")
    assert [tuple(r) for r in search.split_assertions(got).orderBy("place").collect()] == [(7, 0, "Zero."), (7, 1, "148.9 is 11"), (7, 2, "2 of 22")]


def test_coverage_without_assertions(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, assertion_id long")
    c = spark.createDataFrame([(1, 1, True), (2, None, True), (3, None, True), (3, None, False), (1, 9, None)], "query_id long, assertion_id long, valid boolean")
    got = {r.query_id: (r.coverage, r.status) for r in search.citation_coverage(a, c).collect()}
    assert got == {1: (0.5, "INSUFFICIENT_COVERAGE"), 2: (1.0, "VALID"), 3: (1.0, "INVALID_CITATION")}


def joined_rows(plan):
    """Rows that come out of each join of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    below = [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]
    rows = plan.metrics().get("numOutputRows")
    return below + ([rows.get().value()] if "Join" in name and rows.isDefined() else [])


def test_cover_density_meets_rare_terms_first(spark):
    """Frequent words meet no chunk but those that hold a query's rare one."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(40)) + f" rare{i}") for i in range(300)]
    asked = [(q, ["a", "b", "a", f"rare{q}", "c", "d", "e", "f", "g", "h", "i", "j"][: 4 + q % 9]) for q in range(300)] + [(900, ["a", "nowhere"]), (901, []), (902, ["a"])]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string")
    df = search.cover_density(spark.createDataFrame(asked, "query_id long, terms array<string>"), search.build_postings(chunks))
    want = {}
    for q, terms in asked:
        for c, text in docs:
            words, score, start, last = text.split(), 0.0, -1, {}
            if terms and set(terms) <= set(words):
                for at, w in enumerate(words):
                    last |= {w: at} if w in terms else {}
                    if w in terms and len(last) == len(set(terms)) and min(last.values()) > start:
                        start = min(last.values())
                        score += 1.0 / (at - start + 1)
                want[q, c] = round(score, 9)
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in df.collect()} == want
    joins = joined_rows(df._jdf.queryExecution().executedPlan())
    assert joins and max(joins) < 10_000  # all pairs of a query's word and a chunk with it: half a million


def test_query_classes(spark):
    asked = {"count": "STRUCTURED", "accounts": "MIXED", None: "MIXED", "fever": "CLINICAL", "feverish": "MIXED", "hi": "OUT_OF_SCOPE", "hi, sop": "MIXED", "rediagnosed": "CLINICAL", "my blood pressures": "CLINICAL"}
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    assert {r.question: r.query_class for r in search.classify_queries(df).collect()} == asked


def test_vector_blocks_are_one_search(spark, monkeypatch):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, search.vector_topk(queries, vectors, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, search.vector_topk(queries, vectors, 3).collect())) == whole


def test_vector_slices_are_one_search(spark, monkeypatch):
    """Batches that a task scores in slices of seven vectors, ties among them."""
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(100)], "chunk_id long, embedding array<double>").coalesce(1)
    queries = vectors.where("chunk_id % 9 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, search.vector_topk(queries, vectors, 3).collect()))
    monkeypatch.setattr(search, "VECTOR_SLICE", 7)
    assert sorted(map(tuple, search.vector_topk(queries, vectors, 3).collect())) == whole


def test_admission_of_all_events(spark, data):
    """The registered limits over all events, in one block and in small ones."""
    from corvane.plans.budget import COSTS
    from corvane.plans.base import view

    costs, limits = view(spark, data, COSTS[0]), {"day_global": 5000, "day_user": 150, "month_role": 60000, "month_user": 1500}
    spent, want = {}, {}
    for r in sorted(costs.collect(), key=lambda r: (r.month, r.ts, r.id)):
        keys = {"day_global": (r.day,), "day_user": (r.day, r.user), "month_role": (r.month, r.role), "month_user": (r.month, r.user)}
        want[r.id] = all(spent.get((k, v), 0) + r.cost <= limits[k] for k, v in keys.items())
        for k, v in keys.items():
            spent[k, v] = spent.get((k, v), 0) + r.cost * want[r.id]
    assert 0 < sum(want.values()) < len(want)
    for block in (20_000, 150):
        assert {r.id: r.admitted for r in budget.admit(costs, limits, block).collect()} == want


def test_admission_settles_in_few_rounds(spark, monkeypatch):
    """Eight days that each use up their limit, and totals of the month that they do not."""
    rows = [(d * 100 + i, d * 100 + i, f"d{d}", "m", f"r{i % 3}", i % 40, (i * 7 + d) % 11 + 1) for d in range(8) for i in range(100)]
    costs, names = spark.createDataFrame(rows, "id long, ts long, day string, month string, role string, user long, cost long"), []
    kept = budget.keep
    monkeypatch.setattr(budget, "keep", lambda df, name: names.append(name) or kept(df, name))
    got = {r.id: r.admitted for r in budget.admit(costs, {"day_global": 60, "month_role": 200, "month_user": 100}, block=25).collect()}
    spent, want = {}, {}
    for i, _, day, _, role, user, cost in rows:
        keys = {day: 60, role: 200, user: 100}
        want[i] = all(spent.get(k, 0) + cost <= most for k, most in keys.items())
        for k in keys:
            spent[k] = spent.get(k, 0) + cost * want[i]
    assert got == want and names.count("changed") <= 4


def test_admission_orders_what_may_fit(spark, monkeypatch):
    """Days of many charges that their first ones fill up: only these go in order."""
    rows = [(d * 2000 + i, d * 2000 + i, f"d{d}", "m", f"r{i % 3}", i % 40, (i * 7 + d) % 11) for d in range(3) for i in range(2000)]
    costs, ordered, kept = spark.createDataFrame(rows, "id long, ts long, day string, month string, role string, user long, cost long"), [], budget.keep
    monkeypatch.setattr(budget, "HEAD_ROWS", 100, raising=False)
    monkeypatch.setattr(budget, "HEAD_TIMES", 8, raising=False)
    monkeypatch.setattr(budget, "HEAD_SHARE", 4, raising=False)
    monkeypatch.setattr(budget, "keep", lambda df, name: (ordered.append(df.count()) if name == "charges" else None) or kept(df, name))
    got = {r.id: r.admitted for r in budget.admit(costs, {"day_global": 60, "month_role": 900, "month_user": 100}).collect()}
    assert got == _ledger(rows, {"day_global": 60, "month_role": 900, "month_user": 100}) and max(ordered) < len(rows) / 5


def test_admission_behind_the_heads(spark, monkeypatch):
    """Small charges that fit long after a head, and take from users what later days then have
    left; charges of broken numbers, and without a day in two months."""
    draw, rows = random.Random(2), []
    for i in range(1200):
        month, day = draw.choice("ab"), draw.randrange(4)
        cost = draw.choice([7, 9, 13]) if draw.random() < 0.97 else draw.choice([0, 0.25, 1.5, 2])
        rows.append((i, draw.randrange(300) + 300 * day, f"{month}{day}" if day < 3 else None, month, draw.choice(["x", "y", None]), draw.choice([1, 2, 3, None]), float(cost)))
    costs = spark.createDataFrame(rows, "id long, ts long, day string, month string, role string, user long, cost double")
    for name, value in {"HEAD_ROWS": 2, "HEAD_TIMES": 2, "HEAD_STEP": 8, "HEAD_SHARE": 1}.items():
        monkeypatch.setattr(budget, name, value, raising=False)
    passes, limits = [], {"day_global": 60, "month_role": 200, "month_user": 70}
    monkeypatch.setattr(budget, "keep", lambda df, name: passes.append(name) or tables.keep(df, name))
    assert {r.id: r.admitted for r in budget.admit(costs, limits).collect()} == _ledger(rows, limits)
    assert passes.count("inside") > 1


def _ledger(rows, limits):
    """Decisions in order of month, ts and id."""
    spent, want = {}, {}
    for i, _, day, month, role, user, cost in sorted(rows, key=lambda r: (r[3], r[1], r[0])):
        keys = {"day_global": (day,), "day_role": (day, role), "day_user": (day, user), "month_global": (), "month_role": (role,), "month_user": (user,)}
        want[i] = all(spent.get((k, month, keys[k]), 0) + cost <= most for k, most in limits.items())
        for k in limits:
            spent[k, month, keys[k]] = spent.get((k, month, keys[k]), 0) + cost * want[i]
    return want


def test_publishing(spark, tmp_path):
    out, df = f"file://{tmp_path}/index", spark.range(5).toDF("id")
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, out, "t")
    files.publish_index(spark, {"t": df.where("id < 2")}, [], out)
    with pytest.raises(ValueError):
        files.publish_index(spark, {"t": df}, [df], out)
    with pytest.raises(ValueError):
        files.publish_index(spark, {"t": df}, [], out, after=0)
    assert files.read_published(spark, out, "t").count() == 2 and files.published_version(spark, out)[0] == 1
    (tmp_path / "index" / "claims" / f"{2:012d}").touch()  # a writer that stopped between claim and pointer
    files.publish_index(spark, {"t": df}, [], out)
    assert files.read_published(spark, out, "t").count() == 5 and files.published_version(spark, out)[0] == 3


def test_write_documents_keeps_the_old_set(spark, tmp_path):
    out = f"file://{tmp_path}/set"
    rows = spark.createDataFrame([(f"p{i % 3}", i, str(i)) for i in range(50)], "path string, record_index long, document_id string")
    files.write_documents(rows, out)
    broken = rows.withColumn("record_index", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        files.write_documents(broken, out)
    back = files.read_in_order(spark.read.schema(rows.schema).json(out)).orderBy("place").collect()
    assert [(r.path, r.record_index) for r in back] == sorted((f"p{i % 3}", i) for i in range(50))
