"""What a query writes, builds or asks grows no faster than its input."""

import glob
import json

from pyspark.sql import functions as F

from corvane.operators import chunking, clinical, evaluation, search
from corvane.plans.registry import QUERIES


def shared(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


def test_record_files_are_few_whatever_the_ids(spark, tmp_path):
    spark.range(300).selectExpr("id * 2000 as doc_id", "'en' as lang", "concat('src', id % 3) as source").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared(spark)}/files-*"))
    rows = QUERIES["i08_record_files"](spark, str(tmp_path)).collect()
    (out,) = set(glob.glob(f"{shared(spark)}/files-*")) - before
    assert len(glob.glob(f"{out}/json/*/*/part-*")) <= 4
    for kind in ("csv", "json"):
        assert sorted(r.doc_id for r in rows if r.kind == kind) == [i * 2000 for i in range(300)]


def test_ablation_cuts_a_section_once(spark):
    odd = ["", " \n\n \t", "a-b.  C! d\x1c e \U0001f600\U0001f600?\n \nx1y . z", "w " * 1200, "One two. " * 90 + "\n\n" + "w, " * 700 + ". End"]
    sections = spark.createDataFrame([(t,) for t in [*odd, None]], "text string")
    for row in sections.where("text is not null").select(chunking.word_count(F.col("text")).alias("a"), chunking.token_count("text").alias("b")).collect():
        assert row.a == row.b
    out = chunking.ablation(sections, evaluation.ablation_plan(spark, {"seed": 1}), least=20)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.run_id: r for r in out.collect()}
    assert len(got) == 27
    for name, op in (("fixed", chunking.chunk_fixed), ("structure", chunking.chunk_structure), ("semantic", None)):
        keyed = sections.withColumn("section_id", F.monotonically_increasing_id())
        rows = (op(keyed, target=256, overlap=0, least=20) if op else chunking.chunk_semantic(keyed, 0.05, target=256, overlap=0, least=20)).collect()
        run = next(r for i, r in got.items() if i.startswith(f"m25-{name}-256-0-"))
        good = [r.tokens for r in rows if r.status == "OK"]
        assert (run.sections, run.chunks, run.max_tokens) == (len({r.section_id for r in rows}), len(good), max(good))


def test_bundles_are_parsed_once(spark):
    def bundle(*patients, kind="Bundle"):
        entries = [{"resource": {"resourceType": "Patient", "id": p}} if p else {"resource": {"resourceType": "Patient"}} for p in patients]
        return json.dumps({"resourceType": kind, "type": "collection", "fhirVersion": "4.0.1", "entry": entries})

    texts = [bundle("a", "a"), bundle("b", None), bundle("b"), bundle("a", kind="List"), "{broken", None]
    out = clinical.validate_bundles(spark.createDataFrame(list(enumerate(texts)), "source_id long, content string"))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    broken = {(i, code) for i in (4, 5) for code in ("NOT_A_BUNDLE", "TYPE", "VERSION", "NO_ENTRIES")}
    assert {tuple(r) for r in out.collect()} == broken | {(3, "NOT_A_BUNDLE"), (1, "PATIENT_WITHOUT_ID"), (1, "DUPLICATE_PATIENT"), (2, "DUPLICATE_PATIENT")}


def test_quarantine_works_issues_out_once(spark):
    texts = ['{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Device"}}, {"resource": {"resourceType": "Condition", "id": "c"}}]}', "{broken"]
    exploded = clinical.explode_bundles(spark.createDataFrame(list(enumerate(texts)), "source_id long, content string"))
    out = clinical.clinical_quarantine(clinical.validate_resources(exploded))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "importable" in line]
    missing = "; ".join(f"Condition.{f} is required" for f in ("subject", "code", "code.coding.code", "clinicalStatus"))
    assert {(r.source_id, r.position, r.stage, r.reason) for r in out.collect()} == {
        (0, 0, "PROFILE_VALIDATION", "resource type is not importable: Device"), (0, 1, "PROFILE_VALIDATION", missing), (1, None, "PARSE", "PARSE_FAILED"),
    }


def test_rerank_counts_without_tripling_rows(spark):
    hits = spark.createDataFrame([(q, c, c) for q in (1, 2, 3) for c in (1, 2)], "query_id long, chunk_id long, rank int")
    new = [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 1, 2)]
    scores = spark.createDataFrame([(q, c, 0.5, r, "m") for q, c, r in new], "query_id long, chunk_id long, rerank_score double, new_rank int, model string")
    out = search.apply_rerank(hits, scores, 2, "m")
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    kept = {(q, c, c, "DEGRADED") for q in (2, 3) for c in (1, 2)}
    assert {tuple(r) for r in out.collect()} == {(1, 1, 2, None), (1, 2, 1, None)} | kept
