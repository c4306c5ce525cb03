"""Edge cases that the tables do not hold."""

import datetime
import hashlib
import random
import re

import pytest

from corvane.operators import audit, budget, chunking, clinical, deid, embedding, parsing, search, versions
from corvane.sources import files


def test_group_sizes_respects_limits_and_overlap():
    ranges = chunking.group_sizes([40, 40, 40, 40, 10], 80, 100, 45)
    assert ranges[0] == (0, 2) and all(b > a for a, b in ranges) and ranges[-1][1] == 5
    assert all(later[0] > earlier[0] for earlier, later in zip(ranges, ranges[1:]))
    assert chunking.group_sizes([], 10, 10, 0) == [] and chunking.group_sizes([500], 10, 100, 0) == [(0, 1)]


def test_chunks_keep_order_and_bounds(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(60))
    out = chunking.chunk_fixed(spark.createDataFrame([(1, text), (2, "")], "section_id long, text string"), target=30, most=40, least=1, overlap=6).orderBy("ordinal").collect()
    assert {r.section_id for r in out} == {1} and all(r.tokens <= 40 for r in out)
    assert out[0].text.startswith("Sentence number 0") and out[-1].text.endswith("59 ends here.")


def test_sections_and_tables():
    text = "intro\n# A\nx\n## B\ny\n# C\nz"
    assert [(s["path"], s["parents"], s["text"]) for s in parsing.sections_of(text)] == [("1", [], "x"), ("1.1", ["A"], "y"), ("2", [], "z")]
    assert parsing.sections_of("plain")[0]["heading"] == "Document"
    (t,) = parsing.tables_of("cap\n| a | b |\n|---|---|\n| 1 |\nend")
    assert t["rows"] == [{"a": "1", "b": ""}] and t["caption"] == "cap"


def test_html_to_markdown():
    page = "<html><script>x<1</script><h2>T &amp; U</h2><p>one<br>two</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    assert parsing.markdown_of(page) == "## T & U\n\none\ntwo\n\n| a |\n| --- |\n| 1 |"


def test_overlap_rule_is_the_same_natively(spark):
    spans = [("A", 0, 5), ("B", 0, 9), ("C", 4, 6), ("D", 9, 12), ("E", 9, 12), ("F", 20, 20)]
    rows = [dict(entity_type=k, start=a, stop=b, score=0.95, text="") for k, a, b in spans]
    df = spark.createDataFrame([(rows,)], f"spans {deid.SPANS}")
    native = [s.entity_type for s in deid.resolve_overlaps(df).first().spans]
    assert native == [s[0] for s in deid.resolve([(k, a, b, 0.95, "") for k, a, b in spans])] == ["B", "D"]


def test_surrogates_are_hmac(spark):
    import hashlib
    import hmac

    df = deid.detect_entities(spark.createDataFrame([("mail bé.x@y.org now",)], "text string").selectExpr("'a x.y@z.org b' as text"), "text")
    expected = hmac.new(b"s" * 70, b"EMAIL:x.y@z.org", "sha256").hexdigest()[:16]
    assert deid.surrogate(df, b"s" * 70).first().text == f"a EMAIL_{expected} b"


def test_surrogates_by_type(spark):
    """Dates keep their style and move with the record's key, ages over 89 and zips are cut."""
    text = "MRN: A1234 born 03/05/1931, aged 93 years old, zip 06301 and 90210-1234, seen May 7, 2024"
    out = deid.surrogate(deid.detect_entities(spark.createDataFrame([(text,)], "text string"), "text"), b"salt").first().text
    found = re.fullmatch(r"MRN_[0-9a-f]{16} born (\d\d)/(\d\d)/(\d{4}), aged 90\+, zip 000 and 902, seen ([A-Z][a-z]+) (\d\d), (\d{4})", out)
    assert found, out
    moved = datetime.date(int(found[3]), int(found[1]), int(found[2])) - datetime.date(1931, 3, 5)
    seen = datetime.datetime.strptime(f"{found[4]} {found[5]}, {found[6]}", "%B %d, %Y").date() - datetime.date(2024, 5, 7)
    assert moved == seen and abs(moved.days) <= 365
    alone = deid.surrogate(deid.detect_entities(spark.createDataFrame([("on 2024-02-30, 2/3/99 and 85 y/o",)], "text string"), "text"), b"salt").first().text
    assert alone == "on 2024, 1999 and 85 y/o"


def test_canonical_event(spark):
    """Fields in their order, control characters escaped, the chain's hash inside."""
    row = ("e1", "2024-01-01T00:00:00Z", "a\tb", "authn", "r", "VIEW", "7", "OK", {"traceId": 'q"\\', "requestId": "\u0001x"})
    df = spark.createDataFrame([row], "event_id string, occurred_at string, actor string, action string, role string, resource_type string, resource_id string, outcome string, payload map<string,string>")
    got = audit.canonical_hash(audit.classify_event(df)).first()
    payload = '{"requestId":"\\u0001x","traceId":"q\\"\\\\"}'
    assert got.payload_json == payload and got.payload_hash == hashlib.sha256(payload.encode()).hexdigest()
    text = '{"eventId":"e1","timestamp":"2024-01-01T00:00:00Z","actor":"a\\tb","category":"AUTHENTICATION","role":"r","action":"authn","resourceType":"VIEW","resourceId":"7","outcome":"OK""payload":' + payload + f',"payloadHash":"{got.payload_hash}","previousHash":""}}'
    assert got.event_hash == hashlib.sha256(text.encode()).hexdigest()


def test_tampering_is_found_where_it_is(spark):
    rows = [(1, i, f"e{i}") for i in range(5)] + [(2, 0, "x")]
    sealed = audit.seal_chain(spark.createDataFrame(rows, "chain long, seq long, unsealed string"), "chain")
    assert {r.chain: r.broken_at for r in audit.verify_chain(sealed, "chain").collect()} == {1: None, 2: None}
    bad = sealed.selectExpr("chain", "seq", "if(chain = 1 and seq = 2, 'z', unsealed) as unsealed", "prev_hash", "hash")
    assert {r.chain: (r.broken_at, r.reason) for r in audit.verify_chain(bad, "chain").collect()} == {1: (2, "HASH"), 2: (None, None)}


def test_admission_equals_a_ledger(spark):
    draw, limits = random.Random(5), {"day_global": 60, "day_user": 15, "month_role": 150, "month_user": 40}
    rows = []
    for i in range(400):
        month, day = draw.choice(["m1", "m2", "m3"]), draw.randrange(4)
        rows.append((i, draw.randrange(50), f"{month}-{day}", month, draw.choice(["a", "b", None]), draw.choice([1, 2, 3, 4, 5, 6, None]), draw.randrange(1, 6) if month != "m3" else draw.randrange(40) // 39))
    spent, want = {}, {}
    for i, _, day, month, role, user, cost in sorted(rows, key=lambda r: (r[3], r[1], r[0])):
        keys = {"day_global": day, "day_user": (day, user), "month_role": (month, role), "month_user": (month, user)}
        want[i] = all(spent.get((k, v), 0) + cost <= limits[k] for k, v in keys.items())
        for k, v in keys.items():
            spent[k, v] = spent.get((k, v), 0) + cost * want[i]
    costs = spark.createDataFrame(rows, "id long, ts long, day string, month string, role string, user long, cost long")
    assert {r.id: r.admitted for r in budget.admit(costs, limits).collect()} == want
    assert {r.id: r.admitted for r in budget.admit(costs, limits, block=23).collect()} == want
    assert 50 < sum(want.values()) < 350
    assert budget.admit(costs.limit(0), limits).count() == 0
    assert budget.admit(costs, {}).where("admitted").count() == 400


def test_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<float>")
    v = spark.createDataFrame([(7, [2.0, 0.0]), (5, [1.0, 0.0]), (9, [0.0, 3.0])], "chunk_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in search.vector_topk(q, v, 2).collect()}
    assert got == {(1, 1): (5, 1.0), (1, 2): (7, 1.0), (2, 1): (5, 0.0), (2, 2): (7, 0.0)}
    assert search.vector_topk(q.limit(0), v, 2).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(embedding.cosine("a", "b")).collect()


def test_cover_density_prefers_near_terms(spark):
    docs = spark.createDataFrame([(1, "heart rate normal"), (2, "heart was seen and the rate too")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, ["heart", "rate"])], "query_id long, terms array<string>")
    got = {r.chunk_id: r.score for r in search.cover_density(q, search.build_postings(docs)).collect()}
    assert got[1] == 0.5 and got[2] < got[1]


def test_upsert_and_publish(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    n = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k long, v string")
    merged, conflicts = files.upsert_checked(t, n, ["k"], ["v"])
    assert merged.count() == 3 and [r.k for r in conflicts.collect()] == [1]
    with pytest.raises(ValueError):
        files.publish_index(spark, {"docs": merged}, [conflicts], str(tmp_path))
    files.publish_index(spark, {"docs": merged}, [], str(tmp_path))
    assert files.read_published(spark, str(tmp_path), "docs").count() == 3


def test_read_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"Doc ID": 1, "Text": "x"}, {"Doc ID": 2, "Text": "y"}]}')
    assert files.read_records(spark, str(tmp_path / "a.json"), "json").columns == ["doc_id", "text"]
    (tmp_path / "a.csv").write_text("Sample Name,Text\na,b\n")
    assert files.read_records(spark, str(tmp_path / "a.csv"), "csv").columns == ["sample_name", "text"]
    with pytest.raises(ValueError):
        files.clean_names(["a b", "A-B"])
    texts = files.read_text_documents(spark, str(tmp_path))
    assert {r.status for r in texts.collect()} == {"RAW_ONLY"}


def test_k_anonymity_roles(spark):
    df = spark.createDataFrame([("a", 3), ("b", 10)], "code string, patient_count long")
    assert [tuple(r) for r in clinical.k_anonymise(df, 5, "RESEARCHER").collect()] == [("b", 10, 1, False)]
    assert clinical.k_anonymise(df, 5, "CLINICIAN", "care").count() == 2
    with pytest.raises(PermissionError):
        clinical.k_anonymise(df, 5, "ADMIN")
    with pytest.raises(ValueError):
        clinical.strip_identifiers(df.drop("patient_count"))


def test_version_edges(spark):
    rows = [(1, 10, "2", "2020-01-01", "CONFIRMED"), (1, 11, "1", "2020-01-01", "CONFIRMED"), (1, 12, "9", "2021-01-01", "WITHDRAWN"), (1, 13, "9", None, "UNKNOWN")]
    df = spark.createDataFrame(rows, "document_id long, version_id long, version string, effective_date string, status string").selectExpr("document_id", "version_id", "version", "cast(effective_date as date) as effective_date", "status")
    got = {r.version_id: (r.new_status, r.superseded_by) for r in versions.version_chain(df).collect()}
    assert got == {10: ("ACTIVE", None), 11: ("SUPERSEDED", 10), 12: ("WITHDRAWN", None), 13: ("UNKNOWN", None)}
