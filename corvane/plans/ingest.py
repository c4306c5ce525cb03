"""I and P: documents as files, pages as raw markup."""

import uuid

from pyspark.sql import functions as F

from corvane.operators import parsing as par
from corvane.operators.tables import shared_folder
from corvane.sources import files as op

from .base import QUERIES, query

CUR = "select source, doc_id as uri, text, md5(text) as h, length(text) as size from {documents}"
VERSIONS = (
    "select concat('src', cast(user_id % 20 as varchar(9))) as source, user_id as uri, md5(cast(value as varchar(40))) as "
    "fingerprint, ts as retrieved_at, event_id as id from {events}"
).replace("md5(cast(value as varchar(40)))", "md5(event_type)")


def list_documents_file(spark, sf_dir):
    """I-01 over the folder of input tables."""
    return op.list_objects(spark, f"{sf_dir}/documents.parquet").select("size", "mime", "error")


QUERIES["i01_list_objects"] = list_documents_file


@query("i02_fingerprint", "select uri, sha256(text) as fingerprint from c", c=CUR)
def _(c):
    return op.fingerprint(c, "text").select("uri", "fingerprint")


@query("i03_latest_fingerprint", "select source, uri, arg_max(fingerprint, (retrieved_at, id)) as fingerprint from v group by 1, 2", v=VERSIONS)
def _(v):
    return op.latest_fingerprint(v)


@query("i04_classify_changes", "select uri, case when uri % 11 = 0 then 'NEW' when uri % 7 = 0 then 'CHANGED' else 'UNCHANGED' end as change, uri % "
    "11 = 0 or uri % 7 = 0 as should_process from c", c=CUR)
def _(c):
    now = op.fingerprint(c, "text").select("source", "uri", "fingerprint")
    before = now.where("uri % 11 <> 0").withColumn("fingerprint", F.when(F.col("uri") % 7 == 0, "0").otherwise(F.upper("fingerprint")))
    return op.classify_changes(now, before).select("uri", "change", "should_process")


@query("i05_validate_files", "select uri, case when size = 0 then 'EMPTY' when size > 5000 then 'TOO_LARGE' when uri % 6 = 0 then 'TYPE' when uri % "
    "8 = 0 then 'FINGERPRINT' else 'OK' end as status from c", c=CUR)
def _(c):
    rows = c.selectExpr("uri", "size", "if(uri % 6 = 0, 'image/png', 'text/plain') as mime", "h as fingerprint", "if(uri % 8 = 0, 'x', upper(h)) as expected")
    return op.validate_files(rows, 5000, ("text/plain",)).select("uri", "status")


_DIGEST = "cast(sum(cast(concat('0x', left(sha256(concat(cast(uri as varchar), '|', h)), 15)) as bigint)) as varchar)"


@query(
    "i06_file_manifest",
    f"""select source, count(*) as files, cast(sum(size) as bigint) as bytes, min(uri) as first_uri, max(uri) as last_uri, {_DIGEST} as digest
from c group by 1""",
    c=CUR,
)
def _(c):
    return op.file_manifest(c.withColumnRenamed("h", "fingerprint"))


@query("i06_file_records", "select source, uri, size, h as fingerprint, row_number() over (order by source, uri, h) as place from c", c=CUR)
def _(c):
    return op.file_records(c.withColumnRenamed("h", "fingerprint"))


@query("i07_dedupe_by_key", "select source, h, min(uri) as uri from c group by 1, 2", c=CUR)
def _(c):
    return op.dedupe_by_key(c.select("source", "h", "uri"), ["source", "h"], [F.col("uri")])


@query("i08_read_records", "select doc_id, upper(lang) as lang_code from d", d="select doc_id, lang from {documents}")
def _(d):
    """JSON records in a container, as I-08 finds them, with cleaned names."""
    held = d.withColumn("json", F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("Doc ID"), F.upper("lang").alias("Lang-Code"))).alias("records"))))
    parsed = held.select(F.explode(F.from_json("json", "records array<struct<`Doc ID`:bigint,`Lang-Code`:string>>")["records"]).alias("r")).select("r.*")
    return parsed.toDF(*op.clean_names(parsed.columns))


#: Records that a JSON document of i08_record_files holds at most, or about as many.
RECORDS = 20_000


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "i08_record_files",
    """select 'csv' as kind, doc_id, upper(lang) as lang_code, false as corrupt from d
union all select 'jsonl', case when doc_id % 10 > 0 then doc_id end, case when doc_id % 10 > 0 then upper(lang) end, doc_id % 10 = 0 from d
union all select 'json', doc_id, upper(lang), false from d""",
    d="select doc_id, lang, source from {documents}",
)
def _(d):
    """Files written as CSV, as JSON lines of which every tenth is cut off, and as JSON
    documents that hold a source's records in an array, read back by the reader."""
    spark = d.sparkSession
    out = _folder(spark)
    named = d.select(F.col("doc_id").alias("Doc ID"), F.upper("lang").alias("Lang-Code"), "source")
    named.drop("source").write.option("header", True).csv(f"{out}/csv")
    line = F.to_json(F.struct("Doc ID", "Lang-Code"))
    named.select(F.when(F.col("Doc ID") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(f"{out}/jsonl")
    # dealt by ranges, so there are as many documents as ranges and sources, whatever the ids are
    ranges = -(-d.count() // RECORDS) or 1
    dealt = named.repartitionByRange(ranges, "source", "Doc ID").withColumn("part", F.spark_partition_id())
    by_part = dealt.groupBy("source", "part").agg(F.collect_list(F.struct("Doc ID", "Lang-Code")).alias("records"))
    by_part.select("records", "source", "part").write.partitionBy("source", "part").json(f"{out}/json")
    read = []
    for kind, schema in (("csv", None), ("jsonl", "`Doc ID` bigint, `Lang-Code` string, _corrupt string"), ("json", None)):
        rows = op.read_records(spark, f"{out}/json/*/*" if kind == "json" else f"{out}/{kind}", kind, schema)
        corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
        read.append(rows.select(F.lit(kind).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), "lang_code", corrupt.alias("corrupt")))
    return read[0].union(read[1]).union(read[2])


@query(
    "i11_read_text_documents",
    """select 'TXT' as suffix, source, 'PARSED' as status, sha256(string_agg(text || chr(10), ''
  order by doc_id)) as text_hash, true as same from d group by 2
union all select 'CSV', source, 'RAW_ONLY', null, null from d group by 2""",
    d="select doc_id, text, source from {documents}",
)
def _(d):
    """A text file and a file of an unsupported kind for each source, read as bytes."""
    spark = d.sparkSession
    out = _folder(spark)
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("text", "source").write.partitionBy("source").text(f"{out}/text")
    d.select("source", "doc_id").repartition("source").write.partitionBy("source").csv(f"{out}/other")
    read = op.read_text_documents(spark, out)
    source, hashed = F.regexp_extract("uri", "source=([^/]+)", 1), F.sha2("text", 256)
    return read.select(
        F.upper(F.regexp_extract("uri", r"\.([a-z]+)$", 1)).alias("suffix"), source.alias("source"), "status", hashed.alias("text_hash"), (hashed == F.col("fingerprint")).alias("same")
    )


_PATHS = (
    "select concat('docs/', lang) as path, doc_id % 50 as record_index, cast(doc_id as varchar(20)) as document_id, text "
    "from {documents}"
)


@query("i14_write_documents", "select document_id, md5(text) as h, row_number() over (order by path, record_index, document_id) as place from d", d=_PATHS)
def _(d):
    """Written twice, so that the second set takes the first one's place; read in file order."""
    spark = d.sparkSession
    out = f"{_folder(spark)}/set"
    op.write_documents(d.where("record_index = 0"), out)
    op.write_documents(d, out)
    return op.read_in_order(spark.read.schema(d.schema).json(out)).select("document_id", F.md5("text").alias("h"), "place")


@query(
    "i17_publish_index",
    """select 'documents' as table_name, uri as id, upper(h) as value, 2 as version from c
union all select 'chunks', uri, source, 2 from c""",
    c=CUR,
)
def _(c):
    """A set, a newer one, one with a conflict and one that comes too late: the second is read."""
    spark = c.sparkSession
    out = _folder(spark)
    documents, chunks = c.select(F.col("uri").alias("id"), F.col("h").alias("value")), c.select(F.col("uri").alias("id"), F.col("source").alias("value"))
    newer = documents.withColumn("value", F.upper("value"))
    op.publish_index(spark, {"documents": documents, "chunks": chunks.where("id % 2 = 0")}, [], out)
    op.publish_index(spark, {"documents": newer, "chunks": chunks}, [], out, after=1)
    conflicts = op.upsert_checked(newer, documents, ["id"], ["value"])[1]
    for frames, found, after in (({"documents": documents}, [conflicts], None), ({"documents": documents}, [], 1)):
        try:
            op.publish_index(spark, frames, found, out, after)
        except ValueError:
            continue
        raise AssertionError("a set that conflicts was published")
    version = op.published_version(spark, out)[0]
    read = [op.read_published(spark, out, t).select(F.lit(t).alias("table_name"), "id", "value", F.lit(version).alias("version")) for t in ("documents", "chunks")]
    return read[0].union(read[1])


@query("i09_normalise_records", "select record_index, case when record_index % 4 = 0 then concat('record-', lpad(cast(record_index as varchar), 6, "
    "'0')) else concat('d', record_index) end as id, case when record_index % 3 = 0 then concat('src record ', case when "
    "record_index % 4 = 0 then concat('record-', lpad(cast(record_index as varchar), 6, '0')) else concat('d', "
    "record_index) end) else source end as title, case when record_index % 5 = 0 then 'en' else lang end as language from d", d="select doc_id as record_index, source, lang, text from {documents}")
def _(d):
    rows = d.selectExpr("record_index", "if(record_index % 4 = 0, ' ', concat('d', record_index)) as pmid", "if(record_index % 3 = 0, '', source) as name", "text as body", "if(record_index % 5 = 0, cast(null as string), lang) as lang")
    return op.normalise_records(rows, {"id": ("uid", "pmid"), "title": ("title", "name"), "text": ("text", "body"), "language": ("lang",)}, "src").select("record_index", "id", "title", "language")


@query("i10_assign_document_ids", "select uri, left(sha256(concat(source, ':', 'docs/', lang, '#record=', uri, '#index=', uri)), 32) as document_id, "
    "sha256(text) as content_hash from c", c="select source, doc_id as uri, lang, text from {documents}")
def _(c):
    rows = c.selectExpr("uri", "source", "concat('docs/', lang) as path", "cast(uri as string) as id", "uri as record_index", "text")
    return op.assign_document_ids(rows).select("uri", "document_id", "content_hash")


@query("i12_limit_per_source", "select source, record_index from d qualify row_number() over (partition by source order by record_index) <= 7", d="select doc_id as record_index, source from {documents}")
def _(d):
    return op.limit_per_source(d, 7)


@query("i13_license_gate", "select uri from c where source in ('src1', 'src4')", c=CUR, s=("select * from (values ('src1', array('use', 'model')), ('src2', array('use')), ('src4', array('model'))) as s(source, "
    "purposes)", "select 1 as x"))
def _(c, s):
    return op.license_gate(c, s, "model").select("uri")


BASE = "select o_orderkey as k, o_orderstatus as v from {orders} where o_orderkey % 3 > 0"
NEW = (
    "select o_orderkey as k, case when o_orderkey % 10 = 0 then 'Z' else o_orderstatus end as v from {orders} where "
    "o_orderkey % 5 > 0 or o_orderkey % 10 = 0"
)


@query("i15_insert_ignore", "select * from t union all select * from n where k not in (select k from t)", t=BASE, n=NEW)
def _(t, n):
    return op.insert_ignore(t, n, ["k"])


@query("i16_upsert_checked", "select k, coalesce(t.v, n.v) as v from t full join n using (k)", t=BASE, n=NEW)
def _(t, n):
    return op.upsert_checked(t, n, ["k"], ["v"])[0]


@query("i16_upsert_conflicts", "select k, concat('{\"v\":\"', t.v, '\"}') as stored, concat('{\"v\":\"', n.v, '\"}') as offered from t join n using "
    "(k) where t.v <> n.v", t=BASE, n=NEW)
def _(t, n):
    return op.upsert_checked(t, n, ["k"], ["v"])[1]


PAGES = "select page_id as doc_id, html from {pages}"


@query("p01_html_to_markdown", p=PAGES)
def _(p):
    return par.html_to_markdown(p).select("doc_id", "markdown")


MD = "select doc_id, text from {documents}"


def _headed(d):
    """Markdown with a heading in front of each line, levels from 1 to 3."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" H"), i.cast("string"), F.lit("\n"), x))
    return d.withColumn("text", F.array_join(lines, "\n"))


@query("p02_extract_sections", "select doc_id, len(string_split(text, chr(10))) as n from d", d=MD)
def _(d):
    return par.extract_sections(_headed(d)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("p03_assign_section_paths", "with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as i from d) select doc_id, i as place, "
    "case i % 3 when 0 then cast(i // 3 + 1 as varchar) when 1 then concat(i // 3 + 1, '.1') else concat(i // 3 + 1, "
    "'.1.1') end as path, i % 3 as n_parents from l", d=MD)
def _(d):
    return par.extract_sections(_headed(d)).select("doc_id", F.col("place").cast("long").alias("place"), "path", F.size("parents").cast("long").alias("n_parents"))


TB = "select o_orderkey as doc_id, o_orderpriority as a, o_orderstatus as b from {orders}"


def _tables(t):
    """One table behind a heading; the second row is short."""
    return par.extract_tables(t.selectExpr("doc_id", "concat('# Head\\nintro\\n| A | B |\\n| --- | --- |\\n| ', a, ' | ', b, ' |\\n| x |\\nend') as text"))


@query("p04_extract_tables", "select doc_id, 'intro' as caption, a as first_a, b as first_b, '' as second_b from t", t=TB)
def _(t):
    out = _tables(t)
    return out.selectExpr("doc_id", "caption", "rows[0]['A'] as first_a", "rows[0]['B'] as first_b", "rows[1]['B'] as second_b")


@query("p05_section_of_offset", "select t.doc_id, t.start, arg_max(path, (level, path)) as section_path from t left join s on s.doc_id = t.doc_id and "
    "t.start >= s.a and t.start < s.b group by 1, 2",
       t="select l_orderkey as doc_id, l_partkey % 100 as start from {lineitem} where l_linenumber = 1", s="select l_orderkey as doc_id, l_partkey % 50 as a, l_partkey % 50 + l_suppkey as b, l_linenumber as level, "
           "concat(l_returnflag, cast(l_linenumber as varchar(3))) as path from {lineitem}")
def _(t, s):
    return par.section_of_offset(t, s.withColumnsRenamed({"a": "start", "b": "stop"}))


@query("p06_linearise_table", "select doc_id, concat('intro', chr(10), '| A | B |', chr(10), '| --- | --- |', chr(10), '| ', a, ' | ', b, ' |', "
    "chr(10), '| x |  |') as linearised from t", t=TB)
def _(t):
    return par.linearise_table(_tables(t)).select("doc_id", "linearised")


@query("p07_parse_status", "select doc_id, case when doc_id % 5 = 0 or text = '' or doc_id % 7 = 0 then 'FAILED' when doc_id % 3 = 0 then "
    "'PARTIAL' else 'SUCCEEDED' end as parse_status, case when doc_id % 5 = 0 then 'unsupported' when text = '' then "
    "'empty' when doc_id % 7 = 0 then 'no content' end as warning from d", d=MD)
def _(d):
    rows = d.selectExpr("doc_id", "if(doc_id % 5 = 0, 'pdf', 'MD') as suffix", "encode(text, 'UTF-8') as content", "if(doc_id % 7 = 0, 0, 2) as n_sections", "if(doc_id % 3 = 0, array('w'), array()) as warnings")
    return par.parse_status(rows).select("doc_id", "parse_status", "warning")
