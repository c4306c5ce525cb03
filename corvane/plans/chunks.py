"""C and V: sections are documents, vectors the embeddings table."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import chunking as op
from corvane.operators import embedding as emb

from .base import query

SECTIONS = "select doc_id as section_id, text from {documents}"
_TOK = "len(regexp_extract_all({}, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))"
_SENT = (
    "p as (select section_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda x: trim(x) <> '') as parts from s), st as (select section_id, trim(unnest(parts)) as text, "
    "unnest(range(len(parts))) as place from p), sn as (select *, "
) + _TOK.replace("{}", "text") + " as tokens from st)"


@query("c01_token_count", "select section_id, " + _TOK.replace("{}", "text") + " as tokens from s", s=SECTIONS)
def _(s):
    return s.select("section_id", op.token_count("text").alias("tokens"))


@query("c02_paragraphs", "with l as (select section_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, "
    "chr(10))))) as i from s) select section_id, count(*) filter (trim(text) <> '') as n, sum(length(trim(text))) filter "
    "(trim(text) <> '') as chars from l group by 1 having n > 0", s=SECTIONS)
def _(s):
    # a blank line behind each line makes paragraphs of the lines
    p = op.paragraphs(s.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n"))))
    return p.groupBy("section_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("c03_sentences", "with " + _SENT + " select section_id, count(*) as n, cast(sum(tokens) as bigint) as tokens, count(*) filter (tokens > 20) as "
    "unchunkable from sn group by 1", s=SECTIONS)
def _(s):
    return op.sentences(s, 20).groupBy("section_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if(F.col("status") != "OK").alias("unchunkable"))


@query("c04_units", s=SECTIONS)
def _(s):
    return op.units(s, 200)


@query("c05_group_units", s=SECTIONS)
def _(s):
    return op.group_units(op.sentences(s, 200).where("status = 'OK'").withColumn("part", F.lit(0)), 128, 256, 20, 30)


@query("c06_chunk_fixed", s=SECTIONS)
def _(s):
    return op.chunk_fixed(s)


@query("c07_chunk_structure", s=SECTIONS)
def _(s):
    return op.chunk_structure(s)


@query("c08_chunk_semantic", s=SECTIONS)
def _(s):
    return op.chunk_semantic(s, 0.05, 64, 20, 256)


TABLES = ("select o_orderkey as table_id, o_orderpriority as caption, '| part | price |' as header, transform(sequence(1, "
    "cast(o_orderkey % 30 + 1 as int)), i -> concat('| ', i, ' | ', o_totalprice, ' |')) as rows from {orders}", "select o_orderkey as table_id from {orders}")


@query("c09_chunk_tables", t=TABLES)
def _(t):
    return op.chunk_tables(t, 60)


@query("c10_breadcrumb", "select id, concat_ws(' > ', nullif(trim(title), ''), case when id % 3 > 0 then 'part' end, heading) as breadcrumb "
    "from s", s="select doc_id as id, case when doc_id % 5 = 0 then ' ' else source end as title, lang as heading from {documents}")
def _(s):
    with_parents = s.withColumn("parents", F.expr("if(id % 3 = 0, array(''), array('part'))"))
    return op.breadcrumb(with_parents).select("id", "breadcrumb")


@query("c11_finalise_chunks", "select document_id, kind, place, row_number() over (partition by document_id order by kind <> 'section', "
    "section_path, place) - 1 as ordinal from c", c="select l_orderkey as document_id, case when l_linenumber % 2 = 0 then 'table' else 'section' end as kind, "
    "l_returnflag as section_path, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, "
    "l_extendedprice) as place from {lineitem}")
def _(c):
    return op.finalise_chunks(c, "structure-v1").select("document_id", "kind", "place", "ordinal")


@query("c12_split_unchunkable", "with " + _SENT + " select section_id, place from sn where tokens > 20", s=SECTIONS)
def _(s):
    return op.split_unchunkable(op.sentences(s, 20).withColumn("place", F.col("place").cast("long")))[1].select("section_id", "place")


@query("c13_chunk_stats", "with " + _SENT + " select section_id % 50 as version_id, 'fixed-v1' as strategy, count(*) as chunks, cast(sum(tokens) as bigint) as "
    "tokens from sn group by 1", s=SECTIONS)
def _(s):
    return op.chunk_stats(op.sentences(s, 1024).withColumn("version_id", F.col("section_id") % 50).withColumn("strategy", F.lit("fixed-v1")))


CH = (
    "select doc_id as chunk_id, doc_id % 60 as document_id, doc_id as ordinal, source as breadcrumb, text, case when "
    "doc_id % 9 = 0 then 'SUSPECT' else 'CLEAN' end as phi_scan_status, case when doc_id % 4 = 0 then 'OFF' else "
    "'RULE_BASED' end as contextual_mode, case when doc_id % 3 = 0 then null else 'v1' end as context_prompt_version, case "
    "when doc_id % 7 = 0 then null else source end as context_prefix from {documents}"
)
DC = (
    "select c_custkey as document_id, c_name as title, c_mktsegment as publisher, case when c_custkey % 3 = 0 then ' ' "
    "when c_custkey % 3 = 1 then concat('about  ', c_name) end as summary from {customer} where c_custkey < 70"
)


@query("c14_rule_context", "select chunk_id, md5(concat_ws(chr(10), concat('Document: ', title), concat('Publisher: ', publisher), case when "
    "summary is not null then concat('Summary: ', summary) end, concat('Section: ', breadcrumb))) as h from c join d using "
    "(document_id)", c=CH, d=DC)
def _(c, d):
    return op.rule_context(c, d).select("chunk_id", F.md5("context_prefix").alias("h"))


@query("c15_document_summary", "with f as (select document_id, arg_min(text, ordinal) as first from c group by 1) select document_id, "
    "md5(trim(regexp_replace(coalesce(nullif(trim(summary), ''), nullif(trim(left(first, 512)), ''), 'Summary "
    "unavailable'), '\\s+', ' ', 'g'))) as h from d left join f using (document_id)", c=CH, d=DC)
def _(c, d):
    return op.document_summary(c, d).select("document_id", F.md5("summary").alias("h"))


@query("c16_pending_context", "select document_id, ordinal from c where phi_scan_status = 'CLEAN' and (contextual_mode is distinct from 'RULE_BASED' "
    "or context_prompt_version is distinct from 'v1' or context_prefix is null) order by 1, 2 limit 500", c=CH)
def _(c):
    return op.pending_context(c, "RULE_BASED", "v1").select("document_id", "ordinal")


def _first_word(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.split(" ")[0] if t and len(t) % 2 == 0 else None)


@query("c17_apply_context", "select chunk_id, case when chunk_id % 5 = 0 then 'CACHE_HIT' when length(text) % 2 = 0 and length(text) > 0 then "
    "'GENERATED' else 'RULE_FALLBACK' end as context_status, case when chunk_id % 5 = 0 then 'cached' when length(text) % "
    "2 = 0 and length(text) > 0 then string_split(text, ' ')[1] else breadcrumb end as context_prefix from c", c=CH)
def _(c):
    keyed = c.selectExpr("chunk_id", "text", "breadcrumb as rule_prefix", "chunk_id as version_id", "'s' as strategy", "ordinal", "'LLM' as mode", "'v1' as prompt_version")
    cache = keyed.where("chunk_id % 5 = 0").select("version_id", "strategy", "ordinal", "mode", "prompt_version").withColumn("context_text", F.lit("cached"))
    return op.apply_context(keyed, cache, _first_word).select("chunk_id", "context_status", "context_prefix")


@query("c18_embedding_text", "select chunk_id, md5(case when coalesce(trim(context_prefix), '') = '' then text else concat(context_prefix, chr(10), "
    "chr(10), text) end) as h from c", c=CH)
def _(c):
    return op.embedding_text(c).select("chunk_id", F.md5("embedding_text").alias("h"))


@query("c19_context_cost", "select mode, document_id, count(*) as chunks, round(count(*) * (avg(input_tokens) * 3.0 + avg(output_tokens) * 15.0) "
    "/ 1e6, 6) as cost, round(count(*) * (avg(input_tokens) * 3.0 + avg(output_tokens) * 15.0) / 1e6, 6) <= 0.1 as "
    "within_budget from u group by 1, 2", u="select event_type as mode, user_id as document_id, event_id % 900 as input_tokens, event_id % 90 as output_tokens "
    "from {events}")
def _(u):
    return op.context_cost(u, 3.0, 15.0, 0.1)


@query("e19_ablation_run", s=SECTIONS)
def _(s):
    """All 27 settings over all documents in one plan."""
    from corvane.operators.evaluation import ablation_plan

    controls = {"source_corpus_version": "documents", "tokenizer": "words", "embedding_model": "hash", "embedding_dimension": 64, "seed": 42}
    return op.ablation(s, ablation_plan(s.sparkSession, controls))


VEC = "select vec_id as chunk_id, embedding, label from {embeddings}"
_WORDS = (
    "w as (select section_id, unnest(list_filter(string_split_regex(lower(concat('passage:', text)), '\\s+'), lambda x: x "
    "<> '')) as w from s), c as (select section_id, cast(concat('0x', left(sha256(w), 8)) as bigint) % 64 as dimension, "
    "case when cast(concat('0x', substr(sha256(w), 9, 2)) as bigint) % 2 = 0 then 1 else -1 end as sign from w), v as "
    "(select section_id, dimension, sum(sign)::double as value from c group by 1, 2), n as (select section_id, "
    "sqrt(sum(value * value)) as norm from v group by 1)"
)


@query("v01_hash_embed", "with " + _WORDS + " select section_id, dimension, round((value / norm)::float::double, 5) as value from v join n using (section_id) "
    "where value <> 0", s=SECTIONS)
def _(s):
    e = emb.hash_embed(s, "text", 64).select("section_id", F.posexplode("embedding").alias("dimension", "value"))
    return e.where("value <> 0").select("section_id", F.col("dimension").cast("long").alias("dimension"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query("v01_hash_embed_native", "with " + _WORDS + " select section_id, dimension, round(value / norm, 6) as value from v join n using (section_id) where value <> 0", s=SECTIONS)
def _(s):
    return emb.hash_embed_native(s, "text", "section_id", 64).withColumn("value", F.round("value", 6))


def _lengths():
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


@query("v02_model_embed", "select section_id, round((length(text) + 9) / sqrt((length(text) + 9) ** 2 + 1), 5) as x from s", s=SECTIONS)
def _(s):
    return emb.model_embed(s, "text", _lengths, "passage: ").select("section_id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("x"))


@query("v03_cosine", "select a.chunk_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from vec "
    "a join vec b on b.chunk_id = a.chunk_id + 1", vec=VEC)
def _(vec):
    pairs = vec.select("chunk_id", F.col("embedding").alias("a")).join(vec.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("b")), "chunk_id")
    return pairs.select("chunk_id", F.round(emb.cosine("a", "b"), 6).alias("cosine"))


@query("v04_validate_embeddings", "select chunk_id, case when label = 9 then 'UNKNOWN_MODEL' when label = 8 then 'DISABLED_MODEL' when label = 7 then "
    "'DIMENSION' else 'NOT_FINITE' end as problem from vec where label >= 7 or chunk_id % 20 = 0", vec=VEC)
def _(vec):
    rows = vec.selectExpr("chunk_id", "concat('m', label) as model", "'1' as model_version", "if(chunk_id % 20 = 0 and label < 7, transform(embedding, x -> cast('NaN' as float)), embedding) as embedding")
    registry = vec.where("label < 9").select("label").distinct().selectExpr("concat('m', label) as model", "'1' as model_version", "if(label = 7, 32, 64) as dimension", "label <> 8 as enabled")
    return emb.validate_embeddings(rows, registry)


@query("v05_route_by_dimension", "select chunk_id, len(embedding)::int as dim, case when label = 3 then 'ERROR' else 'dim=64' end as route from (select "
    "chunk_id, label, case when label = 3 then embedding[1:10] else embedding end as embedding from vec)", vec=VEC)
def _(vec):
    cut = vec.withColumn("embedding", F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return emb.route_by_dimension(cut, (64, 768)).select("chunk_id", "dim", "route")


@query("v06_embeddable", "select chunk_id from c where phi_scan_status = 'CLEAN'", c=CH)
def _(c):
    return emb.embeddable(c).select("chunk_id")


@query("v07_embed_distinct", "select section_id, sha256(concat(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), chr(10), 'hash', chr(10), '1')) "
    "as key, 64 as size from s", s=SECTIONS)
def _(s):
    return emb.embed_distinct(s, "text", 64).select("section_id", "key", F.size("embedding").alias("size"))
