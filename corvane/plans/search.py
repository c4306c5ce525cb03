"""R: queries are benchmark items and sampled vectors, the corpus is the documents."""

from pyspark.sql import functions as F

from corvane.operators import search as op
from corvane.operators import websearch as web
from corvane.operators.tables import keep

from .base import query

DOCS = "select doc_id as chunk_id, text from {documents}"
QUERIES = ("select item_id as query_id, regexp_extract_all(lower(text), '[\\\\p{{L}}\\\\p{{N}}]+', 0) as terms, text from "
    "{benchmark}", "select item_id as query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as terms, text from {benchmark}")
VQ = "select vec_id as query_id, embedding as vector from {embeddings} where vec_id % 20 = 0"
VEC = "select vec_id as chunk_id, embedding from {embeddings}"
_COS = "list_cosine_similarity(q.vector::double[], v.embedding::double[])"
_VTOP = (
    "vt as (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, "
    "chunk_id) as rank from (select query_id, chunk_id, "
) + _COS + " as score from vq q, vec v) qualify rank <= {k})"
_POST = (
    "tok as (select chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as token from docs), post as "
    "(select token, chunk_id, count(*) as tf from tok group by 1, 2)"
)
_LTOP = _POST + """, want as (select query_id, unnest(list_distinct(terms)) as token, len(list_distinct(terms)) as n_terms
  from q), df as (select token, count(*) as df from post where token in (select token from want)
  group by 1), nn as (select count(*) as n_chunks from docs),
ls as (select query_id, chunk_id, round(sum(ln(1 + n_chunks / df) * tf / (tf + 1)), 9) as score from want join df using (token)
  join post using (token), nn group by 1, 2 having count(*) = max(n_terms)),
lt as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ls qualify rank <= {k})"""


def _k(sql: str, k: int) -> str:
    return sql.replace("{k}", str(k))


@query("r01_normalise_queries", "select query_id, trim(query) as query, greatest(1, least(20, coalesce(top_k, 8))) as top_k, least(100, "
    "greatest(coalesce(candidates, 50), greatest(1, least(20, coalesce(top_k, 8))))) as candidates from rows_ where "
    "trim(query) <> ''", rows_="select doc_id as query_id, case when doc_id % 10 = 0 then '  ' else concat(' ', source) end as query, case when "
    "doc_id % 3 = 0 then null else cast(doc_id % 30 - 2 as int) end as top_k, case when doc_id % 4 = 0 then null else "
    "cast(doc_id % 150 as int) end as candidates from {documents}")
def _(rows_):
    return op.normalise_queries(rows_)


CHUNKS = (
    "select doc_id as chunk_id, doc_id % 700 as version_id, case when doc_id % 9 = 0 then 'SUSPECT' else 'CLEAN' end as "
    "phi_scan_status, case when doc_id % 2 = 0 then 'structure-v1' else 'fixed-v1' end as strategy from {documents}"
)
VERS = (
    "select o_orderkey as version_id, o_custkey as document_id, case o_orderstatus when 'F' then 'ACTIVE' when 'O' then "
    "'SUPERSEDED' else 'WITHDRAWN' end as status, cast(o_orderdate as date) as effective_date from {orders}"
)
DOCUM = (
    "select c_custkey as document_id, c_mktsegment as doc_type, concat('n', cast(c_nationkey as varchar(3))) as publisher "
    "from {customer}"
)
_ELIG = (
    "select chunk_id, version_id, document_id, doc_type, publisher, effective_date from c join v using (version_id) join d "
    "using (document_id) where phi_scan_status = 'CLEAN' and strategy = 'structure-v1' and status in ('ACTIVE', "
    "'SUPERSEDED')"
)


@query("r02_eligible_chunks", _ELIG, c=CHUNKS, v=VERS, d=DOCUM)
def _(c, v, d):
    return op.eligible_chunks(c, v, d, "structure-v1", True).select("chunk_id", "version_id", "document_id", "doc_type", "publisher", "effective_date")


@query("r03_apply_filters", f"with e as ({_ELIG}) select chunk_id from e where doc_type in ('BUILDING', 'MACHINERY') and effective_date >= date '1996-01-01' and effective_date <= date '2000-12-31' and chunk_id % 3 = 0", c=CHUNKS, v=VERS, d=DOCUM)
def _(c, v, d):
    e = op.eligible_chunks(c, v, d, "structure-v1", True).withColumn("metadata", F.create_map(F.lit("section_type"), F.concat(F.lit("s"), F.col("chunk_id") % 3)))
    return op.apply_filters(e, ["BUILDING", "MACHINERY"], None, "1996-01-01", "2000-12-31", ["s0"]).select("chunk_id")


@query("r04_vector_topk", "with " + _k(_VTOP, 8) + " select query_id, chunk_id, round(score, 6) as score, rank from vt", vq=VQ, vec=VEC)
def _(vq, vec):
    return op.vector_topk(vq, vec, 8).withColumn("score", F.round("score", 6))


@query("r05_build_postings", "with " + _POST + " select * from post", docs=DOCS)
def _(docs):
    return op.build_postings(docs).select("token", "chunk_id", "tf")


@query("r06_parse_search", """select query_id, 'alpha' as must, concat('exact ', w1) as phrases, concat(w2, ',beta') as should, w3 as must_not from rows_""", rows_="select doc_id as query_id, concat('src', cast(doc_id % 7 as varchar(3))) as w1, concat('w', cast(doc_id as "
    "varchar(20))) as w2, lang as w3 from {documents}")
def _(rows_):
    built = rows_.withColumn("query", F.expr("concat('Alpha  \"Exact ', w1, '\" ', upper(w2), ' OR beta -', w3)"))
    return op.parse_search(built).select("query_id", *(F.array_join(c, ",").alias(c) for c in ("must", "phrases", "should", "must_not")))


@query("r07_lexical_topk", "with " + _k(_LTOP, 10) + " select query_id, chunk_id, round(score, 6) as score, rank from lt", docs=DOCS, q=QUERIES)
def _(docs, q):
    return op.lexical_topk(q, op.build_postings(docs, op.wanted_tokens(q), False), docs, 10).withColumn("score", F.round("score", 6))


@query("r07_cover_density", docs=DOCS, q=QUERIES)
def _(docs, q):
    return op.cover_density(q, op.build_postings(docs, op.wanted_tokens(q))).withColumn("score", F.round("score", 6))


@query("r08_staleness", "select version_id, coalesce(effective_date < date '1998-05-31', false) as stale from v", v="select o_orderkey as version_id, case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as "
    "effective_date from {orders}")
def _(v):
    from corvane.operators.versions import staleness

    return staleness(v, "2001-05-31").select("version_id", "stale")


#: Web-style queries of whole items: every four words a group of a phrase of two, a word
#: and a word that must not occur, groups joined by OR. The SQL takes the words alone.
_WORDS_OF = (
    "regexp_extract_all(lower(text), '[\\\\p{{L}}\\\\p{{N}}]+', 0)", "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
)
_GROUP = (
    "concat('\"', array_join(slice(w, 4 * i + 1, 2), ' '), '\" ', array_join(transform(slice(w, 4 * i + 3, 1), x -> if(x = "
        "'or', '\"or\"', x)), ''),"
    " if(size(w) > 4 * i + 3, concat(' -', w[4 * i + 3]), ''))"
)
WEB = (
    f"select item_id as query_id, array_join(transform(sequence(0, (size(w) - 1) div 4), i -> {_GROUP}), ' OR ') as query"
    f" from (select item_id, {_WORDS_OF[0]} as w from {{benchmark}}) where size(w) > 0",
    f"select item_id as query_id, {_WORDS_OF[1]} as w from {{benchmark}}",
)
_WEB_LISTS = """
wg as (
  select query_id, g, w[4 * g + 1] as a, w[4 * g + 2] as b, w[4 * g + 3] as c, w[4 * g + 4] as d
  from wq, lateral (select unnest(range(0, (len(w) + 3) // 4)) as g)),
wtok as (
  select chunk_id, unnest(t) as token, unnest(range(len(t))) as pos
  from (select chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from docs)),
occ as (
  select query_id, g, x.chunk_id, 1 as clause, x.pos as s, coalesce(y.pos, x.pos) as e
  from wg join wtok x on x.token = a left join wtok y on y.chunk_id = x.chunk_id and y.pos = x.pos + 1 and y.token = b
  where b is null or y.token is not null
  union all select query_id, g, chunk_id, 2, pos, pos from wg join wtok on token = c),
met as (
  select query_id, g, chunk_id from occ join wg using (query_id, g) group by 1, 2, 3
  having count(distinct clause) = max(case when c is null then 1 else 2 end)),
legal as (
  select * from met where (query_id, g, chunk_id) not in (select query_id, g, chunk_id from wg join wtok on token = d)),
ends as (
  select distinct query_id, g, chunk_id, e,
    least(max(s) filter (clause = 1) over w, case when c is null then 1e9 else max(s) filter (clause = 2) over w end) as low,
    max(s) filter (clause = 1) over w is not null and (c is null or max(s) filter (clause = 2) over w is not null) as full_,
    case when b is null then 1 else 2 end + case when c is null then 0 else 1 end as own
  from occ join legal using (query_id, g, chunk_id) join wg using (query_id, g)
  window w as (partition by query_id, g, chunk_id order by e range unbounded preceding)),
covers as (select query_id, g, chunk_id, low, min(e) as e, max(own) as own from ends where full_ group by 1, 2, 3, 4),
wscore as (
  select query_id, chunk_id, round(sum(0.1::double / (1 + greatest(e - low + 1 - own, 0))), 9) as score from covers group by 1, 2),
lt as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from wscore qualify rank <= {k})"""


@query(
    "r06_web_clauses",
    "with " + _WEB_LISTS.split(",\nwtok as")[0].strip() + """
select query_id, g::int as grp, 'false:' || a || coalesce(' ' || b, '') as clause from wg
union all select query_id, g::int, 'false:' || c from wg where c is not null
union all select query_id, g::int, 'true:' || d from wg where d is not null""",
    wq=WEB,
)
def _(wq):
    said = F.concat(F.col("negated").cast("string"), F.lit(":"), F.array_join("tokens", " "))
    return web.web_clauses(wq).select("query_id", "grp", said.alias("clause"))


@query("r07_web_topk", "with " + _k(_WEB_LISTS, 10) + " select query_id, chunk_id, round(score, 6) as score, rank from lt", docs=DOCS, wq=WEB)
def _(docs, wq):
    return web.web_topk(wq, docs, 10).withColumn("score", F.round("score", 6))


_FUSE = (
    "f as (select coalesce(vt.query_id, lt.query_id) as query_id, coalesce(vt.chunk_id, lt.chunk_id) as chunk_id, vt.rank "
    "as vector_rank, lt.rank as lexical_rank, round(coalesce(1.0 / (60 + vt.rank), 0) + coalesce(1.0 / (60 + lt.rank), 0), "
    "12) as score from vt full join lt on vt.query_id = lt.query_id and vt.chunk_id = lt.chunk_id), ft as (select *, "
    "row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= 8)"
)
#: Each item's query vector is the vector with its id.
IQ = "select vec_id as query_id, embedding as vector from {embeddings} join {benchmark} on vec_id = item_id"
_HYBRID = "with " + _k(_VTOP, 50) + ", " + _k(_LTOP, 50) + ", " + _FUSE
_WEB_HYBRID = "with " + _k(_VTOP, 50) + ", " + _k(_WEB_LISTS, 50) + ", " + _FUSE


@query("r09_rrf", _HYBRID + " select query_id, chunk_id, vector_rank, lexical_rank, round(score, 9) as score, rank from ft", docs=DOCS, q=QUERIES, vq=IQ, vec=VEC)
def _(docs, q, vq, vec):
    out = op.rrf(op.vector_topk(vq, vec, 50), op.lexical_topk(q, op.build_postings(docs, op.wanted_tokens(q), False), docs, 50), 8)
    return out.select("query_id", "chunk_id", "vector_rank", "lexical_rank", F.round("score", 9).alias("score"), "rank")


@query("r10_search", _WEB_HYBRID + " select query_id, chunk_id, rank from ft", docs=DOCS, wq=WEB, vq=IQ, vec=VEC)
def _(docs, wq, vq, vec):
    return web.web_search(wq.join(vq, "query_id"), vec, docs).select("query_id", "chunk_id", "rank")


_METHOD = """
select query_id, chunk_id, rank, round(score, 9) as score,
  case when lexical_rank is null then 'VECTOR_RRF' when vector_rank is null then 'LEXICAL_RRF' else 'VECTOR+LEXICAL_RRF' end as method
from ft"""


@query("flagship_hybrid_search", _WEB_HYBRID + _METHOD, docs=DOCS, wq=WEB, vq=IQ, vec=VEC)
def _(docs, wq, vq, vec):
    out = web.web_search(wq.join(vq, "query_id"), vec, docs)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "method")


RANKED_V = (
    "select l_orderkey as query_id, l_partkey as chunk_id, cast(row_number() over (partition by l_orderkey order by "
    "l_extendedprice desc, l_partkey, l_linenumber, l_suppkey) as int) as rank, l_extendedprice as score from (select "
    "l_orderkey, l_partkey, max(l_extendedprice) as l_extendedprice, max(l_linenumber) as l_linenumber, max(l_suppkey) as "
    "l_suppkey from {lineitem} where l_suppkey % 2 = 0 group by 1, 2) t"
)
RANKED_L = RANKED_V.replace("l_suppkey % 2 = 0", "l_suppkey % 3 = 0").replace("l_extendedprice desc", "l_extendedprice")


@query("r11_hybrid_with_fallback", """with f as (select coalesce(v.query_id, l.query_id) as query_id, coalesce(v.chunk_id, l.chunk_id) as chunk_id, round(coalesce(1.0 /
  (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 12) as score from v full join l on v.query_id = l.query_id and v.chunk_id = l.chunk_id),
ft as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= 3)
select ft.*, null::varchar as reason from ft join ch using (query_id) where lexical_ok union all
  select v.query_id, chunk_id, rank, 'LEXICAL_UNAVAILABLE' from v join ch using (query_id) where not coalesce(lexical_ok, false) and rank <= 3""", v=RANKED_V, l=RANKED_L, ch="select o_orderkey as query_id, case when o_orderkey % 7 = 0 then null else o_orderkey % 4 > 0 end as lexical_ok from "
    "{orders}")
def _(v, l, ch):  # noqa: E741
    return op.hybrid_with_fallback(v, l, ch, 3)


_RERANKED = """, texts as (
  select it.query_id, ft.chunk_id, it.text as query, docs.text as text from ft join it using (query_id) join docs using (chunk_id))
select query_id, chunk_id,
  len(list_intersect(string_split_regex(trim(lower(query)), '\\s+'), string_split_regex(trim(lower(text)), '\\s+')))::double as rerank_score
from texts"""


@query("r12_rerank", _WEB_HYBRID + _RERANKED, docs=DOCS, wq=WEB, it="select item_id as query_id, text from {benchmark}", vq=IQ, vec=VEC)
def _(docs, wq, it, vq, vec):
    """Each item against its own hits."""
    hits = web.web_search(wq.join(vq, "query_id"), vec, docs).select("query_id", "chunk_id")
    pairs = hits.join(it.select("query_id", F.col("text").alias("query")), "query_id").join(docs, "chunk_id")
    return op.rerank(pairs).select("query_id", "chunk_id", "rerank_score")


@query("r13_apply_rerank", """with n as (select query_id, count(*) as n from v group by 1), m as (select query_id, bool_or(chunk_id % 10 = 0) as bad from v group by 1)
select query_id, chunk_id, case when bad then rank else n + 1 - rank end as final_rank, case
  when bad then 'DEGRADED' end as reason from v join n using (query_id) join m using (query_id) where case
  when bad then rank else n + 1 - rank end <= 2""", v=RANKED_V)
def _(v):
    v = keep(v, "ranked")
    n = v.groupBy("query_id").agg(F.count("*").alias("n"))
    scores = v.join(n, "query_id").selectExpr("query_id", "chunk_id", "if(chunk_id % 10 = 0, cast('NaN' as double), score) as rerank_score", "cast(n + 1 - rank as int) as new_rank", "'m1' as model")
    return op.apply_rerank(v, scores, 2, "m1")


@query("r14_final_topk", "select query_id, chunk_id, row_number() over (partition by query_id order by rank, score desc, chunk_id) as place "
    "from v qualify place <= 2", v=RANKED_V.replace("cast(row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber, l_suppkey) as "
    "int)", "l_linenumber"))
def _(v):
    return op.final_topk(v, 2).select("query_id", "chunk_id", "place")


@query("r15_retry_expand", "select query_id, least(20, greatest(top_k + 1, top_k * 2)) as top_k from q where query_id not in (select query_id "
    "from v)", q="select o_orderkey as query_id, cast(o_orderkey % 15 as int) as top_k from {orders}", v=RANKED_V)
def _(q, v):
    return op.retry_expand(q, v)


@query("r16_abstain_reason", "select query_id, case when hits = 0 then 'NO_EVIDENCE' when not sufficient then 'INSUFFICIENT_EVIDENCE' when "
    "valid_citations = 0 then 'NO_VALID_CITATION' end as reason from rows_", rows_="select event_id as query_id, event_id % 4 as hits, event_id % 3 as valid_citations, event_type <> 'error' as "
    "sufficient from {events}")
def _(rows_):
    return op.abstain_reason(rows_).select("query_id", "reason")


_FOLDED = (("\u2018", "''"), ("\u2019", "''"), ("\u02bc", "''"), ("\u201c", '"'), ("\u201d", '"'), ("\u00ab", '"'), ("\u00bb", '"'), *((d, "-") for d in "\u2010\u2011\u2012\u2013\u2014\u2212"), ("\u2026", "..."))


def _folded(text: str) -> str:
    for a, b in _FOLDED:
        text = f"replace({text}, '{a}', '{b}')"
    return f"trim(regexp_replace({text}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


#: Planted: each kind of quote, dash and space; DuckDB has no NFKC, so the texts in front
#: are taken as the two engines agree on them (NFC).
@query("r17_normalise_quote", f"select doc_id, md5({_folded('lower(nfc_normalize(text))')}) as quote from d", d=(
    "select doc_id, concat(lang, ' \u2018a\u2019 \u201cb\u201d \u00abc\u00bb d\u2013e\u2014f\u2212g h\u2026', chr(160), "
        "'\u02bcX\u02bc ', source) as text from {documents}",
    "select doc_id, concat(lang, ' \u2018a\u2019 \u201cb\u201d \u00abc\u00bb d\u2013e\u2014f\u2212g h\u2026', chr(160), "
        "'\u02bcX\u02bc ', source) as text from {documents}"))
def _(d):
    return d.select("doc_id", F.md5(op.normalise_quote(F.col("text"))).alias("quote"))


@query("r17_normalise_documents", d="select doc_id, text from {documents}")
def _(d):
    return d.select("doc_id", F.md5(op.normalise_quote(F.col("text"))).alias("quote"))


CITES = (
    "select doc_id as citation_id, doc_id % 40 as query_id, case when doc_id % 5 = 0 then doc_id + 1 else doc_id end as "
    "chunk_id, doc_id % 7 as version_id, case when doc_id % 11 = 0 then ' ' when doc_id % 3 = 0 then concat(substr(text, "
    "1, 40), 'zq') else substr(text, 1, 60) end as quote from {documents}"
)
CHITS = (
    "select doc_id % 40 as query_id, doc_id as chunk_id, case when doc_id % 13 = 0 then -1 else doc_id % 7 end as "
    "version_id, text, doc_id % 2 = 0 as stale from {documents}"
)
_CITE = (
    "with j as (select c.*, h.version_id as hv, h.stale, trim(regexp_replace(lower(nfc_normalize(quote)), '\\s+', ' ', "
    "'g')) as nq, trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) as nt from c left join h on "
    "c.query_id = h.query_id and c.chunk_id = h.chunk_id), p as (select *, case when hv is null then 'NOT_RETRIEVED' when "
    "hv <> version_id then 'VERSION' when nq = '' then 'EMPTY_QUOTE' when not contains(nt, nq) then 'QUOTE_NOT_FOUND' end "
    "as problem from j)"
)


@query("r18_validate_citations", _CITE + " select citation_id, query_id, problem, problem is null as valid, problem is null and coalesce(stale, false) as "
    "stale_warning from p", c=CITES, h=CHITS)
def _(c, h):
    return op.validate_citations(c, h)


#: Every 11th order's citations name no assertion, every 13th query has no assertion.
_ASSERTED = "select o_custkey as query_id, o_orderkey as assertion_id from {orders} where o_custkey % 13 > 0"
_CITED = (
    "select o_custkey as query_id, case when o_orderkey % 11 = 0 then null else o_orderkey end as assertion_id, o_orderkey "
        "% 50 > 0 as valid"
    " from {orders} where o_orderkey % 6 > 0 or o_custkey % 2 = 0"
)


@query(
    "r19_citation_coverage",
    """with good as (select distinct query_id, assertion_id from ci where valid),
s as (select query_id, count(good.assertion_id) / count(*) as coverage from a left join good using (query_id, assertion_id) group by 1),
t as (select query_id, bool_or(not valid) as bad, bool_or(valid) as any_ok from ci group by 1),
j as (
  select query_id, coalesce(coverage, 1.0) as coverage, coalesce(bad, false) as bad, coalesce(any_ok, false) as any_ok from s full
  join t using (query_id))
select query_id, round(coverage, 6) as coverage,
  case when coverage >= 0.8 and bad or coverage < 0.8 and not any_ok then 'INVALID_CITATION'
  when coverage < 0.8 then 'INSUFFICIENT_COVERAGE' else 'VALID' end as status
from j""",
    a=_ASSERTED,
    ci=_CITED,
)
def _(a, ci):
    return op.citation_coverage(a, ci).withColumn("coverage", F.round("coverage", 6))


@query("r20_split_assertions", "with p as (select doc_id, string_split(regexp_replace(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), "
    "'\\n+', chr(1), 'g'), chr(1)) as parts from d), t as (select doc_id, list_filter(list_transform(parts, lambda x: "
    "trim(x)), lambda x: x <> '') as parts from p) select doc_id, count(*) as n, md5(string_agg(assertion, '|' order by "
    "place)) as h from (select doc_id, unnest(parts) as assertion, unnest(range(len(parts))) as place from t) group by 1", d="select doc_id, text as answer from {documents}")
def _(d):
    split = op.split_assertions(d)
    return split.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "assertion"))), lambda x: x["assertion"]), "|")).alias("h"))


@query("r21_verify_drafts", "select doc_id as draft_id, case when doc_id % 25 = 24 then case when doc_id % 2 = 0 and doc_id % 4 = 2 then 'ACCEPT' "
    "else 'REJECT' end when doc_id % 4 = 2 or doc_id % 3 = 0 or doc_id % 4 = 1 then 'RETRY' else 'ACCEPT' end as verdict "
    "from d", d="select doc_id, text from {documents}")
def _(d):
    drafts = d.selectExpr("doc_id as draft_id", "doc_id as query_id", "concat('in all ', doc_id) as answer", "case when doc_id % 4 = 2 then cast(array() as array<bigint>) when doc_id % 3 = 0 then array(doc_id, doc_id) else "
        "array(doc_id) end as chunk_ids", "case when doc_id % 4 = 2 then cast(array() as array<string>) when doc_id % 3 = 0 then array(substring(text, 1, 9), "
        "substring(text, 1, 9)) else array(if(doc_id % 4 = 1, concat(text, '@@'), substring(text, 1, 60))) end as quotes", "if(doc_id % 2 = 0, array('', cast(doc_id as string)), array('none')) as aggregates")
    return op.verify_drafts(drafts, d.where("doc_id % 25 <> 24").selectExpr("doc_id as query_id", "doc_id as chunk_id", "text"))


@query("r22_normalise_query", "select conv_id, turn, trim(regexp_replace(lower(regexp_replace(nfc_normalize(text), '[\\p{P}\\p{S}]', ' ', 'g')), "
    "'\\s+', ' ', 'g')) as query from t", t="select conv_id, turn, text from {conversations} where role = 'user'")
def _(t):
    return t.select("conv_id", "turn", op.normalise_query(F.col("text")).alias("query"))


LOG = ("select event_id, user_id, event_type, user_id % 7 as top_k, array(event_type, 'b', 'a') as filters, ts as at, user_id "
    "% 5 as model from {events}", "select event_id, user_id, event_type, user_id % 7 as top_k, ts as at, user_id % 5 as model from {events}")
_KEY = "sha256(concat('user_id=', user_id, chr(10), 'top_k=', top_k, chr(10), 'filters=a|b|', event_type))"


@query("r23_request_key", f"select event_id, {_KEY} as key from log", log=LOG)
def _(log):
    return op.request_key(log, ("user_id", "top_k"), ("filters",)).select("event_id", "key")


@query("r24_cache_report", f"with k as (select model, row_number() over (partition by model, {_KEY} order by \"at\") > 1 as hit from log) select model, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, round(count(*) filter (hit) / count(*), 6) as ratio from k group by 1", log=LOG)
def _(log):
    return op.cache_report(op.request_key(log, ("user_id", "top_k"), ("filters",))).withColumn("ratio", F.round("ratio", 6))


#: Planted questions with the class that the rules give them, said once for each turn.
_ASKED = (
    ("What is the hospital policy", "POLICY"), ("Treatment of FEVER", "CLINICAL"), ("how many rows", "STRUCTURED"), ("count patients with pain", "STRUCTURED"),
    ("count policies by ward", "MIXED"), ("policy on dosage", "MIXED"), ("tell me a joke", "OUT_OF_SCOPE"), ("thanks, what dose", "MIXED"), ("summary of accounts", "MIXED"),
    ("undiagnosed cases", "CLINICAL"), ("this is history", "MIXED"), ("hi table", "STRUCTURED"), (" ", "MIXED"), ("drug label", "MIXED"), ("group by ward", "STRUCTURED"),
    ("a standard of care", "POLICY"),
)
_SAID = "case (conv_id + turn) % 16 " + " ".join(f"when {i} then '{q}'" for i, (q, _) in enumerate(_ASKED)) + " end"
_CLASS = "case (conv_id + turn) % 16 " + " ".join(f"when {i} then '{k}'" for i, (_, k) in enumerate(_ASKED)) + " end"


@query("r25_classify_queries", f"select conv_id, turn, {_CLASS} as query_class from t", t=f"select conv_id, turn, {_SAID} as question from {{conversations}}")
def _(t):
    return op.classify_queries(t).select("conv_id", "turn", "query_class")


#: Four words of the texts' languages as signals: whole texts of all turns.
_SIGN = "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])(und|of)($|[^\\p{L}\\p{N}])')"


@query(
    "r25_classify_conversations",
    f"""with w as (
  select conv_id, turn, {_SIGN} as s, {_SIGN.replace('und|of', 'la|the')} as p, {_SIGN.replace('und|of', 'de|in')} as c,
    {_SIGN.replace('und|of', 'with|que')} as o from t)
select conv_id, turn, case when o and not (s or p or c) then 'OUT_OF_SCOPE' when s and not p then 'STRUCTURED'
  when s::int + p::int + c::int <> 1 or o then 'MIXED' when p then 'POLICY' else 'CLINICAL' end as query_class from w""",
    t="select conv_id, turn, text from {conversations}",
)
def _(t):
    words = {"STRUCTURED": ("und", "of"), "POLICY": ("la", "the"), "CLINICAL": ("de", "in"), "OUT_OF_SCOPE": ("with", "que")}
    return op.classify_queries(t.withColumnRenamed("text", "question"), words).select("conv_id", "turn", "query_class")


@query("r26_recent_turns", "with c as (select conv_id, turn, row_number() over w as n, sum(length(text)) over (w rows unbounded preceding) as c "
    "from t window w as (partition by conv_id order by turn desc)) select conv_id, turn from c where n <= 3 and c <= 600", t="select conv_id, turn, min(text) as text from {conversations} group by 1, 2")
def _(t):
    return op.recent_turns(t, 3, 600).select("conv_id", "turn")
