"""Search over a table of queries and a table of chunks: vectors, words, fusion,
reranking, citations, query handling."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signals
from .tables import keep, sliced

#: Queries whose vectors are sent to every task at once; more go in several passes.
QUERY_BLOCK = 4096
#: Vectors that a task scores at a time against a block of queries.
VECTOR_SLICE = 256


def normalise_queries(df: DataFrame, default_k: int = 8, most_k: int = 20, default_candidates: int = 50, most_candidates: int = 100) -> DataFrame:
    """Trimmed query, required; top_k from 1 to 20; candidates from top_k to 100."""
    k = F.greatest(F.lit(1), F.least(F.lit(most_k), F.coalesce("top_k", F.lit(default_k))))
    out = df.withColumn("query", F.trim("query")).where("query <> ''").withColumn("top_k", k)
    return out.withColumn("candidates", F.least(F.lit(most_candidates), F.greatest(F.coalesce("candidates", F.lit(default_candidates)), "top_k")))


def eligible_chunks(chunks: DataFrame, versions: DataFrame, documents: DataFrame, strategy: str, superseded: bool = False) -> DataFrame:
    """Clean chunks of a strategy whose version is ACTIVE (or SUPERSEDED, if asked)."""
    live = versions.where(F.col("status").isin(*(("ACTIVE", "SUPERSEDED") if superseded else ("ACTIVE",))))
    return chunks.where((F.col("phi_scan_status") == "CLEAN") & (F.col("strategy") == strategy)).join(live, "version_id").join(documents, "document_id")


def apply_filters(df: DataFrame, doc_types: list[str] | None = None, publishers: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, section_types: list[str] | None = None) -> DataFrame:
    """Optional filters; those not given let all rows pass."""
    if doc_types:
        df = df.where(F.col("doc_type").isin(doc_types))
    if publishers:
        df = df.where(F.col("publisher").isin(publishers))
    if date_from:
        df = df.where(F.col("effective_date") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.col("effective_date") <= F.lit(date_to).cast("date"))
    if section_types:
        df = df.where(F.col("metadata")["section_type"].isin(section_types))
    return df


def _ranked(df: DataFrame, k, order: list[Column], by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries (query_id, vector), vectors (chunk_id, embedding) -> (query_id, chunk_id,
    score, rank): exact cosine top k, ties by chunk id. Queries go to the tasks in
    blocks of QUERY_BLOCK; VECTOR_SLICE vectors at a time are one matrix product, of which each
    task keeps k rows per query, so what is shuffled is bounded by tasks * queries * k."""
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector is not null")
    # block ends by approximate quantiles: only one block's vectors are on the driver at a time
    n = asked.count()
    shares = [i * QUERY_BLOCK / n for i in range(1, -(-n // QUERY_BLOCK))]
    ends = asked.agg(F.percentile_approx("query_id", shares, 10_000)).first()[0] if shares else []
    bounds, several = [None, *sorted(set(ends)), None], len(shares) > 0
    schema = "query_id long, chunk_id long, score double"
    source = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").where("embedding is not null")
    out = None
    for low, high in zip(bounds, bounds[1:]):
        own = asked if low is None else asked.where(F.col("query_id") > low)
        block = (own if high is None else own.where(F.col("query_id") <= high)).collect()
        shared = spark.sparkContext.broadcast(([r.query_id for r in block], np.array([r.vector for r in block], np.float64)))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            if not len(ids):
                return
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
            best: tuple[np.ndarray, np.ndarray] | None = None
            slices = (b.slice(at, VECTOR_SLICE) for b in batches for at in range(0, b.num_rows, VECTOR_SLICE))
            for batch in slices:
                column = batch.column("embedding")
                chunk = batch.column("chunk_id").to_numpy()
                x = np.asarray(column.flatten(), np.float64).reshape(len(chunk), -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                s, c = matrix @ x.T, np.broadcast_to(chunk, (len(ids), len(chunk)))
                if best is not None:
                    s, c = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], c], axis=1)
                order = np.lexsort((c, -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)
            if best is not None:
                n = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["query_id", "chunk_id", "score"])

        part = source.mapInArrow(score, schema)
        if several:  # a block's best are written before the next block comes to the driver
            part = keep(_ranked(part, k, [F.col("score").desc(), F.col("chunk_id")]).drop("rank"), "block")
            shared.destroy()
        out = part if out is None else out.union(part)
    return _ranked(out, k, [F.col("score").desc(), F.col("chunk_id")])


_TOKENS = r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)"


def build_postings(chunks: DataFrame, wanted: DataFrame | None = None, positions: bool = True) -> DataFrame:
    """(token, chunk_id, tf, positions): lower-cased runs of letters and digits; of the
    tokens of wanted only, if given, which leaves the others before any shuffle."""
    tokens = chunks.select("chunk_id", F.posexplode(F.expr(_TOKENS)).alias("position", "token"))
    if wanted is not None:
        tokens = tokens.join(wanted.select("token").distinct(), "token", "left_semi")
    more = [F.array_sort(F.collect_list("position")).alias("positions")] if positions else []
    return tokens.groupBy("token", "chunk_id").agg(F.count("*").alias("tf"), *more)


def wanted_tokens(queries: DataFrame) -> DataFrame:
    """Tokens of the queries' terms."""
    return queries.select(F.explode("terms").alias("token")).distinct()


def parse_search(queries: DataFrame) -> DataFrame:
    """query in web style -> must, phrases, should (next to `or`), must_not arrays."""
    text = "lower(query)"
    bare = f"regexp_replace({text}, '\"[^\"]*\"', ' ')"
    words = f"filter(split(trim(regexp_replace({bare}, '\\\\s+', ' ')), ' '), w -> w <> '')"
    out = queries.withColumn("phrases", F.expr(f"transform(regexp_extract_all({text}, '\"([^\"]*)\"', 1), p -> trim(p))")).withColumn("_w", F.expr(words))
    near_or = "(i > 0 and _w[i - 1] = 'or') or (i + 1 < size(_w) and _w[i + 1] = 'or')"
    out = out.withColumn("must_not", F.expr("transform(filter(_w, w -> w like '-_%'), w -> substring(w, 2))"))
    out = out.withColumn("should", F.expr(f"filter(_w, (w, i) -> w <> 'or' and w not like '-%' and ({near_or}))"))
    return out.withColumn("must", F.expr(f"filter(_w, (w, i) -> w <> 'or' and w not like '-%' and not ({near_or}))")).drop("_w")


def lexical_topk(queries: DataFrame, postings: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """queries (query_id, terms): chunks with all terms, by a tf-idf score (idf from the
    postings, tf damped), ties by chunk id. Frequent terms are met last: the rarest
    term of each query selects the chunks, the others are looked up in those."""
    total = chunks.agg(F.count("*").alias("n_chunks"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("token"), F.size(F.array_distinct("terms")).alias("n_terms"))
    df = postings.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    # a query with a term that is nowhere has no hit; the rarest term selects the chunks
    scored = wanted.join(df, "token", "left")
    rarest = scored.groupBy("query_id").agg(F.min(F.struct("df", "token")).alias("r"), F.count("df").alias("known"), F.first("n_terms").alias("n")).where("known = n")
    first = rarest.select("query_id", F.col("r.token").alias("token")).join(postings, "token").select("query_id", "chunk_id")
    hits = first.join(scored, "query_id").join(postings.select("token", "chunk_id", "tf"), ["token", "chunk_id"]).join(F.broadcast(total))
    weight = F.ln(1 + F.col("n_chunks") / F.col("df")) * F.col("tf") / (F.col("tf") + 1)
    ranked = hits.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"), F.count("*").alias("met"), F.first("n_terms").alias("n_terms")).where("met = n_terms")
    return _ranked(ranked.select("query_id", "chunk_id", F.round("score", 9).alias("score")), k, [F.col("score").desc(), F.col("chunk_id")])


def cover_density(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Score of chunks with all terms by their shortest windows: each minimal window
    that holds all terms adds 1 / its length. One group is one query and chunk.

    The rarest term of a query selects the chunks; the terms from there on, a few at a time by their
    rarity, leave those that hold them all. Positions are looked up only for what is left."""
    postings = keep(postings, "postings")
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("token"))
    often = postings.groupBy("token").agg(F.count("*").alias("df"))
    # a query with a term that is nowhere has no chunk
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")))
    asked = terms.join(often, "token", "left").groupBy("query_id").agg(ordered.alias("o")).where("o[0].df > 0")
    asked = keep(asked.select("query_id", F.expr("transform(o, x -> x.token)").alias("tokens")), "asked")
    held = postings.select("token", "chunk_id", F.lit(1).alias("held"))
    found = asked.select("query_id", F.col("tokens")[0].alias("token")).join(held, "token").select("query_id", "chunk_id")
    for first, n in ((1, 2), (3, 4), (7, 8)):
        few = asked.select("query_id", F.size(F.slice("tokens", first + 1, n)).alias("n"), F.explode_outer(F.slice("tokens", first + 1, n)).alias("token"))
        met = found.join(few, "query_id").join(held, ["token", "chunk_id"], "left").groupBy("query_id", "chunk_id").agg(F.count("held").alias("met"), F.first("n").alias("n"))
        found = met.where("met = n").select("query_id", "chunk_id")
    each = found.join(asked.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "query_id")
    hits = each.join(postings.select("token", "chunk_id", "positions"), ["token", "chunk_id"])
    full = hits.groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("token", "positions")).alias("found"), F.first("n").alias("n")).where("size(found) = n")

    @F.pandas_udf("double")
    def density(found: pd.Series) -> pd.Series:
        def one(terms) -> float:
            places = sorted((int(p), i) for i, t in enumerate(terms) for p in t["positions"])
            last, score, start = {}, 0.0, -1
            for place, i in places:
                last[i] = place
                if len(last) == len(terms) and (low := min(last.values())) > start:
                    score += 1.0 / (place - low + 1)
                    start = low
            return score

        return found.map(one)

    return full.select("query_id", "chunk_id", density("found").alias("score"))


def rrf(vector: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60, wv: float = 1.0, wl: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists, both ranks and scores kept; ties by
    chunk id."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    x = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    both = v.join(x, ["query_id", "chunk_id"], "full_outer")
    part = lambda rank, w: F.coalesce(F.lit(w) / (rrf_k + F.col(rank)), F.lit(0.0))
    out = both.withColumn("score", F.round(part("vector_rank", wv) + part("lexical_rank", wl), 12))
    method = F.when(F.col("lexical_rank").isNull(), "VECTOR_RRF").when(F.col("vector_rank").isNull(), "LEXICAL_RRF").otherwise("VECTOR+LEXICAL_RRF")
    return _ranked(out.withColumn("method", method), k, [F.col("score").desc(), F.col("chunk_id")])


def search(queries: DataFrame, vectors: DataFrame, postings: DataFrame, chunks: DataFrame, mode: str = "HYBRID", k: int = 8, candidates: int = 50) -> DataFrame:
    """queries (query_id, vector, terms). VECTOR_ONLY, LEXICAL_ONLY or HYBRID."""
    n = max(k, candidates)
    if mode == "VECTOR_ONLY":
        return vector_topk(queries, vectors, k)
    if mode == "LEXICAL_ONLY":
        return lexical_topk(queries, postings, chunks, k)
    return rrf(vector_topk(queries, vectors, n), lexical_topk(queries, postings, chunks, n), k)


def hybrid_with_fallback(vector: DataFrame, lexical: DataFrame, channels: DataFrame, k: int) -> DataFrame:
    """channels (query_id, lexical_ok): where the lexical branch failed, vector results
    and a reason code; else the fusion."""
    fused = rrf(vector, lexical, k).select("query_id", "chunk_id", "rank")
    ok = channels.where("lexical_ok").select("query_id")
    down = channels.where("not coalesce(lexical_ok, false)").select("query_id")
    a = fused.join(ok, "query_id").withColumn("reason", F.lit(None).cast("string"))
    b = vector.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank").join(down, "query_id").withColumn("reason", F.lit("LEXICAL_UNAVAILABLE"))
    return a.union(b)


def rerank(hits: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """hits (query_id, chunk_id, query, text) with rerank_score: the number of shared
    lower-cased words, or a supplied scorer over batches."""
    if scorer is None:
        split = lambda c: F.split(F.trim(F.lower(c)), r"\s+")
        return hits.withColumn("rerank_score", F.size(F.array_intersect(split("query"), split("text"))).cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(rerank_score=scorer(frame).astype(float))

    return hits.mapInPandas(run, hits.withColumn("rerank_score", F.lit(0.0)).schema)


def apply_rerank(hits: DataFrame, scores: DataFrame, k: int, model: str) -> DataFrame:
    """hits (query_id, chunk_id, rank), scores (query_id, chunk_id, rerank_score,
    new_rank, model): a reply that is not exactly the candidates, once each, with
    finite scores, ranks 1..n and the model's name leaves the order and says DEGRADED.
    Scores are written, as two joins read them; a query's distinct ids and ranks are sets, since
    counting them would put each row three times into one task's groups."""
    hits = hits.select("query_id", "chunk_id", "rank")
    scores = keep(scores.select("query_id", "chunk_id", "rerank_score", "new_rank", "model"), "scores")
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    s = scores.join(n, "query_id", "left").join(hits.select("query_id", "chunk_id", F.lit(1).alias("asked")), ["query_id", "chunk_id"], "left")
    bad = F.col("asked").isNull() | F.col("rerank_score").isNull() | F.isnan("rerank_score") | ~F.col("new_rank").between(1, F.col("n")) | (F.col("model") != model)
    per = s.groupBy("query_id").agg(F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad"), F.count("*").alias("got"), F.size(F.collect_set("chunk_id")).alias("ids"), F.size(F.collect_set("new_rank")).alias("ranks"))
    ok = n.join(per, "query_id", "left").select("query_id", F.coalesce(~F.col("bad") & (F.col("got") == F.col("n")) & (F.col("ids") == F.col("n")) & (F.col("ranks") == F.col("n")), F.lit(False)).alias("ok"))
    first = scores.groupBy("query_id", "chunk_id").agg(F.min("new_rank").alias("new_rank"))
    out = hits.join(ok, "query_id").join(first, ["query_id", "chunk_id"], "left")
    final = F.when(F.col("ok"), F.col("new_rank")).otherwise(F.col("rank"))
    return out.withColumn("final_rank", final).where(F.col("final_rank") <= k).select("query_id", "chunk_id", "final_rank", F.when(~F.col("ok"), "DEGRADED").alias("reason"))


def final_topk(df: DataFrame, k: int) -> DataFrame:
    """First k per query by rank, then score, then id."""
    return _ranked(df, k, [F.col("rank"), F.col("score").desc(), F.col("chunk_id")], name="place")


def retry_expand(queries: DataFrame, results: DataFrame, most: int = 20) -> DataFrame:
    """Queries without a hit, with a larger top_k for a second pass."""
    again = queries.join(results.select("query_id").distinct(), "query_id", "left_anti")
    return again.withColumn("top_k", F.least(F.lit(most), F.greatest(F.col("top_k") + 1, F.col("top_k") * 2)))


def abstain_reason(df: DataFrame) -> DataFrame:
    """df (query_id, hits, valid_citations, sufficient): why there is no answer."""
    return df.withColumn("reason", F.when(F.col("hits") == 0, "NO_EVIDENCE").when(~F.col("sufficient"), "INSUFFICIENT_EVIDENCE").when(F.col("valid_citations") == 0, "NO_VALID_CITATION"))


def nfkc(column: Column) -> Column:
    """NFKC form; made when called, as a UDF needs a session."""

    @sliced("string")
    def form(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return form(column)


#: Quotes and dashes that count as one.
_QUOTES = {"\u2018\u2019\u02bc": "'", "\u201c\u201d\u00ab\u00bb": '"', "\u2010\u2011\u2012\u2013\u2014\u2212": "-"}


def normalise_quote(column: Column) -> Column:
    """NFKC, lower case, one kind of spaces, quotes, dashes and ellipsis."""
    out = F.translate(F.lower(nfkc(column)), "".join(_QUOTES), "".join(v * len(k) for k, v in _QUOTES.items()))
    return F.trim(F.regexp_replace(F.replace(out, F.lit("\u2026"), F.lit("...")), r"[\s\p{Z}]+", " "))


def validate_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """citations (citation_id, query_id, chunk_id, version_id, quote), hits (query_id,
    chunk_id, version_id, text, stale): the first failing check and a freshness note."""
    h = hits.select("query_id", "chunk_id", F.col("version_id").alias("_v"), F.col("text").alias("_t"), "stale")
    joined = citations.join(h, ["query_id", "chunk_id"], "left").withColumn("_q", normalise_quote(F.col("quote"))).withColumn("_n", normalise_quote(F.col("_t")))
    problem = F.when(F.col("_v").isNull(), "NOT_RETRIEVED").when(F.col("_v") != F.col("version_id"), "VERSION").when(F.coalesce("_q", F.lit("")) == "", "EMPTY_QUOTE").when(~F.col("_n").contains(F.col("_q")), "QUOTE_NOT_FOUND")
    return joined.select("citation_id", "query_id", problem.alias("problem"), problem.isNull().alias("valid"), (F.coalesce("stale", F.lit(False)) & problem.isNull()).alias("stale_warning"))


def citation_coverage(assertions: DataFrame, citations: DataFrame, least: float = 0.8) -> DataFrame:
    """assertions (query_id, assertion_id), citations (query_id, assertion_id, valid):
    share of assertions with a valid citation, for all queries of either table; 1 without
    assertions. With enough of them any bad citation of the query gives INVALID_CITATION,
    else VALID; with too few INVALID_CITATION if no citation is valid, else
    INSUFFICIENT_COVERAGE. A citation that names no assertion of its query covers none,
    but its being good or bad counts; a null validity is bad."""
    valid = F.coalesce("valid", F.lit(False))
    covered = citations.where(valid).select("query_id", "assertion_id").distinct().withColumn("ok", F.lit(True))
    shares = assertions.select("query_id", "assertion_id").distinct().join(covered, ["query_id", "assertion_id"], "left")
    shares = shares.groupBy("query_id").agg((F.count_if(F.coalesce("ok", F.lit(False))) / F.count("*")).alias("coverage"))
    told = citations.groupBy("query_id").agg(F.bool_or(~valid).alias("bad"), F.bool_or(valid).alias("any"))
    both = shares.join(told, "query_id", "full_outer").fillna({"coverage": 1.0, "bad": False, "any": False})
    status = F.when(F.col("coverage") >= least, F.when(F.col("bad"), "INVALID_CITATION").otherwise("VALID")).when(~F.col("any"), "INVALID_CITATION").otherwise("INSUFFICIENT_COVERAGE")
    return both.select("query_id", "coverage", status.alias("status"))


def split_assertions(df: DataFrame, column: str = "answer") -> DataFrame:
    """One row per assertion: the answer cut behind sentence ends and at line breaks."""
    # given F.trim itself, transform would pass each part's place as the characters to trim
    parts = F.filter(F.transform(F.split(column, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*(c for c in df.columns if c != column), F.posexplode(parts).alias("place", "assertion"))


#: What drafts and evidence are compared by, besides full-width forms.
_DRAFT = {"\u2018\u2019\u201a\u201b": "'", "\u201c\u201d\u201e\u201f": '"', "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63": "-"}


def draft_text(column: Column) -> Column:
    """Lower case with one kind of quotes, dashes, widths and spaces; native throughout."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    folded = F.translate(column, "".join(_DRAFT) + wide, "".join(v * len(k) for k, v in _DRAFT.items()) + plain)
    return F.lower(F.trim(F.regexp_replace(F.replace(folded, F.lit("\u2026"), F.lit("...")), r"[\s\p{Z}]+", " ")))


def verify_drafts(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """drafts (draft_id, query_id, answer, chunk_ids, quotes, aggregates), evidence
    (query_id, chunk_id, text). Without evidence a citation is REJECTed, and the answer is
    accepted only if it holds one of the aggregate values; with evidence the draft is
    tried again (RETRY) if it cites nothing, a chunk twice, or words that are not there."""
    texts = evidence.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", draft_text(F.col("text")).alias("t")))).alias("known"))
    d = drafts.join(texts, "query_id", "left").withColumn("known", F.coalesce("known", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>"))))
    d = d.withColumn("quotes", F.transform("quotes", lambda q: draft_text(q)))
    repeated = F.size(F.array_distinct("chunk_ids")) < F.size("chunk_ids")
    loose = F.exists(F.arrays_zip("chunk_ids", "quotes"), lambda x: F.coalesce(~F.col("known")[x["chunk_ids"]].contains(x["quotes"]) | (x["quotes"] == ""), F.lit(True)))
    told = F.exists("aggregates", lambda v: (F.trim(v) != "") & F.col("answer").contains(v))
    alone = F.when((F.size("chunk_ids") == 0) & F.coalesce(told, F.lit(False)), "ACCEPT").otherwise("REJECT")
    verdict = F.when(F.size("known") == 0, alone).when((F.size("chunk_ids") == 0) | repeated | loose, "RETRY").otherwise("ACCEPT")
    return d.select("draft_id", verdict.alias("verdict"))


def normalise_query(column: Column) -> Column:
    """NFKC, punctuation and symbols to spaces, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(nfkc(column), r"[\p{P}\p{S}]", " ")), r"\s+", " "))


def request_key(df: DataFrame, scalars: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """key: SHA-256 of name=value lines, lists sorted."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in scalars]
    parts += [F.concat(F.lit(f"{c}="), F.array_join(F.array_sort(c), "|")) for c in lists]
    return df.withColumn("key", F.sha2(F.concat_ws("\n", *parts), 256))


def cache_report(log: DataFrame) -> DataFrame:
    """log (key, at, model): the first use of a key is a miss; hits and ratio per model."""
    seen = log.withColumn("hit", F.row_number().over(Window.partitionBy("model", "key").orderBy("at")) > 1)
    return seen.groupBy("model").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("ratio", F.col("hits") / (F.col("hits") + F.col("misses")))


def has_signal(text: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-cased text holds one of the words: those of ASCII letters and digits
    alone with no letter or digit beside them, others anywhere."""
    single = [w for w in words if w.isascii() and w.isalnum()]
    tests = [text.contains(w) for w in words if w not in single]
    if single:
        tests.append(text.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(single) + r")(?![\p{L}\p{N}])"))
    return functools.reduce(lambda a, b: a | b, tests)


def classify_queries(df: DataFrame, words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """query_class of a question. Signs of no kind, of several, or of one beside one that
    is out of scope are MIXED; OUT_OF_SCOPE needs no other sign; structured words without
    policy ones are STRUCTURED whatever else there is. A null or blank question is MIXED.
    words replaces the lists of some kinds (OUT_OF_SCOPE, POLICY, CLINICAL, STRUCTURED)."""
    lists = {"OUT_OF_SCOPE": signals.OUT_OF_SCOPE, "POLICY": signals.POLICY, "CLINICAL": signals.CLINICAL, "STRUCTURED": signals.STRUCTURED} | (words or {})
    text = F.lower(F.trim(F.coalesce("question", F.lit(""))))
    out, policy, clinical, structured = (has_signal(text, lists[k]) for k in ("OUT_OF_SCOPE", "POLICY", "CLINICAL", "STRUCTURED"))
    for stem in signals.CLINICAL_STEMS if not words else ():
        clinical = clinical | text.contains(stem)
    kinds = sum((c.cast("int") for c in (policy, clinical, structured)), F.lit(0))
    found = (
        F.when(out & (kinds == 0), "OUT_OF_SCOPE").when(structured & ~policy, "STRUCTURED").when((kinds != 1) | out, "MIXED")
        .when(policy, "POLICY").when(clinical, "CLINICAL").otherwise("MIXED")
    )
    return df.withColumn("query_class", found)


def recent_turns(df: DataFrame, n: int, chars: int) -> DataFrame:
    """The newest turns of each conversation, at most n and at most chars in total."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("_n") <= n) & (F.col("_c") <= chars)).drop("_n", "_c")
