"""Lexical search by queries in web style: words, "phrases", `or` and -not.

A query is a choice (`or`) of groups; a group asks for all its clauses and for none of
those with a dash. A clause is a run of words that must stand side by side; one word is a
run of one. Evaluation is set algebra over positional postings of units - a clause's one
word, or each two words side by side of a longer one: the rarest unit of a group selects the
chunks, the group's other units are looked up in those alone, positions of a run's units are
shifted by their place in it and intersected, and what is left decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import _TOKENS, _ranked, rrf, vector_topk
from .tables import SLICE, forget, keep

_ITEMS = r"""regexp_extract_all(translate(lower(query), '\u0001', ' '), '-?"[^"]*"|[^\\s"]+', 0)"""


def web_clauses(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) -> (query_id, grp, clause, negated, tokens).

    Words and phrases are lower-cased runs of letters and digits; a word of several runs,
    as with a hyphen, is a phrase. A lone `or` between groups counts once however often it
    is repeated; in quotes it is a word. A quote without its partner is passed over.
    Clauses that repeat in a group count once.
    """
    marked = F.expr(rf"concat('\u0001', array_join({_ITEMS}, '\u0001'), '\u0001')")
    groups = queries.select("query_id", F.posexplode(F.split(marked, "(?:\u0001or)+(?=\u0001)")).alias("grp", "g"))
    items = groups.select("query_id", "grp", F.posexplode(F.split("g", "\u0001")).alias("clause", "item"))
    tokens = F.expr(r"regexp_extract_all(item, '[\\p{L}\\p{N}]+', 0)")
    clauses = items.select("query_id", "grp", "clause", F.col("item").startswith("-").alias("negated"), tokens.alias("tokens")).where("size(tokens) > 0")
    return clauses.groupBy("query_id", "grp", "negated", "tokens").agg(F.min("clause").alias("clause")).select("query_id", "grp", "clause", "negated", "tokens")


def clause_units(clauses: DataFrame) -> DataFrame:
    """clauses of web_clauses -> (query_id, grp, clause, negated, width, n_units, j, word,
    next): a clause of one word is a unit, next being empty; of a longer one every two words
    side by side are, j words after its start."""
    pairs = F.expr("transform(slice(tokens, 1, greatest(size(tokens) - 1, 1)), (t, i) -> struct(t as word, coalesce(get(tokens, i + 1), '') as next))")
    rows = clauses.select("query_id", "grp", "clause", "negated", F.size("tokens").alias("width"), pairs.alias("pairs"))
    return rows.select("query_id", "grp", "clause", "negated", "width", F.size("pairs").alias("n_units"), F.posexplode("pairs").alias("j", "u")).select("*", "u.word", "u.next").drop("u")


def unit_postings(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """chunks (chunk_id, text), units (unit, word, next) -> (unit, chunk_id, positions).
    Texts are dealt by chunk, so their postings need not be dealt again; words that begin
    no unit are left before any other step. Positions are in no order."""
    firsts = units.groupBy("word").agg(F.bool_or(F.col("next") == "").alias("alone"), F.bool_or(F.col("next") != "").alias("leads"))
    tokens = chunks.repartition("chunk_id").select("chunk_id", F.expr(_TOKENS).alias("t"))
    each = tokens.select("chunk_id", F.posexplode(F.arrays_zip("t", F.expr("slice(t, 2, size(t))").alias("n"))).alias("position", "p"))
    each = each.select("chunk_id", "position", F.col("p.t").alias("word"), F.col("p.n").alias("after")).join(firsts, "word")
    nexts = F.when(~F.col("leads"), F.array(F.lit(""))).when(F.col("alone"), F.array(F.lit(""), "after")).otherwise(F.array("after"))
    met = each.select("chunk_id", "position", "word", F.explode(nexts).alias("next")).join(units, ["word", "next"])
    return met.groupBy("unit", "chunk_id").agg(F.collect_list("position").alias("positions"))


def web_seeds(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """asked: rows of clause_units with their unit, postings of unit_postings -> a row for
    each group that may have a chunk: its rarest unit, and all its units as parts. A group
    of nothing but -clauses selects no chunk: it would return the corpus."""
    often = postings.groupBy("unit").agg(F.count("*").alias("df"))
    wants = ~F.col("negated")
    groups = asked.join(often, "unit", "left").groupBy("query_id", "grp").agg(
        F.min(F.when(wants, F.struct("df", "unit"))).alias("r"), F.count_if(wants).alias("n_asked"), F.count_if(wants & F.col("df").isNull()).alias("missing"),
        F.count_if(wants & (F.col("j") == 0)).alias("n_clauses"),
        F.collect_list(F.when(F.col("df").isNotNull(), F.struct("clause", "negated", "width", "n_units", "j", "unit"))).alias("parts"),
    )
    # a group with a unit that is nowhere has no chunk
    return groups.where("n_asked > 0 and missing = 0").select("query_id", "grp", F.col("r.unit").alias("unit"), "n_asked", "n_clauses", "parts")


def web_matches(seeds: DataFrame, postings: DataFrame) -> DataFrame:
    """seeds of web_seeds, postings of unit_postings -> (query_id, grp, chunk_id, found):
    each group's chunks, with the width and the starts of each clause that it asks for, in
    no order."""
    wants = ~F.col("negated")
    chosen = seeds.join(postings.select("unit", "chunk_id"), "unit").drop("unit")
    each = chosen.select("query_id", "grp", "chunk_id", "n_asked", "n_clauses", F.inline("parts"))
    shifted = F.when(F.col("j") == 0, F.col("positions")).otherwise(F.transform("positions", lambda p: p - F.col("j")))
    met = each.join(postings, ["unit", "chunk_id"]).withColumn("starts", shifted).drop("positions", "unit", "j")
    held = met.repartition("query_id", "grp", "chunk_id").groupBy("query_id", "grp", "chunk_id", "n_asked", "n_clauses").agg(
        F.count_if(wants).alias("got"), F.count_if(~wants & (F.col("n_units") == 1)).alias("banned"), F.count_if(F.col("n_units") > 1).alias("parted"),
        F.collect_list(F.struct("clause", "negated", "width", "n_units", "starts")).alias("found"),
    )
    held = held.where("banned = 0 and got = n_asked")
    # the units of a clause must meet in a start
    common = "if(size(u) = u[0].n_units, aggregate(slice(u, 2, size(u)), u[0].starts, (x, f) -> array_intersect(x, f.starts)), slice(u[0].starts, 1, 0))"
    clause = f"transform(array(filter(found, f -> f.clause = c)), u -> struct(c as clause, u[0].negated as negated, u[0].width as width, u[0].n_units as n_units, {common} as starts))[0]"
    merged = f"filter(transform(array_distinct(transform(found, f -> f.clause)), c -> {clause}), f -> size(f.starts) > 0)"
    held = held.withColumn("found", F.expr(f"if(parted > 0, {merged}, found)"))
    return held.where("parted = 0 or (size(found) = n_clauses and not exists(found, f -> f.negated))").select("query_id", "grp", "chunk_id", "found")


def _covers(found: pa.ListArray) -> np.ndarray:
    """Score of each row of found, lists of clauses with width and starts, as cover_score says."""
    owner, clause = pc.list_parent_indices(found).to_numpy(), found.flatten()
    width, starts = (pc.struct_field(clause, name) for name in ("width", "starts"))
    width, of, start = width.to_numpy(), pc.list_parent_indices(starts).to_numpy(), starts.flatten().to_numpy().astype(np.int64)
    clauses, own = np.bincount(owner, minlength=len(found)), np.bincount(owner, width, len(found))
    place = np.arange(len(owner)) - (np.cumsum(clauses) - clauses)[owner]
    end, row, which = start + width[of] - 1, owner[of], place[of]
    order = np.lexsort((end, row))
    start, end, row, which = start[order], end[order], row[order], which[order]
    # the least of the clauses' last starts; -1 where a clause has none yet
    step = end.max(initial=0) + 2
    base, low = row * step, np.full(len(start), step)
    for i in range(clauses.max(initial=0)):
        some = np.flatnonzero(clauses[row] > i)
        last = np.maximum.accumulate(np.where(which[some] == i, base[some] + start[some] + 1, 0)) - base[some] - 1
        low[some] = np.minimum(low[some], np.maximum(last, -1))
    # occurrences that end together are one step
    ends = np.flatnonzero(np.diff(base + end, append=-1) != 0)
    row, end, low = row[ends], end[ends], low[ends]
    before = np.where(np.diff(row, prepend=-1) != 0, -1, np.roll(low, 1))
    gain = np.where(low > before, 0.1 / (1 + np.maximum(end - low + 1 - own[row], 0)), 0.0)
    return np.bincount(row, gain, len(found))


def cover_score(matches: DataFrame) -> DataFrame:
    """matches of web_matches -> (query_id, chunk_id, score) by cover density: each
    shortest stretch of text that holds all clauses of a group adds 0.1 / (1 + noise),
    noise being its words beyond the clauses' own; a query's groups add up.

    Occurrences are walked in the order of their ends, keeping the last start of each
    clause; a stretch begins at the least of those and counts when that has moved on.
    SLICE rows are walked at once.
    """
    schema = T.StructType([matches.schema["query_id"], matches.schema["chunk_id"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                few = batch.slice(at, SLICE)
                found = pa.array(_covers(few.column("found")))
                yield pa.RecordBatch.from_arrays([few.column("query_id"), few.column("chunk_id"), found], names=["query_id", "chunk_id", "score"])

    scored = matches.select("query_id", "chunk_id", "found").mapInArrow(score, schema)
    return scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))


def web_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """queries (query_id, query), chunks (chunk_id, text) -> (query_id, chunk_id, score,
    rank), ties by chunk id. Postings of the queries' words are written once, as the
    frequencies, the selection and the look-up all read them."""
    asked = keep(clause_units(web_clauses(queries)), "asked")
    units = keep(asked.select("word", "next").distinct().withColumn("unit", F.monotonically_increasing_id()), "units")
    postings = keep(unit_postings(chunks, units), "postings")
    seeds = keep(web_seeds(asked.join(units, ["word", "next"]), postings), "seeds")
    top = keep(_ranked(cover_score(web_matches(seeds, postings)), k, [F.col("score").desc(), F.col("chunk_id")]), "lexical")
    for table in (asked, units, postings, seeds):
        forget(table)
    return top


def web_search(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, mode: str = "HYBRID", k: int = 8, candidates: int = 50) -> DataFrame:
    """queries (query_id, vector, query), vectors (chunk_id, embedding), chunks (chunk_id,
    text). VECTOR_ONLY, LEXICAL_ONLY or HYBRID; each channel gives `candidates` chunks."""
    if mode == "VECTOR_ONLY":
        return vector_topk(queries, vectors, k)
    if mode == "LEXICAL_ONLY":
        return web_topk(queries, chunks, k)
    if mode != "HYBRID":
        raise ValueError(f"unknown mode {mode}")
    n = max(k, candidates)
    return rrf(vector_topk(queries, vectors, n), web_topk(queries, chunks, n), k)
