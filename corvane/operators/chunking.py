"""Tokens, paragraphs, sentences, chunks, context prefixes and their cost."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import sliced

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def token_count(column: str) -> Column:
    """Runs of letters and digits, and other visible characters one by one."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(TOKEN))


#: What \s of a pattern matches.
_BLANK = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """token_count of a text that is not null, without making its tokens: each run of letters
    and digits becomes one character, and white space none."""
    return F.length(F.translate(F.regexp_replace(text, r"[\p{L}\p{N}]++", "x"), _BLANK, ""))


def _spans(df: DataFrame, column: str, pattern: str, keep: list[str]) -> DataFrame:
    """Trimmed pieces between matches of pattern (place, text, start, stop), offsets in
    code points of the whole text; empty pieces are dropped."""
    piece = rf"(?s).+?(?=(?:{pattern})|\z)"
    pieces = F.expr(f"regexp_extract_all({column}, '{(piece + '|' + pattern).replace(chr(92), chr(92) * 2)}', 0)")
    out = df.select(*keep, F.posexplode(pieces).alias("place", "raw"))
    w = Window.partitionBy(*keep).orderBy("place")
    out = out.withColumn("stop", F.sum(F.length("raw")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    text = F.regexp_replace("raw", r"^\s+|\s+$", "")
    out = out.withColumn("text", text).withColumn("start", (F.col("stop") - F.length("raw") + lead)).where("text <> ''")
    return out.select(*keep, (F.row_number().over(w) - 1).alias("place"), "text", "start", (F.col("start") + F.length("text")).alias("stop"))


def paragraphs(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """Pieces between blank lines, trimmed, with offsets."""
    return _spans(df, column, r"\R[^\S\n]*\R\s*", list(keep))


def sentences(df: DataFrame, max_tokens: int, column: str = "text", keep: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """Pieces that end behind . ! ? and white space, with token counts; one over
    max_tokens has the status UNCHUNKABLE."""
    parts = F.filter(F.split(column, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    out = df.select(*keep, F.posexplode(parts).alias("place", "text")).withColumn("text", F.trim("text")).withColumn("tokens", token_count("text"))
    return out.withColumn("status", F.when(F.col("tokens") > max_tokens, "UNCHUNKABLE").otherwise("OK"))


def units(df: DataFrame, max_tokens: int, column: str = "text", keep: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """Paragraphs that fit, and the sentences of those that do not (place, part, text,
    tokens, status)."""
    p = paragraphs(df, column, keep).withColumn("tokens", token_count("text"))
    small = p.where(F.col("tokens") <= max_tokens).select(*keep, "place", F.lit(0).alias("part"), "text", "tokens", F.lit("OK").alias("status"))
    large = p.where(F.col("tokens") > max_tokens).select(*keep, F.col("place").alias("p"), "text")
    cut = sentences(large, max_tokens, "text", (*keep, "p")).select(*keep, F.col("p").alias("place"), F.col("place").alias("part"), "text", "tokens", "status")
    return small.union(cut)


def group_sizes(sizes: list[int], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [first, last) of units: extend while the sum stays within `most`, stop at
    `target`; the next range goes back over whole units of at most `overlap` tokens. Where
    these would be all units of the range, the next one starts behind it. A unit over
    `most` is a range of its own: callers tell such texts apart before."""
    out, first = [], 0
    while first < len(sizes):
        last, total = first, 0
        while last < len(sizes) and total < target and total + sizes[last] <= most:
            total += sizes[last]
            last += 1
        last = max(last, first + 1)
        out.append((first, last))
        back, seen = last, 0
        while last < len(sizes) and back > first and seen + sizes[back - 1] <= overlap:
            back -= 1
            seen += sizes[back]
        first = back if back > first else last
    return out


def semantic_sizes(sizes: list[int], alike: list[float], threshold: float, target: int, least: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [first, last) of sentences: a break where the sum would pass `most`, or where
    a sentence is less like the one before than threshold and the range has `least`
    tokens. A range then begins with whole sentences of the one before it, of at most
    `overlap` tokens, if both fit in `most`; one over `most` is split as by group_sizes."""
    if not sizes:
        return []
    starts, total = [0], sizes[0]
    for i in range(1, len(sizes)):
        if total + sizes[i] > most or (alike[i] < threshold and total >= least):
            starts.append(i)
            total = 0
        total += sizes[i]
    out = []
    for n, (first, last) in enumerate(zip(starts, [*starts[1:], len(sizes)], strict=True)):
        back, seen, own = first, 0, sum(sizes[first:last])
        while n and overlap and back > starts[n - 1] and seen + sizes[back - 1] <= overlap:
            back -= 1
            seen += sizes[back]
        back = back if own + seen <= most else first
        parts = [(0, last - back)] if sum(sizes[back:last]) <= most else group_sizes(sizes[back:last], target, most, overlap)
        out += [(back + a, back + b) for a, b in parts]
    return out


def _in_order(df: DataFrame, keep: list[str], fields: list[str], arrange, schema: str) -> DataFrame:
    """Rows that a Python function makes from each group's rows (as dicts, in order of
    the first fields). A group is one section or table, so it is small; whole batches
    of groups go to Python at once."""

    @sliced(f"array<struct<{schema}>>")
    def made(groups: pd.Series) -> pd.Series:
        return groups.map(lambda rows: arrange(list(rows)))

    grouped = df.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))
    return grouped.select(*keep, F.explode(made("_rows")).alias("_m")).select(*keep, "_m.*")


def group_units(df: DataFrame, target: int = 512, most: int = 1024, least: int = 100, overlap: int = 50, keep: tuple[str, ...] = ("section_id",), joiner: str = " ") -> DataFrame:
    """Chunks of each section from its units (in order of place, part): ordinal, text,
    tokens, first and last unit. Sequential in a section, parallel over sections. A
    section with a unit over `most` gives no chunk. `least` is for semantic chunks."""

    def arrange(rows: list[dict]) -> list[dict]:
        sizes, texts = [int(r["tokens"]) for r in rows], [r["text"] for r in rows]
        ranges = group_sizes(sizes, target, most, overlap) if max(sizes, default=0) <= most else []
        return [{"ordinal": i, "text": joiner.join(texts[a:b]), "tokens": sum(sizes[a:b]), "first_unit": a, "last_unit": b - 1} for i, (a, b) in enumerate(ranges)]

    return _in_order(df, list(keep), ["place", "part", "text", "tokens"], arrange, "ordinal: int, text: string, tokens: int, first_unit: int, last_unit: int")


_SENTENCE, _PARAGRAPH = r"(?<=[.!?])(?=\s)", r"(?=\R[^\S\n]*\R)"


def unit_arrays(sections: DataFrame, strategy: str, most: int, column: str = "text", dim: int = 64) -> DataFrame:
    """sections with what their units are grouped by: `_tokens`, `_spans` (start and stop
    of each unit in the text) and, for semantic-v1, `_alike` (likeness of each sentence
    to the one before). Units are sentences; for structure-v1 paragraphs, or the
    sentences of those over `most`. All of a section stays in its row: no shuffle."""
    text = F.coalesce(F.col(column), F.lit(""))
    pieces = F.split(text, _SENTENCE)
    if strategy == "structure-v1":
        pieces = F.flatten(F.transform(F.split(text, _PARAGRAPH), lambda p: F.when(F.regexp_count(p, F.lit(TOKEN)) <= most, F.array(p)).otherwise(F.split(p, _SENTENCE))))

    @sliced("array<struct<start: int, stop: int>>")
    def spans(lengths: pd.Series, leads: pd.Series, bodies: pd.Series) -> pd.Series:
        def one(length, lead, body) -> list[dict]:
            starts = np.cumsum(length) - length + lead
            return [{"start": int(s), "stop": int(s + b)} for s, b in zip(starts, body, strict=True) if b]

        return pd.Series([one(*x) for x in zip(lengths, leads, bodies, strict=True)])

    cut = sections.withColumn("_p", pieces)
    trimmed = F.transform("_p", lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    lead = F.transform("_p", lambda p: F.length(p) - F.length(F.regexp_replace(p, r"^\s+", "")))
    cut = cut.withColumn("_spans", spans(F.transform("_p", lambda p: F.length(p)), lead, F.transform(trimmed, lambda p: F.length(p))))
    cut = cut.withColumn("_p", F.filter(trimmed, lambda p: p != "")).withColumn("_tokens", F.transform("_p", lambda p: F.regexp_count(p, F.lit(TOKEN))))
    if strategy == "semantic-v1":
        from .embedding import likeness_to_previous

        cut = cut.withColumn("_alike", likeness_to_previous("_p", dim))
    return cut.drop("_p")


def _ranges(strategy: str, threshold: float, least: int):
    """UDF of (tokens, alike, target, most, overlap): ranges of units, null if one is
    over `most`; made when called, as a UDF needs a session. Only numbers go to Python."""

    @sliced("array<struct<first: int, last: int, tokens: int>>")
    def ranges(tokens: pd.Series, alike: pd.Series, target: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.Series:
        def one(sizes, near, target, most, overlap) -> list[dict] | None:
            sizes = [int(n) for n in sizes]
            if max(sizes, default=0) > most:
                return None
            found = semantic_sizes(sizes, near, threshold, target, least, most, overlap) if near is not None else group_sizes(sizes, target, most, overlap)
            return [{"first": a, "last": b, "tokens": sum(sizes[a:b])} for a, b in found]

        return pd.Series([one(*x) for x in zip(tokens, alike, target, most, overlap, strict=True)])

    return ranges


def _totals(threshold: float, least: int, most: int):
    """UDF of (tokens, alike, targets, overlaps): for each setting whether a unit is over
    `most`, the ranges' number, their tokens and the largest; null without units."""

    @sliced("array<struct<bad: boolean, n: int, total: long, top: int>>")
    def totals(tokens: pd.Series, alike: pd.Series, targets: pd.Series, overlaps: pd.Series) -> pd.Series:
        def one(sizes, near, targets, overlaps) -> list[dict] | None:
            sizes = [int(n) for n in sizes]
            if not sizes:
                return None
            if max(sizes) > most:
                return [{"bad": True, "n": 0, "total": 0, "top": None}] * len(targets)
            before, out = [0, *itertools.accumulate(sizes)], []
            near = None if near is None else near.tolist()
            for target, overlap in zip(targets.tolist(), overlaps.tolist(), strict=True):
                found = semantic_sizes(sizes, near, threshold, target, least, most, overlap) if near is not None else group_sizes(sizes, target, most, overlap)
                sums = [before[b] - before[a] for a, b in found]
                out.append({"bad": False, "n": len(sums), "total": sum(sums), "top": max(sums)})
            return out

        return pd.Series([one(*x) for x in zip(tokens, alike, targets, overlaps, strict=True)])

    return totals


def _chunks(sections: DataFrame, strategy: str, keep: tuple[str, ...], target: int, least: int, most: int, overlap: int, threshold: float = 0.0, dim: int = 64) -> DataFrame:
    units = unit_arrays(sections, strategy, most, dim=dim)
    alike = F.col("_alike") if strategy == "semantic-v1" else F.lit(None).cast("array<double>")
    ranged = units.withColumn("_r", _ranges(strategy, threshold, least)("_tokens", alike, F.lit(target), F.lit(most), F.lit(overlap)))
    each = ranged.where("_r is null or size(_r) > 0").select(*keep, "text", "_spans", F.posexplode_outer("_r").alias("ordinal", "_c"))
    start, stop = F.col("_spans")[F.col("_c.first")]["start"], F.col("_spans")[F.col("_c.last") - 1]["stop"]
    return each.select(
        *keep, F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.substring("text", start + 1, stop - start).alias("text"), F.col("_c.tokens").alias("tokens"),
        F.col("_c.first").alias("first_unit"), (F.col("_c.last") - 1).alias("last_unit"), F.when(F.col("_c").isNull(), "UNCHUNKABLE").otherwise("OK").alias("status"),
    )


def chunk_fixed(sections: DataFrame, keep: tuple[str, ...] = ("section_id",), target: int = 512, most: int = 1024, least: int = 100, overlap: int = 50) -> DataFrame:
    """fixed-v1: sentences, grouped. A chunk's text is the section's from the first unit's
    start to the last one's end. A section with a sentence over `most` has one row, of the
    status UNCHUNKABLE; a blank one has none."""
    return _chunks(sections, "fixed-v1", keep, target, least, most, overlap)


def chunk_structure(sections: DataFrame, keep: tuple[str, ...] = ("section_id",), target: int = 512, most: int = 1024, least: int = 100, overlap: int = 50) -> DataFrame:
    """structure-v1: paragraphs, or their sentences where too long, grouped within a
    section; else as chunk_fixed."""
    return _chunks(sections, "structure-v1", keep, target, least, most, overlap)


def chunk_semantic(sections: DataFrame, threshold: float, dim: int = 64, least: int = 100, most: int = 1024, keep: tuple[str, ...] = ("section_id",), target: int = 512, overlap: int = 50) -> DataFrame:
    """semantic-v1: ranges of sentences as by semantic_sizes; else as chunk_fixed."""
    return _chunks(sections, "semantic-v1", keep, target, least, most, overlap, threshold, dim)


def ablation(sections: DataFrame, grid: DataFrame, most: int = 1024, least: int = 100, threshold: float = 0.05, dim: int = 64) -> DataFrame:
    """sections (text), grid (run_id, strategy, target, overlap) -> per run: sections,
    chunks, mean_tokens, max_tokens, unchunkable_share (of the sections with units).

    Units are found once for a section and go to Python once for each strategy, with all
    its settings, of which only the sums come back. The grid is a fixed table of a few rows."""
    from .embedding import likeness_to_previous

    # white space holds no token, so a piece is blank if its count is 0, and trimming changes no count
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = lambda pieces: F.transform(pieces, lambda p: word_count(p))
    whole = F.transform(F.split(text, _PARAGRAPH), lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))
    fitting = F.transform(whole, lambda x: F.when(x["n"] <= most, F.array(x["n"])).otherwise(counts(F.split(x["p"], _SENTENCE))))
    cut = sections.select(F.split(text, _SENTENCE).alias("_p"), F.filter(F.flatten(fitting), lambda n: n > 0).alias("_structure"))
    trimmed = F.filter(F.transform("_p", lambda p: F.btrim(p, F.lit(_BLANK))), lambda p: p != "")
    cut = cut.select(trimmed.alias("_p"), "_structure")
    cut = cut.select("_structure", counts(F.col("_p")).alias("_tokens"), likeness_to_previous("_p", dim).alias("_alike"))
    none = F.lit(None).cast("array<double>")
    kinds = (("fixed-v1", "_tokens", none), ("structure-v1", "_structure", none), ("semantic-v1", "_tokens", F.col("_alike")))
    every = cut.select(F.inline(F.array(*(F.struct(F.lit(name).alias("strategy"), F.col(t).alias("_tokens"), a.alias("_alike")) for name, t, a in kinds))))
    runs = grid.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("run_id", "target", "overlap"))).alias("_runs"))
    every = every.join(F.broadcast(runs), "strategy")
    told = _totals(threshold, least, most)("_tokens", "_alike", F.col("_runs.target"), F.col("_runs.overlap"))
    each = every.select("_runs", told.alias("_t")).select(F.inline(F.arrays_zip(F.col("_runs.run_id").alias("run_id"), F.col("_t").alias("t"))))
    sums = each.where("t is not null").select("run_id", "t.*")
    out = sums.groupBy("run_id").agg(
        F.count("*").alias("sections"), F.sum("n").alias("chunks"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean_tokens"),
        F.max("top").alias("max_tokens"), F.avg(F.col("bad").cast("int")).alias("unchunkable_share"),
    )
    return out


def chunk_tables(tables: DataFrame, most: int) -> DataFrame:
    """tables (table_id, caption, header, rows: array<string>): caption and header in
    front of as many rows as fit; a row that never fits has the status UNCHUNKABLE."""
    counted = tables.withColumn("head", F.concat_ws("\n", "caption", "header")).withColumn("head_tokens", token_count("head"))
    rows = counted.select("table_id", "head", "head_tokens", F.posexplode("rows").alias("place", "text")).withColumn("tokens", token_count("text"))
    fits = rows.where(F.col("head_tokens") + F.col("tokens") <= most)

    def arrange(rows: list[dict]) -> list[dict]:
        chunks: list[tuple[list[str], int]] = []
        for r in rows:
            if not chunks or chunks[-1][1] + r["tokens"] > most:
                chunks.append(([r["head"]], r["head_tokens"]))
            chunks[-1] = ([*chunks[-1][0], r["text"]], chunks[-1][1] + r["tokens"])
        return [{"ordinal": i, "text": "\n".join(t), "tokens": n} for i, (t, n) in enumerate(chunks)]

    good = _in_order(fits, ["table_id"], ["place", "text", "tokens", "head", "head_tokens"], arrange, "ordinal: int, text: string, tokens: int").withColumn("status", F.lit("OK"))
    bad = rows.where(F.col("head_tokens") + F.col("tokens") > most).select("table_id", F.col("place").alias("ordinal"), "text", "tokens", F.lit("UNCHUNKABLE").alias("status"))
    return good.union(bad)


def breadcrumb(df: DataFrame) -> DataFrame:
    """title > parents > heading, blanks left out."""
    parts = F.concat(F.array("title"), F.coalesce("parents", F.array().cast("array<string>")), F.array("heading"))
    return df.withColumn("breadcrumb", F.array_join(F.filter(parts, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), " > "))


def finalise_chunks(df: DataFrame, strategy: str) -> DataFrame:
    """ordinal runs over a document's sections, then tables; metadata as a map."""
    w = Window.partitionBy("document_id").orderBy(F.col("kind") != "section", "section_path", "place")
    return df.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("metadata", F.create_map(F.lit("strategy"), F.lit(strategy), F.lit("section_type"), F.col("kind"), F.lit("section_path"), F.col("section_path")))


def split_unchunkable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunkable rows, and the others for quarantine."""
    return df.where("status = 'OK'"), df.where("status <> 'OK'")


def chunk_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("version_id", "strategy").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


def rule_context(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """context_prefix: title, publisher, summary and breadcrumb on lines of their own."""
    lines = F.concat_ws("\n", F.concat(F.lit("Document: "), "title"), F.concat(F.lit("Publisher: "), "publisher"), F.concat(F.lit("Summary: "), "summary"), F.concat(F.lit("Section: "), "breadcrumb"))
    return chunks.join(documents, "document_id").withColumn("context_prefix", lines)


def document_summary(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The metadata summary, else the first chunk's first 512 characters, else a note;
    white space collapsed."""
    first = chunks.groupBy("document_id").agg(F.min_by("text", "ordinal").alias("first"))
    text = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.nullif(F.trim(F.left("first", F.lit(512))), F.lit("")), F.lit("Summary unavailable"))
    return documents.join(first, "document_id", "left").select("document_id", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("summary"))


def pending_context(chunks: DataFrame, mode: str, prompt: str | None, n: int = 500) -> DataFrame:
    """The first n CLEAN chunks whose context is of another mode or prompt, or missing."""
    other = ~F.col("contextual_mode").eqNullSafe(F.lit(mode)) | ~F.col("context_prompt_version").eqNullSafe(F.lit(prompt)) | F.col("context_prefix").isNull()
    return chunks.where((F.col("phi_scan_status") == "CLEAN") & other).orderBy("document_id", "ordinal").limit(n)


def apply_context(chunks: DataFrame, cache: DataFrame, generator, keys: tuple[str, ...] = ("version_id", "strategy", "ordinal", "mode", "prompt_version")) -> DataFrame:
    """Cached prefixes stay; misses go to generator (a pandas function of text, null on
    failure), and failures take the rule's prefix (column rule_prefix)."""
    joined = chunks.join(cache.select(*keys, F.col("context_text").alias("_hit")), list(keys), "left")

    @F.pandas_udf("string")
    def generate(text: pd.Series) -> pd.Series:
        return generator(text)

    made = joined.withColumn("_made", F.when(F.col("_hit").isNull(), generate("text")))
    status = F.when(F.col("_hit").isNotNull(), "CACHE_HIT").when(F.col("_made").isNotNull(), "GENERATED").otherwise("RULE_FALLBACK")
    return made.withColumn("context_prefix", F.coalesce("_hit", "_made", "rule_prefix")).withColumn("context_status", status).drop("_hit", "_made")


def embedding_text(df: DataFrame) -> DataFrame:
    """Prefix, blank line, text; without a prefix the text alone."""
    return df.withColumn("embedding_text", F.when(F.coalesce(F.trim("context_prefix"), F.lit("")) == "", F.col("text")).otherwise(F.concat("context_prefix", F.lit("\n\n"), "text")))


def context_cost(usage: DataFrame, price_in: float, price_out: float, budget: float, keys: tuple[str, ...] = ("mode", "document_id")) -> DataFrame:
    """chunks * (mean input * price + mean output * price) / 1e6, six places."""
    out = usage.groupBy(*keys).agg(F.count("*").alias("chunks"), F.avg("input_tokens").alias("i"), F.avg("output_tokens").alias("o"))
    cost = F.round(F.col("chunks") * (F.col("i") * price_in + F.col("o") * price_out) / 1e6, 6)
    return out.select(*keys, "chunks", cost.alias("cost"), (cost <= budget).alias("within_budget"))
