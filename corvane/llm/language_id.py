"""Language identification by fusing evidence in Bayes' rule.

The posterior of a page's language multiplies
- the likelihood of its text: a multinomial model of hashed three-byte sequences,
  counted per language over all labelled documents; as neighbouring sequences are
  not independent, a text weighs as at most EFFECTIVE of them;
- the likelihood of the language that its markup declares, from how often pages of
  each text language declare it;
- the likelihood of its address suffix (the host's last label), likewise;
- the prior of its host, smoothed towards that of its domain (the last two labels),
  which is smoothed towards the prior of all pages. A page's own vote is taken out.

All counts are grouped aggregates over all rows, partly summed before the shuffle.
Host, domain and suffix tables grow with the input and are joined, not broadcast by
hand. What reaches the driver has one row for each language, sequence bucket and
declared language.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, bounded_batches, keep, string_offsets

BUCKETS = 1 << 14
EFFECTIVE = 60.0
#: Pseudo-counts: for sequences, for what a page declares truly, and for the priors.
SEQUENCE_PRIOR, DECLARED_PRIOR, SUFFIX_PRIOR, HOST_PRIOR = 0.5, 20.0, 20.0, 8.0
MOST_LANGUAGES = 500
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: What opens markup and, for each kind, what ends it; without its end a script, style or
#: comment is a plain tag, and a tag without one is text.
_OPENS = re.compile(r"<(?:(script|style)\b|!(--))?", re.I)
_ENDS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "--": re.compile("-->"), "": re.compile(">")}
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
#: A number of eight digits names no character, as longer ones.
_NUMBER = re.compile(r"&#0*([0-9]{1,8})[0-9]*")


def sequence_buckets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each three-byte sequence of each text, and its row."""
    offsets = string_offsets(array).astype(np.int64)
    offsets, low = offsets - offsets[0], int(offsets[0])
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8)[low : low + int(offsets[-1])] if body is not None and offsets[-1] else np.zeros(0, np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(len(array)), np.diff(offsets))
    value = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    inside = row[:-2] == row[2:]
    return (value[inside] >> np.uint32(18)).astype(np.int64), row[:-2][inside]


def train(documents: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log likelihood of each bucket (language by bucket).
    Rows without text or language are not used."""
    bounded_batches(documents.sparkSession)
    source = documents.select(F.lower(lang_column).alias("lang"), F.col(text_column).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in blocks(batches, "text"):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            bucket, row = sequence_buckets(batch.column("text"))
            found = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, counts in zip(names, found, strict=True):
                totals[name] = totals.get(name, 0) + counts
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["lang", "bucket", "n"])

    counted = keep(source.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "sequences")
    langs = sorted(r.lang for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((len(langs), BUCKETS), SEQUENCE_PRIOR)
    for lang, packed in counted.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n")))).toLocalIterator():  # BUCKETS entries each
        table[langs.index(lang), list(packed)] += list(packed.values())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def page_text(markup: str | None) -> str:
    """The text between markup. The next end of each kind is looked for once and kept
    until the place has passed it, so the search is linear in the markup."""
    markup, parts, at = markup or "", [], 0
    ends: dict[str, re.Match | None] = {}

    def end_of(kind: str, start: int) -> int | None:
        if kind not in ends or ((known := ends[kind]) and known.start() < start):
            ends[kind] = _ENDS[kind].search(markup, start)
        return ends[kind].end() if ends[kind] else None

    for opened in _OPENS.finditer(markup):
        if opened.start() < at:
            continue
        kind = (opened[1] or opened[2] or "").lower()
        end = end_of(kind, opened.end()) if kind in _ENDS else None
        end = end if end is not None else end_of("", opened.start() + 1)
        if end is not None:
            parts += [markup[at : opened.start()], " "]
            at = end
    return html.unescape(_NUMBER.sub(r"&#\1", "".join(parts) + markup[at:]))


def declared_language(markup: str | None) -> str | None:
    """The language that the first html tag with one declares."""
    at = 0
    for opened in _HTML.finditer(markup or ""):
        if opened.start() >= at:
            at = markup.find(">", opened.end())
            at = at if at >= 0 else len(markup)
            if found := _LANG.search(markup, opened.end(), at):
                return found[1].lower()
    return None


def host_of(url: str | None) -> str | None:
    _, found, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()
    return host or None if found else None


def _evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], id_column: str, url_column: str, html_column: str) -> DataFrame:
    """id, host, domain, suffix, declared, support (log likelihood per language),
    text_lang (the best one, null without text)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = "id long, host string, domain string, suffix string, declared string, support array<double>, text_lang string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in blocks(batches, "html"):
            markup = batch.column("html").to_pylist()
            texts = pa.array([page_text(m) for m in markup], pa.string())
            bucket, row = sequence_buckets(texts)
            n = np.bincount(row, minlength=len(texts))
            scale = np.minimum(n, EFFECTIVE) / np.maximum(n, 1)
            support = np.stack([np.bincount(row, log[bucket], len(texts)) * scale for log in table], axis=1) if langs else np.zeros((len(texts), 0))
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            labels = [(h or "").split(".") for h in hosts]
            declared = [declared_language(m) for m in markup]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(hosts, pa.string()),
                    pa.array([".".join(x[-2:]) if h else None for h, x in zip(hosts, labels, strict=True)], pa.string()),
                    pa.array([x[-1] if h else None for h, x in zip(hosts, labels, strict=True)], pa.string()),
                    pa.array(declared, pa.string()),
                    pa.array(support.tolist(), pa.list_(pa.float64())),
                    pa.array([langs[s.argmax()] if c and langs else None for s, c in zip(support, n, strict=True)], pa.string()),
                ],
                names=["id", "host", "domain", "suffix", "declared", "support", "text_lang"],
            )

    source = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.coalesce(html_column, F.lit("")).alias("html"))
    return keep(source.mapInArrow(run, schema), "evidence")


def _votes(evidence: DataFrame, key: str, langs: list[str], name: str) -> DataFrame:
    """Pages of each text language for each value of key, as an array."""
    counts = F.array(*(F.count(F.when(F.col("text_lang") == x, 1)).cast("double") for x in langs))
    return evidence.where(F.col(key).isNotNull()).groupBy(key).agg(counts.alias(name))


def languages(pages: DataFrame, documents: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per page row: id, host, declared, text_lang (by the text alone), lang (by all
    evidence), probability (of lang).

    Missing evidence (null or empty markup, no lang attribute, an unknown declared
    language, no host) leaves the others to decide; ties go to the first language in
    order. Repeated rows and null ids each keep a row. Without any labelled document
    lang is null and probability 0.
    """
    langs, table = train(documents, text_column, lang_column)
    evidence = _evidence(pages, (langs, table), id_column, url_column, html_column)
    if not langs:
        return evidence.select(F.col("id").alias(id_column), "host", "declared", "text_lang", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    known = F.when(F.col("declared").isin(langs), F.col("declared"))
    told = evidence.groupBy("text_lang", known.alias("declared")).count().collect()  # languages squared
    of = {(r.text_lang, r.declared): r["count"] for r in told}
    total = {x: sum(n for (t, d), n in of.items() if t == x) for x in langs}
    stated = {x: sum(n for (t, d), n in of.items() if t == x and d) for x in langs}
    pages_of = np.array([total[x] + 1.0 for x in langs])
    prior = pages_of / pages_of.sum()

    def array(values) -> Column:
        return F.array(*(F.lit(float(v)) for v in values))

    by_declared = F.create_map(*(
        c for d in langs for c in (F.lit(d), array(np.log((of.get((x, d), 0) + DECLARED_PRIOR * (0.9 if x == d else 0.1 / max(1, len(langs) - 1))) / (stated[x] + DECLARED_PRIOR)) for x in langs))
    ))
    joined = evidence
    for key, name in (("suffix", "of_suffix"), ("domain", "of_domain"), ("host", "of_host")):
        joined = joined.join(_votes(evidence, key, langs, name), key, "left")
    own = F.array(*(F.coalesce((F.col("text_lang") == x).cast("double"), F.lit(0.0)) for x in langs))
    none = array([0.0] * len(langs))
    joined = joined.withColumn("own", own).withColumn("prior", array(prior)).withColumn("pages_of", array(pages_of))
    for name in ("of_suffix", "of_domain", "of_host"):
        joined = joined.withColumn(name, F.zip_with(F.coalesce(name, none), "own", lambda n, o: F.greatest(n - o, F.lit(0.0))))
    size = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("suffix_share", (size("of_suffix") + 1) / (F.lit(float(pages_of.sum())) + 1))
    from_suffix = F.zip_with("of_suffix", "pages_of", lambda n, t: F.ln((n + SUFFIX_PRIOR * F.col("suffix_share")) / (t + SUFFIX_PRIOR)))
    joined = joined.withColumn("domain_size", size("of_domain")).withColumn("domain_prior", F.zip_with("of_domain", "prior", lambda n, p: (n + HOST_PRIOR * p) / (F.col("domain_size") + HOST_PRIOR)))
    joined = joined.withColumn("host_size", size("of_host")).withColumn("host_prior", F.zip_with("of_host", "domain_prior", lambda n, p: (n + HOST_PRIOR * p) / (F.col("host_size") + HOST_PRIOR)))
    parts = [F.col("support"), F.transform("host_prior", lambda p: F.ln(p)), F.when(F.col("suffix").isNotNull(), from_suffix).otherwise(none), F.coalesce(by_declared[known], none)]
    joined = joined.withColumn("log_post", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts))
    joined = joined.withColumn("top", F.array_max("log_post"))
    best = F.element_at(F.array(*map(F.lit, langs)), F.array_position("log_post", F.col("top")).cast("int"))
    share = 1 / F.aggregate("log_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return joined.select(F.col("id").alias(id_column), "host", "declared", "text_lang", best.alias("lang"), share.alias("probability"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model is counted over all documents."""
    return languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
