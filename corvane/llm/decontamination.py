"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations only.

A window is `span` consecutive words of a benchmark item (a shorter item is one
window as a whole). A document word is hit if it lies inside any occurrence of a
window. To find occurrences without listing every window of every document:

1. Fingerprints. Of every `span - k + 1` consecutive k-gram hashes only the least
   is kept, so any shared run of `span` words has a fingerprint in common on both
   sides. Document fingerprints meet the benchmark's in one join. Items shorter
   than `span` are looked up by the hash of their whole length instead.
2. Extension. Only in texts with a common fingerprint, all k-grams are matched with
   the items' fingerprints. A window of `span` words that holds a k-gram reaches no
   further than `span - k` words to either side of it, so each match is extended over
   that context: words equal without a gap on both sides, the k-gram included, are a
   hit if they reach the window's length. Every shared window holds a fingerprint, so
   no other windows exist.

Fingerprints with the same context are one, whatever items hold them, so a line that
many items and many texts share is matched once for each place, and the items are named
once for each distinct set of contexts that a text matches. Contexts are cut from blocks of words: no row carries a whole text along.

The first step hashes each word in lower case of any script, which only adds
candidates; the second compares words with A-Z alone lower-cased. Texts are
identified by digest there, so copies are extended once. The benchmark's side is
broadcast if its bytes fit; else the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, checked_broadcast, forget, keep

SPAN, K = 10, 7
_GAP = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # A-Z are lower-cased later
_WORD = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a row of the result.
_RESULT_WIDTH = 160
#: Characters of text in a part of the second step: so many at most, and no fewer than
#: this where there are cores for more parts.
_MOST_CHARS, _LEAST_CHARS = 32 << 20, 1 << 18
#: Words of a block that contexts are cut from.
_BLOCK = 64


def _words(text: str) -> Column:
    return F.expr(f"array_remove(split({text}, '{_GAP}'), '')")


def _paired(array: str, shift: int, other: str, function: str) -> Column:
    """function(array[i], other[i + shift]) while both exist."""
    rest = f"greatest(size({other}) - {shift}, 0)"
    left, right = f"slice({array}, 1, {rest})", f"slice({other}, {shift + 1}, {rest})"
    return F.expr(f"zip_with({left}, {right}, (x, y) -> {function}(x, y))")


def _grams(df: DataFrame, words: str, k: int, out: str) -> DataFrame:
    """Hashes of all k-grams of an array of words, from hashes of half as many words."""
    df, have = df.withColumn("_g1", F.expr(f"transform({words}, w -> xxhash64(lower(w)))")), 1
    while have < k:
        step = min(have, k - have)
        df = df.withColumn(f"_g{have + step}", _paired(f"_g{have}", step, f"_g{have}", "xxhash64"))
        have += step
    return df.withColumn(out, F.col(f"_g{k}"))


def _minima(df: DataFrame, grams: str, width: int, out: str) -> DataFrame:
    """Distinct minima of `width` neighbours."""
    df, have = df.withColumn("_m1", F.col(grams)), 1
    while have < width:
        step = min(have, width - have)
        df = df.withColumn(f"_m{have + step}", _paired(f"_m{have}", step, f"_m{have}", "least"))
        have += step
    return df.withColumn(out, F.expr(f"array_distinct(_m{width})"))


def _with_context(places: DataFrame, worded: DataFrame, key: str, reach: int, span: int) -> DataFrame:
    """places(key, p, ...) with context, the words from p - reach to p + span as far as
    they exist, and at, the place of p in it; worded(key, words) has one row a key."""
    first = f"greatest(b * {_BLOCK} - {reach}, 0)"
    cut = f"slice(words, {first} + 1, {_BLOCK + span + reach})"
    numbers = f"sequence(0, (size(words) - 1) div {_BLOCK})"
    cells = f"inline(transform({numbers}, b -> struct(cast(b as int) as b, {cut} as block)))"
    blocks = worded.where("size(words) > 0").selectExpr(key, cells)
    placed = places.withColumn("b", F.expr(f"cast(p div {_BLOCK} as int)")).join(blocks, [key, "b"])
    placed = placed.withColumn("r", F.expr(f"p - {first}")).withColumn("at", F.expr(f"least(r, {reach})"))
    return placed.withColumn("context", F.expr(f"slice(block, r - at + 1, at + {span})")).drop("b", "r", "block")


def _run(x: str, y: str) -> str:
    """How many elements of two arrays are equal before the first that are not."""
    equal = f"zip_with({x}, {y}, (x, y) -> coalesce(x = y, false))"
    return f"coalesce(nullif(array_position({equal}, false), 0) - 1, size({x}))"


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    k: int = K,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256 (of the
    item ids sorted as strings and comma-joined), contaminated (n_hit > 0).

    Null, empty and wordless texts have no words and no hits; repeated rows and
    null ids each keep a row. Items without words, and items with a null id, are
    left out; items that repeat an id count once. An empty benchmark hits nothing.
    Other columns are not read.
    """
    if not k <= span:
        raise ValueError("k must not exceed span")
    reach = span - k
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("t"))
    items = items.where("item is not null and t is not null")
    items = items.select("item", _words(f"translate(t, '{_UPPER}', '{_LOWER}')").alias("words")).where("size(words) > 0")
    named_words = F.expr("md5(concat_ws(' ', item, array_join(words, ' ')))")
    items = keep(items.withColumn("ikey", named_words).dropDuplicates(["ikey"]), "items")
    long_items = _grams(items.where(f"size(words) >= {span}"), "words", k, "g")
    least = _minima(long_items, "g", reach + 1, "m").select("ikey", F.explode_outer("m").alias("print"))
    prints = long_items.select("ikey", F.posexplode_outer("g").alias("p", "print")).join(least, ["ikey", "print"], "left_semi")
    prints = prints.select("ikey", "p", "print")
    short = items.where(f"size(words) < {span}").withColumn("length", F.size("words"))
    lengths = sorted(r.length for r in short.select("length").distinct().collect())  # below span values at most

    def short_prints(df: DataFrame, words: str, length: int, out: str) -> DataFrame:
        """Hashes of that length, apart from those of other lengths and of k-grams."""
        return _grams(df, words, length, "_s").withColumn(out, F.expr(f"transform(_s, x -> xxhash64(x, {length}))"))

    for length in lengths:
        whole = short_prints(short.where(F.col("length") == length), "words", length, "_p")
        prints = prints.union(whole.select("ikey", F.lit(0).alias("p"), F.explode("_p").alias("print")))
    known = items.select("ikey", "item", F.least(F.lit(span), F.size("words")).alias("need"))
    wanted = _with_context(prints, items.select("ikey", "words"), "ikey", reach, span).join(known, "ikey")
    wanted = wanted.select("print", "item", "need", F.col("at").alias("iat"), F.col("context").alias("ictx"))
    # items that hold a k-gram in the same context are one class
    kind = F.md5(F.concat_ws(" ", F.col("print"), F.col("need"), F.col("iat"), F.array_join("ictx", " ")))
    named_classes = keep(wanted.select(kind.alias("kind"), "item", "print", "need", "iat", "ictx").distinct(), "classes")
    members = named_classes.select("kind", "item")
    wanted = keep(named_classes.drop("item").dropDuplicates(["kind"]), "wanted")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.expr("4 * length(array_join(ictx, '')) + 24 * size(ictx) + 132")).alias("bytes")).first()
    wanted_prints = checked_broadcast(wanted.select("print").distinct(), size.n)

    # 1. texts that share a fingerprint
    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("t"))
    worded = source.select(F.xxhash64("t").alias("key"), F.length("t").alias("chars"), _words("t").alias("low"))
    marked = _minima(_grams(worded, "low", k, "g"), "g", reach + 1, "m")
    emitted = F.expr(f"if(size(low) >= {span}, m, array())")
    for length in lengths:
        marked = short_prints(marked, "low", length, f"_p{length}")
        emitted = F.concat(emitted, F.array_distinct(f"_p{length}"))
    met = marked.select("key", "chars", F.explode(emitted).alias("print")).join(wanted_prints, "print", "left_semi")
    met = keep(met.groupBy("key").agg(F.max("chars").alias("chars")), "met")
    found = met.agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).first()

    # 2. extension in those texts. An inner explode would test the hashes' number in a
    # filter of its own that computes them anew; the joins drop the nulls of an outer one.
    texts = source.withColumn("key", F.xxhash64("t")).join(checked_broadcast(met.select("key"), found.n), "key", "left_semi")
    texts = texts.select(F.md5("t").alias("tid"), "t").dropDuplicates(["tid"])
    chars, cores = found.chars or 0, documents.sparkSession.sparkContext.defaultParallelism
    parts = max(chars // _MOST_CHARS, min(chars // _LEAST_CHARS, 4 * cores)) + 1
    texts = keep(texts.repartition(parts, "tid"), "texts")
    grams = _grams(texts.select("tid", _words("t").alias("low")), "low", k, "g")
    places = grams.select("tid", F.posexplode_outer("g").alias("p", "print"))
    for length in lengths:
        places = places.union(short_prints(grams, "low", length, "_p").select("tid", F.posexplode_outer("_p").alias("p", "print")))
    places = keep(places.join(wanted_prints, "print", "left_semi").select("tid", "p", "print"), "places")
    worded = texts.select("tid", _words(f"translate(t, '{_UPPER}', '{_LOWER}')").alias("words"))
    seeds = _with_context(places, worded, "tid", reach, span)
    seeds = seeds.join(F.broadcast(wanted) if (size.bytes or 0) <= BROADCAST_BYTES else wanted, "print")
    before = _run("reverse(slice(ictx, 1, iat))", "reverse(slice(context, 1, at))")
    after = _run(f"slice(ictx, iat + 1, {span})", f"slice(context, at + 1, {span})")
    runs = seeds.selectExpr("tid", "kind", "need", "p", f"{before} as before", f"{after} as after")
    runs = runs.where("before + after >= need").selectExpr("tid", "kind", "p - before as start", "p + after as end").distinct()
    runs = keep(runs, "runs")
    earlier = Window.partitionBy("tid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select("tid", "start", "end").distinct().withColumn("reached", F.max("end").over(earlier))
    fresh = F.expr("greatest(end - greatest(start, coalesce(reached, 0)), 0)")
    covered = spans.groupBy("tid").agg(F.sum(fresh).alias("n_hit"))
    # items are named once for each distinct set of classes, not for each text
    sets = runs.groupBy("tid").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumn("set", F.md5(F.array_join("kinds", ",")))
    sets = keep(sets, "sets")
    every_item = F.array_join(F.array_sort(F.collect_list("item")), ",")
    items_of = sets.dropDuplicates(["set"]).select("set", F.explode("kinds").alias("kind")).join(members, "kind").select("set", "item").distinct()
    items_of = items_of.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(every_item, 256).alias("items_sha256"))
    named = sets.select("tid", "set").join(items_of, "set").drop("set")
    result = keep(covered.join(named, "tid"), "hits")
    for table in (wanted, named_classes, sets, met, texts, places, runs, items):
        forget(table)

    every = source.select("id", F.expr(f"cast(regexp_count(t, '{_WORD}') as long)").alias("n_words"), F.md5("t").alias("tid"))
    return every.join(checked_broadcast(result, result.count(), _RESULT_WIDTH), "tid", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the benchmark table."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
i as (select item_id, {_SQL_WORDS} as w from benchmark),
iw as (select distinct item_id, l, array_to_string(w[s : s + l - 1], ' ') as win from (
  select item_id, w, least({SPAN}, len(w)) as l, unnest(range(1, len(w) - least({SPAN}, len(w)) + 2)) as s from i where len(w) > 0)),
dw as (select doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') as win from (
  select doc_id, w, l, unnest(range(1, greatest(len(w) - l + 2, 1))) as s from d, (select distinct l from iw))),
hits as (select doc_id, item_id, s, l from dw join iw using (l, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + l)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join named using (doc_id)
"""
