"""Interaction audit of filters: what each removes in every order of application.

A document's failures are a mask of bits, so all that any order can show follows from how
many documents of a part have each mask: the cells. They are one aggregate. All 2^n sets
of filters are then walked in Gray-code order: one filter is switched at a time, each cell
counts its filters that are on and fail it, and the running survivors change only by the
cells whose counter leaves or reaches 0. The stored states give every step of every order
as a difference of two.

Copies: a document fails the filter of copies if its text stands under a smaller id
anywhere. The least id of each text comes from an aggregate, and rows meet it under text
digest *and* id, so no text and no group of copies is a join key of many rows; equal rows
are counted together before. Texts are told apart by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, forget, keep

LETTERS = "ABCDE"
_WORDS = r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')"


def contract_filters() -> list[Column | None]:
    """A: under 50 words; B: distinct words under 65 % of the words; C: capitals over 5 %
    of the code points; D: any of #$%&*|; None: copies. Over columns t (the text, not null)
    and w (its words)."""
    return [
        F.expr("size(w) < 50"),
        F.expr("100 * size(array_distinct(w)) < 65 * size(w)"),
        F.expr("100 * regexp_count(t, '[A-Z]') > 5 * length(t)"),
        F.expr("t rlike '[#$%&*|]'"),
        None,
    ]


def gray_states(cells: np.ndarray) -> np.ndarray:
    """cells [part, mask, value] -> survivors [part, set of filters, value]."""
    parts, masks, values = cells.shape
    failing, on = np.zeros(masks, np.int64), 0
    running = cells.sum(axis=1)
    states = np.zeros((parts, masks, values), cells.dtype)
    states[:, 0] = running
    for step in range(1, masks):
        bit = step & -step  # the bit in which the next Gray code differs
        on ^= bit
        held = np.flatnonzero(np.arange(masks) & bit)
        before = failing[held] > 0
        failing[held] += 1 if on & bit else -1
        after = failing[held] > 0
        running = running - cells[:, held[after & ~before]].sum(axis=1) + cells[:, held[before & ~after]].sum(axis=1)
        states[:, on] = running
    return states


def order_steps(cells: np.ndarray) -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) pairs and [part, pair, column] of kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. Values of cells: rows, good, toxic."""
    n = cells.shape[1].bit_length() - 1
    states, masks = gray_states(cells), np.arange(cells.shape[1])
    fails = [cells[:, (masks >> f & 1) == 1, 0].sum(axis=1) for f in range(n)]
    alone = [cells[:, 1 << f, 0] for f in range(n)]
    named, columns, shapley = [], [], [0] * n
    orders = list(permutations(range(n)))
    for order in orders:
        on = 0
        for f in order:
            lost = states[:, on] - states[:, on | 1 << f]
            shapley[f] = shapley[f] + lost[:, 0]
            on |= 1 << f
            columns.append((f, states[:, on, 0], lost))
        named += [("".join(LETTERS[f] for f in order), i + 1) for i in range(n)]
    rows = [np.stack([kept, lost[:, 0], fails[f] - lost[:, 0], alone[f], lost[:, 1], lost[:, 2], shapley[f]], axis=1) for f, kept, lost in columns]
    return named, np.stack(rows, axis=1)


def failure_cells(documents: DataFrame, labels: DataFrame, filters: Sequence[Column | None], id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many rows of a part fail just the mask's
    filters, and how many of those are labelled good and toxic. Bit i is filter i; a
    filter that is None is that of copies."""
    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("t"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"))
    worded = source.select("id", "part", "t", F.expr(_WORDS).alias("w"))
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters) if f is not None]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = worded.select(F.unhex(F.md5("t")).alias("text"), "id", "part", mask.alias("mask"))
    rows = keep(rows.groupBy("text", "id", "part", "mask").agg(F.count("*").alias("n")), "rows")
    named, nameless = rows.where("id is not null"), rows.where("id is null")
    for bit in (1 << i for i, f in enumerate(filters) if f is None):
        firsts = named.groupBy("text").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        copy = F.when(F.col("first").isNull(), F.lit(bit)).otherwise(F.lit(0))
        named = named.join(firsts, ["text", "id"], "left").withColumn("mask", F.col("mask") + copy).drop("first")
    marks = labels.select(F.col(id_column).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("id is not null").groupBy("id").agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("bad"))
    marks = keep(marks.where("good or bad"), "marks")
    named = named.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(checked_broadcast(marks, marks.count(), 32), "id", "left")
    every = named.select("part", "mask", "n", "good", "bad").unionByName(nameless.select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("bad")))
    cells = every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0))).alias("good"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(F.lit(0))).alias("toxic")
    )
    cells = keep(cells, "cells")
    forget(rows)
    forget(marks)
    return cells


def audit(documents: DataFrame, labels: DataFrame, filters: Sequence[Column | None] | None = None, **columns: str) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (removals of the step's filter over all orders).

    Null texts are empty and so copies of empty ones; a null part is the empty string. A
    null id is neither smaller nor larger than another: its row fails no filter of copies
    and makes none fail. Rows that share an id and a text are no copies of each other.
    Labels that repeat an id count by their largest value; null labels are 0. Other columns
    are not read. An empty table has no part and gives no row; at most five filters.
    """
    filters = contract_filters() if filters is None else list(filters)
    if not 1 <= len(filters) <= len(LETTERS):
        raise ValueError(f"one to {len(LETTERS)} filters")
    cells = failure_cells(documents, labels, filters, **columns)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n at most
    size = 1 << len(filters)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                table = np.zeros((some.num_rows, size, 3), np.int64)
                for i, held in enumerate(some.column("cells").to_pylist()):
                    for c in held:
                        table[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                named, rows = order_steps(table)
                count = some.num_rows
                flat = rows.reshape(count * len(named), rows.shape[2])
                orders, steps = zip(*named, strict=True)
                part = np.repeat(np.array(some.column("part").to_pylist(), object), len(named))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array(list(orders) * count, pa.string()), pa.array(np.tile(np.array(steps, np.int32), count)), *(pa.array(flat[:, c].copy()) for c in range(flat.shape[1]))],
                    names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return parts.mapInArrow(expand, f"part string, filter_order string, step int, {counts}")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters on all documents, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(source, '') as part,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as least
  from documents),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
m as (
  select part, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(least < doc_id, false)::int as mask
  from d left join l using (doc_id)),
c as (
  select part, mask, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as toxic
  from m group by 1, 2),
f as (select i, chr(65 + i::int) as f from range(5) r(i)),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.i, b.i, c.i, d.i, e.i] as seq
  from f a join f b on b.i <> a.i join f c on c.i not in (a.i, b.i)
  join f d on d.i not in (a.i, b.i, c.i) join f e on e.i not in (a.i, b.i, c.i, d.i)),
s as (
  select filter_order, step, seq[step] as i, (1 << seq[step]::int) as bit,
    list_sum(list_transform(seq[1 : step - 1], lambda x: (1 << x::int)))::bigint as earlier
  from o, range(1, 6) r(step)),
p as (
  select part, filter_order, step::int as step, i,
    sum(n) filter ((mask & (coalesce(earlier, 0) | bit)) = 0) as kept,
    sum(n) filter ((mask & bit) <> 0 and (mask & coalesce(earlier, 0)) = 0) as removed,
    sum(n) filter ((mask & bit) <> 0 and (mask & coalesce(earlier, 0)) <> 0) as redundant,
    sum(n) filter (mask = bit) as unique_fails,
    sum(good) filter ((mask & bit) <> 0 and (mask & coalesce(earlier, 0)) = 0) as good_lost,
    sum(toxic) filter ((mask & bit) <> 0 and (mask & coalesce(earlier, 0)) = 0) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, i)::bigint as shapley
from p
"""
