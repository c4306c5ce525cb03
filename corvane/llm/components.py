"""Connected components of an edge table, by alternating star contraction.

Each round re-points every node to the smallest node it has seen (first larger
neighbours, then smaller ones). Rounds grow with the logarithm of a component's
diameter; every round is two hash aggregates and a join, and no component is ever
gathered in one task: a row is an edge, and only minima per node are aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Point each larger neighbour v of u at the smallest node around u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point u and its smaller neighbours at the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    around = edges.join(least, "u")
    return (
        around.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _contract(edges: DataFrame) -> DataFrame:
    """edges(u, v), u > v, distinct -> (node, component) by repeated stars."""
    current, signature = edges, None
    while True:
        following = keep(_small_star(_large_star(current)), "edges")
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if current is not edges:
            forget(current)
        current = following
        if tuple(mark) == signature:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        signature = tuple(mark)


def _mapped(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between components instead of nodes, those within one left out."""
    for end in ("u", "v"):
        c = components.select(F.col("node").alias(end), "component")
        edges = edges.join(c, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, component): component is the smallest node that a
    path reaches. Self-loops, repeats and nulls are ignored; nodes without an
    edge are absent. An empty edge table gives an empty result.

    Dense groups have far more edges than nodes, so each node's edge to its smallest
    neighbour is contracted first - at most one edge a node - and then only the
    edges that still join different components."""
    given = edges.where("u is not null and v is not null and u <> v")
    given = keep(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    forest = keep(given.groupBy("u").agg(F.min("v").alias("v")), "edges")
    first = keep(_contract(forest), "components")
    forget(forest)
    # the smaller end of an edge may be nobody's smallest neighbour
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    placed = nodes.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rest = keep(_mapped(given, first), "edges")
    if rest.isEmpty():
        return placed
    second = keep(_contract(rest), "components")
    forget(rest)
    joined = placed.join(second.toDF("component", "whole"), "component", "left")
    return joined.select("node", F.coalesce("whole", "component").alias("component"))
