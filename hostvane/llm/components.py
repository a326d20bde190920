"""Connected components of an edge table, by alternating stars. DataFrame code only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.operators.joins import join_checked
from hostvane.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every node's larger neighbours to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the least of them. Edges go from ``a`` down to ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Loops, repeated edges, either direction and null ends are accepted; an edge with a null end links nothing,
    and a table without edges gives no rows. A node's neighbours are never gathered: each turn hangs them
    on the least neighbour with joins that adaptive execution splits when a node has very many, and writes the
    edges, whose number never grows. The number of turns grows with the logarithm of the longest path.
    """
    linked = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    ordered = linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(ordered.distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        large = materialize(_large_star(now).where("a != b").distinct(), "edges")
        now = materialize(_small_star(large).distinct(), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def with_component(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``nodes`` with the component of column ``key``; a node without links is its own."""
    found = components(edges).select(F.col("node").alias(key), "component")
    return join_checked(nodes, found, [key], "left").withColumn("component", F.coalesce("component", F.col(key)))
