"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.session import durable


def _both(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(turned)


def _star(pairs: DataFrame) -> DataFrame:
    """Every neighbour of a node, with the least of the node and its neighbours."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.join(least, "a")


def _large(edges: DataFrame) -> DataFrame:
    star = _star(_both(edges)).where("b > a")
    return star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    star = _star(down)
    own = star.select("a", F.col("m").alias("b"))
    other = star.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(other).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges (a, b); root is the least node of its component.

    A node of many edges is combined before the shuffle and its rows are split by the skew join.
    Each round is written to the checkpoint folder; the number of rounds grows with the
    logarithm of the longest chain. No edges: no row.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        if not state["n"]:
            break
        edges = durable(_small(_large(edges)))
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
