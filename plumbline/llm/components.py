"""Connected components by star contraction, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each node.

    A table of its own: the minimum is taken before edges are dealt, and a join
    with it can split a node of very many edges, which it couldn't if it shared
    its dealing with this aggregate.
    """
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    out = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    # A large star's edges go from a node to a lesser one.
    least = _least(edges)
    to_least = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(to_least.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that isn't its component's least node; the root is.

    Each round is a few joins over at most as many rows as edges, written to the
    shared scratch folder; rounds grow with the logarithm of the longest path.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        large = _large_star(now)
        discard(now)
        now, old = _small_star(large), mark
        discard(large)
        mark = _mark(now)
        if mark == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
