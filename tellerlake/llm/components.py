"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its least node.

    Each round hangs every node's larger neighbours, then its smaller ones, below its least
    neighbour. Minima are taken map-side first, so a node with very many neighbours costs no
    single task more. Rounds go on until one changes nothing, as the method is sure to reach; their
    number grows with the logarithm of the nodes. Loops and repeated edges are allowed,
    rows with a null end are ignored. The graph stays on the executors; only a count and a
    checksum reach the driver, once a round.
    """
    now = cut(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_least, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        after = cut(small, "edges")
        drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            ends = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return ends.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
