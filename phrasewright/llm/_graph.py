"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b), any direction, repeats allowed. Returns (node, root), root the smallest node.

    Alternates large-star and small-star steps (each a minimum by node and a join back) until
    the edges are a star around each root: a number of rounds logarithmic in the nodes. A minimum is
    pre-aggregated and written, so that both sides of a join are dealt for it alone and a hub's rows may
    be split: a hub is no task's alone.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # large-star: every greater neighbour of u goes to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        # small-star: every smaller neighbour of u, and u, go to the smallest of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"))
        met = large.join(low, F.col("u") == F.col("x"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        new = cut(small.distinct())
        # done when no node is both above one root and a root itself, and each has one
        stars = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty()
        e = new
        if stars:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
