"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.checkpoints import reliable


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of the component.

    A round is a pair of shuffles over the edges, checkpointed; the number of rounds grows with the logarithm of the
    longest chain. Raises if ``max_rounds`` do not settle the components, instead of returning unfinished ones.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    cur = reliable(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(u.alias("w"), F.least("u", "m").alias("m"))
        # large star: larger neighbours of a node, and the node itself, move to the smallest node around it
        moved = both.where(v > u).join(low, u == F.col("w")).select(v.alias("u"), m.alias("v"))
        large = moved.unionByName(cur.join(low, u == F.col("w")).select("u", m.alias("v"))).where(u != v).distinct()
        # small star: the smaller neighbours of a node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        both_ends = F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", m.alias("v")))
        small = large.join(least, u == F.col("w")).select(F.explode(both_ends).alias("e")).select("e.u", "e.v")
        cur = reliable(small.where(u != v).distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return cur.select(u.alias("node"), v.alias("root")).unionByName(cur.select(v.alias("node"), v.alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
