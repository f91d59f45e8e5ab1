"""Connected components of a large edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut


def _least(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's smallest neighbour; partial sums meet before the shuffle, so hot keys are small."""
    return pairs.groupBy(key).agg(F.least(F.min(value), F.col(key)).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("n")).union(edges.select(F.col("v").alias("c"), F.col("u").alias("n")))
    far = both.join(_least(both, "c", "n"), "c").where("n > c")
    return far.select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("n"))
    near = down.join(_least(down, "c", "n"), "c")
    out = near.select(F.col("n").alias("u"), F.col("m").alias("v")).union(near.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches.

    `edges` has long columns u and v. Nodes without an edge do not appear; self
    loops, null ends and repeated edges do not matter; an empty table gives an
    empty one. The edges stay distributed: each round is two joins on the node
    and one checkpoint; only two numbers a round reach the driver.
    """
    edges = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    before = edges.select(mark.alias("s")).first()["s"]
    for _ in range(rounds):
        if not before["n"]:
            break
        edges = cut(_small_star(_large_star(edges)))
        after = edges.select(mark.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct()
