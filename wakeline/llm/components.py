"""Connected components of an edge table, as alternating large-star and small-star rounds.

Both stars only ever replace an edge by one that points to a smaller node, so the edge table never
grows beyond its first size; rounds are logarithmic in the diameter for chains and one or two for
stars. Every round is a pair of shuffles on node ids, written to the shared folder; neither nodes
nor edges reach the driver, only a count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.skew import join_one
from wakeline.session import checkpoint


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = both.filter("v > u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_rows"))
    return join_one(up, least, ["u"], total=n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
    moved = join_one(down, least, ["u"], total=n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Null ends, loops and repeated edges take no part. A star's centre may hold any share of the edges: its
    edges are dealt over pieces for the joins. Raises if the rounds do not settle.
    """
    now = checkpoint(edges.select("u", "v").filter("u is not null and v is not null and u != v").distinct())
    seen, n = None, now.count()
    for _ in range(max_rounds):
        now = checkpoint(_small_star(_large_star(now, n), n))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
        if tuple(state) == seen:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen, n = tuple(state), state[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
