"""Connected components over an edge table, by alternating large-star and small-star steps.

Both steps only ever take the minimum over a node's neighbours, which combines before
the shuffle, and never gather a neighbourhood; nothing but two totals a round comes to
the driver (joins are merges: numbers are small in files, by which plans judge what to broadcast). Rounds end when an edge table equals its predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _tally(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b, both long): component is its smallest node.

    Null ends and self-loops are dropped; repeated edges count once; an empty table gives an empty one.
    """
    cur = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    before = _tally(cur)
    if before[0]:
        for _ in range(max_rounds):
            cur = written(_small_star(_large_star(cur)), "edges")
            now = _tally(cur)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return members.union(roots).groupBy("node").agg(F.min("component").alias("component"))
