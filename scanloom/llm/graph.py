"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import save

#: Rounds double the distance a label travels at least, so this is beyond any graph that fits a cluster.
MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    A step joins every node with the least node around it: large-star moves a node's larger
    neighbours there, small-star its smaller ones. Minima are aggregated before the shuffle and
    the join on a node's id can be split, so a node with very many edges is no single task's
    work. Each round's edges are written to the shared folder. Rows with nulls and loops are
    left out; repeated edges count once.
    """
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .filter("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        now = save(small_star(large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # (u, v) with v > u only: those neighbours move to the least node around u.
    return (edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
