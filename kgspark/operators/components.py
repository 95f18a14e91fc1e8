"""Connected components of an edge table by alternating large-star and small-star rounds, each written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.storage import cut, discard

MAX_ROUNDS = 60


def _stars(edges: DataFrame, both: bool) -> tuple[DataFrame, DataFrame]:
    """Large star (``both``): larger neighbours of u go to the least of u's neighbourhood. Small star: the smaller ones do."""
    if both:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("c"), "m")
    least = cut(least, "star")
    joined = near.join(least, near.u == least.c)
    if both:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has columns u and v of one ordered type.

    Each round joins edges with the least neighbour of one end, so a hub is a join key with many edges on one side, which
    adaptive execution splits. Rounds are about logarithmic in the longest path; the loop ends when the edges stop changing.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        large, a = _stars(now, True)
        mid = cut(large.where("u <> v").distinct(), "large")
        small, b = _stars(mid, False)
        then = cut(small.where("u <> v").distinct(), "small")
        row = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for x in (now, a, mid, b):
            discard(x)
        now = then
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
