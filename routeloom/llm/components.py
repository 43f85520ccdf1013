"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def _lowest(sym: DataFrame) -> DataFrame:
    """u and the lowest of u and its neighbours."""
    return sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """edges (u, v) of longs -> (node, label): each node that has an edge, with the lowest node it reaches.

    Every step is an aggregation with map-side combine and one join. The lowest
    neighbours are written before they are joined, so both sides of the join are
    plain exchanges, which adaptive execution splits where a hub has many rows. The number of steps grows with the logarithm of the
    diameter; it raises if ``most_rounds`` do not suffice.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(most_rounds):
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_lowest(sym), "least")
        large = written(sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = _lowest(large)  # the lowest of each node's lower neighbours
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        for x in (now, least, large):
            forget(x)
        now, after = new, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
