"""Connected components of an edge table by alternating large and small stars, each round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every end u of edges (u, v) of longs; root is the least value that u is linked with, itself included."""
    e = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        e = stored(_small(_large(e)), "stars")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select("u", F.col("v").alias("root")).union(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
