"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _reattach(edges: DataFrame, scratch: Scratch, small: bool) -> DataFrame:
    """One star step. edges (u, v): each u joins the least of itself and its neighbours; its other neighbours move there."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    else:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = scratch.save(out.filter("u <> v").distinct(), "star")
    scratch.drop(least)
    return out


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links -> (node, root): root is the least node that node reaches. Only nodes with a link are returned.

    Rounds grow with the logarithm of the longest path. A hub with many links is a hot join key, which
    adaptive execution splits: both join sides are plain shuffles of written tables."""
    now = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        big = _reattach(now, scratch, small=False)
        scratch.drop(now)
        now = _reattach(big, scratch, small=True)
        scratch.drop(big)
        row = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
