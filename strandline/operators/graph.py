"""Connected components by alternating large and small stars, on DataFrames alone.

Each round halves distances towards the smallest node of a component, so the
number of rounds grows with the logarithm of the diameter.  Every aggregate has
a map-side part and the joins are plain equi-joins that AQE can split, so a hub
with many neighbours is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node with an edge reaches.

    Self-loops and rows with a null end are ignored, repeated edges count once.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"{src} is not null and {dst} is not null and {src} <> {dst}").distinct()
    e = scratch.save(e, "cc0")
    before, turn = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        turn += 1
        fresh = scratch.save(small, f"cc{turn % 2 + 1}-{turn}")
        now = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        e = fresh
        if now == before:
            break
        before = now
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select("v").distinct().join(nodes.select(F.col("node").alias("v")), "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots)
