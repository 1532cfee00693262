"""Connected components by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): every id of the edges (a, b), with the smallest id that it reaches.

    Each round hangs neighbours on the least id around a node, first the larger ones, then the smaller ones; the number of
    rounds is logarithmic in practice.  A round is written to shared storage before the next.  Loops and null ends do not
    count; without edges the result is empty.
    """
    now = scratch.stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or not got[0]:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        mark = tuple(got)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, now = now, scratch.stage(small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        scratch.drop(before)
