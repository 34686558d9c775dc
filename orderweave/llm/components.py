"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations with partial sums and two joins; no vertex's neighbours are ever gathered, so a
hub is only a skewed join key, which adaptive execution splits. Each round's edges are written to the shared
folder; the number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with u > v, as (node, root): the least node of its component for every node that isn't it."""
    now = scratch.keep(edges.select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while True:
        low = now.select(F.col("v").alias("a"), F.col("u").alias("b")).union(now.select(F.col("u").alias("a"), F.col("v").alias("b")))
        low = low.groupBy("a").agg(F.min("b").alias("m"))
        large = now.join(low, now["v"] == low["a"]).select("u", F.least("v", "m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy(F.col("u").alias("a")).agg(F.min("v").alias("m"))
        small = large.join(least, large["u"] == least["a"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = scratch.keep(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        scratch.drop(now, large)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
