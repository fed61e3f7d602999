"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """id and component (least id of its component) for each id in the links (a, b).

    Every round links each node's greater, then its lesser neighbours to the least neighbour, until
    nothing changes: about log(n) rounds. Links stay distributed; each round is a written table, so a
    lost executor costs one round at most. No links give no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        edges = stored(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), "links")
    return edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component").unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
