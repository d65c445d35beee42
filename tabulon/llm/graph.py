"""Connected components of an edge table by alternating star contractions.

Every round replaces the edges by fewer or flatter ones: first each node's larger neighbours are tied to the smallest
neighbour, then each node and its smaller neighbours are. Stars remain. Rounds are written to the shared folder, so
that lineage stays short; nothing but counts reaches the driver, which gives back what a round left in its memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b; any order, loops and repeats allowed): label is the smallest node reachable."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    flat = stored(edges.filter("a <> b").select(low.alias("v"), high.alias("u")).distinct())
    mark = None
    while True:
        both = flat.select("u", "v").union(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(smallest.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small.select(F.col("v"), F.col("u")))
        got = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stored(flat)
        flat = new
        cleaned(edges.sparkSession)
        if got == mark:
            break
        mark = got
    return flat.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").union(flat.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
