"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import checkpoint, sweep


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of every node of ``edges`` (columns a, b, long).

    A round joins nodes with the least of their neighbours; no node's neighbours are ever gathered in one row. The number of
    rounds grows with the logarithm of the longest path. Lineage is cut in each round by a reliable checkpoint.
    """
    now = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        now = checkpoint(small.distinct())
        sweep(now.sparkSession)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(new):
            break
        mark = tuple(new)
    return now.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
