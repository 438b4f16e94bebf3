"""Join-shaped operators. Small rule tables are row-wise conditions elsewhere; these are the joins between data tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """pages with their template by (domain, page_type), null where none was learnt."""
    return pages.join(templates, ["domain", "page_type"], "left")


def latest_fresh(asks: DataFrame, entries: DataFrame, key: str, ttl_s: int) -> DataFrame:
    """For each ask the latest entry of its key at or before it and not older than the time to live.

    As-of by union and one window per key: no comparison of all asks with all entries of a key.
    """
    a = asks.select(key, F.col("ask_ts").alias("ts"), "ask_id", F.lit(None).cast("string").alias("entry"), F.lit(1).alias("kind"))
    e = entries.select(key, F.col("entry_ts").alias("ts"), F.lit(None).cast("long").alias("ask_id"), F.col("entry").cast("string").alias("entry"), F.lit(0).alias("kind"))
    w = Window.partitionBy(key).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(e).withColumn("found", F.last(F.when(F.col("kind") == 0, F.struct("ts", "entry")), ignorenulls=True).over(w))
    fresh = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("found.ts").cast("timestamp")) <= ttl_s * 1_000_000
    return both.filter("kind = 1").select(key, "ask_id", F.when(fresh, F.col("found.entry")).alias("entry"))


def merge_findings(one: DataFrame, two: DataFrame, key: Column) -> DataFrame:
    """Findings of two scanners by key; those of both are of high severity, others medium."""
    a = one.select(key.alias("k")).distinct().withColumn("a", F.lit(True))
    b = two.select(key.alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("a") & F.col("b"), "high").otherwise("medium").alias("severity"))


def page_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or same for every key of two snapshots."""
    o = old.select(*keys, F.col(value).alias("old"), F.lit(1).alias("in_old"))
    n = new.select(*keys, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    verdict = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return o.join(n, keys, "full_outer").select(*keys, verdict.alias("verdict"))
