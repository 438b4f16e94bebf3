"""Window-shaped operators over chunk, line and event rows. Keys are page, session or domain; nothing runs over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_budget(rows: DataFrame, key: str, order: str, cost: Column, budget: Column) -> DataFrame:
    """Rows in order until the first whose running cost (each positive) would pass the budget."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_running", F.sum(cost).over(w)).filter(F.col("_running") <= budget).drop("_running")


def drop_to_budget(rows: DataFrame, key: str, weight: Column, depth: Column, pos: Column, size: Column, always: Column, budget: Column) -> DataFrame:
    """``kept``: the least weights go first (deepest first at equal weight, then by position) until the total fits; rows
    that always stay count but never go."""
    whole = Window.partitionBy(key)
    # rows that always stay sort last and so are never among the dropped
    order = Window.partitionBy(key).orderBy(always, weight, depth.desc(), pos).rowsBetween(Window.unboundedPreceding, -1)
    total, before = F.sum(size).over(whole), F.coalesce(F.sum(size).over(order), F.lit(0))
    return rows.withColumn("kept", always | (total - before <= budget))


def adjacent_boost(rows: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Boosted score and keep flag: neighbours within two places of a schema match and of the same, non-empty parent gain 0.15
    over the distance, at most once (the largest); dropped ones of 0.45 or more with 5 characters or more are kept."""
    w = Window.partitionBy(page).orderBy(pos)
    gain = F.lit(0.0)
    for distance in (1, 2):
        for near in (F.lag, F.lead):
            matched = near(F.col("reason") == "schema_match", distance, False).over(w) & (near("parent", distance).over(w) == F.col("parent")) & (F.col("parent") != "")
            gain = F.greatest(gain, F.when(matched, F.lit(0.15 / distance)).otherwise(0.0))
    out = rows.withColumn("score", F.least(F.col("score") + gain, F.lit(1.0))).withColumn("_gain", gain)
    flipped = ~F.col("keep") & (F.col("_gain") > 0) & (F.col("score") >= 0.45) & (F.length("text") >= 5)
    return out.withColumn("flipped", flipped).withColumn("keep", F.col("keep") | flipped).drop("_gain")


def islands(rows: DataFrame, key: str, order: str, value: str, name: str = "island") -> DataFrame:
    """Number of the run of equal consecutive values each row belongs to, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_s", starts).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def run_length(rows: DataFrame, key: str, order: str, flag: Column, name: str = "run") -> DataFrame:
    """Length so far of the current run of true flags; 0 at a false one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_f", flag).withColumn("_b", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    within = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(within)).drop("_f", "_b")


def repeats(events: DataFrame, session: str, ts: str, item: str) -> DataFrame:
    """same_as_last with gap_s, and again_gap_s since the last row of the same item in the session (null if none)."""
    micros = lambda a: F.unix_micros(a.cast("timestamp"))
    seconds = lambda a: F.round(micros(F.col(ts)) / 1e6 - micros(a) / 1e6, 3)
    w = Window.partitionBy(session).orderBy(ts, "event_id")
    v = Window.partitionBy(session, item).orderBy(ts, "event_id")
    return events.withColumn("same_as_last", F.coalesce(F.lag(item).over(w) == F.col(item), F.lit(False))).withColumn("gap_s", seconds(F.lag(ts).over(w))).withColumn("again_gap_s", seconds(F.lag(ts).over(v)))


def heading_blocks(chunks: DataFrame, most: int = 3) -> DataFrame:
    """Body blocks with the heading they stand under, the first ``most`` of each heading."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    under = chunks.withColumn("heading_pos", F.max(F.when(F.col("heading"), F.col("pos"))).over(w))
    body = under.filter("not heading").withColumn("n", F.row_number().over(Window.partitionBy("page_id", "heading_pos").orderBy("pos")))
    return body.filter(F.col("n") <= most)
