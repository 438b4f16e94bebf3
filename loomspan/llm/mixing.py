"""Mixing sources to target weights by a low-discrepancy schedule (native DataFrame code only).

Slot i of the mix takes the point frac(i * golden ratio), read from a fixed 48-bit lattice (good for 2^48 slots, that is
2.8e17 words); the source whose interval of cumulative target shares holds that point owns the slot. The k-th slot of a source
takes the k-th block of that source's stream: its documents in shuffled (hash) order, passed over up to three times and cut
into blocks of equally many words. Slots beyond a source's quota are left out, and quota slots that the schedule
missed (a few, bounded by the discrepancy) are appended, so each source's words come to its target exactly.

Scale notes: no window runs over a whole source. Positions inside a source are two-step prefix sums: counts per
(source, bucket) are aggregated map-side, prefix sums run over those, and rows are only ordered inside a bucket.
Buckets are hash ranges of the shuffle order, so one source with a third of all rows spreads over all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import SPACE, checkpoint, text_of

#: 2^48 and the odd integer nearest to 2^48 divided by the golden ratio.
LATTICE = 1 << 48
STEP = 173961102589771
BLOCK_WORDS = 1024
LEAST_ROWS_PER_BUCKET = 1_000
MAX_EPOCHS = 3
#: Words of an output partition of mixed_rows, about.
PARTITION_WORDS = 8 << 20


def n_words(text: str) -> Column:
    """Number of maximal runs of non-space characters."""
    return F.size(F.filter(F.split(text_of(text), f"[{SPACE}]+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size -> with weight, target (double) and cap. One row a source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; a target
    stops at MAX_EPOCHS times its source's size and the excess goes to the others by weight until none is
    above. The fixed point is min(cap, level * weight): with sources ordered by cap / weight the capped ones come first.
    This table has a row for each source, not for each document, so one task may order it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", picked.cast("long")).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("weights_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source in this order that is not capped sets the level for all after it
    t = t.withColumn("fits", F.col("cap") * F.col("weights_left") >= F.col("left") * F.col("weight"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", F.col("left").alias("l"), F.col("weights_left").alias("w")))).over(every)
    t = t.withColumn("level", level)
    share = F.col("level.l") * F.col("weight") / F.col("level.w")
    return t.withColumn("target", F.when(F.col("fits"), share).otherwise(F.col("cap").cast("double"))).select("source", "source_size", "weight", "cap", "target")


def n_buckets(rows: int) -> int:
    """Buckets of a two-step prefix sum: about the square root of the rows in each, so that neither the rows of a bucket
    nor a source's list of buckets outgrows a task (170,000 of each at 30 billion rows)."""
    return max(1, rows // max(LEAST_ROWS_PER_BUCKET, math.isqrt(rows)))


def _prefix(rows: DataFrame, group: str, bucket: str, order: list[str], size: Column, name: str) -> DataFrame:
    """Exclusive running sum of ``size`` in (bucket, order) order inside each group, without a window over a group."""
    rows = rows.withColumn("_size", size)
    sums = rows.groupBy(group, bucket).agg(F.sum("_size").alias("_sum"))
    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    joined = rows.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")))
    return joined.withColumn(name, F.col("_base") + F.col("_in")).drop("_g", "_b", "_base", "_in", "_size")


def source_slots(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: source, k (rank among the source's slots), slot (its place in the mix), words.

    ``goals``: source, quota (whole words to take). Slots lie at the golden-ratio points; each source's last block
    is cut to its quota. Slots that the schedule misses stand at the end.
    """
    spark = goals.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    goals = goals.filter("quota > 0").withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    goals = goals.withColumn("hi", F.sum("blocks").over(order)).withColumn("lo", F.col("hi") - F.col("blocks"))
    goals = checkpoint(goals)
    total = goals.agg(F.max("hi")).first()[0] or 0
    # A slot lands in cell at * cells / total; a source's interval covers a run of cells: an equi-join on the
    # cell and an exact test of the interval, instead of a comparison of every slot with every source. All in whole numbers.
    cells = int(min(max(total, 1), 1 << 16))
    part_of = lambda x, times, of: F.expr(f"cast({x} as decimal(16,0)) * cast({times} as decimal(16,0)) div cast({of} as decimal(16,0))")
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", F.expr(f"(cast(slot as decimal(16,0)) * cast({STEP} as decimal(16,0))) % cast({LATTICE} as decimal(16,0))"))
    slots = slots.withColumn("at", part_of("point", total, LATTICE)).withColumn("cell", part_of("at", cells, max(total, 1))).drop("point")
    spans = goals.withColumn("cell", F.explode(F.sequence(part_of("lo", cells, max(total, 1)), part_of("hi - 1", cells, max(total, 1)))))
    owned = slots.join(spans, "cell").filter("at >= lo and at < hi").select("source", "slot", "blocks", "quota")
    chunk = max(1, -(-total // n_buckets(total)))
    owned = owned.withColumn("part", F.floor(F.col("slot") / chunk))
    ranked = checkpoint(_prefix(owned, "source", "part", ["slot"], F.lit(1), "k"))
    got = ranked.groupBy("source").agg(F.count("*").alias("n"))
    missed = goals.join(got.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < blocks")
    missed = missed.withColumn("k", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1))).withColumn("slot", F.lit(total) + F.col("lo") + F.col("k"))
    every = ranked.filter("k < blocks").select("source", "k", "slot", "quota").unionByName(missed.select("source", "k", "slot", "quota"))
    return every.withColumn("words", F.least(F.lit(block_words), F.col("quota") - F.col("k") * block_words))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), block_words: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: id, source, nth, size, source_size, target, taken, passes, n_slots - one row per input row. ``taken`` counts the
    words the mix takes from the row, repeats counted, MAX_EPOCHS times its size at most; a text without words takes 0.
    ``passes`` has the first slot of each pass over the source that takes words of the row, ``n_slots`` counts the slots it lies in.
    pieces: the mix itself - source, k, slot, id, nth, start, length: slot ``slot`` holds words [start, start + length)
    of that row's text. Rows repeated in full are told apart by nth (1, 2, ...). The shuffle order is an MD5 of seed and id (a null
    id counts as empty), then id, size and nth, so reruns agree. A null source is a source of its own, the last one. Texts may
    have any length; other columns are ignored. Empty input gives empty frames.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    # repeated rows: counted here, told apart by nth
    rows = base.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    rows = checkpoint(rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = checkpoint(targets(sizes, weights))
    parts = n_buckets(rows.count())
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    shuffled = rows.withColumn("code", code).withColumn("part", F.floor(F.col("code") * parts / F.lit(1 << 32)))
    placed = _prefix(shuffled, "source", "part", ["code", "id", "size", "nth"], F.col("size"), "at")
    placed = placed.join(goals.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "part", "code")
    placed = checkpoint(placed.withColumn("quota", F.floor("target").cast("long")))
    # the blocks each row lies in, for each pass over its source
    passes = placed.filter("size > 0").withColumn("pass", F.explode(F.expr(f"sequence(0, {MAX_EPOCHS - 1})"))).withColumn("from", F.col("pass") * F.col("source_size") + F.col("at")).filter("from < quota")
    cut = passes.withColumn("k", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.least(F.col("from") + F.col("size"), F.col("quota")) - 1) / block_words))))
    slots = source_slots(goals.select("source", F.floor("target").cast("long").alias("quota")), block_words)
    slots = slots.select(F.col("source").alias("_s"), F.col("k").alias("_k"), "slot", "words")
    pieces = cut.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k")))
    lo, hi = F.greatest(F.col("from"), F.col("k") * block_words), F.least(F.col("from") + F.col("size"), F.col("k") * block_words + F.col("words"))
    pieces = pieces.select("source", "k", "slot", "id", "size", "nth", "pass", (lo - F.col("from")).alias("start"), (hi - lo).alias("length")).filter("length > 0")
    taken = pieces.groupBy("id", "source", "size", "nth", "pass").agg(F.sum("length").alias("taken"), F.min_by("slot", "start").alias("slot"), F.count("*").alias("n"))
    taken = taken.groupBy("id", "source", "size", "nth").agg(F.sum("taken").alias("taken"), F.transform(F.array_sort(F.collect_list(F.struct("pass", "slot"))), lambda x: x["slot"]).alias("passes"), F.sum("n").alias("n_slots"))
    taken = taken.select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("nth").alias("_n"), "taken", "passes", "n_slots")
    out = placed.join(taken, F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("nth") == F.col("_n")), "left")
    out = out.select("id", "source", "nth", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("passes", F.array().cast("array<bigint>")).alias("passes"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))
    return out, pieces.drop("pass")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``docs`` with each row repeated taken / size times, rounded half up: whole texts, all columns, in the schedule's order.

    A copy of a row stands where the schedule has the first of its words in that pass: partitions follow each other by
    ranges of slots, and rows in a partition by slot. Rows alike in id, source and size share their passes evenly; a row without
    words is left out. Columns may have any names; an empty table stays empty.
    """
    verdict, _ = mix(docs, id_col, text_col, source_col, weights)
    # a null and an empty string are different ids and sources
    part = lambda c: F.concat(F.when(c.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(c.cast("string"), F.lit("")))
    key = lambda i, s, z: F.concat_ws("|", part(i), z.cast("string"), part(s))
    times = verdict.groupBy(key(F.col("id"), F.col("source"), F.col("size")).alias("_key")).agg(
        F.round(F.sum("taken") / F.greatest(F.lit(1), F.first("size")) / F.count("*")).cast("int").alias("_times"), F.min(F.struct("nth", "passes")).getField("passes").alias("_passes"), F.sum("taken").alias("_taken")
    )
    times = checkpoint(times.filter("_times > 0"))
    most = times.agg(F.max(F.array_max("_passes")), F.sum("_taken")).first()
    last, n = int(most[0] or 0), 1 + int(most[1] or 0) // PARTITION_WORDS
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(F.col(id_col), F.col(source_col), n_words(text_col)).alias("_key"))
    row = row.join(times, "_key").select("row", F.posexplode(F.slice("_passes", F.lit(1), F.greatest("_times", F.lit(1)))).alias("_pass", "_slot"))
    row = row.repartitionById(n, F.expr(f"cast(cast(_slot as decimal(16,0)) * {n} div {last + 1} as int)")).sortWithinPartitions("_slot", "_pass")
    return row.select("row.*")
