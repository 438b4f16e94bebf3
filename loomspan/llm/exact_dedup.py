"""Exact dedup by deterministic block naming (native DataFrame code only).

A text is cut into blocks of fixed byte size. Equal blocks get one integer name: the distinct blocks are
sorted and numbered. Then adjacent names are paired, the distinct pairs sorted and numbered, and so on until
one name is left for each document: after round k a name stands for 2^k blocks. Names are given to
*contents*, never to hashes, so the final name is equal exactly when the text is.

Scale notes
-----------
* Each distinct block crosses the network once (map-side pre-aggregated); the occurrences travel with an
  8-byte key instead of the block. A key shared by two different blocks is found exactly and those few
  occurrences are matched by their full content, so the key can't merge different blocks.
* A hot block (a third of all rows) is pre-aggregated before the shuffle that names it; the join that hands names
  back is an ordinary equi-join whose hot key adaptive execution splits.
* The later rounds move 8 bytes a block. The number of rounds is the logarithm of the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import SPACE, checkpoint, sweep, text_of

BLOCK_BYTES = 4096


def _normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), f"[{SPACE}]+", " ")


def _blocks(text: Column, size: int) -> Column:
    """Array of the text's UTF-8 byte blocks; one empty block for the empty text."""
    raw = text.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(size))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Number the (already distinct) rows: sorted inside hash partitions, the partition gives the high bits."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_texts(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per distinct (id, normalised text): id, sha (binary), n_rows, n_blocks, name.

    (n_blocks, name) is equal for two rows exactly when their normalised texts are. ``key_bits`` narrows the
    travelling key; only tests lower it, to force shared keys.
    """
    key = (lambda b: F.xxhash64(b)) if key_bits == 64 else (lambda b: F.pmod(F.xxhash64(b), F.lit(1 << key_bits)))
    texts = docs.select(F.col(id_col).alias("id"), _normalised(text_col).alias("norm"))

    # Names of the distinct blocks; `names` is small (16 bytes a block) and read three times.
    blocks = texts.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block")).select(key(F.col("block")).alias("h"), "block")
    distinct = blocks.groupBy("h", "block").agg(F.lit(1).alias("one")).drop("one")
    names = checkpoint(_named(distinct, ["h", "block"]).select("h", "name"))
    shared = names.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")

    # Rows of equal id and text are one row with a count from here on.
    keyed = texts.select("id", F.sha2("norm", 256).alias("sha"), F.transform(_blocks(F.col("norm"), block_bytes), key).alias("keys"))
    rows = keyed.groupBy("id", "sha").agg(F.count("*").alias("n_rows"), F.first("keys").alias("keys"))
    rows = checkpoint(rows.withColumn("n_blocks", F.size("keys")))
    occurrences = rows.select("id", "sha", F.posexplode("keys").alias("pos", "h"))

    if shared.isEmpty():
        given = occurrences.join(names, "h").select("id", "sha", "pos", "name")
    else:  # some key stands for several blocks: match those by content
        full = texts.select("id", F.sha2("norm", 256).alias("sha"), F.posexplode(_blocks(F.col("norm"), block_bytes)).alias("pos", "block"))
        full = full.withColumn("h", key(F.col("block"))).join(shared, "h", "left_semi").dropDuplicates(["id", "sha", "pos"])
        apart = checkpoint(_named(distinct.join(shared, "h", "left_semi").groupBy("h", "block").agg(F.lit(1).alias("one")).drop("one"), ["h", "block"]))
        offset = names.agg(F.max("name")).first()[0] + 1
        given = occurrences.join(names.join(shared, "h", "left_anti"), "h").select("id", "sha", "pos", "name").unionByName(
            full.join(apart.withColumn("name", F.col("name") + F.lit(offset)), ["h", "block"]).select("id", "sha", "pos", "name")
        )

    top = rows.agg(F.max("n_blocks")).first()[0] or 1
    return _reduce(rows.select("id", "sha", "n_rows", "n_blocks"), given, top)


def _reduce(rows: DataFrame, given: DataFrame, top: int) -> DataFrame:
    """Name adjacent pairs again and again until every row has one name."""
    given = checkpoint(given.join(rows.select(F.col("id").alias("i"), F.col("sha").alias("s"), "n_blocks"), F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))).select("id", "sha", "pos", "name", F.col("n_blocks").alias("left")))
    done = given.filter("left = 1").select("id", "sha", "name")
    rest = given.filter("left > 1")
    while top > 1:
        pairs = rest.groupBy("id", "sha", (F.col("pos") / 2).cast("int").alias("pos"), "left").agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = checkpoint(pairs.withColumn("left", F.ceil(F.col("left") / 2).cast("int")))
        names = _named(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), ["a", "b"])
        rest = checkpoint(pairs.join(names, ["a", "b"]).select("id", "sha", "pos", "name", "left"))
        done = done.unionByName(rest.filter("left = 1").select("id", "sha", "name"))
        rest = rest.filter("left > 1")
        top = (top + 1) // 2
        sweep(rows.sparkSession)
    done = done.select(F.col("id").alias("i"), F.col("sha").alias("s"), "name")
    return rows.join(done, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))).drop("i", "s")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of white space by one space; null counts as empty.
    The smallest id of a group stays. Null ids sort last: a group of null ids only has a null keep_id. Of
    repeated rows (same id, same text) exactly one is kept. Empty input gives no rows.
    """
    named = name_texts(docs, id_col, text_col, block_bytes, key_bits)
    named = checkpoint(named)
    sweep(docs.sparkSession)
    groups = named.groupBy("n_blocks", "name").agg(F.min("id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    # joined by another key than grouped by: both sides are exchanged for the join, so a hot group's rows can be split
    whole = F.concat_ws("|", "n_blocks", "name").alias("whole")
    out = named.select("id", "sha", "n_rows", whole).join(groups.select(whole, "keep_id", "group_size"), "whole")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    first_null = F.col("keep_id").isNull() & F.col("id").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("copy") == 1) & ((F.col("id") == F.col("keep_id")) | first_null)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ).withColumn("kept", F.coalesce("kept", F.lit(False)))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns, whatever their names. Null texts count as empty, so one
    empty text stays; of rows repeated in full one stays; texts may have any length; an empty table stays empty."""
    columns = docs.columns
    # a null id and an empty string are different ids
    one = lambda i, sha: F.concat_ws("|", i.isNull().cast("string"), F.coalesce(i.cast("string"), F.lit("")), sha)
    verdict = exact_dedup(docs, id_col, text_col, block_bytes).filter("kept").select(one(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), one(F.col(id_col), F.sha2(_normalised(text_col), 256)).alias("_key"))
    # rows repeated in full (same id and text) pass the join together: one of them stays
    return row.join(verdict, "_key", "left_semi").dropDuplicates(["_key"]).select("row.*")
