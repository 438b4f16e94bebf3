"""Documents as token-id files: tokenize, order by id, write coded segments, read them back.

Segments are the rows of a Parquet table (one binary column and its counts), so Spark's committer publishes them all or not
at all, and any store that Spark writes to will do. Each segment is a complete unit of the format in id_codec.

Scale notes: one range exchange by (id, hash of the text) puts documents in order, also where one id (or none) stands in many
rows; the number of its partitions follows the bytes of text. Tokenizing and coding happen after it in the same task,
a bounded run of text at a time, so ids are never shuffled. Places before a segment are a running sum over one short row a
partition, then over the segments of each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import id_codec
from loomspan.llm.common import text_of
from loomspan.llm.packed import release

#: Ids of a segment, about; a longer document is one segment.
SEGMENT_IDS = id_codec.LANES * id_codec.BLOCK
#: Text of a partition, about.
PARTITION_BYTES = 32 << 20


def write_ids(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write all documents in ascending order of id (nulls first), the end id after each one's ids.

    A null or empty text is the end id alone; rows repeated in full are written each; rows of one id stand in order of a hash
    of their texts. A document of any length is in one segment. Other columns are ignored. Empty input writes an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n = partitions or 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION_BYTES
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash")
    rows = rows.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loomspan.llm.tokens import encoded, encoder

        part, number = TaskContext.get().partitionId(), 0
        size = max(encoder(vocabulary, kind).edge.size, end_id + 1)
        names, lengths, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            every = np.concatenate(parts)
            parts.clear()
            segment = id_codec.encode(names, np.array(lengths, np.int64), every, size)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([segment], pa.binary())], names=["part", "number", "n_ids", "segment"])
            number, held = number + 1, 0
            release()
            names.clear(), lengths.clear()
            return row

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, flat, begin in encoded(vocabulary, kind, batch.column(1)):
                at = begin + np.arange(b - a + 1)
                every = np.full(at[-1], end_id, np.uint32)
                every[np.arange(len(flat)) + np.repeat(np.arange(b - a), np.diff(begin))] = flat
                if held and held + len(every) > SEGMENT_IDS:
                    yield flush()
                names += ids[a:b]
                lengths += np.diff(at).tolist()
                parts.append(every)
                held += len(every)
        if names:
            yield flush()

    rows.mapInArrow(run, "part int, number int, n_ids long, segment binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids as little-endian bytes)."""
    files = spark.read.schema("part int, number int, n_ids long, segment binary").parquet(path)
    counts = files.select("part", "number", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    starts = counts.withColumn("inside", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part")
    starts = starts.select("part", "number", (F.col("base") + F.col("inside")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, lengths, ids = id_codec.decode(batch.column(2)[i].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                pieces = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([batch.column(k)[i].as_py()] * len(names), pa.int32()) for k in (0, 1)]
                columns += [pa.array(names, pa.int64()), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                columns += [pa.array([bytes(p) for p in pieces], pa.binary())] * with_ids
                yield pa.record_batch(columns, names=["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                release()

    docs = files.select("part", "number", "segment").mapInArrow(run, "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = docs.join(starts, ["part", "number"]).withColumn("start", F.col("start") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
