"""Small shared pieces of the training-data operators.

Conventions used by every operator of this subpackage:

* a null text counts as the empty text, a null id stays null;
* input frames may carry extra columns of any name: operators address the id and text columns by
  parameter and keep their own working columns in separate frames or nested structs;
* an empty input gives an empty result with the same schema.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, as a regex class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where that is
    unset (local tests) a temporary one is made and set, so that checkpoint() works too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = context.getCheckpointDir()
    if not own:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-"))
        own = context.getCheckpointDir()
    return own.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, stem: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder and read it back (columnar and compressed, unlike a checkpoint); with its place."""
    path = new_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, stem: str) -> DataFrame:
    return stored_at(df, stem)[0]


@contextmanager
def small_batches(spark: SparkSession, most: int = 3 << 19) -> Iterator[None]:
    """Tables written in this block go to Python in batches of about ``most`` bytes (one row at least) and not of 10,000 rows: a
    batch of long texts is in memory several times, in the executor and in each of its workers. All rows are sent all the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before.rstrip("bB"))) if before.rstrip("bB").isdigit() else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(column: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that stored_at() wrote and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles and checkpoints that nothing refers to any more, now and not only when the driver
    happens to collect its garbage: iterative steps leave many."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
