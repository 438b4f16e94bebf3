"""Sources, guards and sinks of page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import fixed


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(page_id, url, html) from Parquet."""
    return spark.read.parquet(path)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Nested site/page folders with raw.html and snapshot.json -> site_id, page_dir, url, html; pages without raw.html are absent,
    pages without JSON have a null url."""
    place = lambda k: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -k)
    html = spark.read.text(f"{root}/*/*/raw.html", wholetext=True).select(place(3).alias("site_id"), place(2).alias("page_dir"), F.col("value").alias("html"))
    meta = spark.read.schema("url string, site_id string, page_id string").json(f"{root}/*/*/snapshot.json", multiLine=True)
    meta = meta.select(place(3).alias("site_id"), place(2).alias("page_dir"), "url")
    return html.join(meta, ["site_id", "page_dir"], "left")


def batch_status(wanted: DataFrame, pages: DataFrame, most: int | None = 10) -> DataFrame:
    """One row per distinct wanted URL, first place kept: pos, url, page_id, status. A single request has ``most`` URLs at most (a limit
    of the feature); None takes a table of any size."""
    first = wanted.groupBy("url").agg(F.min("pos").alias("pos"))
    first = first.orderBy("pos").limit(most) if most else first
    joined = first.join(pages.select("url", "page_id", "html"), "url", "left")
    status = F.when(F.col("page_id").isNull(), "error: not found").when(F.octet_length("html") > fixed.MAX_HTML_BYTES, "error: too large").otherwise("ok")
    return joined.select("pos", "url", "page_id", status.alias("status"))


def guard(pages: DataFrame) -> DataFrame:
    """pages with their size in bytes, their number of start tags, and whether both are allowed."""
    size, tags = F.octet_length("html"), F.regexp_count("html", F.lit("<[a-zA-Z]"))
    return pages.select("page_id", size.alias("html_bytes"), tags.alias("tags"), ((size <= fixed.MAX_HTML_BYTES) & (tags <= fixed.MAX_DOM_NODES)).alias("allowed"))


def write_pages(digests: DataFrame, path: str, by: str = "site_id") -> None:
    """One folder per site, JSON lines inside; empty sections are left out."""
    digests.write.partitionBy(by).option("ignoreNullFields", "true").json(path)
