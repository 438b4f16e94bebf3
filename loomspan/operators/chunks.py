"""All chunks of a page: what its head says (structured data, Open Graph, server data) and what its body is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import dom, extract, prompts

#: Places of head chunks, in front of those of the body.
_LD, _OG, _RSC = -2_000_000, -1_000_001, -1_000_000


def every_chunk(pages: DataFrame) -> DataFrame:
    """Rows as those of dom.chunks: one a JSON-LD script, one with all Open Graph values as attributes, one a script with dates, then the body's."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def head(rows: DataFrame, pos, xpath, tag: str, kind: str, text, attrs) -> DataFrame:
        return rows.select("page_id", pos.cast("int").alias("pos"), xpath.alias("xpath"), F.lit("").alias("parent_xpath"), F.lit(tag).alias("tag"), F.lit(kind).alias("kind"), F.lit(0).alias("depth"), F.lit(False).alias("in_main"), text.alias("text"), attrs.alias("attrs"))

    place = lambda xpath: F.regexp_extract(xpath, r"\[(\d+)\]", 1).cast("int")
    ld = extract.jsonld_scripts(pages)
    ld = head(ld, place("xpath") + _LD, F.col("xpath"), "script", "meta", F.col("text"), F.create_map(F.lit("type"), F.lit("application/ld+json")))
    og = extract.og_meta(pages).groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("og"))
    og = head(og, F.lit(_OG), F.lit("/og-meta"), "meta", "meta", F.array_join(F.transform(F.map_entries("og"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.col("og"))
    rsc = prompts.rsc_dates(pages)
    rsc = head(rsc, place("xpath") + _RSC, F.col("xpath"), "script", "rsc_data", F.col("text"), none)
    return dom.chunks(pages).unionByName(ld).unionByName(og).unionByName(rsc)
