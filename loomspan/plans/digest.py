"""The page digest: classification, locale, budget and pruned text of each page in one plan.

One scan: title, locale, budget, type and lines of a page are made in the row that holds it, and only then are the lines spread out.
The budget is one window a page; the plan's shuffles carry short lines and what is said once a page, never the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import fixed
from loomspan.functions import text, urls
from loomspan.operators import classify, windows

LINE_MIN, LINE_MAX, CHARS_PER_TOKEN, FILL = 5, 300, 4.0, 0.95


def basics(pages: DataFrame) -> DataFrame:
    """page_id, url, title, locale, multiplier, pruned_budget, total_budget."""
    rows = pages.select("page_id", "url", text.title(F.col("html")).alias("title"), urls.locale(F.col("url")).alias("locale"), text.multiplier(urls.locale(F.col("url")), F.col("html")).alias("m"))
    return rows.select("page_id", "url", "title", "locale", F.round("m", 3).alias("multiplier"), F.bround(fixed.PRUNED_TOKENS * F.col("m")).cast("long").alias("pruned_budget"), F.bround(fixed.TOTAL_TOKENS * F.col("m")).cast("long").alias("total_budget"))


def compress(lines: DataFrame, budget_tokens: int, least: int = LINE_MIN, most: int = LINE_MAX) -> DataFrame:
    """page_id, text: lines of at least ``least`` characters, cut to ``most``, until the budget is full."""
    cut = lines.withColumn("line", F.substring("line", 1, most)).filter(F.length("line") >= least)
    kept = windows.prefix_budget(cut, "page_id", "pos", F.length("line") + 1, F.lit(int(budget_tokens * CHARS_PER_TOKEN * FILL)))
    return kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("page_id", F.concat_ws("\n", F.col("l.line")).alias("text"))


def typed_lines(pages: DataFrame, **columns: Column) -> DataFrame:
    """page_id, page_type, given columns (made from url and html), pos, line: all from one scan; a page without lines has one row without."""
    made = classify.fence(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), **columns, lines=text.lines(F.coalesce(F.col("html"), F.lit(""))))
    rows = classify.classify(made, (*columns, "lines"))
    return rows.select("page_id", "page_type", *columns, F.posexplode_outer("lines").alias("pos", "line"))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, title, locale, page_type, pruned_budget, text, text_tokens of every page; a page without lines has an empty text.

    The text is held to the page's own budget, which follows its language.
    """
    url, html = F.col("url"), F.col("html")
    locale = urls.locale(url)
    rows = typed_lines(pages, title=text.title(html), locale=locale, pruned_budget=F.bround(fixed.PRUNED_TOKENS * text.multiplier(locale, html)).cast("long"))
    rows = rows.withColumn("line", F.substring("line", 1, LINE_MAX)).withColumn("_n", F.when(F.length("line") >= LINE_MIN, F.length("line") + 1).otherwise(0))
    run = F.sum("_n").over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    fits = (F.col("_n") > 0) & (run <= F.floor(F.col("pruned_budget") * (CHARS_PER_TOKEN * FILL)))
    rows = rows.withColumn("_part", F.when(fits, F.struct("pos", "line")))
    about = [F.first(c).alias(c) for c in ("title", "locale", "page_type", "pruned_budget")]
    out = rows.groupBy("page_id").agg(*about, F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["line"]), "\n").alias("text"))
    return out.select("page_id", "title", "locale", "page_type", "pruned_budget", "text", text.tokens(F.col("text")).alias("text_tokens"))


def prompt(digests: DataFrame, elements: DataFrame, images: DataFrame) -> DataFrame:
    """page_id, prompt: the sections a reader model gets, in order; empty sections are left out."""
    line = F.format_string("[%d] %s: %s (%s)", "ref", "role", "name", "affordance")
    actions = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ref", line.alias("l")))).alias("a")).select("page_id", F.concat_ws("\n", F.col("a.l")).alias("actions"))
    shown = images.filter("rank <= 5").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("i")).select("page_id", F.concat_ws("\n", F.col("i.url")).alias("pictures"))
    rows = digests.join(actions, "page_id", "left").join(shown, "page_id", "left")
    section = lambda name, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), body))
    head = F.concat(F.lit("Title: "), "title", F.lit("\nType: "), "page_type", F.lit("\nLocale: "), "locale")
    return rows.select("page_id", F.concat_ws("\n\n", head, section("Actions", F.col("actions")), section("Info", F.col("text")), section("Images", F.col("pictures"))).alias("prompt"))
