"""What a reader model gets: whole prompts and updates, from section columns; small pieces that feed them."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import terms
from loomspan.functions import text, urls
from loomspan.functions.text import tokens
from loomspan.operators import dom, extract, jsonld

# Limits of a prompt, and the least saving that makes an update worth sending.
OPTIONS, IMAGES, SAVING = 8, 5, 0.20
#: Removal reason -> region; regions that lost their text.
REGIONS = {"semantic-nav": "navigation", "role=navigation": "navigation", "semantic-header": "header", "role=banner": "header", "semantic-footer": "footer", "role=contentinfo": "footer", "semantic-aside": "complementary", "role=complementary": "complementary"}


def removed_regions(removed: DataFrame) -> DataFrame:
    """page_id, regions: the landmarks that pruning took away (removed nodes with their reason)."""
    table = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    return removed.filter("removed").groupBy("page_id").agg(F.array_sort(F.collect_set(table[F.col("reason")])).alias("regions"))


def element_line(options: Column) -> Column:
    """'[ref] role: name (affordance) options=[a,b...+n]' of an element."""
    shown = F.array_join(F.transform(F.slice(options, 1, OPTIONS), lambda o: text.sanitize(o, 100)), ",")
    more = F.when(F.size(options) > OPTIONS, F.concat(F.lit("...+"), (F.size(options) - OPTIONS).cast("string"))).otherwise(F.lit(""))
    list_ = F.when(F.size(options) > 0, F.concat(F.lit(" options=["), shown, more, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] "), "role", F.lit(": "), text.sanitize(F.col("name")), F.lit(" ("), "affordance", F.lit(")"), list_)


SECTIONS = ("warnings", "barrier", "diagnostics", "ecommerce", "actions", "navigation", "info", "images")
_HEADS = {"warnings": "## Warnings", "barrier": "## Barrier", "diagnostics": "## Diagnostics", "ecommerce": "## Ecommerce", "actions": "## Actions", "navigation": "## Navigation", "info": "## Info", "images": "## Images"}


def _header(page: Column) -> Column:
    title = F.when(F.coalesce(page["title"], F.lit("")) != "", F.concat(F.lit("\nTitle: "), text.sanitize(page["title"])))
    return F.concat(F.lit("URL: "), page["url"], F.coalesce(title, F.lit("")), F.lit("\nType: "), page["page_type"], F.lit("\n"))


def whole(page: Column) -> Column:
    """The prompt of struct(url, title, page_type, and one text for each of SECTIONS); empty sections are left out."""
    parts = [F.when(F.coalesce(page[s], F.lit("")) != "", F.concat(F.lit(_HEADS[s] + "\n"), page[s], F.lit("\n"))) for s in SECTIONS]
    return F.concat_ws("\n", _header(page), *parts)


def update(old: Column, new: Column) -> Column:
    """What changed between two prompts of a page: 'unchanged', or changed sections whole and the others in a word.

    Null where it would save less than a fifth of the whole prompt's tokens.
    """
    watched = ("ecommerce", "actions", "navigation", "info", "images")
    has = lambda s: F.coalesce(new[s], F.lit("")) != ""
    same = {s: old[s].eqNullSafe(new[s]) for s in watched}
    every = same["ecommerce"]
    for s in watched[1:]:
        every = every & same[s]
    count = lambda p: F.when(F.coalesce(p["actions"], F.lit("")) == "", 0).otherwise(F.size(F.split(p["actions"], "\n")))
    n, was = count(new), count(old)
    still = F.concat_ws("\n", F.lit("Page update\nStatus: unchanged"), F.when(n > 0, F.concat(F.lit("Refs: 1-"), n.cast("string"), F.lit(" still valid"))))
    actions = (
        F.when(n > was, F.concat(F.lit("- Actions: "), (n - was).cast("string"), F.lit(" new items ("), n.cast("string"), F.lit(" total)")))
        .when(n < was, F.concat(F.lit("- Actions: "), (was - n).cast("string"), F.lit(" removed items ("), n.cast("string"), F.lit(" total)")))
        .otherwise(F.concat(F.lit("- Actions: content updated ("), n.cast("string"), F.lit(" items)")))
    )
    told = {"ecommerce": "- Ecommerce: updated", "info": "- Info: content updated", "navigation": "- Navigation: updated", "images": "- Images: updated"}
    changes = F.concat_ws("\n", F.when(~same["actions"], actions), *[F.when(~same[s], F.lit(told[s])) for s in ("ecommerce", "info", "navigation", "images")])
    status = F.when(~same["actions"], F.lit("Status: updated | refs expired")).otherwise(F.lit("Status: updated"))
    head = F.concat(F.lit("Page update\n"), status, F.lit("\nChanges:\n"), changes, F.lit("\n\n"), _header(new))
    parts = []
    for s in watched:
        fresh = F.concat(F.lit(f"{_HEADS[s]} (updated)\n"), new[s], F.lit("\n"))
        kept = F.lit(f"{_HEADS[s]} — unchanged\n")
        if s == "actions":
            fresh = F.concat(F.lit("## Actions ("), n.cast("string"), F.lit(" total)\n"), new[s], F.lit("\n"))
            kept = F.concat(F.lit("## Actions — unchanged ("), n.cast("string"), F.lit(" items, refs [1]-["), n.cast("string"), F.lit("])\n"))
        parts.append(F.when(has(s), F.when(same[s], kept).otherwise(fresh)))
    made = F.concat_ws("\n", head, *parts)
    full = tokens(whole(new))
    return F.when(every, still).when((full - tokens(made)) / F.greatest(full, F.lit(1)) >= SAVING, made)


# pieces


def rsc_dates(pages: DataFrame) -> DataFrame:
    """page_id, xpath, text, html: scripts that push server data with dates in it; their body is cut to 500 characters."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>((?:(?!</script>).)*self\.__next_f\.push\((?:(?!</script>).)*\)(?:(?!</script>).)*)</script>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(scripts).alias("i", "body")).withColumn("dates", F.regexp_extract_all("body", F.lit(r"(\d{4}[-./]\d{1,2}[-./]\d{1,2})")))
    rows = rows.filter(F.size("dates") > 0)
    return rows.select("page_id", F.concat(F.lit("/rsc-data["), F.col("i").cast("string"), F.lit("]")).alias("xpath"), F.concat(F.lit("RSC dates: "), F.array_join("dates", ", ")).alias("text"), F.concat(F.lit("<script>"), F.substring("body", 1, 500), F.lit("</script>")).alias("html"))


def with_structured_image(images: Column, image: Column) -> Column:
    """The page's pictures with that of its structured data in front, if that one may be shown and isn't there yet; ten at most."""
    own = text.trim(image)
    allowed = (own != "") & (F.length(own) <= 2048) & (own.rlike(r"(?i)^(?:https?:)?//") | ~F.substring_index(own, "/", 1).contains(":")) & ~own.rlike(extract.EXCLUDED)
    plain = lambda u: F.regexp_replace(u, extract.RESIZE, "")
    new = F.coalesce(allowed & ~F.exists(images, lambda u: plain(u) == plain(own)), F.lit(False))
    return F.slice(F.when(new, F.concat(F.array(own), images)).otherwise(images), 1, 10)


_next = "|".join(">" + terms.any_of((t,)) + "<" for t in terms.NEXT_BUTTON + terms.LOAD_MORE)
_prev = "|".join(">" + terms.any_of((t,)) + "<" for t in terms.PREV_BUTTON)
NEXT = rf"(?i){_next}|aria-label=[\"'](?:{terms.any_of(terms.NEXT_BUTTON + terms.LOAD_MORE)})[\"']|class=[\"'][^\"']*next[^\"']*[\"']"
PREV = rf"(?i){_prev}|aria-label=[\"'](?:{terms.any_of(terms.PREV_BUTTON)})[\"']|class=[\"'][^\"']*prev[^\"']*[\"']"
#: How pages are counted in texts and links, and totals.
CURRENT = r"[Pp]age\s+(\d+)\s+(?:of|/)\s+(\d+)|페이지\s*(\d+)\s*/\s*(\d+)|(\d+)\s*/\s*(\d+)\s*페이지|(\d+)\s*/\s*(\d+)\s*ページ|[Ss]eite\s+(\d+)\s+(?:von|/)\s+(\d+)"
PARAM = r"(?i)(?:href|action)=[\"'][^\"']*[?&](?:page|p|pg|pn|pageNo|pageNum|currentPage)=(\d{1,9})"
TOTAL = r"(?i)총\s*[\d,]+\s*건|[\d,]+\s*(?:개의?\s*(?:상품|결과|검색결과|아이템|건))|\d[\d,]*\s*(?:results?|items?|products?)|(?:of|중)\s+[\d,]+|\d+-\d+\s+of\s+[\d,]+|\d[\d,]*\s*件の商品|\d[\d,]*\s*résultats|\d[\d,]*\s*produits|\d[\d,]*\s*Ergebnisse|\d[\d,]*\s*Produkte"


def pages_of(html: Column) -> Column:
    """struct(current_page, total_pages, total_items, has_next, has_prev); counts that aren't told are null."""
    number = lambda k: F.nullif(F.regexp_extract(html, CURRENT, k), F.lit("")).try_cast("int")
    current = F.coalesce(*[number(k) for k in (1, 3, 5, 7, 9)])
    last = F.greatest(F.coalesce(*[number(k) for k in (2, 4, 6, 8, 10)], F.lit(0)), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(PARAM), F.lit(1)), lambda x: x.cast("int"))), F.lit(0)))
    return F.struct(
        F.when(current > 0, current).alias("current_page"), F.when(last > 1, last).alias("total_pages"), F.nullif(text.trim(F.regexp_extract(html, f"({TOTAL})", 1)), F.lit("")).alias("total_items"),
        html.rlike(NEXT).alias("has_next"), html.rlike(PREV).alias("has_prev"),
    )


def site_hints(found: DataFrame) -> DataFrame:
    """(page_id, url, html, page_type, price_text, currency) with missing fields filled by the host's rules, in order, and which of them did."""
    out = found.withColumn("applied", F.array().cast("array<string>"))
    for name, host, types, field, pattern, group, value in jsonld.HINTS:
        made = F.lit(value) if pattern is None else F.nullif(F.trim(F.regexp_extract("html", pattern, group)), F.lit(""))
        fits = F.col("page_type").isin(*types) & urls.host(F.col("url")).contains(host) & (F.coalesce(F.col(field), F.lit("")) == "") & made.isNotNull()
        out = out.withColumn("_fits", F.coalesce(fits, F.lit(False)))
        out = out.withColumn("applied", F.when(F.col("_fits"), F.concat("applied", F.array(F.lit(name)))).otherwise(F.col("applied"))).withColumn(field, F.when(F.col("_fits"), made).otherwise(F.col(field)))
    return out.drop("_fits")


# baseline texts

#: Elements that a baseline drops, styles that hide, attributes that the semantic form keeps.
DROPPED = frozenset("script style svg noscript link meta path defs".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:[;\s]|$)|(?:width|height)\s*:\s*0(?:px)?(?:[;\s]|$)")
KEPT = ("href", "src", "alt", "title", "aria-label", "role", "type", "name", "value", "datetime", "content", "property")


def baseline(page: str, semantic: bool = False) -> str:
    """The page without code, comments and hidden elements, white space collapsed; ``semantic``: with few attributes and no lone wrappers."""

    def write(node: dom.Node) -> str:
        if node.tag in DROPPED or node.attrs.get("aria-hidden") == "true" or HIDDEN.search(node.attrs.get("style", "")):
            return ""
        inner = "".join(entities.escape(p, quote=False) if isinstance(p, str) else write(p) for p in node.parts)
        if semantic and node.tag == "div" and len(node.parts) == 1 and not isinstance(node.parts[0], str):
            return inner
        attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in node.attrs.items() if not semantic or k in KEPT)
        return f"<{node.tag}{attrs}>" if node.tag in dom.VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"

    root = dom.parse(page)
    body = "".join(entities.escape(p, quote=False) if isinstance(p, str) else write(p) for p in root.parts)
    return re.sub(r">\s+<", "> <", re.sub(r"\s+", " ", body)).strip()


def baselines(pages: DataFrame, most: int = 25_000) -> DataFrame:
    """page_id, strip, semantic: both baseline texts, cut to about ``most`` tokens (head and tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"page_id": pa.array([i], pa.int64()), "strip": [baseline(page)], "semantic": [baseline(page, True)]})

    out = pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, strip string, semantic string")
    return out.select("page_id", text.head_tail(F.col("strip"), most).alias("strip"), text.head_tail(F.col("semantic"), most).alias("semantic"))


def source_of(found: Column, jsonld_fields: Column, has_og: Column) -> Column:
    """Where a page's metadata came from, by their keys (internal ones aside): JSON-LD where two agree or the name does, else Open Graph or itemprop."""
    keys = F.array_except(found, F.array(F.lit("items")))
    both = F.array_intersect(keys, jsonld_fields)
    return F.when(F.size(keys) == 0, "").when((F.size(both) >= 2) | F.array_contains(both, "name"), "json_ld").when(F.array_contains(keys, "name"), F.when(has_og, "og").otherwise("itemprop")).otherwise("")
