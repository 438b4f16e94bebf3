"""Extraction of rows from raw HTML by built-in regex functions: no UDF, pages stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import fixed
from loomspan.functions import text, urls

_WS = r"[ \t\r\n]"


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def text_lines(pages: DataFrame) -> DataFrame:
    """page_id, pos, line: one row per visible text line."""
    return pages.select("page_id", F.posexplode(text.lines(F.col("html"))).alias("pos", "line"))


def jsonld_scripts(pages: DataFrame) -> DataFrame:
    """page_id, xpath, text: one META chunk per non-empty JSON-LD script."""
    found = _all(F.col("html"), rf"(?is)<script[^>]*type{_WS}*={_WS}*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", 1)
    rows = pages.select("page_id", F.posexplode(F.transform(found, text.trim)).alias("i", "text"))
    return rows.filter("text <> ''").select("page_id", F.format_string("/json-ld[%d]", "i").alias("xpath"), "text")


def og_meta(pages: DataFrame) -> DataFrame:
    """page_id, key, value: Open Graph entries in both attribute orders; the last value of a key holds."""
    one = rf"(?i)<meta[^>]*property{_WS}*={_WS}*[\"']og:([^\"']*)[\"'][^>]*content{_WS}*={_WS}*[\"']([^\"']*)[\"'][^>]*/?>"
    two = rf"(?i)<meta[^>]*content{_WS}*={_WS}*[\"']([^\"']*)[\"'][^>]*property{_WS}*={_WS}*[\"']og:([^\"']*)[\"'][^>]*/?>"
    pair = lambda pattern, k, v: F.arrays_zip(_all(F.col("html"), pattern, k).alias("k"), _all(F.col("html"), pattern, v).alias("v"))
    rows = pages.select("page_id", F.posexplode(F.concat(pair(one, 1, 2), pair(two, 2, 1))).alias("i", "e"))
    return rows.groupBy("page_id", F.concat(F.lit("og:"), F.col("e.k")).alias("key")).agg(F.max_by("e.v", "i").alias("value"))


#: Elements removed with their content before parsing.
REMOVED = ["script", "style", "noscript", "svg", "link", "path", "defs", "iframe"]


def clean(html: Column) -> Column:
    """Without comments and removed elements, blanks collapsed, trimmed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in REMOVED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}{_WS}*>", "")
        out = F.regexp_replace(out, rf"(?i)<{tag}\b[^>]*/>", "")
    return text.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), rf"\n{_WS}*\n+", "\n"))


def _attr(attrs: Column, name: str) -> Column:
    return F.nullif(text.trim(F.regexp_extract(attrs, rf"(?i){name}=[\"']([^\"']+)[\"']", 1)), F.lit(""))


def _label(attrs: Column, inner: Column) -> Column:
    words = F.regexp_replace(text.trim(F.regexp_replace(inner, "<[^>]+>", " ")), rf"{_WS}+", " ")
    return F.coalesce(_attr(attrs, "aria-label"), words)


#: Words of links that act.
CALLS = r"(?i)장바구니|카트|구매|구입|주문|담기|바로구매|add.to.(?:cart|bag|basket)|buy.now|purchase|checkout|order|size.guide|사이즈[ \t]*가이드|wishlist|위시리스트|찜"


def interactables(pages: DataFrame) -> DataFrame:
    """page_id, ref, role, name, affordance, options: buttons, acting links, inputs and selects, in this order.

    Of equal (role, lower-case name) the first stays; refs are numbered from 1 afterwards.
    """
    html = F.col("html")

    def paired(tag: str) -> Column:
        pattern = rf"(?is)<{tag}\b([^>]*)>(.*?)</{tag}>"
        return F.arrays_zip(_all(html, pattern, 1).alias("attrs"), _all(html, pattern, 2).alias("inner"))

    def rows(kind: int, found: Column) -> DataFrame:
        return pages.select("page_id", F.posexplode(found).alias("i", "e")).select("page_id", F.lit(kind).alias("kind"), "i", F.col("e.attrs").alias("attrs"), F.col("e.inner").alias("inner"))

    none = F.array().cast("array<string>")
    labelled = _label(F.col("attrs"), F.col("inner"))
    sized = (F.col("name") != "") & (F.length("name") <= 100)
    buttons = rows(0, paired("button")).filter(~F.col("attrs").rlike(r"(?i)type=[\"']hidden|disabled\b|style=[\"'][^\"']*display:[ \t]*none"))
    buttons = buttons.withColumn("name", labelled).filter(sized).select("page_id", "kind", "i", F.lit("button").alias("role"), "name", F.lit("click").alias("affordance"), none.alias("options"))
    links = rows(1, paired("a")).withColumn("name", labelled).filter(sized & (F.col("name").rlike(CALLS) | F.col("attrs").rlike(CALLS)))
    links = links.select("page_id", "kind", "i", F.lit("link").alias("role"), "name", F.lit("click").alias("affordance"), none.alias("options"))
    inputs = rows(2, F.transform(_all(html, r"(?i)<input\b([^>]*)>", 1), lambda a: F.struct(a.alias("attrs"), F.lit("").alias("inner"))))
    inputs = inputs.withColumn("type", F.coalesce(F.lower(F.nullif(F.regexp_extract("attrs", r"(?i)type=[\"']([A-Za-z0-9_]+)[\"']", 1), F.lit(""))), F.lit("text")))
    inputs = inputs.filter(~F.col("type").isin("hidden", "submit", "image", "reset")).withColumn("given", F.coalesce(*[_attr(F.col("attrs"), a) for a in ("aria-label", "placeholder", "name", "title")], F.lit("")))
    search = (F.col("type") == "search") | F.lower("given").contains("search")
    inputs = inputs.select("page_id", "kind", "i", F.when(search, "searchbox").otherwise("textbox").alias("role"), F.when(F.col("given") == "", F.col("type")).otherwise(F.col("given")).alias("name"), F.lit("type").alias("affordance"), none.alias("options"))
    selects = rows(3, paired("select"))
    options = F.filter(F.transform(_all(F.col("inner"), r"(?is)<option[^>]*>(.*?)</option>", 1), lambda o: text.unescape(text.trim(F.regexp_replace(o, "<[^>]+>", "")))), lambda o: o != "")
    selects = selects.select("page_id", "kind", "i", F.lit("combobox").alias("role"), F.coalesce(*[_attr(F.col("attrs"), a) for a in ("aria-label", "name", "id", "title")], F.lit("select")).alias("name"), F.lit("select").alias("affordance"), F.slice(options, 1, 10).alias("options"))
    every = buttons.unionByName(links).unionByName(inputs).unionByName(selects).withColumn("name", F.regexp_replace(text.unescape(F.col("name")), " ", " "))
    first = Window.partitionBy("page_id", "role", F.lower("name")).orderBy("kind", "i")
    kept = every.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "i")).alias("ref"), "role", "name", "affordance", "options")


# Image hints and exclusions.
HINTS = r"(?i)product|goods|item|detail|gallery|pdp|zoom|main[-_]?img|swiper|slide|hero|displayitem|prd_img|goods_img|primary[-_](?:img|image|photo)|upload\.wikimedia|article|content[-_]?img|featured|/media/(?:catalog|product|upload)/|/photos?/|m\.media-amazon\.com/images/I/|thumbnail[0-9]*\.coupang(?:cdn)?\.com|image\.msscdn\.net|sitem\.ssgcdn\.com"
EXCLUDED = r"(?i)icon|logo|favicon|wordmark|tagline|copyright|badge|shackle|disambig|padlock|protection[-_]shackle|banner|sprite|spacer|blank|separator|divider|ad[_\-]|tracking|pixel|1x1|beacon|scorecardresearch\.com|doubleclick\.net|google-analytics\.com|facebook\.com/tr|bat\.bing\.com|amazon-adsystem\.com|shields\.io|svg\+xml|data:image/(?:gif|svg)|flyout|fallback_CTA"
RESIZE = r"(?i)[?&](?:imwidth|imheight|w|h|width|height|size|sz|quality|q)=[0-9]+"


def picture_sources(pages: DataFrame) -> DataFrame:
    """page_id, url, i, priority, hint, j, src: the best candidate of each source of each picture element, by width or by density
    (a density counts 10,000 widths), the first of equal ones."""
    pictures = pages.select("page_id", "url", F.posexplode(_all(F.col("html"), r"(?is)<picture\b[^>]*>(.*?)</picture>", 1)).alias("i", "body"))
    sets = pictures.select("page_id", "url", (F.col("i") - 1_000_000).alias("i"), F.lit(False).alias("priority"), F.col("body").rlike(HINTS).alias("hint"), F.posexplode(_all(F.col("body"), r"(?i)<source\b[^>]*?\bsrcset=[\"']([^\"']+)[\"']", 1)).alias("j", "set"))
    parts = F.filter(F.transform(F.split("set", ","), text.trim), lambda p: p != "")
    size = lambda p, unit: F.nullif(F.regexp_extract(p, rf"[ \t]([0-9.]+){unit}$", 1), F.lit("")).try_cast("double")
    scored = F.transform(parts, lambda p, k: F.struct(F.coalesce(size(p, "w"), size(p, "x") * 10_000, F.lit(0.0)).alias("score"), (-k).alias("k"), F.regexp_extract(p, r"^([^ \t]+)", 1).alias("src")))
    return sets.select("page_id", "url", "i", "priority", "hint", "j", F.array_max(scored)["src"].alias("src")).filter("src is not null")


def images(pages: DataFrame, most: int = 10) -> DataFrame:
    """page_id, rank, url: up to ``most`` content images - decorative, tiny and excluded ones left out, one per canonical
    address (the largest), sorted by fetch priority, then hint, then order of appearance."""
    tags = pages.select("page_id", "url", F.posexplode(_all(F.col("html"), r"(?is)<img\b[^>]*?>")).alias("i", "tag"))
    tags = tags.filter(~F.col("tag").rlike(r"(?i)role=[\"'](?:presentation|none)[\"']|aria-hidden=[\"']true[\"']|\balt=[\"'][\"']"))
    side = lambda a: F.nullif(F.regexp_extract("tag", rf"(?i)\b{a}=[\"']?([0-9]{{1,9}})", 1), F.lit("")).cast("int")
    tags = tags.filter((F.coalesce(side("width"), F.lit(9999)) > 50) & (F.coalesce(side("height"), F.lit(9999)) > 50))
    srcset = F.filter(F.transform(F.split(F.regexp_extract("tag", r"(?i)\bsrcset=[\"']([^\"']+)[\"']", 1), ","), text.trim), lambda p: p != "")
    widths = F.transform(F.filter(srcset, lambda p: p.rlike(r"^[^ \t]+[ \t]+[0-9]+w$")), lambda p: F.regexp_extract(p, r"([0-9]+)w$", 1).cast("int"))
    tags = tags.filter(F.coalesce(F.array_max(widths), F.lit(0)).between(1, 99) == F.lit(False))
    priority = F.col("tag").rlike(r"(?i)\bfetchpriority=[\"']high[\"']")
    hint = F.col("tag").rlike(HINTS) | priority | F.col("tag").rlike(r"(?i)\bloading=[\"']eager[\"']")
    named = F.filter(F.array(*[F.regexp_extract("tag", rf"(?i)\b{a}=[\"']([^\"']+)[\"']", 1) for a in ("src", "data-src", "data-lazy-src", "data-original")]), lambda u: u != "")
    rows = tags.select("page_id", "url", "i", priority.alias("priority"), hint.alias("hint"), F.posexplode(F.concat(named, F.transform(srcset, lambda p: F.substring_index(p, " ", 1)))).alias("j", "src"))
    rows = rows.unionByName(picture_sources(pages))
    rows = rows.withColumn("src", text.unescape(text.trim(F.col("src")))).filter("src <> ''")
    absolute = F.lower("src").rlike("^(https?:)?//")
    rows = rows.filter((absolute | ~F.substring_index("src", "/", 1).contains(":")) & (F.length("src") <= fixed.MAX_URL) & ~F.col("src").rlike(EXCLUDED))
    rows = rows.filter(F.coalesce(F.nullif(F.regexp_extract("src", r"/([0-9]{1,9})px-", 1), F.lit("")).cast("int"), F.lit(9999)) > 50)
    base = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")))
    folder = F.regexp_replace(urls.path(F.col("url")), "[^/]*$", "")
    rows = rows.withColumn("src", F.when(F.col("src").startswith("//"), F.concat(F.lit("https:"), F.col("src"))).when(absolute, F.col("src")).when(F.col("src").startswith("/"), F.concat(base, F.col("src"))).otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), F.col("src"))))
    rows = rows.filter(~F.lower("src").endswith(".svg") | F.col("src").rlike(HINTS))
    canon = F.regexp_replace(F.regexp_replace("src", RESIZE, ""), "[?&]+$", "")
    size = F.coalesce(F.array_max(F.transform(_all(F.col("src"), r"(?i)[?&](?:imwidth|imheight|w|h|width|height|size|sz)=([0-9]{1,9})", 1), lambda n: n.cast("int"))), F.lit(0))
    place = F.struct(F.col("i"), F.col("j"))
    # the largest variant of a canonical address; the first one of equal size
    best = rows.groupBy("page_id", canon.alias("canon")).agg(F.max_by("src", F.struct(size, -F.col("i"), -F.col("j"))).alias("url"), F.bool_or("priority").alias("priority"), F.bool_or("hint").alias("hint"), F.min(place).alias("place"))
    order = Window.partitionBy("page_id").orderBy(F.col("priority").desc(), F.col("hint").desc(), "place")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("page_id", "rank", "url")


def pagination(pages: DataFrame) -> DataFrame:
    """page_id, max_page, total_text, has_next."""
    html = F.col("html")
    numbers = F.transform(_all(html, r"(?i)(?:href|action)=[\"'][^\"']*[?&](?:page|p|pg|pn|pageNo|pageNum|currentPage)=([0-9]{1,9})", 1), lambda n: n.cast("int"))
    total = F.nullif(F.regexp_extract(html, r"(?i)([0-9][0-9,]*[ \t]*(?:results?|items?|products?))", 1), F.lit(""))
    following = html.rlike(r"(?i)>(?:next|next page|load more|show more|다음|次へ|suivant|weiter|下一页|siguiente)<|aria-label=[\"'](?:next|next page|load more)[\"']|class=[\"'][^\"']*next[^\"']*[\"']")
    return pages.select("page_id", F.coalesce(F.array_max(numbers), F.lit(0)).alias("max_page"), total.alias("total_text"), following.alias("has_next"))
