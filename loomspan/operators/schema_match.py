"""Which chunks of a page its schema wants, and the full prune rules.

A matcher is a table of (field, reason, condition): conditions are columns over a chunk, so all eight are evaluated in one projection, and
a new schema is a new entry of MATCHERS. Chunks are rows of dom.chunks (with page_id, pos, xpath, tag, kind, in_main, text, attrs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import terms
from loomspan.functions.text import DENSE

# Least lengths by rule, and the limit of product prices outside main.
LIMITS = {
    "in_main_text": 50, "in_main_media": 10, "no_main_text": 30, "no_main_form": 20, "no_main_media": 20,
    "news_body": 50, "wiki_summary": 100, "wiki_section": 30, "saas_desc": 50, "gov_body": 30, "faq_body": 30, "event_desc": 50, "local_biz_desc": 50,
}
PRICES, SHARED_STEPS = 10, 3
# Patterns.
_any = terms.any_of
PRICE = rf"(?:{_any(terms.PRICE)}|,\d{{3}}|\d{{1,3}}(?:,\d{{3}})+)"
DATE = r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"
RATING = rf"(?i)(?:{_any(terms.RATING)}|\d\.\d)"
REVIEWS = rf"(?i)\d+\s*(?:{_any(terms.REVIEW_COUNT)})"
DEPARTMENT = rf"(?i)(?:{_any(tuple(t for t in terms.DEPARTMENT if t != '원'))}|(?<!\d )(?<![,\d])원(?![,\d]))"
LOCATION = r"(?i)장소|위치|주소|venue|location|address|会場|場所|lieu|adresse|Veranstaltungsort|Ort|Adresse"
ADDRESS = r"(?i)주소|위치|address|location|住所|所在地|adresse|Adresse|Standort"
HOURS = r"(?i)영업시간|운영시간|hours|opening hours|business hours|営業時間|horaires|Öffnungszeiten"
PHONE = r"[\+\(]?\d[\d\-\(\)\s]{6,}"
PRODUCT_CLASS = r"(?i)(?:product|goods|item)[-_]?(?:name|title|info|card|unit|detail|summary)"
NAME_CLASS = r"(?i)(?:product|goods|item)[-_]?(?:name|title)"
SHORT = "|".join((rf"(?i)(?:{_any(terms.AVAILABILITY)}", _any(terms.SHIPPING), r"(?:only|just|남은|残り|seulement|nur)\s*\d+", rf"\d+\s*%\s*(?:{_any(terms.DISCOUNT)}))"))
MEASURE = r"(?i)\d+\.?\d*\s*(?:cm|mm|인치|inch|inches|kg|g|lb|oz|%|″|′|‴|ml|L)|\b(?:XS|S|M|L|XL|XXL|2XL|3XL|FREE|총장|가슴[단둘]레|어깨[너폭]비|소매[길장]이|허리[단둘]레|hip|waist|chest|shoulder|sleeve|length|inseam)\b"


class _Chunk:
    """Columns of a chunk that conditions speak about."""

    text = property(lambda self: F.col("text"))
    tag = property(lambda self: F.col("tag"))
    kind = property(lambda self: F.col("kind"))
    main = property(lambda self: F.col("in_main"))

    def attr(self, name: str) -> Column:
        return F.coalesce(F.col("attrs")[name], F.lit(""))

    def prop(self, name: str) -> Column:
        return self.attr("itemprop") == name

    def og(self, name: str) -> Column:
        return (self.kind == "meta") & (self.attr(name) != "")

    def says(self, pattern: str) -> Column:
        return self.text.rlike(pattern)

    def long_text(self, limit: str) -> Column:
        return (self.kind == "text_block") & (F.length(self.text) > LIMITS[limit])


Chunk = _Chunk()
Matcher = Callable[[], list[tuple[str, str, Column]]]


def _product() -> list[tuple[str, str, Column]]:
    c, words = Chunk, F.lower(Chunk.attr("class"))
    return [
        ("name", "h1/itemprop/og:title", (c.tag == "h1") | c.prop("name") | c.og("og:title")),
        ("name", "class=product-name", words.rlike(NAME_CLASS)),
        ("price", "price-pattern", c.says(PRICE) & c.says(r"\d")),
        ("price", "itemprop=price", c.prop("price")),
        ("price", "class=price", words.contains("price")),
        ("product_card", "class=product-card", words.rlike(PRODUCT_CLASS)),
        ("rating", "rating-pattern", c.says(RATING) | c.prop("ratingValue")),
        ("review_count", "review-count-pattern", c.says(REVIEWS) | c.prop("reviewCount")),
        ("brand", "brand-pattern", c.prop("brand") | c.says(f"(?i){_any(terms.BRAND)}")),
    ]


def _news() -> list[tuple[str, str, Column]]:
    c = Chunk
    return [
        ("headline", "h1/itemprop/og:title", ((c.tag == "h1") | c.prop("headline") | c.og("og:title")) & (c.tag != "h2")),
        ("section_heading", "h2-section", c.tag == "h2"),
        ("date_published", "time-element", (c.tag == "time") | (c.attr("datetime") != "")),
        ("date_published", "date-pattern", c.says(DATE)),
        ("date_published", "rsc-data", c.kind == "rsc_data"),
        ("author", "author-pattern", c.prop("author") | c.says(f"(?i){_any(terms.REPORTER)}")),
        ("article_body", "long-text-block", c.long_text("news_body")),
        ("publisher", "meta-chunk", c.kind == "meta"),
    ]


def _wiki() -> list[tuple[str, str, Column]]:
    c = Chunk
    return [
        ("title", "h1/og:title", (c.tag == "h1") | c.og("og:title")),
        ("summary", "long-text-block", c.long_text("wiki_summary")),
        ("sections", "heading", c.kind == "heading"),
        ("sections", "section-text", c.long_text("wiki_section")),
    ]


def _saas() -> list[tuple[str, str, Column]]:
    c, priced, feature = Chunk, Chunk.says(f"(?i){_any(terms.PRICING)}"), Chunk.says(f"(?i){_any(terms.FEATURE)}")
    return [
        ("name", "h1/og:title", (c.tag == "h1") | c.og("og:title") | c.og("og:site_name")),
        ("pricing", "pricing-pattern", priced),
        ("pricing", "pricing-table", (c.kind == "table") & priced),
        ("features", "feature-list", (c.kind == "list") & feature),
        ("features", "feature-heading", (c.kind == "heading") & feature),
        ("description", "long-text", c.long_text("saas_desc")),
    ]


def _government() -> list[tuple[str, str, Column]]:
    c = Chunk
    return [
        ("title", "h1/og:title", (c.tag == "h1") | c.og("og:title")),
        ("department", "og:site_name", c.og("og:site_name")),
        ("department", "department-pattern", c.says(DEPARTMENT)),
        ("contact_info", "contact-pattern", c.says(f"(?i){_any(terms.CONTACT)}")),
        ("description", "body-text-in-main", c.long_text("gov_body") & (c.main | F.lower("parent_xpath").contains("article"))),
        ("date", "date-pattern", c.says(DATE) | (c.attr("datetime") != "")),
    ]


def _faq() -> list[tuple[str, str, Column]]:
    c = Chunk
    return [
        ("title", "h1", c.tag == "h1"),
        ("question", "h2/h3-heading", c.tag.isin("h2", "h3")),
        ("question", "question-mark", c.says("[?？]")),
        ("question", "details-summary", c.tag.isin("details", "summary")),
        ("answer", "long-text-block", c.long_text("faq_body")),
    ]


def _event() -> list[tuple[str, str, Column]]:
    c = Chunk
    return [
        ("name", "h1", c.tag == "h1"),
        ("date", "time-element", (c.tag == "time") | (c.attr("datetime") != "")),
        ("date", "date-pattern", c.says(DATE)),
        ("location", "location-keyword", c.says(LOCATION)),
        ("price", "price-pattern", c.says(PRICE) & c.says(r"\d")),
        ("description", "long-text-block", c.long_text("event_desc")),
    ]


def _local() -> list[tuple[str, str, Column]]:
    c = Chunk
    return [
        ("name", "h1", c.tag == "h1"),
        ("address", "address-keyword", c.says(ADDRESS)),
        ("telephone", "phone-pattern", c.says(PHONE)),
        ("opening_hours", "hours-keyword", c.says(HOURS)),
        ("rating", "rating-pattern", c.says(RATING)),
        ("description", "long-text-block", c.long_text("local_biz_desc")),
    ]


#: The registry: a new schema's matcher is put in here.
MATCHERS: dict[str, Matcher] = {"Product": _product, "NewsArticle": _news, "WikiArticle": _wiki, "SaaSPage": _saas, "GovernmentPage": _government, "FAQPage": _faq, "Event": _event, "LocalBusiness": _local}


def matches(schema: Column) -> Column:
    """array<struct(field, reason)> of what the page's schema finds in a chunk, in the matcher's order."""
    kind = "array<struct<field:string,reason:string>>"
    out = F.when(F.lit(False), F.array().cast(kind))
    for name, rules in MATCHERS.items():
        found = F.array(*[F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(r).alias("reason"))) for f, r, cond in rules()])
        out = out.when(schema == name, F.array_compact(found))
    return F.coalesce(out, F.array().cast(kind))


#: Reason -> (kept, score).
REASONS = {
    "meta_always": (True, 1.0), "schema_match": (True, 0.9), "in_main_heading": (True, 0.85), "in_main_hv_short": (True, 0.75), "in_main_text": (True, 0.7),
    "in_main_structured": (True, 0.7), "in_main_form": (True, 0.65), "in_main_media": (True, 0.6), "keep_heading_no_main": (True, 0.6), "keep_text_no_main": (True, 0.55),
    "keep_form_no_main": (True, 0.5), "keep_media_no_main": (True, 0.45), "recommendation": (False, 0.0), "in_main_short": (False, 0.0), "no_match": (False, 0.0),
}


def prune(chunks: DataFrame, schema_col: str = "schema", alpha: float = 1.0) -> DataFrame:
    """chunks (with the page's schema) with matched, reason, keep and score: the first rule that fits.

    Of a product page the prices are numbered: beyond the tenth, outside main and far from the first one they are taken for
    recommendations. One window a page; ``alpha`` scales the least lengths.
    """
    least = {k: max(1, int(v * alpha)) for k, v in LIMITS.items()}
    page = Window.partitionBy("page_id")
    order = page.orderBy("pos")
    out = chunks.withColumn("_m", matches(F.col(schema_col))).withColumn("_main", F.max(F.col("in_main").cast("int")).over(page) == 1)
    filled = (F.length("text") > 0) | (Chunk.attr("content") != "")
    out = out.withColumn("_hit", (F.size("_m") > 0) & filled & ~F.col("kind").isin("meta", "rsc_data"))
    priced = F.col("_hit") & (F.col(schema_col) == "Product") & F.exists("_m", lambda x: x["field"] == "price")
    out = out.withColumn("_priced", priced)
    out = out.withColumn("price_no", F.when(F.col("_priced"), F.sum(F.col("_priced").cast("int")).over(order)))
    out = out.withColumn("_first", F.first(F.when(F.col("_priced"), F.col("xpath")), ignorenulls=True).over(order))
    steps = F.split(F.regexp_replace("xpath", "^/", ""), "/")
    same = F.zip_with(F.split(F.regexp_replace("_first", "^/", ""), "/"), steps, lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    n, kind, main = F.length("text"), F.col("kind"), F.col("_main") & F.col("in_main")
    short, measure = F.col("text").rlike(SHORT), F.col("text").rlike(MEASURE)
    rules = [
        (kind.isin("meta", "rsc_data"), "meta_always"),
        (F.col("_priced") & (F.col("price_no") > PRICES) & ~F.col("in_main") & (shared < SHARED_STEPS), "recommendation"),
        (F.col("_hit"), "schema_match"),
        (main & (kind == "heading"), "in_main_heading"),
        (main & (kind == "text_block") & (n > least["in_main_text"]), "in_main_text"),
        (main & (kind == "text_block") & short, "in_main_hv_short"),
        (main & kind.isin("table", "list") & (n > least["in_main_text"]), "in_main_structured"),
        (main & kind.isin("table", "list") & (short | measure), "in_main_hv_short"),
        (main & (kind == "form"), "in_main_form"),
        (main & (kind == "media") & (n > least["in_main_media"]), "in_main_media"),
        (main, "in_main_short"),
        (~F.col("_main") & (kind == "heading"), "keep_heading_no_main"),
        (~F.col("_main") & (kind == "text_block") & (n > least["no_main_text"]), "keep_text_no_main"),
        (~F.col("_main") & (kind == "form") & (n > least["no_main_form"]), "keep_form_no_main"),
        (~F.col("_main") & (kind == "media") & (n > least["no_main_media"]), "keep_media_no_main"),
    ]
    reason = F.lit("no_match")
    for cond, name in reversed(rules):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    out = out.withColumn("reason", reason).withColumn("matched", F.when(F.col("reason").isin("schema_match", "recommendation"), F.transform("_m", lambda x: x["field"])))
    out = out.withColumn("keep", F.col("reason").isin([r for r, (kept, _) in REASONS.items() if kept]))
    score = F.create_map(*[F.lit(x) for r, (_, s) in REASONS.items() for x in (r, s)])[F.col("reason")]
    return out.withColumn("score", score).drop("_m", "_main", "_hit", "_priced", "_first")


def reason_counts(pruned: DataFrame) -> DataFrame:
    """page_id, reason, kept, removed."""
    return pruned.groupBy("page_id", "reason").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("removed"))


# tiers

#: What a task prefers - text density, link density, interactive share, semantic weight.
TASKS = {"search": (0.3, 0.8, 0.6, 0.7), "detail": (0.9, 0.2, 0.3, 0.8), "cart": (0.2, 0.3, 0.9, 0.5), "form": (0.4, 0.1, 1.0, 0.6), "general": (0.5, 0.5, 0.5, 0.5)}


def vector(html: Column) -> Column:
    """Four features of a chunk, each from 0 to 1: text density, links a word, interactive share, semantic weight."""
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    a = Chunk.attr
    weight = sum((F.when(cond, x).otherwise(0.0) for cond, x in ((a("itemprop") != "", 0.4), (a("role") != "", 0.2), (F.col("in_main"), 0.2), (F.col("kind") == "heading", 0.1), (a("aria-label") != "", 0.1))), F.lit(0.0))
    cap = lambda x: F.least(x.cast("double"), F.lit(1.0))
    features = [
        cap(F.length("text") / F.greatest(F.length(html), F.lit(1))),
        cap(count(r"(?i)<a\b") / F.greatest(words, F.lit(1))),
        cap(F.when(F.col("kind") == "form", 0.5).otherwise(0.0) + count(r"(?i)<(?:input|button|select|textarea)\b") * 0.2),
        cap(weight),
    ]
    return F.when((F.length("text") == 0) & (F.length(html) == 0), F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(*features))


def fitness(v: Column, task: Column | str, reason: Column) -> Column:
    """Cosine of a chunk with its task's preference; page data always fits, a schema match at least half."""
    t = F.lit(task) if isinstance(task, str) else task
    table = F.create_map(*[x for k, w in TASKS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in w]))])
    wanted = F.coalesce(table[F.lower(F.trim(t))], table["general"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(wanted, wanted))
    sim = F.when(norm > 0, dot(v, wanted) / norm).otherwise(F.lit(0.0))
    return F.when(reason == "meta_always", F.lit(1.0)).when(reason == "schema_match", F.greatest(sim, F.lit(0.5))).otherwise(sim)


def tiers(pruned: DataFrame, pressure: Column | float = 1.0) -> DataFrame:
    """pruned chunks (with fitness) with their tier: A whole, B shortened, C named only. A page without A and B has all A."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(pressure) if isinstance(pressure, (int, float)) else pressure))
    a, b = 0.8 - 0.15 * p, 0.4 - 0.15 * p
    f = F.coalesce("fitness", F.lit(0.0))
    tier = (
        F.when(~F.col("keep"), None)
        .when(F.col("reason") == "meta_always", "A")
        .when((F.col("reason") == "schema_match") & (f >= a * 0.75), "A")
        .when(f >= a, "A")
        .when(F.col("reason").isin("in_main_heading", "keep_heading_no_main"), "B")
        .when(f >= b, "B")
        .otherwise("C")
    )
    out = pruned.withColumn("_t", tier)
    some = F.max(F.col("_t").isin("A", "B").cast("int")).over(Window.partitionBy("page_id"))
    return out.withColumn("tier", F.when(F.col("keep") & (F.coalesce(some, F.lit(0)) == 0), "A").otherwise(F.col("_t"))).drop("_t")


#: Fixed value: where a sentence ends.
SENTENCE = r"(?<=[.!?])\s+|(?<=[。！？])\s*|(?<=[다요]\.)\s+"


def shorten(kind: Column, text: Column, html: Column) -> Column:
    """struct(text, html) of tier B: two sentences, three rows or items, 200 characters; what was left out is counted."""
    keep = F.struct(text.alias("text"), html.alias("html"))
    both = lambda x, y: F.struct(x.alias("text"), y.alias("html"))
    sentences = F.split(text, SENTENCE)
    two = F.concat(F.trim(F.array_join(F.slice(sentences, 1, 2), " ")), F.lit("..."))
    rows, items = F.regexp_extract_all(html, F.lit(r"(?is)(<tr\b[^>]*>.*?</tr>)")), F.regexp_extract_all(html, F.lit(r"(?is)(<li\b[^>]*>.*?</li>)"))
    head = F.regexp_extract(html, r"(?is)(<thead\b[^>]*>.*?</thead>)", 1)
    table = F.concat(F.lit("<table>"), head, F.array_join(F.slice(rows, 1, 3), ""), F.lit("<tr><td>[+"), (F.size(rows) - 3).cast("string"), F.lit(" rows]</td></tr></table>"))
    items_ = F.concat(F.lit("<ul>"), F.array_join(F.slice(items, 1, 3), ""), F.lit("<li>[+"), (F.size(items) - 3).cast("string"), F.lit(" items]</li></ul>"))
    plain = lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", " "))
    return (
        F.when((kind == "text_block") & (F.size(sentences) > 2), both(two, two))
        .when((kind == "table") & (F.size(rows) > 4), both(plain(table), table))
        .when((kind == "list") & (F.size(items) > 3), both(plain(items_), items_))
        .when(~kind.isin("text_block", "table", "list", "heading", "media") & (F.length(text) > 200), both(F.concat(F.substring(text, 1, 200), F.lit("...")), F.concat(F.substring(html, 1, 200), F.lit("..."))))
        .otherwise(keep)
    )


def label(chunks: DataFrame) -> DataFrame:
    """chunks with a label of their section: the first heading of the same parent, an accessible label, or what kind they are."""
    section = Window.partitionBy("page_id", "parent_xpath").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heading = F.first(F.when((F.col("kind") == "heading") & (F.length("text") > 0), F.col("text")), ignorenulls=True).over(section)
    kinds = {"text_block": "Text Block", "table": "Table", "list": "List", "form": "Form", "media": "Media"}
    name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    return chunks.withColumn("label", F.coalesce(F.substring(heading, 1, 50), F.substring(F.nullif(Chunk.attr("aria-label"), F.lit("")), 1, 50), name, F.col("kind")))


def dropped_references(labelled: DataFrame) -> DataFrame:
    """One line for each parent whose chunks were dropped for the budget (column dropped): its label and how many."""
    gone = labelled.filter("dropped").groupBy("page_id", "parent_xpath").agg(F.min_by("label", "pos").alias("label"), F.count("*").alias("n"), F.min("pos").alias("pos"))
    return gone.select("page_id", "pos", F.concat(F.lit("[Section: "), "label", F.lit(" ("), F.col("n").cast("string"), F.lit(" items)]")).alias("text"))


# merging chunks again


def path_key(xpath: Column) -> Column:
    """A key whose order is that of (tag, index) step by step; a step without an index comes before its like with one."""
    step = lambda s: F.concat(F.regexp_extract(s, r"^([^\[]+)", 1), F.lit("\x01"), F.lpad(F.coalesce(F.nullif(F.regexp_extract(s, r"\[(\d+)\]$", 1), F.lit("")), F.lit("0")), 9, "0"))
    return F.array_join(F.transform(F.filter(F.split(xpath, "/"), lambda s: s != ""), step), "\x02")


def remerge(chunks: DataFrame) -> DataFrame:
    """(page_id, xpath, parent_xpath, html) -> one document a page: neighbours of one parent stand in its element again."""
    order = Window.partitionBy("page_id").orderBy("_k", "pos")
    rows = chunks.withColumn("_k", path_key(F.col("xpath")))
    rows = rows.withColumn("_new", F.coalesce((F.lag("parent_xpath").over(order) != F.col("parent_xpath")).cast("int"), F.lit(1)))
    rows = rows.withColumn("_i", F.sum("_new").over(order)).withColumn("_r", F.row_number().over(order))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", c))), lambda x: x[c]), "\n")
    groups = rows.groupBy("page_id", "_i").agg(F.first("parent_xpath").alias("p"), F.count("*").alias("n"), joined("html").alias("inner"))
    steps = F.filter(F.split("p", "/"), lambda s: s != "")
    tag = F.lower(F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), steps), -1), "^([a-zA-Z][a-zA-Z0-9]*)", 1))
    section = F.array_join(F.slice(steps, F.greatest(F.size(steps) - 1, F.lit(1)), F.lit(2)), "/")
    wrapped = F.concat(F.lit("<"), tag, F.lit(' data-section="'), section, F.lit('">\n'), "inner", F.lit("\n</"), tag, F.lit(">"))
    groups = groups.withColumn("_r", F.col("_i")).withColumn("part", F.when((F.col("n") > 1) & ~tag.isin("", "body", "html"), wrapped).otherwise(F.col("inner")))
    return groups.groupBy("page_id").agg(F.concat(F.lit("<html><body>\n"), joined("part"), F.lit("\n</body></html>")).alias("html"))


#: Fixed value: attributes without meaning for a reader.
NOISE_ATTRS = (
    "class|id|data-(?!section\\b)[\\w-]+|style|onclick|onload|onsubmit|onchange|tabindex|accesskey|draggable|lang|dir|translate|hidden|slot|part|xmlns[\\w:]*|xml:[\\w]+|about|datatype|inlist|prefix|rev|"
    "typeof|vocab|autocomplete|autofocus|placeholder|spellcheck|contenteditable|aria-(?!(?:label|labelledby|hidden|current|details|level|autocomplete|invalid)\\b)[a-z]+|width|height|border|cellpadding|cellspacing|bgcolor|align|valign"
)


# Elements that go when empty, and those that a lone wrapper gives way to.
EMPTY = "div|span|p|section|article|aside|figure|figcaption|details|summary|b|i|em|strong|small|sup|sub|a|abbr|cite|code|mark|u|s"
WRAPPED = "p|h[1-6]|ul|ol|table|article|section|figure"


def compress_html(html: Column, passes: int = 5) -> Column:
    """Without attributes that say nothing, empty elements (innermost first), wrappers of one child and bare spans; white space normal."""
    out = F.regexp_replace(html, rf"(?i)\s+(?:{NOISE_ATTRS})\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    for _ in range(max(3, passes)):
        out = F.regexp_replace(out, rf"(?i)<({EMPTY})\b[^>]*>\s*</\1>", "")
    out = F.regexp_replace(out, rf"(?is)<div\b(?![^>]*\bdata-section\b)[^>]*>\s*(<(?:{WRAPPED})\b[^>]*>.*?</(?:{WRAPPED})>)\s*</div>", "$1")
    out = F.regexp_replace(out, r"(?s)<span\s*>(.*?)</span>", "$1")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n"), r">\s+<", ">\n<")
    return F.trim(out)


def is_dense(text: Column) -> Column:
    return text.rlike(f"[{DENSE}]")
