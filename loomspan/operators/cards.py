"""Product cards of listing and search pages, and the contexts that are made of cards, fields and bucketed lines.

Card detection walks the tree (Python, a page at a time); what is done with cards and lines is declarative: lines fall into ordered
buckets by the first condition that fits, buckets have caps, and a running sum holds the budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import terms
from loomspan.functions import money
from loomspan.functions.text import tokens
from loomspan.operators import dom, jsonld
from loomspan.operators import schema_match as sm

# Limits and patterns of cards.
STEPS_UP, LEAST_CARDS, MOST_CARDS, MOST_FOUND = 6, 3, 15, 50
CARD_PRICE = re.compile(r"₩\s*[\d,]+|\d[\d,]+\s*원|\d[\d,]+\s*円|¥\s*[\d,]+|\d{2,3}(?:,\d{3})+(?:\s*원)?|\$\d+(?:\.\d{2})?|€\s*[\d,.]+|£\s*[\d,.]+|USD\s*[\d,.]+|EUR\s*[\d,.]+|CHF\s*[\d,.]+")
_TRIM = "|·-–—"


def from_items(page: str) -> list[dict]:
    """Cards of the page's JSON-LD item list."""
    return [{"name": i["name"], "price": i["price"], "currency": i["currency"], "brand": i["brand"], "url": i["url"]} for i in jsonld.items(jsonld.scripts(page))]


def from_tree(page: str) -> list[dict]:
    """Cards by their prices: from each text with a price up to the child of a row of three alike; the longest line before the price names it."""
    root = dom.parse(page)
    found: list[tuple[dom.Node, str]] = []
    for node in (root, *dom._descendants(root)):
        hit = next((m for t in node.parts if isinstance(t, str) and (m := CARD_PRICE.search(t.strip()))), None)
        if hit:
            found.append((node, hit[0]))
    if len(found) < LEAST_CARDS:
        return []
    cards, seen = [], set()
    for start, price in found:
        node, bounded = start, False
        for _ in range(STEPS_UP):
            up = node.parent
            if up is None or up.tag in ("body", "html"):
                break
            if sum(c.tag == node.tag for c in up.children) >= LEAST_CARDS:
                bounded = True
                break
            node = up
        if not bounded and node is not start:
            continue
        lines = _lines(node)
        text = "\n".join(lines)
        if not text or text in seen:
            continue
        seen.add(text)
        before = [x.strip() for x in text.split(price)[0].split("\n")] if price in text else lines
        names = [x for x in before if len(x) > 1]
        name = max(names, key=len) if names else text[:100]
        if len(name) >= 2:
            cards.append({"name": name[:150], "price_text": price})
    return cards if len(cards) >= LEAST_CARDS else []


def _lines(node: dom.Node) -> list[str]:
    """Texts of a node, one a text part, in order."""
    out, stack = [], list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out += [" ".join(part.split())] * bool(part.strip())
        else:
            stack += reversed(part.parts)
    return out


def from_chunks(page: str) -> list[dict]:
    """Cards of list items with a price; else names and prices of one parent paired by place; else neighbouring lines."""
    chunks = dom.chunk_rows(page)
    cards = []
    for node in _every(page, "li"):
        text = dom.flat_text(node)
        m = CARD_PRICE.search(text) if len(text) >= 5 else None
        name = text[: m.start()].strip().rstrip(_TRIM).strip() if m else ""
        if len(name) > 2:
            cards.append({"name": name, "price_text": m[0]})
    if cards:
        return cards
    parents: dict[str, list[str]] = {}
    for c in chunks:
        parents.setdefault(c["parent_xpath"] or c["xpath"], []).append(c["text"].strip())
    for texts in parents.values():
        prices = [m[0] for t in texts if (m := CARD_PRICE.search(t))]
        names = [t for t in texts if not CARD_PRICE.search(t) and 3 < len(t) < 200]
        if len(texts) > 1 and len(prices) >= 2 and names:
            cards += [{"name": n, "price_text": p} for n, p in zip(names, prices, strict=False)]
    if cards:
        return cards
    texts, k = [c["text"].strip() for c in chunks if c["text"].strip()], 0
    while k < len(texts) - 1:
        own, after = CARD_PRICE.search(texts[k]), CARD_PRICE.search(texts[k + 1])
        if not own and after and 3 < len(texts[k]) < 200:
            cards.append({"name": texts[k], "price_text": after[0]})
            k += 1
        elif own and len(texts[k]) > 15 and len(texts[k][: own.start()].strip().rstrip(_TRIM)) > 2:
            cards.append({"name": texts[k][: own.start()].strip().rstrip(_TRIM), "price_text": own[0]})
        k += 1
    return cards


def _every(page: str, *tags: str) -> Iterator[dom.Node]:
    return (n for n in dom._descendants(dom.parse(page)) if n.tag in tags)


def cards_of(page: str) -> tuple[str, list[dict]]:
    """(source, cards) of the first source that has any; one card for each name and price."""
    for source, find in (("json_ld_itemlist", from_items), ("dom", from_tree), ("chunks", from_chunks)):
        once = {((c["name"] or "").lower().strip(), c.get("price_text") or str(c.get("price") or "")): c for c in reversed(find(page))}
        if once:
            return source, list(reversed(once.values()))
    return "", []


CARD_SCHEMA = "page_id long, pos int, source string, name string, price double, currency string, price_text string, brand string, url string"


def _map(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"page_id": i, **r} for r in rows_of(html)], schema=arrow)

    return pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, schema)


def cards(pages: DataFrame) -> DataFrame:
    """One row a card; empty pages and pages without cards have none."""

    def rows_of(html: str) -> list[dict]:
        source, found = cards_of(html)
        return [{"pos": k, "source": source, **c} for k, c in enumerate(found)]

    return _map(pages, rows_of, CARD_SCHEMA)


def serialised(found: DataFrame, locale: Column, most: int = MOST_CARDS) -> DataFrame:
    """page_id, text: numbered cards 'n. name | price | brand' and how many more there are. ``found`` has the page's locale."""
    price = F.coalesce("price_text", F.when(F.col("price").isNotNull(), money.price(F.col("price"), F.coalesce("currency", F.lit("KRW")))))
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.concat_ws(" | ", "name", F.nullif(price, F.lit("")), F.nullif("brand", F.lit(""))))
    rows = found.select("page_id", "pos", locale.alias("locale"), line.alias("line"))
    some = rows.groupBy("page_id").agg(F.first("locale").alias("locale"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < most, F.struct("pos", "line")))).alias("l"))
    more = F.create_map(*[F.lit(x) for k, v in terms.LABELS.items() for x in (k, v[terms.NAMES.index("overflow")])])[F.col("locale")]
    rest = F.when(F.col("n") > most, F.concat(F.lit("... "), F.replace(more, F.lit("{n}"), (F.col("n") - most).cast("string"))))
    return some.select("page_id", F.concat_ws("\n", F.array_join(F.transform("l", lambda x: x["line"]), "\n"), rest).alias("text"))


# buckets

#: Words of service pages beside the term tables.
PLAN_WORDS = ("plan", "free", "pro", "enterprise", "tier", "/mo", "/yr", "플랜", "무료", "유료", "プラン", "套餐")
FEATURE_WORDS = ("integration", "api", "support", "연동", "지원", "サポート", "集成")
SERVICE_WORDS = ("service", "서비스", "안내", "공지", "notice", "신청", "apply", "サービス", "お知らせ", "服务", "通知")
PROMOTION = r"(?i)결제\s*시|이상\s*결제|카드.*할인|페이\s*[×xX·]|무이자\s*할부|적립금|포인트\s*적립|쿠폰\s*(?:받기|다운|적용)|무신사페이|네이버페이|카카오페이|토스페이|pay\s*with|payment\s*method|installment|credit\s*card\s*(?:offer|deal)|お支払い方法|ポイント還元|分割払い"
FOOTER = r"(?i)어바웃|회사\s*소개|비즈니스|고객지원|고객센터|이용약관|개인정보|사업자\s*등록|통신판매|대표\s*이사|주소\s*:|copyright|©|\(c\)|all\s*rights\s*reserved"
CONTROL = r"(?i)(?:XXS|XS|S|M|L|XL|XXL|2XL|3XL|FREE)\s*[/,]|(?:^|[^\p{L}\p{N}_])(?:수량|quantity|Qty|재고|in stock|out of stock|품절)(?:$|[^\p{L}\p{N}_])"
PERCENT = r"[0-9]{1,2}%"
DATED = r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}"


#: A condition on a line: words it holds in lower case, patterns it must all have, a least length; any of the three kinds may be absent.
class Cond(NamedTuple):
    words: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    least: int = 0
    either: str = ""

    def column(self) -> Column:
        line = F.col("line")
        if self.words:
            held = F.lower(line).rlike(terms.any_of(tuple(dict.fromkeys(w.lower() for w in self.words))))
            return held | line.rlike(self.either) if self.either else held
        return reduce(and_, [line.rlike(p) for p in self.patterns], F.length(line) >= self.least)

    def sql(self) -> str:
        quoted = lambda p: "'" + p.replace("'", "''") + "'"
        if self.words:
            held = f"regexp_matches(lower(line), {quoted(terms.any_of(tuple(dict.fromkeys(w.lower() for w in self.words))))})"
            return f"({held} OR regexp_matches(line, {quoted(self.either)}))" if self.either else held
        return " AND ".join([f"length(line) >= {self.least}", *[f"regexp_matches(line, {quoted(p)})" for p in self.patterns]])


_PRICED = Cond(patterns=(sm.PRICE,))
#: style -> (least length of a line, whether the first long line is the title, buckets (name, condition, most lines, cut)).
#: A line goes to the first bucket whose condition it meets; one without a name takes lines away.
BUCKETS: dict[str, tuple[int, bool, tuple[tuple[str, Cond, int, int], ...]]] = {
    "search": (2, False, (("count", Cond(terms.SEARCH_RESULT), 2, 10_000), ("products", _PRICED, 10, 150), ("filters", Cond(terms.FILTER), 3, 100))),
    "listing": (2, False, (("title", Cond(terms.LISTING), 2, 10_000), ("products", _PRICED, 10, 150), ("filters", Cond(terms.FILTER), 3, 100))),
    "product": (2, False, (
        ("price", Cond(patterns=(sm.PRICE, r"[0-9]")), 5, 10_000), ("", Cond(patterns=(PROMOTION,)), 0, 0), ("", Cond(patterns=(FOOTER,)), 0, 0), ("discount", Cond(patterns=(PERCENT,)), 1, 10_000),
        ("rating", Cond(patterns=(sm.RATING,)), 2, 10_000), ("options", Cond(terms.OPTION, either=CONTROL), 5, 10_000), ("other", Cond(least=9), 10, 200),
    )),
    "saas": (5, True, (("pricing", Cond(terms.PRICING + PLAN_WORDS, either=sm.PRICE), 5, 200), ("features", Cond(terms.FEATURE + FEATURE_WORDS), 5, 200), ("description", Cond(least=50), 3, 200))),
    "government": (5, True, (
        ("department", Cond(terms.DEPARTMENT), 3, 200), ("date", Cond(patterns=(DATED,)), 2, 200), ("contact", Cond(terms.CONTACT), 3, 200), ("service", Cond(SERVICE_WORDS), 5, 200), ("body", Cond(least=30), 3, 300),
    )),
}


def bucketed(lines: DataFrame, style: str, budget: int, title: str = "Title") -> DataFrame:
    """Lines (page_id, pos, line) -> page_id, text: the title, then each bucket's first lines in order while the budget lasts.

    The order inside a bucket is the page's. The running sum stops the context at the first line that does not fit.
    """
    least, titled, some = BUCKETS[style]
    page = Window.partitionBy("page_id").orderBy("pos")
    rows = lines.filter(F.length("line") >= least)
    if titled:
        first = F.min(F.when(F.length("line") > 10, F.col("pos"))).over(Window.partitionBy("page_id"))
        rows = rows.withColumn("_first", first).filter(F.col("pos") >= F.col("_first"))
        is_title = F.col("pos") == F.col("_first")
    else:
        is_title = F.lit(False)
    place = F.lit(None).cast("int")
    for k, (name, cond, _, _) in reversed(list(enumerate(some))):
        place = F.when(cond.column(), F.lit(k if name else None).cast("int")).otherwise(place)
    rows = rows.withColumn("_b", F.when(is_title, F.lit(-1)).otherwise(place)).filter("_b is not null")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "_b").orderBy("pos")))
    table = F.create_map(*[F.lit(x) for k, (_, _, most, _) in enumerate(some) for x in (k, most)])
    cut = F.create_map(*[F.lit(x) for k, (_, _, _, length) in enumerate(some) for x in (k, length)])
    rows = rows.filter((F.col("_b") == -1) | (F.col("_n") <= table[F.col("_b")]))
    part = F.when(F.col("_b") == -1, F.concat(F.lit(f"{title}: "), "line")).otherwise(F.substring("line", F.lit(1), F.coalesce(cut[F.col("_b")], F.lit(10_000))))
    rows = rows.withColumn("part", part)
    run = F.sum(F.length("part") + 1).over(Window.partitionBy("page_id").orderBy("_b", "pos"))
    rows = rows.withColumn("_run", run).filter(F.col("_run") <= budget)
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "pos", "part"))), lambda x: x["part"]), "\n").alias("text"))


def outline(chunks: DataFrame, blocks: int, budget: int) -> DataFrame:
    """page_id, text: headings as '## ...' with up to ``blocks`` text chunks of 300 characters each, while the budget lasts (articles 3, wikis 2)."""
    page = Window.partitionBy("page_id").orderBy("pos")
    rows = chunks.filter(F.col("kind").isin("heading", "text_block") & (F.trim("text") != ""))
    rows = rows.withColumn("_h", F.sum((F.col("kind") == "heading").cast("int")).over(page)).filter("_h > 0")
    rows = rows.withColumn("_n", F.sum((F.col("kind") == "text_block").cast("int")).over(Window.partitionBy("page_id", "_h").orderBy("pos")))
    rows = rows.filter((F.col("kind") == "heading") | (F.col("_n") <= blocks))
    rows = rows.withColumn("part", F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.trim("text"))).otherwise(F.substring(F.trim("text"), 1, 300)))
    rows = rows.withColumn("_run", F.sum(F.length("part") + 1).over(page)).filter(F.col("_run") <= budget)
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("text"))


def card_context(lines: DataFrame, numbered: DataFrame) -> DataFrame:
    """Context of a page with cards: a heading among the first 15 lines, up to three lines of counts or filters among the first 20, the cards."""
    heading, count = Cond(terms.LISTING + terms.SEARCH_RESULT).column(), Cond(terms.SEARCH_RESULT + terms.FILTER).column()
    rows = lines.filter("pos < 20").withColumn("_h", heading & (F.col("pos") < 15)).withColumn("_c", count)
    first = F.min(F.when(F.col("_h"), F.col("pos"))).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("_first", F.col("pos") == first).filter("_first or _c").dropDuplicates(["page_id", "line"])
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("_first"), "pos"))).filter("_n <= 3")
    head = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring("line", 1, 150).alias("line")))), lambda x: x["line"]), "\n").alias("head"))
    return numbered.join(head, "page_id", "left").select("page_id", F.concat_ws("\n", "head", "text").alias("text"))


# news portals


def headlines(pages: DataFrame) -> DataFrame:
    """page_id, pos, headline, summary, portal: of articles (first h2 or h3 and the first paragraph after it), else of linked h2 and h3."""

    def rows_of(html: str) -> list[dict]:
        every = list(dom._descendants(dom.parse(html)))
        linked = [n for n in every if n.tag in ("h2", "h3") and any(c.tag == "a" for c in n.children)]
        articles = [n for n in every if n.tag == "article"]
        out: dict[str, dict] = {}
        for a in articles:
            inside = list(dom._descendants(a))
            k = next((k for k, n in enumerate(inside) if n.tag in ("h2", "h3")), None)
            title = dom.flat_text(inside[k]) if k is not None else ""
            if len(title) >= 5:
                told = next((t for n in inside[k + 1 :] if n.tag == "p" and len(t := dom.flat_text(n)) >= 10), "")
                out.setdefault(title.lower(), {"headline": title[:200], "summary": told[:200]})
        for n in linked if not out else ():
            title = dom.flat_text(n)
            if len(title) >= 5:
                out.setdefault(title.lower(), {"headline": title[:200], "summary": ""})
        portal = len(articles) >= 3 or len(linked) >= 3
        return [{"pos": k, "portal": portal, **r} for k, r in enumerate(out.values())]

    return _map(pages, rows_of, "page_id long, pos int, headline string, summary string, portal boolean")


def portal_context(found: DataFrame, budget: int) -> DataFrame:
    """Numbered headlines with their summaries, of portal pages."""
    part = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "headline", F.when(F.col("summary") != "", F.concat(F.lit("\n   "), "summary")).otherwise(F.lit("")))
    rows = found.filter("portal").withColumn("part", part)
    rows = rows.withColumn("_run", F.sum(F.length("part") + 1).over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("_run") <= budget)
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("text"))


#: Page types that may be short.
SHORT_TYPES = ("login", "error", "form", "settings")


def least_content(context: DataFrame, og: DataFrame, lines: DataFrame, budget: int) -> DataFrame:
    """(page_id, text, page_type, html) with text never near empty: where it has under ten tokens though the page is long, Open
    Graph title and description stand in, then the page's longer lines while half the budget lasts."""
    meta = og.filter(F.col("key").isin("og:title", "og:description")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("key") == "og:title", 0).otherwise(1).alias("o"), F.trim("value").alias("v")))), lambda x: x["v"]), "\n").alias("meta"))
    rows = lines.filter(F.length("line") > 10).withColumn("_run", F.sum(F.length("line") + 1).over(Window.partitionBy("page_id").orderBy("pos")))
    rows = rows.filter(F.col("_run") - F.length("line") - 1 < budget // 2 * 4)
    body = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    out = context.join(meta, "page_id", "left").join(body, "page_id", "left")
    thin = (tokens(F.coalesce("text", F.lit(""))) < 10) & (F.length("html") > 500) & ~F.col("page_type").isin(*SHORT_TYPES)
    stand_in = F.when(tokens(F.coalesce("meta", F.lit(""))) < 10, F.concat_ws("\n", "meta", "body")).otherwise(F.col("meta"))
    return out.select("page_id", "page_type", F.when(thin, stand_in).otherwise(F.col("text")).alias("text"), thin.alias("replaced"))
