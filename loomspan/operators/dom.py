"""HTML to node and chunk tables.

Parsing is the one step that needs Python: a mapInArrow pass over (page_id, html) with the standard library's tokenizer. Everything
after it - weights, removal of subtrees, pruning - is declarative: nodes carry pre-order numbers and the last number of their
subtree, so ancestor tests are comparisons.

Repair rules, stated because parsers differ: a paragraph closes an open paragraph; block elements close an open paragraph and
the inline elements in it; list items and table cells close their like; the end of the text closes all; stray end tags are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import fixed

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em i ins kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr img label".split())
ATOMIC = {"table": "table", "thead": "table", "tbody": "table", "ul": "list", "ol": "list", "dl": "list", "figure": "media", "form": "form"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article section main aside nav header footer div body html".split())
REMOVED = frozenset("script style noscript svg link path defs iframe".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset(ATOMIC) | frozenset("p pre blockquote address fieldset hr li dd dt".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEPT_ATTRS = ("class", "itemprop", "itemtype", "role", "aria-label", "href", "datetime", "content", "property", "id", "type", "name", "alt")
# Limits of sibling grouping.
GROUP_MAX, SINGLE_MAX, MERGE_MIN, MAX_DEPTH = 700, 500, 20, 100
_DENSE = re.compile("[　-鿿가-힯豈-﫿]")
NODE_SCHEMA = "page_id long, node_id int, parent_id int, last_id int, depth int, tag string, attrs map<string,string>, text string, own_text string, link_chars int, xpath string, in_main boolean, in_article boolean, fields int, alike int"
CHUNK_SCHEMA = "page_id long, pos int, xpath string, parent_xpath string, tag string, kind string, depth int, in_main boolean, text string, attrs map<string,string>"


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "number")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list = []  # strings and nodes, in order
        self.number: dict[str, int] = {}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.at, self.skip = self.root, 0

    def _open(self, tag: str) -> bool:
        n = self.at
        while n is not None:
            if n.tag == tag:
                return True
            n = n.parent
        return False

    def _close(self, tag: str) -> None:
        if self._open(tag):
            while self.at.tag != tag:
                self.at = self.at.parent
            self.at = self.at.parent or self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if self.skip:
            self.skip += tag in REMOVED and tag not in VOID
            return
        if tag in REMOVED:
            self.skip = 0 if tag in VOID else 1
            return
        if tag == "html":
            self.root.attrs |= given
            return
        if tag in BLOCKS and self._in_paragraph():
            self._close("p")
        while self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, given, self.at)
        self.at.children.append(node)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def _in_paragraph(self) -> bool:
        n = self.at
        while n is not None and (n.tag in INLINE or n.tag == "p"):
            if n.tag == "p":
                return True
            n = n.parent
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in REMOVED:
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.skip -= tag in REMOVED
            return
        if tag != "html" and tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip and data:
            self.at.parts.append(data)


def parse(html: str) -> Node:
    """The tree of a page; the empty page is a root without children."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def flat_text(node: Node) -> str:
    out, stack = [], [iter(node.parts)]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                out.append(part)
            else:
                stack.append(iter(part.parts))
                break
        else:
            stack.pop()
    return " ".join("".join(out).split())


def _paths(root: Node) -> dict[int, str]:
    """Paths with an index only where siblings share the tag."""
    paths, stack = {id(root): "/html"}, [root]
    while stack:
        node = stack.pop()
        total: dict[str, int] = {}
        for c in node.children:
            total[c.tag] = total.get(c.tag, 0) + 1
        seen: dict[str, int] = {}
        for c in node.children:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            paths[id(c)] = f"{paths[id(node)]}/{c.tag}" + (f"[{seen[c.tag]}]" if total[c.tag] > 1 else "")
            stack.append(c)
    return paths


def node_rows(html: str) -> list[dict]:
    """Rows of a page's elements in document order."""
    root = parse(html)
    paths, rows = _paths(root), []

    def visit(first: Node) -> None:
        stack: list[tuple[Node, int, int, bool, bool, bool]] = [(first, -1, 0, False, False, False)]
        while stack:
            node, parent, depth, main, article, done = stack.pop()
            if done:
                own = rows[parent]  # here: the node's own number
                own["last_id"] = len(rows) - 1
                if own["parent_id"] >= 0:  # sums of what is in the node, and the node itself, for the one that holds it
                    up = rows[own["parent_id"]]
                    up["link_chars"] += own["link_chars"] + (len(own["text"]) if own["tag"] == "a" else 0)
                    up["fields"] += own["fields"] + (own["tag"] in ("input", "select", "button", "textarea"))
                continue
            here = len(rows)
            rows.append(
                {
                    "node_id": here, "parent_id": parent, "last_id": here, "depth": depth, "tag": node.tag, "attrs": dict(node.attrs), "text": flat_text(node),
                    "own_text": " ".join("".join(p for p in node.parts if isinstance(p, str)).split()), "xpath": paths[id(node)], "in_main": main, "in_article": article,
                    "link_chars": 0,
                    "fields": 0,
                    "alike": max(Counter((c.tag, frozenset(c.attrs.get("class", "").split()[:3])) for c in node.children).values(), default=0),
                }
            )
            inside = main or node.tag == "main" or node.attrs.get("role") == "main"
            stack.append((node, here, depth, main, article, True))
            for child in reversed(node.children):
                stack.append((child, here, depth + 1, inside, article or node.tag in ("article", "main"), False))

    visit(root)
    return rows


def _descendants(node: Node) -> Iterator[Node]:
    stack = list(reversed(node.children))
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.children))


def chunk_rows(html: str, alpha: float = 1.0) -> list[dict]:
    """Atomic chunks of a page in document order.

    Tables, lists, figures, forms, headings and paragraphs are one chunk each; containers with block children are taken apart
    (their direct text and inline children yield nothing), others are one chunk. Small neighbouring text chunks of one
    container are merged.
    """
    root = parse(html)
    paths = _paths(root)

    def chunk(node: Node, kind: str, text: str, depth: int, main: bool) -> dict:
        return {"xpath": paths[id(node)], "parent_xpath": paths[id(node.parent)] if node.parent else "", "tag": node.tag, "kind": kind, "depth": depth, "in_main": main, "text": text, "attrs": {k: node.attrs[k] for k in KEPT_ATTRS if k in node.attrs}}

    def visit(node: Node, depth: int, main: bool) -> list[dict]:
        if depth > MAX_DEPTH or node.tag in REMOVED:
            return []
        if node.tag in ATOMIC or node.tag in HEADINGS or node.tag == "p":
            text = flat_text(node)
            kind = ATOMIC.get(node.tag) or ("heading" if node.tag in HEADINGS else "text_block")
            return [chunk(node, kind, text, depth, main)] if text else []
        if node.tag in INLINE:
            return []
        inside = main or node.tag == "main" or node.attrs.get("role") == "main"
        if any(c.tag not in INLINE for c in node.children):
            made = [x for c in node.children for x in visit(c, depth + 1, inside)]
            return merge_small(made, alpha) if node.tag in CONTAINERS else made
        text = flat_text(node)
        return [chunk(node, "text_block", text, depth, main)] if text else []

    return visit(root, 0, False)


def merge_small(chunks: list[dict], alpha: float = 1.0) -> list[dict]:
    """Join runs of small text chunks of one parent and one script kind."""
    out: list[dict] = []
    run: list[dict] = []

    def flush() -> None:
        if len(run) > 1:
            out.append(run[0] | {"text": " ".join(c["text"] for c in run)})
        else:
            out.extend(run)
        run.clear()

    for c in chunks:
        n = len(c["text"])
        small = c["kind"] == "text_block" and MERGE_MIN <= n < SINGLE_MAX * alpha
        fits = run and c["parent_xpath"] == run[0]["parent_xpath"] and bool(_DENSE.search(c["text"])) == bool(_DENSE.search(run[0]["text"])) and sum(len(x["text"]) for x in run) + n < GROUP_MAX * alpha
        if not small or (run and not fits):
            flush()
        if small:
            run.append(c)
        else:
            out.append(c)
    flush()
    return out


def _table(pages: DataFrame, rows_of, schema: str, id_col: str, html_col: str) -> DataFrame:
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # a page of more elements than allowed is not parsed; start tags are counted before
    slim = slim.filter(F.regexp_count("html", F.lit("<[a-zA-Z]")) <= fixed.MAX_DOM_NODES)
    fields = [f for f in slim.sparkSession.createDataFrame([], schema).schema]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convert = lambda v: list(v.items()) if isinstance(v, dict) else v
            for k in range(batch.num_rows):  # a page at a time: its rows are all that is held
                page, rows = batch.column(0)[k].as_py(), rows_of(batch.column(1)[k].as_py())
                if rows:
                    yield pa.record_batch([pa.array([page if n == "page_id" else convert(r.get(n)) for r in rows], t) for n, t in types], names=[n for n, _ in types])

    return slim.mapInArrow(run, schema)


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _table(pages, node_rows, NODE_SCHEMA, id_col, html_col)


def chunks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    numbered = lambda html: [r | {"pos": i} for i, r in enumerate(chunk_rows(html))]
    return _table(pages, numbered, CHUNK_SCHEMA, id_col, html_col)


# Class words of noise and of content, and styles that hide.
NOISE = [r"\bad[-_]?\b", r"\badvertis", r"\bsponsor", r"\bbanner\b", r"\brecommend", r"\brelated\b", r"\bsidebar\b", r"\bpopup\b", r"\bmodal\b", r"\bcookie\b", r"\btracking\b", r"\boverlay\b", r"\bpromo", r"\bwidget\b", r"\btoast\b", r"\bsnackbar\b"]
CONTENT = [r"\barticle\b", r"\bcontent\b", r"\bentry\b", r"\bpost\b", r"\bstory\b", r"\bproduct\b", r"\bitem\b", r"\bgoods\b"]
HIDING = {
    "display-none": r"display\s*:\s*none",
    "visibility-hidden": r"visibility\s*:\s*hidden",
    "opacity-zero": r"opacity\s*:\s*0(?:\.0+)?(?:\s*[;!]|\s*$)",
    "font-size-zero": r"font-size\s*:\s*0(?:\.0+)?(?:px|em|rem|%)?(?:\s*[;!]|\s*$)",
    "offscreen-position": r"(?:left|top|right)\s*:\s*-\d{4,}px",
    "clip-hidden": r"clip\s*:\s*rect\s*\(\s*0[\s,]+0[\s,]+0[\s,]+0\s*\)|clip-path\s*:\s*inset\s*\(\s*100%\s*\)",
    "text-indent-hidden": r"text-indent\s*:\s*-\d{4,}px",
    "transform-offscreen": r"transform\s*:.*translate[XY]?\s*\(\s*-\d{4,}px",
    "sr-only-hidden": r"(?s)(?=.*overflow\s*:\s*hidden)(?=.*(?:width|height)\s*:\s*1px)(?=.*position\s*:\s*absolute)",
    "zero-dimension": r"(?s)(?=.*(?:width|height)\s*:\s*0(?:px)?\s*(?:[;!]|$))(?=.*overflow\s*:\s*hidden)",
}
#: Reasons that hide text from readers: such nodes are never spared or rescued.
SECURITY = ["aria-hidden", *HIDING]
#: Reasons whose removals may be rescued.
RESCUABLE = ["link-density-high", "link-density"]
#: Content worth a rescue, and containers of grids.
RESCUE = [
    r"(?:₩|원|\$|€|£|¥)\s*[\d,]+|\d{2,3}(?:,\d{3})+",
    r"(?i)(?:★|⭐|\d+\.\d+\s*/\s*\d+|\d+\.\d+점|ratingValue|평점|별점|rating|stars?)",
    r"(?i)(?:리뷰\s*\d+|reviews?\s*\(?\d+|reviewCount|\d+\s*(?:reviews?|리뷰|개의\s*평가))",
]
_GRID = ["div", "section", "ul", "ol", "main", "article", "table", "tbody"]
_LINKY = ["div", "section", "ul", "ol", "p", "td", "li", "aside", "table"]


def weigh(table: DataFrame, schema: str = "Generic") -> DataFrame:
    """nodes with weight and reason: the first rule that fits, in order.

    A grid is a container of three children or more of one tag and one set of first classes, most of its text in links; it, what is in
    it and what holds it are spared the rules of link density.
    """
    a = lambda k: F.coalesce(F.col("attrs")[k], F.lit(""))
    role, style, tag = F.lower(a("role")), a("style"), F.col("tag")
    names = F.concat_ws(" ", a("class"), a("id"))
    hits = lambda patterns: sum((F.when(names.rlike("(?i)" + p), 1).otherwise(0) for p in patterns), F.lit(0))
    noise, content = hits(NOISE), hits(CONTENT)
    length = F.length("text")
    linked = F.when(length > 50, F.col("link_chars") / length).otherwise(0.0)
    prose = (tag == "p") & F.col("in_article") & (length - F.col("link_chars") > 80) & (linked > 0)
    direct = F.col("depth") == 2
    gov = F.lit(schema == "GovernmentPage")
    price = F.lit(schema == "Product") & F.col("text").rlike(r"(?:₩|원|\$|€|£|¥)\s*[\d,]+|\d{2,3}(?:,\d{3})+")
    rules: list[tuple[Column, float, str]] = [
        (gov & (role == "contentinfo"), 0.6, "footer-gov-exception"),
        ((role == "complementary") & (F.col("fields") > 0), 0.7, "filter-sidebar"),
        (role == "complementary", 0.3, "role=complementary"),
        (role == "navigation", 0.0, "role=navigation"),
        (role == "banner", 0.0, "role=banner"),
        (role == "contentinfo", 0.0, "role=contentinfo"),
        (role == "main", 1.0, "role=main"),
        (role == "article", 1.0, "role=article"),
        (role == "region", 0.8, "role=region"),
        ((tag == "footer") & direct & gov, 0.6, "footer-gov-exception"),
        ((tag == "header") & direct, 0.0, "semantic-header"),
        ((tag == "footer") & direct, 0.0, "semantic-footer"),
        (tag == "header", 0.8, "semantic-header-nested"),
        (tag == "footer", 0.8, "semantic-footer-nested"),
        ((tag == "section") & ((a("aria-label") != "") | (a("aria-labelledby") != "")), 0.8, "semantic-section-labeled"),
        (tag == "section", 0.6, "semantic-section-unlabeled"),
        ((tag == "aside") & (F.col("fields") > 0), 0.7, "filter-sidebar"),
        (tag == "aside", 0.3, "semantic-aside"),
        (tag == "nav", 0.0, "semantic-nav"),
        (tag == "main", 1.0, "semantic-main"),
        (tag == "article", 1.0, "semantic-article"),
        (a("aria-hidden") == "true", 0.0, "aria-hidden"),
        *[(style.rlike("(?i)" + p), 0.0, reason) for reason, p in HIDING.items()],
        ((noise >= 2) & (content > 0), 0.7, "content-override-noise"),
        ((noise >= 2) & price, 0.7, "product-price-in-noise"),
        (noise >= 2, 0.2, "noise-pattern"),
        (content > 0, 1.0, "content-pattern"),
        (prose & (linked > 0.8), 0.2, "article-p-link-dense"),
        (prose, 0.9, "article-content-p"),
        (tag.isin(_LINKY) & (linked > 0.8), 0.2, "link-density-high"),
        (tag.isin(_LINKY) & (linked > 0.5), 0.4, "link-density"),
    ]
    pick = None
    for cond, weight, reason in rules:
        value = F.struct(F.lit(weight).alias("weight"), F.lit(reason).alias("reason"))
        pick = F.when(cond, value) if pick is None else pick.when(cond, value)
    pick = pick.otherwise(F.struct(F.lit(1.0).alias("weight"), F.lit("default").alias("reason")))
    out = table.withColumn("_p", pick).withColumn("_grid", tag.isin(_GRID) & (F.col("alike") >= 3) & (linked > 0.5))
    # the rules from prose on come after the grid's
    order = Window.partitionBy("page_id").orderBy("node_id")
    spare = tag.isin(_LINKY) & F.col("_p.reason").isin("article-p-link-dense", "article-content-p", "link-density-high", "link-density", "default")
    in_grid = F.max(F.when(F.col("_grid"), F.col("last_id"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("node_id")
    holds_grid = F.min(F.when(F.col("_grid"), F.col("node_id"))).over(order.rowsBetween(1, Window.unboundedFollowing)) <= F.col("last_id")
    by_grid = F.when(spare & in_grid, "grid-whitelist").when(spare & holds_grid, "grid-whitelist-ancestor")
    out = out.withColumn("_by", by_grid).withColumn("weight", F.when(F.col("_by").isNotNull(), 0.8).otherwise(F.col("_p.weight")))
    return out.withColumn("reason", F.coalesce("_by", "_p.reason")).drop("_p", "_grid", "_by")


def remove(weighed: DataFrame, threshold: float = 0.5, schema: str = "Generic") -> DataFrame:
    """weighed nodes with ``removed`` (the top of a removed subtree) and ``gone`` (in one). One pass in document order:
    a node is inside a removed subtree if an earlier removed node's last number reaches it.

    Children of main stay unless they are hidden. Where less than 100 characters would be left, and on products, nodes removed for their links come
    back if what is left in them has a price, h1, rating or review count; a second pass settles what is in what.
    """
    page = Window.partitionBy("page_id")
    order = page.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(F.col("_low"), F.col("last_id"))).over(order) >= F.col("node_id"), F.lit(False))
    exempt = F.col("tag").isin("html", "body", "main") | (F.col("xpath").rlike(r"/main(?:\[\d+\])?/[^/]+$") & ~F.col("reason").isin(SECURITY))
    out = weighed.withColumn("_low", (F.col("weight") < threshold) & ~exempt).withColumn("_in", inside)
    left = F.sum(F.when(~F.col("_low") & ~F.col("_in"), F.length("own_text")).otherwise(0)).over(page)
    linked = F.col("_low") & F.col("reason").isin(RESCUABLE)
    out = out.withColumn("_need", (left < 100) | F.lit(schema == "Product")).withColumn("_need", F.col("_need") & F.coalesce(F.max(linked).over(page), F.lit(False)))
    # what is left in a low node: the text of its nodes that are in no low node further in
    every = F.collect_list(F.when(F.col("_need"), F.struct("node_id", "last_id", "own_text", (F.col("tag") == "h1").alias("h1"), F.col("_low").alias("low")))).over(page)
    out = out.withColumn("_nodes", F.array_sort(every))
    own = F.filter("_nodes", lambda x: (x.node_id >= F.col("node_id")) & (x.node_id <= F.col("last_id")))
    further = lambda x: F.exists("_nodes", lambda y: y.low & (y.node_id > F.col("node_id")) & (y.node_id <= x.node_id) & (y.last_id >= x.node_id))
    kept = F.filter(own, lambda x: ~further(x))
    out = out.withColumn("_own", F.when(F.col("_need") & linked, kept))
    text = F.trim(F.array_join(F.transform("_own", lambda x: x.own_text), " "))
    out = out.withColumn("_kept", F.coalesce(text, F.lit(""))).withColumn("_h1", F.coalesce(F.exists("_own", lambda x: x.h1), F.lit(False)))
    signal = (F.col("_kept") != "") & reduce(or_, (F.col("_kept").rlike(p) for p in RESCUE), F.col("_h1"))
    out = out.withColumn("_low", F.col("_low") & ~(F.col("_need") & linked & signal)).withColumn("_in", inside)
    out = out.withColumn("removed", F.col("_low") & ~F.col("_in")).withColumn("gone", F.col("_low") | F.col("_in"))
    return out.drop("_low", "_in", "_need", "_nodes", "_own", "_kept", "_h1")


def prune(table: DataFrame, text_min: int = 50, no_main_text: int = 30, no_main_form: int = 20, media_min: int = 10, no_main_media: int = 20) -> DataFrame:
    """chunks with keep, reason and score by the ordered rules for pages with and without a main area."""
    has_main = F.max(F.col("in_main").cast("int")).over(Window.partitionBy("page_id")) == 1
    kind, n = F.col("kind"), F.length("text")
    short = F.col("text").rlike(r"(?i)in stock|out of stock|sold out|free shipping|only \d+ left|\d+% off|품절|무료배송")
    measure = F.col("text").rlike(r"(?i)\d+(?:\.\d+)?\s*(?:cm|mm|kg|inch|ml)\b|\b(?:XS|S|M|L|XL|XXL)\b")
    inside = has_main & F.col("in_main")
    # Scores by reason.
    rules: list[tuple[Column, str, bool, float]] = [
        (kind.isin("meta", "rsc_data"), "meta_always", True, 1.0),
        (inside & (kind == "heading"), "in_main_heading", True, 0.85),
        (inside & (kind == "text_block") & (n > text_min), "in_main_text", True, 0.7),
        (inside & (kind == "text_block") & short, "in_main_hv_short", True, 0.75),
        (inside & kind.isin("table", "list") & (n > text_min), "in_main_structured", True, 0.7),
        (inside & kind.isin("table", "list") & (short | measure), "in_main_hv_short", True, 0.75),
        (inside & (kind == "form"), "in_main_form", True, 0.65),
        (inside & (kind == "media") & (n > media_min), "in_main_media", True, 0.6),
        (inside, "in_main_short", False, 0.0),
        (~has_main & (kind == "heading"), "keep_heading_no_main", True, 0.6),
        (~has_main & (kind == "text_block") & (n > no_main_text), "keep_text_no_main", True, 0.55),
        (~has_main & (kind == "form") & (n > no_main_form), "keep_form_no_main", True, 0.5),
        (~has_main & (kind == "media") & (n > no_main_media), "keep_media_no_main", True, 0.45),
    ]
    pick = None
    for cond, reason, keep, score in rules:
        value = F.struct(F.lit(reason).alias("reason"), F.lit(keep).alias("keep"), F.lit(score).alias("score"))
        pick = F.when(cond, value) if pick is None else pick.when(cond, value)
    pick = pick.otherwise(F.struct(F.lit("no_match").alias("reason"), F.lit(False).alias("keep"), F.lit(0.0).alias("score")))
    return table.withColumn("_p", pick).select(*table.columns, "_p.reason", "_p.keep", "_p.score")
