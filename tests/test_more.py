"""Hand-worked cases of prices, matchers, tiers, structured data, cards, diagnostics and keyed machines."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import prices, text
from loomspan.operators import cards, diagnose, jsonld
from loomspan.operators import schema_match as sm
from loomspan.streaming import machines

# prices

CASES = [
    ("₩10,000 ~ ₩20,000", "", [(10000.0, "KRW", 0.95, "range_low"), (20000.0, "KRW", 0.95, "range_high")]),
    ("$99.99 (약 ₩130,000)", "", [(99.99, "USD", 0.54, "exact"), (130000.0, "KRW", 0.855, "exact")]),
    ("1.234,56 €", "", [(1234.56, "EUR", 0.95, "exact")]),
    ("from $99", "", [(99.0, "USD", 0.6, "from")]),
    ("10,000원부터", "", [(10000.0, "KRW", 0.9, "from")]),
    ("무료", "", [(0.0, "USD", 0.9, "free")]),
    ("품절", "", [(0.0, "USD", 0.85, "unavailable")]),
    ("$1,234.56", "https://shop.com.au/x", [(1234.56, "AUD", 0.8, "exact")]),
    ("US$5", "", [(5.0, "SGD", 0.95, "exact")]),
    ("¥1,200", "https://www.taobao.com/i", [(1200.0, "CNY", 0.85, "exact")]),
    ("kr 5", "https://x.no/", [(5.0, "NOK", 0.8, "exact")]),
    ("1,5 JPY", "", [(15.0, "JPY", 0.9, "exact")]),
    ("1.234", "https://x.kr/", [(1234.0, "KRW", 0.4, "exact")]),
    ("call us", "", []),
    ("  ", "", []),
    (None, "", []),
]


def test_prices_by_hand(spark):
    d = spark.createDataFrame([(k, t, u) for k, (t, u, _) in enumerate(CASES)], "k int, t string, u string").select("k", prices.parse(F.col("t"), F.col("u")).alias("r"))
    for r in d.collect():
        got = [(p.amount, p.currency, round(p.confidence, 4), p.price_type) for p in r.r.prices]
        assert got == CASES[r.k][2], CASES[r.k][0]
        assert r.r.is_range == (len(got) == 2 and got[0][3] == "range_low") and r.r.is_cross_listed == (len(got) == 2 and not r.r.is_range)


def test_price_parts_are_made_once(spark):
    """The table of signs stands in the expression once for the ends of a range, once for pieces and once for a single price."""
    assert str(prices.parse(F.col("t"), F.col("u"))).count("HK$") == 3


def test_price_hint(spark):
    got = spark.range(1).select(prices.parse(F.lit("12,50"), F.lit(""), F.lit("EUR")).alias("r")).first().r.prices[0]
    assert (got.amount, got.currency) == (12.5, "EUR")


# chunks


def chunk(pos, kind="text_block", tag="p", text="", main=False, xpath=None, **attrs):
    return (1, pos, xpath or f"/html/body/{tag}[{pos}]", "/html/body", tag, kind, 2, main, text, attrs)


CHUNK = "page_id long, pos int, xpath string, parent_xpath string, tag string, kind string, depth int, in_main boolean, text string, attrs map<string,string>"


@pytest.mark.parametrize(
    "schema,given,fields",
    [
        ("Product", chunk(0, "heading", "h1", "Red shoes"), ["name"]),
        ("Product", chunk(0, text="₩ 12,000"), ["price"]),
        ("Product", chunk(0, tag="div", text="x", **{"class": "product-card price"}), ["price", "product_card"]),
        ("Product", chunk(0, text="4.5 of 5, 120 reviews"), ["rating", "review_count"]),
        ("NewsArticle", chunk(0, "heading", "h2", "Part two", itemprop="headline"), ["section_heading"]),
        ("NewsArticle", chunk(0, tag="time", text="2024-01-02"), ["date_published", "date_published"]),
        ("NewsArticle", chunk(0, text="w" * 51), ["article_body"]),
        ("WikiArticle", chunk(0, text="w" * 101), ["summary", "sections"]),
        ("SaaSPage", chunk(0, "table", "table", "Pricing of plans"), ["pricing", "pricing"]),
        ("GovernmentPage", chunk(0, text="12,000원"), []),
        ("GovernmentPage", chunk(0, text="Ministry of Works", main=True), ["department"]),
        ("FAQPage", chunk(0, "heading", "h3", "Why?"), ["question", "question"]),
        ("Event", chunk(0, text="Venue: Town hall"), ["location"]),
        ("LocalBusiness", chunk(0, text="Call (212) 555-7713"), ["telephone"]),
        ("Generic", chunk(0, "heading", "h1", "Red shoes"), []),
    ],
)
def test_matchers(spark, schema, given, fields):
    d = spark.createDataFrame([given], CHUNK).select(sm.matches(F.lit(schema)).alias("m"))
    assert [m.field for m in d.first().m] == fields


def test_prune_rules(spark):
    """Recommended prices: beyond the tenth, outside main, in another container than the first."""
    given = [chunk(0, "heading", "h1", "Shoes", main=True)] + [chunk(k, text=f"$ {k},000", xpath=f"/html/body/div[1]/p[{k}]") for k in range(1, 12)]
    given += [chunk(12, text="$ 9,000", xpath="/html/body/div[2]/p"), chunk(13, text="$ 9,000", main=True, xpath="/html/body/main/p"), chunk(14, text="short", main=True), chunk(15, "form", "form", "x", main=True), chunk(16, text="only 3 left", main=True)]
    d = sm.prune(spark.createDataFrame(given, CHUNK).withColumn("schema", F.lit("Product")))
    got = {r.pos: r for r in d.collect()}
    assert got[11].reason == "schema_match" and got[11].price_no == 11 and got[12].reason == "recommendation" and not got[12].keep and got[13].reason == "schema_match"
    assert [got[k].reason for k in (14, 15, 16)] == ["in_main_short", "in_main_form", "in_main_hv_short"] and got[16].score == 0.75
    counts = {r.reason: (r.kept, r.removed) for r in sm.reason_counts(d).collect()}
    assert counts["schema_match"] == (13, 0) and counts["recommendation"] == (0, 1)


def test_every_chunk(spark):
    """Head chunks come before the body's and are always kept."""
    from loomspan.operators.chunks import every_chunk

    html = '<head><meta property="og:title" content="T"><script type="application/ld+json">{"a": 1}</script><script>self.__next_f.push(["2024-1-2"])</script></head><body><h1>Head line</h1></body>'
    got = sm.prune(every_chunk(spark.createDataFrame([(1, html)], "page_id long, html string")).withColumn("schema", F.lit("NewsArticle"))).orderBy("pos").collect()
    assert [(r.kind, r.xpath, r.reason) for r in got[:3]] == [("meta", "/json-ld[0]", "meta_always"), ("meta", "/og-meta", "meta_always"), ("rsc_data", "/rsc-data[0]", "meta_always")]
    assert got[1].attrs == {"og:title": "T"} and got[3].reason == "schema_match" and got[3].matched == ["headline"]


def test_shorten(spark):
    rows_ = "".join(f"<tr><td>{k}</td></tr>" for k in range(6))
    given = [("text_block", "One. Two! Three? Four.", ""), ("text_block", "One. Two.", ""), ("table", "x", f"<table>{rows_}</table>"), ("list", "x", "<ul><li>a</li><li>b</li><li>c</li><li>d</li><li>e</li></ul>"), ("form", "f" * 201, "f" * 201), ("heading", "h" * 300, "")]
    got = [r.s for r in spark.createDataFrame(given, "k string, t string, h string").select(sm.shorten(F.col("k"), F.col("t"), F.col("h")).alias("s")).collect()]
    assert [g.text for g in got[:2]] == ["One. Two!...", "One. Two."]
    assert got[2].html == "<table><tr><td>0</td></tr><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>[+3 rows]</td></tr></table>"
    assert got[3].html == "<ul><li>a</li><li>b</li><li>c</li><li>[+2 items]</li></ul>" and got[4].text == "f" * 200 + "..." and len(got[5].text) == 300


def test_paths_and_merging(spark):
    paths = ["/html/body/div[10]/p", "/html/body/div[2]/p[3]", "/html/body/div/p", "/html/body/div[2]/p", "/html/body/div[2]/p[20]"]
    d = spark.createDataFrame([(p,) for p in paths], "x string").orderBy(sm.path_key(F.col("x")))
    assert [r.x for r in d.collect()] == [paths[2], paths[3], paths[1], paths[4], paths[0]]
    given = [(1, 0, "/html/body/h1", "/html/body", "<h1>t</h1>"), (1, 1, "/html/body/main/p[1]", "/html/body/main", "<p>a</p>"), (1, 2, "/html/body/main/p[2]", "/html/body/main", "<p>b</p>")]
    got = sm.remerge(spark.createDataFrame(given, "page_id long, pos int, xpath string, parent_xpath string, html string")).first().html
    assert got == '<html><body>\n<h1>t</h1>\n<main data-section="body/main">\n<p>a</p>\n<p>b</p>\n</main>\n</body></html>'


def test_compress_html(spark):
    given = '<div class="w"><p style="x" href="/a" aria-label="l" data-x="1">a</p></div><span>b</span><div><div></div></div>  \n\n <b  id=q>c</b>'
    got = spark.range(1).select(sm.compress_html(F.lit(given)).alias("h")).first().h
    assert got == '<p href="/a" aria-label="l">a</p>b \n <b>c</b>'


def test_vectors(spark):
    d = spark.createDataFrame([chunk(0, "form", "form", "one two", main=True, role="search")], CHUNK)
    v = d.select(sm.vector(F.lit('<form><a href="/">one</a> two<input></form>')).alias("v")).first().v
    assert v == pytest.approx([7 / 43, 0.5, 0.7, 0.4])


# structured data


def page(*objects, body=""):
    return "<html><head>" + "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in objects) + f"</head><body>{body}</body></html>"


def test_structured_data():
    product = {"@type": "Product", "name": " Shoe ", "offers": {"@type": "AggregateOffer", "lowPrice": "9", "offers": [{"price": "1.299,50"}], "priceCurrency": "EUR"}, "brand": {"name": "B"}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": "1,200"}, "image": ["https://x/1.png", "b"], "review": [{"reviewBody": "good"}, {"reviewBody": " "}]}
    got = jsonld.metadata(page({"@graph": [{"@type": "WebSite"}, product], "@type": "Product"}), "Product")
    assert got == {"name": "Shoe", "price": 1299.5, "currency": "EUR", "brand": "B", "rating": 4.5, "review_count": 1200, "image_url": "https://x/1.png"}
    assert jsonld.reviews([product]) == ["good"] and jsonld.gallery([product], '<div class="gallery"><img src="/c.png"><img src="data:x"></div>') == ["https://x/1.png", "b", "/c.png"]
    assert jsonld.find_type([[[[{"@type": "Event"}]]]], ("Event",)) and not jsonld.find_type([[[[[{"@type": "Event"}]]]]], ("Event",))
    event = {"@type": ["Thing", "MusicEvent"], "name": "E", "location": [{"@type": "VirtualLocation", "url": "https://v"}, {"name": "Hall", "address": {"streetAddress": "1 St", "postalCode": "9"}}], "eventStatus": "https://schema.org/EventPostponed"}
    assert jsonld.metadata(page(event), "Event") == {"name": "E", "location": "https://v, Hall, 1 St, 9", "event_status": "EventPostponed"}
    shop = {"@type": "Hotel", "name": "H", "geo": {"latitude": "1.5", "longitude": 2}, "openingHoursSpecification": [{"dayOfWeek": ["Mo", "Tu"], "opens": "9", "closes": "17"}]}
    assert jsonld.metadata(page(shop), "LocalBusiness") == {"name": "H", "geo": "1.5,2.0", "opening_hours": "Mo, Tu: 9-17"}
    video = {"@type": "VideoObject", "name": "V", "interactionStatistic": [{"interactionType": "https://schema.org/WatchAction", "userInteractionCount": "12"}, {"interactionType": {"@type": "LikeAction"}, "userInteractionCount": 3}]}
    assert jsonld.metadata(page(video), "VideoObject") == {"name": "V", "view_count": 12, "like_count": 3}
    faq = {"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Q?", "acceptedAnswer": {"text": "A"}}, {"@type": "Other", "name": "no"}]}
    assert json.loads(jsonld.metadata(page(faq), "FAQPage")["questions"]) == [{"question": "Q?", "answer": "A"}]
    trail = {"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "B"}, {"position": 1, "item": {"@id": "https://a", "name": "A"}}]}
    assert [c["name"] for c in jsonld.breadcrumbs([trail])] == ["A", "B"]


def test_structured_data_fallbacks():
    body = '<h1 itemprop="name">Long name</h1><span itemprop="price" content="12">x</span>'
    assert jsonld.metadata(page(body=body), "Product") == {"name": "Long name", "price": 12.0}
    offscreen = '<span class="a-offscreen">$19.99</span><span class="price">$5.00 shipping</span><b class="price">$7</b>'
    assert jsonld.metadata(page(body=offscreen), "Product") == {"price": 19.99}
    og = '<meta property="og:title" content="T"><meta property="og:site_name" content="Office">'
    assert jsonld.metadata(page(body=og), "GovernmentPage")["department"] == "Office"
    assert jsonld.metadata("", "Product") == {} and jsonld.metadata("<script type='application/ld+json'>{bad</script>", "Event") == {}


# cards


def test_cards():
    listed = {"@type": "ItemList", "itemListElement": [{"position": 1, "item": {"name": "A", "offers": {"price": 3}}}, {"position": 2, "name": "B", "url": "https://b"}]}
    assert [c["name"] for c in cards.cards_of(page(listed))[1]] == ["A", "B"]
    grid = "<div>" + "".join(f"<div><b>Item number {k}</b><i>${k}.50</i></div>" for k in range(1, 4)) + "</div>"
    source, got = cards.cards_of(page(body=grid))
    assert source == "dom" and got == [{"name": f"Item number {k}", "price_text": f"${k}.50"} for k in range(1, 4)]
    items = "<ul><li>Blue hat | $4.00</li><li>Red hat - $5.00</li></ul>"
    assert cards.cards_of(page(body=items)) == ("chunks", [{"name": "Blue hat", "price_text": "$4.00"}, {"name": "Red hat", "price_text": "$5.00"}])
    assert cards.cards_of("") == ("", [])


def test_serialised_cards(spark):
    given = [(1, k, "s", f"n{k}", None, None, f"${k}", "B" if k == 0 else None, None) for k in range(17)]
    got = cards.serialised(spark.createDataFrame(given, cards.CARD_SCHEMA), F.lit("fr")).first().text.split("\n")
    assert got[0] == "1. n0 | $0 | B" and got[1] == "2. n1 | $1" and len(got) == 16 and got[-1] == "... +2 de plus"


def test_bucketed(spark):
    lines = ["New arrival shoes", "12 results", "Shoe one $10", "Sort by price", "nothing here", "Shoe two $20"]
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "page_id long, pos int, line string")
    assert cards.bucketed(d, "listing", 1000).first().text == "New arrival shoes\nShoe one $10\nShoe two $20\nSort by price"
    assert cards.bucketed(d, "search", 1000).first().text == "12 results\nShoe one $10\nShoe two $20\nSort by price"
    assert cards.bucketed(d, "search", 30).first().text == "12 results\nShoe one $10"
    saas = spark.createDataFrame([(1, 0, "Acme"), (1, 1, "Acme builds forms"), (1, 2, "Pro plan 10 a month"), (1, 3, "API integration")], "page_id long, pos int, line string")
    assert cards.bucketed(saas, "saas", 1000).first().text == "Title: Acme builds forms\nPro plan 10 a month\nAPI integration"


def test_headlines(spark):
    html = "".join(f"<article><p>By Ann, today</p><h2>Headline {k}</h2><p>Something happened {k}</p></article>" for k in range(3))
    d = cards.headlines(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert cards.portal_context(d, 1000).first().text.split("\n")[:2] == ["1. Headline 0", "   Something happened 0"]


# diagnostics


def test_action_failures(spark):
    given = [("Timeout 30s", "a", "b", "none"), ("x", "a", "b", "major"), ("x", "a", "b", "none"), ("Element is not visible", "a", "a", "none"), ("intercepts pointer", "a", "a", "none"), ("was detached", "a", "a", "none"), ("x", "a", "a", "minor"), ("x", "", "b", None)]
    d = spark.createDataFrame(given, "e string, a string, b string, s string").select(diagnose.action_failure(F.col("e"), F.col("a"), F.col("b"), F.lit(False), F.col("s")).alias("d"))
    assert [(r.d.failure, r.d.confidence) for r in d.collect()] == [("timeout_exceeded", 0.95), ("navigation_unexpected", 0.9), ("navigation_unexpected", 0.85), ("element_hidden", 0.9), ("element_blocked", 0.9), ("state_changed", 0.9), ("state_changed", 0.7), ("state_changed", 0.5)]


def test_robots(spark):
    rules = spark.createDataFrame([("o", False, "/"), ("o", True, "/a"), ("o", False, "/a/*.php$"), ("o", True, "/a/x.php"), ("o", False, "/b"), ("o", True, "/b")], "origin string, allow boolean, pattern string")
    given = {"/": False, "/a": True, "/a/y.php": False, "/a/y.php?": True, "/a/x.php": False, "/b": True, "/c+d": False}
    d = spark.createDataFrame([("o", p, p) for p in given] + [("p", "/", "/")], "origin string, url string, path string")
    got = {(r.origin, r.url): r.allowed for r in diagnose.robots(d, rules).collect()}
    assert got == {("o", p): v for p, v in given.items()} | {("p", "/"): True}


def test_dismiss(spark):
    given = [(1, 1, "button", "click", "Accept all"), (1, 2, "button", "click", "Reject all"), (2, 3, "link", "click", "Reject"), (2, 4, "button", "click", "Accept"), (3, 5, "button", "click", " × "), (4, 6, "button", "click", "reject " * 10)]
    d = spark.createDataFrame(given, "page_id long, ref int, role string, affordance string, name string")
    words = {"reject": ("reject",), "accept": ("accept",), "dismiss": ("close",)}
    assert {r.page_id: (r.ref, r.tier) for r in diagnose.dismiss(d, words).collect()} == {1: (2, "reject"), 2: (4, "accept"), 3: (5, "symbol")}
    assert {r.page_id: r.tier for r in diagnose.dismiss(d, words, "accept", confirmed=False).collect()} == {1: "accept", 2: "accept"}


def test_texts(spark):
    got = spark.range(1).select(text.boundary(F.lit("a<web_content_x>b"), F.lit('u"<'), F.lit("n0"), F.lit("t")).alias("b"), text.sanitize_block(F.lit("SYSTEM: hi\n[x](javascript:alert(1)) y")).alias("s")).first()
    assert got.b == '<web_content_n0 source="u&quot;&lt;" timestamp="t">\nab\n</web_content_n0>' and got.s == "hi\n[x](blocked:javascript)) y"
    assert spark.range(1).select(text.content_hash(F.lit("hello")).alias("h")).first().h == 99162322


# machines


def steps(machine, given):
    return [machine.step({"id": k, **row}) for k, row in enumerate(given)]


def test_page_cache():
    fetch = lambda at, url: {"at": at, "op": "fetch", "url": url}
    got = steps(machines.PageCache(2, 90.0), [fetch(0, "a"), fetch(10, "a"), fetch(101, "a"), fetch(102, "b"), fetch(103, "a"), fetch(104, "c"), fetch(105, "b"), {"at": 106, "op": "scroll", "url": None}, {"at": 107, "op": "navigation", "url": None}, fetch(108, "b"), {"at": 109, "op": "timeout", "url": None}, fetch(110, "b")])
    assert [g["outcome"] for g in got] == ["miss", "hit", "expired", "miss", "hit", "miss", "miss", "soft", "hard", "hit", "hard", "miss"]
    assert [g["evicted"] for g in got][5:7] == [1, 1]


def test_template_cache():
    page_ = lambda at, main=True, removal=0.5: {"at": at, "domain": "d", "page_type": "t", "has_main": main, "source": "og", "removal": removal, "selection": 0.5}
    got = steps(machines.TemplateCache(), [page_(0), page_(1), page_(2, False), page_(3, removal=0.9), page_(4), page_(5, False), page_(6, False), page_(7, False), page_(8), page_(90_000)])
    assert [g["outcome"] for g in got] == ["learned", "passed", "failed", "failed", "passed", "failed", "failed", "dropped", "learned", "learned"]
    assert got[2]["mismatches"] == "has_main" and got[3]["mismatches"] == "removal"


def test_auto_threshold():
    low = steps(machines.AutoThreshold(), [{"at": k, "confidence": 0.2, "budget": 1500} for k in range(40)])
    assert [g["adjustment"] for g in low] == [0] * 19 + [225] * 20 + [450] and low[-1]["budget"] == 1950
    m = machines.AutoThreshold()
    steps(m, [{"at": k, "confidence": 0.2, "budget": 1500} for k in range(20)])
    high = steps(m, [{"at": k, "confidence": 0.9, "budget": 1500} for k in range(20, 80)])
    assert high[38]["adjustment"] == 225 and high[59]["adjustment"] == 175


def test_robots_cache():
    at = lambda t, status, age=None: {"at": t, "status": status, "max_age": age}
    got = steps(machines.RobotsCache(), [at(0, 200, 10.0), at(59, 500), at(60, 500), at(359, 200), at(360, 403), at(3959, 200), at(3960, None)])
    assert [(g["cached"], g["policy"]) for g in got] == [(False, "rules"), (True, "rules"), (False, "allow_all"), (True, "allow_all"), (False, "disallow_all"), (True, "disallow_all"), (False, "allow_all")]


def test_tabs():
    op = lambda at, op, name: {"at": at, "op": op, "name": name}
    got = steps(machines.Tabs(), [op(0, "open", "a"), op(1, "open", "a"), op(2, "open", "b c"), *[op(3, "open", f"t{k}") for k in range(5)], op(4, "switch", "a"), op(5, "close", "a"), op(6, "switch", "a"), op(1900, "open", "z")])
    assert [g["status"] for g in got] == ["ok", "tab_exists", "invalid_name", "ok", "ok", "ok", "ok", "max_tabs_reached", "ok", "ok", "tab_not_found", "ok"]
    assert got[-1]["tabs"] == 1 and got[9]["active"] == "t3"


def test_single_flight_and_flow():
    got = steps(machines.SingleFlight(), [{"at": 0, "seconds": 5}, {"at": 4, "seconds": 9}, {"at": 5, "seconds": 1}])
    assert [(g["leader"], g["joined"]) for g in got] == [(0, False), (0, True), (2, False)]
    flow = steps(machines.PurchaseFlow(), [{"step": "barrier", "good": True}, {"step": "discovery", "good": True}, {"step": "product", "good": True}, {"step": "cart", "good": False}, {"step": "cart", "good": None}, {"step": "product", "good": True}, {"step": "barrier", "good": None}])
    assert [g["state"] for g in flow] == ["barrier_resolved", "discovery_analyzed", "product_analyzed", "product_analyzed", "flow_failed", "flow_failed", "barrier_check"] and flow[-1]["successes"] == 5


def test_greedy_buckets():
    el = lambda bucket, tokens: {"bucket": bucket, "tokens": tokens, "budget": 10}
    got = steps(machines.GreedyBuckets(), [el(0, 4), el(0, 7), el(0, 1), el(1, 6), el(1, 1), el(2, 0)])
    assert [g["kept"] for g in got] == [True, False, False, True, False, True]


def test_fold_deals_every_key_in_order(spark):
    """Many keys, a null key and one with half of all rows: each key's rows pass through its own machine once, in order."""

    class Count:
        def __init__(self):
            self.n, self.last = 0, -1

        def step(self, row):
            assert row["at"] >= self.last
            self.n, self.last = self.n + 1, row["at"]
            return {"id": row["id"], "n": self.n}

    d = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 5 > 0, F.col("id") % 97).alias("key"), (F.col("id") * 7919 % 20_000).alias("at"), "id")
    got = machines.fold(d, "key", ["at", "id"], Count, "id long, n long").join(d, "id").groupBy("key").agg(F.count("*").alias("rows"), F.max("n").alias("n")).collect()
    assert sum(r.rows for r in got) == 20_000 and all(r.rows == r.n for r in got) and any(r.key is None for r in got)


# prompts


def _row(**over):
    base = {"url": "u", "title": "T", "page_type": "listing", "warnings": None, "barrier": None, "diagnostics": None, "ecommerce": None, "actions": "[1] button: a (click)\n[2] link: b (click)", "navigation": "~3 pages", "info": "text " * 200, "images": None}
    return base | over


def test_prompts(spark):
    from loomspan.operators import prompts

    kind = "struct<" + ",".join(f"{k}:string" for k in _row()) + ">"
    pairs = [(_row(), _row()), (_row(), _row(actions="[1] button: a (click)")), (_row(), _row(info="other " * 200)), (_row(actions=None, info=None), _row(info=None))]
    got = [r.u for r in spark.createDataFrame(pairs, f"o {kind}, n {kind}").select(prompts.update(F.col("o"), F.col("n")).alias("u")).collect()]
    assert got[0] == "Page update\nStatus: unchanged\nRefs: 1-2 still valid" and got[2] is None and got[3] is None
    assert got[1].startswith("Page update\nStatus: updated | refs expired\nChanges:\n- Actions: 1 removed items (1 total)\n\nURL: u\nTitle: T\nType: listing\n") and "## Info — unchanged" in got[1] and "## Actions (1 total)\n[1] button: a (click)" in got[1]
    full = spark.createDataFrame([(_row(info="i"),)], f"p {kind}").select(prompts.whole(F.col("p")).alias("w")).first().w
    assert full == "URL: u\nTitle: T\nType: listing\n\n## Actions\n[1] button: a (click)\n[2] link: b (click)\n\n## Navigation\n~3 pages\n\n## Info\ni\n"


def test_pieces(spark):
    from loomspan.operators import prompts

    one = spark.range(1)
    html = '<script>self.__next_f.push([1,"2024-01-02"])</script><script>x</script><script>self.__next_f.push([1])</script>'
    (r,) = prompts.rsc_dates(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert (r.xpath, r.text) == ("/rsc-data[0]", "RSC dates: 2024-01-02")
    merged = one.select(*[prompts.with_structured_image(F.array(F.lit("https://a/1.jpg?w=10"), F.lit("b")), F.lit(x)).alias(f"c{k}") for k, x in enumerate(("https://n/2.jpg", "https://a/1.jpg?w=99", "javascript:x", "https://a/logo.png"))]).first()
    assert merged.c0[0] == "https://n/2.jpg" and [len(merged[k]) for k in range(4)] == [3, 2, 2, 2]
    p = one.select(prompts.pages_of(F.lit('Page 2 of 9 <a href="/x?page=12">3</a> 1,234 results <b>Next</b><i class="prev">')).alias("p")).first().p
    assert tuple(p) == (2, 12, "of 9", True, True) or tuple(p) == (2, 12, "1,234 results", True, True)
    given = [(1, "https://www.amazon.de/x", '<i class="a-price"><b>12,00</b></i>', "product_detail", None, None), (2, "https://www.coupang.com/x", "", "listing", "5", "")]
    hints = {r.page_id: (r.price_text, r.currency, r.applied) for r in prompts.site_hints(spark.createDataFrame(given, "page_id long, url string, html string, page_type string, price_text string, currency string")).collect()}
    assert hints == {1: ("12,00", None, ["amazon_price"]), 2: ("5", "KRW", ["coupang_currency"])}
    page_ = '<div><div class="x" style="color:red"><p id="a" title="t">one &amp; two</p></div></div><!-- c --><p style="display:none">no</p><script>s</script><b aria-hidden="true">no</b>'
    assert prompts.baseline(page_) == '<div><div class="x" style="color:red"><p id="a" title="t">one &amp; two</p></div></div>'
    assert prompts.baseline(page_, True) == '<p title="t">one &amp; two</p>' and prompts.baseline("") == ""
    src = lambda a, b, og: one.select(prompts.source_of(F.array(*[F.lit(x) for x in a]).cast("array<string>"), F.array(*[F.lit(x) for x in b]).cast("array<string>"), F.lit(og)).alias("s")).first().s
    assert [src(["name", "price"], ["name"], False), src(["price", "items"], ["items"], True), src(["name"], [], True), src(["name"], [], False), src([], [], False)] == ["json_ld", "", "og", "itemprop", ""]


def test_picture_sources(spark):
    from loomspan.operators import extract

    html = '<picture><source srcset="/a.jpg 300w, /b.jpg 900w"><source srcset="c.jpg 1x, https://x.example/d.jpg 2x"><img src="/f.jpg"></picture><picture><source srcset="/e.jpg, /g.jpg"></picture>'
    d = spark.createDataFrame([(1, "https://s.example/p/q", html)], "page_id long, url string, html string")
    assert [r.src for r in extract.picture_sources(d).orderBy("i", "j").collect()] == ["/b.jpg", "https://x.example/d.jpg", "/e.jpg"]
    assert [r.url for r in extract.images(d).orderBy("rank").collect()] == ["https://s.example/b.jpg", "https://x.example/d.jpg", "https://s.example/e.jpg", "https://s.example/f.jpg"]


def test_cart_and_search(spark):
    from loomspan.operators import commerce

    given = [(1, 1, "button", "Add to cart", "click", []), (1, 2, "combobox", "Size", "select", ["S", "M"]), (1, 3, "combobox", "Qty", "select", ["1"]), (2, 1, "button", "Buy now", "click", []), (2, 2, "link", "add to cart now", "click", []), (3, 1, "combobox", "Sort by", "select", ["price", "new"])]
    e = spark.createDataFrame(given, "page_id long, ref int, role string, name string, affordance string, options array<string>")
    got = {r.page_id: r for r in commerce.cart_actions(e, e.filter("page_id = 1 and ref = 3")).collect()}
    assert (got[1].add_to_cart_ref, got[1].quantity_ref, got[1].prerequisites, got[1].flow_state) == (1, 3, ["Select Size"], "select_options")
    assert (got[2].add_to_cart_ref, got[2].buy_now_ref, got[2].flow_state) == (2, 1, "ready_to_add")
    pages_ = spark.createDataFrame([(3, "https://s.example/search?q=red+hat", "Page 2 of 7")], "page_id long, url string, html string")
    found = spark.createDataFrame([(3, "Hat"), (3, "Hat (sponsored)"), (3, "Bad hat")], "page_id long, name string")
    r = commerce.search_summary(pages_, e, found).first()
    assert (r.query, r.sort_ref, r.sort_options, r.cards, r.sponsored, r.current_page, r.total_pages) == ("red hat", 1, ["price", "new"], 3, 1, 2, 7)
    s = spark.range(1).select(commerce.cart_state(F.lit('<b class="cart-count">3</b> Item added!')).alias("s")).first().s
    assert tuple(s) == (True, 3)
