"""More registered queries: prices, tiers, buckets, cards, structured data, diagnostics and keyed machines, with SQL where it can say the same.

Where a table has no page semantics its columns play the roles that a docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import fixed, terms
from loomspan.functions import prices, text, urls
from loomspan.operators import cards, classify, commerce, detect, diagnose, dom, extract, jsonld
from loomspan.operators import schema_match as sm
from loomspan.operators.chunks import every_chunk
from loomspan.plans import digest, fixtures
from loomspan.plans.queries import LINES, P, QUERIES, SQL, _host_case, _pages, _t, _tokens, _trim, query
from loomspan.sources import pages as sources
from loomspan.streaming import machines

__all__ = ["QUERIES", "SQL"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {other} END"


# prices: parts as offers in the notations of many shops

#: Offers in terms of whole amount {w}, grouped by commas {c} or points {p}, cents {d}; one for each remainder of the part's key.
OFFERS = (
    "${c}.{d}", "{p},{d} €", "₩{c}", "from ${w}.{d}", "${w}.{d} ~ ${w}9.{d}", "${w}.{d} (약 ₩{c})", "Free shipping and handling", "Sold out", "US${w}.{d}", "{w} kr", "¥ {c}",
    "INR 1,{c}.{d}", "R$ {p},{d}", "{c}원부터", "{w} – {w}5 EUR", "", "call us", "S${w}.5", "1.{d}4", "{p}.567", "12,{d} CHF", "à partir de {w},{d} €", "٣٤٥ SAR", "HK${w}",
    "{w}.{d} to {w}1.{d} USD", "RMB {c}", "starting at £{w}", "{w},5 JPY", "  ", "$ {w} (≈ £{w}.{d}) (~ €1)",
)
SHOPS = ("", "https://shop.example.com.au/x", "https://store.example.jp/", "https://item.taobao.com/1", "https://butik.example.se/", "https://shop.example.kr/", "https://www.example.com/")


def _offers(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("a"))
    whole, cents = F.floor(F.col("a") / 100).cast("string"), F.lpad((F.col("a") % 100).cast("string"), 2, "0")
    grouped = lambda sign: F.regexp_replace(whole, r"^([0-9]+)([0-9]{3})$", rf"$1{sign}$2")
    shape = F.element_at(F.array(*[F.lit(o) for o in OFFERS]), (F.col("p_partkey") % len(OFFERS) + 1).cast("int"))
    offer = shape
    for mark, value in (("{w}", whole), ("{c}", grouped(",")), ("{p}", grouped(".")), ("{d}", cents)):
        offer = F.replace(offer, F.lit(mark), value)
    shop = F.element_at(F.array(*[F.lit(s) for s in SHOPS]), (F.col("p_partkey") % len(SHOPS) + 1).cast("int"))
    return d.select("p_partkey", offer.alias("offer"), shop.alias("shop"))


def _offers_sql() -> str:
    whole, cents = "CAST(a // 100 AS VARCHAR)", "lpad(CAST(a % 100 AS VARCHAR), 2, '0')"
    grouped = lambda sign: rf"regexp_replace({whole}, '^([0-9]+)([0-9]{{3}})$', '\1{sign}\2')"
    shape = f"list_extract([{', '.join(map(_q, OFFERS))}], CAST(p_partkey % {len(OFFERS)} + 1 AS INTEGER))"
    for mark, value in (("{w}", whole), ("{c}", grouped(",")), ("{p}", grouped(".")), ("{d}", cents)):
        shape = f"replace({shape}, '{mark}', {value})"
    shop = f"list_extract([{', '.join(map(_q, SHOPS))}], CAST(p_partkey % {len(SHOPS)} + 1 AS INTEGER))"
    return f"(SELECT p_partkey, {shape} AS offer, {shop} AS shop FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS a FROM part))"


def _currency_sql(x: str) -> tuple[str, str]:
    """Code and confidence of text column x with host h and url shop."""
    has = lambda sign: f"contains({x}, {_q(sign)})"
    c, iso = prices.CONFIDENCE, f"regexp_extract({x}, {_q(prices.ISO_PATTERN)}, 1)"
    rules: list[tuple[str, str, float]] = [(has(s), _q(code), c["sign"]) for s, code in prices.MULTI + prices.SINGLE]
    rules += [(has(s), _q(code), c["suffix"]) for s, code in prices.SUFFIX]
    rules.append((f"{iso} <> ''", f"CASE {iso} WHEN 'RMB' THEN 'CNY' ELSE {iso} END", c["iso"]))
    for sign, domains, endings, default in prices.AMBIGUOUS:
        rules += [(f"{has(sign)} AND (h = '{d}' OR ends_with(h, '.{d}'))", _q(code), c["domain"]) for d, code in domains]
        rules += [(f"{has(sign)} AND ends_with(h, '{e}')", _q(code), c["ending"]) for e, code in endings]
        rules.append((has(sign), _q(default), c["default"]))
    rules.append(("shop <> ''", _host_case(fixed.by_host(fixed.CURRENCY_DOMAINS), "'USD'"), c["url"]))
    return _case([(a, b) for a, b, _ in rules], "'USD'"), f"CAST({_case([(a, str(s)) for a, _, s in rules], str(c['none']))} AS DOUBLE)"


def _number_sql(x: str, code: str) -> str:
    t = f"regexp_replace(translate({x}, {_q(prices.DIGITS[0])}, {_q(prices.DIGITS[1])}), '[^0-9,.]', '', 'g')"
    after = lambda s: f"length(list_extract(string_split(t, '{s}'), -1))"
    count = lambda s: f"(length(t) - length(replace(t, '{s}', '')))"
    parts = f"k NOT IN ({', '.join(map(_q, prices.WHOLE_ONLY))})"
    plain = _case(
        [
            (f"contains(t, ',') AND contains(t, '.') AND {after(',')} < {after('.')}", "replace(replace(t, '.', ''), ',', '.')"),
            ("contains(t, ',') AND contains(t, '.')", "replace(t, ',', '')"),
            (f"contains(t, ',') AND {count(',')} = 1 AND {after(',')} <= 2 AND {parts}", "replace(t, ',', '.')"),
            ("contains(t, ',')", "replace(t, ',', '')"),
            (f"{count('.')} > 1", "replace(t, '.', '')"),
            (f"contains(t, '.') AND {after('.')} = 3", "replace(t, '.', '')"),
        ],
        "t",
    )
    return f"(SELECT TRY_CAST({plain} AS DOUBLE) FROM (SELECT {t} AS t, {code} AS k))"


def _prices_sql() -> str:
    any_ = lambda words: terms.any_of(tuple(w.lower() for w in words))
    host = r"lower(regexp_extract(regexp_extract(shop, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1))"
    code, sure = _currency_sql("x")
    return f"""
        WITH o AS (SELECT *, {host} AS h, {_trim("offer")} AS t FROM {_offers_sql()}),
        w AS (SELECT *, lower(t) AS low, {_trim(f"regexp_extract(t, {_q(prices.RANGE)}, 1)")} AS lo, {_trim(f"regexp_extract(t, {_q(prices.RANGE)}, 2)")} AS hi, regexp_matches(lower(t), {_q(prices.FROM)}) AS is_from,
                     {_trim(f"regexp_extract(t, {_q(prices.FROM)}, 2)")} AS behind, {_trim(f"regexp_extract(t, {_q(prices.FROM)}, 1)")} AS front FROM o),
        v AS (SELECT *, CASE WHEN is_from THEN CASE WHEN behind <> '' THEN behind ELSE front END ELSE t END AS work FROM w),
        part AS (SELECT p_partkey, h, shop, 'lo' AS role, 0 AS k, lo AS x FROM v UNION ALL SELECT p_partkey, h, shop, 'hi', 0, hi FROM v UNION ALL SELECT p_partkey, h, shop, 'one', 0, work FROM v
                 UNION ALL SELECT p_partkey, h, shop, 'piece', unnest(range(len(l))), unnest(l) FROM (SELECT p_partkey, h, shop, list_filter(list_transform(regexp_split_to_array(work, {_q(prices.SECOND)}), lambda p: {_trim(r"regexp_replace(p, '\)+$', '')")}), lambda p: p <> '') AS l FROM v)),
        coded AS (SELECT *, {code} AS code, {sure} AS sure FROM part),
        paid AS (SELECT *, {_number_sql("x", "code")} AS amount FROM coded),
        pieces AS (SELECT p_partkey, count(*) AS n, count(amount) AS good FROM paid WHERE role = 'piece' GROUP BY p_partkey),
        lo AS (SELECT * FROM paid WHERE role = 'lo'), hi AS (SELECT * FROM paid WHERE role = 'hi'), one AS (SELECT * FROM paid WHERE role = 'one'),
        f AS (SELECT v.p_partkey, CASE WHEN t = '' THEN 'none' WHEN regexp_matches(low, {_q(any_(terms.FREE_PRICE))}) THEN 'free' WHEN regexp_matches(low, {_q(any_(terms.UNAVAILABLE_PRICE))}) THEN 'unavailable'
                       WHEN lo.x <> '' AND hi.x <> '' AND lo.amount IS NOT NULL AND hi.amount IS NOT NULL THEN 'range' WHEN n >= 2 AND good >= 2 THEN 'cross' WHEN one.amount IS NOT NULL THEN 'single' ELSE 'none' END AS form,
                     CASE WHEN is_from THEN 'from' ELSE 'exact' END AS kind, lo.code AS lo_code
              FROM v JOIN lo USING (p_partkey) JOIN hi USING (p_partkey) JOIN one USING (p_partkey) LEFT JOIN pieces USING (p_partkey))
        SELECT p_partkey, 0 AS k, 0.0 AS amount, 'USD' AS currency, CAST(CASE form WHEN 'free' THEN 0.9 ELSE 0.85 END AS DOUBLE) AS confidence, form AS price_type FROM f WHERE form IN ('free', 'unavailable')
        UNION ALL SELECT p_partkey, 0, amount, code, sure, 'range_low' FROM f JOIN lo USING (p_partkey) WHERE form = 'range'
        UNION ALL SELECT p_partkey, 1, amount, code, sure, 'range_high' FROM f JOIN hi USING (p_partkey) WHERE form = 'range'
        UNION ALL SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY paid.k) - 1 AS INTEGER), amount, code, round(sure * 0.9, 4), kind FROM f JOIN paid USING (p_partkey) WHERE form = 'cross' AND role = 'piece' AND amount IS NOT NULL
        UNION ALL SELECT p_partkey, 0, amount, code, sure, kind FROM f JOIN one USING (p_partkey) WHERE form = 'single'"""


@query(_prices_sql())
def parse_prices(spark, sf_dir):
    """Prices of offers, with parts as offers."""
    d = _offers(spark, sf_dir).select("p_partkey", prices.parse(F.col("offer"), F.col("shop")).alias("r"))
    return d.select("p_partkey", F.posexplode("r.prices").alias("k", "p")).select("p_partkey", "k", "p.amount", "p.currency", F.round("p.confidence", 4).alias("confidence"), "p.price_type")


@query(f"SELECT p_partkey, {_currency_sql('x')[0]} AS currency, {_currency_sql('x')[1]} AS confidence FROM (SELECT p_partkey, shop, offer AS x, lower(regexp_extract(shop, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h FROM {_offers_sql()})")
def offer_currency(spark, sf_dir):
    d = _offers(spark, sf_dir)
    return d.select("p_partkey", prices.currency(F.col("offer"), F.col("shop")).alias("c")).select("p_partkey", F.col("c.code").alias("currency"), "c.confidence")


# tiers, with order lines as chunks: return flag and line status are the reason, discount the fitness, quantity the budget's pressure

_REASON = "CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'in_main_text' WHEN 'NF' THEN 'meta_always' WHEN 'RF' THEN 'schema_match' WHEN 'AF' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'in_main_heading' ELSE 'no_match' END ELSE 'in_main_short' END"
_LINE_CHUNKS = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_REASON} AS reason, l_discount * 8 AS fitness, l_extendedprice, l_tax FROM lineitem)"


@query(
    f"SELECT l_orderkey, l_linenumber, CASE WHEN keep AND max(coalesce(t IN ('A', 'B'), false)) OVER (PARTITION BY l_orderkey) = false THEN 'A' ELSE t END AS tier FROM (SELECT *, CASE WHEN NOT keep THEN NULL WHEN reason = 'meta_always' THEN 'A' WHEN reason = 'schema_match' AND fitness >= 0.725 * 0.75 THEN 'A'"
    f" WHEN fitness >= 0.725 THEN 'A' WHEN reason = 'in_main_heading' THEN 'B' WHEN fitness >= 0.325 THEN 'B' ELSE 'C' END AS t FROM (SELECT *, reason NOT IN ('no_match', 'in_main_short') AS keep FROM {_LINE_CHUNKS}))"
)
def chunk_tiers(spark, sf_dir):
    """Tiers at half pressure; a page without A or B has all A."""
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_REASON).alias("reason"), (F.col("l_discount") * 8).alias("fitness"), F.col("l_orderkey").alias("page_id"))
    return sm.tiers(d.withColumn("keep", ~F.col("reason").isin("no_match", "in_main_short")), 0.5).select("l_orderkey", "l_linenumber", "tier")


_TASK = "list_extract(['search', 'detail', 'cart', 'form', 'general', 'unknown'], CAST(l_linenumber % 6 + 1 AS INTEGER))"
_VEC = "[l_quantity / 50, l_discount * 10, l_tax * 12, (l_partkey % 7) / 7.0]"
_WANT = _case([(f"task = '{k}'", str(list(map(float, v)))) for k, v in sm.TASKS.items()], str(list(sm.TASKS["general"])))
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


@query(
    f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE reason WHEN 'meta_always' THEN 1.0 WHEN 'schema_match' THEN greatest(s, 0.5) ELSE s END, 6) AS fitness FROM (SELECT *, CASE WHEN {_DOT('v', 'v')} > 0 THEN {_DOT('v', 'w')} / (sqrt({_DOT('v', 'v')}) * sqrt({_DOT('w', 'w')})) ELSE 0 END AS s"
    f" FROM (SELECT *, {_WANT} AS w FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_REASON} AS reason, {_TASK} AS task, {_VEC} AS v FROM lineitem)))"
)
def chunk_fitness(spark, sf_dir):
    """Fitness of chunks for their task; an unknown task is a general one."""
    d = _t(spark, sf_dir, "lineitem")
    task = F.element_at(F.array(*[F.lit(x) for x in ("search", "detail", "cart", "form", "general", "unknown")]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    v = F.array(*[x.cast("double") for x in (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12, (F.col("l_partkey") % 7) / 7)])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round(sm.fitness(v, task, F.expr(_REASON)), 6).alias("fitness"))


@query(f"SELECT l_orderkey AS page_id, reason, CAST(count(*) FILTER (WHERE reason NOT IN ('no_match', 'in_main_short')) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE reason IN ('no_match', 'in_main_short')) AS BIGINT) AS removed FROM {_LINE_CHUNKS} GROUP BY ALL")
def reason_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.expr(_REASON).alias("reason"))
    return sm.reason_counts(d.withColumn("keep", ~F.col("reason").isin("no_match", "in_main_short")))


# paths: order lines as chunks of their order's page

_XPATH = "'/html/body/' || CASE WHEN l_linestatus = 'O' THEN 'main' ELSE 'div[' || (l_suppkey % 12) || ']' END || '/p' || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE '[' || (l_partkey % 30) || ']' END"
_PARENT = "'/html/body/' || CASE WHEN l_linestatus = 'O' THEN 'main' ELSE 'div[' || (l_suppkey % 12) || ']' END"
_STEPS = "list_transform(list_filter(string_split(xpath, '/'), lambda s: s <> ''), lambda s: {'t': regexp_extract(s, '^([^\\[]+)', 1), 'i': coalesce(TRY_CAST(nullif(regexp_extract(s, '\\[([0-9]+)\\]$', 1), '') AS INTEGER), 0)})"
_PATHS = f"(SELECT l_orderkey AS page_id, l_linenumber * 1000000 + l_partkey AS pos, {_XPATH} AS xpath, {_PARENT} AS parent_xpath, '<p>' || l_partkey || '</p>' AS html FROM lineitem)"


def _paths(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page_id", "l_linenumber * 1000000 + l_partkey AS pos", f"{_XPATH} AS xpath", f"{_PARENT} AS parent_xpath", "'<p>' || l_partkey || '</p>' AS html")


@query(f"SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {_STEPS}, pos) AS INTEGER) AS place FROM {_PATHS}")
def xpath_order(spark, sf_dir):
    w = Window.partitionBy("page_id").orderBy(sm.path_key(F.col("xpath")), "pos")
    return _paths(spark, sf_dir).select("page_id", "pos", F.row_number().over(w).alias("place"))


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {_STEPS}, pos) AS r FROM {_PATHS}), n AS (SELECT *, CASE WHEN lag(parent_xpath) OVER (PARTITION BY page_id ORDER BY r) = parent_xpath THEN 0 ELSE 1 END AS s FROM k),
        i AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY r) AS i FROM n), g AS (SELECT page_id, i, min(parent_xpath) AS p, count(*) AS n, string_agg(html, chr(10) ORDER BY r) AS inner_ FROM i GROUP BY ALL),
        w AS (SELECT *, regexp_extract(list_extract(string_split(p, '/'), -1), '^([a-z]+)', 1) AS tag, regexp_replace(p, '^/html/', '') AS sec FROM g)
        SELECT page_id, '<html><body>' || chr(10) || string_agg(CASE WHEN n > 1 THEN '<' || tag || ' data-section="' || sec || '">' || chr(10) || inner_ || chr(10) || '</' || tag || '>' ELSE inner_ END, chr(10) ORDER BY i) || chr(10) || '</body></html>' AS html FROM w GROUP BY page_id"""
)
def remerged(spark, sf_dir):
    """Chunks merged again by parent, in path order."""
    return sm.remerge(_paths(spark, sf_dir))


_SECTIONS = "(SELECT l_orderkey AS page_id, l_linenumber * 1000000 + l_partkey AS pos, l_linestatus AS parent_xpath, CASE l_linenumber % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'list' WHEN 3 THEN 'form' ELSE 'text_block' END AS kind, l_shipmode || ' ' || l_partkey AS text, l_returnflag = 'R' AS dropped FROM lineitem)"
_SECTIONS = _SECTIONS.replace("l_shipmode || ' ' || ", "'Section ' || ")


@query(
    f"""WITH l AS (SELECT *, coalesce(substr(first_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id, parent_xpath ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1, 50),
            CASE kind WHEN 'text_block' THEN 'Text Block' WHEN 'table' THEN 'Table' WHEN 'list' THEN 'List' WHEN 'form' THEN 'Form' ELSE kind END) AS label FROM {_SECTIONS})
        SELECT page_id, min(pos) AS pos, '[Section: ' || arg_min(label, pos) || ' (' || count(*) || ' items)]' AS text FROM l WHERE dropped GROUP BY page_id, parent_xpath"""
)
def dropped_sections(spark, sf_dir):
    """References to what the budget dropped, by section."""
    d = _t(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_id", "l_linenumber * 1000000 + l_partkey AS pos", "l_linestatus AS parent_xpath",
        "CASE l_linenumber % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'list' WHEN 3 THEN 'form' ELSE 'text_block' END AS kind",
        "'Section ' || l_partkey AS text", "l_returnflag = 'R' AS dropped", "CAST(map() AS map<string,string>) AS attrs",
    )
    return sm.dropped_references(sm.label(d))


# contexts by bucket


def _bucket_sql(style: str) -> str:
    least, titled, some = cards.BUCKETS[style]
    place = _case([(c.sql(), str(k) if name else "NULL") for k, (name, c, _, _) in enumerate(some)], "NULL")
    title = "min(CASE WHEN length(line) > 10 THEN pos END) OVER (PARTITION BY page_id)" if titled else "CAST(NULL AS BIGINT)"
    keep = "pos >= first_" if titled else "true"
    most = _case([(f"b = {k}", str(m)) for k, (_, _, m, _) in enumerate(some)], "1")
    cut = _case([(f"b = {k}", str(c)) for k, (_, _, _, c) in enumerate(some)], "10000")
    return f"""WITH l AS (SELECT *, {title} AS first_ FROM {LINES} WHERE length(line) >= {least}), b AS (SELECT *, CASE WHEN pos = first_ THEN -1 ELSE {place} END AS b FROM l WHERE {keep}),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id, b ORDER BY pos) AS n FROM b WHERE b IS NOT NULL), p AS (SELECT page_id, b, pos, CASE WHEN b = -1 THEN 'Title: ' || line ELSE substr(line, 1, {cut}) END AS part FROM n WHERE n <= {most}),
        r AS (SELECT *, sum(length(part) + 1) OVER (PARTITION BY page_id ORDER BY b, pos) AS run FROM p) SELECT page_id, string_agg(part, chr(10) ORDER BY b, pos) AS text FROM r WHERE run <= 900 GROUP BY page_id"""


def _bucket_query(style: str):
    def run(spark, sf_dir) -> DataFrame:
        return cards.bucketed(extract.text_lines(_pages(spark, sf_dir)), style, 900)

    return run


for _name in cards.BUCKETS:
    QUERIES[f"context_{_name}"] = _bucket_query(_name)
    SQL[f"context_{_name}"] = _bucket_sql(_name)


@query()
def context_article(spark, sf_dir):
    return cards.outline(dom.chunks(_pages(spark, sf_dir)), 3, 1500)


@query()
def context_wiki(spark, sf_dir):
    return cards.outline(dom.chunks(_pages(spark, sf_dir)), 2, 1500)


@query()
def context_portal(spark, sf_dir):
    return cards.portal_context(cards.headlines(_pages(spark, sf_dir)), 1500)


def _cards(spark, sf_dir) -> DataFrame:
    p = _pages(spark, sf_dir)
    return cards.cards(p).join(p.select("page_id", urls.locale(F.col("url")).alias("locale")), "page_id")


@query()
def product_cards(spark, sf_dir):
    return cards.cards(_pages(spark, sf_dir))


@query()
def context_cards(spark, sf_dir):
    return cards.card_context(extract.text_lines(_pages(spark, sf_dir)), cards.serialised(_cards(spark, sf_dir), F.col("locale")))


@query()
def context_with_least(spark, sf_dir):
    """The default context, never near empty."""
    p = _pages(spark, sf_dir)
    lines = extract.text_lines(p)
    own = p.join(digest.compress(lines, 250), "page_id", "left").join(classify.classify(p).select("page_id", "page_type"), "page_id").select("page_id", "html", "page_type", F.coalesce("text", F.lit("")).alias("text"))
    return cards.least_content(own, extract.og_meta(p), lines, 1500)


@query()
def cart_actions(spark, sf_dir):
    e = extract.interactables(_pages(spark, sf_dir))
    return commerce.cart_actions(e, e.filter("false"))


@query()
def search_summary(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return commerce.search_summary(p, extract.interactables(p), cards.cards(p))


# structured data


def _typed(spark, sf_dir) -> DataFrame:
    """Every page under each schema that has structured data of its own."""
    return _pages(spark, sf_dir).withColumn("schema", F.explode(F.array(*[F.lit(s) for s in jsonld.FIELDS])))


@query()
def structured_fields(spark, sf_dir):
    return jsonld.fields(_typed(spark, sf_dir))


@query()
def schema_chunks(spark, sf_dir):
    """Prune decisions under the page's schema."""
    p = _pages(spark, sf_dir)
    return sm.prune(every_chunk(p).join(p.select("page_id", urls.schema(F.col("url")).alias("schema")), "page_id")).select("page_id", "pos", "kind", "reason", "keep", "score", "matched", "price_no")


@query()
def short_chunks(spark, sf_dir):
    """Chunks of pages in their shortened form."""
    c = dom.chunks(_pages(spark, sf_dir))
    return c.select("page_id", "pos", "kind", sm.shorten(F.col("kind"), F.col("text"), F.col("text"))["text"].alias("text"))


@query()
def compressed_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", sm.compress_html(extract.clean(F.col("html"))).alias("html"))


@query()
def page_complexity(spark, sf_dir):
    """Nodes, complexity, landmarks and size verdict of a page."""
    n = dom.nodes(_pages(spark, sf_dir))
    marks = {"main": ("main",), "nav": ("nav",), "header": ("header",), "footer": ("footer",), "aside": ("aside",)}
    share = lambda tags: F.round(F.count_if(F.col("tag").isin(*tags)) / F.count("*"), 3)
    out = n.groupBy("page_id").agg(F.count("*").alias("nodes"), F.avg("depth").alias("depth"), *[share(t).alias(k) for k, t in marks.items()], F.count_if(F.col("tag").isin("a", "button", "input", "select", "textarea")).alias("interactive"))
    return out.select("page_id", "nodes", F.round(F.least(F.lit(1.0), F.col("nodes") * (F.col("depth") / 20) / 5000), 6).alias("complexity"), *marks, "interactive", (F.col("nodes") <= fixed.MAX_DOM_NODES).alias("allowed"))


# texts

_CONTROL = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFB}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


def _block_sql(x: str) -> str:
    from loomspan.plans.queries import _entities

    x = rf"regexp_replace(replace({_entities(x)}, chr(160), ' '), chr(27) || '\[[0-9;]*[a-zA-Z]', '', 'g')"
    x = f"regexp_replace({x}, '{_CONTROL}', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)\[?[ \t\r\n]*(?:SYSTEM|ASSISTANT|USER|HUMAN|AI|ADMIN|INSTRUCTION|OVERRIDE|IMPORTANT|IGNORE|HACK|COMMAND)[ \t\r\n]*[:\]][ \t\r\n]*', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<[ \t]*/?[ \t]*web_content[a-z0-9_]*[^>]*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)\[([^\]]*)\]\([ \t]*(javascript|vbscript|data|blob)[ \t]*:[^)]*\)', '[\1](blocked:\2)', 'g')"
    x = rf"regexp_replace({x}, '(?i)<[ \t]*(javascript|vbscript|data|blob)[ \t]*:[^>]*>', '[blocked link]', 'g')"
    return f"substr({x}, 1, 50000)"


@query(f"SELECT page_id, md5({_block_sql('html')}) AS safe_md5, '<web_content_' || substr(md5(CAST(page_id AS VARCHAR)), 1, 16) || ' source=\"' || replace(replace(replace(url, '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '\" timestamp=\"2026-01-01T00:00:00Z\">' AS opened FROM {P}")
def sanitize_blocks(spark, sf_dir):
    """Blocks made safe, and the boundary that a page's block is opened with (its nonce a digest of the page id here)."""
    p = _pages(spark, sf_dir)
    nonce = F.substring(F.md5(F.col("page_id").cast("string")), 1, 16)
    opened = F.substring_index(text.boundary(F.lit("x"), F.col("url"), nonce, F.lit("2026-01-01T00:00:00Z")), "\n", 1)
    return p.select("page_id", F.md5(text.sanitize_block(F.col("html"))).alias("safe_md5"), opened.alias("opened"))


@query(
    f"SELECT doc_id, tokens, CASE WHEN tokens <= 100 THEN text ELSE substr(text, 1, CAST(floor(80 * r) AS INTEGER)) || chr(10) || '<!-- ... truncated ... -->' || chr(10) || right(text, CAST(floor(20 * r) AS INTEGER)) END AS cut FROM (SELECT doc_id, text, {_tokens('text')} AS tokens,"
    f" 4.0 - 2.0 * coalesce(CAST(length(regexp_replace(substr(text, 1, 2000), '[^{text.DENSE}]', '', 'g')) AS DOUBLE) / nullif(length(substr(text, 1, 2000)), 0), 0) AS r FROM documents)"
)
def head_and_tail(spark, sf_dir):
    """Documents cut to about 100 tokens: four fifths from the head, the rest from the tail."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", text.tokens(F.col("text")).alias("tokens"), text.head_tail(F.col("text"), 100).alias("cut"))


@query(
    f"SELECT page_id, round(coalesce(greatest(CAST(length(s) AS DOUBLE) / nullif({_tokens('s')}, 0), 1.5), 4.0), 6) AS chars_per_token FROM (SELECT DISTINCT page_id FROM {P}) LEFT JOIN (SELECT page_id, string_agg(part, chr(10) ORDER BY pos) AS s FROM (SELECT page_id, pos, substr(line, 1, 300) AS part, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n"
    f" FROM {LINES} WHERE length(line) >= 5) WHERE n <= 20 GROUP BY page_id) USING (page_id)"
)
def chars_per_token(spark, sf_dir):
    """Characters a token of a page, from its first twenty lines."""
    return _pages(spark, sf_dir).select("page_id", F.round(text.chars_per_token(text.lines(F.col("html"))), 6).alias("chars_per_token"))


@query("SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(text, 1, 2000), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS hash FROM documents WHERE length(text) > 0")
def content_hash(spark, sf_dir):
    """32-bit content hash of documents (texts of the basic plane)."""
    d = _t(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return d.select("doc_id", text.content_hash(F.col("text")).alias("hash"))


# diagnostics, with events as calls

_TOOL = "CASE event_type WHEN 'click' THEN 'fetch_page' WHEN 'view' THEN 'execute_action' WHEN 'purchase' THEN 'fetch_pages' ELSE 'own_tool' END"
_URL = "CASE WHEN event_id % 11 = 0 THEN 'not a url' ELSE 'https://h' || (event_id % 3) || '.example.com/p' END"


@query(
    f"SELECT event_id, CASE WHEN tool = 'fetch_page' THEN CASE WHEN here IS NULL OR there IS NULL OR here <> there THEN 'high' ELSE 'low' END ELSE CASE tool {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in diagnose.TOOL_RISK.items())} ELSE 'medium' END END AS risk FROM (SELECT event_id, tool, a AS here, lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS there"
    f" FROM (SELECT *, {_TOOL} AS tool, nullif(lower(regexp_extract({_URL}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS a FROM events))"
)
def tool_risk(spark, sf_dir):
    """Risk of calls; the active address is that of the session's call before."""
    e = _t(spark, sf_dir, "events").withColumn("tool", F.expr(_TOOL)).withColumn("url", F.expr(_URL))
    active = F.lag("url").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("active", active).select("event_id", diagnose.tool_risk(F.col("tool"), F.col("url"), F.col("active")).alias("risk"))


@query("SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS call, event_type AS tool, round((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6, 3) AS since_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def call_sequence(spark, sf_dir):
    return diagnose.call_sequence(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("SELECT user_id, event_id, event_type AS stage, round((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e3, 3) AS ms FROM events")
def stage_times(spark, sf_dir):
    return diagnose.stage_times(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


ERRORS = ("Timeout 30000ms exceeded", "element is not visible", "click was intercepted by overlay", "node is not attached to the page", "it timed out", "strange", "another element covered it", "element is hidden")
_ERROR = f"CASE event_id % {len(ERRORS)} " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(ERRORS)) + " END"
_SEVERITY = "CASE event_id % 5 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'none' END"
_AFTER = "CASE WHEN event_id % 7 = 0 THEN 'https://b.example.com/' ELSE 'https://a.example.com/' END"
_RE = lambda p: f"regexp_matches(e, '{p}')"


@query(
    f"SELECT event_id, f AS failure, CAST(c AS DOUBLE) AS confidence, CASE f {' '.join(f'''WHEN '{k}' THEN '{v[0][0]}: {v[0][1]}' ''' for k, v in diagnose.ACTION_RECOVERY.items())} END AS first_try FROM (SELECT event_id, split_part(x, '|', 1) AS f, split_part(x, '|', 2) AS c FROM (SELECT event_id, CASE WHEN {_RE(diagnose.TIMEOUT)} THEN 'timeout_exceeded|0.95'"
    f" WHEN a <> 'https://a.example.com/' THEN CASE WHEN s = 'major' THEN 'navigation_unexpected|0.9' ELSE 'navigation_unexpected|0.85' END WHEN {_RE(diagnose.HIDDEN)} THEN 'element_hidden|0.9' WHEN {_RE(diagnose.BLOCKED)} THEN 'element_blocked|0.9'"
    f" WHEN {_RE(diagnose.DETACHED)} THEN 'state_changed|0.9' WHEN s <> 'none' THEN 'state_changed|0.7' ELSE 'state_changed|0.5' END AS x FROM (SELECT event_id, {_ERROR} AS e, {_SEVERITY} AS s, {_AFTER} AS a FROM events)))"
)
def action_failures(spark, sf_dir):
    """Failed actions, with events as attempts, and the first thing to try."""
    e = _t(spark, sf_dir, "events")
    made = diagnose.action_failure(F.expr(_ERROR), F.lit("https://a.example.com/"), F.expr(_AFTER), F.lit(False), F.expr(_SEVERITY))
    first = diagnose.action_recovery(F.col("d.failure"))[0]
    return e.select("event_id", made.alias("d")).select("event_id", "d.failure", "d.confidence", F.concat(first["action"], F.lit(": "), first["reason"]).alias("first_try"))


ACTIONS, KINDS = ("click", "type", "select", "press_key", "hover", "drag"), ("click", "type", "select", "toggle")


@query(
    f"SELECT event_id, CASE action WHEN 'click' THEN true WHEN 'press_key' THEN true WHEN 'hover' THEN true WHEN 'type' THEN kind = 'type' WHEN 'select' THEN kind = 'select' END AS suits FROM (SELECT event_id, list_extract({list(ACTIONS)}, CAST(event_id % {len(ACTIONS)} + 1 AS INTEGER)) AS action, list_extract({list(KINDS)}, CAST(event_id // 7 % {len(KINDS)} + 1 AS INTEGER)) AS kind FROM events)"
)
def affordances(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    of = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return e.select("event_id", diagnose.suits(of(ACTIONS, F.col("event_id")), of(KINDS, F.floor(F.col("event_id") / 7))).alias("suits"))


RULES = [(False, "/"), (True, "/page"), (False, "/*.php$"), (False, "/page/1*"), (True, "/page/12$"), (False, "*?q=")]


@query(
    f"""WITH u AS (SELECT url, 'o' || (page_id % 3) AS origin, '/page/' || page_id || CASE WHEN page_id % 5 = 0 THEN '.php' WHEN page_id % 7 = 0 THEN '?q=1' ELSE '' END AS path FROM {P} WHERE page_id >= 0),
        r AS (SELECT * FROM {fixtures.values([(int(a), p, "o1" if k % 2 else "o0") for k, (a, p) in enumerate(RULES)], "allow", "pattern", "origin")}),
        h AS (SELECT u.url, u.origin, u.path, allow, length(pattern) AS n, regexp_matches(path, '^' || regexp_replace(regexp_replace(pattern, '([.?+^(){{}}|])', '\\\\\\1', 'g'), '\\*', '.*', 'g')) AS hit FROM u LEFT JOIN r USING (origin))
        SELECT url, origin, coalesce(arg_max(allow, n * 2 + allow) FILTER (WHERE hit) = 1, true) AS allowed FROM h GROUP BY url, origin, path"""
)
def robots_rules(spark, sf_dir):
    """Whether robots rules of their origin allow pages."""
    p = _t(spark, sf_dir, "pages")
    path = F.concat(F.lit("/page/"), "page_id", F.when(F.col("page_id") % 5 == 0, ".php").when(F.col("page_id") % 7 == 0, "?q=1").otherwise(""))
    u = p.select("url", F.concat(F.lit("o"), (F.col("page_id") % 3).cast("string")).alias("origin"), path.alias("path"))
    rules = spark.createDataFrame([(a, x, "o1" if k % 2 else "o0") for k, (a, x) in enumerate(RULES)], "allow boolean, pattern string, origin string")
    return diagnose.robots(u, rules).select("url", "origin", "allowed")


_LOW = "lower(html)"
_BODY_TEXT = r"length(trim(regexp_replace(regexp_replace(lower(html), '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>', '', 'g'), '<[^>]+>', ' ', 'g')))"
_SIGNS = {"nextjs": "__next_data__|/_next/", "nuxt": "__nuxt__|/_nuxt/", "react": "data-reactroot|react-root", "vue": "data-v-app|data-v-[0-9a-f]{8}", "angular": "ng-version", "svelte": "svelte-[a-z0-9]+"}
_SKELETON = "class=[\"''][^\"'']*(?:skeleton|shimmer|placeholder-glow)"


@query(
    f"SELECT page_id, framework, NOT (sk AND n < 100) AS hydrated, sk AS has_skeleton, CAST(CASE WHEN framework IN ('nextjs', 'nuxt') THEN 0.85 ELSE 0.75 END AS DOUBLE) AS confidence FROM (SELECT page_id, CASE {' '.join(f'''WHEN regexp_matches({_LOW}, '{p}') THEN '{k}' ''' for k, p in _SIGNS.items())} END AS framework, regexp_matches({_LOW}, '{_SKELETON}') AS sk, {_BODY_TEXT} AS n FROM {P}) WHERE framework IS NOT NULL"
)
def spa_status(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", diagnose.spa(F.col("html")).alias("s")).filter("s is not null").select("page_id", "s.*")


@query()
def page_diagnosis(spark, sf_dir):
    p = _pages(spark, sf_dir)
    typed = p.join(classify.classify(p).select("page_id", "page_type"), "page_id")
    fields = ((F.length(F.lower("html")) - F.length(F.replace(F.lower("html"), F.lit("<input"), F.lit("")))) / 6).cast("double")
    state = detect.page_state(F.col("html"), F.col("page_type"), fields)["state"]
    return diagnose.run_diagnosis(typed.select("page_id", state.alias("state"), detect.antibot(F.col("html"))["provider"].alias("antibot"), diagnose.spa(F.col("html")).alias("spa")))


@query()
def dismiss_buttons(spark, sf_dir):
    """The button that closes a page's barrier, with the reference's default policy."""
    b = extract.interactables(_pages(spark, sf_dir)).select("page_id", "ref", "role", "affordance", "name")
    words = {"reject": ("reject", "decline", "refuse"), "accept": ("accept", "agree", "allow"), "dismiss": ("close", "dismiss", "no thanks")}
    return diagnose.dismiss(b, words)


@query(f"SELECT p_partkey, regexp_matches(p_name || CASE WHEN p_partkey % 9 = 0 THEN ' (Sponsored)' WHEN p_partkey % 10 = 0 THEN ' 광고' ELSE '' END, {_q('(?i)(?:' + '|'.join((chr(92) + 'b' + terms.any_of((t,)) + chr(92) + 'b') if t.isascii() else terms.any_of((t,)) for t in terms.SPONSORED) + ')')}) AS paid FROM part")
def sponsored_cards(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 9 == 0, " (Sponsored)").when(F.col("p_partkey") % 10 == 0, " 광고").otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", diagnose.sponsored(name).alias("paid"))


# machines, with events as calls of a session


def _at() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")


def _machine(rows: DataFrame, machine, out: str) -> DataFrame:
    return machines.fold(rows, "session", ["at", "id"], machine, f"id long, {out}")


@query()
def page_cache(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), _at(), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "navigation").when(F.col("value") > 95, "scroll").otherwise("fetch").alias("op"), F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string")).alias("url"))
    return _machine(e, lambda: machines.PageCache(most=3, ttl=86_400.0), "outcome string, entries int, evicted int")


@query()
def template_cache(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("session"), _at(), F.col("event_id").alias("id"), F.col("event_type").alias("page_type"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("domain"), (F.col("event_id") % 3 > 0).alias("has_main"), F.lit("json_ld").alias("source"), (F.col("value") / 100).alias("removal"), F.lit(0.5).alias("selection"))
    return _machine(e, machines.TemplateCache, "outcome string, mismatches string, entries int")


@query()
def auto_threshold(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("session"), _at(), F.col("event_id").alias("id"), (F.col("value") / 100).alias("confidence"), F.lit(1500).alias("budget"))
    return _machine(e, machines.AutoThreshold, "ema double, adjustment int, budget int")


@query()
def robots_cache(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("session"), _at(), F.col("event_id").alias("id"), F.element_at(F.array(*[F.lit(x) for x in (200, 404, 403, 500)]), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 8 == 0, F.lit(7200.0)).alias("max_age"))
    return _machine(e, machines.RobotsCache, "cached boolean, policy string, until double")


@query()
def tabs(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), _at(), F.col("event_id").alias("id"), F.element_at(F.array(F.lit("open"), F.lit("open"), F.lit("switch"), F.lit("close")), (F.col("event_id") % 4 + 1).cast("int")).alias("op"), F.concat(F.lit("t"), (F.col("event_id") % 9).cast("string")).alias("name"))
    return _machine(e, machines.Tabs, "status string, tabs int, active string")


@query()
def single_flight(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), _at(), F.col("event_id").alias("id"), (F.col("value") * 600).alias("seconds"))
    return _machine(e, machines.SingleFlight, "leader long, joined boolean")


@query()
def purchase_flow(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), _at(), F.col("event_id").alias("id"), F.element_at(F.array(*[F.lit(x) for x in machines.FLOW]), (F.col("event_id") % 4 + 1).cast("int")).alias("step"), F.when(F.col("value") < 90, F.col("value") < 80).alias("good"))
    return _machine(e, machines.PurchaseFlow, "state string, steps int, successes int")


@query()
def greedy_buckets(spark, sf_dir):
    """Interactables within a budget by priority bucket, with order lines as elements."""
    d = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_linenumber") % 3).alias("at"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("id"), (F.col("l_linenumber") % 3).alias("bucket"), F.col("l_quantity").cast("int").alias("tokens"), F.lit(80).alias("budget"))
    out = machines.fold(d, "session", ["at", "id"], machines.GreedyBuckets, "id long, kept boolean, spent int")
    return out


# recall, with documents as pages: their length, a date, two words of the source and the start of the text are what is expected

_EXPECT = "CASE doc_id % 3 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2023.7.9' ELSE 'soon' END"
_PAGE = "text || ' ' || n_chars || ' 2024년 1월 2일 ' || CASE WHEN doc_id % 2 = 0 THEN '2023/07/09' ELSE '' END || ' ' || coalesce(source, '')"


@query(
    rf"""SELECT doc_id, contains(page, CAST(n_chars AS VARCHAR)) AS numeric, d <> 'soon' AND (doc_id % 3 = 0 OR contains(page, '2023/07/09') OR contains(page, d)) OR contains(page, d) AS day,
        contains(lower(page), lower(e)) OR len(list_filter(w, lambda x: contains(lower(page), x))) > 0 AS exact_, contains(lower(page), lower(e)) OR (len(w) > 0 AND len(list_filter(w, lambda x: contains(lower(page), x))) >= len(w) * 0.4) AS words
        FROM (SELECT *, list_filter(string_split(lower(e), chr(32)), lambda x: length(x) > 2) AS w FROM (SELECT doc_id, n_chars, {_PAGE} AS page, {_EXPECT} AS d, coalesce(source, 'none') || ' zzqq yyqq' AS e FROM documents WHERE text IS NOT NULL))"""
)
def field_matches(spark, sf_dir):
    from loomspan.operators import recall

    d = _t(spark, sf_dir, "documents").filter("text is not null").selectExpr("doc_id", "n_chars", f"{_PAGE} AS page", f"{_EXPECT} AS d", "coalesce(source, 'none') || ' zzqq yyqq' AS e")
    page = F.col("page")
    return d.select("doc_id", recall.numeric(F.col("n_chars").cast("string"), page).alias("numeric"), recall.day(F.col("d"), page).alias("day"), recall.exact(F.col("e"), page).alias("exact_"), recall.words(F.col("e"), page).alias("words"))


@query(f"SELECT page_id, octet_length(encode(html)) AS html_bytes, n AS tags, octet_length(encode(html)) <= {fixed.MAX_HTML_BYTES} AND n <= {fixed.MAX_DOM_NODES} AS allowed FROM (SELECT page_id, html, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n FROM {P})")
def page_guard(spark, sf_dir):
    return sources.guard(_pages(spark, sf_dir))


# prompts and their pieces

_PARAM_SQL = r"(?i)(?:href|action)=[\"''][^\"'']*[?&](?:page|p|pg|pn|pageNo|pageNum|currentPage)=([0-9]{1,9})"


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _prompt_rows(spark, sf_dir) -> DataFrame:
    """One row a page with a text for each section."""
    from loomspan.operators import prompts

    p = _pages(spark, sf_dir)
    state = p.withColumn("n", ((F.length(F.lower("html")) - F.length(F.replace(F.lower("html"), F.lit("<input"), F.lit("")))) / 6).cast("double"))
    told = state.select("page_id", "url", detect.barrier(F.col("html"), F.col("n"))["kind"].alias("barrier"), detect.page_state(F.col("html"), F.lit("unknown"), F.col("n"))["state"].alias("state"), prompts.pages_of(F.col("html")).alias("pg"))
    lines = extract.interactables(p).select("page_id", "ref", prompts.element_line(F.col("options")).alias("l"))
    actions = lines.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", "l"))), lambda x: x["l"]), "\n").alias("actions"))
    pictures = extract.images(p).filter("rank <= 5").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: F.concat(F.lit("  ["), x["rank"].cast("string"), F.lit("] "), x["url"])), "\n").alias("images"))
    rows = digest.digest(p).join(told, "page_id").join(actions, "page_id", "left").join(pictures, "page_id", "left")
    nonce = F.substring(F.md5(F.col("page_id").cast("string")), 1, 16)
    info = F.when(F.col("text") != "", text.boundary(text.sanitize_block(F.col("text")), F.col("url"), nonce, F.lit("2026-01-01T00:00:00Z")))
    place = F.when(F.col("pg.total_pages").isNotNull(), F.when(F.col("pg.current_page").isNotNull(), F.concat(F.lit("Page "), F.col("pg.current_page").cast("string"), F.lit("/"), F.col("pg.total_pages").cast("string"))).otherwise(F.concat(F.lit("~"), F.col("pg.total_pages").cast("string"), F.lit(" pages"))))
    nothing = F.lit(None).cast("string")
    return rows.select("page_id", F.struct("url", "title", "page_type", nothing.alias("warnings"), F.concat(F.lit("Type: "), "barrier").alias("barrier"), F.concat(F.lit("State: "), "state").alias("diagnostics"), nothing.alias("ecommerce"), "actions", F.concat_ws(" | ", place, "pg.total_items").alias("navigation"), info.alias("info"), "images").alias("p"))


@query()
def page_prompts(spark, sf_dir):
    """The whole prompt of every page."""
    from loomspan.operators import prompts

    return _prompt_rows(spark, sf_dir).select("page_id", prompts.whole(F.col("p")).alias("prompt"))


@query()
def prompt_updates(spark, sf_dir):
    """Updates of every page's prompt against one whose first action or text line is gone."""
    from loomspan.operators import prompts

    rows = _prompt_rows(spark, sf_dir)
    old = F.when(F.col("page_id") % 3 == 0, F.col("p")).otherwise(F.col("p").withField("actions", F.regexp_replace("p.actions", r"^[^\n]*\n", "")))
    return rows.select("page_id", prompts.update(old, F.col("p")).alias("update"))


@query(
    f"""SELECT page_id, total_pages, total_items, regexp_matches(html, {_re(__import__('loomspan.operators.prompts', fromlist=['NEXT']).NEXT)}) AS has_next, regexp_matches(html, {_re(__import__('loomspan.operators.prompts', fromlist=['PREV']).PREV)}) AS has_prev
        FROM (SELECT page_id, html, CASE WHEN n > 1 THEN n END AS total_pages, nullif(trim(regexp_extract(html, {_re('(' + __import__('loomspan.operators.prompts', fromlist=['TOTAL']).TOTAL + ')')}, 1)), '') AS total_items
        FROM (SELECT page_id, html, greatest(coalesce(TRY_CAST(nullif(regexp_extract(html, '[Pp]age\\s+([0-9]+)\\s+(?:of|/)\\s+([0-9]+)', 2), '') AS INTEGER), 0), coalesce(list_max(list_transform(regexp_extract_all(html, '{_PARAM_SQL}', 1), lambda x: CAST(x AS INTEGER))), 0)) AS n FROM {P}))"""
)
def page_counts(spark, sf_dir):
    """Where a page stands among its like."""
    from loomspan.operators import prompts

    return _pages(spark, sf_dir).select("page_id", prompts.pages_of(F.col("html")).alias("s")).select("page_id", "s.total_pages", "s.total_items", "s.has_next", "s.has_prev")


@query()
def baseline_texts(spark, sf_dir):
    from loomspan.operators import prompts

    return prompts.baselines(_pages(spark, sf_dir))


@query()
def removed_regions(spark, sf_dir):
    from loomspan.operators import prompts

    return prompts.removed_regions(dom.remove(dom.weigh(dom.nodes(_pages(spark, sf_dir)))))
