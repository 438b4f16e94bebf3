"""Registered queries of the web-page engine, each with the SQL that another engine answers on the same tables.

Queries over pages also cover hand-written pages (negative ids), because the driver's pages lack most markup. Where a table has no
page semantics, its columns play the roles the docstring of the operator names: events.user_id is a session, event_type a tool.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan import fixed
from loomspan.functions import money, scores, text, urls
from loomspan.operators import classify, commerce, compress, detect, dom, extract, joins, metadata, windows
from loomspan.plans import digest, fixtures
from loomspan.sources import pages as sources
from loomspan.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(fixtures.PAGES, "page_id long, url string, html string"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("url").unionByName(spark.createDataFrame([(u,) for u in fixtures.URLS], "url string")).distinct()


P = f"(SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {fixtures.values(fixtures.PAGES, 'page_id', 'url', 'html')})"
U = f"(SELECT url FROM {P} UNION SELECT url FROM {fixtures.values([(u,) for u in fixtures.URLS], 'url')})"

# SQL pieces that several queries share.
_AUTH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_HOST = f"lower(regexp_extract({_AUTH}, '^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)', 1))".replace("{u}", "url")
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_WS = r"[ \t\r\n\f\x0B]+"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _entities(x: str) -> str:
    return reduce(lambda a, kv: f"replace({a}, {fixtures.quoted(kv[0])}, {fixtures.quoted(kv[1])})", text.ENTITIES.items(), x)


def _host_case(rules: list[tuple[str, str]], default: str) -> str:
    fits = lambda d: f"ends_with(h, '{d}')" if d.startswith(".") else f"(h = '{d}' OR ends_with(h, '.{d}'))"
    return "CASE " + " ".join(f"WHEN {fits(d)} THEN '{v}'" for d, v in rules) + f" ELSE {default} END"


_CODE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>"
_TEXT = _entities(rf"regexp_replace(regexp_replace(html, '{_CODE}', '', 'g'), '<[^>]+>', chr(10), 'g')")
_TEXT = rf"regexp_replace(replace(regexp_replace({_TEXT}, '([\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}])([0-9])', '\1 \2', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g')"
_LINE_LIST = f"list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"
LINES = f"(SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, {_LINE_LIST} AS l FROM {P}))"
_DENSE = f"[^{text.DENSE}]"


def _tokens(x: str) -> str:
    sample = f"substr({x}, 1, 2000)"
    return f"coalesce(CAST(trunc(length({x}) / (4.0 - 2.0 * CAST(length(regexp_replace({sample}, '{_DENSE}', '', 'g')) AS DOUBLE) / nullif(length({sample}), 0))) AS INTEGER), 0)"


# URLs


@query(f"SELECT url, coalesce(nullif(CASE WHEN contains(h, '.') THEN list_extract(string_split(h, '.'), -2) ELSE h END, ''), 'unknown') AS site_id, regexp_replace(h, '^www\\.', '') AS domain FROM (SELECT url, {_HOST} AS h FROM {U})")
def url_site(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.site_id(F.col("url")).alias("site_id"), urls.template_domain(F.col("url")).alias("domain"))


_LOCALE = (
    f"(SELECT url, coalesce(list_extract(list_filter(seg[1:2], lambda p: list_contains({fixed.LOCALES}, p)), 1), CASE WHEN list_contains({fixed.LOCALES}, split_part(h, '.', 1)) THEN split_part(h, '.', 1) END, {_host_case(fixed.by_host(fixed.LOCALE_DOMAINS), 'NULL')}, 'en') AS locale"
    f" FROM (SELECT url, {_HOST} AS h, list_filter(string_split(lower({_PATH}), '/'), lambda p: p <> '') AS seg FROM {U}))"
)


@query(f"SELECT url, locale, CASE locale {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in fixed.ACCEPT_LANGUAGE.items())} END AS header FROM {_LOCALE}")
def url_locale(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.locale(F.col("url")).alias("locale"), urls.accept_language(F.col("url")).alias("header"))


@query(f"SELECT url, {_host_case(fixed.by_host(fixed.CURRENCY_DOMAINS), repr('USD'))} AS currency, {_host_case(fixed.pairs(fixed.SCHEMA_DOMAINS), '''CASE WHEN regexp_matches(lower(url), '\\.go(?:v)?(?:\\.[a-z]{2})?(?:/|$)') THEN 'GovernmentPage' ELSE 'Generic' END''')} AS schema FROM (SELECT url, {_HOST} AS h FROM {U})")
def url_currency_schema(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.currency(F.col("url")).alias("currency"), urls.schema(F.col("url")).alias("schema"))


@query(
    f"SELECT url, s || '://' || lower(a) || p || CASE WHEN len(l) > 0 THEN '?' || array_to_string(l, '&') ELSE '' END AS cache_key, regexp_replace(p, '/+$', '') = '' OR starts_with(regexp_replace(p, '/+$', ''), '/index') AS is_root, replace(q, '+', ' ') AS search"
    f" FROM (SELECT url, {_SCHEME} AS s, {_AUTH.replace('{u}', 'url')} AS a, {_PATH} AS p, list_transform(list_sort(list_transform(list_filter(string_split({_QUERY}, '&'), lambda x: x <> ''), lambda x: {{'k': split_part(x, '=', 1), 'p': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END}})), lambda x: x.p) AS l,"
    f" coalesce({', '.join(f'''nullif(regexp_extract({_QUERY}, '(?:^|&){x}=([^&]+)', 1), '')''' for x in urls.SEARCH_PARAMS)}) AS q FROM {U})"
)
def url_forms(spark, sf_dir):
    u = F.col("url")
    return _urls(spark, sf_dir).select("url", urls.normal_form(u).alias("cache_key"), urls.is_root(u).alias("is_root"), urls.search_query(u).alias("search"))


def _octet(k: int) -> str:
    part = f"split_part(h, '.', {k + 1})"
    octal = " + ".join(f"coalesce(CAST(nullif(substr(lpad({part}, 12, '0'), {i + 1}, 1), '') AS BIGINT), 0) * {8 ** (11 - i)}" for i in range(12))
    return f"CASE WHEN regexp_matches({part}, '^0[0-7]+$') THEN {octal} WHEN regexp_matches({part}, '^(0|[1-9][0-9]*)$') THEN TRY_CAST({part} AS BIGINT) END"


_IP = "CASE WHEN regexp_matches(h, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN CASE WHEN o0 <= 255 AND o1 <= 255 AND o2 <= 255 AND o3 <= 255 THEN ((o0 * 256 + o1) * 256 + o2) * 256 + o3 END WHEN regexp_matches(h, '^[0-9]+$') THEN CASE WHEN TRY_CAST(h AS BIGINT) <= 4294967295 THEN TRY_CAST(h AS BIGINT) END WHEN regexp_matches(h, '^0x[0-9a-f]{1,15}$') THEN CASE WHEN CAST(h AS BIGINT) <= 4294967295 THEN CAST(h AS BIGINT) END END"


@query(
    f"SELECT url, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'no_host' WHEN list_contains({fixed.METADATA_HOSTS}, h) THEN 'metadata' WHEN list_contains({fixed.BLOCKED_HOSTS}, h) THEN 'blocked_host' WHEN ip BETWEEN {urls.number_of('169.254.0.0')} AND {urls.number_of('169.254.255.255')} THEN 'metadata'"
    f" WHEN {' OR '.join(f'ip BETWEEN {urls.number_of(a)} AND {urls.number_of(b)}' for a, b in fixed.PRIVATE_RANGES)} THEN 'private_ip' END AS risk"
    f" FROM (SELECT url, s, h, {_IP} AS ip FROM (SELECT url, s, h, {', '.join(f'{_octet(k)} AS o{k}' for k in range(4))} FROM (SELECT url, {_SCHEME} AS s, {_HOST} AS h FROM {U})))"
)
def url_risk(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.risk(F.col("url")).alias("risk"))


# text


@query(f"SELECT page_id, pos, line FROM {LINES}")
def text_lines(spark, sf_dir):
    return extract.text_lines(_pages(spark, sf_dir))


@query(f"SELECT page_id, {_trim(_entities(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)'])))} AS title, {_tokens('html')} AS html_tokens, octet_length(encode(html)) AS html_bytes, octet_length(encode(html)) <= {fixed.MAX_HTML_BYTES} AS allowed FROM {P}")
def page_title(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", text.title(F.col("html")).alias("title"), text.tokens(F.col("html")).alias("html_tokens"), F.octet_length("html").alias("html_bytes"), (F.octet_length("html") <= fixed.MAX_HTML_BYTES).alias("allowed"))


_SAMPLE = rf"substr({_trim(rf'''regexp_replace(regexp_replace(regexp_replace(substr(html, greatest(strpos(lower(html), '<body'), 1), 30000), '{_CODE}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}', ' ', 'g')''')}, 1, 2000)"


@query(
    f"SELECT page_id, locale, round(m, 3) AS multiplier, CAST(round_even(1500 * m, 0) AS BIGINT) AS pruned_budget, CAST(round_even(5000 * m, 0) AS BIGINT) AS total_budget FROM ("
    f"SELECT page_id, locale, greatest(1.0, least(2.5, CASE WHEN n < 50 THEN base WHEN base <= 1.0 AND r > 0.3 THEN 1.0 + 0.8 * least(r / 0.7, 1.0) WHEN base > 1.0 AND r < 0.1 THEN 1.0 + (base - 1.0) * (r / 0.1) ELSE base END)) AS m FROM ("
    f"SELECT page_id, locale, CAST(CASE locale WHEN 'ko' THEN 1.8 WHEN 'zh' THEN 1.6 WHEN 'ja' THEN 1.5 ELSE 1.0 END AS DOUBLE) AS base, length(s) AS n, CAST(length(regexp_replace(s, '{_DENSE}', '', 'g')) AS DOUBLE) / nullif(length(s), 0) AS r FROM (SELECT page_id, locale, {_SAMPLE} AS s FROM {P} JOIN {_LOCALE} USING (url))))"
)
def token_budget(spark, sf_dir):
    return digest.basics(_pages(spark, sf_dir)).select("page_id", "locale", "multiplier", "pruned_budget", "total_budget")


_COMPRESSED = f"(SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT page_id, pos, line, sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY pos) AS r FROM (SELECT page_id, pos, substr(line, 1, 300) AS line FROM {LINES}) WHERE length(line) >= 5) WHERE r <= 950 GROUP BY page_id)"


@query(f"SELECT page_id, text, {_tokens('text')} AS tokens FROM {_COMPRESSED}")
def default_context(spark, sf_dir):
    """Text lines of five characters or more, cut to 300, until 250 tokens are full."""
    return digest.compress(extract.text_lines(_pages(spark, sf_dir)), 250).select("page_id", "text", text.tokens(F.col("text")).alias("tokens"))


_COUNTS = ", ".join(f"length(regexp_replace(line, '[^{body}]', '', 'g')) AS n{k}" for k, body in enumerate(text.SCRIPTS.values()))
_ALLN = " + ".join(f"n{k}" for k in range(len(text.SCRIPTS)))
_DOM = "CASE WHEN greatest(" + ", ".join(f"n{k}" for k in range(len(text.SCRIPTS))) + ") = 0 THEN 'COMMON' " + " ".join(f"WHEN n{k} = greatest(" + ", ".join(f"n{j}" for j in range(len(text.SCRIPTS))) + f") THEN '{s}'" for k, s in enumerate(text.SCRIPTS)) + " END"


@query(f"SELECT page_id, pos, {_DOM} AS script, {_ALLN} AS letters FROM (SELECT page_id, pos, {_COUNTS} FROM {LINES})")
def script_profile(spark, sf_dir):
    lines = extract.text_lines(_pages(spark, sf_dir))
    return lines.select("page_id", "pos", text.dominant_script(F.col("line")).alias("script"), text.count_of(F.col("line"), "".join(text.SCRIPTS.values())).alias("letters"))


_OWN = "CASE s " + " ".join(f"WHEN '{s}' THEN " + " + ".join(f"n{list(text.SCRIPTS).index(g)}" for g in group) for s, group in text.GROUPS.items()) + " ELSE 0 END"
_PASS = r"length(line) <= 5 OR regexp_matches(line, '(?i)https?://[^ \t\r\n]+') OR regexp_matches(line, '^[0-9.,]+[ \t]*[a-zA-Z%]*$')"


@query(
    f"WITH l AS (SELECT page_id, pos, line, {_COUNTS} FROM {LINES}), t AS (SELECT page_id, {', '.join(f'sum(n{k}) AS n{k}' for k in range(len(text.SCRIPTS)))} FROM l GROUP BY page_id), d AS (SELECT page_id, {_DOM} AS s FROM t),"
    f" j AS (SELECT l.*, d.s, {_PASS} AS pass FROM l JOIN d USING (page_id)), r AS (SELECT page_id, pos, line, s, pass, {_DOM} AS own, CASE WHEN {_ALLN} > 0 AND s <> 'COMMON' THEN CAST({_ALLN} - ({_OWN}) AS DOUBLE) / ({_ALLN}) ELSE 0.0 END AS f FROM j)"
    f" SELECT page_id, pos, CASE WHEN NOT pass AND f > 0.5 THEN '[' || CASE own {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in text.LABELS.items())} ELSE 'other' END || '] ' || line ELSE line END AS line FROM r WHERE pass OR NOT (length(line) < 50 AND f > 0.8)"
)
def script_filter(spark, sf_dir):
    """Lines of a page without short ones in a foreign script; long foreign ones are tagged."""
    lines = extract.text_lines(_pages(spark, sf_dir))
    per = {s: text.count_of(F.col("line"), body) for s, body in text.SCRIPTS.items()}
    # the page's script: a sum over the page's lines beside them, so the text is read once
    page = Window.partitionBy("page_id")
    sums = lines.select("*", *[c.alias(f"_{s}") for s, c in per.items()]).select("*", *[F.sum(f"_{s}").over(page).alias(f"_sum_{s}") for s in per])
    top = F.array_max(F.array(*[F.struct(F.col(f"_sum_{s}").alias("n"), F.lit(-k).alias("o"), F.lit(s).alias("s")) for k, s in enumerate(per)]))
    rows = sums.withColumn("_top", top).select("page_id", "pos", "line", F.when(F.col("_top.n") > 0, F.col("_top.s")).otherwise("COMMON").alias("script"))
    always = (F.length("line") <= 5) | F.col("line").rlike(r"(?i)https?://[^ \t\r\n]+") | F.col("line").rlike(r"^[0-9.,]+[ \t]*[a-zA-Z%]*$")
    foreign = F.when(F.col("script") == "COMMON", F.lit(0.0)).otherwise(text.foreign_ratio(F.col("line"), F.col("script")))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in text.LABELS.items() for x in kv])[text.dominant_script(F.col("line"))], F.lit("other"))
    kept = rows.withColumn("f", foreign).filter(always | ~((F.length("line") < 50) & (F.col("f") > 0.8)))
    return kept.select("page_id", "pos", F.when(~always & (F.col("f") > 0.5), F.concat(F.lit("["), label, F.lit("] "), "line")).otherwise(F.col("line")).alias("line"))


def _sanitized(x: str) -> str:
    x = rf"regexp_replace(replace({_entities(x)}, chr(160), ' '), chr(27) || '\[[0-9;]*[a-zA-Z]', '', 'g')"
    x = rf"regexp_replace({x}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2069}}\x{{FEFF}}\x{{FFF9}}-\x{{FFFB}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"
    x = rf"regexp_replace(translate({x}, chr(10) || chr(13), '  '), '(?i)\[?[ \t\r\n]*(?:SYSTEM|ASSISTANT|USER|HUMAN|AI|ADMIN|INSTRUCTION|OVERRIDE|IMPORTANT|IGNORE|HACK|COMMAND)[ \t\r\n]*[:\]][ \t\r\n]*', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<[ \t]*/?[ \t]*web_content[a-z0-9_]*[^>]*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)\[([^\]]*)\]\([ \t]*(javascript|vbscript|data|blob)[ \t]*:[^)]*\)', '[\1](blocked:\2)', 'g')"
    x = rf"regexp_replace({x}, '(?i)<[ \t]*(javascript|vbscript|data|blob)[ \t]*:[^>]*>', '[blocked link]', 'g')"
    return f"substr({_trim(rf'''regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')''')}, 1, 256)"


@query(f"SELECT page_id, {_sanitized('html')} AS safe, lower(regexp_replace({_trim('html')}, '{_WS}', ' ', 'g')) AS normal FROM {P}")
def sanitize_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.sanitize(F.col("html")).alias("safe"), text.normalise(F.col("html")).alias("normal"))


# numbers and money

_N = fixtures.values([(x,) for x in fixtures.NUMBERS], "s")


@query(
    f"SELECT s, TRY_CAST({_trim(chr(39).join(['regexp_replace(s, ', '[₩$¥€£원円元,]', ', ', '', ', ', 'g', ')']))} AS DOUBLE) AS numeric, v AS value, CAST(round_even(v, 0) AS BIGINT) AS whole FROM (SELECT s, TRY_CAST(CASE WHEN contains(t, '.') AND contains(t, ',') THEN CASE WHEN length(t) - strpos(reverse(t), ',') > length(t) - strpos(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END WHEN contains(t, ',') THEN replace(t, ',', '') WHEN contains(t, '.') AND (len(p) > 2 OR (len(p) = 2 AND length(p[-1]) = 3)) THEN replace(t, '.', '') ELSE t END AS DOUBLE) AS v FROM (SELECT s, t, string_split(regexp_replace(t, '^-+', ''), '.') AS p FROM (SELECT s, {_trim('s')} AS t FROM {_N})))"
)
def parse_numbers(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in fixtures.NUMBERS], "s string")
    return d.select("s", money.numeric(F.col("s")).alias("numeric"), money.to_float(F.col("s")).alias("value"), money.to_int(F.col("s")).alias("whole"))


_DATE = r"^([0-9]{4})(?:-|\.|年|년[ \t]*)([0-9]{1,2})(?:-|\.|月[ \t]*|월[ \t]*)([0-9]{1,2})"


@query(f"SELECT s, CASE WHEN t = '' THEN NULL WHEN regexp_extract(t, '{_DATE}', 1) <> '' THEN regexp_extract(t, '{_DATE}', 1) || '-' || lpad(regexp_extract(t, '{_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(t, '{_DATE}', 3), 2, '0') ELSE t END AS d FROM (SELECT s, {_trim('s')} AS t FROM {fixtures.values([(x,) for x in fixtures.DATES], 's')})")
def parse_dates(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in fixtures.DATES], "s string")
    return d.select("s", money.date(F.col("s")).alias("d"))


_GROUP = r"regexp_replace(reverse(regexp_replace(reverse({x}), '([0-9]{{3}})', '\1,', 'g')), '^,', '')"


def _price_sql() -> str:
    cents = f"CASE WHEN a < 0 THEN '-' ELSE '' END || {_GROUP.format(x='''split_part(printf('%.2f', abs(a)), '.', 1)''')} || '.' || split_part(printf('%.2f', abs(a)), '.', 2)"
    whole = f"CASE WHEN a < 0 THEN '-' ELSE '' END || {_GROUP.format(x='''CAST(CAST(trunc(abs(a)) AS BIGINT) AS VARCHAR)''')}"
    head = "substr(w, 1, greatest(length(w) - 3, 0))"
    inr = rf"CASE WHEN a < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length(w) > 3 THEN regexp_replace(reverse(regexp_replace(reverse({head}), '([0-9]{{2}})', '\1,', 'g')), '^,', '') || ',' || right(w, 3) ELSE w END || '.' || split_part(printf('%.2f', abs(a)), '.', 2)"
    cases = [f"WHEN 'INR' THEN {inr}"]
    for code, template in money.TEMPLATES.items():
        mark = "{i}" if "{i}" in template else "{d}"
        before, after = template.split(mark)
        cases.append(f"WHEN '{code}' THEN '{before}' || {whole if mark == '{i}' else cents} || '{after}'")
    return f"SELECT a, c, CASE c {' '.join(cases)} END AS price FROM (SELECT a, c, split_part(printf('%.2f', abs(a)), '.', 1) AS w FROM {fixtures.values(fixtures.PRICES, 'a', 'c')})".replace("FROM (SELECT a, c, split", "FROM (SELECT CAST(a AS DOUBLE) AS a, c, split")


@query(_price_sql())
def format_prices(spark, sf_dir):
    d = spark.createDataFrame(fixtures.PRICES, "a double, c string")
    return d.select("a", "c", money.price(F.col("a"), F.col("c")).alias("price"))


@query(
    f"SELECT s, coalesce({', '.join(f'''CASE WHEN contains(s, '{sign}') THEN '{code}' END''' for sign, code in money.SIGNS)}, nullif(regexp_extract(upper(s), '(?:^|[^A-Z])(USD|EUR|GBP|KRW|JPY|CNY|INR|BRL|TRY|SGD|CHF|AUD|CAD|MXN|SEK|NOK|DKK)(?:[^A-Z]|$)', 1), '')) AS currency FROM {fixtures.values([(x,) for x in fixtures.OFFERS], 's')}"
)
def currency_of_text(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in fixtures.OFFERS], "s string")
    return d.select("s", money.currency_of(F.col("s")).alias("currency"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 0 AND l_extendedprice * (1 - l_discount) < l_extendedprice THEN CAST(round_even((1 - l_extendedprice * (1 - l_discount) / l_extendedprice) * 100, 0) AS INTEGER) END AS off FROM lineitem")
def discounts(spark, sf_dir):
    """Percent off, with order lines as offers."""
    d = _t(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", money.discount(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")).alias("off"))


# extraction

_LD = r"(?is)<script[^>]*type[ \t\r\n]*=[ \t\r\n]*[\"'']application/ld\+json[\"''][^>]*>(.*?)</script>"


@query(f"SELECT page_id, '/json-ld[' || (i - 1) || ']' AS xpath, t AS text FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_transform(regexp_extract_all(html, '{_LD}', 1), lambda x: {_trim('x')}) AS l FROM {P})) WHERE t <> ''")
def jsonld_scripts(spark, sf_dir):
    return extract.jsonld_scripts(_pages(spark, sf_dir))


_OG1 = r"(?i)<meta[^>]*property[ \t\r\n]*=[ \t\r\n]*[\"'']og:([^\"'']*)[\"''][^>]*content[ \t\r\n]*=[ \t\r\n]*[\"'']([^\"'']*)[\"''][^>]*/?>"
_OG2 = r"(?i)<meta[^>]*content[ \t\r\n]*=[ \t\r\n]*[\"'']([^\"'']*)[\"''][^>]*property[ \t\r\n]*=[ \t\r\n]*[\"'']og:([^\"'']*)[\"''][^>]*/?>"


@query(f"SELECT page_id, 'og:' || k AS key, arg_max(v, i) AS value FROM (SELECT page_id, unnest(ks) AS k, unnest(vs) AS v, generate_subscripts(ks, 1) AS i FROM (SELECT page_id, list_concat(regexp_extract_all(html, '{_OG1}', 1), regexp_extract_all(html, '{_OG2}', 2)) AS ks, list_concat(regexp_extract_all(html, '{_OG1}', 2), regexp_extract_all(html, '{_OG2}', 1)) AS vs FROM {P})) GROUP BY page_id, k")
def og_meta(spark, sf_dir):
    return extract.og_meta(_pages(spark, sf_dir))


def _clean_sql() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in extract.REMOVED:
        x = rf"regexp_replace(regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}[ \t\r\n]*>', '', 'g'), '(?i)<{tag}\b[^>]*/>', '', 'g')"
    return _trim(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n[ \t\r\n]*\n+', chr(10), 'g')")


@query(f"SELECT page_id, {_clean_sql()} AS cleaned FROM {P}")
def clean_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", extract.clean(F.col("html")).alias("cleaned"))


@query()
def interactables(spark, sf_dir):
    return extract.interactables(_pages(spark, sf_dir))


@query()
def page_images(spark, sf_dir):
    return extract.images(_pages(spark, sf_dir))


_PAGE_NO = r"(?i)(?:href|action)=[\"''][^\"'']*[?&](?:page|p|pg|pn|pageNo|pageNum|currentPage)=([0-9]{1,9})"
_NEXT = r"(?i)>(?:next|next page|load more|show more|다음|次へ|suivant|weiter|下一页|siguiente)<|aria-label=[\"''](?:next|next page|load more)[\"'']|class=[\"''][^\"'']*next[^\"'']*[\"'']"


@query(f"SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(html, '{_PAGE_NO}', 1), lambda x: CAST(x AS INTEGER))), 0) AS max_page, nullif(regexp_extract(html, '(?i)([0-9][0-9,]*[ \t]*(?:results?|items?|products?))', 1), '') AS total_text, regexp_matches(html, '{_NEXT}') AS has_next FROM {P}")
def pagination(spark, sf_dir):
    return extract.pagination(_pages(spark, sf_dir))


# classification and detectors

_GIVEN = f"(SELECT page_id, lower(url) AS url, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)property=[\"'']og:type[\"''][^>]*content=[\"'']([^\"'']+)', 1)) AS og, lower(html) AS html FROM {P})"


@query(" UNION ALL ".join(f"SELECT page_id, '{r.name}' AS signal FROM g WHERE {' AND '.join(c.sql() for c in r.conds)}" for r in classify.RULES).join([f"WITH g AS {_GIVEN} ", ""]))
def page_signals(spark, sf_dir):
    """Which signals fire on which page."""
    p = _pages(spark, sf_dir)
    named = F.filter(F.array(*[F.when(flag, F.lit(r.name)) for r, flag in zip(classify.RULES, classify.fired(F.col("url"), F.col("html")), strict=True)]), lambda x: x.isNotNull())
    return p.select("page_id", F.explode(named).alias("signal"))


def _type_sql() -> str:
    points = fixtures.values([(r.name, r.layer, t, n, int("blocked" in r.points), int(t == r.primary)) for r in classify.RULES for t, n in r.points.items()], "signal", "layer", "page_type", "n", "blocked", "main")
    rank = fixtures.values([(t, k, fixed.THRESHOLD[t]) for k, t in enumerate(fixed.TYPE_PRIORITY)], "page_type", "k", "threshold")
    ld = fixtures.values(list(classify.JSONLD_TYPES.items()), "name", "page_type")
    weights = fixtures.values(list(fixed.JSONLD_WEIGHT.items()), "page_type", "w")
    return f"""
        WITH fired AS ({SQL['page_signals']}), pts AS (SELECT page_id, p.* FROM fired JOIN {points} p USING (signal)),
        url_top AS (SELECT page_id, max(CASE WHEN s > 2 * threshold THEN 1 ELSE 0 END) AS strong FROM (SELECT page_id, page_type, sum(n) AS s FROM pts WHERE layer = 'url' GROUP BY ALL) JOIN {rank} USING (page_type) GROUP BY page_id),
        live AS (SELECT pts.*, coalesce(strong, 0) AS strong FROM pts LEFT JOIN url_top USING (page_id) WHERE layer = 'url' OR coalesce(strong, 0) = 0 OR blocked = 1),
        names AS (SELECT page_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT page_id, flatten(list_transform(regexp_extract_all(html, '(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1), lambda s: regexp_extract_all(s, '"@type"[ \\t\\r\\n]*:[ \\t\\r\\n]*\\[?[ \\t\\r\\n]*"([A-Za-z]+)"', 1))) AS l FROM {P})),
        ld AS (SELECT page_id, arg_min(page_type, CASE WHEN page_type IN ('listing', 'search_results') THEN i ELSE i + 100000 END) AS page_type FROM names JOIN {ld} USING (name) GROUP BY page_id),
        ldp AS (SELECT page_id, page_type, w FROM ld JOIN {weights} USING (page_type) LEFT JOIN url_top USING (page_id) WHERE coalesce(strong, 0) = 0),
        sums AS (SELECT page_id, page_type, sum(n) - greatest(sum(CASE WHEN layer = 'dom' AND n > 0 THEN n ELSE 0 END) - {fixed.DOM_CAP}, 0) AS s, sum(main) AS seen FROM live GROUP BY ALL),
        total AS (SELECT page_id, page_type, coalesce(s, 0) + coalesce(w, 0) AS score, coalesce(seen, 0) AS seen FROM sums FULL JOIN ldp USING (page_id, page_type)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seen DESC, k) AS r FROM total JOIN {rank} USING (page_type) WHERE score <> 0 OR seen > 0)
        SELECT p.page_id, coalesce(CASE WHEN a.score >= a.threshold THEN a.page_type END, 'unknown') AS page_type, CAST(coalesce(a.score, 0) AS INTEGER) AS score, b.page_type AS runner_up, coalesce(least(1.0, a.score / (a.threshold * 2.0)), 0.0) AS confidence
        FROM {P} p LEFT JOIN ranked a ON a.page_id = p.page_id AND a.r = 1 LEFT JOIN ranked b ON b.page_id = p.page_id AND b.r = 2"""


@query(_type_sql())
def page_type(spark, sf_dir):
    return classify.classify(_pages(spark, sf_dir))


_BODY = rf"length({_trim('''regexp_replace(regexp_extract(lower(html), '(?s)<body[^>]*>(.*?)</body>', 1), '<[^>]+>', '', 'g')''')}) < 200 AND regexp_matches(lower(html), '(?s)<body[^>]*>.*?</body>')"


@query(f"SELECT page_id, CASE {' '.join(f'''WHEN regexp_matches(h, '{p}') THEN '{n}' ''' for n, p, _ in fixed.ANTIBOT)} END AS provider, CASE {' '.join(f'''WHEN regexp_matches(h, '{p}') THEN CAST({c} AS DOUBLE)''' for _, p, c in fixed.ANTIBOT)} END AS confidence, CASE WHEN {' OR '.join(f'''regexp_matches(h, '{p}')''' for _, p, _ in fixed.ANTIBOT)} THEN {_BODY} ELSE false END AS visible FROM (SELECT *, lower(html) AS h FROM {P})")
def antibot(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", detect.antibot(F.col("html")).alias("a")).select("page_id", "a.provider", "a.confidence", F.coalesce("a.visible", F.lit(False)).alias("visible"))


def _says(state_name: str) -> str:
    return "(" + " OR ".join(f"contains(h, {fixtures.quoted(t)})" for t in detect.SAYS[state_name]) + ")"


_FIELDS = "(length(h) - length(replace(h, '<input', ''))) / 6.0"
_POP = fixed.POPUP.replace("'", "''")
_COOKIE = " OR ".join(f"regexp_matches(h, '{p}')" for _, p, _ in detect.CONSENT)
_POPUP = f"(regexp_matches(h, '{_POP}') AND NOT regexp_matches(regexp_extract(h, '({_POP})', 1), '{fixed.POPUP_NOT}'))"
_LOGIN = f"round(least((CASE WHEN regexp_matches(h, 'type=[\"'']password[\"'']') THEN 0.4 ELSE 0 END + CASE WHEN {_says('login_required')} THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(h, '/(?:login|signin|sign-in|auth)\\b') THEN 0.3 ELSE 0 END + CASE WHEN {_FIELDS} < 10 THEN 0.2 ELSE 0 END)::DOUBLE, 1.0), 2)"


def _elements() -> Column:
    return ((F.length(F.lower("html")) - F.length(F.replace(F.lower("html"), F.lit("<input"), F.lit("")))) / 6).cast("double")


@query(
    f"SELECT page_id, CASE WHEN {_COOKIE} THEN 'cookie_consent' WHEN {_POPUP} THEN 'popup_overlay' WHEN {_says('age_verification')} THEN 'age_verification' WHEN {_says('region_restricted')} THEN 'region_restricted' WHEN {_LOGIN} >= 0.5 THEN 'login_required' END AS kind,"
    f" CAST(CASE {' '.join(f'''WHEN regexp_matches(h, '{p}') THEN {c}''' for _, p, c in detect.CONSENT)} WHEN {_POPUP} THEN CASE WHEN regexp_matches(substr(h, 1, 5000), '{fixed.POPUP_PROMO}') THEN 0.8 ELSE 0.65 END WHEN {_says('age_verification')} THEN 0.8 WHEN {_says('region_restricted')} THEN 0.8 WHEN {_LOGIN} >= 0.5 THEN {_LOGIN} END AS DOUBLE) AS confidence FROM (SELECT page_id, lower(html) AS h FROM {P})"
)
def barrier(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", detect.barrier(F.col("html"), _elements()).alias("b")).select("page_id", "b.*")


@query(
    f"SELECT page_id, CASE WHEN page_type = 'blocked' OR {_says('bot_blocked')} THEN 'bot_blocked' WHEN {_says('error_page')} AND {_FIELDS} < 10 THEN 'error_page' WHEN {_says('login_required')} AND {_FIELDS} < 15 THEN 'login_required' WHEN {_says('age_verification')} THEN 'age_verification' WHEN {_says('region_restricted')} THEN 'region_restricted' WHEN page_type = 'product_detail' AND {_says('out_of_stock')} THEN 'out_of_stock' WHEN page_type IN ('search_results', 'listing') AND {_says('empty_results')} THEN 'empty_results' END AS state"
    f" FROM (SELECT page_id, lower(html) AS h, page_type FROM {P} JOIN ({_type_sql()}) USING (page_id))"
)
def page_state(spark, sf_dir):
    rows = classify.classify(_pages(spark, sf_dir).withColumn("low", F.lower("html")), ("html", "low"))
    return rows.select("page_id", detect.page_state(F.col("html"), F.col("page_type"), _elements())["state"].alias("state"))


# scores

_L = "(SELECT l_orderkey, l_linenumber, l_discount * 10 AS d, l_tax * 12.5 AS t, l_quantity / 50 AS q, l_returnflag AS f FROM lineitem)"


def _alpha(x: str) -> str:
    return f"CASE WHEN q >= 1 THEN 1.0 ELSE {x} END"


_RAW = "((1 + (1 - q) * 2) * (1 - d * 0.5))"


@query(
    f"SELECT l_orderkey, l_linenumber, round({_alpha(f'greatest(0.8, least(1.15, pow({_RAW}, 0.3)))')}, 6) AS aom, round({_alpha(f'greatest(0.4, least(1.0, 1 / {_RAW}))')}, 6) AS grouping_, round({_alpha(f'greatest(1.0, least(3.0, {_RAW}))')}, 6) AS budget, round(t * (0.7 + 0.3 * d), 6) AS effective, CASE WHEN f = 'R' THEN 'A' WHEN f = 'N' AND d >= (0.8 - 0.15 * q) * 0.75 THEN 'A' WHEN d >= 0.8 - 0.15 * q THEN 'A' WHEN d >= 0.4 - 0.15 * q THEN 'B' ELSE 'C' END AS tier FROM {_L}"
)
def stage_scores(spark, sf_dir):
    """Stage factors, effective scores and tiers, with order lines as chunks: quantity is pressure, discount density and fitness, tax score."""
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12.5).alias("t"), (F.col("l_quantity") / 50).alias("q"), "l_returnflag")
    a = scores.alphas(F.col("q"), F.col("d"))
    reason = F.when(F.col("l_returnflag") == "R", "meta_always").when(F.col("l_returnflag") == "N", "schema_match").otherwise("in_main_text")
    return d.select("l_orderkey", "l_linenumber", F.round(a["aom"], 6).alias("aom"), F.round(a["grouping"], 6).alias("grouping_"), F.round(a["budget"], 6).alias("budget"), F.round(scores.effective(F.col("t"), F.col("d")), 6).alias("effective"), scores.tier(reason, F.col("d"), F.col("q")).alias("tier"))


@query("SELECT vec_id, label, CASE WHEN n > 0 THEN round(dot / n, 9) ELSE 0 END AS similarity FROM (SELECT vec_id, label, list_sum(list_transform(list_zip(e, h), lambda x: x[1] * x[2])) AS dot, sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) CROSS JOIN (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS h FROM embeddings WHERE vec_id = 0))")
def task_fitness(spark, sf_dir):
    """Cosine of every vector with the task vector (that of id 0, one row)."""
    d = _t(spark, sf_dir, "embeddings")
    (task,) = d.filter("vec_id = 0").select("embedding").collect()  # fails unless there is exactly one
    return d.withColumn("hint", F.array(*[F.lit(x) for x in task.embedding])).select("vec_id", "label", F.round(scores.cosine(F.col("embedding"), F.col("hint")), 9).alias("similarity"))


_PAIRS = "(SELECT event_id, user_id, ts, event_type, value, CAST(floor(value) AS INTEGER) AS n, lag(event_type) OVER w AS p_type, lag(CAST(floor(value) AS INTEGER)) OVER w AS p_n, lag(event_id) OVER w AS p_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"SELECT event_id, CASE WHEN p_id IS NULL THEN 'none' WHEN p_type <> event_type OR (abs(n - p_n) > 0 AND (abs(n - p_n) > 3 OR CAST(abs(n - p_n) AS DOUBLE) / greatest(p_n, 1) > 0.2)) THEN 'major' WHEN n <> p_n OR p_id % 7 <> event_id % 7 THEN 'minor' ELSE 'none' END AS severity FROM {_PAIRS}")
def change_verdict(spark, sf_dir):
    """Severity of the change from a session's last fingerprint, with event type as title and value as number of elements."""
    e = _t(spark, sf_dir, "events")
    now = F.struct(F.col("event_type").alias("title"), F.lit(False).alias("dialog"), F.floor("value").cast("int").alias("interactives"), (F.col("event_id") % 7).alias("children"), F.lit(None).cast("string").alias("hash"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("now", now).withColumn("last", F.lag("now").over(w))
    return rows.select("event_id", scores.change(F.col("last"), F.col("now")).alias("severity"))


@query("SELECT user_id, round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / count(*) ELSE 0 END, 9) AS hit_rate, count(*) AS asks FROM events GROUP BY user_id")
def hit_rate(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("h"), F.count_if(~(F.col("value") > 50)).alias("m"), F.count("*").alias("asks"))
    return e.select("user_id", F.round(scores.rate(F.col("h"), F.col("m")), 9).alias("hit_rate"), "asks")


# windows

_CHUNKS = "(SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS INTEGER) AS pos, CASE l_returnflag WHEN 'R' THEN 'schema_match' WHEN 'A' THEN 'no_match' ELSE 'in_main_text' END AS reason, l_linestatus AS parent, round(l_tax * 5 + 0.05, 3) AS score, l_returnflag <> 'A' AS keep, 'text ' || l_partkey AS text, l_quantity AS depth, CAST(l_partkey % 90 + 10 AS INTEGER) AS tokens FROM lineitem)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored chunks of a page (the order)."""
    d = _t(spark, sf_dir, "lineitem")
    reason = F.when(F.col("l_returnflag") == "R", "schema_match").when(F.col("l_returnflag") == "A", "no_match").otherwise("in_main_text")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    return d.select(F.col("l_orderkey").alias("page_id"), F.row_number().over(order).alias("pos"), reason.alias("reason"), F.col("l_linestatus").alias("parent"), F.round(F.col("l_tax") * 5 + 0.05, 3).alias("score"), (F.col("l_returnflag") != "A").alias("keep"), F.concat(F.lit("text "), "l_partkey").alias("text"), F.col("l_quantity").alias("depth"), (F.col("l_partkey") % 90 + 10).cast("int").alias("tokens"))


def _near(k: int) -> str:
    side = lambda f: f"{f}(reason = 'schema_match', {k}) OVER w AND {f}(parent, {k}) OVER w = parent"
    return f"CASE WHEN ({side('lag')}) OR ({side('lead')}) THEN {0.15 / k} ELSE 0 END"


@query(f"SELECT page_id, pos, round(least(score + g, 1.0), 6) AS score, keep OR (g > 0 AND least(score + g, 1.0) >= 0.45 AND length(text) >= 5) AS keep FROM (SELECT *, CAST(greatest({_near(1)}, {_near(2)}) AS DOUBLE) AS g FROM {_CHUNKS} WINDOW w AS (PARTITION BY page_id ORDER BY pos))")
def adjacent_boost(spark, sf_dir):
    return windows.adjacent_boost(_chunks(spark, sf_dir)).select("page_id", "pos", F.round("score", 6).alias("score"), "keep")


@query(f"SELECT page_id, pos, always OR total - before <= 120 AS kept FROM (SELECT page_id, pos, always, sum(tokens) OVER (PARTITION BY page_id) AS total, coalesce(sum(tokens) OVER (PARTITION BY page_id ORDER BY always, score, depth DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, reason = 'schema_match' AS always FROM {_CHUNKS}))")
def budget_drop(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    out = windows.drop_to_budget(c, "page_id", F.col("score"), F.col("depth"), F.col("pos"), F.col("tokens"), F.col("reason") == "schema_match", F.lit(120))
    return out.select("page_id", "pos", "kept")


@query(f"SELECT page_id, pos, tokens FROM (SELECT page_id, pos, tokens, sum(tokens) OVER (PARTITION BY page_id ORDER BY pos) AS r FROM {_CHUNKS}) WHERE r <= 150")
def prefix_budget(spark, sf_dir):
    return windows.prefix_budget(_chunks(spark, sf_dir), "page_id", "pos", F.col("tokens"), F.lit(150)).select("page_id", "pos", "tokens")


@query("SELECT conv_id, turn, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT conv_id, turn, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS s FROM (SELECT DISTINCT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def chunk_islands(spark, sf_dir):
    """Runs of consecutive chunks of one parent, with turns as chunks and roles as parents."""
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return windows.islands(c, "conv_id", "turn", "role").select("conv_id", "turn", "island")


@query("SELECT event_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, b ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM events)")
def consecutive_runs(spark, sf_dir):
    return windows.run_length(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 50).select("event_id", "run")


@query("SELECT event_id, coalesce(lag(event_type) OVER w = event_type, false) AS same_as_last, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6, 3) AS gap_s, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER v) / 1e6, 3) AS again_gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def tool_repeats(spark, sf_dir):
    return windows.repeats(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type").select("event_id", "same_as_last", "gap_s", "again_gap_s")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_per_key(spark, sf_dir):
    return windows.first_per_key(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


# joins and aggregates


@query("WITH t AS (SELECT o_orderpriority AS domain, o_orderstatus AS page_type, min(o_orderkey) AS template FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) SELECT o_orderkey, template FROM orders LEFT JOIN t ON o_orderpriority = domain AND o_orderstatus = page_type")
def template_join(spark, sf_dir):
    """Pages with their template by (domain, page type), with orders as pages."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("page_type"))
    t = o.filter("page_type <> 'P'").groupBy("domain", "page_type").agg(F.min("o_orderkey").alias("template"))
    return joins.with_template(o, t).select("o_orderkey", "template")


@query("WITH w AS (SELECT url, min(pos) AS pos FROM (SELECT url, page_id AS pos FROM pages UNION ALL SELECT 'http://gone.example.com/' || i, 1000000000 + i FROM range(3) r(i)) GROUP BY url) SELECT pos, w.url, page_id, CASE WHEN page_id IS NULL THEN 'error: not found' WHEN octet_length(encode(html)) > %d THEN 'error: too large' ELSE 'ok' END AS status FROM w LEFT JOIN pages p ON p.url = w.url" % fixed.MAX_HTML_BYTES)
def batch_status(spark, sf_dir):
    """Every page is asked for, and three that aren't there."""
    p = _t(spark, sf_dir, "pages")
    gone = spark.range(3).select(F.concat(F.lit("http://gone.example.com/"), F.col("id")).alias("url"), (F.col("id") + 1_000_000_000).alias("pos"))
    return sources.batch_status(p.select("url", F.col("page_id").alias("pos")).unionByName(gone), p, None)


@query("WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') SELECT user_id, ask_id, CASE WHEN epoch_us(ts) - epoch_us(found_ts) <= 86400000000 THEN CAST(found AS VARCHAR) END AS entry FROM (SELECT a.user_id, a.event_id AS ask_id, a.ts, arg_max(e.event_id, e.ts) AS found, max(e.ts) AS found_ts FROM a LEFT JOIN e ON e.user_id = a.user_id AND e.ts <= a.ts GROUP BY ALL)")
def cache_asof(spark, sf_dir):
    """The latest cached entry of a key not older than a day, with clicks as entries and purchases as asks."""
    e = _t(spark, sf_dir, "events")
    asks = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("ask_ts"), F.col("event_id").alias("ask_id"))
    entries = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("entry_ts"), F.col("event_id").alias("entry"))
    return joins.latest_fresh(asks, entries, "user_id", 86_400)


@query("WITH a AS (SELECT DISTINCT lower(substr(p_name, 1, 30)) AS k FROM part WHERE p_size < 20), b AS (SELECT DISTINCT lower(substr(p_name, 1, 30)) AS k FROM part WHERE p_retailprice > 1200) SELECT k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'high' ELSE 'medium' END AS severity FROM a FULL JOIN b USING (k)")
def merge_findings(spark, sf_dir):
    """Findings of two scanners by their first 30 characters, with parts as findings."""
    p = _t(spark, sf_dir, "part")
    return joins.merge_findings(p.filter("p_size < 20"), p.filter("p_retailprice > 1200"), F.lower(F.substring("p_name", 1, 30)))


@query(f"WITH o AS (SELECT page_id, pos, line FROM {LINES}), n AS (SELECT page_id, pos - 1 AS pos, line FROM {LINES} WHERE pos > 0) SELECT coalesce(o.page_id, n.page_id) AS page_id, CAST(coalesce(o.pos, n.pos) AS INTEGER) AS pos, CASE WHEN o.line IS NULL THEN 'added' WHEN n.line IS NULL THEN 'removed' WHEN o.line = n.line THEN 'same' ELSE 'changed' END AS verdict FROM o FULL JOIN n ON o.page_id = n.page_id AND o.pos = n.pos")
def page_diff(spark, sf_dir):
    """Two snapshots of a page line by line; the second one is the page without its first line."""
    lines = extract.text_lines(_pages(spark, sf_dir))
    return joins.page_diff(lines, lines.filter("pos > 0").withColumn("pos", F.col("pos") - 1), ["page_id", "pos"], "line")


@query("SELECT user_id, event_type AS tier, count(*) AS n FROM events GROUP BY 1, 2")
def tier_counts(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("tier")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS pages, CAST(sum(raw) AS BIGINT) AS raw_tokens, CAST(sum(pruned) AS BIGINT) AS pruned_tokens, round(1 - CAST(sum(pruned) AS DOUBLE) / sum(raw), 9) AS reduction, 1 - CAST(sum(pruned) AS DOUBLE) / sum(raw) >= 0.8 AS passed FROM (SELECT {_tokens('html')} AS raw, coalesce({_tokens('text')}, 0) AS pruned FROM {P} p LEFT JOIN {_COMPRESSED} c ON c.page_id = p.page_id)")
def run_summary(spark, sf_dir):
    """Totals of a run and whether it passes the reduction goal."""
    p = _pages(spark, sf_dir)
    c = digest.compress(extract.text_lines(p), 250)
    rows = p.join(c, "page_id", "left").select(text.tokens(F.col("html")).alias("raw"), F.coalesce(text.tokens(F.col("text")), F.lit(0)).alias("pruned"))
    out = rows.agg(F.count("*").alias("pages"), F.sum("raw").alias("raw_tokens"), F.sum("pruned").alias("pruned_tokens"))
    share = 1 - F.col("pruned_tokens") / F.col("raw_tokens")
    return out.select("*", F.round(share, 9).alias("reduction"), (share >= 0.8).alias("passed"))


# keyed state, batch forms


@query("WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT user_id, event_id, n, value AS m FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, 0.3 * o.value + 0.7 * r.m FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, event_id, round(m, 6) AS ema FROM r")
def ema(spark, sf_dir):
    return state.ema(_t(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query("SELECT user_id, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 90000000 AND lag(event_type || floor(value)) OVER w = event_type || floor(value) THEN 'A' WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 90000000 AND lag(event_type) OVER w = event_type THEN 'B' ELSE 'C' END AS tier FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id)")
def cache_tiers(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("session", F.col("user_id") % 3)
    out = state.cache_tiers(e, "session", "ts", F.concat("event_type", F.floor("value").cast("string")), F.col("event_type"))
    return out.select("user_id", "event_id", "tier")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1 AS is_new FROM customer")
def scroll_dedup(spark, sf_dir):
    """Cards new in a session, with customers as cards (market segment as url) and nations as sessions."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("session"), F.col("c_mktsegment").alias("url"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"))
    return state.scroll_dedup(c, "session", "c_custkey").select("c_custkey", F.col("new").alias("is_new"))


@query()
def token_bucket(spark, sf_dir):
    return state.token_bucket(_t(spark, sf_dir, "events"), "user_id", "ts", burst=2.0, rate=0.0001)


@query("WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events), r AS (SELECT user_id, event_id, n, t AS s, 1 AS c, 1 AS no FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.t - r.s >= 1800000000 OR r.c >= 100 THEN o.t ELSE r.s END, CASE WHEN o.t - r.s >= 1800000000 OR r.c >= 100 THEN 1 ELSE r.c + 1 END, CASE WHEN o.t - r.s >= 1800000000 OR r.c >= 100 THEN r.no + 1 ELSE r.no END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, event_id, no AS session_no FROM r")
def session_lifetimes(spark, sf_dir):
    return state.lifetimes(_t(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return state.windowed(_t(spark, sf_dir, "events"), "ts", "10 minutes", "1 day", None, "event_type").select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, k")
def idle_sessions(spark, sf_dir):
    return state.sessions(_t(spark, sf_dir, "events"), "ts", "10 minutes", "30 minutes", "user_id").select("user_id", "start", "n")


# trees and whole pages


@query()
def dom_nodes(spark, sf_dir):
    return dom.nodes(_pages(spark, sf_dir)).drop("attrs", "text", "alike")


@query()
def removed_nodes(spark, sf_dir):
    return dom.remove(dom.weigh(dom.nodes(_pages(spark, sf_dir)))).select("page_id", "node_id", "tag", "weight", "reason", "removed", "gone")


@query()
def pruned_chunks(spark, sf_dir):
    return windows.adjacent_boost(dom.prune(dom.chunks(_pages(spark, sf_dir))).withColumnRenamed("parent_xpath", "parent")).select("page_id", "pos", "kind", "text", "reason", "keep", "score")


@query()
def page_digest(spark, sf_dir):
    return digest.digest(_pages(spark, sf_dir))


@query()
def page_prompt(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return digest.prompt(digest.digest(p), extract.interactables(p), extract.images(p))


# compressors, metadata, commerce


def _style_sql(name: str) -> str:
    s = compress.STYLES[name]
    some = lambda x, terms: "(" + " OR ".join(f"contains({x}, {fixtures.quoted(t)})" for t in terms) + ")" if terms else "false"
    short = f"length(line) < {s.below}"
    by = some("line" if s.exact else "lower(line)", s.terms)
    part = f"substr(line, 1, {s.cut})"
    if s.indent:
        part = f"CASE WHEN {short} THEN {part} ELSE '{s.indent}' || {part} END"
    if s.numbered:
        part = f"'Q' || row_number() OVER (PARTITION BY page_id ORDER BY pos) || '. ' || {part}"
    head = f"SELECT page_id, pos - 1000000000 AS pos, '{s.tag}' || substr(line, 1, 200) AS part FROM {LINES} WHERE {some('lower(line)', s.first)}"
    return f"""WITH h AS ({head}), s AS (SELECT page_id, sum(length(part) + 1) AS spent FROM h GROUP BY page_id),
        r AS (SELECT page_id, pos, {part} AS part FROM {LINES} WHERE length(line) >= {s.least} AND ({short} OR {by})),
        b AS (SELECT r.*, sum(length(part) + 1) OVER (PARTITION BY page_id ORDER BY pos) + coalesce(spent, 0) AS run FROM r LEFT JOIN s USING (page_id))
        SELECT page_id, string_agg(part, chr(10) ORDER BY pos) AS text FROM (SELECT page_id, pos, part FROM b WHERE run <= 600 UNION ALL SELECT page_id, pos, part FROM h) GROUP BY page_id"""


def _style(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compress.text_of(compress.compress(extract.text_lines(_pages(spark, sf_dir)), compress.STYLES[name], 600))

    return run


for _name in compress.STYLES:
    QUERIES[f"compress_{_name}"] = _style(_name)
    SQL[f"compress_{_name}"] = _style_sql(_name)


@query()
def typed_context(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return compress.by_type(digest.typed_lines(p), 950)


@query()
def page_metadata(spark, sf_dir):
    return metadata.cascade(_pages(spark, sf_dir))


@query()
def navigation_hints(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return commerce.hints(extract.interactables(p), classify.classify(p).select("page_id", "page_type"))


@query()
def product_options(spark, sf_dir):
    return commerce.options(extract.interactables(_pages(spark, sf_dir)))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE found) AS hits, round(CAST(count(*) FILTER (WHERE found) AS DOUBLE) / count(*), 9) AS recall FROM (SELECT bool_or(contains(lower(d.text), lower(b.text))) AS found FROM benchmark b CROSS JOIN (SELECT string_agg(text, chr(10)) AS text FROM documents) d GROUP BY b.item_id)")
def field_recall(spark, sf_dir):
    """Share of expected values (whole benchmark items) that the texts hold.

    Candidates share the value's first three words with a text (an equi-join), then containment is tested.
    """
    key = lambda c: F.lower(F.concat_ws(" ", F.slice(F.split(F.trim(c), r"\s+"), 1, 3)))
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("value"), key(F.col("text")).alias("k"))
    # the words are made once, in front of a generator; then every run of three is a short slice
    bodies = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(F.lower("text").alias("body"), F.split(F.lower(F.trim("text")), r"\s+").alias("words")))).alias("s"))
    bodies = bodies.select("doc_id", F.col("s.body").alias("body"), F.col("s.words").alias("words"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("words", i, 3)))
    texts = bodies.select("doc_id", "body", F.explode(F.array_distinct(grams)).alias("k"))
    hit = items.join(texts, "k").filter(F.col("body").contains(F.col("value"))).select("item_id").distinct().withColumn("found", F.lit(True))
    out = items.select("item_id").distinct().join(hit, "item_id", "left").agg(F.count("*").alias("total"), F.count("found").alias("hits"))
    return out.select("total", "hits", F.round(F.col("hits") / F.col("total"), 9).alias("recall"))
