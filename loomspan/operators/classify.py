"""Page types by weighted signals: a rule table, turned into one row-wise expression without any shuffle.

A rule is a condition on the lower-case URL, the title or the lower-case HTML, and the points it gives to page types.
The same conditions also render as SQL text, so that the rule table can be checked against another engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import fixed
from loomspan.functions import urls


@dataclass(frozen=True)
class Cond:
    """kind: has (any term), lacks (no term), count (terms together at least n), below (a term less than n times), re (pattern),
    short (text below n), root, notroot."""

    kind: str
    on: str
    terms: tuple[str, ...] = ()
    n: int = 0

    def column(self, inputs: dict[str, Column]) -> Column:
        x = inputs[self.on]
        if self.kind == "has":
            return reduce(lambda a, b: a | b, [x.contains(t) for t in self.terms])
        if self.kind == "lacks":
            return ~reduce(lambda a, b: a | b, [x.contains(t) for t in self.terms])
        if self.kind == "count":
            times = [(F.length(x) - F.length(F.replace(x, F.lit(t), F.lit("")))) / len(t) for t in self.terms]
            return reduce(lambda a, b: a + b, times) >= self.n
        if self.kind == "re":
            return F.regexp_count(x, F.lit(self.terms[0])) >= max(1, self.n)
        if self.kind == "short":
            return F.length(F.trim(F.regexp_replace(x, "<[^>]+>", ""))) < self.n
        if self.kind == "below":
            return (F.length(x) - F.length(F.replace(x, F.lit(self.terms[0]), F.lit("")))) / len(self.terms[0]) < self.n
        return urls.is_root(x) if self.kind == "root" else ~urls.is_root(x)

    def sql(self) -> str:
        q = lambda t: "'" + t.replace("'", "''") + "'"
        if self.kind in ("has", "lacks"):
            some = "(" + " OR ".join(f"contains({self.on}, {q(t)})" for t in self.terms) + ")"
            return some if self.kind == "has" else f"NOT {some}"
        if self.kind == "count":
            return "(" + " + ".join(f"(length({self.on}) - length(replace({self.on}, {q(t)}, ''))) / {float(len(t))}" for t in self.terms) + f") >= {self.n}"
        if self.kind == "re":
            return f"len(regexp_extract_all({self.on}, {q(self.terms[0])})) >= {max(1, self.n)}"
        if self.kind == "short":
            return f"length(trim(regexp_replace({self.on}, '<[^>]+>', '', 'g'))) < {self.n}"
        if self.kind == "below":
            return f"(length({self.on}) - length(replace({self.on}, {q(self.terms[0])}, ''))) / {float(len(self.terms[0]))} < {self.n}"
        path = f"regexp_replace(regexp_extract({self.on}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
        return ("" if self.kind == "root" else "NOT ") + f"({path} = '' OR starts_with({path}, '/index'))"


@dataclass(frozen=True)
class Rule:
    name: str
    layer: str
    conds: tuple[Cond, ...]
    points: dict[str, int]

    @property
    def primary(self) -> str:
        """The type that gets the most points, the first one at equal points."""
        return max((t for t in self.points if self.points[t] > 0), key=lambda t: self.points[t])


def has(on: str, *terms: str) -> Cond:
    return Cond("has", on, terms)


def lacks(on: str, *terms: str) -> Cond:
    return Cond("lacks", on, terms)


def count(n: int, *terms: str) -> Cond:
    return Cond("count", "html", terms, n)


# The signals. URL terms first: name, terms (any of them), points.
_URL = """
vp_products | /vp/products/ | product_detail 25
products | /products/ | product_detail 20
catalog | /catalog/ | product_detail 20
item | /item/ | product_detail 20
product_slash | /product/ | product_detail 25
product_dot | /product. | product_detail 25
dp | /dp/ | product_detail 20
product_detail_kw | /productdetail | product_detail 20
search | /search | search_results 25, listing -10
q_param | ?q=, &q= | search_results 25
query_param | ?query=, &query= | search_results 25
keyword_param | ?keyword=, &keyword= | search_results 25
browse | /browse | search_results 20
searchterm | ?searchterm=, &searchterm= | search_results 25
article | /article/, /articles/ | article 25, news 5
wiki | /wiki/ | article 30
wikipedia_domain | wikipedia.org | article 15, dashboard -15
blog | /blog/ | article 25
post | /post/ | article 20
news | /news/ | news 25, article 10
ranking | /ranking | listing 20, product_detail -5
best | /best | listing 20, product_detail -5
category | /category/, /categories/ | listing 25, product_detail -15
collections | /collections/, /collection/ | listing 25, product_detail -10
gender_path | /men/, /women/, /man/, /woman/, /men., /women. | listing 20, product_detail -5
login | /login, /signin, /sign-in | login 25, form -10
checkout | /checkout | checkout 25, product_detail -10
payment | /payment | checkout 25
register | /register, /signup, /sign-up | form 20, login -10
contact | /contact | form 20
apply | /apply | form 20
dashboard | /dashboard | dashboard 20
admin | /admin | dashboard 20
analytics | /analytics | dashboard 20
faq | /faq | help_faq 20, article -10
help | /help | help_faq 20
support | /support | help_faq 20
settings | /settings, /preferences | settings 20, form -10
profile_edit | /profile/edit, /account/edit | settings 20
404 | /404 | error 15
error | /error | error 15
docs | /docs, /documentation | documentation 20, article -5
api_ref | /api-reference, /api-docs | documentation 25
youtube_watch | youtube.com/watch, youtu.be/ | video 30, documentation -15
video_path | /video/, /videos/ | video 15
sorry | /sorry/ | blocked 30
captcha | /captcha | blocked 25, error -10
cf_verify | challenge-platform, cf-browser-verification | blocked 30
edgesuite | errors.edgesuite.net | blocked 30
"""
# Terms in the title.
_TITLE = """
title_login | login, sign in, log in, 로그인, ログイン, se connecter, anmelden | login 15
title_error | 404, 500, not found, page not found, 페이지를 찾을 수 없, ページが見つかりません | error 35
title_faq | faq, frequently asked, 자주 묻는 질문, よくある質問, help center, 도움말 | help_faq 15
title_blocked | access denied, attention required, please verify, just a moment, you have been blocked, 접근이 거부, アクセスが拒否 | blocked 30, error -15
"""
_PASSWORD = ('type="password"', "type='password'")
_DENIED = ("access denied", "access blocked", "forbidden", "접근이 거부", "アクセスが拒否")
# Signals that need more than one condition.
_OTHER = [
    ("url_goods", "url", [has("url", "/good"), lacks("url", "/goodbye")], "product_detail 20"),
    ("url_amazon_dp", "url", [has("url", "/dp/"), has("url", "amazon.")], "product_detail 25"),
    ("url_nike_t", "url", [has("url", "/t/"), has("url", "nike.com", "nike.")], "product_detail 15, listing -5"),
    ("url_list", "url", [has("url", "/list"), lacks("url", "/listing")], "listing 20, product_detail -5"),
    ("url_nike_w", "url", [has("url", "/w/"), has("url", "nike.com", "nike.")], "listing 20"),
    ("url_auth", "url", [has("url", "/auth"), lacks("url", "/author")], "login 20"),
    ("url_order", "url", [has("url", "/order"), lacks("url", "/orders")], "checkout 20"),
    ("url_vimeo_video", "url", [has("url", "vimeo.com/"), Cond("notroot", "url")], "video 25"),
    ("url_root", "url", [Cond("root", "url")], "landing 30, listing -10"),
    ("url_challenge", "url", [has("url", "/challenge"), lacks("url", "/challenges")], "blocked 25, error -10"),
    ("meta_og_article", "meta", [Cond("re", "og", ("^article$",))], "article 20"),
    ("meta_og_video", "meta", [Cond("re", "og", ("^video",))], "video 25, documentation -10"),
    ("dom_password_input", "dom", [has("html", *_PASSWORD)], "login 30, form -15, settings -10"),
    ("dom_remember_me", "dom", [has("html", "remember"), has("html", "checkbox", "check")], "login 20"),
    ("dom_single_form_password", "dom", [count(1, "<form"), Cond("below", "html", ("<form",), 2), has("html", *_PASSWORD)], "login 10"),
    ("dom_cc_fields", "dom", [has("html", 'autocomplete="cc-', "autocomplete='cc-")], "checkout 30, form -10"),
    ("dom_shipping_fields", "dom", [has("html", 'autocomplete="shipping', "autocomplete='shipping", 'name="shipping', "name='shipping")], "checkout 20"),
    ("dom_step_indicator", "dom", [has("html", "stepper", "step-indicator")], "checkout 10"),
    ("dom_many_fields_no_password", "dom", [count(6, "<input"), lacks("html", *_PASSWORD)], "form 25, login -20"),
    ("dom_textarea", "dom", [has("html", "<textarea")], "form 15"),
    ("dom_fieldset", "dom", [count(2, "<fieldset")], "form 20"),
    ("dom_many_tables", "dom", [count(2, "<table")], "dashboard 25, article -10"),
    ("dom_chart_elements", "dom", [count(2, "<canvas")], "dashboard 25"),
    ("dom_sidebar_nav", "dom", [has("html", 'role="navigation"'), has("html", "sidebar", "side-nav", "sidenav")], "dashboard 20"),
    ("dom_details_elements", "dom", [count(3, "<details")], "help_faq 30, article -10"),
    ("dom_qa_question", "dom", [count(3, "question")], "help_faq 20"),
    ("dom_switch_role", "dom", [has("html", 'role="switch"')], "settings 15, form -10, login -15"),
    ("dom_many_selects", "dom", [count(3, "<select")], "settings 10"),
    ("dom_very_short_content", "dom", [Cond("short", "html", (), 200)], "error 20"),
    ("dom_not_found_text", "dom", [has("html", "page not found", "페이지를 찾을 수 없", "ページが見つかりません", "page introuvable", "seite nicht gefunden")], "error 25"),
    ("dom_code_blocks", "dom", [count(3, "<code", "<pre")], "documentation 30, article -5"),
    ("dom_toc_sidebar", "dom", [has("html", "sidebar", "side-nav", "sidenav"), Cond("re", "html", (r"table-of-contents|(?:class|id)=[\"'](?:[^\"']*[^a-z0-9_\"'])?toc(?:[^a-z0-9_\"'][^\"']*)?[\"']",))], "documentation 25"),
    ("dom_version_selector", "dom", [has("html", "version"), has("html", "<select")], "documentation 15"),
    ("dom_video_player", "dom", [has("html", "<video", "ytd-player", "video-player")], "video 20"),
    ("dom_mw_content", "dom", [has("html", "mw-content-text", "mw-parser-output")], "article 25, dashboard -20"),
    ("dom_hero_cta", "dom", [has("html", "hero", "jumbotron"), has("html", "cta", "call-to-action", "get-started", "sign-up")], "landing 20, article -10, listing -10"),
    ("dom_many_sections", "dom", [count(10, "<section")], "landing 15"),
    ("dom_add_to_cart", "dom", [has("html", *fixed.CART_TERMS)], "product_detail 20"),
    ("dom_many_cart_keywords", "dom", [count(10, *fixed.CART_TERMS)], "listing 15"),
    ("dom_product_link_grid", "dom", [Cond("re", "html", (r"<a[ \t\r\n](?:[^>]*[^a-z>-])?href=[\"'][^\"']*(?:/products?/|/items?/|/goods/|/dp/)[^\"']*[\"']",), 20)], "listing 20"),
    ("dom_captcha_element", "dom", [has("html", "g-recaptcha", "h-captcha", "cf-turnstile", "challenge-form", "captcha-container")], "blocked 30, error -10"),
    ("dom_modern_antibot", "dom", [has("html", "datadome", "px-captcha", "human-challenge", "incapsula", "_incap_")], "blocked 25"),
    ("dom_blocked_short", "dom", [Cond("short", "html", (), 2000), has("html", *_DENIED)], "blocked 35, error -10"),
    ("dom_cf_challenge", "dom", [has("html", "cf-browser-verification", "challenge-platform", "cf-chl-bypass", "challenge-running")], "blocked 35"),
    ("dom_just_a_moment", "dom", [has("html", "just a moment"), Cond("short", "html", (), 2000)], "blocked 30"),
]


def _points(text: str) -> dict[str, int]:
    return {t: int(n) for t, n in (x.split() for x in text.split(","))}


def _simple(table: str, layer: str, on: str) -> list[Rule]:
    out = []
    for line in table.strip().splitlines():
        name, terms, points = (x.strip() for x in line.split(" | "))
        out.append(Rule(f"{layer}_{name}", layer, (has(on, *(t.strip() for t in terms.split(","))),), _points(points)))
    return out


RULES: list[Rule] = (
    _simple(_URL, "url", "url")
    + [Rule(n, layer, tuple(c), _points(p)) for n, layer, c, p in _OTHER if layer == "url"]
    + _simple(_TITLE, "meta", "title")
    + [Rule(n, layer, tuple(c), _points(p)) for n, layer, c, p in _OTHER if layer != "url"]
)


def inputs(url: Column, html: Column) -> dict[str, Column]:
    """What the conditions look at."""
    return {
        "url": F.lower(url),
        "title": F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "og": F.lower(F.regexp_extract(html, r"(?i)property=[\"']og:type[\"'][^>]*content=[\"']([^\"']+)", 1)),
        "html": F.lower(html),
    }


#: JSON-LD type -> page type; page-level types (listing, search_results) win over the others.
JSONLD_TYPES = {
    "Product": "product_detail", "IndividualProduct": "product_detail", "ItemList": "listing", "CollectionPage": "listing", "OfferCatalog": "listing", "SearchResultsPage": "search_results", "NewsArticle": "news", "Article": "article",
    "ReportageNewsArticle": "news", "BlogPosting": "article", "FAQPage": "help_faq", "ContactPage": "form", "CheckoutPage": "checkout", "Event": "landing",
    "MusicEvent": "landing", "SportsEvent": "landing", "TheaterEvent": "landing", "BusinessEvent": "landing", "EducationEvent": "landing", "Festival": "landing",
    "ExhibitionEvent": "landing", "LocalBusiness": "landing", "Restaurant": "landing", "Hotel": "landing", "Store": "landing", "MedicalClinic": "landing",
    "FoodEstablishment": "landing", "HealthAndBeautyBusiness": "landing", "AutoRepair": "landing", "Dentist": "landing", "RealEstateAgent": "landing", "VideoObject": "video",
}


def jsonld_type(html: Column) -> Column:
    """Page type named by JSON-LD types, page-level ones first; null if none is known."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    found = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(r'"@type"[ \t\r\n]*:[ \t\r\n]*\[?[ \t\r\n]*"([A-Za-z]+)"'), F.lit(1))))
    table = F.create_map(*[F.lit(x) for kv in JSONLD_TYPES.items() for x in kv])
    types = F.filter(F.transform(found, lambda t: table[t]), lambda t: t.isNotNull())
    page = F.filter(types, lambda t: t.isin("listing", "search_results"))
    return F.get(F.concat(page, types), F.lit(0))


def fired(url: Column, html: Column) -> list[Column]:
    """One boolean for each rule."""
    return fired_by(inputs(url, html))


def fired_by(given: dict[str, Column]) -> list[Column]:
    return [reduce(lambda a, b: a & b, [c.column(given) for c in r.conds]) for r in RULES]


def fence(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that later projections read instead of evaluating again: a generator of one row stands between."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_fence")
    return rows.select(*[c for c in rows.columns if c not in columns], made).select("*", *[F.col(f"_fence.{n}").alias(n) for n in columns]).drop("_fence")


def classify(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, page_type, score, runner_up, confidence, and the columns to ``keep``, so that no join brings them back.

    The points of the signals that fired, summed by type, DOM points capped; a strong URL leaves only signs of a block from
    the other layers; ties by number of signals, then by priority. Row-wise in a few fenced projections, so no condition is
    evaluated twice; no shuffle.
    """
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.layer).alias("layer"), F.lit(t).alias("type"), F.lit(n).alias("n"), F.lit("blocked" in r.points).alias("blocked"), F.lit(t == r.primary).alias("main")) for i, r in enumerate(RULES) for t, n in r.points.items()])
    types = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(-k).alias("rank"), F.lit(fixed.THRESHOLD[t]).alias("threshold"), F.lit(fixed.JSONLD_WEIGHT.get(t, 0)).alias("ld")) for k, t in enumerate(fixed.TYPE_PRIORITY)])
    total = lambda some: F.aggregate(some, F.lit(0), lambda s, p: s + p["n"])
    # what the conditions look at is made once: lower-cased texts, the title, the types of structured data
    given = inputs(F.col("url"), F.col("html"))
    rows = fence(pages.select("page_id", "url", "html", *[F.col(k).alias(f"_k_{k}") for k in keep]), **{f"g_{k}": c for k, c in given.items()}, ld=jsonld_type(F.col("html"))).drop("url", "html")
    rows = fence(rows, f=F.array(*fired_by({k: F.col(f"g_{k}") for k in given}))).drop(*[f"g_{k}" for k in given])
    rows = fence(rows, p=F.filter(table, lambda p: F.get(F.col("f"), p["rule"]))).drop("f")
    by_url = lambda t: total(F.filter("p", lambda p: (p["layer"] == "url") & (p["type"] == t["type"])))
    rows = fence(rows, strong=F.exists(types, lambda t: by_url(t) > 2 * t["threshold"]))
    rows = fence(rows, p=F.filter("p", lambda p: (p["layer"] == "url") | ~F.col("strong") | p["blocked"]))

    def score(t: Column) -> Column:
        own = F.filter("p", lambda p: p["type"] == t["type"])
        over = F.greatest(total(F.filter(own, lambda p: (p["layer"] == "dom") & (p["n"] > 0))) - fixed.DOM_CAP, F.lit(0))
        named = F.when(~F.col("strong") & F.col("ld").eqNullSafe(t["type"]), t["ld"]).otherwise(F.lit(0))
        return F.struct((total(own) - over + named).alias("score"), F.size(F.filter(own, lambda p: p["main"])).alias("seen"), t["rank"].alias("rank"), t["type"].alias("type"), t["threshold"].alias("threshold"))

    rows = fence(rows, s=F.transform(types, score))
    rows = fence(rows, r=F.reverse(F.array_sort(F.filter("s", lambda r: (r["score"] != 0) | (r["seen"] > 0)))))
    rows = rows.select("page_id", F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"), *[f"_k_{k}" for k in keep])
    return rows.select(
        "page_id",
        F.when(F.col("a.score") >= F.col("a.threshold"), F.col("a.type")).otherwise("unknown").alias("page_type"),
        F.coalesce("a.score", F.lit(0)).alias("score"),
        F.col("b.type").alias("runner_up"),
        F.coalesce(F.least(F.lit(1.0), F.col("a.score") / (F.col("a.threshold") * 2)), F.lit(0.0)).alias("confidence"),
        *[F.col(f"_k_{k}").alias(k) for k in keep],
    )
