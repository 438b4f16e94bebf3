"""Detectors: conditions in order of precedence, as struct columns that are null where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan import fixed
from loomspan.functions.text import trim

# What pages say in each failure state; the order of the keys is the order of precedence.
SAYS = {
    "bot_blocked": ["access denied", "please verify you are human", "verify you are human", "unusual traffic", "are you a robot", "접근이 차단", "アクセスが拒否", "accès refusé", "zugriff verweigert", "访问被拒绝"],
    "error_page": ["404 not found", "403 forbidden", "500 internal server error", "502 bad gateway", "503 service unavailable", "page not found", "페이지를 찾을 수 없습니다", "존재하지 않는 페이지", "this page doesn't exist", "this page does not exist", "something went wrong", "an error occurred", "server error", "oops", "ページが見つかりません", "page introuvable", "seite nicht gefunden", "页面未找到"],
    "login_required": ["login required", "please log in", "please sign in", "sign in to continue", "log in to continue", "로그인이 필요", "ログインが必要", "connexion requise", "anmeldung erforderlich", "请登录"],
    "age_verification": ["age verification", "verify your age", "are you over 18", "are you 18", "성인인증", "年齢確認", "vérification de l'âge", "altersverifikation", "年龄验证"],
    "region_restricted": ["not available in your country", "not available in your region", "region restricted", "이 지역에서는", "お住まいの地域では", "pas disponible dans votre pays", "in ihrem land nicht verfügbar", "您所在的地区"],
    "out_of_stock": ["품절", "매진", "sold out", "out of stock", "currently unavailable", "no longer available", "在庫切れ", "品切れ", "完売", "rupture de stock", "épuisé", "ausverkauft", "nicht verfügbar", "缺货", "已售罄"],
    "empty_results": ["검색 결과 없음", "결과가 없습니다", "no results found", "no results", "no items found", "your search did not match", "見つかりませんでした", "aucun résultat", "keine ergebnisse", "keine treffer", "没有找到", "未找到结果"],
}


def says(lower: Column, state: str) -> Column:
    """Whether a lower-case page says one of a state's terms."""
    out = F.lit(False)
    for term in SAYS[state]:
        out = out | lower.contains(term)
    return out


def page_state(html: Column, page_type: Column, elements: Column) -> Column:
    """struct(state, confidence) of the first failure that applies; null if none does."""
    h = F.lower(html)
    found = lambda state, value: F.struct(F.lit(state).alias("state"), value.cast("double").alias("confidence"))
    return (
        F.when(page_type == "blocked", found("bot_blocked", F.lit(0.95)))
        .when(says(h, "bot_blocked"), found("bot_blocked", F.when(elements < 5, 0.90).otherwise(0.85)))
        .when(says(h, "error_page") & (elements < 10), found("error_page", F.lit(0.75)))
        .when(says(h, "login_required") & (elements < 15), found("login_required", F.lit(0.70)))
        .when(says(h, "age_verification"), found("age_verification", F.lit(0.80)))
        .when(says(h, "region_restricted"), found("region_restricted", F.lit(0.80)))
        .when((page_type == "product_detail") & says(h, "out_of_stock"), found("out_of_stock", F.lit(0.80)))
        .when(page_type.isin("search_results", "listing") & says(h, "empty_results"), found("empty_results", F.lit(0.85)))
    )


def antibot(html: Column) -> Column:
    """struct(provider, confidence, visible) of the first provider that fits; visible if the body has under 200 characters."""
    h = F.lower(html)
    body = F.regexp_extract(h, r"(?s)<body[^>]*>(.*?)</body>", 1)
    visible = F.regexp_like(h, F.lit(r"(?s)<body[^>]*>.*?</body>")) & (F.length(trim(F.regexp_replace(body, "<[^>]+>", ""))) < 200)
    out = None
    for name, pattern, confidence in fixed.ANTIBOT:
        value = F.struct(F.lit(name).alias("provider"), F.lit(confidence).alias("confidence"), visible.alias("visible"))
        out = F.when(h.rlike(pattern), value) if out is None else out.when(h.rlike(pattern), value)
    return out


def popup(html: Column) -> Column:
    """struct(provider, confidence) of a promotional popup in the markup; null if there is none or it serves something else."""
    h = F.lower(html)
    match = F.regexp_extract(h, f"({fixed.POPUP})", 1)
    provider = (
        F.when(match.contains("newsletter"), F.lit("newsletter"))
        .when(match.contains("app"), F.lit("app-banner"))
        .when(match.contains("promo"), F.lit("promo"))
        .when(match.contains("exit"), F.lit("exit-intent"))
        .when(match.contains("subscribe"), F.lit("newsletter"))
        .otherwise(F.lit("generic"))
    )
    confidence = F.when(F.substring(h, 1, 5000).rlike(fixed.POPUP_PROMO), 0.80).otherwise(0.65)
    return F.when((match != "") & ~match.rlike(fixed.POPUP_NOT), F.struct(provider.alias("provider"), confidence.alias("confidence")))


def login_wall(html: Column, elements: Column) -> Column:
    """struct(confidence, fields, providers): additive evidence of a login wall; null below one half."""
    h = F.lower(html)
    password = h.rlike("type=[\"']password[\"']")
    score = F.when(password, 0.4).otherwise(0.0) + F.when(says(h, "login_required"), 0.3).otherwise(0.0) + F.when(h.rlike(r"/(?:login|signin|sign-in|auth)\b"), 0.3).otherwise(0.0) + F.when(elements < 10, 0.2).otherwise(0.0)
    fields = F.array_distinct(F.regexp_extract_all(h, F.lit(r"<input\b[^>]*type=[\"'](email|password|tel|text)[\"']"), F.lit(1)))
    providers = F.filter(F.array(*[F.when(h.rlike(rf"(?:sign in|log in|continue)[ \t]+with[ \t]+{p}|{p}[-_]?(?:login|signin|oauth)"), F.lit(p)) for p in ("google", "apple", "facebook", "github", "kakao", "naver")]), lambda p: p.isNotNull())
    return F.when(score >= 0.5, F.struct(F.round(F.least(score, F.lit(1.0)), 2).alias("confidence"), F.array_sort(fields).alias("fields"), providers.alias("providers")))


# Consent managers in order, with pattern and confidence.
CONSENT = [
    ("onetrust", r"onetrust|optanon", 0.95),
    ("cookiebot", r"cookiebot|cybotcookiebot", 0.95),
    ("trustarc", r"trustarc|truste", 0.90),
    ("quantcast", r"quantcast|qc-cmp", 0.90),
    ("didomi", r"didomi", 0.90),
    ("usercentrics", r"usercentrics", 0.90),
    ("generic", r"cookie[-_ ]?(?:consent|banner|notice|policy)|gdpr", 0.70),
]


def cookie_banner(html: Column) -> Column:
    """struct(provider, confidence) of the first consent manager that fits."""
    h, out = F.lower(html), None
    for name, pattern, confidence in CONSENT:
        value = F.struct(F.lit(name).alias("provider"), F.lit(confidence).alias("confidence"))
        out = F.when(h.rlike(pattern), value) if out is None else out.when(h.rlike(pattern), value)
    return out


def barrier(html: Column, elements: Column) -> Column:
    """struct(kind, confidence): cookie banner before popup before age gate before region block before login wall."""
    h = F.lower(html)
    value = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("double").alias("confidence"))
    cookie, pop, login = cookie_banner(html), popup(html), login_wall(html, elements)
    return (
        F.when(cookie.isNotNull(), value("cookie_consent", cookie["confidence"]))
        .when(pop.isNotNull(), value("popup_overlay", pop["confidence"]))
        .when(says(h, "age_verification"), value("age_verification", F.lit(0.80)))
        .when(says(h, "region_restricted"), value("region_restricted", F.lit(0.80)))
        .when(login.isNotNull(), value("login_required", login["confidence"]))
    )
