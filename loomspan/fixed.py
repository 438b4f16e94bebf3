"""Fixed values that results depend on: domain tables, thresholds, weights and patterns, in order of precedence."""

from __future__ import annotations

# Host suffix -> currency. Exact domains come first, then endings; the first that fits holds.
CURRENCY_DOMAINS = """
coupang.com KRW; musinsa.com KRW; 29cm.co.kr KRW; ssfshop.com KRW; wconcept.co.kr KRW; thehandsome.com KRW; ssg.com KRW;
gmarket.co.kr KRW; auction.co.kr KRW; 11st.co.kr KRW; taobao.com CNY; tmall.com CNY; jd.com CNY; pinduoduo.com CNY;
suning.com CNY; amazon.in INR; flipkart.com INR; myntra.com INR; rakuten.co.jp JPY; mercadolibre.com.br BRL;
americanas.com.br BRL; magazineluiza.com.br BRL; hepsiburada.com TRY; trendyol.com TRY; lazada.sg SGD; shopee.sg SGD;
zalando.de EUR; zalando.fr EUR; asos.com GBP; farfetch.com USD; .co.kr KRW; .kr KRW; .co.jp JPY; .jp JPY; .co.uk GBP;
.uk GBP; .fr EUR; .de EUR; .es EUR; .it EUR; .nl EUR; .se SEK; .no NOK; .dk DKK; .ch CHF; .in INR; .com.cn CNY; .cn CNY;
.com.tw TWD; .tw TWD; .co.th THB; .th THB; .vn VND; .com.my MYR; .my MYR; .sg SGD; .ph PHP; .co.id IDR; .id IDR;
.com.br BRL; .br BRL; .com.mx MXN; .mx MXN; .com.ar ARS; .ar ARS; .com.au AUD; .au AUD; .co.nz NZD; .ca CAD;
.com.tr TRY; .tr TRY; .com USD
"""
# Host suffix -> locale, same order rule.
LOCALE_DOMAINS = """
coupang.com ko; musinsa.com ko; 29cm.co.kr ko; ssfshop.com ko; wconcept.co.kr ko; thehandsome.com ko; taobao.com zh;
tmall.com zh; jd.com zh; pinduoduo.com zh; xiaohongshu.com zh; douyin.com zh; bilibili.com zh; suning.com zh; .co.kr ko;
.kr ko; .co.jp ja; .jp ja; .fr fr; .de de; .co.uk en; .es es; .it it; .pt pt; .nl nl; .com.cn zh; .cn zh; .com en
"""
LOCALES = ["ja", "fr", "de", "en", "ko", "zh", "es", "it", "pt", "nl"]
DEFAULT_LOCALE = "en"
# Host suffix -> schema.
SCHEMA_DOMAINS = """
coupang.com Product; musinsa.com Product; 29cm.co.kr Product; kurly.com Product; wconcept.co.kr Product; ssfshop.com Product;
thehandsome.com Product; zara.com Product; cos.com Product; hm.com Product; uniqlo.com Product; nike.com Product;
amazon.com Product; news.naver.com NewsArticle; bbc.com NewsArticle; wikipedia.org WikiArticle; youtube.com VideoObject;
youtu.be VideoObject; vimeo.com VideoObject; github.com SaaSPage; gov.kr GovernmentPage
"""
# Locale -> header.
ACCEPT_LANGUAGE = {
    "ko": "ko-KR,ko;q=0.9,en;q=0.8",
    "en": "en-US,en;q=0.9",
    "ja": "ja-JP,ja;q=0.9,en;q=0.8",
    "fr": "fr-FR,fr;q=0.9,en;q=0.8",
    "de": "de-DE,de;q=0.9,en;q=0.8",
    "zh": "zh-CN,zh;q=0.9,en;q=0.8",
    "es": "es-ES,es;q=0.9,en;q=0.8",
    "it": "it-IT,it;q=0.9,en;q=0.8",
    "pt": "pt-BR,pt;q=0.9,en;q=0.8",
    "nl": "nl-NL,nl;q=0.9,en;q=0.8",
}
# Hosts never visited.
METADATA_HOSTS = ["metadata.google.internal", "metadata.goog", "169.254.169.254", "100.100.100.200", "169.254.170.2"]
BLOCKED_HOSTS = ["localhost", *METADATA_HOSTS]
# First and last address of private and reserved IPv4 networks.
PRIVATE_RANGES = [
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("0.0.0.0", "0.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
]
# Limits and budgets.
MAX_HTML_BYTES = 8 * 1024 * 1024
MAX_DOM_NODES = 50_000
PRUNED_TOKENS, TOTAL_TOKENS = 1500, 5000
MAX_URL = 2048
LOCALE_MULTIPLIER = {"ko": 1.8, "zh": 1.6, "ja": 1.5}
MULTIPLIER_CEILING = 2.5
# Page types in order of priority, their thresholds, and the weight of JSON-LD.
TYPE_PRIORITY = ["product_detail", "checkout", "login", "settings", "search_results", "video", "news", "article", "help_faq", "form", "documentation", "dashboard", "listing", "error", "blocked", "landing"]
THRESHOLD = {t: 25 if t in ("error", "landing") else 20 for t in TYPE_PRIORITY}
JSONLD_WEIGHT = {"product_detail": 40, "listing": 40, "news": 40, "article": 40, "help_faq": 40, "form": 35, "checkout": 40, "video": 40, "landing": 35}
DOM_CAP = 40
# Cart terms.
CART_TERMS = ["add to cart", "add to bag", "add to basket", "buy now", "장바구니", "카트에 담기", "구매하기", "바로구매", "カートに入れる", "今すぐ買う", "ajouter au panier", "in den warenkorb", "加入购物车", "立即购买", "añadir al carrito", "comprar ahora"]
# Bot-protection providers in order, with pattern and confidence.
ANTIBOT = [
    ("turnstile", r"cf-turnstile|challenges\.cloudflare\.com/turnstile", 0.95),
    ("recaptcha", r"g-recaptcha|google\.com/recaptcha|grecaptcha", 0.95),
    ("hcaptcha", r"h-captcha|hcaptcha\.com|data-hcaptcha", 0.95),
    ("cloudflare", r"cf-browser-verification|just[ \t\r\n]+a[ \t\r\n]+moment|__cf_chl", 0.90),
    ("akamai", r"akamai.*bot.*manager|_abck|sensor_data", 0.85),
    ("generic", r"captcha|challenge-platform", 0.70),
]
# Popup patterns.
POPUP = r"(?:class|id|aria-label)=[\"'][^\"']*(?:newsletter[-_]?(?:popup|modal|overlay|signup)|app[-_]?(?:banner|download|promo)|promo[-_]?(?:popup|modal|overlay|banner)|exit[-_]?intent|subscribe[-_]?(?:popup|modal|overlay)|popup[-_]?(?:overlay|modal|banner|container)|modal[-_]?(?:overlay|popup|newsletter))[^\"']*[\"']"
POPUP_NOT = r"quick[-_ ]?view|product[-_ ]?modal|size[-_ ]?guide|cart[-_ ]?drawer|mini[-_ ]?cart|accessibility[-_ ]?dialog|cookie|login|sign[-_ ]?in|age[-_ ]?verif|age[-_ ]?gate|consent"
POPUP_PROMO = r"newsletter|subscribe|sign[-_]?up|email[-_]?list|promo(?:tion)?|discount|coupon|offer|deal|popup|exit[-_]?intent|app[-_]?banner|download[-_]?app|install[-_]?app|notification|alert|뉴스레터|구독|이메일|할인|쿠폰"


def pairs(text: str) -> list[tuple[str, str]]:
    """'key value; key value' as a list, in order."""
    return [tuple(x.split()) for x in text.replace("\n", " ").split(";") if x.strip()]


def by_host(text: str) -> list[tuple[str, str]]:
    """Domain rules in the order they are tried: exact domains, then endings."""
    rules = pairs(text)
    return [r for r in rules if not r[0].startswith(".")] + [r for r in rules if r[0].startswith(".")]
