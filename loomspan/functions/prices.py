"""Prices as people write them: currency with confidence, numbers of any convention, ranges, from-prices and second currencies.

All of it is one expression a row: no UDF. Digits of other scripts are mapped one by one (ASCII, full-width, Arabic and Persian);
other compatibility forms are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan import terms
from loomspan.functions import urls
from loomspan.functions.text import trim

# How a currency is recognised, in order.
MULTI = (("R$", "BRL"), ("S$", "SGD"), ("HK$", "HKD"), ("A$", "AUD"), ("C$", "CAD"), ("NZ$", "NZD"), ("NT$", "TWD"), ("RM", "MYR"), ("MX$", "MXN"))
SINGLE = (("₩", "KRW"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("₺", "TRY"), ("₫", "VND"), ("₱", "PHP"), ("฿", "THB"))
SUFFIX = (("원", "KRW"), ("円", "JPY"), ("元", "CNY"), ("人民币", "CNY"))
ISO = tuple("USD EUR GBP JPY KRW CNY RMB CHF SEK NOK DKK AUD CAD NZD INR BRL TRY TWD THB VND MYR SGD PHP IDR MXN ARS HKD PLN CZK HUF ZAR SAR AED".split())
AMBIGUOUS = (
    ("$", (), ((".com.au", "AUD"), (".au", "AUD"), (".ca", "CAD"), (".co.nz", "NZD"), (".sg", "SGD"), (".com.mx", "MXN"), (".mx", "MXN"), (".com.ar", "ARS"), (".ar", "ARS")), "USD"),
    ("¥", (("taobao.com", "CNY"), ("tmall.com", "CNY"), ("jd.com", "CNY")), ((".co.jp", "JPY"), (".jp", "JPY"), (".com.cn", "CNY"), (".cn", "CNY")), "JPY"),
    ("kr", (), ((".se", "SEK"), (".no", "NOK"), (".dk", "DKK")), "SEK"),
)
CONFIDENCE = {"sign": 0.95, "suffix": 0.90, "iso": 0.90, "domain": 0.85, "ending": 0.80, "default": 0.60, "url": 0.40, "none": 0.20}
WHOLE_ONLY = ("KRW", "JPY", "VND", "IDR")
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９٫．，", "012345678901234567890123456789..,")
MARKS = r"[\x{200e}\x{200f}\x{61c}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
RANGE = r"(?s)^(.*?)\s*(?:~|–|—|\s-\s|\sto\s|\sbis\s|\sà\s)\s*(.*)$"
ISO_PATTERN = rf"(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(ISO)})(?:$|[^\p{{L}}\p{{N}}_])"


def _from_pattern() -> str:
    """Longer terms first; short ones that aren't CJK only as whole words."""
    cjk = lambda t: any("　" <= ch <= "鿿" or "가" <= ch <= "힯" for ch in t)
    some = [terms.any_of((t,)) if cjk(t) or len(t) > 4 else rf"\b{terms.any_of((t,))}\b" for t in sorted(terms.FROM_PRICE, key=len, reverse=True)]
    return rf"(?is)^(.*?)(?:{'|'.join(some)})(.*)$"


FROM = _from_pattern()
SECOND = r"\s*\((?:약|≈|~)?\s*"


def _pick(code: str | Column, kind: str) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(CONFIDENCE[kind]).alias("confidence"))


def let(value: Column, body) -> Column:
    """body(value), with the value made once a row: an expression in several places is repeated in full at each."""
    return F.transform(F.array(value), body)[0]


def currency(text: Column, url: Column) -> Column:
    """struct(code, confidence): by sign, suffix, code, a sign that the host decides, the host alone, or US dollars."""
    return let(F.coalesce(urls.host(url), F.lit("")), lambda host: _currency(text, url, host))


def _currency(text: Column, url: Column, host: Column) -> Column:
    out = F.when(F.lit(False), _pick("USD", "none"))
    for kind, table in (("sign", MULTI + SINGLE), ("suffix", SUFFIX)):
        for sign, code in table:
            out = out.when(text.contains(sign), _pick(code, kind))
    iso = F.regexp_extract(text, ISO_PATTERN, 1)
    out = out.when(iso != "", _pick(F.when(iso == "RMB", F.lit("CNY")).otherwise(iso), "iso"))
    for sign, domains, endings, default in AMBIGUOUS:
        for domain, code in domains:
            out = out.when(text.contains(sign) & ((host == domain) | host.endswith("." + domain)), _pick(code, "domain"))
        for ending, code in endings:
            out = out.when(text.contains(sign) & host.endswith(ending), _pick(code, "ending"))
        out = out.when(text.contains(sign), _pick(default, "default"))
    return out.when(F.coalesce(url, F.lit("")) != "", _pick(urls.currency_of(host), "url")).otherwise(_pick("USD", "none"))


def number(text: Column, code: Column) -> Column:
    """Amount in either convention: of two kinds of separators the last one is decimal; one alone is decimal where at most two digits follow
    it and the currency has parts, else it groups (a single point only before three digits)."""
    return let(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), *DIGITS), r"[^0-9,.]", ""), lambda t: _number(t, code))


def _number(t: Column, code: Column) -> Column:
    without = lambda sign: F.replace(t, F.lit(sign), F.lit(""))
    comma, dot = t.contains(","), t.contains(".")
    after = lambda sign: F.length(F.substring_index(t, sign, -1))
    count = lambda sign: F.length(t) - F.length(without(sign))
    parts = ~code.isin(*WHOLE_ONLY)
    plain = (
        F.when(comma & dot & (after(",") < after(".")), F.replace(without("."), F.lit(","), F.lit(".")))
        .when(comma & dot, without(","))
        .when(comma & (count(",") == 1) & (after(",") <= 2) & parts, F.replace(t, F.lit(","), F.lit(".")))
        .when(comma, without(","))
        .when(dot & (count(".") > 1), without("."))
        .when(dot & (after(".") == 3), without("."))
        .otherwise(t)
    )
    return plain.try_cast("double")


SCHEMA = "array<struct<amount:double,currency:string,confidence:double,price_type:string>>"


def _price(amount: Column, code: Column, confidence: Column, kind: Column | str) -> Column:
    return F.struct(amount.alias("amount"), code.alias("currency"), confidence.cast("double").alias("confidence"), (F.lit(kind) if isinstance(kind, str) else kind).alias("price_type"))


def parse(text: Column, url: Column, hint: Column | None = None) -> Column:
    """struct(prices, is_range, is_cross_listed): free, unavailable, a range, prices in two currencies, a from-price or one price.

    Null and blank texts, and texts without a number, have no prices. ``hint`` is a currency that outranks what the text says.
    """
    hinted = hint if hint is not None else F.lit(None).cast("string")
    result = lambda prices, is_range=False, cross=False: F.struct(prices.cast(SCHEMA).alias("prices"), F.lit(is_range).alias("is_range"), F.lit(cross).alias("is_cross_listed"))
    zero = lambda confidence, kind: result(F.array(_price(F.lit(0.0), F.coalesce(hinted, F.lit("USD")), F.lit(confidence), kind)))
    none = result(F.array())

    def of(t: Column, host: Column) -> Column:
        low = F.lower(t)
        says = lambda words: low.rlike(terms.any_of(tuple(w.lower() for w in words)))

        def read(texts: Column) -> Column:
            """struct(code, own, sure, amount) of each text; the first one's currency may be hinted."""
            made = lambda x, c, own: F.struct(c["code"].alias("code"), own.alias("own"), c["confidence"].alias("sure"), number(x, own).alias("amount"))
            own = lambda i, c: F.coalesce(F.when(i == 0, hinted), c["code"])
            return F.transform(texts, lambda x, i: let(_currency(x, url, host), lambda c: let(own(i, c), lambda code: made(x, c, code))))

        def offered(work: Column, kind: Column) -> Column:
            pieces = F.filter(F.transform(F.split(work, SECOND), lambda p: trim(F.regexp_replace(p, r"\)+$", ""))), lambda p: p != "")
            priced = lambda some: F.filter(F.transform(read(some), lambda r: _price(r["amount"], r["own"], F.round(r["sure"] * 0.9, 4), kind)), lambda x: x["amount"].isNotNull())
            single = let(read(F.array(work))[0], lambda r: F.when(r["amount"].isNotNull(), result(F.array(_price(r["amount"], r["own"], r["sure"], kind)))).otherwise(none))
            several = let(pieces, lambda some: F.when(F.size(some) >= 2, priced(some)))
            return let(several, lambda some: F.when(F.size(some) >= 2, result(some, cross=True)).otherwise(single))

        # a range: the low end's currency may be hinted, the high end keeps its own where the two differ
        ends = let(F.array(trim(F.regexp_extract(t, RANGE, 1)), trim(F.regexp_extract(t, RANGE, 2))), lambda e: F.when((e[0] != "") & (e[1] != ""), read(e)))
        high_code = lambda e: F.when(e[1]["code"] != e[0]["code"], e[1]["code"]).otherwise(e[0]["own"])
        ranged = lambda e: result(F.array(_price(e[0]["amount"], e[0]["own"], e[0]["sure"], "range_low"), _price(e[1]["amount"], high_code(e), e[1]["sure"], "range_high")), is_range=True)
        # what a from-price is about stands after the word, or before it
        behind, before = trim(F.regexp_extract(t, FROM, 2)), trim(F.regexp_extract(t, FROM, 1))
        work = lambda is_from: F.when(is_from, let(behind, lambda b: F.when(b != "", b).otherwise(before))).otherwise(t)
        other = let(low.rlike(FROM), lambda is_from: let(work(is_from), lambda w: offered(w, F.when(is_from, F.lit("from")).otherwise(F.lit("exact")))))
        return (
            F.when(t == "", none)
            .when(says(terms.FREE_PRICE), zero(0.90, "free"))
            .when(says(terms.UNAVAILABLE_PRICE), zero(0.85, "unavailable"))
            .otherwise(let(ends, lambda e: F.when(e[0]["amount"].isNotNull() & e[1]["amount"].isNotNull(), ranged(e)).otherwise(other)))
        )

    clean = trim(F.regexp_replace(F.coalesce(text, F.lit("")), MARKS, ""))
    return let(clean, lambda t: let(F.coalesce(urls.host(url), F.lit("")), lambda host: of(t, host)))
