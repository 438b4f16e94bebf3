"""Numbers, prices and dates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import trim

#: Price templates by currency; {i} whole amount, {d} amount with two decimals, both grouped.
TEMPLATES = {
    "KRW": "{i}원", "JPY": "{i}円", "VND": "{i}₫", "IDR": "{i} IDR", "USD": "${d}", "EUR": "€{d}", "GBP": "£{d}", "CHF": "CHF {d}",
    "SEK": "{d} kr", "NOK": "{d} kr", "DKK": "{d} kr", "AUD": "${d} AUD", "CAD": "${d} CAD", "NZD": "${d} NZD", "BRL": "R${d}", "TRY": "₺{d}",
    "CNY": "¥{d}", "TWD": "NT${i}", "THB": "฿{d}", "MYR": "RM{d}", "SGD": "S${d}", "PHP": "₱{d}", "MXN": "MX${d}",
}
#: Signs that name one currency, multi-character ones first, with their confidence.
SIGNS = [("R$", "BRL"), ("NT$", "TWD"), ("HK$", "HKD"), ("MX$", "MXN"), ("S$", "SGD"), ("A$", "AUD"), ("C$", "CAD"), ("₩", "KRW"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("₺", "TRY"), ("฿", "THB"), ("₫", "VND"), ("₱", "PHP"), ("円", "JPY"), ("元", "CNY"), ("원", "KRW")]


def numeric(text: Column) -> Column:
    """Number without currency signs and grouping commas; null if what is left is no number."""
    return trim(F.regexp_replace(text, r"[₩$¥€£원円元,]", "")).try_cast("double")


def date(text: Column) -> Column:
    """ISO, Korean, Japanese and dotted dates at the start of a text as ISO; other texts unchanged, the empty one null."""
    t = trim(text)
    pattern = r"^([0-9]{4})(?:-|\.|年|년[ \t]*)([0-9]{1,2})(?:-|\.|月[ \t]*|월[ \t]*)([0-9]{1,2})"
    part = lambda k: F.regexp_extract(t, pattern, k)
    return F.when(t == "", None).when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise(t)


def to_float(text: Column) -> Column:
    """Number with either separator convention: with both signs the last one is decimal; commas alone group; one
    point before exactly three digits, or several points, group too."""
    t = trim(text)
    both = t.contains(".") & t.contains(",")
    comma_last = F.length(t) - F.locate(",", F.reverse(t)) > F.length(t) - F.locate(".", F.reverse(t))
    parts = F.split(F.regexp_replace(t, "^-+", ""), r"\.")
    groups = (F.size(parts) > 2) | ((F.size(parts) == 2) & (F.length(F.element_at(parts, -1)) == 3))
    no = lambda x, sign: F.replace(x, F.lit(sign), F.lit(""))
    plain = (
        F.when(both & comma_last, F.replace(no(t, "."), F.lit(","), F.lit(".")))
        .when(t.contains(","), no(t, ","))
        .when(t.contains(".") & groups, no(t, "."))
        .otherwise(t)
    )
    return plain.try_cast("double")


def to_int(text: Column) -> Column:
    return F.bround(to_float(text)).cast("long")


def _rupees(amount: Column) -> Column:
    """Indian grouping: the last three digits, then pairs."""
    text = F.format_string("%.2f", F.abs(amount))
    whole, cents = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    tail = F.right(whole, F.lit(3))
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    # pairs counted from the right: reverse, comma after each two, reverse
    paired = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(head), "([0-9]{2})", "$1,")), "^,", "")
    grouped = F.when(F.length(whole) > 3, F.concat(paired, F.lit(","), tail)).otherwise(whole)
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), grouped, F.lit("."), cents)


def price(amount: Column, currency: Column) -> Column:
    whole = F.format_number(amount.cast("long").cast("double"), 0)
    cents = F.format_number(amount.cast("double"), 2)
    out = F.when(currency == "INR", _rupees(amount))
    for code, template in TEMPLATES.items():
        before, after = template.split("{i}" if "{i}" in template else "{d}")
        out = out.when(currency == code, F.concat(F.lit(before), whole if "{i}" in template else cents, F.lit(after)))
    return out.otherwise(F.format_number(F.bround(amount.cast("double")), 0))


def currency_of(text: Column) -> Column:
    """Currency named by a sign in the text, else by its ISO code; null if neither."""
    signs = [F.when(text.contains(sign), F.lit(code)) for sign, code in SIGNS]
    code = F.nullif(F.regexp_extract(F.upper(text), r"(?:^|[^A-Z])(USD|EUR|GBP|KRW|JPY|CNY|INR|BRL|TRY|SGD|CHF|AUD|CAD|MXN|SEK|NOK|DKK)(?:[^A-Z]|$)", 1), F.lit(""))
    return F.coalesce(*signs, code)


def discount(now: Column, before: Column) -> Column:
    """Percent off, rounded half to even; null unless the price fell."""
    return F.when((before > 0) & (now < before), F.bround((1 - now / before) * 100).cast("int"))
