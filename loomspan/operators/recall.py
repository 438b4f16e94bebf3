"""Whether expected values survived in a text, by what kind of value they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import money, text, urls

# Shares of words and list items that are enough.
WORDS, ITEMS = 0.4, 0.5


def numeric(value: Column, page: Column) -> Column:
    """Plain, grouped, as written, or shortened ('66.0k', '66k', '1.2m')."""
    n = money.numeric(value)
    whole = n == F.floor(n)
    forms = [F.when(whole, F.floor(n).cast("string")).otherwise(n.cast("string")), F.when(whole, F.format_number(n, 0)), text.trim(value)]
    hit = F.lit(False)
    for f in forms:
        hit = hit | F.coalesce(page.contains(f), F.lit(False))
    for least, unit, mark in ((1_000_000, 1_000_000, "m"), (1_000, 1_000, "k")):
        part = F.floor(n) / unit
        short = F.lower(page).contains(F.concat(F.format_string("%.1f", part), F.lit(mark))) | ((part == F.floor(part)) & F.lower(page).contains(F.concat(F.floor(part).cast("string"), F.lit(mark))))
        in_range = (n >= least) & ((n < 1_000_000) if mark == "k" else F.lit(True))
        hit = hit | (in_range & short)
    return F.coalesce(n.isNotNull() & hit, F.lit(False))


def words(value: Column, page: Column) -> Column:
    """The whole value, or two fifths of its words of three letters or more."""
    v, p = text.normalise(value), text.normalise(page)
    some = F.filter(F.split(v, " "), lambda w: F.length(w) > 2)
    found = F.size(F.filter(some, lambda w: p.contains(w)))
    return F.coalesce((v != "") & (p.contains(v) | ((F.size(some) > 0) & (found >= F.size(some) * WORDS))), F.lit(False))


def address(value: Column, page: Column) -> Column:
    """The URL, or its path where that is long enough to tell."""
    v = text.trim(value)
    path = urls.path(v)
    return F.coalesce(page.contains(v) | ((F.length(path) > 10) & page.contains(path)), F.lit(False))


def day(value: Column, page: Column) -> Column:
    """The date in any of the usual ways of writing it."""
    iso = money.date(value)
    parts = F.split(iso, "-")
    y, m, d = (F.get(parts, F.lit(k)) for k in range(3))
    mi, di = m.try_cast("int").cast("string"), d.try_cast("int").cast("string")
    forms = [iso, F.concat_ws(".", y, m, d), F.concat_ws(".", y, mi, di), F.concat_ws("/", y, m, d), F.concat_ws("/", y, mi, di), F.concat(y, F.lit("년 "), mi, F.lit("월 "), di, F.lit("일")), F.concat(y, F.lit("년"), mi, F.lit("월"), di, F.lit("일")), text.trim(value)]
    hit = F.lit(False)
    for f in forms:
        hit = hit | F.coalesce(page.contains(f), F.lit(False))
    return F.when(F.size(parts) == 3, hit).otherwise(F.coalesce(page.contains(iso), F.lit(False)))


def items(value: Column, page: Column) -> Column:
    """Half of a list's items; an empty list is always there."""
    p = text.normalise(page)
    return F.coalesce(F.size(F.filter(value, lambda x: p.contains(text.normalise(x)))) >= F.size(value) * ITEMS, F.lit(False))


def exact(value: Column, page: Column) -> Column:
    """The value, or one of its words of three letters or more."""
    v, p = text.normalise(value), text.normalise(page)
    return F.coalesce(p.contains(v) | F.exists(F.split(v, " "), lambda w: (F.length(w) > 2) & p.contains(w)), F.lit(False))
