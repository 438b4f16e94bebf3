"""URL functions as columns: all row-wise, inside code generation, no UDF and no join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan import fixed


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user info and port; empty if there is none."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_rule(name: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Value of the first rule that fits the host: 'x.com' fits itself and its subdomains, '.tld' any host ending so."""
    fits = lambda d: name.endswith(d) if d.startswith(".") else (name == d) | name.endswith("." + d)
    return F.coalesce(*[F.when(fits(d), F.lit(v)) for d, v in rules], default if default is not None else F.lit(None).cast("string"))


def site_id(url: Column) -> Column:
    """Second-to-last host label; a host without dots stands for itself, no host for 'unknown'."""
    name = F.when(host(url) == "", F.lit("unknown")).otherwise(host(url))
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(name)


def template_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def locale(url: Column) -> Column:
    """First two path segments, first host label, domain table, default."""
    segments = F.slice(F.filter(F.split(F.lower(path(url)), "/"), lambda p: p != ""), 1, 2)
    known = F.element_at(F.concat(F.filter(segments, lambda p: p.isin(fixed.LOCALES)), F.array(F.lit(None).cast("string"))), 1)
    label = F.substring_index(host(url), ".", 1)
    return F.coalesce(known, F.when(label.isin(fixed.LOCALES), label), host_rule(host(url), fixed.by_host(fixed.LOCALE_DOMAINS)), F.lit(fixed.DEFAULT_LOCALE))


def accept_language(url: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.ACCEPT_LANGUAGE.items() for x in kv])
    return F.coalesce(table[locale(url)], F.lit(fixed.ACCEPT_LANGUAGE["en"]))


def currency(url: Column) -> Column:
    return currency_of(host(url))


def currency_of(name: Column) -> Column:
    return host_rule(name, fixed.by_host(fixed.CURRENCY_DOMAINS), F.lit("USD"))


def schema(url: Column) -> Column:
    """Schema by domain, then government endings, else Generic."""
    government = F.lower(url).rlike(r"\.go(?:v)?(?:\.[a-z]{2})?(?:/|$)")
    return F.coalesce(host_rule(host(url), fixed.pairs(fixed.SCHEMA_DOMAINS)), F.when(government, F.lit("GovernmentPage")), F.lit("Generic"))


def is_root(url: Column) -> Column:
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return (trimmed == "") | trimmed.startswith("/index")


def normal_form(url: Column) -> Column:
    """Cache key: scheme and authority in lower case, sorted query, no fragment; the path keeps its case.

    Query pairs without '=' get an empty value. Percent-encoded pairs are kept as written.
    """
    with_value = F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    ordered = F.array_sort(F.transform(with_value, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p"))))
    joined = F.concat_ws("&", F.transform(ordered, lambda s: s["p"]))
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), path(url), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


#: Query parameters that hold a search, in order.
SEARCH_PARAMS = ["q", "query", "search", "keyword", "s", "k", "searchTerm", "searchWord"]


def search_query(url: Column) -> Column:
    """Value of the first search parameter present, plus signs as spaces; null if none."""
    found = [F.regexp_extract(query(url), rf"(?:^|&){p}=([^&]+)", 1) for p in SEARCH_PARAMS]
    return F.regexp_replace(F.coalesce(*[F.when(f != "", f) for f in found]), r"\+", " ")


def ip_number(name: Column) -> Column:
    """A host that is an IPv4 address in dotted, decimal, hex or octal form, as a number; else null."""
    part = lambda k: F.split(name, r"\.").getItem(k)
    octet = lambda k: F.when(part(k).rlike("^0[0-7]+$"), F.conv(part(k), 8, 10).cast("long")).when(part(k).rlike("^(0|[1-9][0-9]*)$"), part(k).try_cast("long"))
    dotted = reduce(lambda a, b: a * 256 + b, [F.when(octet(k) <= 255, octet(k)) for k in range(4)])
    single = F.when(name.rlike("^[0-9]+$"), name.try_cast("long")).when(name.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(name, 3, 20), 16, 10).cast("long"))
    return F.when(name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), dotted).otherwise(F.when(single <= 0xFFFFFFFF, single))


def number_of(ip: str) -> int:
    return reduce(lambda a, b: a * 256 + int(b), ip.split("."), 0)


def risk(url: Column) -> Column:
    """Why a URL may not be visited: scheme, no_host, metadata, blocked_host, private_ip; null if it may."""
    name, ip = host(url), ip_number(host(url))
    inside = lambda lo, hi: ip.between(number_of(lo), number_of(hi))
    return (
        F.when(~scheme(url).isin("http", "https"), F.lit("scheme"))
        .when(name == "", F.lit("no_host"))
        .when(name.isin(fixed.METADATA_HOSTS), F.lit("metadata"))
        .when(name.isin(fixed.BLOCKED_HOSTS), F.lit("blocked_host"))
        .when(inside("169.254.0.0", "169.254.255.255"), F.lit("metadata"))
        .when(reduce(lambda a, b: a | b, [inside(lo, hi) for lo, hi in fixed.PRIVATE_RANGES]), F.lit("private_ip"))
        .when(name.isin("[::1]") | name.rlike(r"^\[(f[cd]|fe[89ab]|::ffff:)"), F.lit("private_ip"))
    )


def valid(url: Column) -> Column:
    """http(s) or protocol-relative and of allowed length."""
    return (F.length(url) <= fixed.MAX_URL) & (url.startswith("http://") | url.startswith("https://") | url.startswith("//"))
