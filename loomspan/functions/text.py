"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan import fixed

#: Code point ranges of scripts, as regex class bodies, in order of preference at equal counts.
SCRIPTS = {
    "LATIN": r"A-Za-zÀ-ɏḀ-ỿ",
    "CJK": r"一-鿿㐀-䶿豈-﫿",
    "HANGUL": r"ᄀ-ᇿ㄰-㆏가-힯ힰ-퟿",
    "HIRAGANA": r"぀-ゟ",
    "KATAKANA": r"゠-ヿㇰ-ㇿ",
    "CYRILLIC": r"Ѐ-ӿԀ-ԯ",
    "ARABIC": r"؀-ۿݐ-ݿࢠ-ࣿ",
}
#: Scripts that one language writes side by side.
GROUPS = {s: ["CJK", "HIRAGANA", "KATAKANA"] if s in ("CJK", "HIRAGANA", "KATAKANA") else [s] for s in SCRIPTS}
LABELS = {"LATIN": "en", "HANGUL": "ko", "CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "CYRILLIC": "ru", "ARABIC": "ar"}
#: Characters counted as dense scripts by the budget and by the approximate counter.
DENSE = r"　-鿿가-힯豈-﫿！-｠"
#: Entities decoded without a UDF; the ampersand comes last, so nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&euro;": "€", "&amp;": "&"}


def count_of(text: Column, body: str) -> Column:
    """How many characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{body}]", ""))


def trim(text: Column) -> Column:
    """Without white space at both ends (not only spaces)."""
    return F.regexp_replace(text, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def normalise(text: Column) -> Column:
    return F.lower(F.regexp_replace(trim(text), r"[ \t\r\n\f\x0B]+", " "))


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def tokens(text: Column) -> Column:
    """Approximate token count: 4 characters each, 2 where the first 2,000 characters are all of a dense script."""
    sample = F.substring(text, 1, 2000)
    ratio = count_of(sample, DENSE) / F.nullif(F.length(sample), F.lit(0))
    return F.coalesce((F.length(text) / (4.0 - 2.0 * ratio)).cast("int"), F.lit(0))


def visible_sample(html: Column) -> Column:
    """First 2,000 characters of text of the first 30,000 characters of the body."""
    start = F.locate("<body", F.lower(html))
    part = F.substring(html, F.greatest(start, F.lit(1)), F.lit(30_000))
    return F.substring(trim(F.regexp_replace(F.regexp_replace(without_code(part, " "), r"<[^>]+>", " "), r"[ \t\r\n\f\x0B]+", " ")), 1, 2000)


def without_code(html: Column, by: str = "") -> Column:
    """Without scripts, styles and noscript, content included."""
    return F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", by)


def multiplier(locale: Column, html: Column) -> Column:
    """Budget factor: by locale, raised or lowered by the share of dense scripts in the visible text."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.LOCALE_MULTIPLIER.items() for x in kv])[locale], F.lit(1.0))
    sample = visible_sample(html)
    ratio = count_of(sample, DENSE) / F.nullif(F.length(sample), F.lit(0))
    refined = (
        F.when((base <= 1.0) & (ratio > 0.3), 1.0 + 0.8 * F.least(ratio / 0.7, F.lit(1.0)))
        .when((base > 1.0) & (ratio < 0.1), 1.0 + (base - 1.0) * (ratio / 0.1))
        .otherwise(base)
    )
    chosen = F.when(F.length(sample) >= 50, refined).otherwise(base)
    return F.greatest(F.lit(1.0), F.least(F.lit(fixed.MULTIPLIER_CEILING), chosen))


def lines(html: Column) -> Column:
    """Visible text lines in order: no code, tags as line breaks, entities decoded, trimmed, no empty ones."""
    text = unescape(F.regexp_replace(without_code(html), r"<[^>]+>", "\n"))
    # what stood in two elements doesn't run together where CJK meets a digit
    text = F.regexp_replace(text, r"([\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}])([0-9])", "$1 $2")
    text = F.regexp_replace(F.regexp_replace(text, " ", " "), r"[ \t]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def title(html: Column) -> Column:
    return trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


#: What a hostile text may not carry.
_CONTROL = r"[​-‏‪-‮⁠-⁩﻿￹-￻\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]"
_ROLES = r"(?i)\[?[ \t\r\n]*(?:SYSTEM|ASSISTANT|USER|HUMAN|AI|ADMIN|INSTRUCTION|OVERRIDE|IMPORTANT|IGNORE|HACK|COMMAND)[ \t\r\n]*[:\]][ \t\r\n]*"


def sanitize(text: Column, most: int = 256) -> Column:
    """A short field made safe to show to a model: no control characters, role prefixes, boundary tags or script links."""
    text = F.regexp_replace(unescape(text), " ", " ")
    text = F.regexp_replace(text, r"\x1b\[[0-9;]*[a-zA-Z]", "")
    text = F.translate(F.regexp_replace(text, _CONTROL, ""), "\n\r", "  ")
    text = F.regexp_replace(F.regexp_replace(text, _ROLES, ""), r"(?i)<[ \t]*/?[ \t]*web_content[a-z0-9_]*[^>]*>", "")
    text = F.regexp_replace(text, r"(?i)\[([^\]]*)\]\([ \t]*(javascript|vbscript|data|blob)[ \t]*:[^)]*\)", "[$1](blocked:$2)")
    text = F.regexp_replace(text, r"(?i)<[ \t]*(javascript|vbscript|data|blob)[ \t]*:[^>]*>", "[blocked link]")
    return F.substring(trim(F.regexp_replace(text, r"[ \t]{2,}", " ")), 1, most)


def script_counts(text: Column) -> Column:
    """Array of (count, -order, script), so that its maximum is the dominant script."""
    return F.array(*[F.struct(count_of(text, body).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("script")) for k, (name, body) in enumerate(SCRIPTS.items())])


def dominant_script(text: Column) -> Column:
    top = F.array_max(script_counts(text))
    return F.when(top["n"] > 0, top["script"]).otherwise(F.lit("COMMON"))


def foreign_ratio(text: Column, script: Column) -> Column:
    """Share of letters outside the script's group."""
    every = "".join(SCRIPTS.values())
    total = count_of(text, every)
    own = F.coalesce(*[F.when(script == s, count_of(text, "".join(SCRIPTS[g] for g in group))) for s, group in GROUPS.items()], F.lit(0))
    return F.when(total > 0, (total - own) / total).otherwise(F.lit(0.0))


def format_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1_000), F.lit("K"))).otherwise(n.cast("string"))


def result_count(text: Column) -> Column:
    """'1,234 results' -> 1234; null if there is none."""
    found = F.regexp_extract(text, r"(?i)([0-9][0-9,]*)[ \t]*(?:results|items|products)", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).try_cast("long")


def _hostile(text: Column) -> Column:
    """Without what may not be shown: terminal codes, control and invisible characters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(unescape(text), "\u00a0", " "), r"\x1b\[[0-9;]*[a-zA-Z]", ""), _CONTROL, "")


def sanitize_block(text: Column, most: int = 50_000) -> Column:
    """As sanitize, for a block: line feeds and spacing stay."""
    text = F.regexp_replace(F.regexp_replace(_hostile(text), _ROLES, ""), r"(?i)<[ \t]*/?[ \t]*web_content[a-z0-9_]*[^>]*>", "")
    text = F.regexp_replace(text, r"(?i)\[([^\]]*)\]\([ \t]*(javascript|vbscript|data|blob)[ \t]*:[^)]*\)", "[$1](blocked:$2)")
    text = F.regexp_replace(text, r"(?i)<[ \t]*(javascript|vbscript|data|blob)[ \t]*:[^>]*>", "[blocked link]")
    return F.substring(text, 1, most)


def boundary(text: Column, url: Column, nonce: Column, at: Column) -> Column:
    """The text between tags that its author can't know: nonce and time are given, so that reruns agree."""
    inner = F.regexp_replace(text, r"(?i)<[ \t]*/?[ \t]*web_content[a-z0-9_]*[^>]*>", "")
    source = F.replace(F.replace(F.replace(url, F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.concat(F.lit("web_content_"), nonce)
    return F.concat(F.lit("<"), tag, F.lit(' source="'), source, F.lit('" timestamp="'), at, F.lit('">\n'), inner, F.lit("\n</"), tag, F.lit(">"))


def _ratio(text: Column) -> Column:
    """Characters a token, by the share of dense scripts in the first 2,000."""
    sample = F.substring(text, 1, 2000)
    return 4.0 - 2.0 * F.coalesce(count_of(sample, DENSE) / F.nullif(F.length(sample), F.lit(0)), F.lit(0.0))


def truncate(text: Column, most: int) -> Column:
    """About the first ``most`` tokens."""
    return F.when(tokens(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.floor(most * _ratio(text)).cast("int")))


def head_tail(text: Column, most: int) -> Column:
    """About ``most`` tokens: four fifths from the head, the rest from the tail, with a mark between."""
    head = int(most * 0.8)
    part = lambda n: F.floor(n * _ratio(text)).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), part(head)), F.lit("\n<!-- ... truncated ... -->\n"), F.right(text, part(most - head)))
    return F.when(tokens(text) <= most, text).otherwise(cut)


def chars_per_token(lines: Column, least: int = 5, cut: int = 300) -> Column:
    """Measured on the first twenty lines of some length; 4 where there are none, 1.5 at least."""
    sample = F.array_join(F.slice(F.transform(F.filter(lines, lambda x: F.length(x) >= least), lambda x: F.substring(x, 1, cut)), 1, 20), "\n")
    return F.coalesce(F.greatest(F.length(sample) / F.nullif(tokens(sample), F.lit(0)), F.lit(1.5)), F.lit(4.0))


def content_hash(text: Column) -> Column:
    """32-bit hash of the first 2,000 characters: h * 31 + c (characters of the basic plane)."""
    chars = F.split(F.substring(text, 1, 2000), "")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % F.lit(1 << 32))
