"""Format-preserving Feistel pseudonyms for personal data.

Values are found by pattern and validated (card: Luhn; IBAN: mod 97; SSN: assigned ranges; IP: octets; date: calendar).
Where a card or IBAN runs on into other groups, its shorter forms are tried, and after a failure the search goes on at the next place.
Each is read as one integer of the domain of its format, permuted there by a keyed Feistel network and
written back in the same format: a card stays a Luhn-valid card of the same grouping, a date a date written the same
way. A permutation is injective, so equal values get equal pseudonyms in every document and different values never meet;
the key holder can invert it. Row by row, no shuffle, no state: a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import text_of
from loomspan.llm.packed import texts_of

ROUNDS = 8
#: Only a default for tests and benchmarks; give a secret of your own.
KEY = b"loomspan-demo-key"
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of [0, size): balanced Feistel rounds on the next even number of bits, walking
    the cycle until the value falls into the domain."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mix(r: int, v: int) -> int:
        seed = hmac.new(key, f"{tweak}|{size}|{r}|".encode() + v.to_bytes(width, "big"), hashlib.sha256).digest()
        while len(seed) < width:
            seed += hashlib.sha256(seed).digest()
        return int.from_bytes(seed[:width], "big") & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ mix(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ mix(r, b)
        x = a << half | b
        if x < size:
            return x


#: Character classes that are permuted within themselves; any other character stays.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _chars(text: str, key: bytes, tweak: str, back: bool, classes: tuple[str, ...] = _CLASSES) -> str:
    """Permute a string as one mixed-radix number, each character within its class."""
    alphabets = [next((c for c in classes if ch in c), "") for ch in text]
    x, size = 0, 1
    for ch, c in zip(text, alphabets, strict=True):
        if c:
            x, size = x * len(c) + c.index(ch), size * len(c)
    shape = "".join(str(classes.index(c)) if c else "-" for c in alphabets)
    x = permute(x, size, key, f"{tweak}|{shape}", back)
    out = []
    for ch, c in zip(reversed(text), reversed(alphabets), strict=True):
        if c:
            x, k = divmod(x, len(c))
            ch = c[k]
        out.append(ch)
    return "".join(reversed(out))


def _refill(pattern: str, digits: str) -> str:
    """Put digits into the digit places of a written value."""
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in pattern)


def _digits(s: str) -> str:
    return "".join(ch for ch in s if ch.isdigit())


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(ch), 10)) if k % 2 == 0 else int(ch) for k, ch in enumerate(reversed(body)))
    return str(-total % 10)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = _chars(d[:-1], key, "card", back)
    return _refill(s, body + luhn_digit(body))


def _iban_number(s: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in s))


def _iban(s: str, key: bytes, back: bool) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _chars(flat[4:], key, "iban" + flat[:2], back)
    made = flat[:2] + f"{98 - _iban_number(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(made)
    return "".join(ch if ch == " " else next(it) for ch in s)


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    a, b, c = int(s[:3]), int(s[4:6]), int(s[7:])
    if not (0 < a < 900 and a != 666 and b and c):
        return None
    x = permute(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "ssn", back)
    x, c = divmod(x, 9999)
    a, b = divmod(x, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}{s[3]}{b + 1:02d}{s[6]}{c + 1:04d}"


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in s.split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if not 8 <= len(d) <= 15:
        return None
    country = len(re.match(r"\+?(\d{0,3})", s)[1]) if s[0] == "+" else int(re.match(r"1\D|0\d\D", s) is not None)
    return _refill(s, d[:country] + _chars(d[country:], key, f"phone{d[:country]}", back))


def _date(order: str) -> Callable[[str, bytes, bool], str | None]:
    """order: which of year, month and day stand where, such as 'ymd'."""

    def run(s: str, key: bytes, back: bool) -> str | None:
        parts = re.split(r"([-/.])", s)
        got = dict(zip(order, parts[::2], strict=True))
        try:
            day = date(int(got["y"]), int(got["m"]), int(got["d"])).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST or parts[1] != parts[3]:
            return None
        new = date.fromordinal(permute(day - _FIRST, _LAST - _FIRST + 1, key, "date", back) + _FIRST)
        put = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return parts[1].join(put[c] for c in order)

    return run


def _day_first(s: str, key: bytes, back: bool) -> str | None:
    """Day before month where that is a date, else month first: days above 12, permuted among themselves so that the result
    is no day-first date either."""
    made = _date("dmy")(s, key, back)
    if made is None:
        made = _date("mdy")(s, key, back)
        while made and int(made[3:5]) <= 12:
            made = _date("mdy")(made, key, back)
    return made


def _email(s: str, key: bytes, back: bool) -> str | None:
    name, _, host = s.partition("@")
    first, *rest = host.rsplit(".", 2) if host.count(".") > 1 else host.split(".")
    return f"{_chars(name, key, 'email', back)}@{'.'.join([first, *rest])}"


def _secret(s: str, key: bytes, back: bool) -> str | None:
    return _chars(s, key, "secret", back, ("0123456789abcdef",) if s == s.lower() else ("0123456789ABCDEF",)) if len(set(s)) > 4 else None


#: Length of an IBAN by country.
_IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22
GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31
MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24
XK20 YE30""".split()}


def _group_ends(text: str, start: int, end: int, least: int, more: re.Pattern) -> list[tuple[int, int]]:
    """(characters, end) of the prefixes of a match that end with a group and have ``least`` characters, longest first."""
    made, n = [], 0
    for i in range(start, end):
        n += text[i].isalnum()
        if text[i].isalnum() and n >= least and not more.match(text, i + 1):
            made.append((n, i + 1))
    return made[::-1]


_MORE_DIGITS, _MORE_LETTERS = re.compile(r"\d|\.\d"), re.compile(r"[0-9A-Za-z]")


def _card_ends(text: str, start: int, end: int) -> list[int]:
    return [e for _, e in _group_ends(text, start, end, 13, _MORE_DIGITS)]


def _iban_ends(text: str, start: int, end: int) -> list[int]:
    """The country's length first, then the longest."""
    length = _IBAN_LENGTHS.get(text[start : start + 2])
    return [e for _, e in sorted(_group_ends(text, start, end, 15, _MORE_LETTERS), key=lambda x: x[0] != length)]


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    rewrite: Callable[[str, bytes, bool], str | None]
    #: where the value may end, best first; only at the end of the match if not given
    ends: Callable[[str, int, int], list[int]] | None = None


#: In order of priority; a place taken by one kind is not read as another.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}(?<![.-])"), _email),
    Kind("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"), _secret),
    Kind("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}"), _iban, _iban_ends),
    Kind("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), _ip),
    Kind("date", re.compile(r"(?<![\d./-])\d{4}([-/.])\d{2}\1\d{2}(?![\d]|[./-]\d)"), _date("ymd")),
    Kind("date", re.compile(r"(?<![\d./-])\d{2}([-/.])\d{2}\1\d{4}(?![\d]|[./-]\d)"), _day_first),
    Kind("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"), _ssn),
    # cards as they are grouped on the plastic, then any grouping
    Kind("card", re.compile(r"(?<![\d.-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5})(?!\d)"), _card, _card_ends),
    Kind("card", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}"), _card, _card_ends),
    Kind("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.+-])\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.+-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.+-])0\d(?:[ .-]\d{2}){4}(?![\d-])"), _phone),
)
_ANY = re.compile(r"[0-9@]|[a-fA-F]{32}")


@lru_cache(maxsize=100_000)
def _written(k: int, value: str, key: bytes, back: bool) -> str | None:
    return KINDS[k].rewrite(value, key, back)


def pseudonymise(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every found value replaced, and (kind, start, end) of each in the input, by place."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    for k, kind in enumerate(KINDS):
        taken = sorted((a, b) for a, b, _, _ in found)
        at = pos = 0
        while m := kind.pattern.search(text, pos):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            limit = taken[at][0] if at < len(taken) else len(text)
            if limit <= m.start():
                pos = taken[at][1]
                continue
            pos = m.start() + 1
            for end in kind.ends(text, *m.span()) if kind.ends else [m.end()]:
                new = _written(k, text[m.start() : end], key, back) if end <= limit else None
                if new is not None:
                    found.append((m.start(), end, kind.name, new))
                    pos = end
                    break
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [(kind, a, b) for a, b, kind, _ in found]


def feistel_pseudonyms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per input row: doc_id, n_found, kinds (sorted, comma-joined), changed, text, spans (in the input text).

    A null or empty text comes back as the empty text with nothing found. Repeated rows give repeated rows, texts may have any
    length, other columns are ignored, and an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in texts_of(batch.column(1)):
                made = [pseudonymise(t.decode(), key) for t in texts]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(f) for _, f in made], pa.int64()),
                        pa.array([",".join(sorted({k for k, _, _ in f})) for _, f in made], pa.string()),
                        pa.array([bool(f) for _, f in made], pa.bool_()),
                        pa.array([t for t, _ in made], pa.string()),
                        pa.array([[{"kind": k, "start": i, "end": j} for k, i, j in f] for _, f in made], spans),
                    ],
                    names=["doc_id", "n_found", "kinds", "changed", "text", "spans"],
                )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_found long, kinds string, changed boolean, text string, spans array<struct<kind:string,start:int,end:int>>")
