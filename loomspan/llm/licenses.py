"""License scan by ordered signature rules.

Hundreds of regexes (license_rules), each written for its license: SPDX tags, canonical addresses, clauses, grant sentences, full
names, short mentions. A keyword automaton gates them: a rule runs only on texts that hold all its keywords, so most texts run
none. Detections are then resolved in order of trust: one that lies inside another of more trust is suppressed; those that only
overlap both stay.

Row by row, no shuffle; whole texts of any length.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import license_rules
from loomspan.llm.common import text_of

#: Phrases of the base labels, as words.
BASE = {"mit": (b"mit", b"license"), "apache": (b"apache", b"license"), "gpl": (b"general", b"public", b"license")}
#: Score and priority by signature form; the order is the order of trust.
FORMS = {"tag": 1.0, "clause": 0.95, "address": 0.95, "grant": 0.9, "name": 0.8, "family": 0.6, "short": 0.5}
_ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([c > 0x7F or chr(c).isdigit() or "a" <= chr(c).lower() <= "z" for c in range(256)])


class Rule(NamedTuple):
    label: str
    form: str
    keywords: frozenset[str]
    pattern: re.Pattern


#: What a space, an SPDX tag up to an id (the ids before it are the group) and an optional version word of a rule stand for.
_GAP = r"[\s,;:()\"'/_*#>|!.&-]++"
_TAG = r"spdx-license-identifier:[ \t]*+((?:[( \t]*[a-z0-9.+:-]+[) \t]+(?:and|or|with)[ \t]+)*)[( \t]*"
_VERSION = rf"(?:(?:version|v|ver){_GAP}|v)?"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, those of the most trusted form first."""
    made: list[Rule] = []
    label = ""
    for line in license_rules.RULES.strip().splitlines():
        if line.startswith("["):
            label = line[1:-1]
            continue
        form, words, regex = line.split(" | ")
        tag, regex = regex.startswith("@"), regex.lstrip("@")
        # a gap is eaten whole: the first word after it begins with a letter or a digit
        regex = regex.replace(" % ", _GAP + _VERSION).replace(" ?", f"(?:{_GAP})?").replace(" ", _GAP)
        end = r"(?:-only|-or-later|\+)?(?![a-z0-9.-]*[a-z0-9])" if tag else r"(?![a-z0-9])"
        made.append(Rule(label, form, frozenset(words.split(",")), re.compile((_TAG + f"({regex})" if tag else rf"(?<![a-z0-9])(?:{regex})") + end)))
    return tuple(sorted(made, key=lambda r: (-FORMS[r.form], r.label, r.pattern.pattern)))


@cache
def _gate() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in {w for r in rules() for w in r.keywords}:
        a.add_word(word, word)
    a.make_automaton()
    return a


class Found(NamedTuple):
    label: str
    form: str
    start: int
    end: int


def detect(text: str) -> list[Found]:
    """Detections left after suppression, by place. ``text`` has its A-Z lower-cased."""
    held = {w for _, w in _gate().iter(text)}
    # a later id of an expression stands for itself alone
    start = lambda m, r: m.start(2) if r.form == "tag" and m[1] else m.start()
    every = [(rank, start(m, r), m.end(), r) for rank, r in enumerate(rules()) if r.keywords <= held for m in r.pattern.finditer(text)]
    every.sort(key=lambda x: (-FORMS[x[3].form], -(x[2] - x[1]), x[1], x[0]))
    # by trust: a detection inside one that was met before is suppressed. What holds it may itself be inside a third one, which then
    # holds both; so it is enough to know, for each place, how far the detections that begin up to it reach.
    starts = sorted({a for _, a, _, _ in every})
    reach = [-1] * (len(starts) + 1)  # a Fenwick tree of greatest ends
    out = []
    for _, a, b, r in every:
        k = at = bisect(starts, a)
        far = -1
        while k:
            far, k = max(far, reach[k]), k & (k - 1)
        if far < b:
            out.append(Found(r.label, r.form, a, b))
        while at <= len(starts):
            reach[at] = max(reach[at], b)
            at += at & -at
    return sorted(out, key=lambda f: (f.start, f.end))


def scan(raw: bytes) -> tuple[int, list[tuple[int, str]], list[Found]]:
    """n_words, base places as (first word, label), detections; for UTF-8 text."""
    low = raw.lower()  # of bytes: A-Z only
    is_word = _IS_WORD[np.frombuffer(low, dtype=np.uint8)]
    n_words = int(np.count_nonzero(is_word[1:] & ~is_word[:-1]) + (len(is_word) > 0 and is_word[0]))
    places = []
    if b"license" in low:
        words = _ALNUM.findall(low)
        for i, w in enumerate(words):
            if w == b"license":
                for label, phrase in BASE.items():
                    k = i - len(phrase) + 1
                    if k >= 0 and tuple(words[k : i + 1]) == phrase:
                        places.append((k, label))
    return n_words, places, detect(low.decode())


SCHEMA = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "array<struct<label:string,form:string,start:int,end:int>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A null or empty text gives zero counts, null places, empty labels and score 0. The score is that of the most
    trusted detection; a base place alone scores as a full name. Spans are character offsets in the text, by place. Texts may
    have any length; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch.column(1).to_pylist():
                n, places, found = scan(text.encode())
                base = {label for _, label in places}
                out["n_words"].append(n)
                out["n_base"].append(len(places))
                out["first_word"].append(min((k for k, _ in places), default=None))
                out["last_word"].append(max((k for k, _ in places), default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {f.label for f in found})))
                out["score"].append(max([FORMS[f.form] for f in found] + [FORMS["name"]] * bool(places), default=0.0))
                out["spans"].append([f._asdict() for f in found])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.record_batch([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], names=["doc_id", *out])

    return slim.mapInArrow(run, SCHEMA.format(id=slim.schema["doc_id"].dataType.simpleString()) + f", spans {SPANS}")
