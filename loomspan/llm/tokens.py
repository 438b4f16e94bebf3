"""Whole-text tokenization, a column at a time, with a per-process cache of segments.

Both vocabularies split a text by a pattern before they merge, and a token of that pattern always ends at white space and
where a letter meets a character that is none; so the ids of a text are those of its segments in a row. Columns are cut
into segments, made distinct and looked up by Arrow; only segments that this process hasn't met are encoded, most
of them many at a time; the ids of all texts are then gathered by index.

The cut at letters is made only in plain texts: single spaces and line feeds, ASCII and letters of the Latin blocks that
the vocabulary's normaliser maps to letters, one by one. Any other text, and one that holds the string of an added token, is cut at white
space alone, and its segments go to the tokenizer as they are (from U+0000 or unusual white space on, whole).
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments kept by a process; the cache starts anew when full. It bounds memory and changes no result.
CACHED = 600_000
#: Letters whose normal form is one letter, as an RE2 class body: Latin without U+0130, whose lower case is a letter and a mark.
_LETTER = r"a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_LETTERS = f"^[{_LETTER}]+$"
#: Characters of plain texts: a space or line feed, visible ASCII, Latin letters and signs.
_OTHER = r"[^ \n!-~\x{a1}-\x{12f}\x{131}-\x{24f}]"
#: Where a letter meets a visible ASCII character that is none.
_BORDER = rf"([{_LETTER}])([!-@\[-`{{-~])"
#: Marks a key that stands for itself alone; other byte keys stand for themselves with a space before.
_WHOLE = "\0"
_RUNS = re.compile(r"\s*\S+|\s+").findall
_UNSURE = re.compile(r"[\0\x1c-\x1f]").search


class Encoder:
    """Token ids of string columns. kind: 'word' (lower case, white space is dropped) or 'byte'."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self._forget()
        self.feed = self.tokenizer.token_to_id("Ċ")
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # ids that begin with a space (byte) or end a word (word)
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if kind == "byte" else t.endswith("</w>"))]] = True

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.start, self.size = np.empty(1 << 18, dtype=np.int64), np.empty(1 << 18, dtype=np.int32)

    def _put(self, ids: np.ndarray, sizes: np.ndarray, n: int) -> int:
        """Keep the ids of keys number n and up; the next number."""
        m = len(sizes)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.start) < n + m:
            self.start, self.size = np.concatenate([self.start, np.empty_like(self.start)]), np.concatenate([self.size, np.empty_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + m] = sizes
        self.used += len(ids)
        return n + m

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys in a row, and how many each has."""
        made = self._ids([k[1:] if k[:1] == _WHOLE else " " + k for k in keys] if self.kind == "byte" else keys)
        return np.concatenate(made), np.array([len(x) for x in made])

    def _in_one(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: encoded as one text, whose ids tell where a word begins or ends."""
        (ids,) = self._ids([" " * (self.kind == "byte") + " ".join(keys)])
        edge = np.flatnonzero(self.edge[ids])
        sizes = np.diff(edge, append=len(ids)) if self.kind == "byte" else np.diff(edge, prepend=-1)
        if len(sizes) != len(keys) or sizes.sum() != len(ids):
            return self._one_by_one(keys)
        return ids, sizes

    def _learn(self, fresh: pa.Array) -> None:
        """Encode keys that aren't known yet and keep them."""
        letters = pc.match_substring_regex(fresh, _LETTERS)
        n = len(self.known)
        parts = [fresh.filter(letters), fresh.filter(pc.invert(letters))]
        for part, encode, many in zip(parts, (self._in_one, self._one_by_one), (2_000, 20_000), strict=True):
            keys = part.to_pylist()
            for a in range(0, len(keys), many):
                n = self._put(*encode(keys[a : a + many]), n)
        self.known = pa.concat_arrays([self.known, *parts])

    def _gather(self, index: np.ndarray) -> np.ndarray:
        size = self.size[index].astype(np.int64)
        shift = self.start[index] - (np.cumsum(size) - size)
        place = np.repeat(shift, size)
        place += np.arange(len(place))
        return self.flat[place]

    def _odd(self, texts: pa.Array) -> pa.Array:
        """Texts that aren't plain."""
        odd = pc.match_substring_regex(texts, _OTHER if self.kind == "word" else rf"[ \n][ \n]|{_OTHER}")
        low = pc.ascii_lower(texts)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(low, token))
        return odd

    def _plain_parts(self, texts: pa.Array) -> pa.Array:
        if self.kind == "word":
            return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _BORDER, r"\1 \2"))
        # each space begins a segment, each line feed is one, and so is what follows letters. RE2 takes letter and sign
        # together, so a sign between two letters never hides a border
        cut = pc.replace_substring(texts, "\n", f" {_WHOLE}\n {_WHOLE}")
        cut = pc.replace_substring_regex(cut, _BORDER, rf"\1 {_WHOLE}\2")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_WHOLE), cut, pa.scalar("")), " ")

    def _odd_parts(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.split() if text.isascii() and not _UNSURE(text) else pc.ascii_split_whitespace(pa.scalar(text)).as_py()
        if _UNSURE(text):
            return [_WHOLE + text]
        return [s[1:] if s[0] == " " and len(s) > 1 and not s[1].isspace() else _WHOLE + s for s in _RUNS(text)]

    def _keys(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All segments in order, and where each text's begin (with the end)."""
        odd = self._odd(texts).to_numpy(zero_copy_only=False)
        if not odd.any():
            parts = self._plain_parts(texts)
            return parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        lists: list = [None] * len(texts)
        where = np.flatnonzero(~odd)
        for i, p in zip(where.tolist(), self._plain_parts(texts.take(pa.array(where))).to_pylist(), strict=True):
            lists[i] = p
        for i in np.flatnonzero(odd).tolist():
            lists[i] = self._odd_parts(texts[i].as_py())
        parts = pa.array(lists, pa.list_(pa.string()))
        return parts.flatten(), parts.offsets.to_numpy()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column (no nulls) as uint32, and where each text's begin (with the end)."""
        if len(self.known) > CACHED:
            self._forget()
        keys, begin = self._keys(texts)
        coded = keys.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        if at.null_count:
            fresh, n = coded.dictionary.filter(at.is_null()), len(self.known)
            self._learn(fresh)
            new = pc.add(pc.index_in(fresh, value_set=self.known.slice(n)), pa.scalar(n, pa.int32()))
            at = pc.replace_with_mask(at, at.is_null(), new)
        index = at.to_numpy().astype(np.int64)[coded.indices.to_numpy()] if len(keys) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.size[index], dtype=np.int64)])
        return self._gather(index), ends[begin]


@cache
def encoder(path: str, kind: str) -> Encoder:
    """One for each Python worker; its cache serves all tasks that run there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, kind)


def encoded(path: str, kind: str, texts: pa.Array, most: int = 3 << 20):
    """(first, end, ids, offsets) of a string column in runs of bounded size."""
    from loomspan.llm.packed import chunks, release

    for a, b in chunks(pc.binary_length(texts).to_pylist(), most):
        yield a, b, *encoder(path, kind)(texts.slice(a, b - a))
        release()
