"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every byte 4-gram of a text falls into one of 2^16 hashed cells. The cells of the trusted documents and of the whole
corpus give two add-one smoothed multinomials; a text's score is the mean over its n-grams of log(p_trusted / p_raw).
Each document is then kept or rejected by one fixed threshold, so the verdict of a text does not depend on chance.

The trusted documents are all labelled rows of quality 1, and the raw counts cover every document. The threshold is set on
all labelled rows that pass the base rules: the cut that best parts good from bad rows, moved down until it rejects none of the
good ones beyond ``lose`` of them. Without labelled rows of both kinds the verdict is that of the base rules alone.

Scale notes: labels may be as many as documents, so they are joined and not broadcast: the texts are shuffled once, to meet
the labels of quality 1. Counting sends one row a cell and task (map-side sums over 2^16 cells, whatever the input), the
driver gets 2^16 rows, and the ratio table of 512 KB is sent to the tasks. Scores meet all labels as rows without text; the
threshold comes from running sums over cells of scores, 1/4096 wide, so that no task holds all scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import small_batches, stored, text_of
from loomspan.llm.mixing import _prefix
from loomspan.llm.packed import chunks, texts_of

CELLS = 1 << 16
ORDER = 4
#: Cells of a score unit in the running sums for the threshold.
STEPS = 1 << 12
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # first word not yet counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each n-gram of the joined texts, the first of each text, and how many each text has."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + b"\0" * (ORDER - 1), dtype=np.uint8).astype(np.uint32)
    n = int(sizes.sum())
    h = np.zeros(n, dtype=np.uint32)
    for k in range(ORDER):
        h = (h + data[k : n + k]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(CELLS - 1)).astype(np.int64), np.cumsum(sizes) - sizes, np.maximum(sizes - ORDER + 1, 0)


def _inside(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """True where an n-gram lies within one text."""
    ok = np.zeros(n + 1, dtype=np.int32)
    np.add.at(ok, starts[counts > 0], 1)
    np.add.at(ok, (starts + counts)[counts > 0], -1)
    return np.cumsum(ok[:-1]).astype(bool)


def scores(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Length-normalised log ratio of each text; 0 for a text shorter than one n-gram."""
    out = np.zeros(len(texts))
    for a, b in chunks([len(t) for t in texts]):
        cells, starts, counts = _cells(texts[a:b])
        # each text's sum on its own: it is the same whatever stands beside it
        sums = np.add.reduceat(np.append(table[cells], 0.0), np.stack([starts, starts + counts], axis=1).ravel())[::2]
        out[a:b] = np.where(counts > 0, sums, 0.0) / np.maximum(counts, 1)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for _, _, texts in texts_of(batch.column(0)):
            cells, starts, counts = _cells(texts)
            found += np.bincount(cells[_inside(starts, counts, len(cells))], minlength=CELLS)
    used = np.flatnonzero(found)
    yield pa.record_batch([pa.array(used), pa.array(found[used])], names=["cell", "n"])


def _counts(texts: DataFrame) -> np.ndarray:
    """How many n-grams of a column of texts fall into each cell, and one more."""
    got = texts.mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n")).toPandas().to_numpy()
    out = np.ones(CELLS)
    if len(got):
        out[got[:, 0]] += got[:, 1]
    return out


class Model:
    """ratio: log(p_trusted / p_raw) by cell; threshold: least score that is kept."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def _cut(scored: DataFrame, lose: float) -> float:
    """The threshold with the best balanced accuracy, but at most the ``lose`` quantile of the good scores, from rows of quality (0 or
    1) and llr. In whole numbers: below a cut, each bad row counts as often as there are good rows, and the other way round."""
    n = lambda q: F.sum((F.col("quality") == q).cast("long"))
    at = stored(scored.groupBy("llr").agg(n(1).alias("good"), n(0).alias("bad")), "scores")
    good, bad = at.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return -np.inf
    rows = at.select("llr", "good", "bad", F.lit(0).alias("all"), F.floor(F.col("llr") * STEPS).alias("cell"))
    gain = F.expr(f"cast(bad as decimal(18,0)) * {good} - cast(good as decimal(18,0)) * {bad}").cast("decimal(38,0)")
    best = _prefix(rows, "all", "cell", ["llr"], gain, "gain").orderBy(F.desc("gain"), "llr").first()["llr"]
    below = at.filter((F.col("bad") > 0) & (F.col("llr") < best)).agg(F.max("llr")).first()[0]
    best = best if below is None else (best + below) / 2
    place = (good - 1) * lose
    first, second = int(place), min(int(place) + 1, good - 1)
    near = _prefix(rows.filter("good > 0"), "all", "cell", ["llr"], F.col("good"), "before").filter((F.col("before") <= second) & (F.col("before") + F.col("good") > first))
    low, high = (lambda found: (min(found), max(found)))([r["llr"] for r in near.select("llr").collect()])
    return float(min(best, low + (high - low) * (place - first)))


def _labelled(labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """id and quality, once for each id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("quality")).filter("id is not null and quality in (0, 1)")
    return known.groupBy("id").agg(F.min("quality").alias("quality"))


def measured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", lose: float = 0.002) -> tuple[DataFrame, Model]:
    """``row`` (the id) and the columns of SCHEMA for every row, and the model, learned from all documents and all labels."""
    known = _labelled(labels, id_col, quality_col)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        good = _counts(texts.join(known.filter("quality = 1").hint("merge"), "id").select("text"))
        found = good.sum() > CELLS
        raw = _counts(texts.select("text")) if found else good
        model = Model(np.log(good / good.sum()) - np.log(raw / raw.sum()), -np.inf)
        rows = stored(_judged(texts.select(F.col("id").alias("row"), "text"), model), "judged")
    if found:
        model.threshold = _cut(rows.filter("not base_failed").select(F.col("row").alias("id"), "llr").join(known, "id").select("quality", "llr"), lose)
    return rows.withColumn("kept", F.col("kept") & (F.col("llr") >= F.lit(float(model.threshold)))), model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", lose: float = 0.002) -> Model:
    return measured(docs, labels, id_col, text_col, quality_col, lose)[1]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _judged(rows: DataFrame, model: Model, text_field: int | None = None) -> DataFrame:
    """``row`` (any type) and the columns of SCHEMA, from ``row`` and ``text`` - or from a struct ``row`` alone, whose field of
    that number is the text, so that it goes to Python once. Worked on and sent back a few MB at a time."""
    ratio, threshold = model.ratio, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            column = batch.column(1) if text_field is None else row.field(text_field)
            for a, b, texts in texts_of(column.fill_null("")):
                found = [measure(t.decode()) for t in texts]
                llr = scores(texts, ratio)
                failed = [base_failed(f[0], f[4]) for f in found]
                kept = [not bad and bool(x >= threshold) for bad, x in zip(failed, llr, strict=True)]
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
                yield pa.record_batch([row.slice(a, b - a), *columns, pa.array(failed, pa.bool_()), pa.array(llr, pa.float64()), pa.array(kept, pa.bool_())], names=["row", *[x.split()[0] for x in SCHEMA.split(", ")]])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {SCHEMA}")


def judge(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all input columns) and the columns of SCHEMA.

    A null or empty text has no words and fails the base rules. Rows are judged one by one, so repeated rows get
    the same verdict, and no input column can clash with a measured one.
    """
    return _judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), model, docs.columns.index(text_col))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and verdict of every row; the text isn't sent back from Python.

    A null or empty text has no words and fails the base rules; repeated rows get equal verdicts; texts may have any length; labels of
    null ids, of ids that aren't there and of other values are ignored, and a labelled id stands for all its rows. Other columns are
    ignored. An empty table gives no rows.
    """
    return measured(docs, labels, id_col, text_col)[0].select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names; cases as for quality_rules. An empty
    table stays empty."""
    return judge(docs, fit(docs, labels, id_col, text_col), text_col).filter("kept").select("row.*")
