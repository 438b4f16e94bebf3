"""Scoring by a bigram language model held in Elias-Fano tries.

P(w | v) = (c(v w) + mu * P1(w)) / (c(v) + mu), P1(w) = (c(w) + 1) / (N + V + 1): a Dirichlet-smoothed bigram over an add-one
unigram, counted over all training documents. Its logarithm splits into parts that each need one key only,

    log P1(w) + log(mu / (c(w) + mu)) for each token w (as predicted word and as the context of the next one),
    log(1 + c(v w) / (mu * P1(w))) for each seen pair,

so the model is cut into shards by predicted word, each shard one trie (word -> context), and a document's score is
the sum of what the shards give for its pairs. No machine ever holds the whole model, and shards grow in number with the input.

Identities: a word is a 64-bit fingerprint, so n_known and base_score err only where two of all words share one (chance 0.03
in a billion distinct words). A context is one of 48 bits under its predicted word: in m contexts of one word
m^2 / 2^49 pairs of them are expected to be counted together, 0.2 of ten million. A row is known by 128 bits of its id and text.

Scale notes: texts are taken in chunks of a few MB. One exchange carries each chunk's distinct pairs to the shards (about 6 bytes
a token), a second carries quantised answers back to the chunk, where its documents' places (2 bytes a token) wait. A chunk
visits the shards that its words fall into and no others. Words with over 1/HOT of all tokens (HOT of them at most) have their
pairs spread over all shards by context; their counts are sent to every task. A chunk is named by its task and place,
so ``docs`` should be a table scan, whose tasks read the same rows whenever they run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import checkpoint, text_of
from loomspan.llm.elias_fano import Trie
from loomspan.llm.packed import combine, narrow, pack, release, runs, shard_of, texts_of, unpack, widen, words

MU = 300.0
HOT = 4096
BYTES_PER_SHARD = 3 << 20
#: Contexts travel as 48-bit fingerprints.
CONTEXT_SHIFT = np.uint64(16)
#: Fingerprint of the text's end, also the context of its first word.
END = np.uint64(0)


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted fingerprint, context fingerprint and text number of every token, ends included."""
    doc, word = words([t.lower() for t in texts])
    n = np.bincount(doc, minlength=len(texts)) + 1
    last = np.cumsum(n) - 1
    predicted, context = np.empty(int(n.sum()), np.uint64), np.empty(int(n.sum()), np.uint64)
    at = np.arange(len(word)) + doc
    predicted[at], predicted[last] = word, END
    context[at + 1 if len(at) else at], context[last - n + 1] = word, END
    return predicted, context, np.repeat(np.arange(len(texts)), n)


def _count(shards: int):
    """Training texts -> packed word counts by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in texts_of(batch.column(0)):
                _, word = words([t.lower() for t in texts])
                key, n = np.unique(word, return_counts=True)
                out = [(s, pack(np.diff(key[i:j], prepend=np.uint64(0)), n[i:j].astype(np.uint32))) for s, i, j in runs(shard_of(key, shards))]
                yield pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())], names=["shard", "cell"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """A shard's words -> row (0, tokens, distinct words) and a row (word, count, 0) for each of its very frequent ones."""
    keys, counts = [], []
    for raw in table.column("cell").to_pylist():
        k, c = unpack(raw)
        keys.append(np.cumsum(k, dtype=np.uint64))
        counts.append(c)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    top = np.flatnonzero(n * 256 > n.sum())
    return pa.table({"word": pa.array(np.concatenate([[0], key[top].view(np.int64)])), "n": pa.array(np.concatenate([[n.sum()], n[top]])), "distinct": pa.array(np.concatenate([[len(key)], np.zeros(len(top), np.int64)]))})


#: Answers are fixed-point numbers: word values of 16 bits from -24 up, pair gains (from 0) of 8 bits.
GRID, LOWEST = 1 / 2048, -24.0


def gain_grid(total: int, mu: float) -> float:
    """Step of the pair gains: 1/32, or more where 255 such steps don't reach the largest gain that the counts allow."""
    return max(1 / 32, float(np.log10(1 + total / mu)) / 255)


def _spread(shards: int, hot: np.ndarray):
    """Rows (h1, h2, train, text) -> each chunk's distinct pairs by shard; its documents' lines with shard -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            h1, h2, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), dtype=bool)
            for a, b, texts in texts_of(batch.column(3)):
                predicted, context, owner = _pairs(texts)
                # one sort by a fingerprint of the pair brings equal pairs together, documents in order
                mixed = combine(predicted, context)
                order = np.argsort(mixed, kind="stable")
                mixed, owner = mixed[order], owner[order]
                new = np.ones(len(mixed), bool)
                new[1:] = mixed[1:] != mixed[:-1]
                own = new.copy()
                own[1:] |= owner[1:] != owner[:-1]
                first, lines = np.flatnonzero(new), np.flatnonzero(own)
                p, c, m = predicted[order[first]], context[order[first]] >> CONTEXT_SHIFT, mixed[first]
                # of each distinct pair its lines; of each line its document and how often
                n_lines = np.diff(np.append(np.searchsorted(lines, first), len(lines)))
                line_owner, times = owner[lines], np.diff(np.append(lines, len(mixed)))
                pair = np.repeat(np.arange(len(first)), n_lines)
                seen = np.bincount(pair, weights=times * train[a:b][line_owner], minlength=len(first)).astype(np.uint32)
                shard = shard_of(np.where(np.isin(p, hot), m, p), shards)
                order = np.lexsort((c, p, shard))
                start = (np.cumsum(n_lines) - n_lines)[order]
                n_lines = n_lines[order]
                take = np.repeat(start - (np.cumsum(n_lines) - n_lines), n_lines) + np.arange(len(lines))
                p, c, seen = p[order], c[order], seen[order]
                out = [(-1, pack(h1[a:b], h2[a:b], n_lines.astype(np.uint32), narrow(line_owner[take]), times[take].astype(np.uint32)))]
                for s, i, j in runs(shard[order]):
                    word, many = np.unique(p[i:j], return_counts=True)
                    some, which = np.unique(c[i:j], return_inverse=True)
                    out.append((s, pack(np.diff(word, prepend=np.uint64(0)), many.astype(np.uint32), np.diff(some, prepend=np.uint64(0)), narrow(which), seen[i:j])))
                yield pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([c for _, c in out], pa.binary())], names=["shard", "chunk", "cell"])
                number += 1

    return run


def _fixed(x: np.ndarray, lowest: float, grid: float, kind: type) -> np.ndarray:
    return np.clip(np.rint((x - lowest) / grid), 0, np.iinfo(kind).max).astype(kind)


def _answer(hot: np.ndarray, hot_counts: np.ndarray, n_tokens: int, n_words: int, mu: float):
    """A shard's pairs -> a trie -> answers: of each chunk's words their count and value, of its pairs their gain."""
    total = n_tokens + n_words + 1
    grid = gain_grid(total, mu)

    def answers(cells: list[bytes]) -> list[bytes]:
        asked = [unpack(raw) for raw in cells]
        p = np.concatenate([np.repeat(np.cumsum(x[0], dtype=np.uint64), x[1]) for x in asked])
        c = np.concatenate([np.cumsum(x[2], dtype=np.uint64)[widen(x[3], len(x[4]))] for x in asked])
        seen = np.concatenate([x[4] for x in asked]).astype(np.float64)
        # distinct pairs and their counts
        order = np.lexsort((c, p))
        p, c, seen = p[order], c[order], seen[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        where = np.empty(len(p), np.int64)
        where[order] = np.cumsum(new) - 1
        p, c, pair_count = p[first], c[first], np.add.reduceat(seen, first)
        # counts of the predicted words: of their own pairs, or as sent for those spread over all shards
        word, inverse = np.unique(p, return_inverse=True)
        count = np.bincount(inverse, weights=pair_count)
        if len(hot):
            k = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
            count = np.where(hot[k] == word, hot_counts[k], count)
        there, kept = count > 0, pair_count > 0
        value = np.log10((count + 1) / total) + np.log10(mu / (count + mu))
        gain = np.log10(1 + pair_count[kept] * total / (mu * (count[inverse[kept]] + 1)))
        trie = Trie.build(word[there], value[there], p[kept], c[kept], gain).mapped()
        known, level1, hit, level2 = trie.lookup(p, c)
        value = np.where(known, level1, -np.log10(total))
        by_pair, by_word = _fixed(np.where(hit, level2, 0.0), 0.0, grid, np.uint8), _fixed(value[np.searchsorted(p, word)], LOWEST, GRID, np.uint16)
        out, at = [], 0
        for delta, many, _, _, _ in asked:
            n = int(many.sum())
            w = np.searchsorted(word, np.cumsum(delta, dtype=np.uint64))
            out.append(pack(many, count[w].astype(np.uint64), by_word[w], by_pair[where[at : at + n]]))
            at += n
        return out

    def run(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return pa.table({"chunk": table.column("chunk"), "shard": pa.array([-1] * table.num_rows, pa.int32()), "cell": table.column("cell")})
        made = pa.array(answers(table.column("cell").to_pylist()), pa.binary())
        release()
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "cell": made})

    return run


def _sum_up(total: int, grid: float):
    """A chunk's lines and answers -> a row per document."""

    def run(table: pa.Table) -> pa.Table:
        shard, cells = table.column("shard").to_numpy(), table.column("cell").to_pylist()
        order = np.argsort(shard, kind="stable")
        h1, h2, n_lines, owner, times = unpack(cells[order[0]])
        owner = widen(owner, len(times))
        score, base, known = [], [], []
        for k in order[1:]:
            many, count, value, gain = unpack(cells[k])
            score.append(np.repeat(value * GRID + LOWEST, many) + gain * grid)
            base.append(np.repeat(np.log10(count + 1.0), many))
            known.append(np.repeat(count > 0, many))
        pair = np.repeat(np.arange(len(n_lines)), n_lines)
        add = lambda x: np.bincount(owner, weights=times * np.concatenate(x)[pair], minlength=len(h1))
        tokens = np.bincount(owner, weights=times, minlength=len(h1))
        return pa.table({"h1": pa.array(h1), "h2": pa.array(h2), "n_tokens": pa.array(np.rint(tokens).astype(np.int64)), "n_known": pa.array(np.rint(add(known)).astype(np.int64)), "base_score": pa.array(add(base) - tokens * np.log10(total)), "score": pa.array(add(score))})

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, mu: float = MU) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32(id as text) mod ``folds`` is not ``fold``; a null id counts as empty and is trained on. A
    null or empty text is its end alone. Repeated rows are counted each in training and get equal scores. Scores are
    log10 of the whole text's probability; texts and words may have any length. Other columns are ignored. Empty input gives no rows.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    base = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_of(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    volume, n_train = int(size[0] or 0), int(size[1] or 0)
    shards = max(1, -(-volume // BYTES_PER_SHARD))

    totals = base.filter(~F.col("held_out")).select("text").mapInArrow(_count(shards), "shard int, cell binary").groupBy("shard").applyInArrow(_totals, "word long, n long, distinct long")
    totals = checkpoint(totals.groupBy("word").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")))
    zero = totals.filter("word = 0 and distinct > 0").collect()
    n_tokens = n_train + sum(r.n for r in zero)
    n_words = (n_train > 0) + sum(r.distinct for r in zero)
    # words with over 1 / HOT of all tokens: HOT rows at most. The text's end is always one of them.
    frequent = totals.filter(f"distinct = 0 and n * {HOT} > {n_tokens}").collect() if shards > 1 else []
    counts = {int(np.int64(r.word).view(np.uint64)): r.n for r in frequent} | {int(END): n_train}
    hot = np.array(sorted(counts), dtype=np.uint64)
    hot_counts = np.array([counts[int(h)] for h in hot], dtype=np.float64)

    known_by = [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("h2")]
    rows = base.select(*known_by, (~F.col("held_out")).alias("train"), "text")
    spread = rows.mapInArrow(_spread(shards, hot), "shard int, chunk long, cell binary")
    # lines of many chunks share a shard number below 0, one for each bucket of chunks
    spread = spread.withColumn("shard", F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("chunk"), F.lit(shards))).otherwise(F.col("shard")).cast("int"))
    answered = spread.groupBy("shard").applyInArrow(_answer(hot, hot_counts, n_tokens, n_words, mu), "chunk long, shard int, cell binary")
    total = n_tokens + n_words + 1
    scored = answered.groupBy("chunk").applyInArrow(_sum_up(total, gain_grid(total, mu)), "h1 long, h2 long, n_tokens long, n_known long, base_score double, score double")
    # rows repeated in full are scored alike in each of their places
    scored = scored.dropDuplicates(["h1", "h2"])
    ids = base.select("doc_id", "held_out", *known_by)
    return ids.join(scored, ["h1", "h2"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
