"""The training-data operators against brute force, on small tables and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import common, compaction, components, exact_dedup, id_codec, id_files, licenses, lm_score, mixing, ngram_join, packing, pii, quality, queries
from loomspan.llm.common import new_path
from loomspan.llm.elias_fano import EliasFano

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
AWKWARD = [(1, "a b c"), (2, None), (3, ""), (4, " A  b\nc "), (4, " A  b\nc "), (5, "x " * 3000), (None, "a b c"), (7, "é ß 漢字 \x1f \x00 z"), (8, "   ")]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, long, repeated rows, and extra columns with names the operators use themselves."""
    rows = [(i, t, "s" if k % 2 else None, k, "e") for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int, kept string").drop("row")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# exact dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("block,bits", [(4096, 64), (16, 64), (16, 6)])
def test_exact_dedup(docs, block, bits):
    """Few key bits make different blocks share a key: names must still be right."""
    src = docs.toPandas()
    src["n"] = src.text.map(normal)
    keep, size = src.groupby("n").doc_id.transform("min"), src.groupby("n").doc_id.transform("size")
    got = exact_dedup.exact_dedup(docs, block_bytes=block, key_bits=bits).toPandas().set_index("doc_id").loc[src.doc_id]
    assert (got.keep_id.values == keep.values).all() and (got.group_size.values == size.values).all() and (got.kept.values == (src.doc_id == keep).values).all()
    assert (got.text_sha256.values == src.n.map(lambda s: hashlib.sha256(s.encode()).hexdigest()).values).all()


def test_exact_dedup_awkward(awkward, empty):
    got = exact_dedup.exact_dedup(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for (sha, rows), n in zip(sorted(by.items()), [None] * len(by)):
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)}
    assert len(by) == len({normal(t) for _, t in AWKWARD})
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(by)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


# n-gram join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(docs):
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs)[0].collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("tile", [4, 1024])
def test_ngram_join_near_copies(spark, monkeypatch, tile):
    """Families whose members link only through others, and tiles of a few rows."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng, rows = np.random.default_rng(1), []
    for _ in range(4):
        base = rng.integers(0, 3000, 150)
        for _ in range(25):
            w = base.copy()
            k = rng.integers(0, 10)
            w[rng.integers(0, 150, k)] = rng.integers(0, 3000, k)
            rows.append((len(rows), " ".join(f"W{x}" for x in w[rng.integers(0, 25) : 150 - rng.integers(0, 25)])))
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == brute_components(rows)


def test_ngram_join_runs_tiles(spark, monkeypatch):
    """Links that only a tile can find: sets that are near to members of a family, but not to its centre."""
    seen = []
    across = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda left, sets: seen.append(left.count()) or across(left, sets))
    rng, rows = np.random.default_rng(7), []
    for _ in range(3):
        base = rng.integers(0, 10_000, 400)
        for k in range(40):  # a chain: each text is the last one moved on by a few words
            rows.append((len(rows), " ".join(f"w{x}" for x in np.concatenate([base[5 * k :], rng.integers(0, 10_000, 5 * k)]))))
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == brute_components(rows) and seen and seen[0] > 0


@pytest.mark.parametrize("bits", [3, 8])
def test_ngram_join_shared_hashes(docs, bits):
    """Different texts whose first hash is the same stay apart."""
    some = docs.filter("doc_id < 60")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(some, hash_bits=bits)[0].collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in some.collect()])


def test_drop_near_copies_without_ids(spark, empty):
    """Rows without ids: one of each component stays; an empty string is another id than null."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(None, a), (None, a + " x"), (None, b), ("", b + " y"), ("", "one two three"), (None, ""), (None, "")]
    kept = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r.doc_id is None), r.text.split(" ")[0]) for r in kept) == sorted([(True, "a0"), (False, "b0"), (False, "one"), (True, ""), (True, "")])
    assert ngram_join.drop_near_copies(empty).count() == 0


def test_narrow_numbers():
    from loomspan.llm.packed import narrow, widen

    for values in ([], [0], [0, 0, 0], [1, 2, 3], [255, 256], [2**32 - 1, 0], list(range(1000))):
        raw = narrow(np.array(values, np.int64))
        assert widen(raw, len(values)).tolist() == values
    assert len(narrow(np.arange(1024))) == 1 + 1280


def test_words_that_polynomials_confuse():
    """Letters swapped 65,536 places apart, Thue-Morse words and their mirrors, long words with one other byte: all have their own number."""
    from loomspan.llm.packed import words

    far = b"a" * 10 + b"b" + b"c" * 65_535 + b"d" + b"e" * 9
    swapped = b"a" * 10 + b"d" + b"c" * 65_535 + b"b" + b"e" * 9
    thue = bytes(97 + bin(i).count("1") % 2 for i in range(4096))
    mirror = bytes(195 - c for c in thue)
    some = [far, swapped, thue, mirror, thue[:32], mirror[:32], thue[:33], mirror[:33], b"x" * 32, b"x" * 33, b"x" * 31 + b"y", b"x" * 31 + b"y" + b"x", b"ab", b"ba", b"a", b"b"]
    owner, key = words(some + some)
    assert owner.tolist() == list(range(2 * len(some))) and len(set(key.tolist())) == len(some) and (key[: len(some)] == key[len(some) :]).all()


def test_ngram_join_awkward(awkward, empty):
    got = ngram_join.jaccard_join(awkward)[0].collect()
    assert len(got) == len(AWKWARD)
    assert all(r.component_id == r.id for r in got if r.n_shingles == 0 and r.id is not None)
    assert {r.component_id for r in got if r.id in (1, 4) or r.id is None} == {1}
    kept = ngram_join.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == 6
    assert ngram_join.jaccard_join(empty)[0].count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_bitmap_bound_is_above():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 200).astype(np.uint64) << np.uint64(5)) for _ in range(2))
        most = ngram_join.bound(np.frombuffer(ngram_join.bitmap(a), np.uint64), np.frombuffer(ngram_join.bitmap(b), np.uint64), len(a), len(b), 0, 0)
        assert most >= len(np.intersect1d(a, b))


# mixing


def test_mixing(docs):
    rows, pieces = mixing.mix(docs, block_words=64)
    d = rows.toPandas()
    by = d.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), whole=("source_size", "first"))
    assert (by["size"] == by.whole).all() and (by.target - by.taken).between(0, 1).all() and (by.target <= 3 * by.whole + 1e-9).all()
    assert abs(by.target.sum() - by.whole.sum()) < 1e-6 and (d.taken <= 3 * d["size"]).all()
    p = pieces.toPandas()
    assert not p.duplicated(["source", "k", "slot", "id", "start"]).any() and p.groupby("slot").length.sum().max() <= 64
    again = mixing.mix(docs, block_words=64)[0].toPandas()
    assert again.sort_values("id").taken.tolist() == d.sort_values("id").taken.tolist()


@pytest.mark.parametrize("words", [16, 64])
def test_mixing_schedule(docs, words):
    """Slots stand in golden-ratio order: each belongs to the source whose share holds its point, and every prefix of the
    mix has each source's share but for a few slots. Documents lie in the slots of their own source's blocks."""
    goals = [(r.source, r.target) for r in mixing.targets(docs.groupBy("source").agg(F.sum(mixing.n_words("text")).alias("source_size"))).collect()]
    spark = docs.sparkSession
    slots = mixing.source_slots(spark.createDataFrame([(s, int(t)) for s, t in goals], "source string, quota long"), words).collect()
    blocks = {s: -(-int(t) // words) for s, t in goals if int(t)}
    order = sorted((s for s in blocks if s is not None)) + [None] * (None in blocks)
    total, lo, at = sum(blocks.values()), {}, 0
    for s in order:
        lo[s], at = at, at + blocks[s]
    owner = {}
    for slot in range(total):
        place = slot * mixing.STEP % mixing.LATTICE * total // mixing.LATTICE
        owner[slot] = next(s for s in order if lo[s] <= place < lo[s] + blocks[s])
    seen = collections.Counter()
    for r in sorted(slots, key=lambda r: r.slot):
        assert r.slot >= total or owner[r.slot] == r.source
        assert r.k == seen[r.source]
        seen[r.source] += 1
    assert seen == blocks and len({r.slot for r in slots}) == len(slots) and sum(r.slot >= total for r in slots) <= 6 * len(blocks)
    run = collections.Counter()
    for slot in range(total):
        run[owner[slot]] += 1
        assert all(abs(run[s] - (slot + 1) * blocks[s] / total) <= 2 + math.log2(total + 1) for s in blocks)
    rows, pieces = mixing.mix(docs, block_words=words)
    lies = collections.defaultdict(list)
    for p in pieces.collect():
        lies[p.id, p.nth].append(p.slot)
    by_k = {(r.source, r.k): r.slot for r in slots}
    assert all(by_k[p.source, p.k] == p.slot for p in pieces.collect())
    for r in rows.collect():
        assert r.n_slots == len(lies[r.id, r.nth]) and set(r.passes) <= set(lies[r.id, r.nth]) and (len(r.passes) > 0) == (r.taken > 0)
        assert not r.passes or min(lies[r.id, r.nth]) in r.passes


def test_mixed_rows_in_order(docs, monkeypatch):
    """Partitions one after another, and rows in them, follow the schedule."""
    monkeypatch.setattr(mixing, "PARTITION_WORDS", 3000)
    first = {r.id: r.passes for r in mixing.mix(docs)[0].collect()}
    out = mixing.mixed_rows(docs).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in out}) > 1
    met, places = collections.Counter(), []
    for r in sorted(out, key=lambda r: r.part):  # stable: rows of a partition stay in their order
        places.append(first[r.doc_id][min(met[r.doc_id], len(first[r.doc_id]) - 1)])
        met[r.doc_id] += 1
    assert places == sorted(places)


def test_mixing_null_and_empty_sources(spark):
    """A null source and an empty one are two; null and empty ids too."""
    rows = [(None, "a b c", None), ("", "a b c", ""), ("x", "d e f g", ""), (None, "h i", None)]
    d = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = mixing.mix(d)[0].collect()
    assert len({r.source for r in got}) == 2 and sum(r.source is None for r in got) == 2
    kept = mixing.mixed_rows(d).collect()
    assert {(r.doc_id, r.source) for r in kept} <= {(i, s) for i, _, s in rows}


def test_mixing_targets(spark):
    """The level of the capped share is the fixed point of resharing."""
    sizes = [("a", 1), ("b", 100), ("c", 1000), ("d", 3), (None, 50), ("z", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in sizes if s is not None)) + [None]
    weight, cap, total = dict(zip(order, [5, 2, 1, 5, 2, 1], strict=True)), {s: 3 * n for s, n in sizes}, sum(n for _, n in sizes)
    want, free = {s: 0.0 for s in order}, set(order)
    left = float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s], left = float(cap[s]), left - cap[s]
        free -= over
    assert got == pytest.approx(want)


def test_mixing_awkward(awkward, empty):
    rows, _ = mixing.mix(awkward)
    assert rows.count() == len(AWKWARD)
    assert mixing.mixed_rows(awkward).columns == awkward.columns
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed_rows(empty).count() == 0


# packing


def check_packing(docs, window=1024):
    from tokenizers import Tokenizer

    got = packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), window=window, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id, np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    pad = total = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
        n = int(g.length.sum())
        assert n <= window
        total, pad = total + n, pad + (0 if n & (n - 1) == 0 else window - n)
    assert (got.ids.map(zlib.crc32) == got.ids_crc32).all() and (got.ids.map(len) == 4 * got.length).all()
    pieces = collections.Counter((None if i != i else i, s, x) for i, s, x in zip(got.doc_id, got.start, got.ids, strict=True))
    seen = collections.Counter()
    for (i, raw), n in want.items():
        at = 0
        while at < len(raw) // 4:
            hit = next(x for (j, s, x), m in pieces.items() if j == i and s == at and m > 0 and raw[4 * s : 4 * s + len(x)] == x)
            assert pieces[i, at, hit] >= 1
            seen[i, at, hit] = n
            at += len(hit) // 4
    assert got.length.sum() == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    return pad / max(total, 1)


def test_packing(docs):
    assert check_packing(docs) < 0.02


def test_packing_awkward(awkward, empty):
    assert check_packing(awkward) < 0.05
    assert packing.pack(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_packing_plan(n):
    rests = np.random.default_rng(n).integers(1, 128, n)
    counts = np.bincount(rests, minlength=128)
    made, cut = packing.plan(counts, 128)
    used = cut.copy()
    for pattern, k in made:
        assert sum(pattern) <= 128
        for length in pattern:
            used[length] += k
    assert (used == counts).all()


# token files


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 2047, 2049, 9000])
def test_codec(n):
    ids = np.random.default_rng(n).integers(0, 400, n)
    ids[n // 2 :] = 7
    lengths = np.array([n // 3, n - n // 3])
    raw = id_codec.encode([5, None], lengths, ids, 500)
    got = id_codec.decode(raw)
    assert got[0] == [5, None] and (got[1] == lengths).all() and (got[2] == ids).all()
    if n > 1000:
        assert len(raw) < 2 * n + (2400 if n < 2000 else 0)  # the weights' table of 400 ids
        bad = bytearray(raw)
        bad[-3] ^= 4
        with pytest.raises(id_codec.CorruptBlock):
            id_codec.decode(bytes(bad))


def test_codec_blocks():
    """Any block is decoded alone; damage in one leaves the others readable, damage in the tables is found."""
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 60_000, 3000), rng.zipf(1.3, 5000) % 60_000, np.zeros(2000, np.int64)])
    raw = id_codec.encode([1], np.array([len(ids)]), ids, 60_000)
    s = id_codec.tables(raw)
    for i in range(len(s.sizes)):
        assert (id_codec.decode_blocks(s, i, i + 1) == ids[i * s.block : (i + 1) * s.block]).all()
    for k in (int(s.start[3]), int(s.start[4]) - 1):
        bad = bytearray(raw)
        bad[k] ^= 1
        t = id_codec.tables(bytes(bad))
        with pytest.raises(id_codec.CorruptBlock):
            id_codec.decode_blocks(t, 3, 4)
        assert (id_codec.decode_blocks(t, 4, len(t.sizes)) == ids[4 * s.block :]).all() and (id_codec.decode_blocks(t, 0, 3) == ids[: 3 * s.block]).all()
    bad = bytearray(raw)
    bad[40] ^= 1
    with pytest.raises(id_codec.CorruptBlock):
        id_codec.tables(bytes(bad))
    with pytest.raises(id_codec.CorruptBlock):
        id_codec.tables(raw[:100])


@pytest.mark.parametrize("seed", range(8))
def test_codec_any_ids(seed):
    """Long runs, rare ids at once after them (carries, the least weights), and vocabularies up to a million."""
    rng = np.random.default_rng(seed)
    v = int(rng.integers(2, 1 << 20))
    ids = np.concatenate([np.full(int(rng.integers(1, 1500)), rng.integers(0, v)) if rng.random() < 0.6 else rng.integers(0, v, int(rng.integers(1, 200))) for _ in range(30)])
    got = id_codec.decode(id_codec.encode([None], np.array([len(ids)]), ids, v))
    assert (got[2] == ids).all()


def test_codec_uses_context():
    """A text that repeats costs far less than its order-0 entropy."""
    ids = np.tile(np.random.default_rng(0).integers(0, 1000, 300), 60)
    assert len(id_codec.encode([1], np.array([len(ids)]), ids, 1000)) < 0.5 * len(ids)


def check_files(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    path = new_path(spark, "ids")
    id_files.write_ids(docs, path, queries.vocabulary("word_bpe_49k.json"))
    got = id_files.read_ids(spark, path).toPandas().sort_values("start")
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    src = [(r.doc_id, r.text) for r in sorted(hashed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    ids = [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for _, t in src]
    assert got.n_tokens.tolist() == [len(x) for x in ids] and got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]
    assert got.start.tolist() == (np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]).tolist()
    assert [None if x != x else int(x) for x in got.doc_id] == [i for i, _ in src]


def test_id_files(spark, docs, awkward):
    check_files(spark, docs)
    check_files(spark, awkward)


def test_id_files_partitions(spark, docs, monkeypatch):
    """Many partitions, and half of all rows without an id."""
    monkeypatch.setattr(id_files, "PARTITION_BYTES", 20_000)
    check_files(spark, docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))))


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_as_the_tokenizer(name, kind):
    """All of Unicode's white space, controls, format characters and marks, and letters with unusual lower cases."""
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    from loomspan.llm.tokens import Encoder

    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in every if c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp", "Mn")]
    lower = [c for c in every if len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c][:400]
    latin = [chr(c) for c in range(0x20, 0x250)]
    pieces = ["the", "Hello", "İ", "don't", "WE'LL", "'S", "<|endoftext|>", "K", "Å", "漢字", "H\u0331", "..", ",", "$$$", " ", " ", "  ", "\n", "\n\n", "\r\n", "\0", "\0world"]
    rng = np.random.default_rng(3)
    texts = ["\0", "\0world", *odd, *[c + "a" for c in odd], *["a" + c + ", b" for c in odd + lower], *["İ" + p for p in ".,;:!? a"]]
    for pool in (pieces, pieces + odd, pieces + latin, latin):
        texts += ["".join(pool[k] for k in rng.integers(0, len(pool), n)) for n in rng.integers(1, 14, 2500)]
    plain, encoder = Tokenizer.from_file(queries.vocabulary(name)), Encoder(queries.vocabulary(name), kind)
    for some in (texts, texts[-2500:]):
        ids, begin = encoder(pa.array(some))
        want = plain.encode_batch_fast(some, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [w.ids for w in want]


def test_id_files_empty(spark, empty):
    path = new_path(spark, "ids")
    id_files.write_ids(empty, path, queries.vocabulary("word_bpe_49k.json"))
    assert id_files.read_ids(spark, path).count() == 0


def test_added_tokens(spark):
    """The strings of added tokens are encoded as the unmodified tokenizers do, wherever they stand."""
    from tokenizers import Tokenizer

    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "end", "of.", "é漢", "  ", " ", "\n", "\n\n", "\t", "\xa0", "\x1f", "7"]
    rng = np.random.default_rng(0)
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|>b\n<|startoftext|> c"] + ["".join(marks[k] for k in rng.integers(0, len(marks), n)) for n in rng.integers(1, 30, 400)]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_files(spark, held)
    plain = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    got = packing.pack(held, queries.vocabulary("byte_bpe_50k.json"), with_ids=True).toPandas().sort_values("start")
    ids = got.groupby("doc_id").ids.apply(lambda x: np.frombuffer(b"".join(x), "<u4").tolist()).to_dict()
    assert ids == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


# language model


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 5), (1000, 1 << 63), (5000, 7000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    e = EliasFano.of(v, universe)
    assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate([v, rng.integers(0, universe, 300, dtype=np.uint64), np.array([0], np.uint64)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()


def check_lm(docs, per_shard, monkeypatch):
    monkeypatch.setattr(lm_score, "BYTES_PER_SHARD", per_shard)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    texts = [(zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2, WORD.findall((r.text or "").encode().lower()) + [None]) for r in rows]
    c, b = collections.Counter(), collections.Counter()
    for held, w in texts:
        if not held:
            c.update(w)
            b.update(zip([None, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    one = lambda x: (c[x] + 1) / (n + v + 1)
    for r, (held, w) in zip(rows, texts, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held, len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10(one(x)) for x in w), rel=1e-9)
        score = sum(math.log10((b[a, x] + lm_score.MU * one(x)) / (c[a] + lm_score.MU)) for a, x in zip([None, *w], w, strict=False))
        assert abs(g.score - score) <= 0.025 * len(w)


def test_lm_score(docs, awkward, monkeypatch):
    check_lm(docs, 100_000, monkeypatch)
    check_lm(docs, 1 << 30, monkeypatch)
    check_lm(awkward, 1 << 20, monkeypatch)


def test_lm_long_words(spark, monkeypatch):
    """One word of 100,000 bytes, a text of 2 MB, and words that differ far inside."""
    big = "q" * 100_000
    rows = [(0, big), (1, big[:-1] + "z"), (2, "a b " * 500_000), (3, f"a {big} b"), (5, None)]
    check_lm(spark.createDataFrame(rows, "doc_id long, text string"), 1 << 20, monkeypatch)


def test_lm_gains_are_not_clipped():
    """The grid of gains reaches the largest gain of any corpus: a pair seen always, of words seen nowhere else."""
    for total in (100, 10**9, 10**13, 10**18):
        assert 255.5 * lm_score.gain_grid(total, lm_score.MU) >= np.log10(1 + total / lm_score.MU)


def test_lm_empty(empty):
    assert lm_score.lm_score(empty).count() == 0


# quality


def brute_measure(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_measures(docs):
    for r in docs.collect():
        assert quality.measure(r.text) == brute_measure(r.text)
    for t in ("", "a a a a", "a b c a b c", "x\nx\n\n \n \nx", "# * $"):
        assert quality.measure(t) == brute_measure(t)


def test_quality_verdicts(spark):
    """On held-out labels (the larger table's), good documents stay and junk goes."""
    d = "/root/testdata/sf0.01"
    got = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").filter("doc_id % 2 = 0")).join(spark.read.parquet(f"{d}/labels.parquet").filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.02
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()


def brute_llr(rows, trusted):
    """Mean log ratio of a text's byte 4-grams, each cell counted one gram at a time."""
    cells, raw, good = quality.CELLS, collections.Counter(), collections.Counter()

    def grams(t):
        data = (t or "").encode()
        for i in range(len(data) - 3):
            h = 0
            for b in data[i : i + 4]:
                h = ((h + b) * 2654435761) & 0xFFFFFFFF
                h ^= h >> 15
            yield h % cells

    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            good[g] += i in trusted
    n_raw, n_good = sum(raw.values()) + cells, sum(good.values()) + cells
    out = {}
    for i, t in rows:
        some = [math.log((good[g] + 1) / n_good) - math.log((raw[g] + 1) / n_raw) for g in grams(t)]
        out[i] = sum(some) / len(some) if some else 0.0
    return out


def test_quality_llr_and_verdict(spark, docs, sf):
    """Ratio, threshold and verdict of every document, recounted one n-gram at a time."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kind = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    llr = brute_llr(rows, {i for i, q in kind.items() if q == 1})
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(abs(got[i].llr - llr[i]) < 1e-9 for i, _ in rows)
    failed = {i: quality.base_failed(*(brute_measure(t or "")[k] for k in (0, 4))) for i, t in rows}
    good, bad = (sorted(llr[i] for i, _ in rows if kind.get(i) == q and not failed[i]) for q in (1, 0))
    cut = quality.fit(docs, labels).threshold
    if good and bad:  # no cut parts the two kinds better, unless that one would lose more good texts than allowed
        balance = lambda c: sum(x >= c for x in good) / len(good) + sum(x < c for x in bad) / len(bad)
        assert sum(x < cut for x in good) <= 0.002 * len(good) + 1
        assert balance(cut) == pytest.approx(max(balance(c) for c in [*good, *bad])) or cut == pytest.approx(np.quantile(good, 0.002))
    assert all(got[i].kept == (not failed[i] and llr[i] >= cut) for i, _ in rows)


def test_keep_good_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(empty, labels).count() == 0 and quality.keep_good(empty, labels).columns == empty.columns


def test_small_batches(spark):
    """Long texts go to Python a few at a time, and the setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches)
    rows = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 20000) as text")
    with common.small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 400 and max(got) < 100 and spark.conf.get(key) == before


def test_quality_learns_from_all_labels(spark):
    """Where every document is trusted, no n-gram is worth anything, however many documents there are."""
    docs = spark.range(21_000).selectExpr("id as doc_id", "concat('text number ', id) as text")
    assert not quality.fit(docs, docs.selectExpr("doc_id", "1 as quality")).ratio.any()


def test_quality_cut_by_brute_force(spark):
    rng = np.random.default_rng(5)
    good, bad = np.round(rng.normal(0.3, 0.4, 700), 2), np.round(rng.normal(-0.2, 0.3, 90), 2)
    at = np.unique(np.concatenate([good, bad]))
    gain = [int((bad < x).sum()) * len(good) - int((good < x).sum()) * len(bad) for x in at]
    best = at[int(np.argmax(gain))]
    best = (best + bad[bad < best].max()) / 2
    scored = spark.createDataFrame([(1, float(x)) for x in good] + [(0, float(x)) for x in bad], "quality int, llr double")
    for lose in (0.002, 0.31, 1.0):
        assert quality._cut(scored, lose) == pytest.approx(min(best, np.quantile(good, lose)), abs=1e-12)
    assert quality._cut(scored.filter("quality = 1"), 0.002) == -np.inf


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = quality.quality_rules(awkward, labels)
    assert got.count() == len(AWKWARD) and quality.keep_good(awkward, labels).columns == awkward.columns
    assert quality.quality_rules(empty, labels.limit(0)).count() == 0


# licenses


def test_licenses(awkward, empty):
    n, places, found = licenses.scan("Released under the MIT License. See the Apache-License, Version 2.0!\nGNU General Public License, version 3".encode())
    assert n == 18 and [label for _, label in places] == ["mit", "apache", "gpl"] and places[0][0] == 3
    assert {"mit", "apache-2.0", "gpl-3.0"} == {f.label for f in found}
    assert licenses.detect("spdx-license-identifier: bsd-3-clause")[0].form == "tag"
    assert licenses.detect("a mitigating licence to drive, permitted by mit") == []
    # a longer, more trusted detection suppresses those inside it
    assert [f.label for f in licenses.detect("licensed under the apache license, version 2.0")] == ["apache-2.0"]
    assert len(licenses.rules()) > 300
    got = licenses.license_scan(awkward)
    assert got.count() == len(AWKWARD) and got.filter("n_base = 0 and first_word is not null").count() == 0
    assert licenses.license_scan(empty).count() == 0


def test_licenses_in_comments():
    """Clauses that wrap inside comment blocks, and every id of an SPDX expression."""
    labels = lambda t: sorted(f.label for f in licenses.detect(t))
    for mark in ("// ", " * ", "# ", "> "):
        assert labels(f"{mark}redistribution and use in source and binary forms, with or without\n{mark}modification, are permitted") == ["bsd"]
        assert labels(f"{mark}permission is hereby granted, free of charge, to any person obtaining a copy\n{mark}of this software") == ["mit"]
    tag = "spdx-license-identifier: "
    assert labels(tag + "mit or apache-2.0") == ["apache-2.0", "mit"] and labels(tag + "mit\nor apache-2.0") == ["mit"]
    assert labels(tag + "(mit or apache-2.0) and bsd-3-clause\n") == ["apache-2.0", "bsd-3-clause", "mit"]
    assert [f.form for f in licenses.detect(tag + "gpl-2.0-only with classpath-exception-2.0 or mit")] == ["tag", "tag"]


def test_licenses_gaps_and_overlaps():
    """Gaps of any length, whole words, containment (not overlap) suppresses, and every rule compiles with a gate its regex implies."""
    labels = lambda t: sorted({f.label for f in licenses.detect(t)})
    assert labels("apache license,\n" + " " * 17 + "version 2.0") == ["apache-2.0"] == labels("apache license,\n *\n *\n" + " *   \n" * 40 + " * version 2.0")
    assert labels("see the bsd license") == ["bsd"] and labels("spdx-license-identifier: " + "mit or " * 60 + "isc") == ["isc", "mit"]
    assert labels("licensed under gplv2+") == ["gpl-2.0"] and labels("a gplv2x, an limit licensee, emit license") == []
    assert labels("spdx-license-identifier: (x11 or creativeml-openrail)") == ["mit", "openrail-m"]
    # 'mit license' and 'license, apache 2.0 license' overlap in one word: both stay
    both = licenses.detect("the mit license apache 2.0 license")
    assert {"mit", "apache-2.0"} == {f.label for f in both}
    for f in both:
        assert not any(g is not f and g.start <= f.start and f.end <= g.end and licenses.FORMS[g.form] >= licenses.FORMS[f.form] for g in both)
    assert len({r.label for r in licenses.rules()}) > 100 and all(r.keywords for r in licenses.rules())


def test_licenses_base_places(spark, docs, duck):
    """Base places of all documents, found again by SQL over their words."""
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(docs).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    hits = " UNION ALL ".join(f"SELECT doc_id, w, i, '{label}' AS label FROM p WHERE w[i + 1:i + {len(p)}] = {p}" for label, p in phrases.items())
    sql = f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM t), h AS ({hits}),
        a AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
        SELECT t.doc_id, len(t.w), coalesce(n, 0), lo, hi, coalesce(labels, '') FROM t LEFT JOIN a USING (doc_id)"""
    assert got == {r[0]: r[1:] for r in duck.execute(sql).fetchall()}


# personal data


def independent_values(text):
    """Values with their kinds by another way than the operator's: candidates cut from runs of allowed characters, checked by their own rules."""
    out = set()
    for m in re.finditer(r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(int(c) for c in reversed(d)))
        if total % 10 == 0 and len(set(d)) > 1:
            out.add(("card", m[0]))
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9]|-[0-9])", text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            out.add(("ssn", m[0]))
    for m in re.finditer(r"(?<![0-9A-Za-z_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", text):
        if all(str(int(p)) == p and int(p) < 256 for p in m[0].split(".")):
            out.add(("ip", m[0]))
    for m in re.finditer(r"(?<![0-9./-])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9]|[./-][0-9])", text):
        days = [31, 29 if int(m[1]) % 4 == 0 and (int(m[1]) % 100 or int(m[1]) % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        if 1900 <= int(m[1]) < 2100 and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= days[int(m[2]) - 1]:
            out.add(("date", m[0]))
    for m in re.finditer(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9][A-Za-z0-9_.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+", text):
        out.add(("email", m[0]))
    return out


def test_pseudonyms_against_an_independent_finder(docs):
    """Over all documents: every value that another finder holds valid is replaced by a value of its format, equal ones alike, different ones differently."""
    made, kinds = {}, collections.Counter()
    for r in docs.collect():
        out, found = pii.pseudonymise(r.text)
        spans = {(k, r.text[a:b]) for k, a, b in found}
        held = independent_values(r.text)
        assert {v for k, v in held if not any(v in w for _, w in spans)} == set(), r.doc_id
        kinds.update(k for k, _ in held)
        shift = 0
        for k, a, b in found:
            was, new = r.text[a:b], out[a + shift : b + shift]
            assert len(new) == len(was) or k == "ip"
            shift += len(new) - len(was) if k != "ip" else 0
            if k != "ip":
                assert made.setdefault((k, was), new) == new and (new == was) <= (k == "date")
                assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", was) or k in ("email", "secret", "iban")
            else:
                new = re.match(r"[0-9.]*[0-9]", out[a + shift :])[0]
                assert made.setdefault((k, was), new) == new
                shift += len(new) - len(was)
            assert (k, new) in independent_values(f" {new} ") or k in ("phone", "secret", "iban") or (k, new[-4:]) == (k, was[-4:]) or k == "date"
    assert len(set(made.values())) == len(made) and len(kinds) >= 3


def test_every_date_inverts():
    """All dates of two centuries, in each way of writing them."""
    from datetime import date, timedelta

    day, seen = date(1900, 1, 1), collections.defaultdict(set)
    while day.year < 2100:
        for k, form in enumerate(("%Y-%m-%d", "%d/%m/%Y", "%m.%d.%Y")):
            was = day.strftime(form)
            (new,) = [pii.pseudonymise(was)[0]]
            assert pii.pseudonymise(new, back=True)[0] == was
            seen[k].add((was, new))
        day += timedelta(days=3)
    for pairs in seen.values():
        assert len({n for _, n in pairs}) == len({w for w, _ in pairs})


def test_feistel():
    for size in (2, 3, 10, 97, 1000):
        got = {pii.permute(x, size, b"k", "t") for x in range(size)}
        assert got == set(range(size))
        assert all(pii.permute(pii.permute(x, size, b"k", "t"), size, b"k", "t", back=True) == x for x in range(size))


def test_pseudonyms(docs, awkward, empty):
    text = "card 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00, born 1980-02-29, ssn 123-45-6789, ip 192.168.0.1, tel +1 (212) 555-7713, mail a.b@x.example.com"
    out, found = pii.pseudonymise(text)
    assert [k for k, _, _ in found] == ["card", "iban", "date", "ssn", "ip", "phone", "email"]
    assert all(text[a:b] not in out for _, a, b in found) and re.sub(r"[\d]", "0", out[:24]) == "card 0000 0000 0000 0000"
    assert pii.luhn_digit("".join(ch for ch in out[5:24] if ch.isdigit())[:-1]) == out[23]
    assert pii.pseudonymise(out, back=True)[0] == text
    assert pii.pseudonymise("order 4111 1111 1111 1112 of 2024-02-30 at 300.1.1.1, v1.2.3.4") == ("order 4111 1111 1111 1112 of 2024-02-30 at 300.1.1.1, v1.2.3.4", [])
    got = pii.feistel_pseudonyms(docs).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect()
    for r in got:
        assert r.text == pii.pseudonymise(r.was)[0] and r.changed == (r.n_found > 0) and (r.changed or r.text == r.was)
    assert pii.feistel_pseudonyms(awkward).count() == len(AWKWARD) and pii.feistel_pseudonyms(empty).count() == 0


def test_pseudonyms_run_on():
    """Valid values followed or led by more groups, common phone forms, and dates of either order."""
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    held = [(f"card {card} 12/25", card), (f"order 12 {card}", card), ("4111111111111111 12 25", "4111111111111111"), (f"{card}-12345678", card), (f"2024-01-02 {card} 2024-01-02", card)]
    held += [(f"{iban} EUR", iban), (f"{iban} BIC COBADEFF", iban), ("DE89370400440532013000 AND", "DE89370400440532013000"), (f"AB12 {iban}", iban)]
    held += [("call 1-800-555-0199 now", "1-800-555-0199"), ("or 555 123 4567.", "555 123 4567"), ("tel 01 23 45 67 89", "01 23 45 67 89")]
    for text, value in held:
        out, found = pii.pseudonymise(text)
        assert value in [text[a:b] for _, a, b in found] and value not in out and len(out) == len(text)
        assert pii.pseudonymise(out, back=True)[0] == text
    assert pii.pseudonymise(f"{card} 12/25")[0][:19] == pii.pseudonymise(card)[0] and pii.pseudonymise(f"{iban} EUR")[0][:27] == pii.pseudonymise(iban)[0]
    dates = [f"{a:02d}/{b:02d}/{y}" for y in range(1900, 2100, 7) for a in range(1, 32) for b in range(1, 32)]
    made = {t: pii.pseudonymise(t)[0] for t in dates if pii.pseudonymise(t)[1]}
    assert len(set(made.values())) == len(made) and any(int(t[3:5]) > 12 for t in made)
    assert all(pii.pseudonymise(new, back=True)[0] == t for t, new in made.items())


# compaction


def test_compaction(spark, docs, awkward):
    store = compaction.ShardStore(spark, new_path(spark, "store"))
    for k in range(5):
        store.append(docs.filter(F.col("doc_id") % 5 == k), rows_per_shard=10)
    before = store.manifest()
    assert store.version() == 5 and sum(s.rows for s in before["shards"]) == docs.count()
    store.compact(target=200_000)
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) and all(len(x) < compaction.FANOUT for x in store.tiers(after["shards"], 200_000).values())
    key = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    assert key(store.read()) == key(docs) == key(store.read(5))
    assert store.vacuum() == 0  # too young: another writer may still list them
    assert store.vacuum(older_than_s=0) > 0 and key(store.read()) == key(docs)
    with pytest.raises(compaction.CommitConflict):
        store.commit(1, [], "{}")
    # a crash between writing and committing: nothing is seen of it, and it is cleared away
    stray = store._write(docs, 50)
    assert key(store.read()) == key(docs) and store.vacuum(older_than_s=0) == len(stray) and key(store.read()) == key(docs)
    other = compaction.ShardStore(spark, new_path(spark, "store"))
    other.append(awkward)
    other.compact()
    assert other.read().count() == len(AWKWARD) and other.read().columns == awkward.columns


def test_compaction_two_writers(spark, docs, monkeypatch):
    """Of writers that commit one version at once, one succeeds, the others learn of it; a dead writer's claim is taken over."""
    from concurrent.futures import ThreadPoolExecutor

    root = new_path(spark, "store")
    compaction.ShardStore(spark, root).append(docs.limit(3))

    def attempt(k):
        store = compaction.ShardStore(spark, root)
        try:
            return store.commit(1, [compaction.Shard(f"writer-{k}", k, k)], "{}")
        except compaction.CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(attempt, range(8)))
    assert sorted(x for x in got if x) == [2] and compaction.ShardStore(spark, root).manifest()["shards"][0].path == f"writer-{got.index(2)}"
    store = compaction.ShardStore(spark, root)
    store._fs.create(store._path(f"{root}/_manifest/{3:020d}.claim"), False).close()
    with pytest.raises(compaction.CommitConflict):
        store.commit(2, [], "{}")
    monkeypatch.setattr(compaction, "CLAIM_SECONDS", -1)
    assert store.commit(2, [], "{}") == 3


def test_compaction_empty(spark, empty):
    store = compaction.ShardStore(spark, new_path(spark, "store"))
    assert store.append(empty) == 1 and store.compact() == [] and store.read().count() == 0 and store.read().columns == empty.columns
