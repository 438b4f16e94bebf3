"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Documents are sets of 64-bit fingerprints of their distinct five-word shingles. All links (Jaccard of 0.75 or more) are found,
and the components they form, without comparing all pairs:

1. Equal texts are one set: a task sends each text once, and what several tasks send is joined where it is counted. A
   text is known by 64 bits that a second 64-bit hash has shown to belong to it alone.
2. One exchange of packed shingles counts in how many sets each occurs. A set of which under 75% occurs elsewhere can't link;
   the others (few) keep their shared shingles, a hashed bitmap and a prefix: sorted from rare to frequent, two linking
   sets share a shingle within the first quarter (prefix filter with exact frequencies). Frequencies only choose candidates:
   what links is decided by the fingerprints of the two sets alone, where a chance meeting in 20,000 shingles each has odds of 2e-11.
3. Sets that share a prefix shingle are compared with the smallest of them, then, where they are still in several components,
   with one set of the largest, a few turns: as many comparisons as members. Links form components.
4. What is still apart makes tiles by largest component and size band: the sets outside it against all of its shingles'
   sets. Bit counts bound the overlap from above; what passes is intersected exactly.

Pairs inside a component are never compared again, so thousands of near copies cost thousands of comparisons, not their
square, and no link between different components is missed. Joins by shingle use another key than the aggregates beside them,
so both sides are exchanged for the join and adaptive execution can split a frequent shingle's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import checkpoint, discard, stored_at, sweep, text_of
from loomspan.llm.components import components
from loomspan.llm.packed import combine, narrow, pack, release, runs, shard_of, texts_of, unpack, widen, words

GRAM = 5
#: A link: LINK_OF * intersection >= LINK * union.
LINK, LINK_OF = 75, 100
BITMAP_BYTES = 128
TILE = 1024
#: Turns of comparing with one set of the largest component before the tiles; they only save work.
TURNS = 1
BYTES_PER_SHARD = 6 << 20


def shingles(texts: list[bytes], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of each text and their text's number, sorted by both."""
    doc, word = words([t.lower() for t in texts])
    n = np.bincount(doc, minlength=len(texts))
    i = np.arange(max(0, len(doc) - gram + 1))
    i = i[doc[i] == doc[i + gram - 1]] if len(i) else i
    keys, owner = [combine(*(word[i + k] for k in range(gram)))], [doc[i]]
    begin = np.cumsum(n) - n
    for few in range(1, gram):  # a text of fewer words is one shingle of all of them
        some = np.flatnonzero(n == few)
        keys.append(combine(*(word[begin[some] + k] for k in range(few))))
        owner.append(some)
    key, at = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return key[new], at[new]


def _spread(shards: int):
    """Rows (rid, text) -> packed shingles by shard, a few MB of text at a time; the sizes in shards below 0, as many of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * 7919
        sent: set[int] = set()  # of this task: equal texts go once
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            fresh = [i for i in np.sort(first).tolist() if batch.column(0)[i].as_py() not in sent]
            batch = batch.take(pa.array(fresh, pa.int64()))
            ids = batch.column(0).to_numpy()
            sent.update(ids.tolist())
            for a, b, texts in texts_of(batch.column(1)):
                keys, owner = shingles(texts)
                rid, size = ids[a:b], np.bincount(owner, minlength=b - a).astype(np.uint32)
                out = [(-1 - number % shards, pack(rid, size))]
                number += 1
                # shards are ranges of the fingerprint, so each is a slice of the sorted shingles
                for s, i, j in runs(shard_of(keys, shards)):
                    here, o = np.unique(owner[i:j], return_inverse=True)
                    out.append((s, pack(np.diff(keys[i:j], prepend=np.uint64(0)), narrow(o), rid[here], size[here])))
                yield pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["shard", "cell"])

    return run


def _shared(buckets: int):
    """Packed shingles of a shard -> those that occur in several sets, packed by the set's bucket."""

    def run(table: pa.Table) -> pa.Table:
        release()
        cells = table.column("cell").to_pylist()
        if table.column("shard")[0].as_py() < 0:
            return pa.table({"bucket": pa.array([-1] * len(cells), pa.int32()), "cell": pa.array(cells, pa.binary())})
        keys, owner, size = [], [], []
        for raw in cells:
            k, o, rid, n = unpack(raw)
            o = widen(o, len(k))
            keys.append(np.cumsum(k, dtype=np.uint64))
            owner.append(rid[o])
            size.append(n[o])
        del cells
        k, o, n = np.concatenate(keys), np.concatenate(owner), np.concatenate(size)
        del keys, owner, size
        order = np.argsort(k, kind="stable")
        k, o, n = k[order], o[order], n[order]
        again = k[1:] == k[:-1]
        several = np.append(again, False) | np.insert(again, 0, False) if len(k) else np.empty(0, bool)
        k, o, n = k[several], o[several], n[several]
        # a set that several tasks sent counts once
        order = np.lexsort((o, k))
        k, o, n = k[order], o[order], n[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o, n = k[new], o[new], n[new]
        count = np.diff(np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))) if len(k) else np.empty(0, np.int64)
        df = np.repeat(count, count)
        many = df > 1
        k, o, n, df = k[many], o[many], n[many], df[many].astype(np.uint32)
        bucket = (o.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((k, bucket))
        k, o, n, df, bucket = k[order], o[order], n[order], df[order], bucket[order]
        out = []
        for b, i, j in runs(bucket):
            here, first, index = np.unique(o[i:j], return_index=True, return_inverse=True)
            out.append((b, pack(np.diff(k[i:j], prepend=np.uint64(0)), narrow(index), here, n[i:j][first], df[i:j])))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "cell": pa.array([c for _, c in out], pa.binary())})

    return run


def bitmap(keys: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP_BYTES * 8, dtype=np.uint8)
    bits[(keys >> np.uint64(19)) % np.uint64(BITMAP_BYTES * 8)] = 1
    return np.packbits(bits).tobytes()


def prefix_length(n: int) -> int:
    """Among the first this many shingles (of n) in a global order lies one of any linking set."""
    return n - -(-LINK * n // LINK_OF) + 1


def _survivors(table: pa.Table) -> pa.Table:
    """Sets of a bucket that may link: rid, n, keys (sorted), bits, prefix."""
    release()
    keys, owner, size, df = [], [], [], []
    for raw in table.column("cell").to_pylist():
        k, o, rid, n, d = unpack(raw)
        o = widen(o, len(k))
        keys.append(np.cumsum(k, dtype=np.uint64))
        owner.append(rid[o])
        size.append(n[o])
        df.append(d)
    k, o, n, d = (np.concatenate(x) for x in (keys, owner, size, df))
    order = np.lexsort((k, o))
    k, o, n, d = k[order], o[order], n[order], d[order]
    start = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    end = np.append(start[1:], len(o))
    rows: dict[str, list] = {"rid": [], "n": [], "keys": [], "bits": [], "prefix": []}
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        total = int(n[a])
        if LINK_OF * (b - a) >= LINK * total:
            own = k[a:b]
            # shingles of this set alone come first in the order and need no place
            some = np.lexsort((own, d[a:b]))[: prefix_length(total) - (total - (b - a))]
            rows["rid"].append(int(o[a]))
            rows["n"].append(total)
            rows["keys"].append(own.tobytes())
            rows["bits"].append(bitmap(own))
            rows["prefix"].append(own[some].view(np.int64))
    return pa.table({"rid": pa.array(rows["rid"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "keys": pa.array(rows["keys"], pa.binary()), "bits": pa.array(rows["bits"], pa.binary()), "prefix": pa.array(rows["prefix"], pa.list_(pa.int64()))})


def links(n_a: int, n_b: int, both: int) -> bool:
    return LINK_OF * both >= LINK * (n_a + n_b - both)


def bound(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, lone_a: np.ndarray, lone_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: a bit of one that the other lacks is a shingle that it lacks. lone: unshared shingles."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - lone_a - only_a, n_b - lone_b - only_b)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets -> pairs that link."""
    for batch in batches:
        c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        a, b = [], []
        for ra, rb, na, nb, ka, kb, ba, bb in zip(*(c[x].to_pylist() for x in ("a", "b", "n_a", "n_b", "keys_a", "keys_b", "bits_a", "bits_b")), strict=True):
            ka, kb = np.frombuffer(ka, np.uint64), np.frombuffer(kb, np.uint64)
            most = bound(np.frombuffer(ba, np.uint64), np.frombuffer(bb, np.uint64), na, nb, na - len(ka), nb - len(kb))
            if links(na, nb, int(most)) and links(na, nb, len(np.intersect1d(ka, kb, assume_unique=True))):
                a.append(ra)
                b.append(rb)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that link."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a long, b long")


def _tile(table: pa.Table) -> pa.Table:
    """Outside sets against the sets of one tile: pairs of different components whose bound links."""
    c = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("rid", "n", "lone", "comp", "out")}
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(c["rid"]), -1)
    left, right = np.flatnonzero(c["out"]), np.flatnonzero(~c["out"])
    found = []
    for i in left:
        n, m = c["n"][i], c["n"][right]
        near = right[(c["comp"][right] != c["comp"][i]) & (LINK_OF * np.minimum(n, m) >= LINK * np.maximum(n, m))]
        if len(near):
            most = bound(bits[i], bits[near], n, c["n"][near], c["lone"][i], c["lone"][near])
            near = near[LINK_OF * most >= LINK * (n + c["n"][near] - most)]
            found += [(min(c["rid"][i], r), max(c["rid"][i], r)) for r in c["rid"][near]]
    found = sorted(set(found))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _by_token(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows joined with one row a token, by a key that stands for the token but isn't the one that ``groups`` was grouped by."""
    key = F.col("token").bitwiseXOR(F.lit(0x5DEECE66D)).alias("_key")
    return rows.select("*", key).join(groups.select(key, *[c for c in groups.columns if c != "token"]), "_key").drop("_key")


def _grouped(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (token, rid) of shingles whose sets are in several components: with comp, and main, the largest one."""
    at = checkpoint(rows.join(comp.select(F.col("node").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid")))
    parts = at.groupBy("token", "comp").agg(F.count("*").alias("m"))
    groups = parts.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("m", "comp")).alias("most"))
    return checkpoint(_by_token(at, groups.filter("comps > 1").select("token", F.col("most.comp").alias("main"))))


def _stars(grouped: DataFrame, comp: DataFrame, turn: int) -> DataFrame:
    """Pairs of the sets outside a largest component with one set of it, another one in each turn."""
    mains = grouped.select("main").distinct()
    inside = comp.join(mains, comp["comp"] == mains["main"], "left_semi").groupBy("comp").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("c"))
    alone = mains.join(comp, mains["main"] == comp["comp"], "left_anti").select(F.col("main").alias("comp"), F.col("main").alias("node"))
    centre = inside.select("comp", "c.node").unionByName(alone).select(F.col("comp").alias("main"), "node")
    pairs = grouped.filter("comp <> main").select("rid", "main").distinct().join(centre, "main")
    return pairs.select(F.least("rid", "node").alias("a"), F.greatest("rid", "node").alias("b")).distinct()


def _across(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs between components: tiles by main component and size band."""
    members = grouped.groupBy("main", "rid").agg(F.first("comp").alias("comp"))
    members = checkpoint(members.join(sets.select("rid", "n", "bits", (F.col("n") - F.octet_length("keys") / 8).cast("long").alias("lone")), "rid"))
    # sets of linking sizes are in the same or the next band: a band spans the least size ratio
    members = members.withColumn("band", F.floor(F.log(F.col("n")) / F.lit(math.log(LINK_OF / LINK)) + F.lit(1e-9)).cast("int"))
    count = members.groupBy("main").agg(F.count("*").alias("members"), F.count_if(F.col("comp") != F.col("main")).alias("outside"))
    members = members.join(count, "main")
    # tile (i, j) of a band: the i-th run of outside sets against the j-th run of all; rows are dealt to runs by hash
    i = F.pmod(F.xxhash64("rid"), F.ceil(F.col("outside") / TILE)).cast("int")
    j = F.pmod(F.xxhash64("rid", F.lit(1)), F.ceil(F.col("members") / TILE)).cast("int")
    last = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / TILE) - 1).cast("int"))
    keep = ["main", "rid", "n", "bits", "lone", "comp"]
    outside = members.filter("comp <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    outside = outside.select(*keep, "band", F.lit(True).alias("out"), i.alias("i"), F.explode(last("members")).alias("j"))
    every = members.select(*keep, "band", F.lit(False).alias("out"), F.explode(last("outside")).alias("i"), j.alias("j"))
    # one key of their own for the tiles, so that those of one component are dealt over the tasks, not all to the one of its number
    tiles = outside.unionByName(every).withColumn("tile", F.concat_ws("|", "main", "band", "i", "j"))
    return tiles.groupBy("tile").applyInArrow(_tile, "a long, b long").distinct()


def _known_by(base: DataFrame, bits: int = 64) -> Column:
    """A column that is one number for each different text: a 64-bit hash, salted where two texts share it.

    Found by a second 64-bit hash; in n texts n^2 / 2^65 of them are expected to share one (24 in 30 billion), so the list
    of those numbers is short. ``bits`` narrows the hash; only tests lower it, to force shared numbers.
    """
    first = F.xxhash64("text") if bits == 64 else F.pmod(F.xxhash64("text"), F.lit(1 << bits))
    second = F.xxhash64(F.lit(1), F.col("text"))
    clash = base.select(first.alias("h"), second.alias("s")).groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a <> b")
    shared = [r.h for r in clash.select("h").collect()]
    return F.when(first.isin(shared), F.xxhash64(second, F.col("text"))).otherwise(first) if shared else first


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: one row per input row - id, n_shingles, component_id (smallest id reachable by links, itself included),
    rid (class of equal texts). links: pairs of classes (a, b) that were compared and link; they span every component.
    A null text counts as empty; a text without words has no shingles, links with nothing and is its own component.
    Repeated rows are copies of each other. A component of null ids only has a null component_id. Texts and words may have any
    length; other columns are ignored. An empty table gives two empty frames. ``hash_bits`` is for tests.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out, edges = _classes(base, _known_by(base, hash_bits))
    return out.drop("comp"), edges


def _classes(base: DataFrame, known_by: Column) -> tuple[DataFrame, DataFrame]:
    """jaccard_join of rows (id, text); documents with comp, the smallest class of the component, too."""
    spark = base.sparkSession
    rid = known_by.alias("rid")
    ids = base.select("id", rid)
    volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(volume) // BYTES_PER_SHARD))
    spread = base.select(rid, "text").mapInArrow(_spread(shards), "shard int, cell binary")
    shared, shared_path = stored_at(spread.groupBy("shard").applyInArrow(_shared(shards), "bucket int, cell binary"), "shared")
    sizes = checkpoint(shared.filter("bucket < 0").mapInArrow(_sizes, "rid long, n long").distinct())
    sets, sets_path = stored_at(shared.filter("bucket >= 0").groupBy("bucket").applyInArrow(_survivors, "rid long, n long, keys binary, bits binary, prefix array<long>"), "sets")
    discard(spark, shared_path)
    sweep(spark)

    rows = sets.select(F.explode("prefix").alias("token"), "rid", "n")
    centre = rows.groupBy("token").agg(F.min(F.struct("n", "rid")).alias("c"), F.count("*").alias("m")).filter("m > 1").select("token", F.col("c.n").alias("n_c"), F.col("c.rid").alias("a"))
    stars = _by_token(rows, centre).filter((F.col("a") != F.col("rid")) & (LINK_OF * F.col("n_c") >= LINK * F.col("n"))).select("a", F.col("rid").alias("b")).distinct()
    edges = checkpoint(_linked(stars, sets))
    comp = components(edges)
    left = rows
    for turn in range(TURNS):
        left = _grouped(left.select("token", "rid", "n"), comp)
        if left.isEmpty():
            break
        edges = checkpoint(edges.unionByName(_linked(_stars(left, comp, turn), sets)))
        comp = components(edges)
    left = _grouped(left.select("token", "rid", "n"), comp)
    if not left.isEmpty():
        edges = checkpoint(edges.unionByName(_linked(_across(left, sets), sets)))
        comp = components(edges)
    discard(spark, sets_path)  # all links are in the checkpoint of edges
    sweep(spark)
    placed = ids.groupBy("rid").agg(F.min("id").alias("least")).join(sizes, "rid").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    placed = checkpoint(placed)
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = checkpoint(placed.join(least, "comp").select("rid", "n", "comp", "component_id"))
    out = ids.join(placed, "rid").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "rid", "comp")
    return out, edges


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("cell").to_pylist():
            rid, n = unpack(raw)
            yield pa.record_batch([pa.array(rid), pa.array(n.astype(np.int64))], names=["rid", "n"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that of the smallest id (where that id has several texts or rows, one of them); rows
    without words all stay. A null id is never the smallest, unless all of a component are null. All columns are kept, whatever
    their names; an empty table stays empty.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rid = _known_by(base)
    out, _ = _classes(base, rid)
    # a null id and an empty string are different ids
    one = lambda i, r: F.concat_ws("|", i.isNull().cast("string"), F.coalesce(i.cast("string"), F.lit("")), r.cast("string"))
    best = out.filter("n_shingles > 0 and id <=> component_id").groupBy("comp").agg(F.first("id").alias("id"), F.min("rid").alias("rid")).select("id", "rid", F.lit(1).alias("n_shingles"))
    kept = best.unionByName(out.filter("n_shingles = 0").select("id", "rid", F.lit(0).alias("n_shingles")).distinct())
    kept = kept.select(one(F.col("id"), F.col("rid")).alias("_key"), "n_shingles")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col(id_col).alias("id"), text_of(text_col).alias("text")).alias("t"))
    row = row.select("row", F.col("t.id").alias("id"), F.col("t.text").alias("text")).select("row", one(F.col("id"), rid).alias("_key"))
    row = row.join(kept, "_key")
    alone = row.filter("n_shingles > 0").dropDuplicates(["_key"]).unionByName(row.filter("n_shingles = 0"))
    return alone.select("row.*")
