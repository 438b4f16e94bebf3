"""Registered queries against SQL, and the pipeline against brute force."""

import collections
import re

import corpus_pipeline
import pytest

from loomspan.llm import exact_dedup, mixing, ngram_join, queries
from tests.llm.test_operators import brute_components


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).fetchdf()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    side = lambda d: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in d[names].astype(object).itertuples(index=False))
    assert side(got) == side(want)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("k", range(4))
def test_stages_on_awkward_rows(spark, sf, k):
    """Nulls, empty texts, repeated rows, clashing column names and an empty table, through every stage that returns documents."""
    name, stage = corpus_pipeline.STAGES[k]
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "a", 1, 2, "x", "k"), (1, long, "a", 1, 2, "x", "k"), (None, long + " more", None, 3, 4, None, "k"), (2, None, "a", 0, 0, "y", "k"), (3, "", "", 0, 0, "y", "k"), (None, "b " * 70, None, 0, 0, "z", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, size int, _key string, rid string")
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= {tuple(r) for r in docs.collect()}
    assert sum(r[1] == long for r in got) <= (3 if name == "source mix" else 2)
    if name == "exact dedup":
        assert len(got) == 4 and sum(not r[1] for r in got) == 1
    if name == "near duplicates":
        assert len(got) == 4 and sum(not r[1] for r in got) == 2 and sum((r[1] or "").startswith("word0") for r in got) == 1
    empty = stage(spark, docs.limit(0), sf)
    assert empty.columns == docs.columns and empty.count() == 0


def test_packing_stage_on_awkward_rows(spark, sf):
    docs = spark.createDataFrame([(1, "a b", "s", "t"), (None, None, None, "t"), (2, "", "s", "t")], "doc_id long, text string, source string, length string")
    out = corpus_pipeline.sequences(spark, docs, sf).collect()
    assert {(r.doc_id, r.doc_tokens) for r in out} == {(1, 3), (None, 1), (2, 1)} and sum(r.length for r in out) == 5
    assert corpus_pipeline.sequences(spark, docs.limit(0), sf).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [f for _, f in corpus_pipeline.STAGES]
    kept = names[0](spark, docs, sf)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    norm = collections.defaultdict(list)
    for i, t in texts.items():
        norm[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    apart = exact_dedup.drop_copies(kept)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(min(x) for x in norm.values())
    rest = [(r.doc_id, r.text) for r in apart.collect()]
    single = ngram_join.drop_near_copies(apart)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in brute_components(rest).values()})
    mixed = mixing.mixed_rows(single)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).toPandas()
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(out.doc_id) == set(times) and out.groupby("sequence_id").length.sum().max() <= 1024
    assert out[out.start == 0].doc_id.value_counts().to_dict() == dict(times)
