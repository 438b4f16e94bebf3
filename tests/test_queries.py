"""Every query with SQL against the other engine, on the smallest tables."""

import math

import pytest

from loomspan.plans import more as queries  # all registered queries


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if hasattr(v, "item"):
        return cell(v.item())
    return v


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(str(cell(v)) for v in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    same = rows(got), rows(want)
    fixed = [[tuple(x.removesuffix(".0") for x in r) for r in side] for side in same]
    assert fixed[0] == fixed[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
