"""Scores, thresholds and verdicts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def alphas(pressure: Column, density: Column) -> Column:
    """Factors of the pruning stages; all 1 without pressure."""
    raw = (1 + (1 - pressure) * 2) * (1 - density * 0.5)
    free = pressure >= 1
    pick = lambda x: F.when(free, F.lit(1.0)).otherwise(x)
    return F.struct(
        pick(clamp(F.pow(raw, F.lit(0.3)), 0.8, 1.15)).alias("aom"),
        pick(clamp(1 / raw, 0.4, 1.0)).alias("grouping"),
        pick(clamp(F.pow(raw, F.lit(0.3)), 0.8, 1.5)).alias("rule"),
        pick(clamp(raw, 1.0, 3.0)).alias("budget"),
        pick(clamp(raw, 1.0, 2.0)).alias("compress"),
    )


def effective(score: Column, fitness: Column) -> Column:
    return F.when(fitness.isNull(), score).otherwise(score * (0.7 + 0.3 * fitness))


def tier(reason: Column, fitness: Column, pressure: Column) -> Column:
    """A, B or C of a kept chunk."""
    p = clamp(pressure, 0.0, 1.0)
    a, b, f = 0.8 - 0.15 * p, 0.4 - 0.15 * p, F.coalesce(fitness, F.lit(0.0))
    heading = reason.isin("in_main_heading", "keep_heading_no_main")
    return (
        F.when((reason == "meta_always") | ((reason == "schema_match") & (f >= a * 0.75)) | (f >= a), F.lit("A"))
        .when(heading | (f >= b), F.lit("B"))
        .otherwise(F.lit("C"))
    )


def quality(token_ratio: Column, chunk_ratio: Column, fallback: Column, errors: Column, page_type: Column, grids: Column) -> Column:
    """Extraction quality by page type, three decimals."""
    # Weights of token ratio, chunk ratio, no fallback, no errors, and the most that grids add.
    profiles = {"landing": (0.2, 0.2, 0.1, 0.2, 0.3), "search_results": (0.2, 0.3, 0.15, 0.15, 0.2), "article": (0.35, 0.25, 0.2, 0.2, 0.0)}
    total = lambda t, c, m, e, g: t * token_ratio + c * chunk_ratio + m * (~fallback).cast("double") + e * (~errors).cast("double") + F.least(grids * 0.1, F.lit(g))
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weights in profiles.items():
        out = out.when(page_type == name, total(*weights))
    return F.round(clamp(out.otherwise(total(0.3, 0.3, 0.2, 0.2, 0.0)), 0.0, 1.0), 3)


def confidence(removal: Column, chunk_ratio: Column, chunks: Column, main: Column, missed: Column, page_type: Column) -> Column:
    """How far a pruned page may be trusted, two decimals."""
    best = F.when(page_type == "landing", removal.between(0.1, 0.5)).otherwise(removal.between(0.3, 0.7))
    by_removal = F.when(best, 0.2).when(removal > 0.9, -0.1).when((removal < 0.1) & (chunks > 3), -0.05).otherwise(0.0)
    bonus = F.when(page_type.isin("article", "product_detail") & (chunk_ratio > 0.7), 0.05).otherwise(0.0)
    return F.round(clamp(0.5 + by_removal + chunk_ratio * 0.2 + bonus + F.when(main, 0.1).otherwise(0.0) - 0.05 * missed, 0.0, 1.0), 2)


def change(before: Column, after: Column) -> Column:
    """Severity of a change between two page fingerprints (structs title, dialog, interactives, children, hash)."""
    delta = F.abs(after["interactives"] - before["interactives"])
    many = (delta > 3) | (delta / F.greatest(before["interactives"], F.lit(1)) > 0.2)
    major = ~before["title"].eqNullSafe(after["title"]) | (~before["dialog"] & after["dialog"]) | ((delta > 0) & many)
    minor = (delta > 0) | (before["children"] != after["children"])
    text = before["hash"].isNotNull() & ~before["hash"].eqNullSafe(after["hash"])
    return F.when(before.isNull() | after.isNull(), F.lit("none")).when(major, F.lit("major")).when(minor, F.lit("minor")).when(text, F.lit("content_changed")).otherwise(F.lit("none"))


def template_fits(expected: Column, actual: Column) -> Column:
    """Whether a page still fits its template (structs has_main, source, removal, selection)."""
    near = lambda k: F.abs(expected[k] - actual[k]) <= 0.3
    source = (expected["source"] == "") | (actual["source"] == "") | (expected["source"] == actual["source"])
    return (expected["has_main"] == actual["has_main"]) & source & near("removal") & near("selection")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(F.lit(0.0))
