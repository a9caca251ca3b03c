"""Vector and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions.text import let


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, term))


def cosine(left: Column, right: Column) -> Column:
    """Cosine over positions where the right value is present; 0 for a zero norm; clamped."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.filter(
        F.arrays_zip(F.slice(left, 1, n).alias("l"), F.slice(right, 1, n).alias("r")),
        lambda p: p["r"].isNotNull(),
    )

    def finish(ps: Column) -> Column:
        def total(a: str, b: str) -> Column:
            return _sum(F.transform(ps, lambda p: p[a].cast("double") * p[b].cast("double")))

        norm = F.sqrt(total("l", "l")) * F.sqrt(total("r", "r"))
        return F.when(norm == 0, F.lit(0.0)).otherwise(clamp01(total("l", "r") / norm))

    return let(pairs, finish)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def semantic_score(distance: Column) -> Column:
    """Squared-L2 distance to a score in [0, 1]; an unusable distance counts as 1."""
    d = F.coalesce(distance, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - d / 2.0)


def minimum_semantic_score(max_distance: float = fv.MAX_SEARCH_DISTANCE) -> float:
    return max(0.0, min(1.0, 1.0 - max_distance / 2.0))


def final_top_k(requested: Column, configured: int = fv.FINAL_TOP_K) -> Column:
    return F.greatest(
        F.lit(1), F.least(F.greatest(F.lit(1), requested), F.lit(max(1, configured)))
    )


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.65, F.lit("high"))
        .when(confidence >= 0.40, F.lit("med"))
        .otherwise(F.lit("low"))
    )
