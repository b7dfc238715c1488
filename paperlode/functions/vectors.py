"""Column expressions on ``array<float>`` vectors. Products are taken in double."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2sq(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _sum(F.zip_with(a, b, square))


def l2_normalize(a: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    scaled = F.transform(
        F.array(F.struct(a.alias("v"), norm(a).alias("n"))),
        lambda p: F.transform(
            p["v"],
            lambda x: F.when(p["n"] > 0, x.cast("double") / p["n"]).otherwise(x.cast("double")),
        ),
    )
    return F.element_at(scaled, 1)


def relevance(distance: Column) -> Column:
    """Relevance of a squared L2 distance between unit vectors."""
    return F.lit(1.0) - distance / F.lit(math.sqrt(2.0))
