"""Vector expressions over array columns, computed in double precision and in the order of the array."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def finite(a: Column | str) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def unit(a: Column | str) -> Column:
    """Divided by the norm where that is more than 1e-10."""
    n = norm(a)
    return F.when(n > 1e-10, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean(a: Column | str) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def similarity_from_distance(d: Column | str, valid_from: float | None = None) -> Column:
    """1 for a null distance, 1 - d up to 1, else 0. With ``valid_from``, null for distances outside [it, 1]."""
    d = F.col(d) if isinstance(d, str) else d
    inside = d <= 1 if valid_from is None else d.between(valid_from, 1)
    return F.when(d.isNull(), F.lit(1.0)).when(inside, 1 - d).otherwise(F.lit(0.0) if valid_from is None else F.lit(None))
