"""Evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def character_error_rate(hypothesis: Column | str, reference: Column | str) -> Column:
    """Edit distance over the length of the reference; null for an empty reference."""
    return F.levenshtein(hypothesis, reference) / F.nullif(F.length(reference), F.lit(0))


def mean_without_nan(x: Column | str) -> Column:
    return F.avg(F.nanvl(x, F.lit(None).cast("double")))


def flow_magnitude(x: Column | str, y: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.avg(F.sqrt(x * x + y * y))


def straightness(position: Column | str) -> Column:
    """Deviation of the points of a line."""
    return F.stddev_pop(position)


#: Weights of the five scales of structural similarity.
SCALE_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def multi_scale_similarity(scales: Column | str) -> Column:
    """Weighted sum over an array of five similarities."""
    out = F.lit(0.0)
    for i, w in enumerate(SCALE_WEIGHTS):
        out = out + F.get(scales, F.lit(i)) * w
    return out
