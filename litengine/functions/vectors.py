"""Vector and score functions as column expressions; vectors are arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_of_units(a: Column, b: Column) -> Column:
    """MTH1: the dot product of unit vectors; vectors of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """MTH2: 0 where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    """MTH3: a vector without length stays as it is."""
    # The length goes in as an array, so that it is worked out once and not for every component.
    length = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, length, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def score_of_distance(d: Column) -> Column:
    """MTH4."""
    return F.round(1 / (1 + F.greatest(F.lit(0.0), d)), 6)


def relevance(raw: Column) -> Column:
    """MTH5: an eighth of a raw score, at most 1, to three places."""
    return F.least(F.lit(1.0), F.bround(raw / 8, 3))


def relevance_label(x: Column) -> Column:
    """MTH5: high from 0.65, medium from 0.35."""
    return F.when(x >= 0.65, "high").when(x >= 0.35, "medium").otherwise("low")


def clamp(x: Column) -> Column:
    """MTH6."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def distance_label(d: Column) -> Column:
    """MTH7."""
    return F.when(d <= 0.70, "high").when(d <= 0.95, "medium").otherwise("low")
