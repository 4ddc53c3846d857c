"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are rounded here before they are ordered, so that the order does not
#: depend on how a sum happened to be blocked; ties are then decided by id.
SCORE_DIGITS = 9


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(as_double(vector), lambda x: x / norm)).otherwise(as_double(vector))


def shorten(vector: Column, dimensions: int) -> Column:
    """Fewer output dimensions: keep the leading ones and scale to length one again."""
    return unit(F.slice(vector, 1, dimensions))
