"""Vector expressions on ``array<float>`` columns. Sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earmark.functions.keys import as_col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column | str, floor: float | None = None) -> Column:
    """Vector of length 1. A zero vector stays zero, or is divided by ``floor`` where one is given."""
    length = norm(a)
    divisor = F.greatest(length, F.lit(floor)) if floor is not None else F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(as_col(a), lambda x: x.cast("double") / divisor)


def cosine(a: Column | str, b: Column | str, floor: float = 1e-8) -> Column:
    """Cosine similarity; lengths are clamped from below so that zero vectors give 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    deltas = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(deltas, F.lit(0.0), lambda acc, x: acc + x * x)
