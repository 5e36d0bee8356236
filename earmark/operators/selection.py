"""The n smallest rows by value, found from counts over ranges of the value; no row is moved.

Each pass counts the rows of ``BINS`` equal ranges between the least and the greatest value still in question and goes on with the
range that holds the n-th row. A range number never falls as the value rises, so it is a prefix of the order. What comes back is a
cut-off (value, and a key among equal values), and rows are filtered where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.operators.ordering import LIMIT_IN_ONE_TASK, with_position

BINS = 4096
_WHOLE = object()


@dataclass(frozen=True)
class Cut:
    """Rows at or below (value, key) in the order of (value, key). ``kind``: null, -inf, finite, inf or nan, in this order."""

    kind: str
    value: float | None
    key: object
    n: int
    n_all: int
    mean: float | None
    mean_all: float | None

    def condition(self, value: str, key: str) -> Column:
        v, k = F.col(value).cast("double"), F.col(key)
        same = v.isNull() if self.kind == "null" else v == F.lit(self.value)
        if self.key is None:
            same = same & k.isNull()
        elif self.key is not _WHOLE:
            same = same & (k.isNull() | (k <= F.lit(self.key)))
        below = F.lit(False) if self.kind == "null" else v.isNull() | (v < F.lit(self.value))
        return F.coalesce(below | same, F.lit(False))


_KINDS = {"null": None, "-inf": -math.inf, "finite": 0.0, "inf": math.inf, "nan": math.nan}


def smallest_cut(rows: DataFrame, value: str, key: str, wanted: Callable[[int], int]) -> Cut | None:
    """Cut-off of the ``wanted(number of rows)`` smallest rows; None for an empty table.

    Null values come first and NaN last, equal values go by ``key``, which is unique. ``rows`` should be a stored table, as there are
    three passes or more, over two columns.
    """
    narrow = rows.select(F.col(value).cast("double").alias("v"), F.col(key).alias("k"))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < math.inf)
    s = narrow.agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("v").isNull()).alias("null"), F.count_if(F.col("v") == -math.inf).alias("-inf"),
        F.count_if(finite).alias("finite"), F.count_if(F.col("v") == math.inf).alias("inf"), F.count_if(F.isnan("v")).alias("nan"),
        F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"), F.sum(F.when(finite, F.col("v"))).alias("sum"), F.avg("v").alias("mean")).first()
    if not s["n_all"]:
        return None
    n = left = max(1, min(wanted(s["n_all"]), s["n_all"]))
    total = 0.0
    for kind, sign in _KINDS.items():
        here = s[kind]
        if here and left <= here:
            break
        left -= here
        total += s["sum"] if kind == "finite" and here else sign * here if here and kind != "null" else 0.0
    if kind == "finite":
        at, at_key, more = _cut_finite(narrow.filter(finite), s["lo"], s["hi"], left)
        total += more
    else:
        at = sign
        own = narrow.filter({"null": F.col("v").isNull(), "nan": F.isnan("v")}.get(kind, F.col("v") == F.lit(sign)))
        at_key = _cut_ties(own, here, left)
        total += sign * left if kind != "null" else 0.0
    known = n - min(n, s["null"])
    return Cut(kind, at, at_key, n, s["n_all"], total / known if known else None, s["mean"])


def _cut_ties(rows: DataFrame, n: int, wanted: int) -> object:
    """The ``wanted``-th smallest key of ``n`` rows with equal values."""
    if wanted >= n:
        return _WHOLE
    keys = rows.select("k")
    if wanted <= LIMIT_IN_ONE_TASK:
        return keys.orderBy("k").limit(wanted).agg(F.max("k")).first()[0]
    return with_position(keys, [], ["k"], "_pos").filter(F.col("_pos") == wanted).first()["k"]


def _cut_finite(rows: DataFrame, lo: float, hi: float, wanted: int) -> tuple[float, object, float]:
    """(value, key, sum of the values at or below them) of the ``wanted``-th smallest row, ``wanted`` 1 at least."""
    total = 0.0
    while True:
        within = rows.filter(F.col("v").between(lo, hi))
        if lo == hi:
            return lo, _cut_ties(within, within.count(), wanted), total + wanted * lo
        # Halves, so that the difference of two finite numbers is finite.
        share = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        ranges = within.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("sum"))
        for r in sorted(ranges.collect(), key=lambda r: r["bin"]):
            if wanted <= r["n"]:
                break
            wanted -= r["n"]
            total += r["sum"]
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= LIMIT_IN_ONE_TASK:
            first = rows.filter(F.col("v").between(lo, hi)).orderBy("v", "k").limit(wanted)
            last = first.agg(F.max(F.struct("v", "k")).alias("m"), F.sum("v").alias("sum")).first()
            return last["m"]["v"], last["m"]["k"], total + last["sum"]
