"""Closed forms of ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earmark.functions.keys import as_col


def discount(rank: Column | str) -> Column:
    """1 / log2(rank + 1), ranks counted from 1."""
    return F.lit(1.0) / F.log2(as_col(rank) + F.lit(1.0))


def gain(relevance: Column | str) -> Column:
    return F.pow(F.lit(2.0), as_col(relevance).cast("double")) - F.lit(1.0)


def discount_sum(n: Column | str) -> Column:
    """Sum of the discounts of ranks 1..n; 0 for n below 1. ``n`` is a cut-off, so the array is short."""
    n = as_col(n).cast("int")
    ranks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, i: acc + discount(i))


def binary_ndcg(dcg: Column | str, k_eff: Column | str, n_positive: Column | str) -> Column:
    """nDCG for 0/1 relevance. The ideal ranking needs only the number of positives of the whole pool."""
    ideal = discount_sum(F.least(as_col(k_eff), as_col(n_positive)))
    return F.when(ideal > 0, as_col(dcg) / ideal).otherwise(F.lit(0.0))


def random_ndcg(mean_gain: Column | str, k_eff: Column | str, ideal: Column | str) -> Column:
    """Expected nDCG of a uniformly random ranking: every position has the mean gain of the pool."""
    ideal = as_col(ideal)
    return F.when(ideal > 0, as_col(mean_gain) * discount_sum(k_eff) / ideal).otherwise(F.lit(0.0))


def random_hit(n_pool: Column | str, n_positive: Column | str, k: Column | str) -> Column:
    """Chance that a random top-k holds a positive: 1 - C(n-r, k) / C(n, k), with its edge cases."""
    n, r = as_col(n_pool).cast("long"), as_col(n_positive).cast("long")
    k_eff = F.least(as_col(k).cast("long"), n)
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(k_eff - 1, F.lit(0).cast("long")))
    misses = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * ((n - r - i) / (n - i)))
    return (
        F.when((n <= 0) | (as_col(k) <= 0) | (r <= 0), F.lit(0.0))
        .when((r >= n) | (k_eff > n - r), F.lit(1.0))
        .otherwise(F.lit(1.0) - misses)
    )
