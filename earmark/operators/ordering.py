"""Ranks, running values and exact cut-offs that never send one group, or all rows, to one task.

A window over a whole table or over one hot key runs in a single task. The operators here place rows by range
over (keys, order) instead. A hot key then covers many placements; each placement is processed on its own and
receives a carry from the placements before it. The carry table has one row per (key, placement).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.functions.keys import as_col, seeded_hash
from earmark.session import pin

PLACEMENT = "_placement"
# Number of range placements; None lets adaptive execution size them.
PLACEMENTS: int | None = None
# Largest n for which ORDER BY ... LIMIT n keeps its heap in one task.
LIMIT_IN_ONE_TASK = 10_000

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join in which null keys match each other, so that rows with a null key are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def place(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and record each row's placement number durably.

    Without a number of partitions, adaptive execution merges small neighbouring ranges; their numbers stay in
    range order.
    """
    partitions = partitions or PLACEMENTS
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return pin(ranged.withColumn(PLACEMENT, F.spark_partition_id()))


def running(
    placed: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    specs: Sequence[tuple[str, str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, max, min or count per key, up to the row (or up to the row before it).

    ``specs`` holds (output name, kind, value). Expects rows from :func:`place` with the same keys and order.
    """
    block = [*keys, PLACEMENT]
    carry_window = Window.partitionBy(*keys).orderBy(PLACEMENT).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*block).agg(*[_AGGREGATES[kind](value).alias(name) for name, kind, value in specs])
    carries = totals.select(
        *block,
        *[
            (F.sum if kind in ("sum", "count") else _AGGREGATES[kind])(name).over(carry_window).alias(f"_carry_{name}")
            for name, kind, _ in specs
        ],
    )
    local_window = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = placed.select("*", *[_AGGREGATES[kind](value).over(local_window).alias(f"_local_{name}") for name, kind, value in specs])
    joined = join_null_safe(local, carries, block)
    combined = []
    for name, kind, _ in specs:
        here, before = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if kind in ("sum", "count"):
            combined.append((F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))).alias(name))
        else:
            combined.append((F.greatest if kind == "max" else F.least)(here, before).alias(name))
    return joined.select(*placed.columns, *combined)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    position: str = "position",
    size: str | None = None,
    keep_placement: bool = False,
) -> DataFrame:
    """1-based position of each row within its key (within the whole table for no keys), and the key's row count.

    ``order`` must be a total order within the key.
    """
    placed = place(df, keys, order)
    out = running(placed, keys, order, [(position, "count", F.lit(1))])
    if size is not None:
        sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
        out = join_null_safe(out, sizes, keys) if keys else out.withColumn(size, sizes.scalar())
    return out if keep_placement else out.drop(PLACEMENT)


def smallest(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Exactly the first ``n`` rows in ``order`` (a total order)."""
    if n <= LIMIT_IN_ONE_TASK:
        return df.orderBy(*order).limit(max(n, 0))
    return with_position(df, [], order, "_pos").filter(F.col("_pos") <= n).drop("_pos")


def hash_position(df: DataFrame, key: str, seed: int, position: str = "position", weight: Column | None = None) -> DataFrame:
    """Running weight (row count by default) of unique keys in seeded hash order, this row included.

    The digest is uniform, so its first four hex digits split the keys into 65,536 even buckets; only the
    bucket totals are added up in order. Needs no checkpoint.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    hashed = df.withColumn("_hash", seeded_hash(seed, key)).withColumn("_bucket", F.substring("_hash", 1, 4))
    totals = hashed.groupBy("_bucket").agg(F.sum(weight).alias("_w"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", key).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumn("_inside", F.sum(weight).over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(position, F.col("_offset") + F.col("_inside"))
        .drop("_hash", "_bucket", "_offset", "_inside")
    )


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cap: int, salt_on: Sequence[str], salts: int = 64
) -> DataFrame:
    """The first ``cap`` rows of each key in ``order``, ranked twice so that a hot key is cut in many tasks first."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(part))
        .filter(F.col("_rn") <= cap)
        .withColumn("_rn", F.row_number().over(whole))
        .filter(F.col("_rn") <= cap)
        .drop("_salt", "_rn")
    )


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "first", n_dropped: str | None = None) -> DataFrame:
    """One row per key: the first or the last in ``order``. Partial aggregation, so hot keys are safe."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[as_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    chosen = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), rank).alias("_row")
    aggregates = [chosen] + ([(F.count(F.lit(1)) - 1).alias(n_dropped)] if n_dropped else [])
    out = df.groupBy(*keys).agg(*aggregates)
    extra = [n_dropped] if n_dropped else []
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], *extra)
