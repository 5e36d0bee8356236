"""Seeded samples, caps and splits.

All of them order keys by a seeded digest and keep what lies at or below a cut-off digest. The cut-off is
found from counts: totals per four-digit prefix, then the digests of the one prefix that holds the cut. The
rows themselves are only filtered, never ranked, shuffled or gathered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from earmark.functions.keys import seeded_hash
from earmark.functions.values import tag_buckets
from earmark.operators.ordering import join_null_safe, keep_one, with_position
from earmark.operators.selection import smallest_cut
from earmark.session import pin

PREFIX_DIGITS = 4
_ALL = "g"  # sorts after every hex digest


def hash_cutoffs(df: DataFrame, key: str, seed: int, wanted: Mapping[str, tuple[Column, int]]) -> dict[str, str]:
    """Per name, the smallest digest at or below which at least n of the rows that meet the condition lie.

    ``wanted`` maps a name to (condition, n). A name with fewer than n rows gets a cut-off above all digests;
    n of 0 or less gives an empty cut-off. One job of two passes over (key, conditions); at most one row per
    name returns.
    """
    cutoffs = {name: _ALL if n > 0 else "" for name, (_, n) in wanted.items()}
    names = [name for name, (_, n) in wanted.items() if n > 0]
    if not names:
        return cutoffs
    each = range(len(names))
    hashed = df.select(
        seeded_hash(seed, key).alias("_hash"), *[wanted[n][0].cast("int").alias(f"_m{i}") for i, n in enumerate(names)]
    ).withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    counts = [F.coalesce(F.sum(f"_m{i}"), F.lit(0)).alias(f"_c{i}") for i in each]

    def upto(totals: DataFrame, window: WindowSpec) -> DataFrame:
        return totals.withColumns({f"_u{i}": F.sum(f"_c{i}").over(window) for i in each})

    def still_needed(i: int, n: Column) -> Column:
        """What is left of n where the running count of name i passes it, else null."""
        before = F.col(f"_u{i}") - F.col(f"_c{i}")
        return F.when((F.col(f"_u{i}") >= n) & (before < n), n - before)

    # At most 65,536 prefixes; those that hold a cut go on (at most one per name).
    prefixes = upto(hashed.groupBy("_prefix").agg(*counts), Window.orderBy("_prefix")).select(
        "_prefix", *[still_needed(i, F.lit(wanted[n][1])).alias(f"_n{i}") for i, n in enumerate(names)])
    held = prefixes.filter(F.coalesce(*[f"_n{i}" for i in each]).isNotNull())
    digests = hashed.join(F.broadcast(held), "_prefix").groupBy("_prefix", "_hash").agg(
        *counts, *[F.max(f"_n{i}").alias(f"_n{i}") for i in each])
    cuts = upto(digests, Window.partitionBy("_prefix").orderBy("_hash")).select(
        "_hash", *[still_needed(i, F.col(f"_n{i}")).alias(f"_k{i}") for i in each])
    for row in cuts.filter(F.coalesce(*[f"_k{i}" for i in each]).isNotNull()).collect():
        for i in each:
            if row[f"_k{i}"] is not None:
                cutoffs[names[i]] = row["_hash"]
    return cutoffs


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) of a table with unique keys."""
    cutoff = hash_cutoffs(df, key, seed, {"n": (F.lit(True), n)})["n"]
    return df.filter(seeded_hash(seed, key) <= cutoff)


def cap_per_tag(df: DataFrame, key: str, conditions: Mapping[str, Column], cap: int, seed: int = 42) -> DataFrame:
    """Rows among the first ``cap`` of any tag in seeded order; a row may stand for several tags."""
    cutoffs = hash_cutoffs(df, key, seed, {tag: (cond, cap) for tag, cond in conditions.items()})
    digest = seeded_hash(seed, key)
    keep = F.lit(False)
    for tag, cond in conditions.items():
        keep = keep | (cond & (digest <= cutoffs[tag]))
    return df.filter(keep)


_SEP = "\x1f"


def _joint_cutoffs(unique: DataFrame, digest: Column, target: int) -> tuple[list[tuple[str, str]], tuple[str, str] | None] | None:
    """Cut-off digest of each bucket in turn, and of the rows that fill up ("fill") or are cut off ("cut") in the end.

    None if there are ``target`` rows or fewer. ``unique`` has ``_buckets``. One pass counts rows by (set of buckets, digest prefix). On
    that table the turns are bounded: a prefix that may hold a cut-off leaves the rows of the bucket there taken or not, so later
    cut-offs lie in a range of prefixes. A second pass gets the digests of those prefixes only, and the turns are taken exactly.
    """
    named = unique.select(F.array_join("_buckets", _SEP).alias("s"), digest.alias("h")).withColumn("p", F.substring("h", 1, PREFIX_DIGITS))
    counts = named.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).toArrow()
    n_each = counts["n"].to_numpy()
    if n_each.sum() <= target:
        return None
    sets, set_of = np.unique(np.array(counts["s"].to_pylist(), object), return_inverse=True)
    prefixes, prefix_of = np.unique(np.array(counts["p"].to_pylist(), object), return_inverse=True)
    rows = np.zeros((len(sets), len(prefixes)), np.int64)
    rows[set_of, prefix_of] = n_each
    present = sorted({b for s in sets for b in s.split(_SEP)})
    members = {b: np.array([b in s.split(_SEP) for s in sets]) for b in present}
    quota = max(1, target // len(present))

    # Bounds: rows that are certainly open, and rows that may be.
    least, most = rows.copy(), rows.copy()
    doubtful = np.zeros(len(prefixes), bool)

    def between(fewest: np.ndarray, mosts: np.ndarray, low: int, high: int) -> tuple[int, int]:
        return int(np.searchsorted(mosts.cumsum(), max(low, 1))), int(np.searchsorted(fewest.cumsum(), max(high, 1)))

    for bucket in present:
        own = members[bucket]
        first, last = between(least[own].sum(axis=0), most[own].sum(axis=0), quota, quota)
        doubtful[first : last + 1] = True
        least[own, :first] = most[own, :first] = 0
        least[own, first : last + 1] = 0
    low, high = target - int((rows - least).sum()), target - int((rows - most).sum())
    if high > 0:
        first, last = between(least.sum(axis=0), most.sum(axis=0), low, high)
        doubtful[first : last + 1] = True
    if low < 0:
        first, last = between((rows - most).sum(axis=0), (rows - least).sum(axis=0), target, target)
        doubtful[first : last + 1] = True

    asked = unique.sparkSession.createDataFrame([(p,) for p in prefixes[doubtful]], "p STRING")
    exact = named.join(F.broadcast(asked), "p").groupBy("s", "h").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sure = ~doubtful[prefix_of]
    place = np.concatenate([prefixes[prefix_of[sure]], np.array(exact["h"].to_pylist(), object)])
    of_set = np.concatenate([set_of[sure], np.searchsorted(sets, np.array(exact["s"].to_pylist(), object))]).astype(np.int64)
    n = np.concatenate([n_each[sure], exact["n"].to_numpy()])
    order = np.argsort(place, kind="stable")
    place, of_set, n = place[order], of_set[order], n[order]
    taken = np.zeros(len(n), bool)

    def cutoff(open_rows: np.ndarray, wanted: int) -> str:
        upto = (n * open_rows).cumsum()
        at = int(np.searchsorted(upto, wanted))
        return place[at] if at < len(upto) else _ALL

    turns = []
    for bucket in present:
        open_rows = members[bucket][of_set] & ~taken
        turns.append((bucket, cutoff(open_rows, quota)))
        taken |= open_rows & (place <= turns[-1][1])
    n_taken = int(n[taken].sum())
    if n_taken < target:
        return turns, ("fill", cutoff(~taken, target - n_taken))
    return turns, ("cut", cutoff(taken, target)) if n_taken > target else None


def stratified_sample(df: DataFrame, key: str, target: int, labels: Column, seed: int = 42) -> DataFrame:
    """``target`` rows, the tags served in turn with equal quotas, then filled up from all other rows.

    One row per key is kept first and written once. Tags are served in name order, ``none`` standing for untagged rows; a row
    counts for the first tag that takes it. All quotas come from one table of counts and one look at the digests around the
    cut-offs, whatever the number of tags; the sample is a filter on the digest.
    """
    if target <= 0:
        return df.limit(0)
    unique = pin(keep_one(df.withColumn("_buckets", tag_buckets(labels)), [key], [F.to_json(F.struct(*df.columns))]))
    digest = seeded_hash(seed, key)
    found = _joint_cutoffs(unique, digest, target)
    if found is None:
        return unique.drop("_buckets")
    turns, last = found
    taken = F.lit(False)
    for bucket, cutoff in turns:
        taken = taken | (F.array_contains("_buckets", bucket) & ~taken & (digest <= cutoff))
    if last is not None:
        kind, cutoff = last
        taken = taken | (digest <= cutoff) if kind == "fill" else taken & (digest <= cutoff)
    return unique.filter(taken).drop("_buckets")


def group_split(df: DataFrame, group: str, ratio: float = 0.1, seed: int = 42, flag: str = "is_val") -> DataFrame:
    """Flag whole groups for validation, in seeded group order, until their rows reach ``ratio`` of all rows.

    The target is rounded half-even and at least 1 (0 for a table of one row). No group is in both parts.
    """
    total = df.count()
    target = max(1, round(total * ratio)) if total > 1 else 0
    cutoff = hash_cutoffs(df, group, seed, {"val": (F.lit(True), target)})["val"]
    return df.withColumn(flag, seeded_hash(seed, group) <= cutoff)


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in seeded order (a range-partitioned sort)."""
    return df.orderBy(seeded_hash(seed, key), key)


def mine_hard(df: DataFrame, sim: str, key: str, fraction: float = 0.2, ranks: bool = True) -> DataFrame:
    """The least similar ``max(1, ceil(n * fraction))`` rows, with error score, rank share, and the means over all and over these rows.

    ``key`` is unique; equal similarities go by key, nulls come first. The rows are written once; the cut-off comes from counts, and the
    rows are filtered where they lie. Only (key, similarity) of the kept rows are ranked. Joining the ranks moves the kept rows:
    with vectors in them, take ``ranks=False`` and :func:`hard_ranks` once the vectors are gone.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    rows = pin(df)
    cut = smallest_cut(rows, sim, key, lambda n: max(1, math.ceil(n * fraction)))
    kept = rows.filter(cut.condition(sim, key)) if cut else rows.limit(0)
    kept = kept.withColumns({
        "mean_sim_all": F.lit(cut.mean_all if cut else None).cast("double"), "mean_sim_hard": F.lit(cut.mean if cut else None).cast("double"),
        "error_score": 1.0 - F.col(sim), "is_hard": F.lit(True), "_n": F.lit(cut.n_all if cut else 0)})
    return hard_ranks(kept, sim, key) if ranks else kept


def hard_ranks(hard: DataFrame, sim: str, key: str) -> DataFrame:
    """Mined rows with ``rank_pct``, their rank among all rows as a share."""
    ranked = with_position(hard.select(key, sim), [], [F.col(sim), F.col(key)], "_rank").select(key, "_rank")
    return join_null_safe(hard, ranked, [key]).withColumn("rank_pct", F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def representative_rows(df: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """First, middle ((n-1) div 2) and last row of every group, with position (from 0) and group size."""
    placed = with_position(df, [group], order, "_pos", size="num_segments").withColumn("position", F.col("_pos") - 1)
    last = F.col("num_segments") - 1
    wanted = F.array(F.lit(0).cast("long"), F.floor(last / 2).cast("long"), last)
    return placed.filter(F.array_contains(wanted, F.col("position"))).drop("_pos")


def plan_segments(df: DataFrame, duration: str, step: float = 15.0, min_tail: float = 5.0) -> DataFrame:
    """One row per clip: index, start, end, duration. A tail shorter than ``min_tail`` gives no clip."""
    length = F.col(duration)
    whole = F.floor(length / step)
    clips = (whole + F.when(length - whole * step >= min_tail, 1).otherwise(0)).cast("int")
    rows = df.filter(length > 0).withColumn("_clips", clips).filter(F.col("_clips") > 0)
    rows = rows.withColumn("segment_index", F.explode(F.sequence(F.lit(0), F.col("_clips") - 1))).drop("_clips")
    start = F.col("segment_index") * F.lit(step)
    end = F.least((F.col("segment_index") + 1) * F.lit(step), length)
    return (
        rows.withColumn("start_sec", F.round(start, 3)).withColumn("end_sec", F.round(end, 3))
        .withColumn("duration_sec", F.round(end - start, 3)).filter(end > start)
    )
