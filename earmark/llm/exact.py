"""Exact deduplication against a minimal perfect hash over the digests of the documents that are there already.

The historical documents' distinct SHA-256 digests are cut by their first bits into parts of about ``PART`` digests. For each
part a minimal perfect hash is built by hashing and displacement: digests fall into small buckets by one hash, and each
bucket, largest first, gets the first displacement that sends all its digests to free slots. A slot holds the full digest and
the winner's locator (the largest id) with the number of copies. A lookup computes the slot and compares all 32 bytes, so that
a digest that is no member is never taken for one. Digests that are no members form groups of their own. Copies are counted
before anything is looked up, so each distinct digest is probed once whatever its number of copies.

Defined results: a null text counts as empty; the largest id of a group stays; with several rows of that id one of them stays;
null ids stay only if the group has no other; rows are never lost. Empty tables, on either side, give the groups of the other. Very long
texts are digested whole. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import lower_ascii, pin

PART = 16_384
#: Digests of a bucket on average.
LOAD = 4


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, null as empty; 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(lower_ascii(text), F.lit("")).cast("binary"), 256))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three words of each digest that the choice of the part hasn't used."""
    words = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)
    return words[:, 1], words[:, 2], words[:, 3] | np.uint64(1)


def build_slots(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets, and the slot of each of n distinct digests (n x 32 bytes): 0 to n - 1, each once."""
    n = len(digests)
    bucket_word, base, step = _halves(digests)
    bucket = (bucket_word % np.uint64((n + LOAD - 1) // LOAD)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=(n + LOAD - 1) // LOAD)
    first = np.concatenate([[0], np.cumsum(count)])
    displacement = np.zeros(len(count), np.uint64)
    slot = np.empty(n, np.int64)
    free = np.ones(n, bool)
    tries = np.arange(64, dtype=np.uint64)
    for b in np.argsort(-count, kind="stable").tolist():
        if not count[b]:
            break
        own = order[first[b] : first[b + 1]]
        start = np.uint64(0)
        while True:
            d = start + tries
            at = _slot(base[own][None, :], step[own][None, :], d[:, None], n)
            ok = free[at].all(axis=1)
            if len(own) > 1:
                ok &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            hit = np.flatnonzero(ok)
            if len(hit):
                displacement[b], slot[own] = d[hit[0]], at[hit[0]]
                free[at[hit[0]]] = False
                break
            start += np.uint64(len(tries))
    return displacement, slot


def _slot(base: np.ndarray, step: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = base ^ (displacement * np.uint64(0x9E3779B97F4A7C15))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * step
        mixed = mixed ^ (mixed >> np.uint64(29))
        return (mixed % np.uint64(n)).astype(np.int64)


def find_slots(digests: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """The only slot that can hold each digest."""
    bucket_word, base, step = _halves(digests)
    return _slot(base, step, displacement[(bucket_word % np.uint64(len(displacement))).astype(np.int64)], n)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(lists.to_pylist()), np.uint8).reshape(-1, 32)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, members [(digest, winner, copies)] -> part, displacements, slots (the members in slot order)."""
    for batch in batches:
        for row in range(batch.num_rows):
            members = batch.column(1)[row].values
            displacement, slot = build_slots(_matrix(members.field("digest")))
            inverse = np.empty_like(slot)
            inverse[slot] = np.arange(len(slot))
            taken = members.take(pa.array(inverse))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, 1), pa.array([displacement.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(slot)], pa.int32()), taken)],
                names=["part", "displacements", "slots"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, displacements, slots, probes [(digest, winner, copies)] -> digest, winner, copies, member of the groups."""
    for batch in batches:
        for row in range(batch.num_rows):
            out: dict[str, list] = {"digest": [], "winner": [], "copies": [], "member": []}
            slots, probes = batch.column(2)[row].as_py() or [], batch.column(3)[row].as_py() or []
            hit = [-1] * len(probes)
            if slots and probes:
                displacement = np.frombuffer(batch.column(1)[row].as_py(), np.uint64)
                hit = find_slots(np.frombuffer(b"".join(p["digest"] for p in probes), np.uint8).reshape(-1, 32), displacement, len(slots)).tolist()
            for p, at in zip(probes, hit):
                if at >= 0 and slots[at]["digest"] == p["digest"]:
                    winners = [w for w in (slots[at]["winner"], p["winner"]) if w is not None]
                    slots[at] = {"digest": p["digest"], "winner": max(winners, default=None), "copies": slots[at]["copies"] + p["copies"]}
                else:
                    for k in ("digest", "winner", "copies"):
                        out[k].append(p[k])
                    out["member"].append(False)
            for s in slots:
                for k in ("digest", "winner", "copies"):
                    out[k].append(s[k])
                out["member"].append(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["digest"], pa.binary()), pa.array(out["winner"], pa.int64()), pa.array(out["copies"], pa.int64()), pa.array(out["member"], pa.bool_())],
                names=["digest", "winner", "copies", "member"])


def _by_part(groups: DataFrame, parts: int, name: str) -> DataFrame:
    part = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(parts))
    return groups.groupBy(part.alias("part")).agg(F.collect_list(F.struct("digest", "winner", "copies")).alias(name))


def build_index(groups: DataFrame, parts: int) -> DataFrame:
    """The hash as a table (part, displacements, slots) in the shared folder; ``groups`` has digest, winner, copies."""
    slots = "array<struct<digest: binary, winner: bigint, copies: bigint>>"
    return pin(_by_part(groups, parts, "members").mapInArrow(_build, f"part long, displacements binary, slots {slots}"), "slots")


def exact_groups(history: DataFrame, arrivals: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of both tables: id, keep_id, group_size, kept, digest, member (its text is in the history)."""
    columns = [F.col(f"`{key}`").cast("long").alias("id"), digest_of(F.col(f"`{text}`")).alias("digest")]
    rows = history.select(*columns, F.lit(True).alias("old")).unionByName(arrivals.select(*columns, F.lit(False).alias("old")))
    rows = pin(rows.groupBy("digest", "id", "old").agg(F.count(F.lit(1)).alias("n")), "digests")
    groups = pin(rows.groupBy("digest", "old").agg(F.max("id").alias("winner"), F.sum("n").alias("copies")), "groups")
    parts = max(1, -(-groups.count() // PART))
    index = build_index(groups.filter("old").drop("old"), parts)
    probes = _by_part(groups.filter(~F.col("old")).drop("old"), parts, "probes")
    whole = index.join(probes, "part", "full").select("part", "displacements", "slots", "probes")
    found = whole.mapInArrow(_probe, "digest binary, winner long, copies long, member boolean")
    first = F.row_number().over(_same_id()) == 1
    rows = rows.withColumn("first", first).withColumn("n", F.col("n").cast("int"))
    joined = rows.join(found, "digest")
    place = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("place")
    out = joined.select("id", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), "digest", "member", "first", place)
    # Without any id, one row of the group stays all the same.
    return out.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & F.col("first") & (F.col("place") == 1)).alias("kept"), "digest", "member")


def _same_id():
    from pyspark.sql import Window

    return Window.partitionBy("digest", "id").orderBy(F.desc("old"))
