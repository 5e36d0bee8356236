"""SimHash fingerprints, and all pairs of them that differ in few bits by a self-join of binary tries.

The join walks pairs of trie nodes together: at each bit a pair has up to four pairs of children, a pair of unequal children
costs one error, and a pair over the budget is dropped with all below it. So that the work spreads, fingerprints are first
dealt into cells: with budget e the bits are cut into e + 1 blocks, of which a pair within the budget shares one at least. A
pair is reported only in the cell of the first block it shares. A cell with too many fingerprints is dealt again by the bits
that are left, so that a task never holds more than ``CELL`` of them; each step fixes a third of the bits that are left, and
12 bits can't tell more than 4,096 fingerprints apart, so this ends.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; equal fingerprints are one node, so
copies are never expanded into pairs; a component without any non-null id has a null component id; repeated ids and rows are
kept; very long texts are read whole; a bit that half of the shingles have is 0; an empty table gives no rows. Other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import ROWS, keyed_texts, pin, raw_texts, words
from earmark.llm.components import components

BITS = 64
SHINGLE = 3
BUDGET = 2
SEED = 42
#: Most fingerprints of a cell that one task compares.
CELL = 4096
_CHUNK = 1 << 15


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """Majority of each bit over hashes that are made already, as a signed long; 0 without any."""
    set_bits = sum((ones(hashes[at : at + _CHUNK]) for at in range(0, len(hashes), _CHUNK)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 of all word shingles, repeats included; 0 without a word."""
    parts = words(raw)
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    starts, ends = (end - length)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], "<u8")
        set_bits += ones(hashes)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def make(texts: pa.Array) -> pa.Array:
        made = (fingerprint(raw, shingle) for start in range(0, len(texts), ROWS) for raw in raw_texts(texts.slice(start, ROWS)))
        return pa.array(np.fromiter(made, np.uint64, len(texts)).view(np.int64))

    return make(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


@dataclass(frozen=True)
class Kind:
    """Cells that agree in the bits of ``fixed``; pairs that agree in any of ``earlier`` belong to another cell."""

    fixed: int
    left: tuple[int, ...]
    earlier: tuple[int, ...]

    def split(self, budget: int) -> list[Kind]:
        made, earlier = [], list(self.earlier)
        for block in np.array_split(np.array(self.left), budget + 1):
            mask = sum(1 << int(b) for b in block)
            gone = {int(b) for b in block}
            made.append(Kind(self.fixed | mask, tuple(b for b in self.left if b not in gone), tuple(earlier)))
            earlier.append(mask)
        return made


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j and cell of all pairs within the budget. ``values``: uint64, distinct and sorted within each cell.

    A trie node is a range of the sorted values, so that the tries of many cells are walked at once, level by level.
    """
    cell = np.arange(len(starts))
    a_lo, a_hi, b_lo, b_hi, errors = starts.copy(), ends.copy(), starts.copy(), ends.copy(), np.zeros(len(starts), np.int8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for bit in range(BITS - 1, -1, -1):
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        twins = a_lo == b_lo
        children = [
            (a_lo, a_mid, b_lo, b_mid, errors, cell, np.ones(len(cell), bool)),
            (a_mid, a_hi, b_mid, b_hi, errors, cell, np.ones(len(cell), bool)),
            (a_lo, a_mid, b_mid, b_hi, errors + 1, cell, np.ones(len(cell), bool)),
            (a_mid, a_hi, b_lo, b_mid, errors + 1, cell, ~twins),
        ]
        kept = []
        for lo, hi, lo2, hi2, e, c, ok in children:
            ok = ok & (lo < hi) & (lo2 < hi2) & (e <= budget) & ~((lo == lo2) & (hi - lo == 1))
            kept.append([x[ok] for x in (lo, hi, lo2, hi2, e.astype(np.int8), c)])
        a_lo, a_hi, b_lo, b_hi, errors, cell = (np.concatenate([k[i] for k in kept]) for i in range(6))
        leaf = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if leaf.any():
            i, j = a_lo[leaf], b_lo[leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            found.append((np.minimum(i, j)[near], np.maximum(i, j)[near], cell[leaf][near]))
            a_lo, a_hi, b_lo, b_hi, errors, cell = (x[~leaf] for x in (a_lo, a_hi, b_lo, b_hi, errors, cell))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _join_cells(kinds: list[Kind], budget: int):
    width = max([1, *(len(k.earlier) for k in kinds)])
    masks = np.array([[*k.earlier, *[0] * (width - len(k.earlier))] for k in kinds], np.uint64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kind = part.column(0).to_numpy()
                lists = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in part.column(1).to_pylist()]
                ends = np.cumsum([len(x) for x in lists])
                values = np.concatenate(lists)
                i, j, cell = trie_pairs(values, ends - np.array([len(x) for x in lists]), ends, budget)
                differ = values[i] ^ values[j]
                skip = masks[kind[cell]]
                own = (((differ[:, None] & skip) != 0) | (skip == 0)).all(axis=1)
                a, b = values[i[own]].view(np.int64), values[j[own]].view(np.int64)
                for k in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])

    return join


def near_pairs(distinct: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """All pairs (a, b) of the distinct longs in column ``fp`` that differ in 1 to ``budget`` bits, each once."""
    if not 0 <= budget <= 4 or cell < 2:
        raise ValueError("budget must be 0 to 4 and cell at least 2")
    kinds = Kind(0, tuple(range(BITS - 1, -1, -1)), ()).split(budget)
    dealt = distinct.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(k.fixed))).alias("key"), F.col("fp").alias("fp"))
        for i, k in enumerate(kinds)])).alias("x")).select("x.*")
    pairs = None
    while True:
        sizes = dealt.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        small = (
            dealt.join(sizes.filter(F.col("n") <= cell), ["kind", "key"], "left_semi")
            .groupBy("kind", "key").agg(F.collect_list("fp").alias("fps")).select("kind", "fps"))
        found = small.mapInArrow(_join_cells(kinds, budget), "a long, b long")
        pairs = found if pairs is None else pairs.unionByName(found)
        if all(len(k.left) <= np.log2(cell) for k in kinds) or sizes.filter(F.col("n") > cell).isEmpty():
            return pairs
        large = dealt.join(sizes.filter(F.col("n") > cell), ["kind", "key"], "left_semi")
        parts = [k.split(budget) for k in kinds]
        children = [c for p in parts for c in p]
        step = len(parts[0])
        masks = F.array(*[F.lit(_signed(c.fixed)) for c in children])
        number = F.explode(F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: F.col("kind") * step + i)).alias("kind")
        dealt = pin(large.select("fp", number).withColumn("key", F.col("fp").bitwiseAND(F.element_at(masks, F.col("kind") + 1))), "cells")
        kinds = children


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component_id (smallest id linked to it directly or not, its own included), root
    (smallest fingerprint of the component).

    Two documents are linked if their fingerprints differ in ``budget`` bits at most.
    """
    rows = pin(keyed_texts(docs, key, text).select(F.col("_c0").alias("id"), fingerprints(F.col("_c1"), shingle).alias("fp")), "fingerprints")
    distinct = pin(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    rooted = components(near_pairs(distinct.select("fp"), budget))
    root = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(root.join(least, "root"), "fp").select("id", "fp", "component_id", "root")
