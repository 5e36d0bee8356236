"""Vectors as short codes: a codebook for each part of a vector, learned by rounds of dual-tree Lloyd on integers.

Vectors become integers and are cut into parts; each part's position has a codebook, which starts as that part of the vectors with
the smallest ids. In a round every part goes to its nearest entry (ties to the lower index), and each entry becomes the mean of its
parts, rounded down.

A task reads its vectors in blocks. For each position it builds a tree over the block's parts (halved at the median of the widest
side, with the box, the sum and the count of each node) and walks it together with a tree over the entries. For a pair of nodes the
boxes give the least and the greatest distance that a part and an entry in them can have. An entry node goes as soon as its least
distance exceeds the smallest greatest distance of another; where one entry is left, the cached sum and count of the whole node
are booked on it. Leaves that stay uncertain are decided by integer distances. All bounds are integers too, so nothing is rounded.

Only sums and counts leave a task, one row an entry; codebooks are bounded by parts x entries.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are vectors whose
length isn't the most frequent one (ties: the longest); that length must be a multiple of the number of parts. Components beyond
2 ** 19 count as 2 ** 19, so that sums of squares stay in 64 bits. Null ids come last among the first vectors and are encoded like
any other; repeated ids and rows are kept; of one id, the smaller vector comes first; with fewer vectors than entries there are fewer
entries; an empty table gives no rows. Other columns are not read, so their names can't clash. Vectors of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import keyed, pin

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, MOST = 256, 1 << 27
#: Components of a block of vectors, and parts of a leaf of its trees.
BLOCK, LEAF = 1 << 19, 16


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """_c0 (id), _c1 (label), _c2 (vector) of the rows that are kept, and their length; 0 if there are none."""
    rows = keyed(vectors, key, label, vector).withColumn("_c2", F.col("_c2").cast("array<double>"))
    rows = rows.filter(F.col("_c2").isNotNull() & (F.size("_c2") > 0) & F.forall("_c2", _finite))
    widest = rows.groupBy(F.size("_c2").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return (rows.filter(F.size("_c2") == widest.width), widest.width) if widest else (rows, 0)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 * component)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64).reshape(-1, width)


@dataclass
class EntryTree:
    """Nodes of a tree over the entries of a codebook; a node with one entry has no children."""

    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    entry: np.ndarray

    @classmethod
    def build(cls, book: np.ndarray) -> EntryTree:
        low, high, children, entry = [], [], [], []

        def add(own: np.ndarray) -> int:
            node = len(low)
            low.append(book[own].min(axis=0))
            high.append(book[own].max(axis=0))
            children.append((-1, -1))
            entry.append(int(own[0]) if len(own) == 1 else -1)
            if len(own) > 1:
                side = int(np.argmax(high[node] - low[node]))
                own = own[np.argsort(book[own, side], kind="stable")]
                children[node] = add(own[: len(own) // 2]), add(own[len(own) // 2 :])
            return node

        add(np.arange(len(book)))
        return cls(np.array(low), np.array(high), np.array(children), np.array(entry))


class PartTree:
    """A complete binary tree over the parts of a block at one position. Padding repeats a part and weighs nothing."""

    def __init__(self, parts: np.ndarray) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(parts)) / LEAF))))
        size = LEAF << self.depth
        order = np.minimum(np.arange(size), len(parts) - 1)
        for level in range(self.depth):
            order = order.reshape(1 << level, -1)
            own = parts[order]
            side = np.argmax(own.max(axis=1) - own.min(axis=1), axis=1)
            along = np.take_along_axis(own, side[:, None, None], axis=2)[:, :, 0]
            order = np.take_along_axis(order, np.argpartition(along, order.shape[1] // 2, axis=1), axis=1)
        self.order = order.reshape(-1, LEAF)
        # The last part stands for the padding too; it counts where it stands first.
        self.weight = np.ones(self.order.shape, bool)
        padded = np.flatnonzero(self.order.reshape(-1) == len(parts) - 1)[1:]
        self.weight.reshape(-1)[padded] = False
        self.parts = parts[self.order]
        low, high = [self.parts.min(axis=1)], [self.parts.max(axis=1)]
        total, count = [(self.parts * self.weight[:, :, None]).sum(axis=1)], [self.weight.sum(axis=1)]
        for _ in range(self.depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            total.append(total[-1][::2] + total[-1][1::2])
            count.append(count[-1][::2] + count[-1][1::2])
        self.low, self.high, self.total, self.count = low[::-1], high[::-1], total[::-1], count[::-1]

    def assign(self, book: np.ndarray, entries: EntryTree) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes of the block's parts, sum and count of each entry, and how many parts were decided one by one."""
        codes = np.empty(self.order.shape, np.int64)
        sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        node, other, level, single = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
        while len(node):
            low, high = self.low[level][node], self.high[level][node]
            low_e, high_e = entries.low[other], entries.high[other]
            gap = np.maximum(0, np.maximum(low_e - high, low - high_e))
            far = np.maximum(high_e - low, high - low_e)
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sizes = np.diff(np.r_[starts, len(node)])
            bound = np.repeat(np.minimum.reduceat((far * far).sum(axis=1), starts), sizes)
            stays = (gap * gap).sum(axis=1) <= bound
            node, other = node[stays], other[stays]
            entry = entries.entry[other]
            first = np.r_[True, node[1:] != node[:-1]]
            sure = first & np.r_[first[1:], True] & (entry >= 0)
            if sure.any():
                np.add.at(sums, entry[sure], self.total[level][node[sure]])
                np.add.at(counts, entry[sure], self.count[level][node[sure]])
                codes.reshape(1 << level, -1)[node[sure]] = entry[sure][:, None]
                node, other, entry = node[~sure], other[~sure], entry[~sure]
            open_ = entry < 0
            if level == self.depth and not open_.any():
                single = self._decide(book, node, entry, codes, sums, counts)
                break
            node, other = np.repeat(node, 1 + open_), np.repeat(other, 1 + open_)
            split = entries.entry[other] < 0
            nth = np.zeros(len(node), np.int64)
            nth[np.cumsum(1 + open_)[open_] - 1] = 1
            other = np.where(split, entries.children[other, nth], other)
            if level < self.depth:
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
                sizes = np.diff(np.r_[starts, len(node)])
                # The pairs of a node follow each other: once for its left child, then once more for its right one.
                at = np.repeat(starts, 2 * sizes) + np.arange(2 * len(node)) - np.repeat(2 * starts, 2 * sizes)
                right = np.arange(2 * len(node)) - np.repeat(2 * starts, 2 * sizes) >= np.repeat(sizes, 2 * sizes)
                at = at - np.where(right, np.repeat(sizes, 2 * sizes), 0)
                node, other, level = 2 * node[at] + right, other[at], level + 1
        out = np.empty(int(self.weight.sum()), np.int64)
        out[self.order[self.weight]] = codes[self.weight]
        return out, sums, counts, single

    def _decide(self, book: np.ndarray, node: np.ndarray, entry: np.ndarray, codes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> int:
        """Leaves with several entries left, by integer distances."""
        if not len(node):
            return 0
        apart = self.parts[node] - book[entry][:, None, :]
        apart = (apart * apart).sum(axis=2)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        nearest = np.repeat(np.minimum.reduceat(apart, starts), np.diff(np.r_[starts, len(node)]), axis=0)
        found = np.minimum.reduceat(np.where(apart == nearest, entry[:, None], len(book)), starts)
        leaf = node[starts]
        codes[leaf] = found
        weight = self.weight[leaf]
        np.add.at(counts, found[weight], 1)
        np.add.at(sums, found[weight], self.parts[leaf][weight])
        return int(weight.sum())


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """The rows of all batches in tables of ``block`` rows."""
    waiting, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, block - rows)
            batch = batch.slice(piece.num_rows)
            waiting.append(piece)
            rows += piece.num_rows
            if rows == block:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _column(table: pa.Table, k: int) -> pa.Array:
    return table.column(k).chunk(0)


def _rows(block: int, width: int) -> int:
    return max(LEAF, block // width)


def _sums(books: np.ndarray, block: int):
    """Per task: part, entry, count and sum of each entry that has parts."""
    parts, entries, side = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree.build(book) for book in books]
        total, count = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for table in _blocks(batches, _rows(block, parts * side)):
            vectors = integers(_column(table, 0), parts * side).reshape(-1, parts, side)
            for p in range(parts):
                _, s, c, _ = PartTree(np.ascontiguousarray(vectors[:, p])).assign(books[p], trees[p])
                total[p] += s
                count[p] += c
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(count[part, entry], pa.int64()), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return add


def _codes(books: np.ndarray, block: int):
    parts, _, side = books.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree.build(book) for book in books]
        for table in _blocks(batches, _rows(block, parts * side)):
            vectors = integers(_column(table, 2), parts * side).reshape(-1, parts, side)
            codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(vectors[:, p])
                code = PartTree(own).assign(books[p], trees[p])[0]
                codes[:, p] = code
                error += ((own - books[p][code]) ** 2).sum(axis=1)
            text, n = codes.tobytes().hex(), 2 * parts
            yield pa.RecordBatch.from_arrays(
                [_column(table, 0), _column(table, 1), pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return encode


def learn(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> np.ndarray:
    """Codebooks (part, entry, component) after the rounds. ``rows``: :func:`usable`."""
    if width % parts:
        raise ValueError(f"vectors of length {width} can't be cut into {parts} equal parts")
    if entries > 256:
        raise ValueError("a code has two hex digits, so a codebook has at most 256 entries")
    seeds = rows.select("_c0", "_c2").orderBy(F.col("_c0").asc_nulls_last(), "_c2").limit(entries).toArrow().column(1).combine_chunks()
    seeds = integers(seeds if isinstance(seeds, pa.Array) else seeds.chunk(0), width) if len(seeds) else np.zeros((0, width), np.int64)
    books = seeds.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        side = width // parts
        summed = rows.select("_c2").mapInArrow(_sums(books, block), "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(side)])
        for row in summed.collect():
            books[row.part, row.entry] = [row[f"s{k}"] // row.n for k in range(side)]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that stand for a vector's code."""
    return np.concatenate([books[p][k] for p, k in enumerate(bytes.fromhex(code))])


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """One row a vector that is kept (id, label, code, error, label_error), and the codebooks."""
    rows, width = usable(vectors, key, vector, label)
    types = dict(rows.dtypes)
    schema = f"id {types['_c0']}, label {types['_c1']}, code string, error long"
    if not width:
        none = vectors.sparkSession.createDataFrame([], schema + ", label_error long")
        return none, np.zeros((parts, 0, 0), np.int64)
    books = learn(rows, width, parts, entries, rounds, block)
    coded = pin(rows.mapInArrow(_codes(books, block), schema), "codes")
    summed = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    c, s = coded.alias("c"), summed.alias("s")
    return c.join(s, F.col("c.label").eqNullSafe(F.col("s.label"))).select("c.id", "c.label", "c.code", "c.error", "s.label_error"), books
