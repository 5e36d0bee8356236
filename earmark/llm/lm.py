"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c has level q, the number of edges 1, 2, 3, ... (growing by ``GROWTH``) that it reaches. For each n-gram the filter
holds the events (n-gram, 1) to (n-gram, q); a count is read by probing the levels in turn until a probe fails, so errors can
only raise a count, and a wrong raise by k levels has the probability of k false positives. The filter is cut into segments by
the n-gram's hash; each is built in one task, sized by its own events, at ``BITS`` bits an event with all bits of an event in
one 64-bit word.

The model interpolates words with word pairs. Word: c / N scaled by 1 - n1 / N for known words, n1 / N for the unknown one
(n1: words seen once). Pair: (c(h, w) + T p(w)) / (c(h) + T), where T is Witten and Bell's number of different followers,
averaged over the histories of the same level, so that it needs no filter of its own.

Exact counts for the baseline: words of the highest counts, at most ``FREQUENT`` of them, go along with the filter as two
arrays; the other words of a document are looked up by a join with the table of counts, in which each (document, word) is one
row. Words are identified by 64-bit hashes.

All counts cover all training documents. The filter of pairs never passes the driver: its segments are dealt in shards of at most
``SHARD_BYTES`` (one segment at least), each shard to tasks of its own, and the documents' pairs go where their shard is. A task takes
the documents in blocks; of a block a shard gets each different pair once, with the levels of its words and the places of its documents,
and gives back one sum a document. So texts are read once, whatever the number of shards. Blocks are what a task reads: rows that another
run of the task would read in another order have to be a table first. The filter of single words is broadcast and must fit into ``MOST_BYTES``.

Defined results: null and empty texts have the end token alone; a null id is not held out and not learned from; repeated rows
are scored each; with an empty training part N = V = 0, the baseline and the score are 0. Very long texts are scored whole; words of equal
counts are frequent or not together. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm.common import keyed_texts, pieces, pin, raw_texts, words

GROWTH = 1.25
BITS = 12
FREQUENT = 1_000_000
MOST_BYTES = 512 << 20
#: Bytes of a shard of the filter of pairs, at most; a small filter has SHARDS shards, or fewer of LEAST_SHARD bytes.
SHARD_BYTES = 32 << 20
LEAST_SHARD = 4 << 20
SHARDS = 24
#: Keys that a task gathers before it passes on their counts.
GATHER = 2_000_000
TOKENS_PER_PART = 1_500_000
#: Tokens and documents of a block; a document's place in it has two bytes.
BLOCK_TOKENS = 1_000_000
BLOCK_DOCS = 1 << 16
#: Different pairs of a block that are one row.
ROW_KEYS = 1024
_SEGMENT_BITS = 12
_END = b"\n"  # no word holds white space


def _edges(most: int = 1 << 62) -> np.ndarray:
    made, x = [1], 1.0
    while made[-1] < most:
        x *= GROWTH
        if int(x) > made[-1]:
            made.append(int(x))
    return np.array(made, np.int64)


EDGES = _edges()
#: Count that a level stands for: the geometric mean of the counts that have it.
MEANS = np.concatenate([[0.0], np.sqrt(EDGES[:-1].astype(float) * (EDGES[1:] - 1).astype(float)), [float(EDGES[-1])]])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, counts, side="right")


_SMALL = 4096  # counts below are looked up one by one
_SHIFT = round(np.log(EDGES[80]) / np.log(GROWTH)) - 80


def _large_level(n):
    """Level of counts of at least _SMALL, null for others: from the logarithm, mended by the edges on both sides."""
    guess = F.floor(F.log(n.cast("double")) / float(np.log(GROWTH))).cast("int") - _SHIFT + 1
    edges = F.array(*[F.lit(int(e)) for e in EDGES])
    mended = F.when(F.get(edges, guess) <= n, guess + 1).when(F.get(edges, guess - 1) > n, guess - 1).otherwise(guess)
    return F.when(n >= _SMALL, mended)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


def _place(keys: np.ndarray, level, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of the events (key, level)."""
    e = _mix(keys + np.asarray(level, np.uint64) * np.uint64(0xD1342543DE82EF95))
    at = first + (((e >> np.uint64(32)) * size) >> np.uint64(32))
    one = np.uint64(1)
    bits = (one << (e & np.uint64(63))) | (one << ((e >> np.uint64(6)) & np.uint64(63)))
    bits |= (one << ((e >> np.uint64(12)) & np.uint64(63))) | (one << ((e >> np.uint64(18)) & np.uint64(63)))
    return at.astype(np.int64), bits


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - _SEGMENT_BITS)).astype(np.int64)


def build_segment(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    size = max(1, -(-int(levels.sum()) * BITS // 64))
    out = np.zeros(size, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        at, bits = _place(own, level, np.uint64(0), np.uint64(size))
        np.bitwise_or.at(out, at, bits)
    return out


@dataclass
class LevelFilter:
    """Segments one after another; a segment that isn't here has no words."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def join(cls, segments: dict[int, bytes | pa.Buffer]) -> LevelFilter:
        size = np.zeros(1 << _SEGMENT_BITS, np.uint64)
        for s, b in segments.items():
            size[s] = memoryview(b).nbytes // 8
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64)
        return cls(np.frombuffer(b"".join(segments[s] for s in sorted(segments)), np.uint64), first, size)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, by probing level after level until one fails."""
        found = np.zeros(len(keys), np.int64)
        segment = segment_of(keys)
        active = np.flatnonzero(self.size[segment])
        level = 1
        while len(active):
            k, s = keys[active], segment[active]
            at, bits = _place(k, level, self.first[s], self.size[s])
            active = active[(self.data[at] & bits) == bits]
            found[active] = level
            level += 1
            if level > len(EDGES):
                break
        return found


def _hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each with its end, and the number of tokens of each text."""
    all_words: list[bytes] = []
    sizes = []
    for raw in raws:
        own = words(raw)
        all_words += own
        all_words.append(_END)
        sizes.append(len(own) + 1)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, all_words), np.uint64, len(all_words)), np.array(sizes, np.int64)


END_HASH = np.uint64(xxhash.xxh3_64_intdigest(_END))


def _before(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = END_HASH
    return out


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums counts of equal keys; further columns are the same for all rows of a key."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.add.reduceat(np.concatenate([p[1] for p in parts])[order], start) if len(keys) else np.zeros(0, np.int64)
    return (keys[start], counts, *[np.concatenate([p[i] for p in parts])[order][start] for i in range(2, len(parts[0]))])


def _pack(*columns: np.ndarray) -> bytes:
    """Sorted keys as steps, and columns of other numbers, byte plane after byte plane, so that equal bytes stand together."""
    columns = (np.diff(columns[0], prepend=np.uint64(0)), *columns[1:])
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return np.array([len(raw), *map(len, columns)], np.uint32).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes | pa.Buffer, *kinds: type) -> tuple[np.ndarray, ...]:
    """The columns, of uint64 and the given kinds."""
    kinds = (np.uint64, *kinds)
    data = memoryview(data)
    whole, *sizes = np.frombuffer(data[: 4 * len(kinds) + 4], np.uint32).tolist()
    raw = np.frombuffer(pa.decompress(data[4 * len(kinds) + 4 :], whole, "zstd"), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(kind).reshape(size))
        at += size * width
    return (np.cumsum(out[0], dtype=np.uint64), *out[1:])


def _count(batches: Iterator[pa.RecordBatch], unigrams: LevelFilter | None, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Counts of words, or of pairs with the level of their first word, added up in the task. Pairs are packed by their segments without the last ``shift`` bits."""
    parts: list[tuple[np.ndarray, ...]] = []
    gathered = 0

    def give(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        if unigrams is None:
            for at in range(0, len(part[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(part[0][at : at + 50_000].view(np.int64)), pa.array(part[1][at : at + 50_000])], names=["key", "n"])
            return
        own = segment_of(part[0]) >> shift
        edges = [*np.flatnonzero(np.diff(own, prepend=-1)).tolist(), len(own)]
        for at in range(0, len(edges) - 1, 64):
            cuts = edges[at : at + 65]
            data = [_pack(*(c[a:b] for c in part)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], names=["bin", "data"])

    for batch in batches:
        for piece in pieces(batch):
            tokens, sizes = _hashes(raw_texts(piece.column(0)))
            if unigrams is None:
                keys, n = np.unique(tokens, return_counts=True)
                parts.append((keys, n))
            else:
                before = _before(tokens, sizes)
                keys, at, n = np.unique(pair_keys(before, tokens), return_index=True, return_counts=True)
                history, inverse = np.unique(before[at], return_inverse=True)
                parts.append((keys, n, unigrams.levels(history).astype(np.uint8)[inverse]))
            gathered += len(keys)
            if gathered >= GATHER:
                parts = [_merge(parts)]
                gathered = len(parts[0][0])
                if 2 * gathered >= GATHER:
                    yield from give(parts.pop())
                    gathered = 0
    if parts:
        yield from give(_merge(parts))


def _of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _segments([(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), np.zeros(b.num_rows, np.uint8)) for b in batches if b.num_rows])


def _of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _segments([_unpack(x.as_buffer(), np.int64, np.uint8) for b in batches for x in b.column(0)])


def _segments(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Filter segments of the partition's keys; in the row of segment -1, the number of different pairs by level of the history."""
    if not parts:
        return
    keys, counts, history = _merge(parts)
    parts.clear()
    edges = np.searchsorted(segment_of(keys), np.arange((1 << _SEGMENT_BITS) + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        own = slice(edges[s], edges[s + 1])
        data = build_segment(keys[own], level_of(counts[own]))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["segment", "data"])
    types = np.bincount(history, minlength=len(EDGES) + 1)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([types.tobytes()], pa.binary())], names=["segment", "data"])


def _pinned(df: DataFrame, label: str) -> DataFrame:
    """:func:`pin`; the shuffle files that led to the table go once it is written, not when the driver happens to collect its garbage."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        return pin(df, label)
    finally:
        if before is None:
            conf.unset(setting)
        else:
            conf.set(setting, before)


def _collected(segments: DataFrame) -> LevelFilter:
    """The filter of these segments of a table; their size has been checked. The driver has it once, and some segments more."""
    size = np.zeros(1 << _SEGMENT_BITS, np.uint64)
    for s, n in segments.select("segment", F.octet_length("data")).collect():
        size[s] = n // 8
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64)
    data = np.empty(int(size.sum()), np.uint64)
    for r in segments.select("segment", "data").coalesce(1 + data.nbytes // (16 << 20)).toLocalIterator():
        data[int(first[r.segment]) :][: int(size[r.segment])] = np.frombuffer(bytes(r.data), np.uint64)
    return LevelFilter(data, first, size)


@dataclass
class Model:
    total: int
    distinct: int
    once: int
    unigrams: LevelFilter
    #: Filter segments of pairs, and the segments of each shard.
    pairs: DataFrame
    shards: list[list[int]]
    followers: np.ndarray
    frequent: tuple[np.ndarray, np.ndarray]
    counts: DataFrame


def train(texts: DataFrame, text: str = "text", most_bytes: int = MOST_BYTES, frequent: int = FREQUENT, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count words and pairs of all rows and build the filters."""
    rows = keyed_texts(texts, text)
    counts = _pinned(rows.mapInArrow(lambda b: _count(b, None), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    by_level: dict[int, tuple[int, int]] = {}
    for n, level, n_words, tokens in counts.groupBy(F.when(F.col("n") < _SMALL, F.col("n")).alias("n"), _large_level(F.col("n")).alias("level")).agg(
            F.count(F.lit(1)), F.sum("n")).collect():
        q = int(level_of(np.array([n]))[0]) if n is not None else level
        before = by_level.get(q, (0, 0))
        by_level[q] = (before[0] + n_words, before[1] + tokens)
    total, distinct, once = sum(t for _, t in by_level.values()), sum(w for w, _ in by_level.values()), by_level.get(1, (0, 0))[0]
    least, kept = len(EDGES) + 1, 0
    for q in sorted(by_level, reverse=True):
        if kept + by_level[q][0] > frequent:
            break
        least, kept = q, kept + by_level[q][0]
    often = counts.filter(F.col("n") >= (int(EDGES[least - 1]) if least <= len(EDGES) else 1 << 62)).select("key", "n").toArrow()
    keys, n = often["key"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    parts = max(1, -(-total // TOKENS_PER_PART))
    segment = F.shiftrightunsigned("key", 64 - _SEGMENT_BITS).cast("int")
    made = counts.select("key", "n", segment.alias("segment")).repartition(parts, "segment").select("key", "n").mapInArrow(_of_words, "segment int, data binary")
    # Bits an event are fixed, so the size follows from the number of events by level: checked before it is collected.
    if sum(q * w for q, (w, _) in by_level.items()) * BITS // 8 > most_bytes:
        raise ValueError("the filter of single words exceeds most_bytes")
    unigrams = _collected(_pinned(made.filter("segment >= 0"), "words_filter"))
    shared = texts.sparkSession.sparkContext.broadcast(unigrams)
    # Some bins for each part, so that parts are even.
    shift = max(0, _SEGMENT_BITS - (8 * parts - 1).bit_length())
    found = rows.mapInArrow(lambda b: _count(b, shared.value, shift), "bin int, data binary")
    pairs = _pinned(found.repartition(parts, "bin").select("data").mapInArrow(_of_pairs, "segment int, data binary"), "segments")
    followers = np.zeros(len(EDGES) + 1)
    for r in pairs.filter("segment < 0").collect():
        followers += np.frombuffer(bytes(r["data"]), np.int64)
    histories = np.array([max(1, by_level.get(q, (0, 0))[0]) for q in range(len(EDGES) + 1)], float)
    sizes = sorted(map(tuple, pairs.filter("segment >= 0").select("segment", F.octet_length("data")).collect()))
    bound = min(shard_bytes, max(LEAST_SHARD, sum(n for _, n in sizes) // SHARDS))
    shards: list[list[int]] = []
    room = 0
    for s, size in sizes:
        if not shards or room + size > bound:
            shards.append([])
            room = 0
        shards[-1].append(s)
        room += size
    return Model(total, distinct, once, unigrams, pairs, shards or [[]], followers / histories, (keys[order], n[order]), counts)


def _apart(spark: SparkSession, n: int) -> np.ndarray:
    """A key for each of ``n`` partitions: dealt by them, each partition gets one."""
    keys = np.zeros(n, np.int64)
    for p, key in spark.range(40 * n, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect():
        keys[p] = key
    return keys


def _rows(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of ``PLACED``; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in PLACED], schema=PLACED)


def _probes(model: Model, shard_of: np.ndarray, places: np.ndarray, small) -> Callable:
    """Of a task's documents, the rows of their exact counts, and those of their pairs, by the places of the pairs' shards."""
    total, once = model.total, model.once
    whole = float(total + model.distinct + 1)

    def turn(block: int) -> int:
        return (block >> 32) + block  # the first blocks of all tasks differ, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigrams, often, often_n = small.value
        unknown_history = unigrams.levels(np.array([END_HASH]))
        block, docs, gathered, parts = TaskContext.get().partitionId() << 32, 0, 0, []

        def give() -> Iterator[pa.RecordBatch]:
            pairs, word, history, doc = map(np.concatenate, zip(*parts))
            parts.clear()
            order = np.argsort(pairs)
            pairs = pairs[order]
            start = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            doc, word, history, pairs = doc[order], word[order][start], history[order][start], pairs[start]
            times = np.diff(start, append=len(doc))
            place = places[shard_of[segment_of(pairs)], turn(block) % places.shape[1]]
            edges = np.union1d(np.flatnonzero(place[1:] != place[:-1]) + 1, np.arange(0, len(pairs) + ROW_KEYS, ROW_KEYS).clip(max=len(pairs))).tolist()
            start = np.append(start, len(doc))
            for at in range(0, len(edges) - 1, 64):
                cuts = edges[at : at + 65]
                data = [_pack(pairs[a:b], times[a:b].astype(np.uint32), word[a:b], history[a:b], doc[start[a] : start[b]]) for a, b in zip(cuts, cuts[1:])]
                yield _rows(len(data), place=pa.array(place[cuts[:-1]]), block=pa.array([block] * len(data)), row=pa.array([docs] * len(data)), data=pa.array(data, pa.binary()))

        for batch in batches:
            for piece in pieces(batch):
                tokens, sizes = _hashes(raw_texts(piece.column(1)))
                first = np.cumsum(sizes) - sizes
                kinds, inverse = np.unique(tokens, return_inverse=True)
                at = np.minimum(np.searchsorted(often, kinds), max(len(often) - 1, 0))
                exact = np.where(often[at] == kinds, often_n[at], 0) if len(often) else np.zeros(len(kinds), np.int64)
                seen = exact[inverse]
                known = np.add.reduceat((seen > 0).astype(np.int64), first)
                base = np.add.reduceat(np.where(seen > 0, np.log10((seen + 1) / whole), 0.0), first)
                edge = np.concatenate([[0], np.cumsum(sizes - known)]) if total else np.zeros(len(sizes) + 1, np.int64)
                rest = tokens[seen == 0].view(np.int64) if total else np.zeros(0, np.int64)
                if docs and (docs + len(sizes) > BLOCK_DOCS or gathered + len(tokens) > BLOCK_TOKENS):
                    yield from give()
                    block, docs, gathered, parts = block + 1, 0, 0, []
                yield _rows(
                    len(sizes), place=pa.array(np.full(len(sizes), places.flat[turn(block) % places.size])), block=pa.array([block] * len(sizes)), row=pa.array(np.arange(docs, docs + len(sizes))), id=piece.column(0), n_tokens=pa.array(sizes),
                    n_known=pa.array(known), base=pa.array(base), rest=pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(rest)))
                if total:
                    level = unigrams.levels(kinds).astype(np.uint8)[inverse]
                    history = np.empty_like(level)
                    history[1:] = level[:-1]
                    history[first] = unknown_history
                    parts.append((pair_keys(_before(tokens, sizes), tokens), level, history, np.repeat(np.arange(docs, docs + len(sizes)).astype(np.uint16), sizes)))
                    docs += len(sizes)
                    gathered += len(tokens)
        if parts:
            yield from give()

    return run


def _answers(model: Model, places: np.ndarray) -> Callable:
    """For each block's pairs of a shard, whose segments come first, the sum of log10 probabilities in each document."""
    total, followers = model.total, model.followers
    number = {key: shard for shard, own in enumerate(places.tolist()) for key in own}
    unknown = model.once / total if model.once else 1 / (total + 1)

    def sums(pairs: LevelFilter, rows: list[tuple[np.ndarray, ...]], docs: int) -> bytes:
        """All pairs of a block and shard at once, by their keys, whatever order their rows come in."""
        keys, times, word, history, doc = map(np.concatenate, zip(*sorted(rows, key=lambda r: r[0][0])))
        single = np.where(word > 0, (1 - unknown) * np.minimum(MEANS[word] / total, 1.0), unknown)
        mass = followers[history]
        p = np.where(history > 0, np.minimum((MEANS[pairs.levels(keys)] + mass * single) / np.maximum(MEANS[history] + mass, 1e-9), 1.0), single)
        logs = np.log10(np.maximum(p, np.minimum(single, 1e-12)))
        return np.bincount(doc, np.repeat(logs, times), docs).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, bytes] = {}
        pairs, at, docs, rows = None, (None, None), 0, []

        def give() -> Iterator[pa.RecordBatch]:
            if rows:
                yield _rows(1, place=pa.array([at[0]]), block=pa.array([at[1]]), row=pa.array([-1 - number[at[0]]]), data=pa.array([sums(pairs, rows, docs)], pa.binary()))

        for batch in batches:
            if (documents := batch.filter(batch.column("n_tokens").is_valid())).num_rows:
                yield documents
            for place, block, row, data in zip(*(batch.column(c).to_pylist() for c in ("place", "block", "row")), batch.column("data")):
                if not data.is_valid:
                    continue
                if (place, block) != at:
                    yield from give()
                    if place != at[0]:
                        segments, pairs = {}, None
                    at, docs, rows = (place, block), row, []
                if block < 0:
                    segments[row] = data.as_py()
                    continue
                if pairs is None:
                    pairs, segments = LevelFilter.join(segments), {}
                rows.append(_unpack(data.as_buffer(), np.uint32, np.uint8, np.uint8, np.uint16))
        yield from give()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their scores: of each block the sums of all shards come first, shard after shard."""
    at, sums = None, None
    for batch in batches:
        blocks, rows = batch.column("block").to_numpy(), batch.column("row").to_numpy()
        score = np.zeros(batch.num_rows)
        for i, (block, row, data) in enumerate(zip(blocks.tolist(), rows.tolist(), batch.column("data"))):
            if block != at:
                at, sums = block, None
            if row < 0:
                own = np.frombuffer(data.as_buffer(), np.float64)
                sums = own if sums is None else sums + own
            elif sums is not None:
                score[i] = sums[row]
        kept = pa.RecordBatch.from_arrays([*(batch.column(c) for c in DONE[:-1]), pa.array(score)], names=DONE).filter(pa.array(rows >= 0))
        if kept.num_rows:
            yield kept


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of each row."""
    spark = docs.sparkSession
    whole = float(model.total + model.distinct + 1)
    small = spark.sparkContext.broadcast((model.unigrams, *model.frequent))
    # Few shards are there several times, so that all cores have some: a block goes to one of each shard's places.
    copies = -(-2 * spark.sparkContext.defaultParallelism // len(model.shards))
    places = _apart(spark, len(model.shards) * copies).reshape(len(model.shards), copies)
    shard_of = np.zeros(1 << _SEGMENT_BITS, np.int64)
    for number, shard in enumerate(model.shards):
        shard_of[shard] = number

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, data = batch.column(0), batch.column(1)
            for copy in range(copies):
                yield _rows(batch.num_rows, place=pa.array(places[shard_of[row.to_numpy()], copy]), block=pa.array([-1] * batch.num_rows, pa.int64()), row=row.cast(pa.int64()), data=data)

    schema = "place long, block long, row long, data binary, id long, n_tokens long, n_known long, base double, rest array<long>"
    probes = keyed_texts(docs, key, text).mapInArrow(_probes(model, shard_of, places, small), schema)
    segments = model.pairs.filter("segment >= 0").select("segment", "data").mapInArrow(deal, schema)
    answers = probes.unionByName(segments).repartition(places.size, "place").sortWithinPartitions("place", "block").mapInArrow(_answers(model, places), schema)
    added = answers.repartition(places.size, "block").sortWithinPartitions("block", "row")
    scored = _pinned(added.mapInArrow(_added, "id long, n_tokens long, n_known long, base double, rest array<long>, score double").withColumn("row", F.monotonically_increasing_id()), "scores")
    # Words that aren't frequent: exact counts from the table.
    rare = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    c = F.coalesce("n", F.lit(0))
    looked = rare.join(model.counts, "key", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((c + 1) / F.lit(whole))).alias("more_base"))
    return scored.join(looked, "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")


_LONG = pa.int64()
PLACED = pa.schema([
    ("place", _LONG), ("block", _LONG), ("row", _LONG), ("data", pa.binary()), ("id", _LONG), ("n_tokens", _LONG), ("n_known", _LONG), ("base", pa.float64()), ("rest", pa.list_(_LONG))])
DONE = ["id", "n_tokens", "n_known", "base", "rest", "score"]
