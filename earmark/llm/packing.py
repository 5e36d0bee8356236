"""Token ids packed into rows of fixed length: best-fit decreasing with a segment tree over capacities.

Documents are tokenised with a public vocabulary, each ends with the end id, and one longer than a row is split into
consecutive pieces that together are the document, so nothing is lost. Every task packs its own stretch of documents: pieces
are gathered up to ``BUFFER`` token ids, then placed, longest first, each into the open row with the least room that still
holds it. Rows that have no room left are closed; a segment tree over room (not over rows) finds the least room of any open row
that is large enough, in logarithmic time. Nothing is shuffled, and memory is bounded by the buffer and the longest document.

A packed row holds ``ids`` (row length, padded with the end id), ``cu_seqlens`` (0, then the end of each piece), ``positions``
(from 0 anew for each piece; 0 in the padding), and for each piece its document and its place in it.

Defined results: a null or empty text is a piece of the end id alone; null ids are kept as null; repeated rows are packed each;
an empty table gives no rows. Ties in length keep the order of reading. Very long texts, words and runs of white space are tokenised whole.
Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earmark.llm.common import keyed_texts, pieces

LENGTH = 2048
BUFFER = 1 << 20
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the public vocabulary splits text before merging; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row from which on the pattern isn't asked to split it: its search runs out of stack there. The characters that \s means, as fixed values.
LONG_SPACE = 100_000
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SCHEMA = "ids array<int>, cu_seqlens array<int>, positions array<int>, doc_ids array<long>, offsets array<long>, n_tokens int"


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """The vocabulary's ranks, read by Spark, so that the path may be in any store. Bounded by the vocabulary."""
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in spark.read.text(path).collect() if r.value.strip())}


def token_ids(encoding, text: str) -> list[int]:
    """Ids of a text. A very long run of white space is one piece, but for its last character before other text, as the pattern has it."""
    if len(text) < LONG_SPACE:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for run in re.finditer(f"{_SPACE}{{{LONG_SPACE},}}", text):
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


class Capacities:
    """Open rows by room, and a segment tree that finds the least room of at least a given size that any row has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            node = room + self.size
            while node and not self.tree[node]:
                self.tree[node] = 1
                node >>= 1

    def best(self, needed: int) -> tuple[int, int] | None:
        """Takes out (room, row) of the fullest row that holds ``needed``."""
        node = needed + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node:
                self.tree[node] = node < self.size and (self.tree[2 * node] or self.tree[2 * node + 1])
                node >>= 1
        return room, row


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of places in ``lengths``, by best-fit decreasing."""
    rows: list[list[int]] = []
    capacities = Capacities(length)
    for place in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[place])
        fit = capacities.best(need)
        if fit is None:
            rows.append([place])
            capacities.add(length - need, len(rows) - 1)
        else:
            rows[fit[1]].append(place)
            capacities.add(fit[0] - need, fit[1])
    return rows


class Packer:
    """Gathers the pieces of documents and gives packed rows as Arrow batches."""

    def __init__(self, length: int, end: int, buffer: int):
        self.length, self.end, self.buffer = length, end, buffer
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.offsets: list[int] = []
        self.n = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), self.length):
            self.parts.append(ids[at : at + self.length])
            self.docs.append(doc)
            self.offsets.append(at)
            self.n += len(self.parts[-1])
            if self.n >= self.buffer:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        rows = best_fit(lengths, self.length)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            ids = np.full((len(part), self.length), self.end, np.int32)
            positions = np.zeros((len(part), self.length), np.int32)
            order = [p for row in part for p in row]
            counts = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.concatenate([np.cumsum(lengths[row]) for row in part])
            flat_start = np.repeat(np.arange(len(part)) * self.length, counts) + ends - lengths[order]
            steps, flat, count = np.arange(self.length, dtype=np.int32), ids.reshape(-1), positions.reshape(-1)
            for p, start in zip(order, flat_start.tolist()):
                n = len(self.parts[p])
                flat[start : start + n] = self.parts[p]
                count[start : start + n] = steps[:n]
            edge = np.concatenate([[0], np.cumsum(counts)])
            cu = np.insert(ends, edge[:-1], 0)

            def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

            whole = np.arange(len(part) + 1) * self.length
            yield pa.RecordBatch.from_arrays([
                lists(pa.array(flat), whole), lists(pa.array(cu.astype(np.int32)), edge + np.arange(len(edge))), lists(pa.array(count), whole),
                lists(pa.array([self.docs[p] for p in order], pa.int64()), edge), lists(pa.array([self.offsets[p] for p in order], pa.int64()), edge),
                pa.array(ends[edge[1:] - 1].astype(np.int32)),
            ], names=["ids", "cu_seqlens", "positions", "doc_ids", "offsets", "n_tokens"])
        self.clear()


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, buffer: int = BUFFER,
    end: int | None = None,
) -> DataFrame:
    """Packed rows of all documents: ids, cu_seqlens, positions, doc_ids, offsets, n_tokens.

    ``end`` is the end id; by default the first id after the vocabulary.
    """
    if length < 2:
        raise ValueError("length must be 2 at least")
    spark = docs.sparkSession
    ranks = read_ranks(spark, vocabulary)
    end_id = len(ranks) if end is None else end
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        packer = Packer(length, end_id, buffer)
        for batch in batches:
            for part in pieces(batch, 128):
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield from packer.add(doc, np.array([*token_ids(encoding, body or ""), end_id], np.int32))
        if packer.n:
            yield from packer.flush()

    return keyed_texts(docs, key, text).mapInArrow(run, SCHEMA)
