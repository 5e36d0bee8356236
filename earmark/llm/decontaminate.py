"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every document is a query. A posting holds the BM25 weight of a term in an item as a share of the score the
item needs, so that one threshold, 1, serves all items. The needed score is derived, not tuned: an item with s word shingles
of which 80 % must be found can lack at most s - ceil(0.8 s) words, so its full score less its heaviest such words is a
bound that no verified item falls below. Items found are then verified: the share of the item's distinct five-word shingles
that the passage contains, question and answer together, must reach ``overlap``; where the benchmark has an answer of its
own, so must the share of the answer's words.

Passages are windows of two strides, a stride being the length of the longest item at least, so that any copy of an item
lies in one passage whole. Before single passages, whole stretches of 16 strides are tried on block maxima alone.

Words are runs of letters and digits, A-Z lower-cased; other ASCII characters separate, bytes over 127 belong to words.

Defined results: a null or empty text or item matches nothing; an item of fewer than five words is one shingle; a document
with a null id is reported with null; repeated rows are reported each; several copies in one document give the best one; an
empty table on either side gives no rows. Very long texts are searched whole; of items with equal scores all are reported. Other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import keyed, keyed_texts, pieces, raw_texts

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 2
STRIDE = 64
STRETCH = 16
#: Items that are indexed and broadcast at once; more are searched in several passes over the documents.
ITEMS_AT_ONCE = 50_000
BYTES_AT_ONCE = 64 << 20
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_KEEP).split()


def shingles(tokens: list[bytes]) -> set[bytes]:
    if not tokens:
        return set()
    return {b" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))}


@dataclass
class Item:
    key: int
    grams: set[bytes]
    answer: Counter | None


@dataclass
class Index:
    """Postings by term, items ascending, with the maximum of each block of ``BLOCK`` items."""

    overlap: float
    items: list[Item] = field(default_factory=list)
    ids: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    blocks: list[dict[int, float]] = field(default_factory=list)
    longest: int = 0

    @classmethod
    def build(cls, rows: list[tuple[int, str | None, str | None]], overlap: float = OVERLAP) -> Index:
        out = cls(overlap)
        texts = []
        # Items of like length share a block: the weights of their terms are alike, so that block maxima bound tightly.
        for key, question, answer in sorted(rows, key=lambda r: len(r[1] or "") + len(r[2] or "")):
            tail = terms((answer or "").encode())
            tokens = terms((question or "").encode()) + tail
            if tokens:
                texts.append(tokens)
                out.items.append(Item(key, shingles(tokens), Counter(tail) if tail else None))
        if not texts:
            return out
        out.longest = max(map(len, texts))
        df = Counter(t for x in texts for t in set(x))
        mean = sum(map(len, texts)) / len(texts)
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for i, tokens in enumerate(texts):
            norm = K1 * (1 - B + B * len(tokens) / mean)
            weight = {t: math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(tokens).items()}
            n_grams = len(out.items[i].grams)
            repeats = max(1, len(tokens) - SHINGLE + 1) - n_grams
            lacking = n_grams - math.ceil(overlap * n_grams - 1e-9) + repeats
            needed = max(sum(weight.values()) - sum(sorted(weight.values(), reverse=True)[:lacking]), 1e-9)
            for t, w in weight.items():
                lists[t].append((i, w / needed))
        for t, found in lists.items():
            out.ids[t] = len(out.postings)
            out.postings.append(([i for i, _ in found], [w for _, w in found]))
            best: dict[int, float] = {}
            for i, w in found:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), w)
            out.blocks.append(best)
        return out

    def prepare(self) -> None:
        """Block maxima by term as flat arrays; made once in each task."""
        count = np.array([len(b) for b in self.blocks], np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.block_at = np.array([k for b in self.blocks for k in b], np.int64)
        self.block_max = np.array([w for b in self.blocks for w in b.values()], np.float64)
        self.n_blocks = (len(self.items) + BLOCK - 1) // BLOCK
        self.top = np.array([max(b.values()) for b in self.blocks])

    def open_blocks(self, query: np.ndarray) -> np.ndarray:
        """Blocks whose maxima over the query's terms add up to the threshold."""
        first, count = self.first[query], self.first[query + 1] - self.first[query]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.flatnonzero(np.bincount(self.block_at[at], self.block_max[at], self.n_blocks) >= 1 - 1e-9)

    def search(self, query: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the query's distinct terms reaches 1."""
        lists = [self.postings[t] for t in query.tolist()]
        maxima, tops = [self.blocks[t] for t in query.tolist()], self.top[query].tolist()
        at = [0] * len(lists)
        found, end = [], len(self.items)
        order = list(range(len(lists)))
        while True:
            order = sorted((k for k in order if at[k] < len(lists[k][0])), key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, end
            for k in order:
                bound += tops[k]
                if bound >= 1 - 1e-9:
                    pivot = lists[k][0][at[k]]
                    break
            if pivot == end:
                return found
            block = pivot // BLOCK
            here = [k for k in order if lists[k][0][at[k]] <= pivot]
            if sum(maxima[k].get(block, 0.0) for k in here) >= 1 - 1e-9:
                goal, score = pivot, 0.0
                for k in here:
                    items, weights = lists[k]
                    while at[k] < len(items) and items[at[k]] < goal:
                        at[k] += 1
                    if at[k] < len(items) and items[at[k]] == goal:
                        score += weights[at[k]]
                        at[k] += 1
                if score >= 1 - 1e-9:
                    found.append((pivot, score))
            else:
                # The lists up to the pivot can't reach the threshold in this block: go to its end, or to where another list joins.
                later = [lists[k][0][at[k]] for k in order if lists[k][0][at[k]] > pivot]
                goal = min([(block + 1) * BLOCK, *later[:1]])
                for k in here:
                    items = lists[k][0]
                    while at[k] < len(items) and items[at[k]] < goal:
                        at[k] += 1


def passages(index: Index, tokens: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
    """Start, end and items found of each passage that may hold an item."""
    stride = max(STRIDE, index.longest)
    get = index.ids.get
    ids = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
    for at in range(0, max(1, len(ids) - stride), stride * STRETCH):
        stretch = ids[at : at + stride * (STRETCH + 1)]
        query = np.unique(stretch)
        query = query[query >= 0]
        if not len(query) or not len(index.open_blocks(query)):
            continue
        for start in range(0, max(1, len(stretch) - stride), stride):
            query = np.unique(stretch[start : start + 2 * stride])
            query = query[query >= 0]
            if len(query) and len(index.open_blocks(query)):
                found = index.search(query)
                if found:
                    yield at + start, min(at + start + 2 * stride, len(ids)), found


def verified(index: Index, raw: bytes) -> dict[int, tuple[float, float, float, int]]:
    """Item place -> (overlap, answer overlap, score, first word of the passage), best passage first."""
    best: dict[int, tuple[float, float, float, int]] = {}
    tokens = terms(raw)
    for start, end, found in passages(index, tokens):
        part = tokens[start:end]
        grams, bag = shingles(part), None
        for i, score in found:
            item = index.items[i]
            if len(item.grams) == 1 and len(next(iter(item.grams)).split(b" ")) < SHINGLE:
                share = float(b" " + next(iter(item.grams)) + b" " in b" " + b" ".join(part) + b" ")
            else:
                share = len(item.grams & grams) / len(item.grams)
            if share < index.overlap - 1e-9:
                continue
            answer = 1.0
            if item.answer is not None:
                bag = bag or Counter(part)
                answer = sum((item.answer & bag).values()) / sum(item.answer.values())
                if answer < index.overlap - 1e-9:
                    continue
            if i not in best or (share, answer, score) > best[i][:3]:
                best[i] = (share, answer, score, start)
    return best


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded number and bytes; one block is on the driver at a time."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("_c1", F.lit(""))) + F.octet_length(F.coalesce("_c2", F.lit("")))).alias("size")).first()
    blocks = max(1, math.ceil(2 * total["n"] / ITEMS_AT_ONCE), math.ceil(2 * (total["size"] or 0) / BYTES_AT_ONCE))
    if blocks == 1 or total["n"] <= ITEMS_AT_ONCE and (total["size"] or 0) <= BYTES_AT_ONCE:
        yield [tuple(r) for r in items.orderBy("_c0", "_c1").collect()]
        return
    dealt = items.withColumn("block", F.pmod(F.xxhash64("_c0", "_c1"), F.lit(blocks)))
    for b in range(blocks):
        yield [tuple(r) for r in dealt.filter(F.col("block") == b).drop("block").orderBy("_c0", "_c1").collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text",
    answer: str | None = None, overlap: float = OVERLAP,
) -> DataFrame:
    """(id, item_id, overlap, answer_overlap, score, at_word) of each document and item it contains."""
    if not 0 < overlap <= 1:
        raise ValueError("overlap must be over 0 and 1 at most")
    spark, schema = docs.sparkSession, "id long, item_id long, overlap double, answer_overlap double, score double, at_word long"
    items = keyed(benchmark, item, question, *([answer] if answer else [])) if answer else keyed(benchmark, item, question).withColumn("_c2", F.lit(None).cast("string"))
    rows = keyed_texts(docs, key, text)
    out = None
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(Index.build(block, overlap))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            if not index.items:
                return
            index.prepare()
            for batch in batches:
                made = []
                for part in pieces(batch):
                    for doc, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                        made += [(doc, index.items[i].key, *v) for i, v in verified(index, raw).items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))],
                    names=["id", "item_id", "overlap", "answer_overlap", "score", "at_word"])

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out
