"""Near copies by exact Jaccard similarity of word shingles; tries of SimHash fingerprints name the first pairs to compare, minima of hash functions and rare shingles all others.

A text is the set of its shingles of ``SHINGLE`` words (a shorter text is one shingle). Two texts are linked if their sets have a
Jaccard similarity of ``LEAST`` or more. A set's SimHash fingerprint is the majority of each bit over its shingles. Fingerprints meet in the
self-join of tries of :mod:`earmark.llm.simhash`, and each is compared with the nearest smaller one that differs in ``BUDGET`` bits at most.
Sets of similarity 0.8 differ in ten of the 64 bits on average, a budget that tries can't afford for all pairs: what they leave apart is
named by bands and rare shingles, so no link depends on the budget.

The least values of ``BANDS`` x ``ROWS_PER_BAND`` hash functions are cut into bands, and
texts that agree in a band share a bucket: a pair with similarity s shares none with probability (1 - s ** 5) ** 25, which is
0.00005 at 0.8 and less above. Each pair that is linked was compared by its whole sets.

Equal sets are one node. First each node is compared with the one that the tries name, or else with the least node of the bucket that it shares
most often with one; then with the least nodes of its other buckets, where both are still in different components. So a large group costs about one comparison a
member. Whole sets are compared only where a bound allows it: shingles are dealt to ``CELLS`` cells by hash, and a cell in which one set has
an odd and the other an even number of them holds at least one that only one set has. Texts of a family that stay a little below the
similarity are told apart by that, without a text being moved. Nodes that share a bucket and stay in different components are compared by rare shingles: all their shingles are ordered by
rising frequency, and sets of similarity 0.8 share one of the first |x| - ceil(0.8 |x|) + 1. Shingles that a whole family has are
frequent and come last, so texts of a family that are less similar seldom meet. The place of the shared shingle bounds what the sets
can still have in common. Here, too, each node is first compared with the least one of a shingle's list. What stays apart meets in blocks of
``BLOCK`` nodes of a list, whose bounds are taken at once, pair by pair of blocks: each node first with the one that differs from it in the fewest
cells, so that a large family becomes one component by about one comparison a node, then with all others that are still apart.

The texts of nodes that share a bucket or are named by the tries are written once; from there a text travels once for each comparison. The node with which
many are compared is held once for each ``LANE`` of them, so it is no hot key; other tables hold numbers only.

Defined results: null and empty texts have the empty set and are linked with each other only; a component without any non-null
id has a null component id; repeated ids and rows are kept, equal texts are one node however many they are; very long texts are read
whole; a similarity of exactly 0.8 links; an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.common import keyed_texts, pieces, pin, raw_texts, words
from earmark.llm.components import components
from earmark.llm.simhash import majority, near_pairs

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Most bits in which fingerprints differ that the tries find.
BUDGET = 4
BANDS, ROWS_PER_BAND = 25, 5
SEED = 42
_CHUNK = 4096
#: Cells of a set's parities, as bits of 64-bit numbers.
CELLS = 512
#: Nodes that are compared with one copy of another node.
LANE = 64
#: Nodes of a shingle's list that meet others at once.
BLOCK = 128
_draw = np.random.default_rng(SEED)
_MIX = _draw.integers(0, 1 << 63, BANDS * ROWS_PER_BAND, np.uint64), _draw.integers(0, 1 << 63, BANDS * ROWS_PER_BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all different shingles, sorted; empty without a word."""
    parts = words(raw)
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    starts, ends = (end - length)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def buckets(found: np.ndarray) -> list[int]:
    """One signed hash for each band; none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS_PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        mixed = (found[at : at + _CHUNK, None] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, -1))]


def parities(found: np.ndarray) -> list[int]:
    """Whether each cell holds an odd number of the shingles, as bits of signed 64-bit numbers."""
    odd = np.bincount((found % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            sets, sizes, prints, bands, odd = [], [], [], [], []
            for raw in raw_texts(piece.column(2)):
                found = shingles(raw)
                sets.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
                sizes.append(len(found))
                prints.append(majority(found))
                bands.append(buckets(found))
                odd.append(parities(found))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["id", "tag", "node", "size", "fp", "bands", "odd"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by b, lane: first the text of b, then those of the nodes a to compare with it."""
    node, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for piece in pieces(batch):
            a, b = [], []
            for to, other, raw in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), raw_texts(piece.column(2))):
                found = shingles(raw)
                if other is None:
                    node, own = to, found
                elif to == node and similar(own, found):
                    a.append(other)
                    b.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar enough. ``texts``: node, text."""
    lanes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LANE).alias("lanes"))
    dealt = pairs.join(lanes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("lanes")).alias("lane"), "a")
    heads = lanes.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"))
    head = heads.join(texts.withColumnRenamed("node", "b"), "b").select("b", "lane", F.lit(None).cast("long").alias("a"), "text")
    rest = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "lane", "a", "text")
    met = head.unionByName(rest).repartition("b", "lane").sortWithinPartitions("b", "lane", F.col("a").asc_nulls_first())
    return pin(met.select("b", "a", "text").mapInArrow(_compare, "a long, b long"), "links")


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: the least node of each fingerprint with that of the nearest smaller fingerprint within the budget, and other nodes
    of a fingerprint with its least one. ``nodes``: node, size, fp."""
    some = nodes.filter("size > 0")
    least = pin(some.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
    met = near_pairs(least.select("fp"), BUDGET).select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("other"))
    # One number, so that the pairs are aggregated by hash where they are found and a large family's aren't written.
    near = F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).cast("long"), 60) + F.shiftrightunsigned("other", 4)
    nearest = pin(met.groupBy("fp").agg(F.min_by("other", near).alias("other")), "nearest")
    pairs = nearest.join(least.select("fp", F.col("b").alias("x")), "fp").join(least.select(F.col("fp").alias("other"), F.col("b").alias("y")), "other")
    same = some.join(least, "fp").filter("b < node").select(F.col("node").alias("a"), "b")
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).unionByName(same)


def _list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 64):
            sets = [shingles(raw) for raw in raw_texts(piece.column(1))]
            node = np.repeat(piece.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], names=["node", "shingle"])


def _prefixes(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(shingle, node, size, place): the first shingles of each node in rising frequency, as far as a similar set must share one of them.

    ``texts``: node, text; ``sizes``: node, size. Shingles that no other node has are only counted.
    """
    held = pin(texts.mapInArrow(_list_shingles, "node long, shingle long"), "shingles")
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = held.join(counts, "shingle").join(sizes, "node")
    order = Window.partitionBy("node").orderBy("n", "shingle")
    shared = shared.withColumn("before", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("node")))
    # Those that no other node has come first, and their number says where the others stand.
    place = F.col("size") - F.col("all") + F.col("before")
    prefix = F.col("size") - F.ceil(F.col("size") * LEAST[0] / LEAST[1]) + 1
    return pin(shared.withColumn("place", place).filter(F.col("place") <= prefix).select("shingle", "node", "size", "place"), "prefixes")


def _mixed(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists of shingles whose nodes are in several components. ``roots``: node, root and, if they are known, the parities ``odd``."""
    rooted = prefixes.join(roots, "node")
    several = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("shingle")
    return pin(rooted.join(several, "shingle", "left_semi"), "mixed")


def _alike(odd: bool = True) -> Column:
    """Whether sets x and y may be similar enough by their sizes and, with ``odd``, by their parities."""
    sizes = LEAST[1] * F.least("x.size", "y.size") >= LEAST[0] * F.greatest("x.size", "y.size")
    if not odd:
        return sizes
    # Similarity p / q of sizes with sum s leaves at most (q - p) * s / (q + p) that only one set has.
    differ = sum((F.bit_count(F.get("x.odd", F.lit(k)).bitwiseXOR(F.get("y.odd", F.lit(k)))) for k in range(CELLS // 64)), F.lit(0))
    return sizes & (sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * (F.col("x.size") + F.col("y.size")))


def _close(mixed: DataFrame) -> Column:
    """Whether sets x and y, which share a shingle, may be similar enough, also by what follows it."""
    # Sets share the shingle and at most what follows it; similarity p / q of sizes with sum s needs p * s / (p + q) in common.
    room = sum(LEAST) * (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1) >= LEAST[0] * (F.col("x.size") + F.col("y.size"))
    return room & _alike("odd" in mixed.columns)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _least_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node of a list with the list's least one, if that is in another component."""
    held = [c for c in mixed.columns if c != "shingle"]
    heads = mixed.groupBy("shingle").agg(F.min_by(F.struct(*held), "node").alias("h")).select("shingle", "h.*")
    x, y = mixed.alias("x"), heads.alias("y")
    return _pairs(x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & _close(mixed)))


def _members(blocks: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Bounds of the blocks, and the members of all of them as columns; parities as rows of numbers."""
    held = blocks.flatten()
    columns = {held.type.field(k).name: c for k, c in enumerate(held.flatten())}
    odd = columns.pop("odd", None)
    found = {name: c.to_numpy(zero_copy_only=False) for name, c in columns.items()}
    if odd is not None:
        found["odd"] = odd.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(held), -1)
    return np.concatenate([[0], np.cumsum(blocks.value_lengths().to_numpy(zero_copy_only=False))]), found


def _near_members(x: dict[str, np.ndarray], y: dict[str, np.ndarray], best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of x and y in different components that the bounds of :func:`_close` leave, and the cells in which they differ; with ``best`` the least of each."""
    left, right = np.minimum.outer(x["size"], y["size"]), np.maximum.outer(x["size"], y["size"])
    ahead = np.minimum.outer(x["size"] - x["place"], y["size"] - y["place"]) + 1
    both = left + right
    i, j = np.nonzero(np.not_equal.outer(x["root"], y["root"]) & (LEAST[1] * left >= LEAST[0] * right) & (sum(LEAST) * ahead >= LEAST[0] * both))
    differ = np.zeros(len(i), np.int64)
    if "odd" in x:
        differ = np.bitwise_count(x["odd"][i] ^ y["odd"][j]).sum(axis=1, dtype=np.int64)
        few = sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * both[i, j]
        i, j, differ = i[few], j[few], differ[few]
    if best:
        firsts = []
        for own, other in ((i, y["node"][j]), (j, x["node"][i])):
            order = np.lexsort((other, differ))
            firsts.append(order[np.unique(own[order], return_index=True)[1]])
        kept = np.union1d(*firsts)
        i, j, differ = i[kept], j[kept], differ[kept]
    return x["node"][i], y["node"][j], differ


def _meet(best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 64):
                (x_ends, x), (y_ends, y) = _members(piece.column(0)), _members(piece.column(1))
                found = [np.zeros((3, 0), np.int64)]
                for k in range(piece.num_rows):
                    cut = ({name: c[ends[k] : ends[k + 1]] for name, c in held.items()} for ends, held in ((x_ends, x), (y_ends, y)))
                    found.append(np.stack(_near_members(*cut, best)))
                a, b, differ = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(differ)], names=["a", "b", "differ"])

    return run


def _rare_pairs(mixed: DataFrame, best: bool = False) -> DataFrame:
    """Pairs (a, b) of all nodes of a list that are in different components; with ``best`` only each node with the one that differs in the fewest cells."""
    held = F.struct(*[c for c in mixed.columns if c != "shingle"])
    dealt = mixed.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("shingle").orderBy("root", "node")) - 1) / BLOCK))
    blocks = dealt.groupBy("shingle", "block").agg(F.collect_list(held).alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    # Blocks of one component have nothing to compare; those of one list are dealt to many tasks.
    apart = (F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")) & (F.col("x.block") <= F.col("y.block"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & apart).repartition("x.shingle", "x.block", "y.block")
    found = met.select(F.col("x.held").alias("x"), F.col("y.held").alias("y")).mapInArrow(_meet(best), "a long, b long, differ long")
    if not best:
        return found.select("a", "b").distinct()
    found = pin(found.distinct(), "near")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "differ"))
    least = both.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
    return least.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _best_pairs(mixed: DataFrame) -> DataFrame:
    return _rare_pairs(mixed, best=True)


def _rooted(links: DataFrame, rooted: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components by ``links`` (a, b) and those that ``rooted`` has; only roots that new links join are looked at again."""
    if rooted is None:
        return pin(components(links), "roots")
    a, b = (rooted.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    joined = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    merged = pin(components(joined), "merged")
    to = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = rooted.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return pin(old.unionByName(merged.join(rooted, "node", "left_anti")), "roots")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, tag (xxhash64 of the text), component_id (smallest id linked to it directly or not, its own
    included), root (smallest node of the component)."""
    rows = keyed_texts(docs, key, text).select("_c0", F.xxhash64("_c1").alias("_c1"), F.col("_c1").alias("_c2"))
    made = pin(rows.mapInArrow(_sketch, "id long, tag long, node long, size long, fp long, bands array<long>, odd array<long>"), "sketches")
    distinct = made.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.min("id").alias("least"), F.min("tag").alias("tag"))
    distinct = pin(distinct, "distinct")
    members = distinct.select("node", "size", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last").select("bucket", "b")
    members = pin(members.join(shared, "bucket"), "buckets")
    tried = members.filter("b < node").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    bounds = distinct.select("node", "size", "odd")

    def alike(pairs: DataFrame) -> DataFrame:
        met = pairs.join(bounds.alias("y"), F.col("b") == F.col("y.node")).join(bounds.alias("x"), (F.col("a") == F.col("x.node")) & _alike())
        return met.select(*pairs.columns)

    near = pin(alike(_trie_pairs(distinct.select("node", "size", "fp"))), "tries")
    tried = pin(alike(tried), "pairs")
    best = tried.join(near.select("a").distinct(), "a", "left_anti").groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b"))
    best = pin(near.unionByName(best), "best")
    # Small tables are written, so that Spark knows their size and needn't shuffle texts to meet them.
    met = members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sharing = pin(distinct.select("node", "tag").join(met, "node", "left_semi"), "sharing")
    texts = pin(rows.join(sharing, rows["_c1"] == sharing["tag"]).groupBy("node").agg(F.first("_c2").alias("text")), "compared")
    rooted = _rooted(_links(texts, best))

    def apart(pairs: DataFrame) -> DataFrame:
        a, b = (rooted.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        known = pairs.join(a, "a", "left").join(b, "b", "left")
        return known.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    more = pin(apart(tried.join(best, ["a", "b"], "left_anti")), "more")
    if not more.isEmpty():
        rooted = _rooted(_links(texts, more), rooted)
    found = members.join(rooted, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = found.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    alone = pin(found.join(mixed, "bucket", "left_semi").select("node", "size", "root").distinct(), "apart")
    if not alone.isEmpty():
        prefixes = _prefixes(texts.join(alone.select("node"), "node", "left_semi"), alone.select("node", "size"))
        alone, tried = alone.join(bounds.select("node", "odd"), "node"), tried.select("a", "b").unionByName(near)
        roots = alone.select("node", "root", "odd")
        for choose in (_least_pairs, _best_pairs, _rare_pairs):
            others = pin(choose(_mixed(prefixes, roots)).join(tried, ["a", "b"], "left_anti"), "others")
            if others.isEmpty():
                continue
            rooted, tried = _rooted(_links(texts, others), rooted), tried.unionByName(others)
            roots = alone.select("node", "odd").join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "odd")
    root = distinct.select("node", "least").join(rooted, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.select("id", "tag", "node").join(root.join(least, "root"), "node").select("id", "tag", "component_id", "root")
