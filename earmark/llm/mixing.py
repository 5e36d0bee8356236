"""Mixing sources to target weights: exact block quotas, split among shards by a multivariate-hypergeometric tree.

Sources, by code point and null last, carry the weights in turn. They share ``volume`` times all words by weight; no target
exceeds ``most`` times its source's words, and what is over is shared anew by weight until no target is above. A source takes
every document floor(target / words) times, and the rest from documents in a seeded order: blocks of documents first, then
single documents of the one block in which the rest ends, up to the nearest document.

For the output, a source's draws are its blocks, once for each pass. The tree halves the shards again and again; at each node
the draws that go left are, source by source, one draw from a hypergeometric distribution given what the sources before it
took, so that together they are a multivariate-hypergeometric sample, and each shard gets its exact number of draws. Runs of
the source's permuted blocks, disjoint between shards, fill the quotas, and each shard is shuffled by hash.

All of it is DataFrame functions: sums by source and block with partial aggregation, quotas by folding over arrays that have
one entry a source. The only windows over a whole source hold its at most ``BLOCKS`` blocks.

Defined results: null or blank texts have size 0 and are taken like their block, in words always 0; null sources are a source
of their own; a null id is an id like any other; rows that agree in id, source and size are one unit and taken alike, so repeated rows
are; very long texts count all their words; ties of hashes go by id and size; an empty table gives no rows; no column that ``docs`` has
besides is read or overwritten, whatever its name. Sources are ranked and their quotas folded in one task: tens of thousands, not millions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.common import WORD_PATTERN, fresh, pin

WEIGHTS = (5, 2, 1)
VOLUME = 1.5
MOST = 2
BLOCKS = 512
#: Documents of a block, as long as a source has fewer than BLOCKS blocks.
BLOCK_ROWS = 64
SHARDS = 16


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _log_factorial(n: Column) -> Column:
    """ln(n!): exact to 20, then Stirling's series, whose error is below 1e-9 there."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, volume: float = VOLUME, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, units) with the target of each source.

    Sources in the order of most * words / weight fill up first. The k-th is full if the level that the sources from it on
    would reach without it being full is not lower; those after the full ones share what is left by weight.
    """
    weighted = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = (
        weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("wanted", total * F.lit(float(volume)))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("before")) / F.col("from_here"))
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level")))
    shared = F.min(F.when(~F.col("full"), F.struct("before", "level"))).over(Window.partitionBy())["level"]
    return ranked.select("source", "source_size", "units", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * shared).alias("target"))


def _quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, first, last): the draws, numbered from 0 within a source, that each shard takes.

    ``draws`` has source and n. One row a tree node: its sources with their draws, and its number of shards.
    """
    empty = F.array().cast("array<struct<source:string,n:bigint>>")
    nodes = draws.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("parts")).select(
        F.lit(0).alias("first_shard"), F.lit(shards).alias("shards"), F.coalesce("parts", empty).alias("parts"))
    while shards > 1:
        left_shards = F.floor(F.col("shards") / 2).cast("int")
        total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
        left = F.floor(total * left_shards / F.col("shards")).cast("bigint")

        def choose(n: Column, k: Column) -> Column:
            return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

        def draw(state: Column, part: Column) -> Column:
            """Of ``left`` more draws from ``pool`` remaining, how many fall on this source: inverse of its distribution."""
            others = state["pool"] - part["n"]
            low = F.greatest(F.lit(0).cast("bigint"), state["left"] - others)
            high = F.least(part["n"], state["left"])
            u = _uniform(seed, "first_shard", "shards", part["source"])
            taken = F.aggregate(
                F.sequence(low, high), F.struct(F.lit(0.0).alias("sum"), low.alias("at")),
                lambda s, x: F.struct(
                    (s["sum"] + F.exp(choose(part["n"], x) + choose(others, state["left"] - x) - choose(state["pool"], state["left"]))).alias("sum"),
                    F.when(s["sum"] <= u, x).otherwise(s["at"]).alias("at")))["at"]
            return F.struct((state["left"] - taken).alias("left"), others.alias("pool"), F.concat(state["out"], F.array(taken)).alias("out"))

        start = F.struct(left.alias("left"), total.alias("pool"), F.array().cast("array<bigint>").alias("out"))
        split = nodes.withColumn("go", F.when(F.col("shards") > 1, F.aggregate("parts", start, draw)["out"]))
        halves = F.when(F.col("shards") == 1, F.array(F.struct("first_shard", "shards", "parts"))).otherwise(F.array(
            F.struct("first_shard", left_shards.alias("shards"), F.transform("parts", lambda p, i: F.struct(p["source"].alias("source"), F.get("go", i).alias("n"))).alias("parts")),
            F.struct((F.col("first_shard") + left_shards).alias("first_shard"), (F.col("shards") - left_shards).alias("shards"),
                     F.transform("parts", lambda p, i: F.struct(p["source"].alias("source"), (p["n"] - F.get("go", i)).alias("n"))).alias("parts"))))
        nodes = pin(split.select(F.explode(halves).alias("h")).select("h.*"), "quotas")
        shards = (shards + 1) // 2
    flat = nodes.select(F.col("first_shard").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.source", "p.n")
    running = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("last", F.sum("n").over(running)).select("source", "shard", (F.col("last") - F.col("n")).alias("first"), "last")


def _block(seed: int) -> Column:
    """Block of a unit u of a source s."""
    n_blocks = F.least(F.lit(BLOCKS), F.ceil(F.col("s.units") / BLOCK_ROWS)).cast("int")
    return F.pmod(F.xxhash64(F.lit(seed), "u.id", "u.source", "u.size"), n_blocks)


def plan_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    volume: float = VOLUME, most: float = MOST, seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units (id, source, size, rows, block, taken copies), blocks (source, block, place, passes) and sources with targets."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), size_of(F.col(f"`{text}`")).alias("size"))
    units = pin(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    sources = pin(targets(sizes, weights, volume, most), "sources")
    same = F.col("u.source").eqNullSafe(F.col("s.source"))
    units = units.alias("u").join(sources.alias("s"), same).select(
        "u.*", _block(seed).alias("block"), F.xxhash64(F.lit(seed + 1), "u.id", "u.source", "u.size").alias("order"))
    blocks = units.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    copies = F.when(F.col("s.source_size") > 0, F.floor(F.col("s.target") / F.col("s.source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    blocks = (
        blocks.withColumn("place", F.row_number().over(permuted) - 1)
        .withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .select("b.*", copies.alias("passes"), (F.col("s.target") - copies * F.col("s.source_size") - F.col("b.before")).alias("room"))
        .withColumn("whole", (F.col("room") >= F.col("words")) & (F.col("room") > 0))
        .withColumn("cut", (F.col("room") > 0) & ~F.col("whole")))
    blocks = pin(blocks, "blocks")
    placed = units.alias("u").join(
        blocks.alias("b"), F.col("u.source").eqNullSafe(F.col("b.source")) & (F.col("u.block") == F.col("b.block"))
    ).select("u.*", "b.passes", "b.room", "b.whole", "b.cut")
    words = F.col("size") * F.col("rows")
    block = Window.partitionBy("source", "block")
    # In the block where the room ends: documents in order while they fit, then the one that comes nearest to what is left.
    cut = placed.filter("cut").withColumn("through", F.sum(words).over(block.orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("fits", F.col("through") <= F.col("room"))
    cut = cut.withColumn("gap", F.col("room") - F.coalesce(F.sum(F.when(F.col("fits"), words)).over(block), F.lit(0)))
    off = F.abs(F.col("gap") - words)
    nearest = F.row_number().over(block.orderBy(F.col("fits"), off, "order", "id", "size")) == 1
    cut = cut.withColumn("extra", (F.col("fits") | nearest & (off < F.col("gap"))).cast("long"))
    rest = placed.filter(~F.col("cut")).withColumn("extra", F.col("whole").cast("long"))
    columns = ["id", "source", "size", "rows", "block", "order", (F.col("passes") + F.col("extra")).alias("copies"), "passes", "extra", "cut"]
    return cut.select(*columns).unionByName(rest.select(*columns)), blocks, sources


def plan_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    volume: float = VOLUME, most: float = MOST, shards: int = SHARDS, seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """:func:`plan_mix`, and the shard of each pass of each block (source, block, block_shards)."""
    if shards < 1 or most < 1 or volume < 0 or volume > most:
        raise ValueError("shards and most must be 1 at least, volume between 0 and most")
    units, blocks, sources = plan_mix(docs, key, text, source, weights, volume, most, seed)
    per_source = blocks.groupBy("source").agg((F.max("passes") * F.count(F.lit(1)) + F.count(F.when(F.col("whole") | F.col("cut"), 1))).alias("n"), F.count(F.lit(1)).alias("blocks"))
    quotas = _quotas(per_source.select("source", "n"), shards, seed + 3).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("ends"))
    # The shard of pass p of a block is the first whose run of draws ends after p * blocks + place.
    where = blocks.alias("b").join(per_source.alias("n"), F.col("b.source").eqNullSafe(F.col("n.source"))).join(
        quotas.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source")))
    draws = F.sequence(F.lit(0).cast("bigint"), F.col("b.passes"))
    block_shards = F.transform(draws, lambda p: F.get(F.filter("q.ends", lambda e: e["last"] > p * F.col("n.blocks") + F.col("b.place")), F.lit(0))["shard"])
    where = pin(where.select("b.source", "b.block", block_shards.alias("block_shards")), "shards")
    return units, blocks, sources, where


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    volume: float = VOLUME, most: float = MOST, shards: int = SHARDS, seed: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken (words), and the shards its copies go to."""
    units, blocks, sources, where = plan_shards(docs, key, text, source, weights, volume, most, shards, seed)
    same = F.col("u.source").eqNullSafe(F.col("w.source")) & (F.col("u.block") == F.col("w.block"))
    total = F.col("s.source").eqNullSafe(F.col("u.source"))
    out = units.alias("u").join(where.alias("w"), same).join(sources.alias("s"), total)
    return out.select(
        "u.id", "u.source", "u.size", "s.source_size", "s.target", (F.col("u.size") * F.col("u.copies")).alias("taken"), F.col("u.copies"),
        F.slice("w.block_shards", F.lit(1), F.col("u.copies").cast("int")).alias("shards"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("u.rows"))).alias("row")).drop("row")


#: Words of a piece of a shard in the output. Each piece is sorted by a task of its own and drawn by hash, so its order is random too.
PIECE_WORDS = 4_000_000


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, shards: int = SHARDS, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, dealt to its shards and shuffled there.

    Columns are those of ``docs`` in their order and two more, _shard and _order, that say where a row goes (with more underscores
    if ``docs`` has such columns). A row finds its block by hash; only ids of blocks that are cut are looked up, so texts are
    shuffled once, to their shards.
    """
    units, blocks, sources, where = plan_shards(docs, key, text, source, seed=seed, shards=shards, **options)
    cut = pin(units.filter("cut").select("id", "source", "size", "extra"), "cut")
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    pieces = max(1, math.ceil(words / shards / PIECE_WORDS))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"),
        size_of(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.lit(seed + 4), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("drawn"))
    placed = rows.alias("u").join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.*", _block(seed).alias("block"))
    plan = where.alias("w").join(blocks.alias("b"), F.col("w.source").eqNullSafe(F.col("b.source")) & (F.col("w.block") == F.col("b.block")))
    plan = pin(plan.select("w.source", "w.block", "w.block_shards", "b.passes", "b.whole"), "plan")
    placed = placed.alias("u").join(plan.alias("b"), F.col("u.source").eqNullSafe(F.col("b.source")) & (F.col("u.block") == F.col("b.block")))
    same = F.col("u.id").eqNullSafe(F.col("c.id")) & F.col("u.source").eqNullSafe(F.col("c.source")) & (F.col("u.size") == F.col("c.size"))
    copies = F.col("b.passes") + F.coalesce("c.extra", F.col("b.whole").cast("long"))
    out = placed.join(cut.alias("c"), same, "left").select("u.row", "u.drawn", F.posexplode(F.slice("b.block_shards", F.lit(1), copies.cast("int"))).alias("copy", "shard"))
    out = out.select("row", "shard", F.xxhash64("drawn", "shard", "copy").alias("order")).withColumn("piece", F.pmod(F.shiftright("order", 8), F.lit(pieces)))
    out = out.repartition(shards * pieces, "shard", "piece").sortWithinPartitions("shard", "order")
    return out.select("row.*", F.col("shard").alias(fresh(docs.columns, "_shard")), F.col("order").alias(fresh(docs.columns, "_order")))
