"""Exact vector search: scores of queries against a pool and the best K per query.

Vectors are scored in Arrow batches with one matrix product per batch. A scan keeps only the best K rows per
query and task, so the rows that leave a task do not grow with the pool. Scores are rounded to nine decimals
before ranking: the order of float additions then cannot change a rank, and ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.session import pin

# Bounds for sending the query side to every executor; larger sets take the partitioned route.
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
# Largest result (queries times k) that joins may broadcast.
MAX_BROADCAST_RESULTS = 200_000
SCORE_DECIMALS = 9
# Scores a task holds at a time (8 bytes each).
SCORES_IN_MEMORY = 4_000_000


def vector_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; all lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return np.zeros((0, 0))
    if flat.size % n:
        raise ValueError("vectors of one column must have one length")
    return flat.reshape(n, flat.size // n)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return matrix / length


def score_matrix(queries: np.ndarray, pool: np.ndarray, metric: str) -> np.ndarray:
    """Scores, larger is better: inner product, cosine, or negative squared distance. Undefined scores rank last."""
    if metric == "l2":
        squares = (queries**2).sum(axis=1)[:, None] + (pool**2).sum(axis=1)[None, :]
        raw = -np.maximum(squares - 2.0 * (queries @ pool.T), 0.0)
    elif metric == "cosine":
        raw = unit_rows(queries) @ unit_rows(pool).T
    else:
        raw = queries @ pool.T
    return np.round(np.where(np.isnan(raw), -np.inf, raw), SCORE_DECIMALS) + 0.0


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` of one query as (ids, scores); ties by id."""
    if scores.size > k:
        floor = np.partition(scores, scores.size - k)[scores.size - k]
        keep = np.flatnonzero(scores >= floor)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_rows_of(
    queries: np.ndarray, pool: np.ndarray, ids: np.ndarray, k: int, metric: str, floor: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, scores) of the best ``k`` of a batch, scored in slices of bounded memory.

    Queries whose ``floor`` no row of the batch reaches are left out.
    """
    step = max(1, SCORES_IN_MEMORY // max(len(ids), 1))
    for start in range(0, len(queries), step):
        scores = score_matrix(queries[start : start + step], pool, metric)
        for q, row in enumerate(scores, start):
            if floor is None:
                yield q, *best_of(row, ids, k)
            elif row.max(initial=-np.inf) >= floor[q]:
                near = row >= floor[q]
                yield q, *best_of(row[near], ids[near], k)


def _bounded_rows(queries: DataFrame, id_col: str, vec_col: str) -> tuple[list, np.ndarray] | None:
    """Query ids and vectors on the driver if the set is within both bounds, else None."""
    rows = queries.select(id_col, vec_col).limit(MAX_BROADCAST_QUERIES + 1).collect()
    if len(rows) > MAX_BROADCAST_QUERIES or sum(len(r[1]) for r in rows) * 8 > MAX_BROADCAST_BYTES:
        return None
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def _types(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def _result_schema(queries: DataFrame, query_id: str, pool: DataFrame, item_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", _types(queries, query_id)),
            T.StructField("item_id", _types(pool, item_id)),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _arrow_types(schema: T.StructType) -> pa.Schema:
    names = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, names[f.dataType.simpleString()]) for f in schema.fields])


def score_pool(
    queries: DataFrame, pool: DataFrame, metric: str = "cosine", query_id: str = "query_id", query_vec: str = "query_vec",
    item_id: str = "item_id", item_vec: str = "item_vec",
) -> DataFrame:
    """Every (query, item) score, for any number of queries; undefined scores are negative infinity."""
    queries = queries.select(query_id, query_vec).filter(F.col(query_vec).isNotNull())
    pool = pool.select(item_id, item_vec).filter(F.col(item_vec).isNotNull())
    bounded = _bounded_rows(queries, query_id, query_vec)
    schema = _result_schema(queries, query_id, pool, item_id)
    if bounded is None:
        asked, items = _all_units(queries.toDF("query_id", "query_vec"), pool.toDF("item_id", "item_vec"), pool.count())
        return _search_units(asked, items, None, metric, schema)
    ids, matrix = bounded
    arrow = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pool_matrix = vector_matrix(batch.column(1))
            for qid, query in zip(ids, matrix, strict=True):
                row = score_matrix(query[None, :], pool_matrix, metric)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * batch.num_rows, arrow.field(0).type), batch.column(0), pa.array(row)], schema=arrow
                )

    return pool.mapInArrow(run, schema)


ROUTES = ("scan", "cells", "bounds")


def top_k(
    queries: DataFrame, pool: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id",
    query_vec: str = "query_vec", item_id: str = "item_id", item_vec: str = "item_vec", route: str | None = None,
) -> DataFrame:
    """Best ``k`` pool items per query: query_id, item_id, score, rank (from 1). Exact for any number of queries.

    Null vectors take no part. A vector with NaN has no defined score: it counts as negative infinity, ties by id. A result of proven small size is marked for broadcast, so that a join with payload or labels scans the large
    side where it lies.

    Routes: a scan of the pool for a query set within the bounds of a broadcast; for larger sets cells around pivots where vectors are
    narrow enough for the triangle inequality to leave cells out, else bounds from one-byte components. ``route`` forces one of the last two.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if route is not None and route not in ROUTES[1:]:
        raise ValueError(f"route must be one of {ROUTES[1:]}")
    queries = queries.select(query_id, query_vec).filter(F.col(query_vec).isNotNull())
    pool = pool.select(item_id, item_vec).filter(F.col(item_vec).isNotNull())
    bounded = _bounded_rows(queries, query_id, query_vec) if route is None else None
    schema = _result_schema(queries, query_id, pool, item_id)
    if bounded is not None:
        best = best_rows(pool.mapInArrow(_scanner(*bounded, k, metric, _arrow_types(schema)), schema), k)
        return F.broadcast(best) if len(bounded[0]) * k <= MAX_BROADCAST_RESULTS else best
    queries, pool = queries.toDF("query_id", "query_vec"), pool.toDF("item_id", "item_vec")
    if route is None:
        width = pool.select(F.size("item_vec")).first()
        route = "cells" if width is None or metric != "ip" and width[0] <= CELLS_UP_TO else "bounds"
    search = _partitioned_top_k if route == "cells" else _bounded_top_k
    return best_rows(search(queries, pool, k, metric, schema), k)


def best_rows(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial results into the final ranking; the rank filter is also applied before the shuffle."""
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return partial.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _scanner(ids: list, matrix: np.ndarray, k: int, metric: str, arrow: pa.Schema):
    """Task body of a scan: keeps the best ``k`` per query over all batches of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
        floor = np.full(len(ids), -np.inf)  # k-th best score so far; lower scores need no look
        for batch in batches:
            if batch.num_rows == 0 or not ids:
                continue
            item_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for q, top_ids, top_scores in best_rows_of(matrix, vector_matrix(batch.column(1)), item_ids, k, metric, floor):
                if best[q] is not None:
                    top_ids, top_scores = best_of(
                        np.concatenate([best[q][1], top_scores]), np.concatenate([best[q][0], top_ids]), k
                    )
                best[q] = (top_ids, top_scores)
                if len(top_scores) == k:
                    floor[q] = top_scores[-1]
        for qid, found in zip(ids, best, strict=True):
            if found is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(found[0]), arrow.field(0).type), pa.array(found[0], arrow.field(1).type), pa.array(found[1])],
                    schema=arrow,
                )

    return run


# Widest vectors for which the triangle inequality leaves enough cells out.
CELLS_UP_TO = 32
# Partitioned route: pool rows per work unit, queries per work unit, number of pivots.
UNIT_ITEMS = 20_000
UNIT_QUERIES = 4_000
MAX_PIVOTS = 256


def _partitioned_top_k(queries: DataFrame, pool: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """Exact k-nearest-neighbour join for a query set too large to broadcast.

    Every pool vector belongs to the cell of its nearest pivot. A query first searches one unit of its own cell;
    its k-th best distance there bounds the answer. By the triangle inequality it then visits only cells whose
    ball can hold something as near. Cells are split into units of bounded size and so are the queries of a
    unit; both sides meet in an equi-join on the unit, and a unit returns at most k rows per query.

    Inner product is no metric, so there every query meets every unit. A vector with NaN is near nothing: a cell that
    holds one is always visited, and such a query visits all cells.
    """
    spark = pool.sparkSession
    unit_length = metric == "cosine"
    n_pool = pool.count()
    if n_pool == 0:
        return spark.createDataFrame([], schema)
    if metric == "ip":
        return _search_units(*_all_units(queries, pool, n_pool), k, metric, schema)
    n_pivots = int(min(MAX_PIVOTS, max(1, math.isqrt(n_pool))))
    seeds = pool.orderBy(F.md5(F.col("item_id").cast("string").cast("binary"))).limit(n_pivots).select("item_vec").collect()
    drawn = np.array([r[0] for r in seeds], dtype=np.float64)
    pivots = np.unique(drawn[np.isfinite(drawn).all(axis=1)], axis=0)
    if not len(pivots):
        pivots = np.zeros((1, drawn.shape[1]))
    if unit_length:
        pivots = unit_rows(pivots)

    def assigner(id_type: pa.DataType):
        out = pa.schema([("id", id_type), ("vec", pa.list_(pa.float64())), ("cell", pa.int32()), ("away", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                matrix = vector_matrix(batch.column(1))
                matrix = unit_rows(matrix) if unit_length else matrix
                distance = _distances(matrix, pivots)
                cell = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(matrix), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)),
                     pa.array(distance[np.arange(len(cell)), cell])],
                    schema=out,
                )

        return run

    def placed(df: DataFrame) -> DataFrame:
        id_type = df.schema[0].dataType
        arrow = _arrow_types(T.StructType([T.StructField("id", id_type)])).field(0).type
        return df.mapInArrow(assigner(arrow), f"id {id_type.simpleString()}, vec array<double>, cell int, away double")

    # The distance of a cell's farthest member, and how many units the cell is split into; one row per pivot.
    items = pin(placed(pool))
    cells = items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    n_units = {r["cell"]: max(1, math.ceil(r["n"] / UNIT_ITEMS)) for r in cells}
    filled = np.array(sorted(n_units))
    reach = float(np.linalg.norm(pivots, axis=1).max())
    radius = np.array([{r["cell"]: r["radius"] for r in cells}[c] for c in filled])
    unit_map = F.create_map(*[F.lit(x) for pair in n_units.items() for x in pair])
    items = items.withColumn("unit", F.pmod(F.xxhash64("id"), unit_map[F.col("cell")]).cast("int")).select("id", "vec", "cell", "unit")

    def visited(bounds: bool):
        """Cells a query visits: its nearest filled cell, or every cell whose ball reaches within its bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 128):
                    batch = whole.slice(start, 128)
                    distance = _distances(vector_matrix(batch.column(1)), pivots)[:, filled]
                    if bounds:
                        limit = batch.column(2).to_numpy(zero_copy_only=False)
                        lengths = np.array([np.linalg.norm(v) for v in vector_matrix(batch.column(1))])
                        slack = 1e-6 * (1.0 + reach + lengths)  # floating-point error of the distances
                        # Not "at most": an undefined distance or radius leaves no cell out.
                        query, cell = np.nonzero(~(distance - radius[None, :] > (limit + slack)[:, None]))
                    else:
                        query, cell = np.arange(batch.num_rows), distance.argmin(axis=1)
                    index = pa.array(query, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(index), batch.column(1).take(index), pa.array(filled[cell], pa.int32())],
                        names=["id", "vec", "cell"],
                    )

        return run

    qtype = queries.schema[0].dataType.simpleString()
    visit_schema = f"id {qtype}, vec array<double>, cell int"
    asked = pin(placed(queries).select("id", "vec"))
    home = asked.mapInArrow(visited(False), visit_schema).withColumn("unit", F.lit(0))
    first = _search_units(home, items, k, metric, schema)
    # Scores are rounded, so the bound allows for the rounding step.
    squared = 2.0 - 2.0 * F.col("score") if unit_length else -F.col("score")
    distance = F.sqrt(F.greatest(squared, F.lit(0.0)) + F.lit(10.0**-SCORE_DECIMALS * 4))
    bound = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max(distance)).otherwise(F.lit(float("inf"))).alias("limit")
    )
    bounded = asked.join(bound, asked["id"] == bound["query_id"], "left").select(
        "id", "vec", F.coalesce("limit", F.lit(float("inf"))).alias("limit")
    )
    reached = bounded.mapInArrow(visited(True), visit_schema)
    all_units = reached.withColumn("unit", F.explode(F.sequence(F.lit(0), unit_map[F.col("cell")] - 1)))
    return _search_units(all_units, items, k, metric, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * a @ b.T, 0.0))


def _all_units(queries: DataFrame, pool: DataFrame, n_pool: int) -> tuple[DataFrame, DataFrame]:
    """Visits and items in which every query meets every unit of the pool."""
    units = max(1, math.ceil(n_pool / UNIT_ITEMS))
    asked = queries.toDF("id", "vec").select("id", "vec", F.lit(0).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    return asked, pool.toDF("id", "vec").select("id", "vec", F.lit(0).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(units)).cast("int").alias("unit"))


def _search_units(visits: DataFrame, items: DataFrame, k: int | None, metric: str, schema: T.StructType) -> DataFrame:
    """Best ``k`` (None: all) per query and unit. Queries of a busy unit are split, and the unit's items are repeated per split."""
    most = UNIT_QUERIES if k is not None else max(1, SCORES_IN_MEMORY // UNIT_ITEMS)
    load = visits.groupBy("cell", "unit").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("splits"))
    unit = ["cell", "unit"]
    asked = visits.join(load, unit).withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int"))
    offered = items.join(load, unit).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    arrow = _arrow_types(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow.empty_table()
        ids = right.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        asked, offered = vector_matrix(left.column("vec")), vector_matrix(right.column("vec"))
        found = list(best_rows_of(asked, offered, ids, k, metric)) if k is not None else [(q, ids, row) for q, row in enumerate(score_matrix(asked, offered, metric))]
        query_ids = np.repeat(left.column("id").combine_chunks().to_numpy(zero_copy_only=False), [len(f[1]) for f in found])
        return pa.table(
            [pa.array(query_ids, arrow.field(0).type), pa.array(np.concatenate([f[1] for f in found]), arrow.field(1).type),
             pa.array(np.concatenate([f[2] for f in found]))],
            schema=arrow,
        )

    key = [*unit, "split"]
    pairs = asked.select(*key, "id", "vec").groupBy(*key).cogroup(offered.select(*key, "id", "vec").groupBy(*key))
    return pairs.applyInArrow(run, schema)


# Bounds route: bytes of the codes, or of the query vectors, of a work unit.
UNIT_BYTES = 16 << 20
# Pairs of a query and an item that a work unit looks at.
UNIT_PAIRS = 1 << 27
_LEVELS = 127


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def encode_bytes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scale of each row, length of what the codes miss, and length of the row. Rows that aren't finite miss infinitely much."""
    finite = np.isfinite(matrix).all(axis=1)
    safe = np.where(finite[:, None], matrix, 0.0)
    scale = np.abs(safe).max(axis=1, initial=0.0) / _LEVELS
    codes = np.round(np.divide(safe, scale[:, None], out=np.zeros_like(safe), where=scale[:, None] > 0)).astype(np.int8)
    miss = np.where(finite, _norms(safe - codes * scale[:, None]), np.inf)
    return codes, scale, miss, np.where(finite, _norms(safe), np.inf)


def score_bounds(
    queries: np.ndarray, lengths: np.ndarray, codes: np.ndarray, scale: np.ndarray, miss: np.ndarray, item_lengths: np.ndarray, metric: str,
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rounded scores of all queries with all coded items; queries are float32 rows of the given lengths.

    The inner product of a query with what a code misses is at most the product of their lengths; the rest allows for single precision.
    """
    near = (queries @ codes.T.astype(np.float32)).astype(np.float64) * scale
    reach = item_lengths + miss
    off = lengths[:, None] * (miss + reach * (1.2e-7 * (queries.shape[1] + 4)))
    if metric == "l2":
        squares = lengths[:, None] ** 2 + item_lengths[None, :] ** 2
        near, off = np.minimum(2.0 * near - squares, 0.0), 2.0 * off + 1e-12 * squares
    off = off + 4 * 10.0**-SCORE_DECIMALS
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(off), near - off, -np.inf), np.where(np.isfinite(off), near + off, np.inf)


def _coded(df: DataFrame, unit_length: bool) -> DataFrame:
    """(id, code, scale, miss, length, same, undefined): vectors as bytes; equal vectors have equal digests."""
    id_type = df.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            raw = vector_matrix(batch.column(1))
            matrix = unit_rows(raw) if unit_length else raw
            codes, scale, miss, length = encode_bytes(matrix)
            same = [hashlib.blake2b((row + 0.0).tobytes(), digest_size=16).digest() for row in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(miss), pa.array(length), pa.array(same, pa.binary()), pa.array(np.isnan(raw).any(axis=1))],
                names=["id", "code", "scale", "miss", "length", "same", "undefined"])

    return df.mapInArrow(run, f"id {id_type.simpleString()}, code binary, scale double, miss double, length double, same binary, undefined boolean")


def _narrowed(df: DataFrame, unit_length: bool) -> DataFrame:
    """(id, vec, length): query vectors in single precision; undefined ones have an infinite length."""
    id_type = df.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = vector_matrix(batch.column(1))
            matrix = unit_rows(matrix) if unit_length else matrix
            finite = (np.abs(matrix) < 1e30).all(axis=1)
            safe = np.where(finite[:, None], matrix, 0.0)
            length = np.where(finite, _norms(safe), np.where(np.isnan(matrix).any(axis=1), np.nan, np.inf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in safe.astype(np.float32)], pa.binary()), pa.array(length)], names=["id", "vec", "length"])

    return df.mapInArrow(run, f"id {id_type.simpleString()}, vec binary, length double")


def work_grid(n_items: int, n_asked: int, width: int, k: int) -> tuple[int, int]:
    """(units of the items, splits of the queries): a pair of both is within ``UNIT_BYTES`` a side and about ``UNIT_PAIRS`` pairs.

    Of the grids with enough cells it is the one that moves least: codes once a split, queries and their results once a unit.
    """
    item_bytes, query_bytes = width + 48, 4 * width + 16
    cells = n_items * n_asked / UNIT_PAIRS
    moved = cells * n_items * item_bytes / max(1, n_asked * (query_bytes + 64 * k))
    units = max(1, math.ceil(n_items * item_bytes / UNIT_BYTES), round(math.sqrt(moved)))
    return units, max(1, math.ceil(n_asked * query_bytes / UNIT_BYTES), math.ceil(cells / units))


def _bounded_top_k(queries: DataFrame, pool: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """Exact search by a vector-approximation file: bytes are scanned, and only what their bounds leave open is scored.

    Pool vectors become one byte a component, with the length of what that misses. Units of codes meet splits of the queries, of
    bounded bytes and with a bounded number of pairs; in each, an item stays if its upper bound reaches the k-th best lower bound, and of equal vectors the k smallest ids stay. The
    k-th best lower bound over all units cuts again, and what is left is scored by whole vectors. Vectors move once for that, codes once for
    each split of the queries, single-precision queries once for each unit.
    """
    first = pool.select("item_vec").first()
    if first is None:
        return pool.sparkSession.createDataFrame([], schema)
    unit_length, width = metric == "cosine", max(1, len(first[0]))
    items, asked = pin(_coded(pool, unit_length), "codes"), pin(_narrowed(queries, unit_length), "asked")
    units, splits = work_grid(items.count(), asked.count(), width, k)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    offered = items.withColumns({"unit": F.pmod(F.xxhash64("id"), F.lit(units)).cast("int"), "split": each(splits)})
    wanted = asked.withColumn("split", F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")).withColumn("unit", each(units))
    ids = _arrow_types(schema)
    out = pa.schema([ids.field(0), ids.field(1), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out.empty_table()
        column = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        item_ids, same = column(right, "id"), column(right, "same")
        # Of equal vectors only the k smallest ids can be among the best k.
        order = np.lexsort((item_ids, same))
        starts = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        keep = np.sort(order[nth < k])
        item_ids, undefined = item_ids[keep], column(right, "undefined")[keep]
        scale, miss, length = (column(right, c)[keep] for c in ("scale", "miss", "length"))
        codes = np.frombuffer(b"".join(column(right, "code")), np.int8).reshape(right.num_rows, -1)[keep]
        asking, query_ids, lengths = np.frombuffer(b"".join(column(left, "vec")), np.float32).reshape(left.num_rows, -1), column(left, "id"), column(left, "length")
        smallest = np.argsort(item_ids)[:k]
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, SCORES_IN_MEMORY // (4 * max(1, len(item_ids))))
        for start in range(0, len(asking), step):
            lower, upper = score_bounds(asking[start : start + step], np.nan_to_num(lengths[start : start + step], nan=np.inf), codes, scale, miss, length, metric)
            lower[:, undefined] = upper[:, undefined] = -np.inf
            for q, (low, high) in enumerate(zip(lower, upper), start):
                if np.isnan(lengths[q]):  # all scores are undefined, and ids decide
                    found.append((q, smallest, np.full(len(smallest), -np.inf), np.full(len(smallest), -np.inf)))
                    continue
                kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                stays = np.flatnonzero((high >= kth) & (high > -np.inf))
                if kth == -np.inf and undefined.any():
                    stays = np.r_[stays, np.flatnonzero(undefined)[np.argsort(item_ids[undefined])[:k]]]
                found.append((q, stays, low[stays], high[stays]))
        return pa.table(
            [pa.array(np.repeat(query_ids, [len(f[1]) for f in found]), ids.field(0).type), pa.array(item_ids[np.concatenate([f[1] for f in found])], ids.field(1).type),
             pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[3] for f in found]))], schema=out)

    key = ["unit", "split"]
    types = [schema[0].dataType.simpleString(), schema[1].dataType.simpleString()]
    # Their bytes are few and their work is much: a given number of partitions keeps adaptive execution from putting them together.
    wanted, offered = (side.repartition(units * splits, *key) for side in (wanted, offered))
    near = wanted.groupBy(*key).cogroup(offered.groupBy(*key)).applyInArrow(run, f"query_id {types[0]}, item_id {types[1]}, lower double, upper double")
    near = pin(near, "near")
    by_lower = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    kth = near.select("query_id", "lower", F.row_number().over(by_lower).alias("n")).filter(F.col("n") == k).select("query_id", F.col("lower").alias("kth"))
    left = pin(near.join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("query_id", "item_id"), "open")
    pairs = left.join(pool, "item_id").join(queries, "query_id").select("query_id", "item_id", "query_vec", "item_vec")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = vector_matrix(batch.column(2)), vector_matrix(batch.column(3))
            if metric == "cosine":
                a, b = unit_rows(a), unit_rows(b)
            raw = np.einsum("ij,ij->i", a, b)
            if metric == "l2":
                raw = -np.maximum(np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b) - 2.0 * raw, 0.0)
            exact = np.round(np.where(np.isnan(raw), -np.inf, raw), SCORE_DECIMALS) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact)], schema=ids)

    return pairs.mapInArrow(score, schema)
