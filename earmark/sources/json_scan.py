"""Elements of one large JSON array or object, read by many tasks.

A file is read in pieces that end at commas, so Spark splits it like any text file. Each task joins its pieces into chunks of
bounded size and says, for both cases (a chunk starts inside a string or outside), how many quotes a chunk has, by how much it
changes the bracket depth, and how many commas it has at each depth. Prefix sums over the chunks of a file then tell for each
chunk whether it starts inside a string, how deep, and how many elements begin before it. With that every chunk is cut by itself;
only elements that a chunk's border cuts are put together, from the ends of chunks.

Chunks are written once, because the same pieces must be seen by both passes. One value as long as the file would still be one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earmark.session import pin

#: Characters of a chunk, the last piece apart.
CHUNK = 1 << 20
_ESCAPE = re.compile(r"\\.", re.DOTALL)
_MARK = re.compile(r"[\[\]{},]")
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)', re.DOTALL)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|[\[\]{},]', re.DOTALL)
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_CHUNKS = "file string, start long, seq int, text string, quotes long, rise array<long>, commas array<map<int,long>>"


def summary(text: str) -> tuple[int, list[int], list[list[tuple[int, int]]]]:
    """Quotes; and for a start outside and inside a string: change of depth, and (depth from the start, commas there)."""
    parts = _ESCAPE.sub("", text).split('"')
    rise, commas = [], []
    for first in (0, 1):
        marks = np.frombuffer("".join(_MARK.findall(" ".join(parts[first::2]))).encode(), np.uint8)
        depth = np.cumsum(_STEP[marks])
        at, n = np.unique(depth[marks == ord(",")], return_counts=True)
        rise.append(int(depth[-1]) if len(depth) else 0)
        commas.append(list(zip(at.tolist(), n.tolist())))
    return len(parts) - 1, rise, commas


def segments(text: str, inside: bool, depth: int) -> tuple[list[str], bool]:
    """Texts between the commas at depth 1, outermost brackets left out, and whether the outermost bracket closes."""
    out, closed = [], False
    at = _STRING_END.match(text).end() if inside else 0
    begin = 0
    for token in _TOKEN.finditer(text, at):
        c = token.group()
        if c in "[{":
            depth += 1
            if depth == 1:
                begin = token.end()
        elif c in "]}":
            depth -= 1
            if depth == 0:
                out.append(text[begin : token.start()])
                closed = True
                break
        elif c == "," and depth == 1:
            out.append(text[begin : token.start()])
            begin = token.end()
    if not closed and (depth > 0 or inside):
        out.append(text[begin:])
    return out, closed


def _chunks(size: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seq, waiting, length = None, 0, [], 0

        def row() -> pa.RecordBatch:
            text = ",".join(waiting)
            quotes, rise, commas = summary(text)
            return pa.RecordBatch.from_arrays(
                [pa.array([block[0]], pa.string()), pa.array([block[1]], pa.int64()), pa.array([seq], pa.int32()), pa.array([text], pa.string()), pa.array([quotes], pa.int64()),
                 pa.array([rise], pa.list_(pa.int64())), pa.array([commas], pa.list_(pa.map_(pa.int32(), pa.int64())))], names=["file", "start", "seq", "text", "quotes", "rise", "commas"])

        for batch in batches:
            for file, start, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block is not None and ((file, start) != block or length >= size):
                    yield row()
                    seq, waiting, length = (seq + 1 if (file, start) == block else 0), [], 0
                block = file, start
                waiting.append(piece)
                length += len(piece) + 1
        if waiting:
            yield row()

    return join


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, root, place, part, whole, text) of each segment; the first and last one of a chunk may go on in others."""
    names = ["file", "root", "place", "part", "whole", "text"]
    for batch in batches:
        for file, text, inside, depth, before, opens, number in zip(*(batch.column(i).to_pylist() for i in range(7))):
            root = None
            if number == 0:
                text = text.removeprefix("\ufeff")
                root = text.lstrip()[:1]
            found, closed = segments(text, inside, depth) if depth or inside or number == 0 else ([], False)
            whole = [True] * len(found)
            if found:
                whole[0] = number == 0 or opens
                whole[-1] = closed and whole[-1]
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(range(before, before + n), pa.int64()), pa.array([number] * n, pa.int64()),
                 pa.array(whole, pa.bool_()), pa.array(found, pa.string())], names=names)


def scan_elements(spark: SparkSession, path: str | Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(file, root, place, text): each element of the outermost array, or ``"key": value`` of the outermost object, of each file.

    ``root`` is the outermost bracket, ``place`` numbers the elements of a file from 0 in file order. Files whose outermost value is
    neither an array nor an object have no rows. Of a file that breaks off, the elements before that place are still read.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    chunks = pin(pieces.mapInArrow(_chunks(chunk), _CHUNKS), "json_chunks")
    order = Window.partitionBy("file").orderBy("start", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = chunks.select("file", "start", "seq", "quotes", "rise", "commas").withColumn("number", F.row_number().over(order) - 1)
    known = known.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    known = known.withColumn("depth", F.coalesce(F.sum(F.get("rise", F.col("inside"))).over(before), F.lit(0)))
    # The comma between two chunks belongs to the second one.
    known = known.withColumn("opens", (F.col("number") > 0) & (F.col("inside") == 0) & (F.col("depth") == 1))
    here = F.coalesce(F.element_at(F.get("commas", F.col("inside")), (1 - F.col("depth")).cast("int")), F.lit(0).cast("long"))
    known = known.withColumn("before", F.coalesce(F.sum(here).over(before), F.lit(0)) + F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = pin(known.select("file", "start", "seq", "number", F.col("inside").cast("boolean").alias("inside"), F.col("depth").cast("int").alias("depth"), "opens", "before"), "json_states")
    ready = chunks.select("file", "start", "seq", "text").join(known, ["file", "start", "seq"]).select("file", "text", "inside", "depth", "before", "opens", "number")
    parts = pin(ready.mapInArrow(_cut, "file string, root string, place long, part long, whole boolean, text string"), "json_segments")
    roots = parts.filter("part = 0").groupBy("file").agg(F.max("root").alias("root")).filter(F.col("root").isin("[", "{"))
    whole = parts.filter("whole").select("file", "place", "text")
    # An element of many chunks: its ends in the order of the chunks. The comma between two chunks is one of its own characters.
    torn = parts.filter("not whole").groupBy("file", "place").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("ends"))
    torn = torn.select("file", "place", F.array_join(F.col("ends.text"), ",").alias("text"))
    rows = whole.unionByName(torn).withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    return rows.filter(F.col("text") != "").join(roots, "file").select("file", "root", "place", "text")
