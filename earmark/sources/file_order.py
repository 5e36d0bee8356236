"""The order in which rows stand in files.

A scan knows each row's file, the start of its block (the part of the file that one task reads) and how many rows it has read
before. That triple sorts as the rows stand in the files, whatever the size of the blocks, and costs nothing: rules that keep the
first or the last row of a key need no more. Numbers need one pass to count the rows of each block and prefix sums over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.session import pin

ORDER = "_ord"


def file_order() -> Column:
    """(file, block, row): sorts in file order. Only for rows straight from a scan of files."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def with_file_order(rows: DataFrame, order: str = ORDER) -> DataFrame:
    return rows.withColumn(order, file_order())


def number_lines(rows: DataFrame, order: str = ORDER, number: str = "line") -> DataFrame:
    """Add the number of each row over all files, from 0, files in the order of their paths.

    ``rows`` are all rows of the scan, none left out: what a task reads of a block has consecutive numbers then. They are written once,
    so that blocks stay as they are; the table of blocks has one row for each part that a task reads, far fewer than rows.
    """
    placed = pin(rows, "numbered")
    blocks = placed.groupBy(F.col(f"{order}.file").alias("_file"), F.col(f"{order}.block").alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(f"{order}.row").alias("_first"))
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("_file").alias("_f"), before.alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_inside", inside).join(files, F.col("_file") == F.col("_f"))
    starts = pin(starts.select("_file", "_block", (F.col("_before") + F.col("_inside") - F.col("_first")).alias("_shift")), "blocks")
    same = (placed[order]["file"] == starts["_file"]) & (placed[order]["block"] == starts["_block"])
    return placed.join(starts, same).withColumn(number, F.col(f"{order}.row") + F.col("_shift")).drop("_file", "_block", "_shift")
