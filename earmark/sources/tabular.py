"""CSV and TSV readers and writers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.constants import LABEL_COLUMNS
from earmark.functions.keys import basename, blank_to_null, strip
from earmark.functions.values import parse_relevance

BOM = "\ufeff"
# <dataset>_public/<arm>_seed<n>.csv, as one file or as a folder of part files of that name
MATRIX_PATH = r"/([^/]+)_public/([^/]+)_seed(\d+)\.csv"


def _files_by_header(spark: SparkSession, path: str | Sequence[str], **options) -> list[list[str]]:
    """Files below ``path`` in groups that have the same first line; empty files are left out. One row a file reaches the driver.

    First lines are told apart by 128 bits of digests: the minimum of numbers is aggregated by hash, while that of texts would sort all
    lines of a task. The text is read once for each group, from one of its files.
    """
    lines = spark.read.options(**options).text(path).filter(F.col("_metadata.file_block_start") == 0)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    digests = F.xxhash64("value"), F.xxhash64(F.lit(1), "value")
    first = lines.groupBy("file").agg(*[F.min_by(d, "place").alias(f"d{k}") for k, d in enumerate(digests)])
    alike: dict[tuple[int, int], list[str]] = {}
    for file, *digest in first.collect():
        alike.setdefault(tuple(digest), []).append(re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file)))
    groups: dict[str, list[str]] = {}
    for files in alike.values():
        header = spark.read.text(min(files)).filter(F.col("_metadata.file_block_start") == 0).first()["value"]
        groups.setdefault(header.lstrip(BOM).rstrip("\r"), []).extend(files)
    return [sorted(groups[h]) for h in sorted(groups)]


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", required: Sequence[str] = (), splittable: bool = False
) -> DataFrame:
    """CSV with a header, all columns text. Byte-order marks are cut from the names; required columns are checked.

    Columns are matched by name, whatever the header of each file; a column that a file lacks is null there. Cells may hold line
    breaks, so a file is read in one piece. With ``splittable`` no cell holds a line break, and large files are read by many tasks. Either way
    files are read in groups that have one header, so columns in another order are still matched by name.
    """

    def read(files: str | Sequence[str]) -> DataFrame:
        raw = spark.read.option("header", True).option("sep", sep).option("multiLine", not splittable).option("escape", '"')
        df = raw.csv(files)
        return df.toDF(*[c.lstrip(BOM) for c in df.columns])

    groups = _files_by_header(spark, path)
    parts = [read(files) for files in groups] or [read(path)]
    for part in parts:
        present = {c.lower() for c in part.columns}
        missing = [c for c in required if c.lower() not in present]
        if missing:
            raise ValueError(f"missing columns {missing}; the file has {part.columns}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_wide_tsv(spark: SparkSession, path: str | Sequence[str], required: Sequence[str]) -> DataFrame:
    return read_csv(spark, path, sep="\t", required=required, splittable=True)


def parse_ragged_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated lines of five fixed fields and any number of tags; shorter lines are dropped."""
    parts = F.split(column, "\t")
    rows = lines.select(parts.alias("p")).filter(F.size("p") >= 6)
    tags = F.transform(F.slice("p", 6, F.size("p")), strip)
    return rows.select(
        strip(F.col("p")[0]).alias("track_id"),
        F.translate(strip(F.col("p")[3]), "\\", "/").alias("path"),
        F.coalesce(F.col("p")[4].try_cast("double"), F.lit(0.0)).alias("duration"),
        F.filter(tags, lambda t: t != "").alias("tags"),
    )


def read_ragged_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """As :func:`parse_ragged_lines`, without the header line of each file."""
    lines = spark.read.text(path)
    return parse_ragged_lines(lines.filter(~F.upper("value").startswith("TRACK_ID\t")))


def long_labels(rows: DataFrame, threshold: float, key: str = "sample_key") -> DataFrame:
    """(key, instrument) of every annotation whose relevance reaches the threshold; unreadable relevance is 0."""
    relevance = F.coalesce(strip("relevance").try_cast("double"), F.lit(0.0))
    return (
        rows.select(strip(key).alias("sample_key"), F.lower(strip("instrument")).alias("instrument"), relevance.alias("relevance"))
        .filter((F.col("sample_key") != "") & (F.col("relevance") >= threshold))
    )


def read_long_labels(spark: SparkSession, path: str | Sequence[str], threshold: float = 0.5) -> DataFrame:
    return long_labels(read_csv(spark, path, required=("sample_key", "instrument", "relevance"), splittable=True), threshold)


def judged_rows(rows: DataFrame) -> DataFrame:
    """Rows of a judgement sheet that have an id, a type and a whole-number rank; relevance null where unjudged."""
    rank = strip("rank").try_cast("int")
    return rows.filter(blank_to_null("query_id").isNotNull() & blank_to_null("query_type").isNotNull() & rank.isNotNull()).select(
        strip("query_id").alias("query_id"), strip("query_type").alias("query_type"), rank.alias("rank"),
        parse_relevance("relevance").alias("relevance"),
    )


def read_judgements(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return judged_rows(read_csv(spark, path, required=("query_id", "query_type", "rank", "relevance")))


def read_matrices(spark: SparkSession, path: str, schema: str, pattern: str = MATRIX_PATH) -> DataFrame:
    """All metric matrices below ``path``, with data set, arm and seed taken from each file's path.

    Columns are matched by the header of each file: files may hold them in any order, lack some (null) or have others (left out).
    There is one scan for each distinct header. A cell that can't be read as its type is null.
    """
    typed = T.StructType.fromDDL(schema)
    below = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}

    def read(files: list[str]) -> DataFrame:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        at = {c.lstrip(BOM).strip().lower(): i for i, c in enumerate(raw.columns)}
        plain = raw.select(F.col("_metadata.file_path").alias("_file"), "*").toDF("_file", *[f"_{i}" for i in range(len(raw.columns))])
        cells = {f.name: F.col(f"_{at[f.name.lower()]}") if f.name.lower() in at else F.lit(None) for f in typed.fields}
        return plain.select("_file", *[cells[f.name].try_cast(f.dataType).alias(f.name) for f in typed.fields])

    parts = [read(files) for files in _files_by_header(spark, path, **below)]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"_file STRING, {schema}")
    return rows.select(
        F.regexp_extract("_file", pattern, 1).alias("dataset"),
        F.regexp_extract("_file", pattern, 2).alias("arm"),
        F.regexp_extract("_file", pattern, 3).cast("int").alias("seed"),
        *[F.col(f.name) for f in typed.fields],
    )


def grid_gaps(present: DataFrame, datasets: Sequence[str], arms: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Cells (dataset, arm, seed) of the expected grid for which there is no row. The grid is part of the plan."""
    spark = present.sparkSession
    cells = [(d, a, s) for d in datasets for a in arms for s in seeds]
    expected = spark.createDataFrame(cells, "dataset STRING, arm STRING, seed INT")
    return expected.join(present.select("dataset", "arm", "seed").distinct(), ["dataset", "arm", "seed"], "left_anti")


def require_grid(present: DataFrame, datasets: Sequence[str], arms: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    gaps = grid_gaps(present, datasets, arms, seeds).orderBy("dataset", "arm", "seed").take(5)
    if gaps:
        raise FileNotFoundError(f"missing metric matrices, for example {[tuple(g) for g in gaps]}")
    return present


def fixed_columns(df: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """Text cells in a fixed column order: floats with fixed decimals, nulls as blanks."""
    types = dict(df.dtypes)
    cells = []
    for name in columns:
        cell = F.col(name)
        text = F.format_string(f"%.{decimals}f", cell) if types[name] in ("double", "float") else cell.cast("string")
        cells.append(F.coalesce(F.when(cell.isNotNull(), text), F.lit("")).alias(name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], bom: bool = False, decimals: int = 6) -> None:
    """Fixed-column CSV. With ``bom`` the header of each file starts with a byte-order mark for spreadsheets."""
    cells = fixed_columns(df, columns, decimals)
    if bom:
        cells = cells.withColumnRenamed(columns[0], BOM + columns[0])
    cells.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def labelling_sheet(songs: DataFrame, source: str = "source_path", labels: Sequence[str] = LABEL_COLUMNS, default: str = "0") -> DataFrame:
    """One row per song for people to label: name, key and label cells holding the default."""
    rows = songs.filter(blank_to_null(source).isNotNull()).select(strip(source).alias("source_path"))
    return rows.select(basename("source_path").alias("song_name"), "source_path", *[F.lit(default).alias(c) for c in labels])


def judging_sheet(candidates: DataFrame) -> DataFrame:
    """Ranked candidates with blank cells for a judge."""
    return candidates.select("*", *[F.lit("").alias(c) for c in ("relevance", "judge_confidence", "notes")])
