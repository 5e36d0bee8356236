"""JSON lines, JSON arrays and JSON objects, read tolerantly with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.constants import DEFAULT_QUERIES
from earmark.functions.keys import blank_to_null, resolve_path, strip
from earmark.operators.ordering import keep_one, smallest
from earmark.schemas import QUERY_SET
from earmark.sources.file_order import number_lines, with_file_order
from earmark.sources.json_scan import CHUNK, scan_elements

CORRUPT = "_corrupt_record"


def _options() -> dict[str, str]:
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}


def _well_formed(text: Column) -> Column:
    """Whether a text is one JSON value and no more. The parser stops at the end of a value, so the text is put between brackets."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _options())
    named = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", _options())
    return F.coalesce((F.size(listed) == 1) & (F.size(named) == 1), F.lit(False))


def parse_lines(lines: DataFrame, schema: str, strict: bool = False, column: str = "value") -> DataFrame:
    """Rows of JSON lines. Blank lines and lines that hold no object are dropped.

    A field of the wrong type is null and the rest of its row stays. Malformed lines are dropped, or with
    ``strict`` fail the job. All other columns of ``lines`` are kept.
    """
    text = strip(column)
    malformed = ~_well_formed(text)
    rows = lines.filter(text != "").filter(F.startswith(text, F.lit("{")) | (F.lit(strict) & malformed))
    rows = rows.withColumn("_row", F.from_json(text, f"{schema}, {CORRUPT} STRING", _options()))
    if strict:
        message = F.concat(F.lit("malformed JSON line: "), F.substring(text, 1, 200))
        rows = rows.filter(F.when(malformed, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    else:
        rows = rows.filter(~malformed)
    kept = [c for c in lines.columns if c != column]
    return rows.select(*kept, "_row.*").drop(CORRUPT)


def read_jsonl(
    spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = False, order: str | None = None, line: str | None = None,
) -> DataFrame:
    """Rows of JSON lines files. ``order`` names a column that sorts in file order, ``line`` one with the number of the line over all files."""
    lines = spark.read.text(path)
    if order or line:
        lines = with_file_order(lines, order or "_ord")
    if line:
        lines = number_lines(lines, order or "_ord", line)
    return parse_lines(lines if order or not line else lines.drop("_ord"), schema, strict)


def usable_manifest(
    rows: DataFrame, root: str | None = None, key: str = "audio_path", inventory: DataFrame | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Manifest rows with a key: the key resolved, blank text replaced by 'None'.

    ``inventory`` (path) keeps rows whose file exists. ``max_rows`` is an explicit row limit for trial runs, taken in
    key order so that it always gives the same rows.
    """
    rows = rows.filter(blank_to_null(key).isNotNull())
    if root is not None:
        rows = rows.withColumn(key, resolve_path(key, root))
    rows = rows.withColumn("text", F.coalesce(blank_to_null("text"), F.lit("None")))
    if inventory is not None:
        rows = rows.join(inventory.select(F.col("path").alias(key)).distinct(), key, "left_semi")
    return smallest(rows, [key], max_rows) if max_rows is not None else rows


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; raises if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no usable rows in {what}")
    return df


def parse_array(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Objects of JSON arrays held in a text column; elements that are no objects are dropped."""
    elements = F.from_json(strip(column), "array<string>")
    kept = [c for c in lines.columns if c != column]
    exploded = lines.filter(F.startswith(strip(column), F.lit("["))).select(*kept, F.explode(elements).alias("value"))
    return parse_lines(exploded, schema)


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: str, order: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Objects of files that hold one JSON array each; large files are read by many tasks.

    ``order`` names a column for the file order (file, place of the element).
    """
    elements = scan_elements(spark, path, chunk).filter(F.col("root") == "[")
    rows = parse_lines(elements.select(F.col("text").alias("value"), F.struct("file", "place").alias("_place")), schema)
    return rows.withColumnRenamed("_place", order) if order else rows.drop("_place")


def parse_object_map(lines: DataFrame, value_type: str, key: str = "key", value: str = "payload", column: str = "value") -> DataFrame:
    """``{id: payload}`` objects as one row per id."""
    kept = [c for c in lines.columns if c != column]
    return lines.select(*kept, F.explode(F.from_json(column, f"map<string,{value_type}>")).alias(key, value))


def read_json_map(spark: SparkSession, path: str | Sequence[str], value_type: str, chunk: int = CHUNK) -> DataFrame:
    """(key, payload) of files that hold one JSON object each; large files are read by many tasks. Of a repeated key the last entry counts."""
    entries = scan_elements(spark, path, chunk).filter(F.col("root") == "{")
    rows = parse_object_map(entries.select("file", "place", F.concat(F.lit("{"), "text", F.lit("}")).alias("value")), value_type)
    return keep_one(rows, ["file", "key"], ["place"], "last").select("key", "payload")


def valid_queries(rows: DataFrame) -> DataFrame:
    """Query-set rows whose four fields are all present and not blank, trimmed."""
    fields = ("query_id", "query_type", "label", "query_text")
    trimmed = rows.select(*[blank_to_null(f).alias(f) for f in fields])
    return trimmed.dropna(how="any")


def read_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Query set of a file, or the default set."""
    if path is None:
        return spark.createDataFrame(list(DEFAULT_QUERIES), QUERY_SET)
    return valid_queries(read_json_array(spark, path, QUERY_SET))


def split_ledger(
    rows: DataFrame, key: str, truth: str, predicted: str, labels: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(distinct processed keys, rows whose status is ok and whose truth and prediction are known labels)."""
    keys = rows.select(key).filter(blank_to_null(key).isNotNull()).distinct()
    ok = (F.col("status") == "ok") & F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)
    return keys, rows.filter(ok)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, null fields written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def write_keyed(df: DataFrame, path: str, key: str, fmt: str = "json") -> None:
    """Rows in key order over all files, so that a re-run writes the same order."""
    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = ordered.write.option("ignoreNullFields", "false") if fmt == "json" else ordered.write
    writer.format(fmt).save(path)


def as_json_line(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
