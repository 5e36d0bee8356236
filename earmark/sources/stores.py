"""File inventory, feature cache and embedding table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions.keys import strip
from earmark.functions.text import compose_caption
from earmark.functions.values import confidence_or_zero
from earmark.functions.vectors import unit


def file_inventory(spark: SparkSession, path: str, relative_to: str | None = None) -> DataFrame:
    """Files below ``path`` (path, length, modified); contents are never read.

    Empty files are not listed: Spark schedules no read for them. Every use of an inventory asks for content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace("path", r"^file:/+", "/")
    if relative_to is not None:
        name = F.regexp_replace(name, "^" + _quoted(relative_to.rstrip("/")) + "/", "")
    return files.select(name.alias("path"), "length", F.col("modificationTime").alias("modified"))


def read_logs(spark: SparkSession, path: str, prefix: str = "slurm-") -> DataFrame:
    """Whole log files, one per row: job_id (file name without prefix and suffix), path, modified, value."""
    name = F.substring_index("path", "/", -1)
    logs = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return logs.withColumn("job_id", F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(prefix), F.lit("")))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def append_features(features: DataFrame, path: str, key: str = "cache_key", vector: str = "features") -> None:
    """Add entries to a feature cache (one Parquet table; keys must be new, see :func:`missing_keys`)."""
    features.select(F.col(key).alias("cache_key"), F.col(vector).cast("array<float>").alias("features")).write.mode("append").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cache_key STRING, features ARRAY<FLOAT>").parquet(path)


def missing_keys(manifest: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Manifest rows whose key the cache lacks."""
    return manifest.join(cache.select(F.col("cache_key").alias(key)), key, "left_anti")


def lookup_features(manifest: DataFrame, cache: DataFrame, key: str = "cache_key", require_all: bool = False) -> DataFrame:
    """Manifest with its cached features; with ``require_all`` a missing key fails the job."""
    found = manifest.join(cache.withColumnRenamed("cache_key", key), key, "left")
    if require_all:
        fail = F.raise_error(F.concat(F.lit("feature missing for "), F.col(key))).cast("array<float>")
        found = found.withColumn("features", F.when(F.col("features").isNull(), fail).otherwise(F.col("features")))
    return found


def cache_coverage(manifest: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """One row: distinct manifest keys and how many of them are cached."""
    keys = manifest.select(key).distinct()
    flagged = keys.join(cache.select(F.col("cache_key").alias(key), F.lit(1).alias("hit")).distinct(), key, "left")
    return flagged.agg(F.count("hit").alias("present"), F.count(F.lit(1)).alias("total"))


def embedding_rows(
    rows: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame], min_confidence: float = 0.0, with_mood: bool = True
) -> DataFrame:
    """Rows of an embedding table: confidence filter, text composition, encoder, unit vectors, payload.

    The filter runs before the encoder, because no filter is pushed through a batch function.
    ``encode(df, text column, vector column)`` adds the vector.
    """
    kept = rows.withColumn("confidence", confidence_or_zero("confidence")).filter(F.col("confidence") >= min_confidence)
    text = compose_caption("text", "mood") if with_mood else compose_caption("text", F.lit(None).cast("string"))
    encoded = encode(kept.withColumn("_embed_text", text), "_embed_text", "embedding")
    return encoded.withColumn("embedding", unit("embedding").cast("array<float>")).drop("_embed_text")


def write_embedding_table(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def caption_rows(clips: DataFrame, source: str = "source_path") -> DataFrame:
    """Payload columns of a caption index row: the item is named by its file name."""
    return clips.withColumn("audio", F.substring_index(strip(F.translate(source, "\\", "/")), "/", -1))
