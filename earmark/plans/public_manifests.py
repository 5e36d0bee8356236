"""Manifests of public data sets: labels of an annotation table, a seeded sample with a cap per tag, and the files that are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.constants import PUBLIC_LABELS, WIDE_RELAXING_COLUMNS, WIDE_VOCAL_COLUMNS
from earmark.functions.keys import blank_to_null, strip
from earmark.operators.filters import any_flag
from earmark.operators.merging import instrument_flags, resolve_files
from earmark.operators.sampling import cap_per_tag
from earmark.sources.tabular import long_labels, read_csv, read_wide_tsv

LABELS = tuple(PUBLIC_LABELS.values())


def _sampled(flags: DataFrame, key: str, usable: Column, cap: int, seed: int) -> DataFrame:
    """Rows whose key is among the first ``cap`` of any label in seeded order; ``usable`` says which rows may be drawn."""
    drawn = flags.filter(usable).groupBy(key).agg(*[F.max(c).alias(c) for c in LABELS])
    kept = cap_per_tag(drawn, key, {c: F.col(c) == 1 for c in LABELS}, cap, seed)
    return flags.join(kept.select(key), key, "left_semi")


def wide_manifest(rows: DataFrame, inventory: DataFrame, root: str, cap: int = 60, seed: int = 42, dataset: str = "mtat") -> DataFrame:
    """One row per annotated clip of the sample: clip_id, mp3_path, three labels, and audio_path where a file with content is there.

    ``rows`` is the wide annotation table, one column a tag; several columns stand for one label. Clips without a path are not drawn. A file is looked
    for in the folders mp3, mp3s and input, then beside them. ``inventory`` has path and length.
    """
    present = {c.lower(): c for c in rows.columns}

    def flag(names: Sequence[str]) -> Column:
        return any_flag([F.col(f"`{present[n]}`") for n in names if n in present]).cast("int")

    path = F.coalesce(F.col("mp3_path"), F.lit(""))
    flags = rows.select("clip_id", path.alias("mp3_path"), *[flag(names).alias(c) for c, names in zip(LABELS, (("piano",), WIDE_VOCAL_COLUMNS, WIDE_RELAXING_COLUMNS))])
    kept = _sampled(flags, "clip_id", F.col("mp3_path") != "", cap, seed)
    relative = strip("mp3_path")
    folders = [f"{root.rstrip('/')}/{f}" for f in ("mp3/", "mp3s/", "input/", "")]
    candidates = F.when(relative != "", F.array(*[F.concat(F.lit(f), relative) for f in folders])).otherwise(F.array().cast("array<string>"))
    return resolve_files(kept.withColumn("dataset", F.lit(dataset)), candidates, inventory, "clip_id")


def read_wide_manifest(spark: SparkSession, path: str, inventory: DataFrame, root: str, cap: int = 60, seed: int = 42) -> DataFrame:
    return wide_manifest(read_wide_tsv(spark, path, ("clip_id", "mp3_path", "piano")), inventory, root, cap, seed)


def long_manifest(rows: DataFrame, inventory: DataFrame, root: str, threshold: float = 0.5, cap: int = 60, seed: int = 42, dataset: str = "openmic") -> DataFrame:
    """One row per key of the sample: sample_key, three labels (relaxing always 0), and audio_path where a file with content is there.

    ``rows`` is the long annotation table (sample_key, instrument, relevance). Files lie in folders named by the first three characters of the key.
    """
    flags = instrument_flags(long_labels(rows, threshold), {LABELS[0]: "piano", LABELS[1]: "voice"}).withColumn(LABELS[2], F.lit(0))
    kept = _sampled(flags, "sample_key", F.lit(True), cap, seed)
    folder = F.concat(F.lit(f"{root.rstrip('/')}/audio/"), F.substring("sample_key", 1, 3), F.lit("/"), F.col("sample_key"))
    candidates = F.array(*[F.concat(folder, F.lit(x)) for x in (".ogg", ".wav", ".mp3")])
    return resolve_files(kept.withColumn("dataset", F.lit(dataset)), candidates, inventory, "sample_key")


def read_long_manifest(spark: SparkSession, path: str, inventory: DataFrame, root: str, threshold: float = 0.5, cap: int = 60, seed: int = 42) -> DataFrame:
    rows = read_csv(spark, path, required=("sample_key", "instrument", "relevance"), splittable=True)
    return long_manifest(rows, inventory, root, threshold, cap, seed)


def usable_rows(manifest: DataFrame) -> DataFrame:
    """Rows whose file was found."""
    return manifest.filter(blank_to_null("audio_path").isNotNull())
