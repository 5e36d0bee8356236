"""Corpus building: metadata to clips to leak-free train and validation manifests, and mixing with public sets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.functions.keys import blank_to_null, clip_name, source_key
from earmark.functions.text import tag_caption
from earmark.functions.values import mix_target, public_label_map
from earmark.operators.filters import above
from earmark.operators.merging import exclude_holdout, layered_merge, match_segments, mix_domains, source_metadata
from earmark.operators.sampling import group_split, plan_segments, seeded_shuffle, stratified_sample
from earmark.session import pin


def reviewed_metadata(seed: DataFrame, automatic: DataFrame, human: DataFrame, min_confidence: float = 0.35) -> DataFrame:
    """Metadata after review: seed rows, overridden by confident automatic rows, overridden by human rows."""
    return layered_merge([seed, automatic.filter(above("confidence", min_confidence)), human], "audio")


def segment_map(files: DataFrame, metadata: DataFrame, min_confidence: float, prefix: str = "data/music_db_15s/") -> DataFrame:
    """Clips of the files (path, length_sec) whose metadata confidence lies above the threshold."""
    allowed = metadata.filter(above("confidence", min_confidence)).select(source_key("audio").alias("_key")).distinct()
    kept = files.withColumn("_key", source_key("path")).join(allowed, "_key", "left_semi")
    planned = plan_segments(kept, "length_sec")
    return planned.select(
        F.concat(F.lit(prefix), clip_name("_key", "segment_index")).alias("segment_path"), F.col("path").alias("source_path"), "segment_index",
        "start_sec", "end_sec", "duration_sec")


def train_val_manifests(segments: DataFrame, metadata: DataFrame, ratio: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, one summary row). All clips of a song are on one side; unmatched clips are only counted.

    The matched clips are written once, because the split counts them before it flags them; they carry no texts, which the manifests
    get from their sources.
    """
    fields = ("text", "mood", "confidence")
    bare = metadata.select("audio", *[F.lit(None).cast(metadata.schema[c].dataType).alias(c) for c in fields], "_ord")
    joined = pin(match_segments(segments, bare).drop(*fields))
    matched = joined.filter("matched").drop("matched")
    flagged = group_split(matched, "source_key", ratio, seed)
    counts = flagged.agg(
        F.count(F.lit(1)).alias("matched_segment_rows"), F.count_if("is_val").alias("val_rows"), F.count_if(~F.col("is_val")).alias("train_rows"),
        F.count_distinct("source_key").alias("group_count_sources"))
    unmatched = joined.filter("NOT matched").agg(F.count(F.lit(1)).alias("n")).scalar()
    summary = counts.withColumn("unmatched_segment_rows", unmatched)
    told = flagged.join(source_metadata(metadata), "source_key").select(
        "audio_path", F.coalesce("text", F.lit("")).alias("text"), "mood", "confidence", "source_path", "segment_index", "start_sec", "end_sec", "duration_sec", "is_val")
    return told.filter("NOT is_val").drop("is_val"), told.filter("is_val").drop("is_val"), summary


def public_candidates(rows: DataFrame, holdout: DataFrame, labels: Column | None = None) -> DataFrame:
    """Public rows that carry any label and are not held out, captioned by their labels."""
    labels = public_label_map() if labels is None else labels
    captioned = rows.withColumn("_labels", labels).filter(F.exists(F.map_values("_labels"), lambda v: v == 1))
    captioned = captioned.withColumn("_c", tag_caption("_labels")).withColumns({"text": F.col("_c.text"), "text_source": F.col("_c.text_source")})
    return exclude_holdout(captioned.drop("_c", "_labels"), holdout)


def mixed_manifest(home: DataFrame, public: Mapping[str, DataFrame], mix_ratio: float | None = 0.5, explicit: int | None = None, seed: int = 42) -> DataFrame:
    """In-domain rows and a stratified sample of all public candidates, in seeded order."""
    pool = pin(mix_domains(dict(public)))
    sizes = home.agg(F.count(F.lit(1)).alias("n_home"))
    target = sizes.withColumn("n_pool", pool.agg(F.count(F.lit(1)).alias("n")).scalar()).select(
        mix_target(F.col("n_home"), F.col("n_pool"), explicit, mix_ratio).alias("t")).first()["t"]
    sampled = stratified_sample(pool, "audio_path", target, public_label_map(), seed)
    return seeded_shuffle(home.withColumn("domain", F.lit("home")).unionByName(sampled, allowMissingColumns=True), "audio_path", seed + 1)


def mixed_summary(
    home: DataFrame, candidates: Mapping[str, DataFrame], holdout: DataFrame, mixed: DataFrame, mix_ratio: float | None = 0.5, explicit: int | None = None, key: str = "audio_path",
) -> DataFrame:
    """Counters of a mixed manifest as rows (name, n): rows of each domain and in all, candidates of each public set, paths held out, and how many
    public rows were asked for and, as the candidates allow, aimed at. ``candidates`` are what is left of each set without the hold-out.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    rows = [count(df, f"{name}_candidates") for name, df in candidates.items()]
    rows += [count(home, "home"), count(mixed, "total"), count(holdout.select(key).filter(blank_to_null(key).isNotNull()).distinct(), "holdout_paths")]
    known = pin(reduce(DataFrame.unionByName, rows), "counters")
    pool = F.sum(F.when(F.endswith("name", F.lit("_candidates")), F.col("n")))
    base = known.agg(F.max(F.when(F.col("name") == "home", F.col("n"))).alias("h"), F.coalesce(pool, F.lit(0)).alias("p"))
    asked = mix_target(F.col("h"), F.lit(1 << 62), explicit, mix_ratio)
    targets = base.select(F.explode(F.array(
        F.struct(F.lit("public_target_requested").alias("name"), asked.alias("n")), F.struct(F.lit("public_target").alias("name"), F.least(asked, "p").alias("n")))).alias("t")).select("t.*")
    domains = mixed.groupBy(F.concat(F.lit("domain_"), "domain").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(targets).unionByName(domains)


def domain_counts(mixed: DataFrame) -> DataFrame:
    return mixed.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
