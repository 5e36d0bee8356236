"""Keyed merges, exclusions, work lists and audits.

Every key table is reduced to one row per key by partial aggregation before it is joined, so a join never
multiplies rows and the skewed side of a join can be split at run time. No side is forced to broadcast;
Spark broadcasts a side whose measured size is below its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.constants import LABEL_COLUMNS, PRIMARY_TAGS
from earmark.functions.keys import basename, blank_to_null, norm_path, resolve_path, source_key, strip
from earmark.functions.text import tag_caption
from earmark.functions.values import array_mean, flag_is_bad, parse_flag
from earmark.operators.ordering import keep_one, with_position


def source_metadata(metadata: DataFrame, order: str = "_ord") -> DataFrame:
    """source_key, text, mood and confidence: the last metadata row of each source."""
    rows = metadata.filter(blank_to_null("audio").isNotNull()).select(source_key("audio").alias("source_key"), "text", "mood", "confidence", order, F.lit(True).alias("_hit"))
    return keep_one(rows, ["source_key"], [order], keep="last").drop(order)


def match_segments(segments: DataFrame, metadata: DataFrame, order: str = "_ord") -> DataFrame:
    """Segments with the text, mood and confidence of their source (last metadata row per source wins).

    ``matched`` tells whether the source has metadata; unmatched segments stay for counting.
    """
    meta = source_metadata(metadata, order)
    rows = segments.filter(F.col("source_path").isNotNull() & F.col("segment_path").isNotNull())
    joined = rows.withColumn("source_key", source_key("source_path")).join(meta, "source_key", "left")
    return joined.select(
        F.col("segment_path").alias("audio_path"), F.coalesce("text", F.lit("")).alias("text"), "mood", "confidence",
        "source_path", "source_key", "segment_index", "start_sec", "end_sec", "duration_sec",
        F.coalesce("_hit", F.lit(False)).alias("matched"),
    )


def tag_captions(
    manifest: DataFrame, gold: DataFrame, root: str = "/", tags: Sequence[tuple[str, str]] = PRIMARY_TAGS,
    fallback: str = "music", order: str = "_ord",
) -> DataFrame:
    """Manifest with captions made from gold labels (first gold row per source wins); the old text is kept."""
    labels = keep_one(
        gold.filter(blank_to_null("source_path").isNotNull() & F.col("human_multihot").isNotNull()).select(
            resolve_path("source_path", root).alias("_key"), F.col("human_multihot").alias("_labels"), order),
        ["_key"], [order],
    ).drop(order)
    rows = manifest.filter(blank_to_null("source_path").isNotNull()).withColumn("_key", resolve_path("source_path", root))
    caption = tag_caption("_labels", tags, fallback)
    return (
        rows.join(labels, "_key", "left")
        .withColumn("text_orig", F.coalesce("text", F.lit("")))
        .withColumn("_c", caption)
        .withColumns({"text": F.col("_c.text"), "text_source": F.col("_c.text_source")})
        .drop("_key", "_labels", "_c")
    )


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of two tables side by side, by their position in the given total orders. Row counts must be equal."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"row count mismatch: {n_left} and {n_right}; write both again together")
    a = with_position(left, [], [F.col(c) for c in left_order], "row_idx")
    b = with_position(right, [], [F.col(c) for c in right_order], "row_idx")
    return a.join(b, "row_idx")


def join_numbered(left: DataFrame, right: DataFrame, number: str) -> DataFrame:
    """Rows of two tables side by side by the number that each row has. Row counts must be equal; nothing is sorted."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"row count mismatch: {n_left} and {n_right}; write both again together")
    return left.join(right, number)


def name_warnings(joined: DataFrame, left_name: str, right_name: str, labels: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    """One row: mismatched names, repeated names, and unreadable label cells of a positional join."""
    shown = F.coalesce(blank_to_null(left_name), blank_to_null(right_name))
    mismatch = blank_to_null(left_name).isNotNull() & blank_to_null(right_name).isNotNull() & (strip(left_name) != strip(right_name))
    bad = sum((flag_is_bad(c).cast("int") for c in labels if c in joined.columns), F.lit(0))
    per_name = joined.groupBy(shown.alias("_name")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(mismatch).alias("_m"), F.sum(bad).alias("_b"))
    return per_name.agg(
        F.sum("_n").alias("n_rows"), F.sum("_m").alias("n_name_mismatch"), F.sum(F.col("_n") - 1).alias("n_duplicate_names"),
        F.sum("_b").alias("n_bad_cells"))


def merge_gold(
    gold: DataFrame, tempo: DataFrame, metadata: DataFrame, labels: Sequence[str] = LABEL_COLUMNS, order: str = "_ord"
) -> DataFrame:
    """Nested gold rows: human labels, tempo result of the source (status ok only), metadata by file name.

    The last tempo and metadata row per key wins. Label cells are text as read from the sheet.
    """
    fields = ("clip_bpms", "gt_tempo_song", "pred_tempo_song", "clip_gt_tempo", "clip_pred_tempo", "mean_scores_song", "eval_audio_paths")
    tempo_rows = keep_one(
        tempo.filter(blank_to_null("source_path").isNotNull()).select(
            norm_path("source_path").alias("source_path"), F.struct("status", *fields).alias("_t"), order),
        ["source_path"], [order], keep="last").drop(order)
    meta_rows = keep_one(
        metadata.filter(blank_to_null("audio").isNotNull()).select(
            basename("audio").alias("_base"), F.struct("audio", "text", "mood", "confidence").alias("program_metadata"), order),
        ["_base"], [order], keep="last").drop(order)
    rows = gold.filter(blank_to_null("source_path").isNotNull()).withColumn("source_path", norm_path("source_path"))
    t = F.col("_t")
    program_tempo = F.when(
        t["status"] == "ok",
        F.struct(
            t["clip_bpms"].alias("clip_bpms"), array_mean(t["clip_bpms"]).alias("bpm_mean"),
            t["gt_tempo_song"].alias("tempo_bin_bpm"), t["pred_tempo_song"].alias("tempo_clap_zeroshot"),
            t["clip_gt_tempo"].alias("clip_gt_tempo"), t["clip_pred_tempo"].alias("clip_pred_tempo"),
            t["mean_scores_song"].alias("mean_scores_song"), t["eval_audio_paths"].alias("eval_audio_paths")),
    )
    human = F.map_from_arrays(F.array(*[F.lit(c) for c in labels]), F.array(*[parse_flag(c) for c in labels]))
    return (
        rows.withColumn("_base", basename("source_path"))
        .join(tempo_rows, "source_path", "left")
        .join(meta_rows, "_base", "left")
        .select(
            F.coalesce(blank_to_null("song_name"), F.col("_base")).alias("song_name"), "source_path",
            human.alias("human_multihot"), program_tempo.alias("program_tempo"), "program_metadata")
    )


def merge_summary(merged: DataFrame) -> DataFrame:
    """One row: rows written and how many carry tempo and metadata."""
    return merged.agg(
        F.count(F.lit(1)).alias("rows_written"), F.count("program_tempo").alias("with_program_tempo"),
        F.count("program_metadata").alias("with_program_metadata"))


def swap_captions(manifest: DataFrame, refined: DataFrame, root: str = "/", default_source: str = "original", order: str = "_ord") -> DataFrame:
    """Captions replaced by refined ones, matched by resolved path, else by file name (last refined row wins)."""
    usable = refined.filter(F.col("audio_path").isNotNull() & blank_to_null("text").isNotNull()).select(
        resolve_path("audio_path", root).alias("_path"), basename("audio_path").alias("_name"), strip("text").alias("_new"), order)
    by_path = keep_one(usable.select("_path", "_new", order), ["_path"], [order], keep="last").select("_path", F.col("_new").alias("_by_path"))
    by_name = keep_one(usable.select("_name", "_new", order), ["_name"], [order], keep="last").select("_name", F.col("_new").alias("_by_name"))
    rows = manifest.filter(blank_to_null("audio_path").isNotNull()).withColumns(
        {"_path": resolve_path("audio_path", root), "_name": basename("audio_path")})
    joined = rows.join(by_path, "_path", "left").join(by_name, "_name", "left").withColumn("_new", F.coalesce("_by_path", "_by_name"))
    return _replace_text(joined, "llm_refined", default_source).drop("_path", "_name", "_by_path", "_by_name", "_new")


def propagate_captions(
    clips: DataFrame, ledger: DataFrame, root: str = "/", label: str = "llm_full_corpus", default_source: str = "original",
    tag_mode: bool = False, order: str = "_ord",
) -> DataFrame:
    """Every clip takes the caption of its song (last ledger row wins); clips without one keep theirs.

    In ``tag_mode`` the tag text is kept as ``text_orig_tag`` unless the clip already has an original text.
    """
    captions = caption_map(ledger, root, order)
    rows = clips.filter(blank_to_null("source_path").isNotNull()).withColumn("_key", resolve_path("source_path", root))
    joined = rows.join(captions, "_key", "left")
    if not tag_mode:
        return _replace_text(joined, label, default_source).drop("_key", "_new")
    keep_tag = F.when(F.col("_new").isNotNull(), F.col("text"))
    if "text_orig" in clips.columns:
        keep_tag = F.when(F.col("text_orig").isNull(), keep_tag)
    joined = joined.withColumn("text_orig_tag", keep_tag)
    return joined.withColumns({
        "text": F.coalesce("_new", "text"),
        "text_source": F.when(F.col("_new").isNotNull(), F.lit(label)).otherwise(_source_or(clips, default_source)),
    }).drop("_key", "_new")


def caption_map(ledger: DataFrame, root: str = "/", order: str = "_ord") -> DataFrame:
    """Last non-blank caption per resolved song key: ``_key``, ``_new``."""
    usable = ledger.filter(F.col("source_path").isNotNull() & blank_to_null("text").isNotNull())
    keyed = usable.select(resolve_path("source_path", root).alias("_key"), strip("text").alias("_new"), order)
    return keep_one(keyed, ["_key"], [order], keep="last").drop(order)


def _source_or(df: DataFrame, default: str) -> Column:
    return F.coalesce("text_source", F.lit(default)) if "text_source" in df.columns else F.lit(default)


def _replace_text(joined: DataFrame, label: str, default_source: str) -> DataFrame:
    hit = F.col("_new").isNotNull()
    old = F.col("text_orig") if "text_orig" in joined.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "text_orig": F.when(hit, F.coalesce("text", F.lit(""))).otherwise(old),
        "text": F.coalesce("_new", "text"),
        "text_source": F.when(hit, F.lit(label)).otherwise(_source_or(joined, default_source)),
    })


def exclude_holdout(candidates: DataFrame, holdout: DataFrame, key: str = "audio_path") -> DataFrame:
    """Candidates whose key is in no hold-out manifest."""
    keys = holdout.filter(blank_to_null(key).isNotNull()).select(norm_path(key).alias("_key")).distinct()
    return candidates.withColumn("_key", norm_path(key)).join(keys, "_key", "left_anti").drop("_key")


def evaluation_pool(index: DataFrame, gold: DataFrame, item: str = "audio", gold_key: str = "source_path") -> DataFrame:
    """Index rows whose file name is labelled."""
    labelled = gold.filter(blank_to_null(gold_key).isNotNull()).select(basename(gold_key).alias("basename")).distinct()
    return index.filter(blank_to_null(item).isNotNull()).withColumn("basename", basename(item)).join(labelled, "basename", "left_semi")


def restrict_keys(df: DataFrame, key: str, *key_sets: DataFrame) -> DataFrame:
    """Rows whose key is in every given key set (first column of each)."""
    for keys in key_sets:
        df = df.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df


def keys_without_rows(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def remaining(work: DataFrame, ledger: DataFrame, key: str, retry_failed: bool = False, ok: str = "ok") -> DataFrame:
    """Work whose key the ledger lacks; with ``retry_failed`` a key without any ok row counts as lacking."""
    done = ledger.filter(F.col("status") == ok) if retry_failed else ledger
    return work.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def completeness(work: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of the work and how many the ledger holds."""
    keys = work.select(key).distinct()
    done = keys.join(ledger.select(key, F.lit(1).alias("_done")).distinct(), key, "left")
    return done.agg(F.count(F.lit(1)).alias("n_total"), F.count("_done").alias("n_done"))


def require_complete(work: DataFrame, ledger: DataFrame, key: str) -> None:
    row = completeness(work, ledger, key).first()
    if row["n_done"] < row["n_total"]:
        raise RuntimeError(f"incomplete: {row['n_done']} of {row['n_total']} keys are in the ledger")


def coverage_audit(expected: DataFrame, ledger: DataFrame, key: str, ok: Column, order: str = "_ord") -> DataFrame:
    """Expected keys with their state in the ledger (last row wins): ok, present_not_ok or missing."""
    state = keep_one(ledger.select(key, ok.alias("_ok"), order), [key], [order], keep="last").drop(order)
    flagged = expected.join(state.withColumn("_seen", F.lit(True)), key, "left")
    return flagged.withColumn(
        "state",
        F.when(F.col("_seen").isNull(), F.lit("missing")).when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("present_not_ok")),
    ).drop("_ok", "_seen")


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count(F.lit(1)).alias("expected"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("ok", "missing", "present_not_ok")])


def resolve_files(manifest: DataFrame, candidates: Column, inventory: DataFrame, key: str) -> DataFrame:
    """Manifest with ``audio_path`` = the first candidate path that exists and is not empty, else null."""
    exploded = manifest.select(key, F.posexplode(candidates).alias("_priority", "path"))
    present = inventory.filter(F.col("length") > 0).select("path").distinct()
    chosen = exploded.join(present, "path").groupBy(key).agg(F.min_by("path", "_priority").alias("audio_path"))
    return manifest.join(chosen, key, "left")


def readiness(resolved: DataFrame, path: str = "audio_path") -> DataFrame:
    """One row: rows, rows whose file exists, and the state that follows."""
    counted = resolved.agg(F.count(F.lit(1)).alias("n_rows"), F.count(path).alias("n_audio_ready"))
    return counted.withColumn(
        "prep_state",
        F.when((F.col("n_rows") > 0) & (F.col("n_audio_ready") >= F.col("n_rows")), F.lit("done"))
        .when(F.col("n_audio_ready") > 0, F.lit("partial")).otherwise(F.lit("pending")))


def layered_merge(layers: Sequence[DataFrame], key: str, order: str = "_ord") -> DataFrame:
    """One row per key over all layers; a later layer overrides, within a layer the last row wins."""
    merged = None
    for level, layer in enumerate(layers):
        rows = layer.filter(blank_to_null(key).isNotNull()).withColumn(key, strip(key)).withColumn("_layer", F.lit(level))
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    return keep_one(merged, [key], ["_layer", order], keep="last").drop(order)


def union_tags(*tables: DataFrame, key: str = "track_id", order: str = "_ord") -> DataFrame:
    """One row per key with the sorted union of its tags; other fields from the first row.

    Tags are made distinct per (key, tag) before they are gathered, so a key's array holds its distinct tags only.
    """
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "tags")]
    first = keep_one(rows.select(key, *rest), [key], [order]).drop(order)
    tags = rows.select(key, F.explode("tags").alias("_tag")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("_tag")).alias("tags"))
    return first.join(tags, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def instrument_flags(labels: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One row per key: for each output flag, whether any annotation names its instrument."""
    return labels.groupBy("sample_key").agg(
        *[F.max(F.when(F.col("instrument") == name, 1).otherwise(0)).alias(out) for out, name in flags.items()])


def mix_domains(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all domains with a ``domain`` column; columns a domain lacks are null."""
    merged = None
    for domain, rows in parts.items():
        tagged = rows.withColumn("domain", F.lit(domain))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def add_hard_duplicates(train: DataFrame, hard: DataFrame, refined: DataFrame, iteration: int, hard_weight: float = 2.0,
                        default_source: str = "original", duplicate: bool = True, order: str = "_ord") -> DataFrame:
    """All rows with weight 1, plus refined hard rows once more with the higher weight (last refined row wins)."""
    base_source = F.coalesce("text_source", F.lit(default_source)) if "text_source" in train.columns else F.lit(default_source)
    base_orig = F.coalesce("text_orig", "text") if "text_orig" in train.columns else F.col("text")
    original = train.select(
        "audio_path", "text", base_orig.alias("text_orig"), base_source.alias("text_source"), F.lit("orig").alias("source"),
        F.lit(1.0).alias("weight"), F.lit(iteration).alias("iter"),
        F.lit(None).cast("double").alias("sim"), F.lit(None).cast("double").alias("error_score"))
    if not duplicate:
        return original
    newest = keep_one(refined.select("audio_path", "text", "text_orig", "text_source", "sim", "error_score", order), ["audio_path"], [order], keep="last")
    extra = newest.join(hard.select("audio_path").distinct(), "audio_path", "left_semi").select(
        "audio_path", "text", F.coalesce("text_orig", "text").alias("text_orig"), F.coalesce("text_source", F.lit(default_source)).alias("text_source"),
        F.lit("hard").alias("source"), F.lit(hard_weight).alias("weight"), F.lit(iteration).alias("iter"), "sim", "error_score")
    return original.unionByName(extra)


def work_list(on_disk: DataFrame, existing: DataFrame, key: str = "audio", threshold: float | None = None, rebuild: bool = False) -> DataFrame:
    """Keys to process among all keys on disk or on record: the new ones, those below a threshold, or all.

    Each key once; of several records of a key the highest confidence counts.
    """
    keys = on_disk.select(key).union(existing.select(key)).distinct()
    if threshold is not None:
        known = existing.groupBy(key).agg(F.max("confidence").alias("confidence"))
        joined = keys.join(known, key, "left")
        return joined.filter(F.col("confidence").isNull() | (F.col("confidence") < threshold)).select(key)
    return keys if rebuild else keys.join(existing.select(key).distinct(), key, "left_anti")
