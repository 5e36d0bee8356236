"""Zero-shot tempo of clips and of songs, as resumable runs: work that the ledger lacks, its results, and metrics over both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.constants import TEMPO_LABELS, TEMPO_PROMPTS
from earmark.functions.keys import blank_to_null, resolve_path, strip
from earmark.functions.values import bin_value
from earmark.operators.classification import argmax_label, class_metrics, confusion_counts, zero_shot
from earmark.session import pin

#: Adds ``bpm`` to rows by their absolute path; null where it can't be measured.
Measure = Callable[[DataFrame, str], DataFrame]
Encode = Callable[[DataFrame, str, str], DataFrame]


def _scored(rows: DataFrame, path: str, encode_audio: Encode, encode_text: Encode) -> DataFrame:
    """Rows with pred, margin and scores of the three tempo prompts."""
    spark = rows.sparkSession
    asked = spark.createDataFrame(list(enumerate(TEMPO_PROMPTS)), "place INT, prompt STRING")
    prompts = [r["vec"] for r in encode_text(asked, "prompt", "vec").orderBy("place").collect()]  # one row a prompt
    return zero_shot(encode_audio(rows, path, "_vec"), prompts, TEMPO_LABELS, "_vec").drop("_vec")


def _score_struct(scores: Column) -> Column:
    return F.struct(*[scores[i].alias(label) for i, label in enumerate(TEMPO_LABELS)])


def clip_run(
    manifest: DataFrame, ledger: DataFrame, inventory: DataFrame, measure: Measure, encode_audio: Encode, encode_text: Encode, key: str = "audio_path", root: str = "/",
) -> DataFrame:
    """New ledger rows of the clips whose key the ledger lacks: key, status, bpm, gt_tempo, pred_tempo, scores, margin_top1_top2.

    A clip without a key, without a file, or whose tempo can't be measured has a row with that status and no more. Clips are encoded
    only once their tempo is known. The result is written, so that measuring and encoding happen once.
    """
    own = manifest.select(F.col(key).alias("_key"), resolve_path(key, root).alias("_path"))
    done = ledger.select(F.col(key).alias("_key")).filter(blank_to_null("_key").isNotNull()).distinct()
    blank = blank_to_null("_key").isNull()
    missing = own.filter(blank).select("_key", F.lit("missing_audio_field").alias("status"))
    work = own.filter(~blank).join(done, "_key", "left_anti")
    there = inventory.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    found = pin(measure(work.join(there, "_path", "left").filter("_there"), "_path").select("_key", "_path", "bpm"), "measured")
    absent = work.join(there, "_path", "left_anti").select("_key", F.lit("missing_file").alias("status"))
    failed = found.filter("bpm is null").select("_key", F.lit("bpm_error").alias("status"))
    scored = _scored(found.filter("bpm is not null"), "_path", encode_audio, encode_text)
    ok = scored.select(
        "_key", F.lit("ok").alias("status"), "bpm", bin_value("bpm").alias("gt_tempo"), F.col("pred").alias("pred_tempo"),
        _score_struct(F.col("scores")).alias("scores"), F.col("margin").alias("margin_top1_top2"))
    rows = ok.unionByName(missing.unionByName(absent).unionByName(failed), allowMissingColumns=True)
    return pin(rows.withColumnRenamed("_key", key), "clip_run")


def song_run(
    manifest: DataFrame, ledger: DataFrame, inventory: DataFrame, measure: Measure, encode_audio: Encode, encode_text: Encode,
    key: str = "source_path", clips: str = "eval_audio_paths", root: str = "/",
) -> DataFrame:
    """New ledger rows of the songs that the ledger lacks: status, values of each clip in order, tempo by majority, and mean scores.

    On a tie the true tempo is that of the mean beat rate, the predicted one that of the greatest mean score. The first clip that is
    bad decides the status of its song, and such a song is not encoded. Songs without a key or without clips have no row. A song's few clips
    are gathered by song.
    """
    done = ledger.select(strip(key).alias("_done")).filter(blank_to_null("_done").isNotNull()).distinct()
    todo = manifest.filter(blank_to_null(key).isNotNull() & (F.size(clips) > 0)).join(done, F.col(key) == F.col("_done"), "left_anti")
    todo = todo.select(strip(key).alias("_key"), F.col(clips).alias("_clips"))
    each = todo.select("_key", F.posexplode("_clips").alias("_at", "_clip")).withColumn("_path", resolve_path(strip("_clip"), root))
    there = inventory.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    each = each.withColumn("_blank", blank_to_null("_clip").isNull()).join(there, "_path", "left")
    usable = ~F.col("_blank") & F.col("_there").isNotNull()
    known = pin(measure(each.filter(usable).select("_key", "_at", "_path"), "_path").select("_key", "_at", "_path", "bpm"), "measured")
    bad = each.filter(~usable).select("_key", "_at", F.when(F.col("_blank"), F.lit("bad_clip_path")).otherwise(F.lit("missing_file")).alias("_why"))
    bad = bad.unionByName(known.filter("bpm is null").select("_key", "_at", F.lit("bpm_error").alias("_why")))
    reasons = pin(bad.groupBy("_key").agg(F.min_by("_why", "_at").alias("status")), "reasons")
    scored = _scored(known.join(reasons, "_key", "left_anti"), "_path", encode_audio, encode_text)
    clip = F.struct("_at", "bpm", bin_value("bpm").alias("gt"), "pred", "scores")
    songs = scored.groupBy("_key").agg(F.sort_array(F.collect_list(clip)).alias("c"))

    def majority(values: Column) -> Column:
        counts = F.array(*[_count(values, t) for t in TEMPO_LABELS])
        top = F.array_max(counts)
        return F.when(F.size(F.filter(counts, lambda n: n == top)) == 1, argmax_label(counts, TEMPO_LABELS))

    n = F.size("c").cast("double")
    mean = F.array(*[F.aggregate("c", F.lit(0.0), _add_score(i)) / n for i in range(len(TEMPO_LABELS))])
    bpms = F.transform("c", lambda c: c["bpm"])
    ok = songs.withColumns({"_mean": mean, "clip_bpms": bpms, "clip_gt_tempo": F.transform("c", lambda c: c["gt"]), "clip_pred_tempo": F.transform("c", lambda c: c["pred"])})
    mean_bpm = F.aggregate("clip_bpms", F.lit(0.0), lambda a, x: a + x) / n
    ok = ok.select(
        "_key", F.lit("ok").alias("status"), "clip_bpms", "clip_gt_tempo", "clip_pred_tempo",
        F.coalesce(majority(F.col("clip_gt_tempo")), bin_value(mean_bpm)).alias("gt_tempo_song"),
        F.coalesce(majority(F.col("clip_pred_tempo")), argmax_label(F.col("_mean"), TEMPO_LABELS)).alias("pred_tempo_song"),
        _score_struct(F.col("_mean")).alias("mean_scores_song"))
    rows = ok.unionByName(reasons.select("_key", "status"), allowMissingColumns=True).join(todo.select("_key", F.col("_clips").alias("eval_audio_paths")), "_key")
    return pin(rows.withColumnRenamed("_key", key), "song_run")


def _count(values: Column, label: str) -> Column:
    return F.size(F.filter(values, lambda x: x == label))


def _add_score(i: int):
    return lambda total, c: total + c["scores"][i]


def run_metrics(ledger: DataFrame, new: DataFrame, truth: str = "gt_tempo", predicted: str = "pred_tempo") -> DataFrame:
    """One row: accuracy, macro F1, and how many results were resumed, new, and skipped in this run; rows with unknown classes don't count."""
    valid = (F.col("status") == "ok") & F.col(truth).isin(*TEMPO_LABELS) & F.col(predicted).isin(*TEMPO_LABELS)
    old, fresh = (df.select("status", truth, predicted) for df in (ledger, new))
    both = old.filter(valid).unionByName(fresh.filter(valid))
    classes = class_metrics(confusion_counts(both, truth, predicted, TEMPO_LABELS))
    overall = classes.agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"), F.sum("support").alias("num_valid_for_eval"))
    resumed = old.agg(F.count_if(valid).alias("n")).scalar()
    this_run = fresh.agg(F.struct(F.count_if(valid).alias("n"), F.count_if(F.col("status") != "ok").alias("skipped"))).scalar()
    return overall.withColumns({"num_resumed_predictions": resumed, "num_new_predictions": this_run["n"], "num_skipped_this_run": this_run["skipped"]})
