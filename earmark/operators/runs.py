"""Analysis of training logs and of the progress of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.operators.ordering import place, running


def best_epoch(log: DataFrame, run: str, completion: DataFrame | None = None, monitor: str | None = None) -> DataFrame:
    """Best epoch and metric per run: from its completion record if there is one, else from the log.

    The log's metric is ``monitor``, or else the first present of checkpoint, validation and training
    similarity. The earliest epoch wins on equal metrics; NaN is no metric.
    """
    metric = F.col(monitor) if monitor else F.coalesce("checkpoint_metric", "val_similarity", "train_similarity")
    usable = log.withColumn("_metric", metric).filter(F.col("_metric").isNotNull() & ~F.isnan("_metric"))
    best = F.max(F.struct(F.col("_metric").alias("metric"), (-F.col("epoch")).alias("neg_epoch")))
    logged = usable.groupBy(run).agg(best.alias("_b")).select(run, (-F.col("_b.neg_epoch")).alias("_epoch"), F.col("_b.metric").alias("_metric"))
    if completion is None:
        return logged.select(run, F.col("_epoch").alias("best_epoch"), F.col("_metric").alias("best_metric"))
    recorded = completion.filter(F.col("best_similarity").isNotNull()).select(run, "best_epoch", "best_similarity")
    both = logged.join(recorded, run, "full")
    has_record = F.col("best_similarity").isNotNull()
    return both.select(
        run, F.when(has_record, F.col("best_epoch")).otherwise(F.col("_epoch")).alias("best_epoch"),
        F.coalesce("best_similarity", "_metric").alias("best_metric"))


def run_complete(log: DataFrame, run: str, flagged: DataFrame | None = None, min_epoch: int = 5) -> DataFrame:
    """Per run whether it finished: flagged so, or its last epoch is late enough and has a validation metric."""
    last = log.groupBy(run).agg(F.max_by(F.struct("epoch", "val_similarity"), "epoch").alias("_l"))
    done = (F.col("_l.epoch") >= min_epoch) & F.col("_l.val_similarity").isNotNull()
    out = last.select(run, F.col("_l.epoch").alias("last_epoch"), F.coalesce(done, F.lit(False)).alias("complete"))
    if flagged is None:
        return out
    out = out.join(flagged.select(run, F.lit(True).alias("_f")).distinct(), run, "full")
    return out.withColumn("complete", F.coalesce("_f", F.lit(False)) | F.coalesce("complete", F.lit(False))).drop("_f")


def group_state(complete: DataFrame, group: str) -> DataFrame:
    """Per group of runs: complete and total number, and done / partial / pending."""
    counted = complete.groupBy(group).agg(F.count_if("complete").alias("n_complete"), F.count(F.lit(1)).alias("n_total"))
    return counted.withColumn("status", progress_state(F.col("n_complete"), F.col("n_total")))


def progress_state(n_done: Column, n_total: Column, idle: Column | None = None) -> Column:
    idle = F.lit("pending") if idle is None else idle
    return F.when((n_total > 0) & (n_done >= n_total), F.lit("done")).when(n_done > 0, F.lit("partial")).otherwise(idle)


def evaluation_coverage(present: DataFrame, datasets: Sequence[str], arms: Sequence[str], n_seeds: int) -> DataFrame:
    """Per data set: finished evaluations per arm, total, expected number and state. ``present`` has one row per result."""
    spark = present.sparkSession
    done = present.select("dataset", "arm", "seed").distinct().groupBy("dataset").agg(
        *[F.count_if(F.col("arm") == a).alias(f"n_{a}") for a in arms])
    expected = spark.createDataFrame([(d,) for d in datasets], "dataset STRING")
    rows = expected.join(done, "dataset", "left").fillna(0)
    total = sum((F.col(f"n_{a}") for a in arms), F.lit(0))
    rows = rows.withColumns({"n_done": total, "n_expected": F.lit(n_seeds * len(arms))})
    return rows.withColumn("eval_state", progress_state(F.col("n_done"), F.col("n_expected")))


def audio_readiness(manifests: DataFrame, inventory: DataFrame, datasets: Sequence[str], path: str = "audio_path") -> DataFrame:
    """Per data set: manifest rows, rows whose file is there, and done / partial / pending.

    ``manifests`` has dataset and a path; ``inventory`` has path. A data set without a manifest is pending.
    """
    there = inventory.select(F.col("path").alias(path)).distinct().withColumn("_there", F.lit(True))
    counted = manifests.join(there, path, "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count("_there").alias("n_ready"))
    expected = manifests.sparkSession.createDataFrame([(d,) for d in datasets], "dataset STRING")
    rows = expected.join(counted, "dataset", "left").fillna(0, ["n_rows", "n_ready"])
    return rows.withColumn("prep_state", progress_state(F.col("n_ready"), F.col("n_rows")))


def coverage_states(readiness: DataFrame, present: DataFrame, arms: Sequence[str], n_seeds: int) -> DataFrame:
    """Preparation and evaluation of each data set: an evaluation that hasn't begun is next once the files are ready, else pending."""
    names = [r["dataset"] for r in readiness.select("dataset").collect()]  # one row a data set
    done = evaluation_coverage(present, names, arms, n_seeds).drop("eval_state")
    idle = F.when(F.col("prep_state") == "done", F.lit("next")).otherwise(F.lit("pending"))
    return readiness.join(done, "dataset").withColumn("eval_state", progress_state(F.col("n_done"), F.col("n_expected"), idle))


def overall_state(states: DataFrame, report_exists: bool) -> DataFrame:
    """One row: state of the whole evaluation, and expected results of the ready data sets against those there are."""
    ready = F.col("prep_state") == "done"
    totals = states.agg(
        F.coalesce(F.sum(F.when(ready, F.col("n_expected"))), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("n_done"), F.lit(0)).alias("n_done"),
        F.count_if(ready).alias("n_prepared"), F.count_if(ready & (F.col("eval_state") != "done")).alias("_open"), F.count_if(F.col("prep_state") == "partial").alias("_partial"))
    evaluated = (F.col("n_prepared") > 0) & (F.col("_open") == 0)
    begun = (F.col("n_done") > 0) | (F.col("n_prepared") > 0)
    state = (
        F.when(F.lit(report_exists) & evaluated, F.lit("done")).when(begun & evaluated, F.lit("eval pending"))
        .when(begun | (F.col("_partial") > 0), F.lit("partial")).otherwise(F.lit("pending")))
    return totals.withColumn("state", state).drop("_open", "_partial")


def step_states(steps: DataFrame, group: str, step: str = "step", done: str = "done", started: str | None = None) -> DataFrame:
    """State of ordered steps per group: done; the first unfinished is next (running if started); the rest pending."""
    open_before = running(
        place(steps, [group], [step]), [group], [step], [("_open", "sum", (~F.col(done)).cast("long"))], inclusive=False)
    first = F.when(F.col(started), F.lit("running")).otherwise(F.lit("next")) if started else F.lit("next")
    return open_before.withColumn(
        "state", F.when(F.col(done), F.lit("done")).when(F.col("_open") == 0, first).otherwise(F.lit("pending"))).drop("_open", "_placement")


def early_stop(log: DataFrame, run: str, epoch: str, metric: str, patience: int = 2, min_epochs: int = 5) -> DataFrame:
    """Per run: epochs seen before the stop, stop epoch (null if none), best epoch and metric up to the stop.

    An epoch improves if its metric is above every earlier one. The run stops at the first epoch, not before
    ``min_epochs``, that is ``patience`` logged epochs past the last improvement. NaN never improves. Epochs are reported as
    logged, so a log that starts late keeps its numbers. ``epoch`` is unique per run.
    """
    placed = place(log.select(run, epoch, F.when(~F.isnan(metric), F.col(metric)).alias(metric)), [run], [epoch])
    before = running(placed, [run], [epoch], [("_best", "max", F.col(metric)), ("_before", "count", F.lit(1))], inclusive=False)
    seen = before.withColumns({
        "_no": F.col("_before") + 1,
        "_improved": F.col(metric).isNotNull() & (F.col("_best").isNull() | (F.col(metric) > F.col("_best")))})
    seen = running(seen, [run], [epoch], [
        ("_last", "max", F.when(F.col("_improved"), F.col("_no"))), ("_last_epoch", "max", F.when(F.col("_improved"), F.col(epoch)))])
    stop = (F.col("_no") - F.coalesce("_last", F.lit(0)) >= patience) & (F.col(epoch) >= min_epochs)
    # the best epoch and metric up to a row are known on that row
    here = F.struct("_no", F.col(epoch).alias("_epoch"), "_last_epoch", F.greatest("_best", metric).alias("_metric"))
    ends = seen.groupBy(run).agg(
        F.max("_no").alias("n_logged"), F.min(F.when(stop, here)).alias("_stop"), F.max(here).alias("_end"))
    at = F.coalesce("_stop", "_end")
    return ends.select(
        run, "n_logged", F.col("_stop._epoch").alias("stop_epoch"), at["_last_epoch"].alias("best_epoch"), at["_metric"].alias("best_metric"))


def plateau_stop(
    log: DataFrame, run: str, iteration: str, metric: str, min_delta: float, patience: int, inner_ok: Column
) -> DataFrame:
    """Per run: first iteration at which the outer loop stops, as logged, or null.

    An iteration is stagnant if it gains less than ``min_delta`` over the one before. After ``patience``
    stagnant iterations in a row the loop stops if ``inner_ok`` holds there; otherwise the count starts again.
    So within a stretch of stagnation the rule is tested at every multiple of ``patience``.
    """
    rows = log.select(run, iteration, metric, inner_ok.alias("_ok"))
    placed = place(rows, [run], [F.col(iteration)])
    # the largest earlier (iteration, metric) pair is the row before
    paired = running(placed, [run], [F.col(iteration)], [
        ("_prev", "max", F.struct(F.col(iteration).alias("i"), F.col(metric).alias("m"))), ("_before", "count", F.lit(1))], inclusive=False)
    paired = paired.withColumns({
        "_no": F.col("_before") + 1, "_stagnant": F.coalesce(F.col(metric) - F.col("_prev.m") < min_delta, F.lit(False))})
    counted = running(paired, [run], [F.col(iteration)], [("_reset", "max", F.when(~F.col("_stagnant"), F.col("_no")))])
    length = F.col("_no") - F.col("_reset")
    stop = F.col("_stagnant") & (length % patience == 0) & F.col("_ok")
    return counted.groupBy(run).agg(F.count(F.lit(1)).alias("n_iterations"), F.min(F.when(stop, F.col(iteration))).alias("stop_iteration"))


def suffix_histogram(files: DataFrame, suffix: Column) -> DataFrame:
    """Files per suffix, most frequent first."""
    return files.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.col("n_files").desc(), "suffix")
