"""Predicates, routing and classification rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.constants import (
    LABEL_COLUMNS, TRADEOFF_FORGETTING, TRADEOFF_HURTS_BOTH, TRADEOFF_NONE, TRADEOFF_SPECIALISATION,
)
from earmark.functions.keys import as_col, blank_to_null, strip
from earmark.functions.values import parse_flag


def above(value: Column | str, threshold: float, inclusive: bool = False) -> Column:
    return as_col(value) >= threshold if inclusive else as_col(value) > threshold


def confidence_band(value: Column | str, low: float = 0.1, high: float = 0.4) -> Column:
    """Route of a record: review for the closed middle band, high, low, or other for a missing number."""
    value = as_col(value)
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("other"))
        .when(value.between(low, high), F.lit("review"))
        .when(value > high, F.lit("high"))
        .otherwise(F.lit("low"))
    )


def route_counts(df: DataFrame, value: str = "confidence") -> DataFrame:
    """One row: total and number of records per route."""
    band = confidence_band(value)
    return df.select(band.alias("band")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("band") == b).alias(n) for b, n in
          (("review", "n_review"), ("high", "n_high"), ("low", "n_low"), ("other", "n_other"))],
    )


def needs_refetch(keys: DataFrame, existing: DataFrame, threshold: float, key: str = "audio") -> DataFrame:
    """Keys without a row, without confidence, or below the threshold; the highest counts of several records of a key."""
    known = existing.groupBy(key).agg(F.max("confidence").alias("confidence"))
    return keys.join(known, key, "left").filter(F.col("confidence").isNull() | (F.col("confidence") < threshold)).select(key)


def any_flag(columns: Sequence[Column | str]) -> Column:
    """True where any annotation cell is exactly 1."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (parse_flag(c) == 1)
    return hit


def any_tag(tags: Column | str, needles: Sequence[str]) -> Column:
    return F.arrays_overlap(as_col(tags), F.array(*[F.lit(n) for n in needles]))


def all_tags(labels: Column | str, tag_ids: Column | Sequence[str]) -> Column:
    """True where every tag has a label other than 0; a tag the map lacks counts as 0."""
    ids = tag_ids if isinstance(tag_ids, Column) else F.array(*[F.lit(t) for t in tag_ids])
    return F.forall(ids, lambda t: F.coalesce(F.try_element_at(as_col(labels), t), F.lit(0)) != 0)


def gate(
    sim_old: Column | str, sim_new: Column | str, text_cos: Column | str,
    min_sim_gain: float = 0.0, min_text_cos: float = 0.85, strict: bool = True,
) -> Column:
    """Struct of the acceptance test of a refined text: gain in similarity first, then drift of the text."""
    old, new, drift = as_col(sim_old), as_col(sim_new), as_col(text_cos)
    sim_ok = new > old + min_sim_gain if strict else new >= old + min_sim_gain
    drift_ok = drift >= min_text_cos
    return F.struct(
        old.alias("sim_old"), new.alias("sim_new"), (new - old).alias("sim_gain"), drift.alias("text_cos"),
        (sim_ok & drift_ok).alias("accepted"),
        F.when(~sim_ok, F.lit("sim")).when(~drift_ok, F.lit("drift")).alias("reject_reason"),
    )


def tradeoff_label(gold_delta: Column | str, ood_delta: Column | str, tag: Column | str) -> Column:
    """Reading of one tag's change in the home domain and outside it; the vocal tag needs a larger gain."""
    gold, ood = as_col(gold_delta), as_col(ood_delta)
    needed = F.when(as_col(tag) == "inst_vocal", F.lit(0.15)).otherwise(F.lit(0.10))
    return (
        F.when(gold.isNull() | ood.isNull(), F.lit("n/a"))
        .when((gold >= -0.05) & (ood >= needed), F.lit(TRADEOFF_FORGETTING))
        .when((gold >= 0.10) & (ood <= -0.05), F.lit(TRADEOFF_SPECIALISATION))
        .when((gold <= -0.05) & (ood <= -0.05), F.lit(TRADEOFF_HURTS_BOTH))
        .otherwise(F.lit(TRADEOFF_NONE))
    )


def verdict(delta: Column | str, better: str = "LLM arm better", worse: str = "Original arm better",
            tied: str = "Roughly tied", band: float = 0.01) -> Column:
    delta = as_col(delta)
    return F.when(delta > band, F.lit(better)).when(delta < -band, F.lit(worse)).otherwise(F.lit(tied))


def upgrade_sheet(df: DataFrame, labels: Sequence[str] = LABEL_COLUMNS, name: str = "song_name") -> DataFrame:
    """Label sheet with exactly the current columns as '0'/'1'; rows without a name go, unknown columns go."""
    present = set(df.columns)
    cells = [
        F.when(parse_flag(c) != 0, F.lit("1")).otherwise(F.lit("0")).alias(c) if c in present else F.lit("0").alias(c)
        for c in labels
    ]
    return df.filter(blank_to_null(name).isNotNull()).select(strip(name).alias(name), *cells)


def review_rows(gold: DataFrame, labels: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    """Flat review table of merged gold rows: label cells as '0'/'1' and the tempo class, blank if unknown."""
    cells = [
        F.when(F.coalesce(F.try_element_at("human_multihot", F.lit(c)), F.lit(0)) != 0, F.lit("1")).otherwise(F.lit("0")).alias(c)
        for c in labels
    ]
    tempo = F.coalesce(strip(F.col("program_tempo.tempo_bin_bpm")), F.lit(""))
    return gold.select(F.coalesce(strip("song_name"), F.lit("")).alias("song_name"), *cells, tempo.alias("tempo_bin_bpm"))


# Marker texts of a job log; (marker, compare without case, texts).
LOG_MARKERS = (
    ("domain_tradeoff", True, ("domain tradeoff",)),
    ("public_download", False, ("public-dl Slurm job", "public_eval backend driver")),
    ("public_eval", True, ("public ood",)),
    ("skip_train", False, ("SKIP_TRAIN=1",)),
    ("skip_eval", False, ("SKIP_EVAL=1",)),
    ("error", False, ("ERROR:", "Traceback (most recent call last)")),
)


def classify_log(
    df: DataFrame, text: str = "value", fine_tune_runs: Sequence[str] = (), eval_modules: Sequence[str] = (), tail: int = 8
) -> DataFrame:
    """Phase and state of whole job logs, one log per row, the markers they hold (has_...), and their last non-blank lines.

    ``fine_tune_runs`` are run names whose mention marks a fine-tuning log, ``eval_modules`` module names whose
    mention marks an evaluation log.
    """
    body = F.col(text)
    lower = F.lower(body)

    def mentions(words: Sequence[str], column: Column = body) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(column, F.lit(word))
        return hit

    flags = {name: mentions(words, lower if fold else body) for name, fold, words in LOG_MARKERS}
    flags["fine_tune"] = mentions(fine_tune_runs)
    flags["domain_tradeoff"] = flags["domain_tradeoff"] | flags["fine_tune"]
    flags["public_eval"] = flags["public_eval"] | mentions(eval_modules)
    flags["done"] = F.contains(body, F.lit("\nDone.\n")) | F.endswith(F.rtrim(body, F.lit(" \t\r\n")), F.lit("Done."))
    marked = df.withColumns({f"has_{n}": c for n, c in flags.items()})
    phase = (
        F.when(F.col("has_domain_tradeoff"), F.lit("domain_tradeoff"))
        .when(F.col("has_public_eval"), F.lit("public_ood_eval"))
        .when(F.col("has_public_download"), F.lit("public_ood_download"))
        .when(F.col("has_skip_train") & F.col("has_done"), F.lit("skipped_train"))
        .otherwise(F.lit("unknown"))
    )
    state = (
        F.when(F.col("has_skip_train") & F.col("has_done") & ~F.col("has_fine_tune"), F.lit("skipped"))
        .when(F.col("has_error"), F.lit("failed"))
        .when(F.col("has_done"), F.lit("completed"))
        .otherwise(F.lit("running"))
    )
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t")) != "")
    last = F.slice(lines, F.greatest(F.size(lines) - tail + 1, F.lit(1)), tail)
    return marked.withColumns({"phase": phase, "state": state, "tail": last})
