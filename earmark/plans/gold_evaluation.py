"""Evaluation of a text index against gold labels, from nested gold rows to the metric matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.constants import LABEL_COLUMNS, TEMPO_LABELS, TEMPO_QUERY_TEXTS
from earmark.functions.keys import basename, blank_to_null
from earmark.functions.text import strip_music_suffix
from earmark.operators.classification import class_metrics, confusion_counts
from earmark.operators.evaluation import metric_matrix
from earmark.operators.search import top_k
from earmark.session import pin

Encode = Callable[[DataFrame, str, str], DataFrame]


def gold_by_basename(gold: DataFrame, labels: Sequence[str] = LABEL_COLUMNS, order: str = "_ord") -> DataFrame:
    """One row per file name: 0/1 label columns of the last gold row, the last known tempo class, and the last pair of true and
    predicted class (pair_tempo, pair_predicted) of which both are known. Rows of equal order: the larger values win.
    """
    rows = gold.filter(blank_to_null("source_path").isNotNull() & F.col("human_multihot").isNotNull()).select(
        basename("source_path").alias("basename"),
        *[(F.coalesce(F.try_element_at("human_multihot", F.lit(c)), F.lit(0)) != 0).cast("int").alias(c) for c in labels],
        F.col("program_tempo.tempo_bin_bpm").alias("tempo"), F.col("program_tempo.tempo_clap_zeroshot").alias("predicted"), order)
    known = F.col("tempo").isin(*TEMPO_LABELS)
    last = rows.groupBy("basename").agg(
        F.max(F.struct(order, *labels)).alias("row"),
        F.max(F.when(known, F.struct(order, "tempo"))).alias("known"),
        F.max(F.when(known & F.col("predicted").isin(*TEMPO_LABELS), F.struct(order, "tempo", "predicted"))).alias("pair"))
    return last.select(
        "basename", *[F.col("row")[c].alias(c) for c in labels], F.col("known.tempo").alias("tempo"),
        F.col("pair.tempo").alias("pair_tempo"), F.col("pair.predicted").alias("pair_predicted"))


def gold_pool(index: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """Index rows (item_id, audio, item_vec) whose file name is labelled, with the labels."""
    return index.filter(blank_to_null("audio").isNotNull()).withColumn("basename", basename("audio")).join(gold_rows, "basename")


def pool_positives(pool: DataFrame, labels: Sequence[str] = LABEL_COLUMNS, tempo: Sequence[str] = TEMPO_LABELS) -> DataFrame:
    """(query_id, item_id) of every label and tempo class a pool row has: one pass, a short array per row."""
    hits = [F.when(F.col(c) == 1, F.lit(c)) for c in labels] + [F.when(F.col("tempo") == t, F.lit(f"tempo_{t}")) for t in tempo]
    return pool.select("item_id", F.explode(F.array_compact(F.array(*hits))).alias("query_id"))


def prompt_table(queries: DataFrame, labels: Sequence[str] = LABEL_COLUMNS, with_tempo: bool = True) -> DataFrame:
    """Queries that name a label column, and on request one phrase per tempo class: query_id, query_text."""
    style = queries.filter(F.col("query_id").isin(*labels)).select("query_id", strip_music_suffix("query_text").alias("query_text"))
    if not with_tempo:
        return style
    phrases = [(f"tempo_{t}", phrase) for t, phrase in zip(TEMPO_LABELS, TEMPO_QUERY_TEXTS, strict=True)]
    tempo = queries.sparkSession.createDataFrame(phrases, "query_id STRING, query_text STRING")
    return style.unionByName(tempo.withColumn("query_text", strip_music_suffix("query_text")))


def gold_matrix(index: DataFrame, gold: DataFrame, queries: DataFrame, encode: Encode, ks: Sequence[int] = (10,), labels: Sequence[str] = LABEL_COLUMNS,
                with_tempo_queries: bool = True, with_tempo_metrics: bool = False, order: str = "_ord") -> DataFrame:
    """Metric matrix of all label (and tempo) queries over the labelled part of an index.

    The labelled part of the index is joined once and stored; scan, counts, hits and songs read the columns they need of it.
    With tempo metrics every row also carries accuracy and macro F1 of the predicted tempo over the pool, null without any such song.
    """
    gold_rows = gold_by_basename(gold, labels, order)
    pool = pin(gold_pool(index, gold_rows), "gold_pool")
    prompts = prompt_table(queries, labels, with_tempo_queries)
    ranked = top_k(encode(prompts, "query_text", "query_vec"), pool, max(ks))
    matrix = metric_matrix(prompts, ranked, pool_positives(pool, labels), pool, ks)
    if not with_tempo_metrics:
        return matrix
    songs = pool.select("basename", "pair_tempo", "pair_predicted").dropDuplicates(["basename"])
    confusion = confusion_counts(songs, "pair_tempo", "pair_predicted", TEMPO_LABELS)
    overall = class_metrics(confusion).agg(F.struct(
        F.when(F.sum("support") > 0, F.max("accuracy")).alias("accuracy"), F.when(F.sum("support") > 0, F.max("macro_f1")).alias("macro_f1"),
        F.sum("support").alias("n"))).scalar()
    return matrix.withColumns({
        "tempo_accuracy": overall["accuracy"], "tempo_macro_f1": overall["macro_f1"], "tempo_n_songs": overall["n"]})
