"""Votes, mean vectors, zero-shot labels and classification metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.operators.ordering import with_position
from earmark.operators.search import score_matrix, vector_matrix


def mean_vectors(df: DataFrame, group: str, vector: str, out: str = "mean_vec") -> DataFrame:
    """Mean vector per group. Vectors are summed on the map side, without exploding them."""
    sums = df.filter(F.col(vector).isNotNull()).groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_m"))
    return sums.select(group, vector_to_array("_m").alias(out))


def majority_vote(df: DataFrame, group: str, label: str, value: str | None = None) -> DataFrame:
    """Per group the most frequent label, or null on a tie; with ``value`` also its mean over the group.

    A tie shows as two different winners when the labels are compared upwards and downwards.
    """
    extra = [F.sum(value).alias("_s"), F.count(value).alias("_c")] if value else []
    counts = df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"), *extra)
    high, low = F.max(F.struct("_n", label))[label], F.min(F.struct(-F.col("_n"), F.col(label).alias(label)))[label]
    votes = counts.groupBy(group).agg(
        high.alias("_high"), low.alias("_low"), F.sum("_n").alias("n_votes"),
        *([(F.sum("_s") / F.sum("_c")).alias("mean_value")] if value else []))
    return votes.withColumn("majority", F.when(F.col("_high") == F.col("_low"), F.col("_high"))).drop("_high", "_low")


def argmax_label(scores: Column, labels: Sequence[str]) -> Column:
    """Label of the largest entry of a score array, the first on a tie."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))


def confusion_counts(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """(truth, predicted, n) for the full label grid."""
    spark = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"truth {kind}, predicted {kind}")
    counts = df.filter(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)).groupBy(
        F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """One row per label: precision, recall, F1 and support, with accuracy and macro F1; empty ratios are 0."""
    sides = confusion.select(
        "n", (F.col("truth") == F.col("predicted")).alias("_same"),
        F.explode(F.array(
            F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_truth")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_truth")))).alias("_s"))
    per_label = sides.groupBy(F.col("_s.label").alias("label")).agg(
        F.sum(F.when(F.col("_same") & (F.col("_s.is_truth") == 1), F.col("n")).otherwise(F.lit(0))).alias("tp"),
        F.sum(F.when(F.col("_s.is_truth") == 1, F.col("n")).otherwise(F.lit(0))).alias("support"),
        F.sum(F.when(F.col("_s.is_truth") == 0, F.col("n")).otherwise(F.lit(0))).alias("predicted"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows = per_label.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    everything = Window.partitionBy()  # one row per label
    return rows.select(
        "label", "precision", "recall", "f1", "support",
        ratio(F.sum("tp").over(everything), F.sum("support").over(everything)).alias("accuracy"),
        F.avg("f1").over(everything).alias("macro_f1"))


def zero_shot(
    items: DataFrame, prompts: Sequence[Sequence[float]], labels: Sequence[str], vector: str, out: str = "pred"
) -> DataFrame:
    """Label of the most similar prompt, the margin between the best two, and all scores.

    The prompt vectors are a fixed handful; items are scored in batches with one matrix product each.
    """
    matrix = np.asarray(prompts, dtype=np.float64)
    names = np.array(list(labels), dtype=object)
    schema = T.StructType([
        *df_fields(items), T.StructField(out, T.StringType()), T.StructField("margin", T.DoubleType()),
        T.StructField("scores", T.ArrayType(T.DoubleType()))])
    position = items.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores = score_matrix(matrix, vector_matrix(batch.column(position)), "cosine").T
            best = scores.argmax(axis=1)
            ordered = np.sort(scores, axis=1)[:, ::-1]
            margin = ordered[:, 0] - ordered[:, 1] if scores.shape[1] > 1 else np.zeros(len(scores))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(margin), pa.array(list(scores), pa.list_(pa.float64()))],
                names=[*batch.schema.names, out, "margin", "scores"])

    return items.mapInArrow(run, schema)


#: Bytes of the label vectors, or of the item vectors, that a task scores at a time.
BLOCK_BYTES = 16 << 20


def zero_shot_table(
    items: DataFrame, prompts: DataFrame, key: str, vector: str, label: str = "label", label_vec: str = "label_vec", block_bytes: int | None = None
) -> DataFrame:
    """(key, pred, margin): label of the most similar prompt, ties to the smaller label, and its lead over the second; any number of labels.

    A label table within ``block_bytes`` goes to all tasks. A larger one is cut into blocks that meet splits of the items; each block gives an
    item's best two labels there, and the best two of all are merged by item.
    """
    most = block_bytes or BLOCK_BYTES
    prompts = prompts.select(F.col(label).cast("string").alias("label"), F.col(label_vec).cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    size = prompts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    rows = items.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull())
    if size["n"] * (size["width"] or 1) * 8 <= most:
        known = prompts.orderBy("label").collect()
        if not known:
            return rows.select(F.col("id").alias(key), F.lit(None).cast("string").alias("pred"), F.lit(None).cast("double").alias("margin"))
        return zero_shot(rows, [r["vec"] for r in known], [r["label"] for r in known], "vec").select(F.col("id").alias(key), "pred", "margin")
    per_block = max(1, most // (8 * size["width"]))
    blocks = -(-size["n"] // per_block)
    placed = with_position(prompts, [], ["label"], "place").withColumn("block", F.floor((F.col("place") - 1) / per_block).cast("int"))
    splits = max(1, -(-rows.count() * size["width"] * 8 // most))
    offered = placed.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    asked = rows.withColumns({"split": F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"id {id_type}, best array<struct<score: double, place: bigint, label: string>>"

    def best_two(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("place", pa.int64()), ("label", pa.string())]))
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table([left["id"].slice(0, 0), pa.array([], kind)], names=["id", "best"])
        right = right.sort_by("place")
        names, places = right["label"].to_pylist(), right["place"].to_pylist()
        scores = score_matrix(vector_matrix(right["vec"]), vector_matrix(left["vec"]), "cosine").T
        first = np.argsort(-scores, axis=1, kind="stable")[:, :2]
        best = [[{"score": -float(row[j]), "place": places[j], "label": names[j]} for j in own] for row, own in zip(scores, first)]
        return pa.table([left["id"], pa.array(best, kind)], names=["id", "best"])

    met = asked.groupBy("block", "split").cogroup(offered.groupBy("block", "split")).applyInArrow(best_two, out)
    # At most two for each block; scores are negative, so that the smallest is best.
    merged = met.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    margin = F.when(F.size("best") > 1, F.col("best")[1]["score"] - F.col("best")[0]["score"]).otherwise(F.lit(0.0))
    return merged.select(F.col("id").alias(key), F.col("best")[0]["label"].alias("pred"), margin.alias("margin"))


def df_fields(df: DataFrame) -> list[T.StructField]:
    return list(df.schema.fields)
