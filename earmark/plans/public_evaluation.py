"""Evaluation of prompts on several public data sets, each with the tags that it has labels for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.constants import PUBLIC_TAGS
from earmark.operators.evaluation import label_positives, metric_matrix
from earmark.operators.search import top_k

Encode = Callable[[DataFrame, str, str], DataFrame]
BRIDGE = "dataset STRING, query_id STRING, label STRING, query_text STRING"


def tag_bridge(spark: SparkSession) -> DataFrame:
    """(dataset, query_id, label, query_text): a data set without labels for a tag has no row for it."""
    return spark.createDataFrame([(d, *tag) for d, tags in PUBLIC_TAGS.items() for tag in tags], BRIDGE)


def public_matrix(pools: DataFrame, bridge: DataFrame, encode: Encode, ks: Sequence[int] = (10,)) -> DataFrame:
    """Metric rows for each data set and each of its tags: a tag's prompt ranks the items of that data set alone.

    ``pools`` has dataset, item_id, item_vec and the label columns, and should be a stored table. A prompt is encoded once, however many
    data sets use it. The bridge has one row a data set and tag.
    """
    pairs = bridge.collect()
    prompts = encode(bridge.select("query_id", "query_text").distinct(), "query_text", "query_vec")
    parts = []
    for dataset in sorted({p["dataset"] for p in pairs}):
        own = [p for p in pairs if p["dataset"] == dataset]
        pool = pools.filter(F.col("dataset") == dataset)
        ids = [p["query_id"] for p in own]
        asked = prompts.filter(F.col("query_id").isin(ids))
        labels = label_positives(pool, "item_id", sorted({p["label"] for p in own})).withColumnRenamed("query_id", "label")
        named = bridge.filter(F.col("dataset") == dataset).select("query_id", "label")
        positives = labels.join(F.broadcast(named), "label").select("query_id", "item_id")
        matrix = metric_matrix(asked.select("query_id"), top_k(asked, pool, max(ks)), positives, pool.select("item_id"), ks)
        parts.append(matrix.withColumn("dataset", F.lit(dataset)))
    return reduce(DataFrame.unionByName, parts).join(bridge, ["dataset", "query_id"])


def macro_rows(matrix: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over the data sets that have the tag."""
    return matrix.groupBy("query_id", "top_k").agg(F.count(F.lit(1)).alias("n_datasets"), *[F.avg(m).alias(m) for m in metrics])
