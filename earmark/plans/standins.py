"""Relations the queries run on, derived from whole given tables, and the same relations as SQL.

Documents stand for catalogue items (source = album folder, lang = mood, n_chars / 10 = seconds), embeddings
for item vectors, label means for the vectors of prompts, and order lines for measurements of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions.keys import clip_name
from earmark.operators.classification import mean_vectors
from earmark.operators.sampling import plan_segments
from earmark.plans.registry import table


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata rows: doc_id, audio, text, mood, confidence, source, n_chars."""
    d = table(spark, folder, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("data/music_db/"), "source", F.lit("/doc"), "doc_id", F.lit(".mp3")).alias("audio"), "text",
        F.col("lang").alias("mood"), F.round((F.col("n_chars") % 101) / 100.0, 2).alias("confidence"), "source", "n_chars",
    )


CATALOGUE = """catalogue AS (
  SELECT doc_id, 'data/music_db/' || source || '/doc' || doc_id || '.mp3' AS audio, text, lang AS mood,
         round((n_chars % 101) / 100.0, 2) AS confidence, source, n_chars
  FROM documents)"""


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen-second clips of all catalogue items."""
    songs = catalogue(spark, folder).select(
        "doc_id", F.col("audio").alias("source_path"), (F.col("n_chars") / 10.0).alias("length_sec"))
    planned = plan_segments(songs, "length_sec")
    relative = F.regexp_replace("source_path", "^data/music_db/", "")
    return planned.withColumn("segment_path", F.concat(F.lit("data/music_db_15s/"), clip_name(relative, "segment_index")))


CLIPS = CATALOGUE + """, clips AS (
  SELECT doc_id, audio AS source_path, i AS segment_index,
         'data/music_db_15s/' || source || '__doc' || doc_id || '__seg' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INTEGER), '0')
           || '.mp3' AS segment_path,
         round(i * 15.0::DOUBLE, 3) AS start_sec, round(least((i + 1) * 15.0::DOUBLE, n_chars / 10.0), 3) AS end_sec,
         round(least((i + 1) * 15.0::DOUBLE, n_chars / 10.0) - i * 15.0::DOUBLE, 3) AS duration_sec
  FROM (SELECT *, unnest(range(0, CAST(floor(n_chars / 150.0) AS BIGINT)
               + CASE WHEN n_chars / 10.0 - floor(n_chars / 150.0) * 15.0 >= 5.0 THEN 1 ELSE 0 END)) AS i FROM catalogue))"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec"), "label")


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label; its vector is the mean of the label's items, as a prompt would stand for them."""
    means = mean_vectors(items(spark, folder), "label", "item_vec", "query_vec")
    return means.select(F.concat(F.lit("label_"), "label").alias("query_id"), "label", "query_vec")


CENTROIDS = """positions AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v
  FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
centroids AS (
  SELECT label, 'label_' || label AS query_id, list(v ORDER BY i) AS query_vec FROM positions GROUP BY label)"""

RANKED = CENTROIDS + """, scored AS (
  SELECT c.query_id, c.label AS query_label, e.vec_id AS item_id, e.label,
         round(list_cosine_similarity(c.query_vec, CAST(e.embedding AS DOUBLE[])), 9) AS score
  FROM centroids c CROSS JOIN embeddings e),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored)"""


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A metric matrix (dataset, arm, seed, query_id, top_k, ...) measured over all order lines."""
    line = table(spark, folder, "lineitem")
    arm = F.when(F.col("l_linenumber") <= 2, "pretrained").when(F.col("l_linenumber") <= 4, "home").otherwise("mixed")
    tag = F.when(F.col("l_tax") < 0.03, "inst_piano").when(F.col("l_tax") < 0.06, "inst_vocal").otherwise("mood_relaxing")
    rows = line.select(
        F.col("l_returnflag").alias("dataset"), arm.alias("arm"), (F.col("l_suppkey") % 3 + 42).cast("int").alias("seed"),
        tag.alias("query_id"), "l_discount", "l_quantity", "l_extendedprice")
    return rows.groupBy("dataset", "arm", "seed", "query_id").agg(
        F.count_if(F.col("l_discount") >= 0.05).alias("n_positive"), F.count(F.lit(1)).alias("n_pool"),
        F.avg(F.col("l_discount") * 10).alias("precision_at_k"), (F.avg(F.col("l_quantity") / 50) - 0.5).alias("ndcg_delta"),
    ).withColumn("top_k", F.lit(10))


METRICS = """metrics AS (
  SELECT l_returnflag AS dataset,
         CASE WHEN l_linenumber <= 2 THEN 'pretrained' WHEN l_linenumber <= 4 THEN 'home' ELSE 'mixed' END AS arm,
         CAST(l_suppkey % 3 + 42 AS INTEGER) AS seed,
         CASE WHEN l_tax < 0.03 THEN 'inst_piano' WHEN l_tax < 0.06 THEN 'inst_vocal' ELSE 'mood_relaxing' END AS query_id,
         count(*) FILTER (WHERE l_discount >= 0.05) AS n_positive, count(*) AS n_pool,
         avg(l_discount * 10) AS precision_at_k, avg(l_quantity / 50) - 0.5 AS ndcg_delta, 10 AS top_k
  FROM lineitem GROUP BY ALL)"""


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    """One run per user: events in time order are epochs, their values the validation metric."""
    e = table(spark, folder, "events")
    return e.select(
        F.concat(F.lit("run"), "user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_similarity"),
        F.when(F.col("event_type") != "error", F.col("value") / 2).alias("checkpoint_metric"),
        F.when(F.col("event_type") == "view", F.col("value") / 4).alias("train_similarity"), "event_type", "user_id")


TRAINING_LOG = """training_log AS (
  SELECT 'run' || user_id AS run, event_id AS epoch, value AS val_similarity,
         CASE WHEN event_type <> 'error' THEN value / 2 END AS checkpoint_metric,
         CASE WHEN event_type = 'view' THEN value / 4 END AS train_similarity, event_type, user_id
  FROM events)"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue with the labels of those items that have any (null otherwise)."""
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return catalogue(spark, folder).join(labels, "doc_id", "left")
