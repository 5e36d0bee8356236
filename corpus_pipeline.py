"""A training corpus from raw documents: language, near copies, benchmark leaks, mix, packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs. All
but the last return the columns of documents, and any others that docs has, whatever their names. Null, empty, very long and
repeated rows follow the rules of the operators, ties too: the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm import decontaminate, langid, minhash, mixing, packing
from earmark.llm.common import fresh, pin, remainder

#: Texts whose best language has less than this share of the evidence are in no language that was learned.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters, and those in none of the languages that the labelled three quarters of rows teach."""
    model = langid.fit(docs.filter(remainder(F.col("doc_id"), 4) != 2), "text", "lang")
    name = fresh(docs.columns, "_language")
    told = langid.identify(docs, model, out=name)
    return told.filter((F.col(f"{name}.lang") != langid.UNDETERMINED) & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles with a similarity of 0.8 or more), the row with the smallest doc_id stays; of several such rows, and without any id, one."""
    members = pin(minhash.near_copies(docs), "members")
    wins = F.col("id").eqNullSafe(F.col("component_id"))
    ids = pin(members.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(wins).alias("wins")), "ids")
    repeated = ids.filter("n > 1").select("id")
    gone = pin(ids.filter("n > 1 or not wins").select("id"), "gone")
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")
    if repeated.isEmpty():
        return kept
    # Several rows with one id: only their texts tell which group a row is in.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_tag"))
    groups = members.filter(wins).join(repeated.withColumnRenamed("id", "again"), F.col("id").eqNullSafe(F.col("again")), "left_semi").select("id", "tag", "root").distinct()
    found = rows.join(groups, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag")))
    one = found.groupBy("root").agg(F.min_by("row", F.struct("own_tag", F.to_json("row"))).alias("row"))
    return kept.unionByName(one.select("row.*"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a benchmark item."""
    leaks = pin(decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("id").distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["id"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt to shards and shuffled there."""
    return mixing.mixed(docs).drop(fresh(docs.columns, "_shard"), fresh(docs.columns, "_order"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mix", mix), ("token_ids", token_ids)]

#: Fingerprints, learned models and token ids can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
