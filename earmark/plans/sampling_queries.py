"""Samples, splits, mining and representative rows over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions.values import mix_target, public_label_map
from earmark.functions.vectors import cosine
from earmark.operators import merging, sampling
from earmark.operators.ordering import first_per_group, hash_position, smallest, with_position
from earmark.plans import standins as s
from earmark.plans.registry import query, table


def _hash(seed: int, key: str) -> str:
    return f"md5('{seed}:' || {key})"


@query("M3", "T3", sql=f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY {_hash(42, 'o_orderkey')}, o_orderkey LIMIT 2500""")
def exact_seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Uniform sample of exactly n rows."""
    return sampling.sample_exactly(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 2500)


@query("U1", sql=f"""
SELECT doc_id, row_number() OVER (ORDER BY {_hash(43, 'doc_id')}, doc_id) AS shuffled_position FROM documents""")
def seeded_order(spark: SparkSession, folder: str) -> DataFrame:
    """Position of every row in the seeded shuffle."""
    return hash_position(table(spark, folder, "documents").select("doc_id"), "doc_id", 43, "shuffled_position")


@query("M2", "P4", sql=f"""
WITH tagged AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b FROM labels),
pick AS (
  SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_hash(42, 'doc_id')}) AS rn FROM tagged WHERE a) WHERE rn <= 60
  UNION SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_hash(42, 'doc_id')}) AS rn FROM tagged WHERE b) WHERE rn <= 60)
SELECT doc_id, quality AS gold_pub_piano, toxic AS gold_pub_vocal FROM labels WHERE doc_id IN (SELECT doc_id FROM pick)""")
def per_tag_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most 60 rows drawn per tag; a row drawn for one tag shows all its labels."""
    rows = table(spark, folder, "labels")
    capped = sampling.cap_per_tag(rows, "doc_id", {"piano": F.col("quality") == 1, "vocal": F.col("toxic") == 1}, cap=60)
    return capped.select("doc_id", F.col("quality").alias("gold_pub_piano"), F.col("toxic").alias("gold_pub_vocal"))


@query("M2", sql=f"""
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {_hash(42, 'event_id')}, event_id) AS rn FROM events) WHERE rn <= 5""")
def per_group_cap(spark: SparkSession, folder: str) -> DataFrame:
    """A cap per group for any number of groups, ranked in salted parts first."""
    from earmark.functions.keys import seeded_hash

    e = table(spark, folder, "events").select("user_id", "event_id").withColumn("_h", seeded_hash(42, "event_id"))
    return first_per_group(e, ["user_id"], ["_h", "event_id"], 5, ["event_id"]).drop("_h")


_BUCKETS = """pool AS (
  SELECT d.doc_id, md5('42:' || d.source || '/' || d.doc_id) AS h, coalesce(quality, 0) = 1 AS a, coalesce(toxic, 0) = 1 AS b, lang = 'fr' AS c
  FROM documents d LEFT JOIN labels USING (doc_id)),
goal AS (SELECT CAST(floor(count(*) * 0.25 / 0.75) AS BIGINT) AS target, greatest(1, CAST(floor(count(*) * 0.25 / 0.75) AS BIGINT) // 4) AS quota FROM pool),
r1 AS (SELECT doc_id FROM pool, goal WHERE a QUALIFY row_number() OVER (ORDER BY h) <= quota),
r2 AS (SELECT doc_id FROM pool, goal WHERE b AND doc_id NOT IN (FROM r1) QUALIFY row_number() OVER (ORDER BY h) <= quota),
r3 AS (SELECT doc_id FROM pool, goal WHERE c AND doc_id NOT IN (FROM r1) AND doc_id NOT IN (FROM r2) QUALIFY row_number() OVER (ORDER BY h) <= quota),
r4 AS (SELECT doc_id FROM pool, goal WHERE NOT a AND NOT b AND NOT c QUALIFY row_number() OVER (ORDER BY h) <= quota),
taken AS (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3 UNION ALL FROM r4),
fill AS (SELECT doc_id FROM pool, goal WHERE doc_id NOT IN (FROM taken) QUALIFY row_number() OVER (ORDER BY h) <= target - (SELECT count(*) FROM taken)),
sample AS (FROM taken UNION ALL FROM fill)"""


def _public_pool(spark: SparkSession, folder: str) -> DataFrame:
    rows = s.labelled(spark, folder)
    return rows.select(
        F.concat_ws("/", "source", "doc_id").alias("audio_path"), "doc_id", F.col("quality").alias("gold_pub_piano"),
        F.col("toxic").alias("gold_pub_vocal"), (F.col("mood") == "fr").cast("int").alias("gold_pub_relaxing"))


@query("M1", "F21", "F15", sql="WITH " + _BUCKETS + " SELECT doc_id FROM sample")
def stratified_public_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Equal quotas per tag, tags served in turn, then filled up to the target of the mixing rule."""
    pool = _public_pool(spark, folder)
    target = pool.agg(mix_target(F.count(F.lit(1)), F.count(F.lit(1)), mix_ratio=0.25).alias("t")).first()["t"]
    return sampling.stratified_sample(pool, "audio_path", target, public_label_map()).select("doc_id")


@query("U1", "J7", "M1", "A7", sql="WITH " + _BUCKETS + """
SELECT domain, count(*) AS n, count(gold_pub_piano) AS n_with_label FROM (
  SELECT 'home' AS domain, NULL AS gold_pub_piano FROM part
  UNION ALL SELECT 'public', quality FROM sample JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def mixed_domain_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """In-domain rows and sampled public rows with their own columns, in seeded order, counted per domain."""
    pool = _public_pool(spark, folder)
    target = pool.agg(mix_target(F.count(F.lit(1)), F.count(F.lit(1)), mix_ratio=0.25).alias("t")).first()["t"]
    public = sampling.stratified_sample(pool, "audio_path", target, public_label_map()).drop("doc_id")
    home = table(spark, folder, "part").select(F.concat(F.lit("home/"), "p_partkey").alias("audio_path"), F.col("p_name").alias("text"))
    mixed = sampling.seeded_shuffle(merging.mix_domains({"home": home, "public": public}), "audio_path", 43)
    return mixed.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count("gold_pub_piano").alias("n_with_label"))


@query("W3", sql="WITH " + s.CLIPS + f""",
g AS (SELECT source_path, {_hash(42, 'source_path')} AS h, count(*) AS n FROM clips GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT source_path, n AS n_clips, before < greatest(1, (SELECT round_even(count(*) * 0.1::DOUBLE, 0) FROM clips)) AS is_val FROM r""")
def group_train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    """Whole songs go to validation until a tenth of all clips is reached."""
    flagged = sampling.group_split(s.clips(spark, folder), "source_path", ratio=0.1)
    return flagged.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_clips"), F.max("is_val").alias("is_val"))


@query("W2", "V2", "A19", sql="WITH " + s.CENTROIDS + """, sims AS (
  SELECT e.vec_id, round(list_cosine_similarity(c.query_vec, CAST(e.embedding AS DOUBLE[])), 9) AS sim FROM embeddings e JOIN centroids c USING (label)),
n AS (SELECT *, row_number() OVER (ORDER BY sim, vec_id) AS rk, count(*) OVER () AS n, avg(sim) OVER () AS mean_all FROM sims)
SELECT vec_id, sim, round(1 - sim, 9) AS error_score, round(rk / n, 8) AS rank_pct, round(mean_all, 8) AS mean_sim_all, round(avg(sim) OVER (), 8) AS mean_sim_hard
FROM n WHERE rk <= greatest(1, ceil(n * 0.2))""")
def hard_pair_mining(spark: SparkSession, folder: str) -> DataFrame:
    """Least similar fifth of all pairs of an item and its prompt vector."""
    pairs = s.items(spark, folder).join(s.label_queries(spark, folder).select("label", "query_vec"), "label")
    sims = pairs.select(F.col("item_id").alias("vec_id"), F.round(cosine("item_vec", "query_vec"), 9).alias("sim"))
    hard = sampling.mine_hard(sims, "sim", "vec_id", 0.2)
    return hard.select(
        "vec_id", "sim", F.round("error_score", 9).alias("error_score"), F.round("rank_pct", 8).alias("rank_pct"),
        F.round("mean_sim_all", 8).alias("mean_sim_all"), F.round("mean_sim_hard", 8).alias("mean_sim_hard"))


@query("W2", sql="""
SELECT l_orderkey, l_linenumber, rk AS rank_no FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rk,
         count(*) OVER () AS n FROM lineitem) WHERE rk <= ceil(n * 0.05)""")
def bottom_share_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Exact ranks of the lowest twentieth of all order lines, ranked in range partitions."""
    line = table(spark, folder, "lineitem")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    ranked = with_position(line.select(*order), [], order, "rank_no", size="n")
    return ranked.filter(F.col("rank_no") <= F.ceil(F.col("n") * 0.05)).select("l_orderkey", "l_linenumber", "rank_no")


@query("W4", sql="WITH " + s.CLIPS + """, p AS (
  SELECT source_path, segment_path, segment_index, row_number() OVER (PARTITION BY source_path ORDER BY segment_index) - 1 AS position,
         count(*) OVER (PARTITION BY source_path) AS n FROM clips)
SELECT source_path, n AS num_segments, string_agg(segment_path, ';' ORDER BY position) AS eval_audio_paths,
       string_agg(CAST(segment_index AS VARCHAR), ';' ORDER BY position) AS eval_segment_index
FROM p WHERE position IN (0, (n - 1) // 2, n - 1) GROUP BY 1, 2""")
def representative_clips(spark: SparkSession, folder: str) -> DataFrame:
    """First, middle and last clip of every song."""
    rows = sampling.representative_rows(s.clips(spark, folder).select("source_path", "segment_path", "segment_index"), "source_path", ["segment_index"])
    chosen = rows.groupBy("source_path", "num_segments").agg(F.array_sort(F.collect_list(F.struct("position", "segment_path", "segment_index"))).alias("c"))
    return chosen.select(
        "source_path", "num_segments", F.array_join(F.transform("c", lambda x: x["segment_path"]), ";").alias("eval_audio_paths"),
        F.array_join(F.transform("c", lambda x: x["segment_index"].cast("string")), ";").alias("eval_segment_index"))


@query("W4", sql="""
SELECT user_id, event_id, position, n AS num_segments FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE position IN (0, (n - 1) // 2, n - 1)""")
def representative_events(spark: SparkSession, folder: str) -> DataFrame:
    """First, middle and last event of every user, in time order."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return sampling.representative_rows(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "position", "num_segments")


@query("T3", "T4", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""")
def ordered_report_sample(spark: SparkSession, folder: str) -> DataFrame:
    """First rows of a report in an explicit order (the cap is the feature)."""
    return smallest(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 30)
