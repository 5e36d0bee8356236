"""Encoders, refiners, caches and incremental runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions import text
from earmark.functions.encoders import encode_column, hash_encoder
from earmark.functions.vectors import norm
from earmark.operators import refining, search
from earmark.operators.merging import propagate_captions
from earmark.plans import standins as s
from earmark.plans.registry import query, table
from earmark.session import scratch_path
from earmark.sources import jsonl, stores
from earmark.streaming import incremental

_VEC = ("list_transform(range(0, 8), lambda i: CAST(CAST(CAST(('0x' || substr(md5({0}), 2 * i + 1, 2)) AS INTEGER) / 255.0::DOUBLE - 0.5 AS FLOAT) AS DOUBLE))")


def _encode(df: DataFrame, column: str, vector: str) -> DataFrame:
    return encode_column(df, column, vector, hash_encoder())


@query("X1", sql=f"""
SELECT doc_id, round(v[1], 6) AS first, round(v[8], 6) AS last, round(list_sum(v), 6) AS total FROM (SELECT doc_id, {_VEC.format('text')} AS v FROM documents)""")
def batch_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts through a batch encoder."""
    rows = _encode(table(spark, folder, "documents").select("doc_id", "text"), "text", "v")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("doc_id", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.col("v")[7].cast("double"), 6).alias("last"), F.round(total, 6).alias("total"))


_REFINED = f"""hard AS (SELECT doc_id, text, length(text) >= 200 AS answered, {_VEC.format('text')} AS a, {_VEC.format("text || ' refined'")} AS b,
   {_VEC.format("CAST(doc_id AS VARCHAR)")} AS item FROM documents),
gated AS (SELECT doc_id, answered, list_cosine_similarity(item, b) - list_cosine_similarity(item, a) AS gain, list_cosine_similarity(a, b) AS drift FROM hard)"""


def _refiner():
    """Answers with a marked text; drops texts of fewer than 200 characters."""
    return lambda texts: (texts + " refined").where(texts.str.len() >= 200, None)


def _gated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("text_orig"), F.col("doc_id").cast("string").alias("key"))
    items = _encode(rows, "key", "item_vec")
    answered = refining.refine_rows(items, "text_orig", _refiner)
    return refining.gate_refined(answered, "item_vec", hash_encoder(), min_sim_gain=0.05, min_text_cos=-0.1)


@query("X2", "P7", sql="WITH " + _REFINED + """
SELECT doc_id, CASE WHEN NOT gain > 0.05 THEN 'sim' WHEN NOT drift >= -0.1 THEN 'drift' ELSE 'accepted' END AS outcome FROM gated WHERE answered""")
def refined_row_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document refined, and accepted or rejected by the gate."""
    gated = _gated(spark, folder).filter(F.col("text_new").isNotNull())
    return gated.select("doc_id", F.coalesce("gate.reject_reason", F.lit("accepted")).alias("outcome"))


@query("X2", "A7", sql="WITH " + _REFINED + """
SELECT count(*) AS n_in, count(*) FILTER (WHERE answered AND gain > 0.05 AND drift >= -0.1) AS n_accepted, count(*) FILTER (WHERE answered AND NOT gain > 0.05) AS n_rejected_sim,
       count(*) FILTER (WHERE answered AND gain > 0.05 AND NOT drift >= -0.1) AS n_rejected_drift, count(*) FILTER (WHERE NOT answered) AS n_dropped FROM gated""")
def refinement_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of a refinement pass."""
    return refining.gate_counts(_gated(spark, folder))


@query("X3", "J6", "J10", "A1", sql="WITH " + s.CLIPS + """
SELECT segment_path, CASE WHEN quality = 1 THEN 'earlier caption' WHEN length(text) >= 200 THEN 'new caption' ELSE 'old' END AS text,
       CASE WHEN quality = 1 OR length(text) >= 200 THEN 'llm_full_corpus' ELSE 'original' END AS text_source
FROM clips JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def song_caption_run(spark: SparkSession, folder: str) -> DataFrame:
    """One refiner call per song without a caption, appended to the ledger and carried to all clips of the song."""
    path = scratch_path(spark, "captions")
    schema = "source_path STRING, text STRING, text_orig STRING, text_source STRING"
    songs = s.labelled(spark, folder)
    earlier = songs.filter(F.col("quality") == 1).select(
        F.col("audio").alias("source_path"), F.lit("earlier caption").alias("text"), F.lit(None).cast("string").alias("text_orig"), F.lit("llm_full_corpus").alias("text_source"))
    jsonl.append_ledger(earlier, path)
    clips = s.clips(spark, folder).select("source_path", "segment_index", "segment_path")
    texts = songs.select(F.col("audio").alias("source_path"), "text")

    def caption():
        return lambda prompts: prompts.where(prompts.str.len() < 0, "new caption").where(prompts.str.len() >= 200, None)

    # a song's own text is the prompt here, so that the oracle can tell which songs the refiner drops
    new = refining.refine_songs(clips, jsonl.read_jsonl(spark, path, schema), F.col("text"), caption, root="/lib", order="segment_index", texts=texts)
    jsonl.append_ledger(new, path)
    ledger = jsonl.read_jsonl(spark, path, schema).withColumn("_ord", F.lit(0))
    return propagate_captions(clips.withColumn("text", F.lit("old")), ledger, root="/lib").select("segment_path", "text", "text_source")


@query("S18", "J14", "X4", "F4", sql="""
SELECT k.source || '/' || k.doc_id || '.mp3' AS cache_key, CASE WHEN l.doc_id IS NULL THEN 'computed' ELSE 'cached' END AS origin,
       (SELECT count(*) FROM documents) AS n_total, (SELECT count(*) FROM labels) AS n_present_before
FROM documents k LEFT JOIN labels l USING (doc_id)""")
def feature_cache_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Missing features are computed and appended; then every key of the manifest is found."""
    from earmark.functions.keys import cache_key

    path = scratch_path(spark, "features")
    d = table(spark, folder, "documents")
    rows = d.select("doc_id", F.concat(F.lit("data/music_db_15s/"), "source", F.lit("/"), "doc_id", F.lit(".mp3")).alias("audio_path"))
    manifest = rows.withColumn("cache_key", cache_key("audio_path"))
    manifest = manifest.unionByName(manifest).dropDuplicates(["cache_key"])
    have = manifest.join(table(spark, folder, "labels").select("doc_id"), "doc_id")
    stores.append_features(have.select("cache_key", F.array(F.lit(1.0), F.lit(0.0)).alias("features")), path)
    before = stores.cache_coverage(manifest, stores.read_features(spark, path)).first()
    missing = stores.missing_keys(manifest, stores.read_features(spark, path))
    stores.append_features(_encode(missing, "cache_key", "features"), path)
    found = stores.lookup_features(manifest, stores.read_features(spark, path), require_all=True)
    return found.select(
        "cache_key", F.when(F.size("features") == 2, "cached").otherwise("computed").alias("origin"),
        F.lit(before["total"]).cast("bigint").alias("n_total"), F.lit(before["present"]).cast("bigint").alias("n_present_before"))


@query("S19", "P1", "P6", "V1", "X1", sql="WITH " + s.CATALOGUE + f""", t AS (SELECT audio, confidence, trim(text, E' \\t\\n\\r') || '. mood: ' || mood AS caption FROM catalogue WHERE confidence >= 0.35),
v AS (SELECT audio, confidence, {_VEC.format('caption')} AS v FROM t)
SELECT audio, confidence, 1.0::DOUBLE AS length, round(CAST(CAST(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS FLOAT) AS DOUBLE), 5) AS first FROM v""")
def embedding_table_build(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, compose, encode, normalise and store, then read back."""
    path = scratch_path(spark, "index")
    stores.write_embedding_table(stores.embedding_rows(s.catalogue(spark, folder).select("audio", "text", "mood", "confidence"), _encode, 0.35), path)
    stored = spark.read.schema("audio STRING, text STRING, mood STRING, confidence DOUBLE, embedding ARRAY<FLOAT>").parquet(path)
    return stored.select("audio", "confidence", F.round(norm("embedding"), 4).alias("length"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("T1", "S19", "S12", "X1", sql=f"""
WITH pool AS (SELECT doc_id AS item_id, {_VEC.format('text')} AS v FROM documents), q AS (SELECT DISTINCT source AS query_id, {_VEC.format('source')} AS v FROM documents),
sc AS (SELECT query_id, item_id, round(list_cosine_similarity(q.v, pool.v), 9) AS score FROM q CROSS JOIN pool)
SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM sc
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 5""")
def text_query_search(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as queries over encoded documents."""
    pool = _encode(table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text"), "text", "item_vec")
    queries = _encode(table(spark, folder, "documents").select(F.col("source").alias("query_id")).distinct(), "query_id", "query_vec")
    return search.top_k(queries, pool, 5).select("query_id", "item_id", "rank")


@query("X5", "W2", "J12", "U2", sql=f"""
WITH t AS (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS path, {_VEC.format('text')} AS a, {_VEC.format("text || ' refined'")} AS b, {_VEC.format("CAST(doc_id AS VARCHAR)")} AS item FROM documents),
sims AS (SELECT *, list_cosine_similarity(item, a) AS sim FROM t),
hard AS (SELECT * FROM sims QUALIFY row_number() OVER (ORDER BY sim, path) <= ceil((SELECT count(*) FROM t) * 0.2)),
ok AS (SELECT * FROM hard WHERE length(text) >= 200 AND list_cosine_similarity(item, b) > sim AND list_cosine_similarity(a, b) >= -0.5)
SELECT path AS audio_path, 'orig' AS source, 1.0::DOUBLE AS weight, md5(text) AS text_md5 FROM t UNION ALL SELECT path, 'hard', 2.0, md5(text || ' refined') FROM ok""")
def self_train_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Mine the hard fifth, refine and gate it, and add what was accepted to the manifest."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("audio_path"), "text")
    train = _encode(rows, "audio_path", "item_vec")
    _, _, mixed = refining.self_train_round(train, "item_vec", hash_encoder(), _refiner, iteration=1, min_text_cos=-0.5)
    return mixed.select("audio_path", "source", "weight", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("X2", "F18", sql=f"""
SELECT conv_id, turn, md5('{text.PROMPT_REWRITE}' || E'\\nOriginal caption: ' || trim(coalesce(text, ''), E' \\t\\n\\r') || E'\\nMood hint: ' || role || E'\\n{text.PROMPT_CLOSE}') AS answer_md5
FROM conversations""")
def no_op_refinement(spark: SparkSession, folder: str) -> DataFrame:
    """Refiner that answers with its prompt."""
    c = table(spark, folder, "conversations")
    rows = c.select("conv_id", "turn", text.rewrite_prompt(F.col("text"), F.col("role"), F.lit(None).cast("double")).alias("prompt"))
    out = refining.refine_rows(rows, "prompt", refining.no_op())
    return out.select("conv_id", "turn", F.md5(F.col("text_new").cast("binary")).alias("answer_md5"))


@query("R1", "S16", "J10", sql="""
SELECT user_id, CASE WHEN max(value) > 400 THEN 'failed' ELSE 'ok' END AS status, max(value) AS value FROM events GROUP BY 1""")
def incremental_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Two arrivals of files processed by two stream runs into one ledger; each key is processed once."""
    source, ledger, checkpoint = (scratch_path(spark, n) for n in ("arrivals", "stream-ledger", "stream-state"))
    totals = table(spark, folder, "events").groupBy("user_id").agg(F.max("value").alias("value"))
    schema = "user_id BIGINT, value DOUBLE"

    def process(rows: DataFrame) -> DataFrame:
        return rows.withColumn("status", F.when(F.col("value") > 400, "failed").otherwise("ok"))

    for arrived in (totals.filter(F.col("value") <= 300), totals):
        arrived.write.mode("append").json(source)
        incremental.process_new_files(spark, source, schema, process, ledger, checkpoint, "user_id")
    return incremental.read_ledger(spark, ledger, f"{schema}, status STRING").select("user_id", "status", "value")


@query("R1", "J10", sql="""
WITH first AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ok' END AS status FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, status FROM first UNION ALL SELECT c_custkey, 'ok' FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM first WHERE status = 'ok')""")
def retried_batch_run(spark: SparkSession, folder: str) -> DataFrame:
    """Batch runs over a ledger that records failures; the second run retries them and takes the rest."""
    path = scratch_path(spark, "batch-ledger")
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    first = c.filter(F.col("c_mktsegment") != "BUILDING")
    jsonl.append_ledger(first.select("c_custkey", F.when(F.col("c_acctbal") < 0, "failed").otherwise("ok").alias("status")), path)
    ledger = jsonl.read_jsonl(spark, path, "c_custkey BIGINT, status STRING")
    incremental.run_pending(c, ledger, path, "c_custkey", lambda rows: rows.select("c_custkey", F.lit("ok").alias("status")), retry_failed=True)
    return jsonl.read_jsonl(spark, path, "c_custkey BIGINT, status STRING")
