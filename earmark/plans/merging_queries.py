"""Joins, merges, exclusions and key sets over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.constants import LABEL_COLUMNS
from earmark.functions.values import bin_value
from earmark.operators import ablation, filters, merging
from earmark.operators.ordering import keep_one
from earmark.operators.refining import unique_songs
from earmark.plans import standins as s
from earmark.plans.registry import query, table

TEMPO_SQL = "CASE WHEN {0} < 80 THEN 'slow' WHEN {0} <= 120 THEN 'mid-tempo' ELSE 'fast' END"


@query("J1", "A7", sql="WITH " + s.CLIPS + """
SELECT source_path, count(*) AS n_segments, count(*) FILTER (WHERE mood IS NOT NULL) AS n_matched, max(coalesce(mood, 'none')) AS mood
FROM clips LEFT JOIN (SELECT audio AS source_path, mood FROM catalogue JOIN labels USING (doc_id)) USING (source_path) GROUP BY 1""")
def segment_metadata_join(spark: SparkSession, folder: str) -> DataFrame:
    """Clips with the metadata of their song; songs without labels have no metadata here and count as unmatched."""
    meta = s.labelled(spark, folder).filter(F.col("quality").isNotNull()).select(
        F.concat(F.lit("./"), "audio").alias("audio"), "text", "mood", "confidence", F.col("doc_id").alias("_ord"))
    joined = merging.match_segments(s.clips(spark, folder), meta)
    return joined.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if("matched").alias("n_matched"), F.max(F.coalesce("mood", F.lit("none"))).alias("mood"))


@query("J2", sql="""
SELECT doc_id, md5(text) AS text_orig_md5,
       CASE WHEN quality = 1 AND toxic = 1 THEN 'piano, vocal' WHEN quality = 1 THEN 'piano' WHEN toxic = 1 THEN 'vocal' ELSE 'music' END AS text,
       CASE WHEN quality IS NULL THEN 'tag_no_gold' WHEN quality = 1 OR toxic = 1 THEN 'tag_primary' ELSE 'tag_fallback' END AS text_source
FROM documents LEFT JOIN labels USING (doc_id)""")
def tag_caption_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest recaptioned from gold labels; a repeated gold row must lose against the first."""
    rows = s.catalogue(spark, folder).withColumnRenamed("audio", "source_path")
    gold = s.labelled(spark, folder).filter(F.col("quality").isNotNull())
    first = gold.select("audio", F.create_map(F.lit("inst_piano"), "quality", F.lit("inst_vocal"), "toxic").alias("human_multihot"), F.lit(0).alias("_ord"))
    repeated = gold.select("audio", F.create_map(F.lit("mood_relaxing"), F.lit(1)).alias("human_multihot"), F.lit(1).alias("_ord"))
    out = merging.tag_captions(rows, repeated.unionByName(first).withColumnRenamed("audio", "source_path"))
    return out.select("doc_id", F.md5(F.col("text_orig").cast("binary")).alias("text_orig_md5"), "text", "text_source")


@query("J3", sql="""
WITH sheet AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_idx, o_orderkey, o_orderstatus FROM orders),
side AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_idx, o_custkey FROM orders)
SELECT row_idx, o_orderkey, o_orderstatus, o_custkey FROM sheet JOIN side USING (row_idx)""")
def positional_pairing(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables of one length, paired row by row in their own orders."""
    o = table(spark, folder, "orders")
    sheet, side = o.select("o_orderkey", "o_orderstatus", "o_totalprice"), o.select("o_custkey", F.col("o_orderkey").alias("k"))
    out = merging.positional_join(sheet, side, ["o_totalprice", "o_orderkey"], ["k"])
    return out.select("row_idx", "o_orderkey", "o_orderstatus", "o_custkey")


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Merged gold rows: labelled items, tempo from a user's events, metadata from the catalogue."""
    rows = s.labelled(spark, folder).filter(F.col("quality").isNotNull())
    gold = rows.select(
        F.concat(F.lit("song "), "doc_id").alias("song_name"), F.concat(F.lit(" "), F.replace("audio", F.lit("/"), F.lit("\\"))).alias("source_path"),
        *[(F.col("quality").cast("string") if c == "inst_piano" else F.col("toxic").cast("string") if c == "mood_epic" else F.lit(" ")).alias(c)
          for c in LABEL_COLUMNS])
    events = table(spark, folder, "events")
    source = F.concat(F.lit("data/music_db/src"), F.col("user_id") % 20, F.lit("/doc"), "user_id", F.lit(".mp3"))
    no_paths = F.array().cast("array<string>")
    tempo = events.select(
        source.alias("source_path"), F.when(F.col("event_type") == "error", "missing_file").otherwise("ok").alias("status"),
        F.array("value", F.col("value") * 2).alias("clip_bpms"), bin_value("value").alias("gt_tempo_song"),
        bin_value(F.col("value") * 1.5).alias("pred_tempo_song"), no_paths.alias("clip_gt_tempo"), no_paths.alias("clip_pred_tempo"),
        F.create_map(F.lit("slow"), "value").alias("mean_scores_song"), F.array(F.lit("a")).alias("eval_audio_paths"), F.col("event_id").alias("_ord"))
    meta = s.catalogue(spark, folder).filter(F.col("mood") != "fr").select("audio", "text", "mood", "confidence", F.col("doc_id").alias("_ord"))
    return merging.merge_gold(gold, tempo, meta)


GOLD_SQL = "WITH " + s.CATALOGUE + f""",
last_event AS (SELECT 'data/music_db/src' || (user_id % 20) || '/doc' || user_id || '.mp3' AS source_path,
                      arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1),
gold AS (
  SELECT 'song ' || c.doc_id AS song_name, c.audio AS source_path, l.quality AS inst_piano, l.toxic AS mood_epic,
         CASE WHEN t.event_type <> 'error' THEN t.value * 1.5 END AS bpm_mean,
         CASE WHEN t.event_type <> 'error' THEN {TEMPO_SQL.format('t.value')} END AS tempo_bin_bpm,
         CASE WHEN c.mood <> 'fr' THEN c.confidence END AS confidence
  FROM catalogue c JOIN labels l USING (doc_id) LEFT JOIN last_event t ON t.source_path = c.audio)"""


@query("J4", "A2", sql=GOLD_SQL + """
SELECT song_name, source_path, inst_piano, mood_epic, round(bpm_mean, 6) AS bpm_mean, tempo_bin_bpm, confidence FROM gold""")
def gold_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows with tempo (last ledger row, status ok) and metadata."""
    labels = F.col("human_multihot")
    return _gold(spark, folder).select(
        "song_name", "source_path", labels["inst_piano"].alias("inst_piano"), labels["mood_epic"].alias("mood_epic"),
        F.round("program_tempo.bpm_mean", 6).alias("bpm_mean"), F.col("program_tempo.tempo_bin_bpm").alias("tempo_bin_bpm"),
        F.col("program_metadata.confidence").alias("confidence"))


@query("J4", "A7", sql=GOLD_SQL + """
SELECT count(*) AS rows_written, count(bpm_mean) AS with_program_tempo, count(confidence) AS with_program_metadata FROM gold""")
def gold_merge_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the gold merge."""
    return merging.merge_summary(_gold(spark, folder))


@query("P11", sql=GOLD_SQL + """
SELECT song_name, CASE WHEN inst_piano <> 0 THEN '1' ELSE '0' END AS inst_piano, CASE WHEN mood_epic <> 0 THEN '1' ELSE '0' END AS mood_epic,
       '0' AS mood_relaxing, coalesce(tempo_bin_bpm, '') AS tempo_bin_bpm
FROM gold""")
def gold_review_table(spark: SparkSession, folder: str) -> DataFrame:
    """Flat review table of nested gold rows."""
    return filters.review_rows(_gold(spark, folder)).select("song_name", "inst_piano", "mood_epic", "mood_relaxing", "tempo_bin_bpm")


@query("J5", sql="""
WITH refined AS (SELECT p_partkey, p_name, CASE WHEN p_size < 25 THEN '/lib/' || p_partkey || '.mp3' ELSE 'other/' || p_partkey || '.mp3' END AS path,
                        'refined ' || p_partkey AS new_text FROM part WHERE p_size >= 10)
SELECT p.p_partkey, CASE WHEN p.p_size >= 10 THEN 'refined ' || p.p_partkey ELSE p.p_name END AS text,
       CASE WHEN p.p_size >= 10 THEN 'llm_refined' ELSE 'original' END AS text_source, CASE WHEN p.p_size >= 10 THEN p.p_name END AS text_orig
FROM part p""")
def two_key_caption_swap(spark: SparkSession, folder: str) -> DataFrame:
    """Refined captions found by full path, else by file name; items without one keep their text."""
    p = table(spark, folder, "part")
    name = F.concat("p_partkey", F.lit(".mp3"))
    manifest = p.select("p_partkey", name.alias("audio_path"), F.col("p_name").alias("text"))
    refined = p.filter(F.col("p_size") >= 10).select(
        F.when(F.col("p_size") < 25, F.concat(F.lit("/lib/"), name)).otherwise(F.concat(F.lit("other/"), name)).alias("audio_path"),
        F.concat(F.lit(" refined "), "p_partkey").alias("text"), F.lit(1).alias("_ord"))
    stale = refined.withColumns({"text": F.lit("stale"), "_ord": F.lit(0)})
    out = merging.swap_captions(manifest, refined.unionByName(stale), root="/lib")
    return out.select("p_partkey", "text", "text_source", "text_orig")


@query("J6", sql="WITH " + s.CLIPS + """
SELECT segment_path, CASE WHEN quality IS NOT NULL THEN 'caption ' || doc_id ELSE 'old' END AS text,
       CASE WHEN quality IS NOT NULL THEN 'llm_full_corpus' ELSE 'original' END AS text_source
FROM clips LEFT JOIN labels USING (doc_id)""")
def caption_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Every clip takes the caption of its song where the ledger has one."""
    clips = s.clips(spark, folder).withColumn("text", F.lit("old"))
    done = s.labelled(spark, folder).filter(F.col("quality").isNotNull())
    ledger = done.select(F.col("audio").alias("source_path"), F.concat(F.lit("caption "), "doc_id").alias("text"), F.lit(0).alias("_ord"))
    return merging.propagate_captions(clips, ledger, root="/lib").select("segment_path", "text", "text_source")


@query("J6", sql="WITH " + s.CLIPS + """
SELECT text_source, count(*) AS n, count(text_orig_tag) AS n_kept_tag
FROM (SELECT CASE WHEN quality IS NOT NULL THEN 'tag_llm_refined' ELSE 'tag_primary' END AS text_source,
             CASE WHEN quality IS NOT NULL THEN 'tag' END AS text_orig_tag FROM clips LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def tag_caption_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """As caption_propagation for tag captions, which keep the tag text."""
    clips = s.clips(spark, folder).withColumn("text", F.lit("tag"))
    done = s.labelled(spark, folder).filter(F.col("quality").isNotNull())
    ledger = done.select(F.col("audio").alias("source_path"), F.lit("sentence").alias("text"), F.lit(0).alias("_ord"))
    out = merging.propagate_captions(clips, ledger, label="tag_llm_refined", default_source="tag_primary", tag_mode=True)
    return out.groupBy("text_source").agg(F.count(F.lit(1)).alias("n"), F.count("text_orig_tag").alias("n_kept_tag"))


@query("J7", sql="""
SELECT doc_id, source || '/' || doc_id AS audio_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def holdout_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Training candidates without the held-out items (here the labelled ones)."""
    d = table(spark, folder, "documents")
    rows = d.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("audio_path"))
    holdout = rows.join(table(spark, folder, "labels").select("doc_id"), "doc_id").select(F.concat(F.lit(" "), F.replace("audio_path", F.lit("/"), F.lit("\\"))).alias("audio_path"))
    return merging.exclude_holdout(rows, holdout)


@query("J7", sql="""
SELECT count(*) AS n_candidates, count(*) FILTER (WHERE b.text IS NULL) AS n_clean
FROM documents d LEFT JOIN (SELECT DISTINCT text FROM benchmark) b ON trim(d.text) = trim(b.text)""")
def benchmark_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose whole text is a benchmark item are excluded."""
    d = table(spark, folder, "documents").select("doc_id", F.col("text").alias("audio_path"))
    kept = merging.exclude_holdout(d, table(spark, folder, "benchmark").select(F.col("text").alias("audio_path")))
    return d.agg(F.count(F.lit(1)).alias("n_candidates")).withColumn("n_clean", kept.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("J8", sql="WITH " + s.CATALOGUE + """
SELECT doc_id, 'doc' || doc_id || '.mp3' AS basename FROM catalogue WHERE doc_id IN (SELECT doc_id FROM labels)""")
def evaluation_pool_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows whose file name is labelled."""
    index = s.catalogue(spark, folder).select("doc_id", "audio")
    gold = s.labelled(spark, folder).filter(F.col("quality").isNotNull()).select(F.concat(F.lit("elsewhere/"), F.element_at(F.split("audio", "/"), -1)).alias("source_path"))
    return merging.evaluation_pool(index, gold).select("doc_id", "basename")


@query("J9", "U4", sql="""
SELECT 'kept' AS part, o_custkey AS k, count(*) AS n FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_custkey IN (SELECT user_id FROM events) GROUP BY 2
UNION ALL SELECT 'without_rows', c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def key_set_restriction(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key is in two key sets, and keys that have no row."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    segment = table(spark, folder, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    users = table(spark, folder, "events").select("user_id")
    kept = merging.restrict_keys(orders, "k", segment, users).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    absent = merging.keys_without_rows(table(spark, folder, "customer").select(F.col("c_custkey").alias("k")), orders, "k")
    return kept.select(F.lit("kept").alias("part"), "k", "n").unionByName(absent.select(F.lit("without_rows").alias("part"), "k", F.lit(0).cast("bigint").alias("n")))


@query("J10", sql="""
SELECT count(*) AS n_total, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_done FROM documents""")
def ledger_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct keys of the work, and how many the ledger holds."""
    return merging.completeness(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id"), "doc_id")


@query("J11", sql="""
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT c_custkey AS user_id, CASE WHEN t IS NULL THEN 'missing' WHEN t <> 'error' AND v > 10 THEN 'ok' ELSE 'present_not_ok' END AS state
FROM customer LEFT JOIN last ON user_id = c_custkey""")
def coverage_audit(spark: SparkSession, folder: str) -> DataFrame:
    """State of every expected key in a ledger whose last row per key counts."""
    expected = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    ledger = table(spark, folder, "events").select("user_id", "event_type", "value", F.col("event_id").alias("_ord"))
    return merging.coverage_audit(expected, ledger, "user_id", (F.col("event_type") != "error") & (F.col("value") > 10)).select("user_id", "state")


@query("J13", "A24", sql="""
WITH files AS (SELECT '/a/' || doc_id AS path, quality AS length FROM labels UNION ALL SELECT '/b/' || doc_id, toxic FROM labels)
SELECT d.doc_id, CASE WHEN l.quality > 0 THEN '/a/' || d.doc_id WHEN l.toxic > 0 THEN '/b/' || d.doc_id END AS audio_path,
       (SELECT count(*) FROM labels WHERE quality > 0 OR toxic > 0) AS n_audio_ready, 'partial' AS prep_state
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def file_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """First existing, non-empty candidate file per item, and the readiness that follows."""
    manifest = table(spark, folder, "documents").select("doc_id")
    labels = table(spark, folder, "labels")
    inventory = labels.select(F.concat(F.lit("/a/"), "doc_id").alias("path"), F.col("quality").alias("length")).unionByName(
        labels.select(F.concat(F.lit("/b/"), "doc_id").alias("path"), F.col("toxic").alias("length")))
    candidates = F.array(F.concat(F.lit("/a/"), "doc_id"), F.concat(F.lit("/b/"), "doc_id"))
    resolved = merging.resolve_files(manifest, candidates, inventory, "doc_id")
    ready = merging.readiness(resolved).select(F.struct("n_audio_ready", "prep_state")).scalar()
    return resolved.select("doc_id", "audio_path", ready["n_audio_ready"].alias("n_audio_ready"), ready["prep_state"].alias("prep_state"))


@query("A1", sql="WITH " + s.CLIPS + """
SELECT '/lib/' || source_path AS song_key, min(segment_path) AS segment_path, 0 AS segment_index FROM clips GROUP BY source_path""")
def first_clip_per_song(spark: SparkSession, folder: str) -> DataFrame:
    """First clip of every song."""
    out = unique_songs(s.clips(spark, folder), root="/lib", order="segment_index")
    return out.select("song_key", "segment_path", "segment_index")


@query("A1", "A2", sql="""
SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, count(*) - 1 AS n_duplicates
FROM events GROUP BY 1""")
def first_and_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """One row per key by both duplicate rules, with the number of dropped rows."""
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id")
    first = keep_one(e, ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("first_type"))
    last = keep_one(e, ["user_id"], ["event_id"], keep="last", n_dropped="n_duplicates")
    return first.join(last, "user_id").select("user_id", "first_type", F.col("event_type").alias("last_type"), "n_duplicates")


@query("A3", sql="""
SELECT o_custkey AS k, CASE WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN 'human'
         WHEN max(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 ELSE 0 END) = 1 THEN 'auto' ELSE 'seed' END AS layer,
       CASE WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN max(o_orderkey) FILTER (WHERE o_orderstatus = 'P')
         WHEN max(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 ELSE 0 END) = 1
           THEN max(o_orderkey) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000)
         ELSE max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') END AS o_orderkey
FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'F' OR o_totalprice > 100000 GROUP BY 1""")
def layered_override(spark: SparkSession, folder: str) -> DataFrame:
    """Seed rows, overridden by confident automatic ones, overridden by human ones."""
    o = table(spark, folder, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    def layer(name: str, keep) -> DataFrame:
        return o.filter(keep).select("k", F.lit(name).alias("layer"), "o_orderkey", F.col("o_orderkey").alias("_ord"))
    status = F.col("o_orderstatus")
    merged = merging.layered_merge(
        [layer("seed", status == "F"), layer("auto", (status == "O") & filters.above("o_totalprice", 100000)), layer("human", status == "P")], "k")
    return merged.select(F.col("k").cast("bigint").alias("k"), "layer", "o_orderkey")


@query("A4", sql="""
SELECT CAST(l_partkey AS VARCHAR) AS track_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags
FROM (SELECT l_partkey, l_returnflag AS tag FROM lineitem UNION ALL SELECT l_partkey, 'line' || l_linestatus FROM lineitem
      UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part) GROUP BY 1""")
def tag_union(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted union of the tags of a track over two tables."""
    line = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("track_id"), F.array("l_returnflag", F.concat(F.lit("line"), "l_linestatus")).alias("tags"), F.lit(0).alias("_ord"))
    part = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("track_id"), F.split("p_name", " ").alias("tags"), F.lit(1).alias("_ord"))
    return merging.union_tags(line, part).select("track_id", F.array_join("tags", ",").alias("tags"))


@query("A6", sql="""
WITH w AS (SELECT doc_id, CASE WHEN quality = 1 THEN '1.0' ELSE '' END AS inst_piano, CAST(toxic AS VARCHAR) AS mood_epic,
                  CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE '2' END AS mood_relaxing FROM labels),
n AS (SELECT *, inst_piano = '1.0' AS a, mood_epic <> '0' AS b, mood_relaxing = '2' AS c FROM w)
SELECT label, n_positive, n_rows, n_no_mood, round(n_positive / n_rows, 8) AS prevalence FROM (
  SELECT 'inst_piano' AS label, count(*) FILTER (WHERE a) AS n_positive, count(*) AS n_rows, count(*) FILTER (WHERE NOT b AND NOT c) AS n_no_mood FROM n
  UNION ALL SELECT 'mood_epic', count(*) FILTER (WHERE b), count(*), count(*) FILTER (WHERE NOT b AND NOT c) FROM n
  UNION ALL SELECT 'mood_relaxing', count(*) FILTER (WHERE c), count(*), count(*) FILTER (WHERE NOT b AND NOT c) FROM n)""")
def label_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Positives and prevalence per label cell column, and rows without any mood."""
    rows = table(spark, folder, "labels").select(
        F.when(F.col("quality") == 1, "1.0").otherwise("").alias("inst_piano"), F.col("toxic").cast("string").alias("mood_epic"),
        F.when(F.col("doc_id") % 5 == 0, "bad").otherwise("2").alias("mood_relaxing"))
    out = ablation.label_balance(rows, ["inst_piano", "mood_epic", "mood_relaxing"], ["mood_epic", "mood_relaxing"])
    return out.withColumn("prevalence", F.round("prevalence", 8))


@query("J12", "U2", sql="""
SELECT source, text_source, weight, count(*) AS n, count(sim) AS n_sim FROM (
  SELECT 'orig' AS source, 'original' AS text_source, 1.0::DOUBLE AS weight, NULL::DOUBLE AS sim FROM orders
  UNION ALL SELECT 'hard', 'llm_refined', 2.0, 0.5 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) GROUP BY ALL""")
def weighted_hard_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """All rows once, refined hard rows once more with a higher weight."""
    o = table(spark, folder, "orders").withColumn("audio_path", F.col("o_orderkey").cast("string"))
    train = o.select("audio_path", F.col("o_orderpriority").alias("text"))
    hard = o.filter(F.col("o_orderstatus") == "F").select("audio_path")
    refined = o.filter(F.col("o_totalprice") > 200000).select(
        "audio_path", F.lit("better").alias("text"), F.col("o_orderpriority").alias("text_orig"), F.lit("llm_refined").alias("text_source"),
        F.lit(0.5).alias("sim"), F.lit(0.5).alias("error_score"), F.lit(0).alias("_ord"))
    mixed = merging.add_hard_duplicates(train, hard, refined, iteration=1)
    return mixed.groupBy("source", "text_source", "weight").agg(F.count(F.lit(1)).alias("n"), F.count("sim").alias("n_sim"))


@query("J3", sql="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_id <> event_id % 150) AS n_name_mismatch,
       count(*) - count(DISTINCT user_id) AS n_duplicate_names, count(*) FILTER (WHERE event_type = 'view') AS n_bad_cells
FROM events""")
def pairing_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of mismatched and repeated names and of unreadable cells."""
    e = table(spark, folder, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("left_name"), (F.col("event_id") % 150).cast("string").alias("right_name"),
        F.when(F.col("event_type") == "view", "maybe").otherwise("1").alias("inst_piano"))
    return merging.name_warnings(rows, "left_name", "right_name")
