"""Predicates and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions import keys, text, values
from earmark.functions.vectors import unit
from earmark.operators import filters
from earmark.operators.sampling import plan_segments
from earmark.plans import standins as s
from earmark.plans.registry import query, table


@query("P1", sql="WITH " + s.CATALOGUE + """
SELECT source, count(*) FILTER (WHERE confidence > 0.35) AS n_strict, count(*) FILTER (WHERE confidence >= 0.35) AS n_inclusive
FROM catalogue GROUP BY 1""")
def confidence_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of the confidence threshold, per source."""
    return s.catalogue(spark, folder).groupBy("source").agg(
        F.count_if(filters.above("confidence", 0.35)).alias("n_strict"),
        F.count_if(filters.above("confidence", 0.35, inclusive=True)).alias("n_inclusive"))


@query("P2", sql="WITH " + s.CATALOGUE + """, c AS (SELECT doc_id, CASE WHEN mood = 'de' THEN NULL ELSE confidence END AS confidence FROM catalogue)
SELECT doc_id, CASE WHEN confidence IS NULL THEN 'other' WHEN confidence BETWEEN 0.1 AND 0.4 THEN 'review'
       WHEN confidence > 0.4 THEN 'high' ELSE 'low' END AS band,
       (SELECT count(*) FROM c WHERE confidence BETWEEN 0.1 AND 0.4) AS n_review, (SELECT count(*) FROM c) AS total
FROM c""")
def confidence_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Route of every record, with the route counts."""
    rows = s.catalogue(spark, folder).withColumn("confidence", F.when(F.col("mood") != "de", F.col("confidence")))
    counts = filters.route_counts(rows).select(F.struct("n_review", "total")).scalar()
    return rows.select("doc_id", filters.confidence_band("confidence").alias("band"), counts["n_review"].alias("n_review"), counts["total"].alias("total"))


@query("P3", "U3", sql="WITH " + s.CATALOGUE + """,
existing AS (SELECT audio, CASE WHEN toxic = 0 THEN confidence END AS confidence FROM catalogue JOIN labels USING (doc_id)),
everything AS (SELECT audio FROM catalogue UNION SELECT audio FROM existing)
SELECT 'threshold' AS mode, k.audio FROM everything k LEFT JOIN existing e USING (audio) WHERE e.confidence IS NULL OR e.confidence < 0.35
UNION ALL SELECT 'incremental', audio FROM everything WHERE audio NOT IN (SELECT audio FROM existing)""")
def refetch_work_list(spark: SparkSession, folder: str) -> DataFrame:
    """Keys to fetch: all without sufficient confidence, or only new ones."""
    from earmark.operators.merging import work_list

    rows = s.labelled(spark, folder)
    existing = rows.filter(F.col("quality").isNotNull()).select("audio", F.when(F.col("toxic") == 0, F.col("confidence")).alias("confidence"))
    on_disk = rows.select("audio")
    by_threshold = work_list(on_disk, existing, threshold=0.35).select(F.lit("threshold").alias("mode"), "audio")
    return by_threshold.unionByName(work_list(on_disk, existing).select(F.lit("incremental").alias("mode"), "audio"))


@query("P4", sql="""
SELECT p_partkey, (p_name LIKE '%red%' OR p_name LIKE '%blue%') AS has_colour FROM part""")
def any_tag_predicate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a tag list holds any of the wanted tags."""
    tags = F.split("p_name", " ")
    return table(spark, folder, "part").select("p_partkey", filters.any_tag(tags, ["red", "blue"]).alias("has_colour"))


@query("P5", "F15", sql="""
SELECT doc_id, quality = 1 AND toxic = 1 AS both_tags,
       CASE WHEN quality = 1 AND toxic = 1 THEN 'inst_piano,inst_vocal' WHEN quality = 1 THEN 'inst_piano' WHEN toxic = 1 THEN 'inst_vocal'
            ELSE 'none' END AS buckets
FROM labels""")
def label_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Label map of public labels: AND over tags, and sampling buckets."""
    rows = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("gold_pub_piano"), F.col("toxic").alias("gold_pub_vocal"), F.lit(None).cast("int").alias("gold_pub_relaxing"))
    labels = values.public_label_map()
    return rows.select(
        "doc_id", filters.all_tags(labels, ["inst_piano", "inst_vocal"]).alias("both_tags"),
        F.array_join(values.tag_buckets(labels), ",").alias("buckets"))


@query("P6", sql="""
WITH c AS (SELECT event_id, CASE WHEN event_type = 'click' THEN ' ' WHEN event_type = 'view' THEN NULL ELSE 'track ' || user_id END AS text,
                  CASE WHEN value > 100 THEN ' calm ' WHEN value > 50 THEN '' END AS mood FROM events)
SELECT event_id, CASE WHEN nullif(trim(text), '') IS NOT NULL AND nullif(trim(mood), '') IS NOT NULL THEN trim(text) || '. mood: ' || trim(mood)
  WHEN nullif(trim(text), '') IS NOT NULL THEN trim(text) WHEN nullif(trim(mood), '') IS NOT NULL THEN 'music mood ' || trim(mood)
  ELSE 'unknown music' END AS caption
FROM c""")
def caption_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Text to embed from caption and mood, with every case of blanks."""
    e = table(spark, folder, "events")
    caption = F.when(F.col("event_type") == "click", " ").when(F.col("event_type") != "view", F.concat(F.lit("track "), "user_id"))
    mood = F.when(F.col("value") > 100, " calm ").when(F.col("value") > 50, "")
    return e.select("event_id", text.compose_caption(caption, mood).alias("caption"))


@query("P7", sql="""
WITH g AS (SELECT event_id, value / 500 AS sim_old, (value + user_id - 75) / 500 AS sim_new, 1 - user_id / 500.0::DOUBLE AS text_cos FROM events)
SELECT event_id, sim_new > sim_old AND text_cos >= 0.85 AS accepted, sim_new >= sim_old + 0.01 AND text_cos >= 0.8 AS accepted_loose,
       CASE WHEN NOT sim_new > sim_old THEN 'sim' WHEN NOT text_cos >= 0.85 THEN 'drift' ELSE 'none' END AS reason,
       round(sim_new - sim_old, 8) AS sim_gain
FROM g""")
def refinement_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance test of refined texts, strict and loose."""
    e = table(spark, folder, "events")
    rows = e.select("event_id", (F.col("value") / 500).alias("o"), ((F.col("value") + F.col("user_id") - 75) / 500).alias("n"), (1 - F.col("user_id") / 500).alias("c"))
    strict, loose = filters.gate("o", "n", "c"), filters.gate("o", "n", "c", min_sim_gain=0.01, min_text_cos=0.8, strict=False)
    return rows.select(
        "event_id", strict["accepted"].alias("accepted"), loose["accepted"].alias("accepted_loose"),
        F.coalesce(strict["reject_reason"], F.lit("none")).alias("reason"), F.round(strict["sim_gain"], 8).alias("sim_gain"))


@query("P10", "F11", sql="""
WITH sheet AS (SELECT doc_id, CASE WHEN lang = 'es' THEN ' ' ELSE ' song ' || doc_id END AS song_name,
  CASE lang WHEN 'de' THEN '1.0' WHEN 'fr' THEN 'yes' ELSE '' END AS inst_piano, CAST(n_chars % 3 AS VARCHAR) AS mood_epic FROM documents)
SELECT trim(song_name) AS song_name, CASE WHEN inst_piano = '1.0' THEN '1' ELSE '0' END AS inst_piano,
       CASE WHEN mood_epic <> '0' THEN '1' ELSE '0' END AS mood_epic, '0' AS mood_dark_tense
FROM sheet WHERE trim(song_name) <> ''""")
def label_sheet_upgrade(spark: SparkSession, folder: str) -> DataFrame:
    """Old label sheet brought to the current columns."""
    d = table(spark, folder, "documents")
    sheet = d.select(
        F.when(F.col("lang") == "es", " ").otherwise(F.concat(F.lit(" song "), "doc_id")).alias("song_name"),
        F.when(F.col("lang") == "de", "1.0").when(F.col("lang") == "fr", "yes").otherwise("").alias("inst_piano"),
        (F.col("n_chars") % 3).cast("string").alias("mood_epic"), F.lit("1").alias("obsolete_label"))
    return filters.upgrade_sheet(sheet).select("song_name", "inst_piano", "mood_epic", "mood_dark_tense")


@query("P12", sql="""
WITH logs AS (SELECT doc_id, text || CASE lang WHEN 'fr' THEN E'\\nERROR: out of memory\\n' WHEN 'de' THEN E'\\nSKIP_TRAIN=1\\n\\nDone.\\n'
                WHEN 'es' THEN E'\\nrun home_arm SKIP_EVAL=1\\n  \\nDone.  ' ELSE E'\\nPublic OOD step 1\\n' END AS body FROM documents)
SELECT doc_id, CASE WHEN contains(lower(body), 'domain tradeoff') OR contains(body, 'home_arm') THEN 'domain_tradeoff'
         WHEN contains(lower(body), 'public ood') THEN 'public_ood_eval'
         WHEN contains(body, 'SKIP_TRAIN=1') THEN 'skipped_train' ELSE 'unknown' END AS phase,
       CASE WHEN contains(body, 'SKIP_TRAIN=1') THEN 'skipped' WHEN contains(body, 'ERROR:') THEN 'failed'
         WHEN contains(body, 'Done.') THEN 'completed' ELSE 'running' END AS state,
       least(8, len(list_filter(string_split(body, E'\\n'), lambda x: trim(x, E' \\t') <> ''))) AS n_tail,
       md5(list_filter(string_split(body, E'\\n'), lambda x: trim(x, E' \\t') <> '')[-1]) AS last_line_md5, contains(body, 'SKIP_EVAL=1') AS skips_evaluation
FROM logs""")
def job_log_states(spark: SparkSession, folder: str) -> DataFrame:
    """Phase, state and last lines of whole logs."""
    d = table(spark, folder, "documents")
    closing = (
        F.when(F.col("lang") == "fr", "\nERROR: out of memory\n").when(F.col("lang") == "de", "\nSKIP_TRAIN=1\n\nDone.\n")
        .when(F.col("lang") == "es", "\nrun home_arm SKIP_EVAL=1\n  \nDone.  ").otherwise("\nPublic OOD step 1\n"))
    logs = d.select("doc_id", F.concat("text", closing).alias("value"))
    rows = filters.classify_log(logs, fine_tune_runs=["home_arm"])
    return rows.select(
        "doc_id", "phase", "state", F.size("tail").cast("bigint").alias("n_tail"),
        F.md5(F.element_at("tail", -1).cast("binary")).alias("last_line_md5"), F.col("has_skip_eval").alias("skips_evaluation"))


_MESSY = "'  ./' || replace(url, '/', '\\') || ' '"


@query("F1", "F2", "F4", "F5", "F8", sql=f"""
WITH p AS (SELECT page_id, {_MESSY} AS messy, 'x/music_db_15s/' || url AS clip, 'data/music_db/' || page_id || '/' || url AS stored FROM pages)
SELECT page_id, replace(trim(messy), '\\', '/') AS norm,
       ltrim(replace(trim(messy), '\\', '/'), './') AS source_key, substr(ltrim(trim(stored), './'), 15) AS stored_key,
       string_split(rtrim(replace(trim(messy), '\\', '/'), '/'), '/')[-1] AS base,
       url AS cache_key, substr(sha256(url), 1, 20) || '_' || right(replace(url, '/', '__'), 80) || '.npy' AS blob,
       replace(regexp_replace(url, '([^/])\\.[^./]+$', '\\1'), '/', '__') || '__seg007.mp3' AS clip_name,
       regexp_replace(url, '\\.[^.]*$', '') AS stem
FROM p JOIN pages USING (page_id)""")
def path_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Key forms of untidy paths."""
    p = table(spark, folder, "pages")
    messy = F.concat(F.lit("  ./"), F.replace("url", F.lit("/"), F.lit("\\")), F.lit(" "))
    stored = F.concat(F.lit("data/music_db/"), "page_id", F.lit("/"), "url")
    clip = F.concat(F.lit("x/music_db_15s/"), "url")
    return p.select(
        "page_id", keys.norm_path(messy).alias("norm"), keys.source_key(messy).alias("source_key"), keys.source_key(stored).alias("stored_key"),
        keys.basename(messy).alias("base"), keys.cache_key(clip).alias("cache_key"), keys.blob_name("url").alias("blob"),
        keys.clip_name("url", F.lit(7)).alias("clip_name"), keys.drop_extension("url").alias("stem"))


@query("F3", sql="""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/staged/p' || page_id || '.mp3' ELSE '/root/x/p' || page_id || '.mp3' END AS resolved,
       '/abs/p' || page_id AS absolute
FROM pages""")
def path_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Relative and absolute paths, with a staging root for clips."""
    p = table(spark, folder, "pages")
    name = F.concat(F.lit("p"), "page_id", F.lit(".mp3"))
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data/music_db_15s/"), name)).otherwise(F.concat(F.lit("./x//"), name))
    return p.select(
        "page_id", keys.resolve_path(path, "/root/", staged_root="/staged").alias("resolved"),
        keys.resolve_path(F.concat(F.lit("/abs/p"), "page_id"), "/root").alias("absolute"))


@query("F6", "F7", "F10", sql="""
SELECT doc_id, md5(regexp_replace(text, '[^\\p{L}\\p{Z}\\s\\x0b\\x1c-\\x1f\\x{85}]', '', 'g')) AS letters_md5,
       source || ' suite' AS stripped, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS blank_to_null
FROM documents""")
def text_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Letters only, suffix stripping and blank handling."""
    d = table(spark, folder, "documents")
    named = F.concat(F.lit(" "), "source", F.when(F.col("lang") == "fr", " suite MUSIC ").otherwise(" suite music"))
    blank = F.when(F.col("lang") == "en", " \n").otherwise(F.concat(F.lit(" "), "lang"))
    return d.select(
        "doc_id", F.md5(text.letters_only("text").cast("binary")).alias("letters_md5"),
        text.strip_music_suffix(named).alias("stripped"), keys.blank_to_null(blank).alias("blank_to_null"))


@query("F9", sql="""
SELECT event_id, round_even(least(1.0, greatest(0.0, coalesce(TRY_CAST(cell AS DOUBLE), 0.0))), 2) AS confidence
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'true' WHEN 'error' THEN '-0.5'
             ELSE CAST(value / 307 AS VARCHAR) END AS cell FROM events)""")
def confidence_coercion(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence cells as stored: limited and rounded half-even."""
    e = table(spark, folder, "events")
    cell = F.when(F.col("event_type") == "view", "true").when(F.col("event_type") == "error", "-0.5").otherwise((F.col("value") / 307).cast("string"))
    return e.select("event_id", values.quantise_confidence(cell).alias("confidence"))


@query("F13", "F20", sql="""
SELECT event_id, CASE WHEN value < 80 THEN 'slow' WHEN value <= 120 THEN 'mid-tempo' ELSE 'fast' END AS tempo,
       CASE WHEN event_type = 'view' THEN NULL ELSE round((value + user_id + 60.5) / 3, 6) END AS bpm_mean
FROM events""")
def tempo_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Tempo class of a value and mean of a short list (null for an empty one)."""
    e = table(spark, folder, "events")
    bpms = F.when(F.col("event_type") == "view", F.array().cast("array<double>")).otherwise(
        F.array(F.col("value"), F.col("user_id").cast("double"), F.lit(60.5)))
    return e.select("event_id", values.bin_value("value").alias("tempo"), F.round(values.array_mean(bpms), 6).alias("bpm_mean"))


@query("F14", sql="""
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'piano, vocal' WHEN quality = 1 THEN 'piano' WHEN toxic = 1 THEN 'vocal' ELSE 'music' END AS text,
       CASE WHEN quality IS NULL THEN 'tag_no_gold' WHEN quality = 1 OR toxic = 1 THEN 'tag_primary' ELSE 'tag_fallback' END AS text_source
FROM documents LEFT JOIN labels USING (doc_id)""")
def tag_text(spark: SparkSession, folder: str) -> DataFrame:
    """Caption words of the active tags, and where they come from."""
    rows = s.labelled(spark, folder)
    labels = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("inst_piano"), "quality", F.lit("inst_vocal"), "toxic"))
    return rows.select("doc_id", text.tag_caption(labels).alias("c")).select("doc_id", "c.text", "c.text_source")


@query("F16", sql="""
WITH old AS (SELECT event_id, event_type, value / 617 AS s, user_id / 211.0::DOUBLE AS r, CAST(json_extract(props, '$.k') AS DOUBLE) / 103 AS d FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN 'file' || event_id ELSE 'song' || event_id END AS audio,
       CASE WHEN event_type = 'view' THEN '' ELSE 'text' END AS text,
       CASE event_type WHEN 'click' THEN 'calm' WHEN 'signup' THEN 'dark' END AS mood,
       CASE event_type WHEN 'view' THEN 0.0 WHEN 'click' THEN round_even(least(1.0, s), 2)
            WHEN 'signup' THEN round_even(0.5 * least(1.0, s) + 0.3 * least(1.0, r) + 0.2 * least(1.0, d), 2) ELSE 0.0 END AS confidence
FROM old WHERE event_type <> 'error'""")
def legacy_record_upgrade(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all earlier shapes in one column set; rows without a key are dropped."""
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    share = F.get_json_object("props", "$.k").cast("double") / 103
    has_key = kind.isin("click", "signup", "purchase")
    row = F.struct(
        F.when(has_key, F.concat(F.lit(" song"), "event_id")).alias("audio"), F.when(has_key, F.lit(" text ")).alias("text"),
        F.when(kind == "click", " calm").alias("mood"), F.when(kind == "click", F.col("value") / 617).alias("confidence"),
        F.struct(F.when(kind == "signup", F.lit("dark")).alias("mood")).alias("tags"),
        F.when(kind == "signup", F.col("value") / 617).alias("S"), F.when(kind == "signup", F.col("user_id") / 211).alias("R"),
        F.when(kind == "signup", share).alias("D"), F.when(kind == "view", F.concat(F.lit("file"), "event_id")).alias("filename"))
    upgraded = e.select("event_id", row.alias("row")).select("event_id", values.upgrade_record(F.col("row")).alias("r"))
    return upgraded.filter(F.col("r").isNotNull()).select("event_id", "r.audio", "r.text", "r.mood", "r.confidence")


@query("F17", sql="""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'own key' ELSE 'key' || event_id END AS audio,
       CASE WHEN event_type IN ('click', 'view') THEN 'a "quoted" text' ELSE '' END AS text,
       CASE WHEN event_type = 'view' THEN 'calm' END AS mood,
       CASE WHEN event_type IN ('click', 'view') THEN round_even(least(1.0, value / 307), 2) ELSE 0.0 END AS confidence
FROM events""")
def model_response_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a model: complete, without key, cut off, an array, and empty."""
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    body = F.to_json(F.struct(
        F.when(kind == "click", "own key").alias("audio"), F.lit(' a "quoted" text ').alias("text"),
        F.when(kind == "view", "calm").otherwise(" ").alias("mood"), (F.col("value") / 307).alias("confidence")))
    raw = (
        F.when(kind.isin("click", "view"), body).when(kind == "signup", F.left(body, F.lit(12)))
        .when(kind == "error", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("")))
    parsed = values.parse_response(raw, F.concat(F.lit("key"), "event_id"))
    return e.select("event_id", parsed.alias("r")).select("event_id", "r.audio", "r.text", "r.mood", "r.confidence")


@query("F18", sql=f"""
WITH c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'calm' ELSE ' ' END AS mood,
                  CASE WHEN turn % 2 = 0 THEN turn / 8.0::DOUBLE END AS confidence, 'c' || conv_id AS src, turn / 7.0::DOUBLE AS sim FROM conversations)
SELECT conv_id, turn,
  md5('{text.PROMPT_IMPROVE}' || E'\\nOriginal caption: ' || coalesce(text, '') || CASE WHEN trim(mood) <> '' THEN E'\\nMood hint: ' || mood ELSE '' END
   || CASE WHEN confidence IS NULL THEN '' ELSE E'\\nMetadata confidence: ' || confidence END || E'\\nSource track: ' || src
   || E'\\nCurrent CLAP audio-text similarity: ' || printf('%.4f', sim) || E'\\n{text.PROMPT_CLOSE}') AS improve_md5,
  md5('{text.PROMPT_EXPAND}' || E'\\nTag description: ' || trim(coalesce(text, ''), E' \\t\\n\\r') || E'\\nSource: ' || src || E'\\n{text.PROMPT_CLOSE}') AS expand_md5,
  '{text.PROMPT_REWRITE}' || E'\\nOriginal caption: ' || src || CASE WHEN trim(mood) <> '' THEN E'\\nMood hint: ' || trim(mood) ELSE '' END
   || E'\\n{text.PROMPT_CLOSE}' AS rewrite
FROM c""")
def prompt_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """The three prompts; lines without a value are left out."""
    c = table(spark, folder, "conversations")
    mood = F.when(F.col("role") == "user", "calm").otherwise(" ")
    confidence = F.when(F.col("turn") % 2 == 0, F.col("turn") / 8)
    source = F.concat(F.lit("c"), "conv_id")
    improve = text.improve_prompt(F.col("text"), mood, confidence, source, F.col("turn") / 7)
    expand = text.expand_prompt(F.col("text"), source)
    return c.select(
        "conv_id", "turn", F.md5(improve.cast("binary")).alias("improve_md5"), F.md5(expand.cast("binary")).alias("expand_md5"),
        text.rewrite_prompt(source, mood, F.lit(None).cast("double")).alias("rewrite"))


@query("F19", sql="WITH " + s.CLIPS + """
SELECT doc_id, segment_index::INTEGER AS segment_index, start_sec, end_sec, duration_sec, segment_path FROM clips""")
def segment_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Clip offsets of every item."""
    return s.clips(spark, folder).select("doc_id", "segment_index", "start_sec", "end_sec", "duration_sec", "segment_path")


@query("F19", sql="""
WITH o AS (SELECT o_orderkey, o_totalprice / 1009 AS d FROM orders),
n AS (SELECT *, CAST(floor(d / 30) AS INTEGER) + CASE WHEN d - floor(d / 30) * 30 >= 10 THEN 1 ELSE 0 END AS n FROM o)
SELECT o_orderkey, n AS n_clips, round(least(d, n * 30.0::DOUBLE), 3) AS last_end FROM n WHERE n > 0""")
def segment_plan_custom(spark: SparkSession, folder: str) -> DataFrame:
    """Other clip length and tail limit, over all orders as durations."""
    o = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 1009).alias("d"))
    planned = plan_segments(o, "d", step=30.0, min_tail=10.0)
    return planned.groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n_clips"), F.max("end_sec").alias("last_end"))


@query("F21", sql="""
SELECT c.c_mktsegment, count(*) AS n_in_domain, least(CAST(floor(count(*) * 0.3 / (1 - 0.3)) AS BIGINT), any_value(p.n)) AS by_ratio,
       least(count(*), any_value(p.n)) AS same_size, least(200, any_value(p.n)) AS explicit
FROM customer c, (SELECT count(*) AS n FROM supplier) p GROUP BY 1""")
def mixing_target(spark: SparkSession, folder: str) -> DataFrame:
    """How many public rows to draw, by each of the three rules."""
    pool = table(spark, folder, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.col("n_in_domain")
    counts = table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_in_domain"))
    return counts.withColumn("_pool", pool).select(
        "c_mktsegment", "n_in_domain", values.mix_target(n, F.col("_pool"), mix_ratio=0.3).alias("by_ratio"),
        values.mix_target(n, F.col("_pool"), mix_ratio=None).alias("same_size"), values.mix_target(n, F.col("_pool"), explicit=200).alias("explicit"))


@query("V1", sql="""
SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 8) AS squared_length, round(u[1], 8) AS first, round(u[-1], 8) AS last
FROM (SELECT vec_id, list_transform(v, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0), 1)) AS u
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors scaled to length 1."""
    e = table(spark, folder, "embeddings").select("vec_id", unit("embedding").alias("u"))
    squares = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("vec_id", F.round(squares, 8).alias("squared_length"), F.round(F.col("u")[0], 8).alias("first"), F.round(F.element_at("u", -1), 8).alias("last"))
