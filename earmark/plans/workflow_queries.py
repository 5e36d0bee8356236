"""The main workflows end to end over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earmark.constants import DEFAULT_QUERIES, LABEL_COLUMNS, TEMPO_LABELS, TEMPO_PROMPTS, TEMPO_QUERY_TEXTS
from earmark.functions.encoders import encode_column, hash_encoder
from earmark.functions.values import bin_value
from earmark.plans import corpus, gold_evaluation, public_manifests, tempo_evaluation
from earmark.plans import standins as s
from earmark.plans.incremental_queries import _VEC
from earmark.plans.merging_queries import GOLD_SQL, _gold
from earmark.plans.registry import query, table
from earmark.session import pin, scratch_path
from earmark.sources.jsonl import read_queries
from earmark.sources.stores import embedding_rows


def _encode(df: DataFrame, column: str, vector: str) -> DataFrame:
    return encode_column(df, column, vector, hash_encoder())


_PROMPTS = ", ".join(
    [f"('{q}', '{t.removesuffix(' music')}')" for q, _, _, t in DEFAULT_QUERIES] + [f"('tempo_{t}', '{p}')" for t, p in zip(TEMPO_LABELS, TEMPO_QUERY_TEXTS, strict=True)])

_GOLD_EVAL = GOLD_SQL + f""", prompts(query_id, query_text) AS (VALUES {_PROMPTS}),
captions AS (SELECT audio, trim(text, E' \\t\\n\\r') || '. mood: ' || mood AS caption FROM catalogue WHERE confidence >= 0.35),
pool AS (SELECT g.*, u AS vec FROM gold g JOIN (
  SELECT audio, list_transform(v, lambda x: CAST(CAST(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT) AS DOUBLE)) AS u
  FROM (SELECT audio, {_VEC.format('caption')} AS v FROM captions)) ON audio = source_path),
scored AS (
  SELECT p.query_id, pool.source_path, round(list_cosine_similarity({_VEC.format('p.query_text')}, vec), 9) AS score,
         CASE p.query_id WHEN 'inst_piano' THEN inst_piano = 1 WHEN 'mood_epic' THEN mood_epic = 1 ELSE coalesce('tempo_' || tempo_bin_bpm = p.query_id, FALSE) END AS rel
  FROM prompts p CROSS JOIN pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_path) AS rank FROM scored),
m AS (SELECT query_id, count(*) AS n_pool, count(*) FILTER (WHERE rel) AS n_positive, count(*) FILTER (WHERE rel AND rank <= 10) AS hits,
             coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= 10), 0) AS dcg, least(10, count(*)) AS k_eff FROM ranked GROUP BY 1),
i AS (SELECT *, coalesce((SELECT sum(1 / log2(j + 1)) FROM range(1, 11) t(j) WHERE j <= least(k_eff, n_positive)), 0) AS idcg FROM m),
tempo AS (SELECT t.tempo_bin_bpm AS truth, CASE WHEN bpm_mean < 80 THEN 'slow' WHEN bpm_mean <= 120 THEN 'mid-tempo' ELSE 'fast' END AS pred FROM pool t WHERE tempo_bin_bpm IS NOT NULL)
SELECT query_id, n_pool, n_positive, round(hits / k_eff, 8) AS precision_at_k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 8) AS ndcg_at_k,
       (SELECT round(avg(CAST(truth = pred AS DOUBLE)), 8) FROM tempo) AS tempo_accuracy, (SELECT count(*) FROM tempo) AS tempo_n_songs
FROM i"""


@query("V9", "J8", "S19", "A10", "F6", "S12", sql=_GOLD_EVAL)
def gold_evaluation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata index, nested gold rows, style and tempo queries, and tempo agreement on every row."""
    meta = s.catalogue(spark, folder).select("audio", "text", "mood", "confidence")
    index = pin(embedding_rows(meta, _encode, 0.35)).select(F.col("audio").alias("item_id"), "audio", F.col("embedding").alias("item_vec"))
    gold = pin(_gold(spark, folder)).withColumn("_ord", F.lit(0))
    matrix = gold_evaluation.gold_matrix(index, gold, read_queries(spark), _encode, (10,), LABEL_COLUMNS, with_tempo_metrics=True)
    return matrix.select(
        "query_id", "n_pool", "n_positive", F.round("precision_at_k", 8).alias("precision_at_k"), F.round("ndcg_at_k", 8).alias("ndcg_at_k"),
        F.round("tempo_accuracy", 8).alias("tempo_accuracy"), "tempo_n_songs")


@query("F19", "J1", "P1", "W3", "A3", "A7", sql="WITH " + s.CATALOGUE + """,
merged AS (SELECT audio, CASE WHEN l.quality = 1 THEN 0.9::DOUBLE ELSE c.confidence END AS confidence, n_chars FROM catalogue c LEFT JOIN labels l USING (doc_id)
           WHERE l.quality = 1 OR c.confidence > 0.35),
n AS (SELECT audio, CAST(floor(n_chars / 150.0) AS BIGINT) + CASE WHEN n_chars / 10.0 - floor(n_chars / 150.0) * 15.0 >= 5.0 THEN 1 ELSE 0 END AS n FROM merged WHERE confidence > 0.5),
g AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('42:' || replace(audio, 'data/music_db/', '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE n > 0)
SELECT CAST(sum(n) AS BIGINT) AS matched_segment_rows, CAST(sum(n) FILTER (WHERE before < t) AS BIGINT) AS val_rows, CAST(sum(n) FILTER (WHERE before >= t) AS BIGINT) AS train_rows,
       count(*) AS group_count_sources, 0 AS unmatched_segment_rows
FROM g, (SELECT greatest(1, round_even(sum(n) * 0.1::DOUBLE, 0)) AS t FROM g)""")
def corpus_split_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed metadata to clips to train and validation manifests, as the summary row of the run."""
    rows = s.labelled(spark, folder)
    auto = rows.select("audio", "text", "mood", "confidence", F.col("doc_id").alias("_ord"))
    human = rows.filter(F.col("quality") == 1).select("audio", "text", "mood", F.lit(0.9).alias("confidence"), F.col("doc_id").alias("_ord"))
    meta = pin(corpus.reviewed_metadata(auto.limit(0), auto, human)).withColumn("_ord", F.lit(0))
    files = rows.select(F.col("audio").alias("path"), (F.col("n_chars") / 10.0).alias("length_sec"))
    _, _, summary = corpus.train_val_manifests(corpus.segment_map(files, meta, 0.5), meta)
    return summary.withColumn("unmatched_segment_rows", F.col("unmatched_segment_rows").cast("int"))


def _mix_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Public rows, what is held out of them, and the rows of the home domain."""
    rows = s.labelled(spark, folder).filter(F.col("quality").isNotNull())
    public = rows.select(
        F.concat_ws("/", "source", "doc_id").alias("audio_path"), F.col("quality").alias("gold_pub_piano"), F.col("toxic").alias("gold_pub_vocal"),
        (F.col("mood") == "fr").cast("int").alias("gold_pub_relaxing"), "mood")
    holdout = public.filter(F.col("mood") == "de").select("audio_path")
    home = table(spark, folder, "part").select(F.concat(F.lit("home/"), "p_partkey").alias("audio_path"), F.col("p_name").alias("text"))
    return public, holdout, home


@query("J7", "M1", "U1", "F14", "A7", sql="""
WITH cand AS (SELECT d.doc_id, quality, toxic, lang = 'fr' AS relax FROM documents d JOIN labels USING (doc_id) WHERE (quality = 1 OR toxic = 1 OR lang = 'fr') AND lang <> 'de'),
n AS (SELECT (SELECT count(*) FROM part) AS home, (SELECT count(*) FROM cand) AS pool)
SELECT 'home' AS domain, home AS n FROM n UNION ALL SELECT 'public', least(pool, CAST(floor(home * 0.05 / 0.95) AS BIGINT)) FROM n""")
def mixed_corpus_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates without hold-out, sampled to the mixing ratio, merged with the home rows, counted per domain."""
    public, holdout, home = _mix_inputs(spark, folder)
    candidates = corpus.public_candidates(public, holdout)
    return corpus.domain_counts(corpus.mixed_manifest(home, {"public": candidates}, mix_ratio=0.05))


_TEMPO = "CASE WHEN {0} < 80 THEN 'slow' WHEN {0} <= 120 THEN 'mid-tempo' ELSE 'fast' END"
_TEMPO_SCORES = ", ".join(
    f"round(list_cosine_similarity({_VEC.format(repr(p))}, {_VEC.format('path')}), 9) AS s{i}" for i, p in enumerate(TEMPO_PROMPTS))
_TEMPO_BEST = "CASE WHEN {0}s0 >= {0}s1 AND {0}s0 >= {0}s2 THEN 'slow' WHEN {0}s1 >= {0}s2 THEN 'mid-tempo' ELSE 'fast' END"
_TEMPO_METRICS = """classes AS (SELECT unnest(['slow', 'mid-tempo', 'fast']) AS l),
f AS (SELECT l, count(*) FILTER (WHERE gt = l AND pred = l) AS tp, count(*) FILTER (WHERE gt = l) AS sup, count(*) FILTER (WHERE pred = l) AS pre FROM classes, pairs GROUP BY l),
f1 AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (sup + pre) ELSE 0 END AS f1 FROM f)"""


@query("V9", "V12", "R1", "F13", "A10", "S16", sql=f"""
WITH m AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN ' ' ELSE 'c' || event_id || '.mp3' END AS audio, '/clips/c' || event_id || '.mp3' AS path, event_type, user_id, value FROM events),
old AS (SELECT {_TEMPO.format('value')} AS gt, {_TEMPO.format('(value * 1.5)')} AS pred FROM m WHERE user_id % 4 = 0 AND event_type <> 'signup'),
work AS (SELECT *, {_TEMPO_SCORES} FROM m WHERE user_id % 4 <> 0 OR event_type = 'signup'),
new AS (SELECT CASE WHEN event_type = 'signup' THEN 'missing_audio_field' WHEN event_type = 'error' THEN 'missing_file' WHEN value > 450 THEN 'bpm_error' ELSE 'ok' END AS status,
  {_TEMPO.format('value')} AS gt, {_TEMPO_BEST.format('')} AS pred FROM work),
pairs AS (SELECT gt, pred FROM old UNION ALL SELECT gt, pred FROM new WHERE status = 'ok'), {_TEMPO_METRICS},
overall AS (SELECT round(sum(tp) / sum(sup), 8) AS accuracy, round(avg(f1), 8) AS macro_f1 FROM f1)
SELECT status, CASE WHEN status = 'ok' THEN gt END AS gt_tempo, CASE WHEN status = 'ok' THEN pred END AS pred_tempo, count(*) AS n, any_value(accuracy) AS accuracy, any_value(macro_f1) AS macro_f1,
  (SELECT count(*) FROM old) AS num_resumed_predictions, (SELECT count(*) FROM new WHERE status = 'ok') AS num_new_predictions, (SELECT count(*) FROM new WHERE status <> 'ok') AS num_skipped_this_run
FROM new, overall GROUP BY 1, 2, 3""")
def clip_tempo_run(spark: SparkSession, folder: str) -> DataFrame:
    """Clips that the ledger lacks, measured, encoded and told apart by three prompts; outcomes counted, with metrics over old and new results."""
    e = table(spark, folder, "events")
    name = F.concat(F.lit("c"), "event_id", F.lit(".mp3"))
    manifest = e.select(F.when(F.col("event_type") == "signup", F.lit(" ")).otherwise(name).alias("audio_path"))
    known = e.filter((F.col("user_id") % 4 == 0) & (F.col("event_type") != "signup"))
    ledger = known.select(name.alias("audio_path"), F.lit("ok").alias("status"), bin_value("value").alias("gt_tempo"), bin_value(F.col("value") * 1.5).alias("pred_tempo"))
    path = F.concat(F.lit("/clips/"), name)
    inventory = e.filter(F.col("event_type") != "error").select(path.alias("path"))
    beats = e.select(path.alias("_p"), F.when(F.col("value") <= 450, F.col("value")).alias("bpm"))
    new = tempo_evaluation.clip_run(
        manifest, ledger, inventory, lambda df, p: df.join(beats, df[p] == beats["_p"]).drop("_p"), _encode, _encode, root="/clips")
    metrics = tempo_evaluation.run_metrics(ledger, new)
    row = metrics.select(F.struct("*")).scalar()
    counts = new.groupBy("status", "gt_tempo", "pred_tempo").agg(F.count(F.lit(1)).alias("n"))
    rounded = {c: F.round(row[c], 8) for c in ("accuracy", "macro_f1")}
    return counts.withColumns(rounded | {c: row[c] for c in ("num_resumed_predictions", "num_new_predictions", "num_skipped_this_run")})


@query("V9", "A8", "A10", "W4", sql=f"""
WITH ranked AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
clips AS (SELECT *, '/clips/s' || user_id || '/' || event_id || '.mp3' AS path FROM ranked WHERE i <= 3),
scored AS (SELECT *, {_TEMPO.format('value')} AS gt, {_TEMPO_SCORES} FROM clips),
told AS (SELECT *, {_TEMPO_BEST.format('')} AS pred FROM scored),
bad AS (SELECT user_id, arg_min(CASE WHEN event_type = 'signup' THEN 'bad_clip_path' WHEN event_type = 'error' THEN 'missing_file' ELSE 'bpm_error' END, i) AS why
  FROM clips WHERE event_type IN ('signup', 'error') OR value > 480 GROUP BY 1),
song AS (SELECT user_id, count(*) AS n, avg(value) AS bpm, avg(s0) AS s0, avg(s1) AS s1, avg(s2) AS s2, {", ".join(f"count(*) FILTER ({c} = '{t}') AS {c}{i}" for c in ("gt", "pred") for i, t in enumerate(TEMPO_LABELS))} FROM told GROUP BY 1),
done AS (SELECT user_id FROM ranked WHERE user_id % 7 = 0),
named AS (SELECT user_id, {", ".join(f"CASE WHEN {c}0 > {c}1 AND {c}0 > {c}2 THEN 'slow' WHEN {c}1 > {c}0 AND {c}1 > {c}2 THEN 'mid-tempo' WHEN {c}2 > {c}0 AND {c}2 > {c}1 THEN 'fast' ELSE {other} END AS {c}" for c, other in (("gt", _TEMPO.format("bpm")), ("pred", _TEMPO_BEST.format(""))))} FROM song)
SELECT 's' || user_id AS source_path, coalesce(why, 'ok') AS status, CASE WHEN why IS NULL THEN gt END AS gt_tempo_song, CASE WHEN why IS NULL THEN pred END AS pred_tempo_song
FROM named LEFT JOIN bad USING (user_id) WHERE user_id NOT IN (FROM done)""")
def song_tempo_run(spark: SparkSession, folder: str) -> DataFrame:
    """Tempo of songs by the votes of their first three clips; the first bad clip decides the status of a song."""
    e = table(spark, folder, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    first = e.withColumn("i", rank).filter("i <= 3")
    name = F.concat(F.lit("s"), "user_id", F.lit("/"), "event_id", F.lit(".mp3"))
    clip = F.when(F.col("event_type") == "signup", F.lit("  ")).otherwise(name)
    manifest = first.groupBy(F.concat(F.lit("s"), "user_id").alias("source_path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", clip.alias("clip")))), lambda c: c["clip"]).alias("eval_audio_paths"))
    ledger = e.filter(F.col("user_id") % 7 == 0).select(F.concat(F.lit("s"), "user_id").alias("source_path"))
    path = F.concat(F.lit("/clips/"), name)
    inventory = e.filter(F.col("event_type") != "error").select(path.alias("path"))
    beats = e.select(path.alias("_p"), F.when(F.col("value") <= 480, F.col("value")).alias("bpm"))
    new = tempo_evaluation.song_run(manifest, ledger, inventory, lambda df, p: df.join(beats, df[p] == beats["_p"]).drop("_p"), _encode, _encode, root="/clips")
    return new.select("source_path", "status", "gt_tempo_song", "pred_tempo_song")


@query("S7", "S9", "M2", "P4", "A5", "J13", sql="""
WITH wide AS (SELECT 'k' || p_partkey AS id, CASE WHEN p_size = 1 THEN '' ELSE 'a/' || p_partkey || '.mp3' END AS rel, CAST(p_name LIKE '%ring%' AS INT) AS a,
    CAST(p_name LIKE '%bolt%' OR p_name LIKE '%blue%' AS INT) AS b, CAST(p_name LIKE '%small%' AS INT) AS c, p_size FROM part),
pick AS (SELECT id FROM wide WHERE rel <> '' AND a = 1 QUALIFY row_number() OVER (ORDER BY md5('42:' || id)) <= 25
  UNION SELECT id FROM wide WHERE rel <> '' AND b = 1 QUALIFY row_number() OVER (ORDER BY md5('42:' || id)) <= 25
  UNION SELECT id FROM wide WHERE rel <> '' AND c = 1 QUALIFY row_number() OVER (ORDER BY md5('42:' || id)) <= 25),
long AS (SELECT 'p' || l_partkey AS id, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS b FROM lineitem WHERE l_discount * 10 >= 0.5 GROUP BY 1),
drawn AS (SELECT id FROM long WHERE a = 1 QUALIFY row_number() OVER (ORDER BY md5('42:' || id)) <= 25 UNION SELECT id FROM long WHERE b = 1 QUALIFY row_number() OVER (ORDER BY md5('42:' || id)) <= 25)
SELECT 'mtat' AS dataset, id, a AS gold_pub_piano, b AS gold_pub_vocal, c AS gold_pub_relaxing,
  CASE WHEN p_size % 3 = 0 THEN '/w/mp3s/' || rel WHEN p_size % 3 = 1 THEN '/w/' || rel END AS audio_path FROM wide WHERE id IN (FROM pick)
UNION ALL SELECT 'openmic', id, a, b, 0, CASE WHEN substr(id, -1) < '5' THEN '/o/audio/' || substr(id, 1, 3) || '/' || id || '.wav' END FROM long WHERE id IN (FROM drawn)""")
def public_manifests_build(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of annotation table from files to manifests: labels, sample with a cap per label, and the files that are there."""
    p = table(spark, folder, "part")
    relative = F.when(F.col("p_size") == 1, F.lit("")).otherwise(F.concat(F.lit("a/"), "p_partkey", F.lit(".mp3")))
    flags = {"piano": "ring", "vocals": "bolt", "voice": "blue", "calm": "small"}
    wide_path, long_path = scratch_path(spark, "wide"), scratch_path(spark, "long")
    p.select(F.concat(F.lit("k"), "p_partkey").alias("clip_id"), *[F.col("p_name").contains(w).cast("int").cast("string").alias(c) for c, w in flags.items()], relative.alias("mp3_path")).write.option(
        "header", True).option("sep", "\t").csv(wide_path)
    line = table(spark, folder, "lineitem")
    instrument = F.when(F.col("l_returnflag") == "A", "piano").when(F.col("l_returnflag") == "R", "voice").otherwise("drums")
    line.select(F.concat(F.lit("p"), "l_partkey").alias("sample_key"), instrument.alias("instrument"), (F.col("l_discount") * 10).alias("relevance")).write.option("header", True).csv(long_path)
    beside = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/w/mp3s/"), relative)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/w/"), relative)).otherwise(F.concat(F.lit("/w/mp3/"), relative))
    files = p.select(beside.alias("path"), F.when(F.col("p_size") % 3 == 2, 0).otherwise(9).alias("length"))
    key = F.concat(F.lit("p"), "l_partkey")
    sounds = line.filter(F.substring(key, -1, 1) < "5").select(F.concat(F.lit("/o/audio/"), F.substring(key, 1, 3), F.lit("/"), key, F.lit(".wav")).alias("path"), F.lit(1).alias("length"))
    wide = public_manifests.read_wide_manifest(spark, wide_path, files, "/w", cap=25)
    long = public_manifests.read_long_manifest(spark, long_path, sounds, "/o", cap=25)
    columns = ["dataset", "id", *public_manifests.LABELS, "audio_path"]
    return wide.withColumnRenamed("clip_id", "id").select(*columns).unionByName(long.withColumnRenamed("sample_key", "id").select(*columns))


@query("A7", "J7", "M1", "F21", sql="""
WITH d AS (SELECT doc_id, doc_id % 2 AS side, lang, quality = 1 OR toxic = 1 OR lang = 'fr' AS any_label FROM documents JOIN labels USING (doc_id)),
n AS (SELECT (SELECT count(*) FROM part) AS home, count(*) FILTER (WHERE any_label AND lang <> 'de' AND side = 0) AS even, count(*) FILTER (WHERE any_label AND lang <> 'de' AND side = 1) AS odd,
  count(*) FILTER (WHERE lang = 'de') AS held FROM d),
t AS (SELECT *, CAST(floor(home * 0.05 / 0.95) AS BIGINT) AS asked FROM n), u AS (SELECT *, least(asked, even + odd) AS used FROM t)
SELECT unnest(['even_candidates', 'odd_candidates', 'home', 'total', 'holdout_paths', 'public_target_requested', 'public_target', 'domain_home', 'domain_public']) AS name,
  unnest([even, odd, home, home + used, held, asked, used, home, used]) AS n FROM u""")
def mixed_corpus_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of a mixed manifest made of two public sets: candidates of each, hold-out, target asked for and used, rows of each domain."""
    public, holdout, home = _mix_inputs(spark, folder)
    side = F.substring("audio_path", -1, 1).isin("0", "2", "4", "6", "8")
    candidates = {name: pin(corpus.public_candidates(public.filter(part), holdout)) for name, part in (("even", side), ("odd", ~side))}
    both = pin(candidates["even"].unionByName(candidates["odd"]))
    mixed = pin(corpus.mixed_manifest(home, {"public": both}, mix_ratio=0.05))
    return corpus.mixed_summary(home, candidates, holdout, mixed, mix_ratio=0.05)
