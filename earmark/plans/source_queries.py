"""Readers and writers, exercised on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earmark.constants import LABEL_COLUMNS, TEMPO_LABELS
from earmark.functions.keys import resolve_path
from earmark.functions.values import bin_value
from earmark.operators.merging import caption_map, instrument_flags, join_numbered
from earmark.operators.ordering import keep_one
from earmark.plans import standins as s
from earmark.plans.registry import query, table
from earmark.session import scratch_path
from earmark.sources import jsonl, stores, tabular

TEMPO_SQL = "CASE WHEN {0} < 80 THEN 'slow' WHEN {0} <= 120 THEN 'mid-tempo' ELSE 'fast' END"


@query("S1", "S13", "F3", sql="""
SELECT doc_id, '/library/' || source || '/' || doc_id AS audio_path,
       md5(CASE WHEN lang = 'fr' THEN 'None' ELSE trim(text, E' \\t\\n\\r') END) AS text_md5
FROM documents WHERE lang NOT IN ('de', 'es')""")
def jsonl_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest lines with blank keys (de), broken lines (es), blank texts (fr), arrays and blank lines."""
    d = table(spark, folder, "documents")
    path = scratch_path(spark, "manifest")
    row = d.select(
        "lang", jsonl.as_json_line(
            "doc_id", F.when(F.col("lang") == "de", F.lit("  ")).otherwise(F.concat_ws("/", "source", "doc_id")).alias("audio_path"),
            F.when(F.col("lang") == "fr", F.lit(" \t")).otherwise(F.col("text")).alias("text")).alias("line"))
    good = row.select(F.when(F.col("lang") == "es", F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")).alias("value"))
    noise = d.select(F.when(F.col("lang") == "en", F.lit("[1]")).otherwise(F.lit("")).alias("value"))
    good.unionByName(noise).write.text(path)
    rows = jsonl.read_jsonl(spark, path, "doc_id BIGINT, audio_path STRING, text STRING")
    usable = jsonl.usable_manifest(rows, root="/library")
    return usable.select("doc_id", "audio_path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("S2", sql=f"""
WITH ledger AS (
  SELECT 'clip' || user_id AS audio, {TEMPO_SQL.format('value')} AS gt, {TEMPO_SQL.format('(value * 1.5)')} AS pred,
         CASE WHEN event_type = 'error' THEN 'bpm_error' ELSE 'ok' END AS status
  FROM events WHERE event_type <> 'signup')
SELECT gt AS gt_tempo, pred AS pred_tempo, count(*) AS n, (SELECT count(DISTINCT audio) FROM ledger) AS n_keys
FROM ledger WHERE status = 'ok' GROUP BY ALL""")
def ledger_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction ledger with broken lines (signup) and failed rows (error)."""
    e = table(spark, folder, "events")
    line = jsonl.as_json_line(
        F.concat(F.lit("clip"), "user_id").alias("audio"), F.col("value").alias("bpm"), bin_value("value").alias("gt_tempo"),
        bin_value(F.col("value") * 1.5).alias("pred_tempo"),
        F.when(F.col("event_type") == "error", "bpm_error").otherwise("ok").alias("status"))
    lines = e.select(F.when(F.col("event_type") == "signup", F.left(line, F.lit(20))).otherwise(line).alias("value"))
    path = scratch_path(spark, "ledger")
    lines.write.text(path)
    rows = jsonl.read_jsonl(spark, path, "audio STRING, bpm DOUBLE, gt_tempo STRING, pred_tempo STRING, status STRING")
    keys, valid = jsonl.split_ledger(rows, "audio", "gt_tempo", "pred_tempo", TEMPO_LABELS)
    return valid.groupBy("gt_tempo", "pred_tempo").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "n_keys", keys.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("S3", sql="""
SELECT p_partkey, p_name AS audio, p_type AS mood, round(p_size / 50.0, 2) AS confidence FROM part
UNION ALL SELECT p_partkey, p_brand, NULL, NULL FROM part""")
def json_array_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of two records, a number and a string each; only the records are rows."""
    p = table(spark, folder, "part")
    first = jsonl.as_json_line(F.col("p_name").alias("audio"), F.col("p_type").alias("mood"), F.round(F.col("p_size") / 50.0, 2).alias("confidence"))
    second = jsonl.as_json_line(F.col("p_brand").alias("audio"), F.lit(7).alias("other"))
    lines = p.select("p_partkey", F.concat(F.lit("["), first, F.lit(', 7, "x", '), second, F.lit("]")).alias("value"))
    return jsonl.parse_array(lines, "audio STRING, mood STRING, confidence DOUBLE")


@query("S4", sql="""
SELECT 'k' AS key, CAST(json_extract(props, '$.k') AS DOUBLE) AS payload, count(*) AS n FROM events
WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 2""")
def json_map_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Objects read as maps, one row per entry."""
    lines = table(spark, folder, "events").select(F.col("props").alias("value"))
    return jsonl.parse_object_map(lines, "double").groupBy("key", "payload").agg(F.count(F.lit(1)).alias("n"))


@query("S5", "S15", sql="""
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, printf('%.6f', p_retailprice / 7) AS price,
       coalesce(CAST(nullif(p_size, 7) AS VARCHAR), '') AS p_size
FROM part""")
def csv_sheet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed-column CSV with a byte-order mark, six-decimal cells and blanks for nulls, written and read."""
    p = table(spark, folder, "part").select(
        "p_partkey", "p_name", (F.col("p_retailprice") / 7).alias("price"), F.nullif("p_size", F.lit(7)).alias("p_size"))
    path = scratch_path(spark, "sheet")
    tabular.write_csv(p, path, ["p_partkey", "p_name", "price", "p_size"], bom=True)
    rows = tabular.read_csv(spark, path, required=("p_partkey", "price"))
    return rows.select("p_partkey", "p_name", "price", F.coalesce("p_size", F.lit("")).alias("p_size"))


@query("S6", "F12", sql="""
WITH sheet AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS query_id, 'user' AS query_type,
         CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS rank_cell,
         CASE WHEN value < 20 THEN NULL WHEN value < 40 THEN -1 WHEN value < 60 THEN NULL ELSE floor(value / 100) END AS rel
  FROM events)
SELECT query_id, CAST(rank_cell AS INTEGER) AS rank, count(*) AS n, count(*) FILTER (WHERE rel >= 0) AS n_judged,
       coalesce(sum(rel) FILTER (WHERE rel >= 0), 0) AS relevance_sum
FROM sheet WHERE trim(query_id) <> '' AND rank_cell <> 'n/a' GROUP BY ALL""")
def judgement_sheet_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Judgement sheet with blank ids, unreadable ranks, and blank, negative or unreadable relevance."""
    e = table(spark, folder, "events")
    relevance = (
        F.when(F.col("value") < 20, "").when(F.col("value") < 40, "-1").when(F.col("value") < 60, "unclear")
        .otherwise(F.floor(F.col("value") / 100).cast("string")))
    sheet = e.select(
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("query_id"), F.lit("user").alias("query_type"),
        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("user_id").cast("string")).alias("rank"), relevance.alias("relevance"))
    path = scratch_path(spark, "judged")
    tabular.write_csv(sheet, path, sheet.columns)
    rows = tabular.read_judgements(spark, path)
    return rows.groupBy("query_id", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.count("relevance").alias("n_judged"), F.coalesce(F.sum("relevance"), F.lit(0.0)).alias("relevance_sum"))


@query("S7", "P4", sql="""
SELECT p_partkey, CAST(p_name LIKE '%ring%' AS INTEGER) AS gold_pub_piano,
       CAST(p_name LIKE '%bolt%' OR p_name LIKE '%blue%' AS INTEGER) AS gold_pub_vocal,
       CAST(p_name LIKE '%small%' AS INTEGER) AS gold_pub_relaxing
FROM part""")
def wide_annotation_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Wide tab-separated annotations; several columns stand for one label."""
    from earmark.operators.filters import any_flag

    p = table(spark, folder, "part")
    flags = {"piano": "ring", "vocals": "bolt", "voice": "blue", "calm": "small"}
    wide = p.select(F.col("p_partkey").alias("clip_id"), *[F.col("p_name").contains(w).cast("int").cast("string").alias(c) for c, w in flags.items()],
                    F.concat(F.lit("a/"), "p_partkey", F.lit(".mp3")).alias("mp3_path"))
    path = scratch_path(spark, "annotations")
    wide.write.option("header", True).option("sep", "\t").csv(path)
    rows = tabular.read_wide_tsv(spark, path, required=("clip_id", "mp3_path", "piano"))
    return rows.select(
        F.col("clip_id").cast("bigint").alias("p_partkey"), any_flag(["piano"]).cast("int").alias("gold_pub_piano"),
        any_flag(["vocals", "voice"]).cast("int").alias("gold_pub_vocal"), any_flag(["calm"]).cast("int").alias("gold_pub_relaxing"))


@query("S8", sql="""
SELECT 't' || p_partkey AS track_id, 'a/b/' || p_partkey || '.mp3' AS path, round(p_retailprice, 2) AS duration,
       replace(p_name, ' ', ',') || ',' || replace(p_type, ' ', ',') AS tags
FROM part WHERE p_size >= 10""")
def ragged_tag_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of five fields and any number of tags; lines without a tag field are dropped."""
    p = table(spark, folder, "part")
    fixed = F.concat_ws("\t", F.concat(F.lit(" t"), "p_partkey"), "p_brand", F.lit("album"), F.concat(F.lit("a\\b/"), "p_partkey", F.lit(".mp3")),
                        F.round("p_retailprice", 2).cast("string"))
    tags = F.concat_ws("\t", F.replace("p_name", F.lit(" "), F.lit("\t ")), F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("\t")))
    path = scratch_path(spark, "tags")
    p.select(F.when(F.col("p_size") >= 10, F.concat_ws("\t", fixed, tags)).otherwise(fixed).alias("value")).write.text(path)
    return tabular.read_ragged_tsv(spark, path).select("track_id", "path", "duration", F.array_join("tags", ",").alias("tags"))


@query("S9", "A5", sql="""
SELECT CAST(l_partkey AS VARCHAR) AS sample_key, CAST(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS piano,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS voice
FROM lineitem WHERE l_discount * 10 >= 0.5 GROUP BY 1""")
def long_label_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Long annotations with a header in mixed case, cut at a relevance threshold, as flags per key."""
    line = table(spark, folder, "lineitem")
    instrument = F.when(F.col("l_returnflag") == "A", " Piano").when(F.col("l_returnflag") == "R", "voice ").otherwise("drums")
    path = scratch_path(spark, "long")
    line.select(F.col("l_partkey").alias("Sample_Key"), instrument.alias("Instrument"), (F.col("l_discount") * 10).alias("Relevance")) \
        .write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return instrument_flags(tabular.read_long_labels(spark, path, 0.5), {"piano": "piano", "voice": "voice"})


_PARTITIONED = r"/dataset=([^/]+)/arm=([^/]+)/seed=(\d+)/"


def _write_matrices(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "matrices")
    rows = s.metrics(spark, folder)
    rows.repartition("dataset", "arm", "seed").write.option("header", True).partitionBy("dataset", "arm", "seed").csv(path)
    return path


@query("S10", sql="WITH " + s.METRICS + """
SELECT dataset, arm, seed, query_id, top_k, n_pool, n_positive, round(precision_at_k, 8) AS precision_at_k FROM metrics""")
def metric_matrix_collection(spark: SparkSession, folder: str) -> DataFrame:
    """All matrix files in one scan, keys from the path; a gap in the grid would be an error."""
    path = _write_matrices(spark, folder)
    schema = "query_id STRING, n_positive BIGINT, n_pool BIGINT, precision_at_k DOUBLE, ndcg_delta DOUBLE, top_k INT"
    rows = tabular.read_matrices(spark, path, schema, _PARTITIONED)
    tabular.require_grid(rows, ("A", "N", "R"), ("pretrained", "home", "mixed"), (42, 43, 44))
    return rows.select("dataset", "arm", "seed", "query_id", "top_k", "n_pool", "n_positive", F.round("precision_at_k", 8).alias("precision_at_k"))


@query("S11", sql="WITH " + s.METRICS + """
SELECT dataset, count(DISTINCT arm || '/' || seed) AS n_folders FROM metrics GROUP BY dataset""")
def file_inventory_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory of a folder tree: distinct relative folders that hold a file with content."""
    path = _write_matrices(spark, folder)
    files = stores.file_inventory(spark, path).filter((F.col("length") > 0) & F.col("path").endswith(".csv"))
    parts = files.select(F.regexp_extract("path", r"dataset=([^/]+)/", 1).alias("dataset"), F.regexp_extract("path", r"/(arm=[^/]+/seed=\d+)/", 1).alias("f"))
    return parts.distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_folders"))


@query("S12", sql="""
SELECT source || '_' || doc_id AS query_id, lang AS query_type, source AS label, source || ' music' AS query_text
FROM documents WHERE lang NOT IN ('de', 'fr')""")
def query_set_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Query definitions; rows with a blank (de) or missing (fr) field are dropped."""
    d = table(spark, folder, "documents")
    text = F.when(F.col("lang") == "de", " ").when(F.col("lang") != "fr", F.concat(F.lit(" "), "source", F.lit(" music ")))
    line = jsonl.as_json_line(F.concat_ws("_", "source", "doc_id").alias("query_id"), F.col("lang").alias("query_type"), F.col("source").alias("label"), text.alias("query_text"))
    lines = d.select(line.alias("value"))
    return jsonl.valid_queries(jsonl.parse_lines(lines, "query_id STRING, query_type STRING, label STRING, query_text STRING"))


@query("S14", "T4", sql="""
SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, 0 AS n_overlapping_files
FROM orders GROUP BY 1""")
def keyed_sink_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written in key order: no two files overlap in their key range."""
    path = scratch_path(spark, "keyed")
    jsonl.write_keyed(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderkey")
    rows = spark.read.schema("o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE").json(path)
    from pyspark.sql import Window

    files = rows.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    after = files.withColumn("prev", F.max("hi").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)))
    overlaps = after.agg(F.count_if(F.col("lo") <= F.col("prev")).cast("int").alias("n"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")).withColumn(
        "n_overlapping_files", overlaps.scalar())


@query("S16", "J10", sql="""
WITH ledger AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'click' THEN 'ok' ELSE 'failed' END AS status
                FROM events WHERE event_type = 'click' OR (event_type = 'error' AND value > 200)),
work AS (SELECT DISTINCT c_custkey AS user_id FROM customer)
SELECT 'all_done' AS rule, user_id FROM work WHERE user_id NOT IN (SELECT user_id FROM ledger)
UNION ALL SELECT 'retry_failed', user_id FROM work WHERE user_id NOT IN (SELECT user_id FROM ledger WHERE status = 'ok')""")
def ledger_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger appended in two steps; what remains to do, with and without retrying failures."""
    from earmark.operators.merging import remaining

    e = table(spark, folder, "events")
    path = scratch_path(spark, "append")
    jsonl.append_ledger(e.filter(F.col("event_type") == "click").select("user_id", F.lit("ok").alias("status")), path)
    jsonl.append_ledger(e.filter((F.col("event_type") == "error") & (F.col("value") > 200)).select("user_id", F.lit("failed").alias("status")), path)
    ledger = jsonl.read_jsonl(spark, path, "user_id BIGINT, status STRING")
    work = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")).distinct()
    plain = remaining(work, ledger, "user_id").select(F.lit("all_done").alias("rule"), "user_id")
    return plain.unionByName(remaining(work, ledger, "user_id", retry_failed=True).select(F.lit("retry_failed").alias("rule"), "user_id"))


@query("S17", sql="""
SELECT 'doc' || doc_id || '.mp3' AS song_name, 'data/music_db/' || source || '/doc' || doc_id || '.mp3' AS source_path,
       '0' AS inst_piano, '0' AS mood_epic
FROM documents""")
def labelling_sheet_export(spark: SparkSession, folder: str) -> DataFrame:
    """Label sheet (CSV with mark) and its key file (JSON lines), written from one frame and joined by row key."""
    sheet = tabular.labelling_sheet(s.catalogue(spark, folder), source="audio").withColumn("row_key", F.md5(F.col("source_path").cast("binary")))
    sheet_path, side_path = scratch_path(spark, "labels"), scratch_path(spark, "sidecar")
    tabular.write_csv(sheet, sheet_path, ["song_name", *LABEL_COLUMNS, "row_key"], bom=True)
    jsonl.write_jsonl(sheet.select("row_key", "song_name", "source_path"), side_path)
    cells = tabular.read_csv(spark, sheet_path, required=("song_name", *LABEL_COLUMNS))
    keys = jsonl.read_jsonl(spark, side_path, "row_key STRING, source_path STRING", strict=True)
    return cells.join(keys, "row_key").select("song_name", "source_path", "inst_piano", "mood_epic")


def _json_file(rows: DataFrame, group: str, order: str, element: str, brackets: str, last: str, path: str) -> None:
    """One JSON file for each value of ``group``: elements in order, each on lines of its own, between brackets. ``order`` is unique in a group.

    The first and the last row carry the brackets. In a union with rows for them the repartition would be left out where both sides are
    dealt by ``group`` already, and adaptive execution then coalesces each side by itself: a group would be in several files.
    """
    ends = rows.groupBy(group).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    lines = F.array(
        F.when(F.col(order) == F.col("_first"), F.lit(brackets[0])), F.concat(F.col(element), F.lit(",")), F.when(F.col(order) == F.col("_last"), F.lit(last + brackets[1])))
    whole = rows.join(ends, group).select(group, order, F.posexplode(lines).alias("_part", "value")).filter("value is not null")
    whole.repartition(group).sortWithinPartitions(group, order, "_part").select(group, "value").write.partitionBy(group).text(path)


@query("S3", "A1", sql="""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS place FROM documents)
SELECT doc_id, place, md5(coalesce(text, '')) AS text_md5, n_chars / 10.0 AS seconds FROM placed""")
def json_array_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one large array each, written with line breaks, brackets and commas in strings, cut into chunks and read by many tasks."""
    d = table(spark, folder, "documents").withColumn("part", F.col("doc_id") % 3)
    order = F.row_number().over(Window.partitionBy("part").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")))).cast("long")
    element = F.to_json(
        F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("n_chars") / 10.0).alias("seconds"), F.array(F.lit("a]"), F.lit('"[{,')).alias("tags")), {"pretty": "true"})
    path = scratch_path(spark, "arrays")
    _json_file(d.select("part", order.alias("o"), element.alias("element")), "part", "o", "element", "[]", '7, "x,{", [1, 2], null', path)
    rows = jsonl.read_json_array(spark, path, "doc_id BIGINT, text STRING, seconds DOUBLE", order="place", chunk=1 << 16)
    return rows.select("doc_id", F.col("place.place").alias("place"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "seconds")


@query("S4", sql="""
SELECT 'id "' || (p_partkey % 1500) || '"' AS key, arg_max(p_name, p_partkey) AS audio, arg_max(p_size, p_partkey) AS size FROM part GROUP BY 1""")
def json_map_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one large object each; of a repeated key the last entry counts."""
    p = table(spark, folder, "part")
    key = F.concat(F.lit('id "'), F.col("p_partkey") % 1500, F.lit('"'))
    payload = F.to_json(F.struct(F.col("p_name").alias("audio"), F.col("p_size").alias("size"), F.array(F.lit("}, {"), F.lit("\\")).alias("other")))
    quoted = F.concat(F.lit('"'), F.replace(key, F.lit('"'), F.lit('\\"')), F.lit('": '), payload)
    path = scratch_path(spark, "maps")
    _json_file(p.select(F.lit(0).alias("part"), F.col("p_partkey").alias("o"), quoted.alias("element")), "part", "o", "element", "{}", '"none": null', path)
    rows = jsonl.read_json_map(spark, path, "struct<audio: string, size: int>", chunk=1 << 14)
    return rows.filter("payload is not null").select("key", "payload.audio", "payload.size")


def _shuffled_lines(rows: DataFrame, key: str, path: str) -> None:
    """JSON lines in the order of a digest of the key, over as many files as the sort makes."""
    rows.orderBy(F.md5(F.col(key).cast("string").cast("binary"))).write.json(path)


@query("A1", "A2", "J6", "J4", sql="""
WITH placed AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS o FROM documents),
said AS (SELECT source, arg_max(lang || doc_id, o) AS text FROM placed WHERE n_chars % 3 > 0 GROUP BY source)
SELECT source, arg_min(doc_id, o) AS first_id, arg_max(doc_id, o) AS last_id, count(*) - 1 AS n_duplicates, any_value(said.text) AS caption
FROM placed LEFT JOIN said USING (source) GROUP BY source""")
def file_order_rules(spark: SparkSession, folder: str) -> DataFrame:
    """First and last row of each repeated key, and the last caption that isn't blank, as the rows stand in the files."""
    d = table(spark, folder, "documents")
    path = scratch_path(spark, "ordered")
    caption = F.when(F.col("n_chars") % 3 > 0, F.concat("lang", "doc_id")).otherwise(" ")
    _shuffled_lines(d.select(F.col("source").alias("source_path"), "doc_id", caption.alias("text")), "doc_id", path)
    rows = jsonl.read_jsonl(spark, path, "source_path STRING, doc_id BIGINT, text STRING", order="_ord")
    first = keep_one(rows.select("source_path", F.col("doc_id").alias("first_id"), "_ord"), ["source_path"], ["_ord"]).drop("_ord")
    last = keep_one(rows.select("source_path", F.col("doc_id").alias("last_id"), "_ord"), ["source_path"], ["_ord"], "last", "n_duplicates").drop("_ord")
    captions = caption_map(rows, root="/").select(F.col("_key").alias("_song"), F.col("_new").alias("caption"))
    both = first.join(last, "source_path").join(captions, resolve_path("source_path", "/") == F.col("_song"), "left")
    return both.select(F.col("source_path").alias("source"), "first_id", "last_id", "n_duplicates", "caption")


@query("J3", "A7", sql="""
WITH a AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR))) - 1 AS line FROM part),
b AS (SELECT *, row_number() OVER (ORDER BY md5(p_partkey || '')) - 1 AS line FROM part)
SELECT a.line, a.p_partkey, b.p_name AS name FROM a JOIN b USING (line)""")
def numbered_line_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Two files side by side by line number; numbers come from counts of the blocks, no row is sorted."""
    p = table(spark, folder, "part")
    left, right = scratch_path(spark, "left"), scratch_path(spark, "right")
    _shuffled_lines(p.select("p_partkey"), "p_partkey", left)
    _shuffled_lines(p.select("p_partkey", F.col("p_name").alias("name")), "p_partkey", right)
    a = jsonl.read_jsonl(spark, left, "p_partkey BIGINT", line="line")
    b = jsonl.read_jsonl(spark, right, "name STRING", line="line")
    return join_numbered(a, b, "line")
