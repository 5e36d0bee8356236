"""Vector search, ranking metrics and classification metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.constants import PUBLIC_TAGS, TEMPO_LABELS
from earmark.functions.encoders import encode_column, hash_encoder
from earmark.functions.ranking import random_hit
from earmark.functions.values import bin_value
from earmark.functions.vectors import cosine
from earmark.operators import classification, evaluation, search
from earmark.plans import public_evaluation
from earmark.plans import standins as s
from earmark.plans.registry import query, table
from earmark.session import pin

K = 10


def _ranked(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return search.top_k(s.label_queries(spark, folder), s.items(spark, folder), k)


def _positives(spark: SparkSession, folder: str) -> DataFrame:
    return s.items(spark, folder).select(F.concat(F.lit("label_"), "label").alias("query_id"), "item_id")


_COUNTS = """counts AS (SELECT query_label, query_id, count(*) AS n_pool, count(*) FILTER (WHERE label = query_label) AS n_positive FROM scored GROUP BY 1, 2),
ks AS (SELECT unnest([5, 10, 20]) AS top_k),
grid AS (SELECT *, least(top_k, n_pool) AS k_eff FROM counts, ks),
found AS (
  SELECT g.query_id, g.top_k, any_value(n_pool) AS n_pool, any_value(n_positive) AS n_positive, any_value(k_eff) AS k_eff,
         count(*) FILTER (WHERE r.label = r.query_label) AS hits,
         coalesce(sum(1 / log2(r.rank + 1)) FILTER (WHERE r.label = r.query_label), 0) AS dcg
  FROM grid g JOIN ranked r ON r.query_id = g.query_id AND r.rank <= g.top_k GROUP BY 1, 2),
ideal AS (
  SELECT *, (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i) WHERE i <= least(f.k_eff, f.n_positive)) AS idcg,
         (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i) WHERE i <= f.k_eff) AS all_places FROM found f)"""


@query("V9", "V3", "V4", "V5", "V6", "V7", "V8", "W1", "A9", sql="WITH " + s.RANKED + ", " + _COUNTS + """
SELECT query_id, CAST(top_k AS INTEGER) AS top_k, n_pool, n_positive, round(n_positive / n_pool, 8) AS prevalence,
       round(hits / k_eff, 8) AS precision_at_k, round(hits / k_eff - n_positive / n_pool, 8) AS precision_delta,
       round(dcg / idcg, 8) AS ndcg_at_k, round(n_positive / n_pool * all_places / idcg, 8) AS ndcg_random_mean,
       round(dcg / idcg - n_positive / n_pool * all_places / idcg, 8) AS ndcg_delta,
       CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_at_k
FROM ideal""")
def label_retrieval_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: every label query over all item vectors, with metrics and random baselines at three cut-offs."""
    queries, ks = s.label_queries(spark, folder).select("query_id"), (5, 10, 20)
    matrix = evaluation.metric_matrix(queries, _ranked(spark, folder, max(ks)), _positives(spark, folder), s.items(spark, folder), ks)
    decimals = ("prevalence", "precision_at_k", "precision_delta", "ndcg_at_k", "ndcg_random_mean", "ndcg_delta")
    return matrix.select("query_id", "top_k", "n_pool", "n_positive", *[F.round(c, 8).alias(c) for c in decimals], "hit_at_k")


@query("T1", "W1", sql="WITH " + s.RANKED + """
SELECT query_id, item_id, label, CAST(rank AS INTEGER) AS rank, score FROM ranked WHERE rank <= 10""")
def nearest_items(spark: SparkSession, folder: str) -> DataFrame:
    """Best ten items per label query, with their payload."""
    best = _ranked(spark, folder)
    return best.join(s.items(spark, folder).select("item_id", "label"), "item_id").select("query_id", "item_id", "label", "rank", "score")


@query("T2", sql="WITH " + s.CENTROIDS + """, d AS (
  SELECT c.query_id, e.vec_id AS item_id, round(list_sum(list_transform(list_zip(c.query_vec, CAST(e.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance
  FROM centroids c CROSS JOIN embeddings e)
SELECT query_id, item_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) <= 5""")
def nearest_by_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Five items of least squared distance per label query."""
    best = search.top_k(s.label_queries(spark, folder), s.items(spark, folder), 5, metric="l2")
    return best.select("query_id", "item_id", (-F.col("score")).alias("distance"))


@query("V3", sql="WITH " + s.RANKED + """
SELECT query_id, count(*) AS n, round(avg(score), 8) AS mean_score, max(score) AS max_score, min(score) AS min_score FROM scored GROUP BY 1""")
def query_pool_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all items for every label query, summarised as they stream by."""
    scores = search.score_pool(s.label_queries(spark, folder), s.items(spark, folder))
    return scores.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


@query("A9", sql="WITH " + s.CENTROIDS + """
SELECT query_id, len(query_vec) AS dims, round(query_vec[1], 8) AS first, round(query_vec[-1], 8) AS last, round(list_sum(query_vec), 8) AS total FROM centroids""")
def label_mean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of every label."""
    q = s.label_queries(spark, folder)
    total = F.aggregate("query_vec", F.lit(0.0), lambda a, x: a + x)
    return q.select("query_id", F.size("query_vec").cast("bigint").alias("dims"), F.round(F.col("query_vec")[0], 8).alias("first"),
                    F.round(F.element_at("query_vec", -1), 8).alias("last"), F.round(total, 8).alias("total"))


_SELF = s.CENTROIDS + """, queries AS (
  SELECT vec_id AS query_id, list_transform(range(1, len(embedding) + 1), lambda i: 0.25::DOUBLE * embedding[i] + c.query_vec[i]) AS qv
  FROM embeddings JOIN centroids c USING (label)),
own AS (
  SELECT q.query_id, e.vec_id AS item_id, round(list_cosine_similarity(q.qv, CAST(e.embedding AS DOUBLE[])), 9) AS score
  FROM queries q CROSS JOIN embeddings e),
best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 5)"""


def _text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One query an item: its vector, drawn to the mean of its label."""
    pairs = s.items(spark, folder).join(s.label_queries(spark, folder).select("label", F.col("query_vec").alias("c")), "label")
    return pairs.select(F.col("item_id").alias("query_id"), F.zip_with("item_vec", "c", lambda x, y: 0.25 * x.cast("double") + y).alias("query_vec"))


@query("A20", sql="WITH " + _SELF + """
SELECT round(count(*) FILTER (WHERE query_id = item_id) / (SELECT count(*) FROM embeddings), 8) AS hit_rate FROM best""")
def self_retrieval_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of items that their own text vector finds among its five nearest."""
    best = search.top_k(_text_vectors(spark, folder), s.items(spark, folder), 5)
    n = s.items(spark, folder).agg(F.count(F.lit(1)).alias("n")).scalar()
    return evaluation.self_hit_rate(best, n).select(F.round("hit_rate", 8).alias("hit_rate"))


@query("T1", "A20", "W1", sql="WITH " + _SELF + """
SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM best""")
def nearest_by_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest of every item's text vector by the route for large sets of wide vectors: bytes scanned, what their bounds leave open scored."""
    return search.top_k(_text_vectors(spark, folder), s.items(spark, folder), 5, route="bounds")


@query("V12", sql="WITH " + s.RANKED + """, two AS (
  SELECT item_id, label, arg_max(query_label, score) AS pred, max(score, 2) AS best FROM scored GROUP BY 1, 2)
SELECT item_id, 'label_' || pred AS pred, round(best[1] - best[2], 9) AS margin FROM two""")
def zero_shot_label_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Most similar label of every item, with the labels cut into blocks of three."""
    out = classification.zero_shot_table(s.items(spark, folder), s.label_queries(spark, folder), "item_id", "item_vec", "query_id", "query_vec", block_bytes=3 * 64 * 8)
    return out.select("item_id", "pred", F.round("margin", 9).alias("margin"))


@query("A19", "V2", sql="WITH " + s.CENTROIDS + """
SELECT round(avg(list_cosine_similarity(c.query_vec, CAST(e.embedding AS DOUBLE[]))), 8) AS mean_similarity, count(*) AS n FROM embeddings e JOIN centroids c USING (label)""")
def mean_pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean similarity of every item with its paired vector."""
    pairs = s.items(spark, folder).join(s.label_queries(spark, folder).select("label", "query_vec"), "label")
    return pairs.agg(F.round(F.avg(cosine("item_vec", "query_vec")), 8).alias("mean_similarity"), F.count(F.lit(1)).alias("n"))


@query("V7", sql="""
WITH c AS (SELECT label, count(*) AS r, (SELECT count(*) FROM embeddings) AS n FROM embeddings GROUP BY 1), ks AS (SELECT unnest([1, 5, 10, 100]) AS k)
SELECT label, CAST(k AS INTEGER) AS top_k, round(CASE WHEN least(k, n) > n - r THEN 1.0
  ELSE 1 - list_aggregate(list_transform(range(0, least(k, n)), lambda i: (n - r - i) / (n - i)), 'product') END, 8) AS random_hit
FROM c, ks""")
def random_hit_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of a random hit per label and cut-off."""
    e = table(spark, folder, "embeddings")
    counts = e.groupBy("label").agg(F.count(F.lit(1)).alias("r")).withColumn("n", e.agg(F.count(F.lit(1)).alias("n")).scalar())
    grid = counts.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 100)])))
    return grid.select("label", "top_k", F.round(random_hit("n", "r", "top_k"), 8).alias("random_hit"))


@query("V8", sql="""
WITH RECURSIVE c AS (SELECT 'label_' || label AS query_id, count(*) AS r, (SELECT count(*) FROM embeddings) AS n FROM embeddings GROUP BY label),
draws AS (
  SELECT query_id, r, n, it, 0::BIGINT AS i, 0::BIGINT AS hits, 0.0::DOUBLE AS dcg FROM c, range(1, 65) t(it)
  UNION ALL
  SELECT query_id, r, n, it, i + 1, hits + CAST(hit AS BIGINT), dcg + CASE WHEN hit THEN 1 / log2(i + 2) ELSE 0 END FROM (
    SELECT *, CAST(('0x' || substr(md5('42:' || query_id || ':' || it || ':' || i), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0 < (r - hits) / (n - i) AS hit
    FROM draws WHERE i < 10))
SELECT query_id, round(avg(dcg / (SELECT sum(1 / log2(j + 1)) FROM range(1, 11) u(j) WHERE j <= r)), 8) AS ndcg_random_mean
FROM draws WHERE i = 10 GROUP BY 1""")
def random_ndcg_simulation(spark: SparkSession, folder: str) -> DataFrame:
    """Random baseline by seeded draws, the alternative to its closed form."""
    counts = evaluation.label_counts(s.label_queries(spark, folder).select("query_id"), _positives(spark, folder), s.items(spark, folder))
    return evaluation.random_ndcg_draws(counts, K, iterations=64).select("query_id", F.round("ndcg_random_mean", 8).alias("ndcg_random_mean"))


@query("V6", sql="WITH " + s.RANKED + """, graded AS (
  SELECT query_id, item_id, score, rank, CASE WHEN label = query_label THEN 3 WHEN abs(label - query_label) = 1 THEN 1 ELSE 0 END AS rel FROM ranked),
ideal AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS j FROM graded)
SELECT query_id, round(dcg / idcg, 8) AS ndcg_at_k FROM
  (SELECT query_id, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM graded WHERE rank <= 10 GROUP BY 1)
  JOIN (SELECT query_id, sum((pow(2, rel) - 1) / log2(j + 1)) AS idcg FROM ideal WHERE j <= 10 GROUP BY 1) USING (query_id)""")
def graded_ranking_quality(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG with graded relevance: own label 3, neighbouring label 1."""
    items = s.items(spark, folder).select("item_id", "label")
    near = items.withColumn("query_label", F.explode(F.array(F.col("label") - 1, F.col("label"), F.col("label") + 1)))
    labels = items.select(F.col("label").alias("query_label")).distinct()
    graded = near.join(labels, "query_label").select(
        F.concat(F.lit("label_"), "query_label").alias("query_id"), "item_id",
        F.when(F.col("label") == F.col("query_label"), 3.0).otherwise(1.0).alias("relevance"))
    return evaluation.graded_ndcg(_ranked(spark, folder), graded, K).select("query_id", F.round("ndcg_at_k", 8).alias("ndcg_at_k"))


_HASHED = """hashed AS (
  SELECT d.doc_id, l.quality, l.toxic, d.n_chars > 1000 AS long,
         list_transform(range(0, 8), lambda i: CAST(CAST(('0x' || substr(md5(d.text), 2 * i + 1, 2)) AS INTEGER) / 255.0::DOUBLE - 0.5 AS FLOAT)) AS vec
  FROM documents d JOIN labels l USING (doc_id))"""


def _prompt_sql(text: str) -> str:
    return (f"list_transform(range(0, 8), lambda i: CAST(CAST(('0x' || substr(md5({text}), 2 * i + 1, 2)) AS INTEGER) / 255.0::DOUBLE - 0.5 AS FLOAT))")


def _hashed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as a stored embedding table: encoded once, then read by column."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    flat = rows.select(F.col("doc_id").alias("item_id"), "text", "quality", "toxic", (F.col("n_chars") > 1000).cast("int").alias("long"))
    return pin(encode_column(flat, "text", "item_vec", hash_encoder()).drop("text"))


def _prompts(spark: SparkSession, specs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(specs, "query_id STRING, query_text STRING")


_METRIC_SQL = """, s AS (
  SELECT q.query_id, h.doc_id, q.rel_kind, CASE q.rel_kind WHEN 'quality' THEN quality = 1 WHEN 'toxic' THEN toxic = 1 WHEN 'both' THEN quality <> 0 AND toxic <> 0
           ELSE quality <> 0 AND toxic <> 0 AND long END AS rel,
         round(list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(h.vec AS DOUBLE[])), 9) AS score FROM q CROSS JOIN hashed h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
m AS (SELECT query_id, count(*) AS n_pool, count(*) FILTER (WHERE rel) AS n_positive, count(*) FILTER (WHERE rel AND rank <= 10) AS hits,
             coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= 10), 0) AS dcg,
             least(10, count(*)) AS k_eff FROM r GROUP BY 1),
i AS (SELECT *, coalesce((SELECT sum(1 / log2(j + 1)) FROM range(1, 11) t(j) WHERE j <= least(k_eff, n_positive)), 0) AS idcg FROM m)
SELECT query_id, n_pool, n_positive, round(hits / k_eff, 8) AS precision_at_k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 8) AS ndcg_at_k FROM i"""


def _matrix(prompts: DataFrame, pool: DataFrame, positives: DataFrame) -> DataFrame:
    ranked = search.top_k(encode_column(prompts, "query_text", "query_vec", hash_encoder()), pool, K)
    rows = evaluation.metric_matrix(prompts.select("query_id"), ranked, positives, pool, [K])
    return rows.select("query_id", "n_pool", "n_positive", F.round("precision_at_k", 8).alias("precision_at_k"), F.round("ndcg_at_k", 8).alias("ndcg_at_k"))


@query("V10", sql="WITH " + _HASHED + f""", q AS (
  SELECT 'quality' AS query_id, 'quality' AS rel_kind, {_prompt_sql("'piano'")} AS vec UNION ALL SELECT 'toxic', 'toxic', {_prompt_sql("'vocal'")})""" + _METRIC_SQL)
def public_label_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt queries over encoded documents, one label column each."""
    pool = _hashed_documents(spark, folder)
    positives = evaluation.label_positives(pool, "item_id", ["quality", "toxic"])
    return _matrix(_prompts(spark, [("quality", "piano"), ("toxic", "vocal")]), pool.select("item_id", "item_vec"), positives)


@query("V10", "A14", sql="WITH " + _HASHED + f""", bridge AS (
  SELECT * FROM (VALUES {", ".join(f"('{d}', '{q}', '{c}', {_prompt_sql(repr(t))})" for d, tags in PUBLIC_TAGS.items() for q, c, t in tags)}) b(dataset, query_id, label, vec)),
pools AS (SELECT *, ['jamendo', 'mtat', 'openmic'][doc_id % 3 + 1] AS dataset FROM hashed),
s AS (SELECT p.dataset, b.query_id, p.doc_id, CASE b.label WHEN 'gold_pub_piano' THEN quality = 1 WHEN 'gold_pub_vocal' THEN toxic = 1 ELSE long END AS rel,
        round(list_cosine_similarity(CAST(b.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[])), 9) AS score FROM bridge b JOIN pools p USING (dataset)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, doc_id) AS rank FROM s),
m AS (SELECT dataset, query_id, count(*) AS n_pool, count(*) FILTER (WHERE rel) AS n_positive, count(*) FILTER (WHERE rel AND rank <= 10) / least(10, count(*)) AS p FROM r GROUP BY 1, 2)
SELECT dataset, query_id, n_pool, n_positive, round(p, 8) AS precision_at_k, round(p - n_positive / n_pool, 8) AS precision_delta FROM m
UNION ALL SELECT 'macro', query_id, count(*), NULL, round(avg(p), 8), round(avg(p - n_positive / n_pool), 8) FROM m GROUP BY query_id""")
def public_sets_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All public sets with the tags that each has, and the mean over the sets that have the tag."""
    pool = _hashed_documents(spark, folder).select(
        F.get(F.array(*[F.lit(d) for d in PUBLIC_TAGS]), (F.col("item_id") % 3).cast("int")).alias("dataset"), "item_id", "item_vec",
        F.col("quality").alias("gold_pub_piano"), F.col("toxic").alias("gold_pub_vocal"), F.col("long").alias("gold_pub_relaxing"))
    matrix = pin(public_evaluation.public_matrix(pool, public_evaluation.tag_bridge(spark), lambda df, text, vec: encode_column(df, text, vec, hash_encoder())))
    macro = public_evaluation.macro_rows(matrix, ["precision_at_k", "precision_delta"])
    rows = matrix.select("dataset", "query_id", "n_pool", "n_positive", "precision_at_k", "precision_delta").unionByName(
        macro.select(F.lit("macro").alias("dataset"), "query_id", F.col("n_datasets").alias("n_pool"), F.lit(None).cast("bigint").alias("n_positive"), "precision_at_k", "precision_delta"))
    return rows.withColumns({c: F.round(c, 8) for c in ("precision_at_k", "precision_delta")})


@query("V11", "P5", sql="WITH " + _HASHED + f""", q AS (
  SELECT 'quality' AS query_id, 'quality' AS rel_kind, {_prompt_sql("'piano'")} AS vec UNION ALL SELECT 'quality;toxic', 'both', {_prompt_sql("'piano vocal'")}
  UNION ALL SELECT 'quality;toxic;long', 'all', {_prompt_sql("'piano vocal relaxing'")})""" + _METRIC_SQL)
def composite_query_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts that grow by one tag; an item must have every tag of the prompt."""
    pool = _hashed_documents(spark, folder)
    specs = evaluation.prefix_queries([("quality", "piano"), ("toxic", "vocal"), ("long", "relaxing")])
    tags = spark.createDataFrame([(q, ids) for q, _, _, ids in specs], "query_id STRING, tag_ids ARRAY<STRING>")
    labels = pool.withColumn("labels", F.create_map(*[x for c in ("quality", "toxic", "long") for x in (F.lit(c), F.col(c))]))
    positives = evaluation.composite_positives(labels, "item_id", "labels", tags)
    return _matrix(_prompts(spark, [(q, phrase) for q, _, phrase, _ in specs]), pool.select("item_id", "item_vec"), positives)


@query("V9", "S12", sql="""
SELECT DISTINCT source || '' AS query_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')""")
def unlabelled_query_report(spark: SparkSession, folder: str) -> DataFrame:
    """Queries that name no label column and are therefore skipped."""
    queries = table(spark, folder, "documents").select(F.col("source").alias("query_id")).distinct()
    return evaluation.unlabelled_queries(queries, ["src1", "src2", "src3"])


@query("V12", sql="WITH " + s.RANKED + """, two AS (
  SELECT item_id, label, arg_max(query_label, score) AS pred, max(score, 2) AS best FROM scored GROUP BY 1, 2)
SELECT item_id, 'label_' || pred AS pred, round(best[1] - best[2], 9) AS margin FROM two""")
def zero_shot_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Most similar label of every item, with the margin over the second."""
    out = classification.zero_shot_table(s.items(spark, folder), s.label_queries(spark, folder), "item_id", "item_vec", "query_id", "query_vec")
    return out.select("item_id", "pred", F.round("margin", 9).alias("margin"))


_CONFUSION = """long AS (SELECT truth AS label, n, truth = pred AS same, 1 AS t FROM cm UNION ALL SELECT pred, n, truth = pred, 0 FROM cm),
per AS (SELECT label, CAST(sum(CASE WHEN same AND t = 1 THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN t = 1 THEN n ELSE 0 END) AS BIGINT) AS support,
               CAST(sum(CASE WHEN t = 0 THEN n ELSE 0 END) AS BIGINT) AS predicted FROM long GROUP BY 1),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)
SELECT label, support, round(p, 8) AS precision, round(r, 8) AS recall, round(f1, 8) AS f1,
       round(sum(tp) OVER () / sum(support) OVER (), 8) AS accuracy, round(avg(f1) OVER (), 8) AS macro_f1 FROM f"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("label", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")])


@query("A10", sql="""
WITH cm AS (SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2), """ + _CONFUSION)
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Class metrics of one label against another."""
    return _rounded(classification.class_metrics(classification.confusion_counts(table(spark, folder, "labels"), "quality", "toxic", [0, 1])))


_TEMPO = "CASE WHEN {0} < 80 THEN 'slow' WHEN {0} <= 120 THEN 'mid-tempo' ELSE 'fast' END"
_VOTES = f"""v AS (SELECT user_id, {_TEMPO.format('value')} AS l, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2),
m AS (SELECT user_id, max(n) AS top, CAST(sum(n) AS BIGINT) AS n_votes, sum(s) / sum(n) AS mean_value FROM v GROUP BY 1),
w AS (SELECT v.user_id, count(*) AS winners, min(l) AS l FROM v JOIN m USING (user_id) WHERE n = top GROUP BY 1),
songs AS (SELECT user_id, n_votes, CASE WHEN winners = 1 THEN l END AS majority, CASE WHEN winners = 1 THEN l ELSE {_TEMPO.format('mean_value')} END AS gt FROM m JOIN w USING (user_id))"""


def _song_tempo(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "value", bin_value("value").alias("tempo"))
    votes = classification.majority_vote(e, "user_id", "tempo", value="value")
    return votes.withColumn("gt_tempo", F.coalesce("majority", bin_value("mean_value")))


@query("A8", sql="WITH " + _VOTES + "\nSELECT user_id, n_votes, majority, gt AS gt_tempo FROM songs")
def tempo_majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Class of each group by majority; on a tie the class of its mean value."""
    return _song_tempo(spark, folder).select("user_id", "n_votes", "majority", "gt_tempo")


@query("A8", "A10", "V9", sql="WITH " + _VOTES + f""", last AS (SELECT user_id, {_TEMPO.format('arg_max(value, event_id)')} AS pred FROM events GROUP BY 1),
labels3 AS (SELECT unnest(['slow', 'mid-tempo', 'fast']) AS l),
cm AS (SELECT a.l AS truth, b.l AS pred, count(x.user_id) AS n FROM labels3 a CROSS JOIN labels3 b
       LEFT JOIN (SELECT user_id, gt, pred FROM songs JOIN last USING (user_id)) x ON x.gt = a.l AND x.pred = b.l GROUP BY 1, 2), """ + _CONFUSION)
def tempo_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Class metrics of the voted tempo against the class of the group's last value."""
    last = table(spark, folder, "events").groupBy("user_id").agg(bin_value(F.max_by("value", "event_id")).alias("pred"))
    both = _song_tempo(spark, folder).join(last, "user_id")
    return _rounded(classification.class_metrics(classification.confusion_counts(both, "gt_tempo", "pred", TEMPO_LABELS)))


_JUDGED = """judged AS (
  SELECT user_id AS query_id, 'type' || (user_id % 3) AS query_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank,
         CASE WHEN event_type <> 'error' THEN floor(value / 100) END AS rel FROM events),
top AS (SELECT * FROM judged WHERE rank <= 20 AND rel IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS j FROM top),
per AS (SELECT query_id, min(query_type) AS query_type, count(*) AS num_judged, avg(CAST(rel > 0 AS DOUBLE)) AS p, max(CAST(rel > 0 AS DOUBLE)) AS h,
               sum((pow(2, rel) - 1) / log2(i + 1)) AS dcg, sum((pow(2, rel) - 1) / log2(j + 1)) AS idcg FROM placed GROUP BY 1),
scored_queries AS (SELECT *, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS g FROM per)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    from earmark.operators.ordering import with_position

    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    ranked = with_position(e, ["user_id"], ["event_id"], "rank")
    return ranked.select(
        F.col("user_id").alias("query_id"), F.concat(F.lit("type"), F.col("user_id") % 3).alias("query_type"), "rank",
        F.when(F.col("event_type") != "error", F.floor(F.col("value") / 100).cast("double")).alias("relevance"))


@query("V4", "V5", "V6", sql="WITH " + _JUDGED + """
SELECT query_id, query_type, num_judged, round(p, 8) AS precision_at_k, round(h, 8) AS hitrate_at_k, round(g, 8) AS ndcg_at_k FROM scored_queries""")
def judged_query_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of judged rankings; unjudged rows are left out."""
    scores = evaluation.judged_scores(_judged(spark, folder), 20)
    return scores.select("query_id", "query_type", "num_judged", *[F.round(c, 8).alias(c) for c in ("precision_at_k", "hitrate_at_k", "ndcg_at_k")])


@query("A18", sql="WITH " + _JUDGED + """
SELECT coalesce(query_type, 'overall') AS query_type, count(*) AS queries, round(avg(p), 8) AS precision_at_k, round(avg(h), 8) AS hitrate_at_k,
       round(avg(g), 8) AS ndcg_at_k FROM scored_queries GROUP BY ROLLUP (query_type)""")
def judged_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Means of judged metrics per query type and overall."""
    rolled = evaluation.judged_rollup(evaluation.judged_scores(_judged(spark, folder), 20))
    return rolled.select(F.coalesce("query_type", F.lit("overall")).alias("query_type"), "queries",
                         *[F.round(c, 8).alias(c) for c in ("precision_at_k", "hitrate_at_k", "ndcg_at_k")])


@query("S17", "W1", sql="WITH " + s.RANKED + """
SELECT 'run1' AS run_id, query_id, item_id, CAST(rank AS INTEGER) AS rank, '' AS relevance, '' AS notes FROM ranked WHERE rank <= 10""")
def judging_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked candidates with blank cells for a judge."""
    from earmark.sources.tabular import judging_sheet as sheet

    return sheet(_ranked(spark, folder)).select(F.lit("run1").alias("run_id"), "query_id", "item_id", "rank", "relevance", "notes")
