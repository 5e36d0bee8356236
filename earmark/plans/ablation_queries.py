"""Statistics over seeds and comparison tables over a whole metric matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.operators import ablation, filters
from earmark.plans import standins as s
from earmark.plans.registry import query, table
from earmark.session import pin

K = 10
BY = ["dataset", "arm", "query_id"]


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


@query("A11", sql="WITH " + s.METRICS + """
SELECT dataset, round(avg(precision_at_k), 8) AS precision_mean, round(stddev_pop(precision_at_k), 8) AS precision_stdev,
       round(avg(ndcg_delta), 8) AS finite_mean, round(coalesce(stddev_samp(ndcg_delta), 0), 8) AS finite_stdev, count(*) AS n_finite_finite
FROM metrics WHERE query_id = 'inst_piano' GROUP BY 1""")
def seed_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Population deviation, and sample deviation over finite values (NaN and infinite ones are left out)."""
    rows = s.metrics(spark, folder)
    noisy = F.when(F.col("query_id") == "inst_vocal", F.lit(float("nan"))).when(F.col("query_id") == "mood_relaxing", F.lit(float("-inf"))).otherwise(F.col("ndcg_delta"))
    piano = F.when(F.col("query_id") == "inst_piano", F.col("precision_at_k"))
    out = rows.groupBy("dataset").agg(*ablation.seed_stats(piano, "precision"), *ablation.finite_stats(noisy, "finite"))
    return _round(out, "precision_mean", "precision_stdev", "finite_mean", "finite_stdev")


@query("A11", sql="""
SELECT l_partkey, round(avg(l_discount), 8) AS discount_mean, round(stddev_pop(l_discount), 8) AS discount_stdev FROM lineitem GROUP BY 1""")
def statistics_at_volume(spark: SparkSession, folder: str) -> DataFrame:
    """The same statistics for many groups."""
    out = table(spark, folder, "lineitem").groupBy("l_partkey").agg(*ablation.seed_stats("l_discount", "discount"))
    return _round(out, "discount_mean", "discount_stdev")


_SUMMARY = s.METRICS + """, summary AS (
  SELECT dataset, arm, query_id, avg(precision_at_k) AS precision_mean, stddev_pop(precision_at_k) AS precision_stdev,
         avg(ndcg_delta) AS ndcg_delta_mean, stddev_pop(ndcg_delta) AS ndcg_delta_stdev, arg_min(n_positive, seed) AS n_positive,
         arg_min(n_pool, seed) AS n_pool, count(*) AS n_seeds FROM metrics GROUP BY 1, 2, 3)"""


@query("A12", sql="WITH " + _SUMMARY + """
SELECT dataset, arm, query_id, round(precision_mean, 8) AS precision_mean, round(precision_stdev, 8) AS precision_stdev,
       round(ndcg_delta_mean, 8) AS ndcg_delta_mean, round(ndcg_delta_stdev, 8) AS ndcg_delta_stdev, n_positive, n_pool, n_seeds FROM summary""")
def arm_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Seed statistics per data set, arm and tag."""
    out = ablation.arm_summary(s.metrics(spark, folder), BY, K)
    return _round(out, "precision_mean", "precision_stdev", "ndcg_delta_mean", "ndcg_delta_stdev")


@query("A13", "P9", sql="WITH " + _SUMMARY + """
SELECT dataset, query_id, round(b.precision_mean, 8) AS base_precision_mean, round(o.precision_mean, 8) AS other_precision_mean,
       round(b.precision_stdev, 8) AS base_precision_stdev, round(o.precision_mean - b.precision_mean, 8) AS delta_precision,
       round(o.ndcg_delta_mean - b.ndcg_delta_mean, 8) AS delta_ndcg, o.n_seeds,
       CASE WHEN o.precision_mean - b.precision_mean > 0.01 THEN 'LLM arm better' WHEN o.precision_mean - b.precision_mean < -0.01 THEN 'Original arm better'
            ELSE 'Roughly tied' END AS verdict
FROM summary b JOIN summary o USING (dataset, query_id) WHERE b.arm = 'home' AND o.arm = 'mixed'""")
def arm_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two arms side by side per data set and tag."""
    out = ablation.compare_arms(s.metrics(spark, folder), ["dataset", "query_id"], K, "home", "mixed")
    kept = ("base_precision_mean", "other_precision_mean", "base_precision_stdev", "delta_precision", "delta_ndcg")
    return _round(out, *kept).select("dataset", "query_id", *kept, "n_seeds", "verdict")


@query("J15", sql="WITH " + _SUMMARY + """
SELECT a.dataset, a.arm, a.query_id, round(a.precision_mean - b.precision_mean, 8) AS delta_precision,
       round(a.ndcg_delta_mean - b.ndcg_delta_mean, 8) AS delta_ndcg
FROM summary a JOIN summary b ON b.arm = 'pretrained' AND a.dataset = b.dataset AND a.query_id = b.query_id""")
def baseline_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Every arm minus the pretrained one."""
    summary = ablation.arm_summary(s.metrics(spark, folder), BY, K)
    out = ablation.baseline_delta(summary, ["dataset", "query_id"], "pretrained")
    return _round(out, "delta_precision", "delta_ndcg").select("dataset", "arm", "query_id", "delta_precision", "delta_ndcg")


_MACRO = _SUMMARY + """, macro AS (
  SELECT arm, query_id, avg(precision_mean) AS precision_mean, stddev_pop(precision_mean) AS precision_stdev, avg(ndcg_delta_mean) AS ndcg_delta_mean,
         string_agg(dataset || '=' || printf('%.6f', precision_mean), ';' ORDER BY dataset) AS by_dataset, count(*) AS n_datasets FROM summary GROUP BY 1, 2)"""


@query("A14", sql="WITH " + _MACRO + """
SELECT arm, query_id, round(precision_mean, 8) AS precision_mean, round(precision_stdev, 8) AS precision_stdev, by_dataset, n_datasets FROM macro""")
def macro_over_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over data sets of the seed means, with the value of each data set."""
    out = ablation.macro_over_datasets(s.metrics(spark, folder), K)
    entries = F.transform(F.map_entries("by_dataset"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    return _round(out, "precision_mean", "precision_stdev").select(
        "arm", "query_id", "precision_mean", "precision_stdev", F.array_join(entries, ";").alias("by_dataset"), "n_datasets")


@query("A15", "P8", sql="WITH " + _MACRO + """,
gold AS (SELECT arm, query_id, avg(precision_mean) AS p FROM (SELECT arm, query_id, seed, avg(precision_at_k) AS precision_mean FROM metrics WHERE dataset = 'A' GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT query_id, max(g.p) FILTER (WHERE g.arm = 'home') AS home_gold, max(g.p) FILTER (WHERE g.arm = 'mixed') AS mixed_gold,
             max(m.precision_mean) FILTER (WHERE m.arm = 'home') AS home_ood_macro, max(m.precision_mean) FILTER (WHERE m.arm = 'mixed') AS mixed_ood_macro,
             max(m.precision_mean) FILTER (WHERE m.arm = 'pretrained') AS pretrained_ood_macro FROM gold g JOIN macro m USING (arm, query_id) GROUP BY 1),
d AS (SELECT *, mixed_gold - home_gold AS gd, mixed_ood_macro - home_ood_macro AS od FROM t)
SELECT query_id, round(home_gold, 8) AS home_gold, round(mixed_gold, 8) AS mixed_gold, round(gd, 8) AS gold_delta, round(home_ood_macro, 8) AS home_ood_macro,
       round(mixed_ood_macro, 8) AS mixed_ood_macro, round(od, 8) AS ood_delta, round(pretrained_ood_macro, 8) AS pretrained_ood_macro,
       CASE WHEN gd >= -0.05 AND od >= CASE WHEN query_id = 'inst_vocal' THEN 0.15 ELSE 0.10 END THEN 'Forgetting-dominated (mixed recovers OOD)'
            WHEN gd >= 0.10 AND od <= -0.05 THEN 'Specialization (anime-only wins in-domain)' WHEN gd <= -0.05 AND od <= -0.05 THEN 'Mixed hurts both — check ratio / leakage'
            ELSE 'No clear tradeoff — arms similar' END AS interpretation
FROM d""")
def domain_tradeoff_table(spark: SparkSession, folder: str) -> DataFrame:
    """Two training arms in the home domain and outside it, with the reading per tag."""
    rows = pin(s.metrics(spark, folder))
    out = ablation.tradeoff_table(rows.filter(F.col("dataset") == "A"), rows, K, "home", "mixed")
    kept = ("home_gold", "mixed_gold", "gold_delta", "home_ood_macro", "mixed_ood_macro", "ood_delta", "pretrained_ood_macro")
    return _round(out, *kept).select("query_id", *kept, "interpretation")


@query("P8", sql="""
WITH d AS (SELECT event_id, value / 1000 - 0.2 AS gd, user_id / 400.0::DOUBLE - 0.13 AS od, CASE WHEN event_type = 'view' THEN 'inst_vocal' ELSE 'inst_piano' END AS tag FROM events)
SELECT event_id, CASE WHEN gd >= -0.05 AND od >= CASE WHEN tag = 'inst_vocal' THEN 0.15 ELSE 0.10 END THEN 'Forgetting-dominated (mixed recovers OOD)'
  WHEN gd >= 0.10 AND od <= -0.05 THEN 'Specialization (anime-only wins in-domain)' WHEN gd <= -0.05 AND od <= -0.05 THEN 'Mixed hurts both — check ratio / leakage'
  ELSE 'No clear tradeoff — arms similar' END AS interpretation,
  CASE WHEN gd > 0.01 THEN 'LLM arm better' WHEN gd < -0.01 THEN 'Original arm better' ELSE 'Roughly tied' END AS verdict
FROM d""")
def tradeoff_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every case of the trade-off rules and of the verdict."""
    e = table(spark, folder, "events")
    rows = e.select("event_id", (F.col("value") / 1000 - 0.2).alias("gd"), (F.col("user_id") / 400 - 0.13).alias("od"),
                    F.when(F.col("event_type") == "view", "inst_vocal").otherwise("inst_piano").alias("tag"))
    return rows.select("event_id", filters.tradeoff_label("gd", "od", "tag").alias("interpretation"), filters.verdict("gd").alias("verdict"))


_PER_QUERY = s.METRICS + """, q AS (SELECT *, dataset || '_' || query_id AS qid FROM metrics),
per_query AS (SELECT qid AS query_id, CASE WHEN arm = 'pretrained' THEN 'pretrained' ELSE 'fine_tuned' END AS model, avg(precision_at_k) AS precision_at_k,
   avg(ndcg_delta) AS ndcg_delta, CASE WHEN arm <> 'pretrained' THEN stddev_pop(precision_at_k) END AS sd FROM q WHERE arm IN ('pretrained', 'mixed') GROUP BY qid, arm)"""


def _per_query(spark: SparkSession, folder: str) -> DataFrame:
    """Data set and tag together name a query here, so that there are as many queries as such pairs."""
    rows = pin(s.metrics(spark, folder)).withColumn("query_id", F.concat_ws("_", "dataset", "query_id"))
    return ablation.per_query_table(rows, K, "pretrained", "mixed")


@query("A16", sql="WITH " + _PER_QUERY + """
SELECT query_id, model, round(precision_at_k, 8) AS precision_at_k, round(ndcg_delta, 8) AS ndcg_delta, round(sd, 8) AS precision_stdev_across_seeds FROM per_query""")
def per_query_table(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline and tuned values per query."""
    return _round(_per_query(spark, folder), "precision_at_k", "ndcg_delta", "precision_stdev_across_seeds")


@query("A16", sql="WITH " + _PER_QUERY + """, tiers AS (SELECT 'all' AS tier_id, query_id FROM per_query GROUP BY 2
  UNION ALL SELECT 'piano', query_id FROM per_query WHERE query_id LIKE '%inst_piano' GROUP BY 2
  UNION ALL SELECT 'instruments', query_id FROM per_query WHERE query_id LIKE '%inst_%' GROUP BY 2)
SELECT tier_id, model, count(*) AS n_queries, round(avg(precision_at_k), 8) AS macro_precision_at_k, round(avg(ndcg_delta), 8) AS macro_ndcg_delta
FROM per_query JOIN tiers USING (query_id) GROUP BY 1, 2""")
def query_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Macro means over nested tiers of queries."""
    per_query = _per_query(spark, folder)
    ids = per_query.select("query_id").distinct()
    tier = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("query_id").contains("inst_piano"), "piano"), F.when(F.col("query_id").contains("inst_"), "instruments")))
    tiers = ids.select("query_id", F.explode(tier).alias("tier_id"))
    return _round(ablation.tier_means(per_query, tiers), "macro_precision_at_k", "macro_ndcg_delta")


@query("W7", sql="WITH " + _PER_QUERY + """, o AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS pos FROM (SELECT DISTINCT query_id FROM per_query))
SELECT model, pos AS n_queries_in_set, query_id AS last_query_id, round(avg(precision_at_k) OVER w, 8) AS macro_precision_at_k,
       round(avg(ndcg_delta) OVER w, 8) AS macro_ndcg_delta, string_agg(query_id, ';') OVER w AS query_ids_in_set
FROM per_query JOIN o USING (query_id) WINDOW w AS (PARTITION BY model ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def cumulative_query_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Macro means over the first n queries, for every n."""
    from earmark.operators.ordering import with_position

    per_query = _per_query(spark, folder)
    ordered = with_position(per_query.select("query_id").distinct(), [], ["query_id"], "pos")
    out = ablation.cumulative_means(per_query, ordered)
    out = out.join(ablation.query_set_ids(ordered), "n_queries_in_set").drop("n_queries")
    return _round(out, "macro_precision_at_k", "macro_ndcg_delta")


@query("A17", sql="WITH " + s.METRICS + """, c AS (
  SELECT CASE query_id WHEN 'inst_piano' THEN 1 WHEN 'inst_vocal' THEN 2 ELSE 3 END AS n_tags, arm, seed, avg(precision_at_k) AS p, avg(ndcg_delta) AS d FROM metrics GROUP BY 1, 2, 3)
SELECT n_tags, round(max(p) FILTER (WHERE arm = 'pretrained'), 8) AS pretrained_precision_at_k, round(avg(p) FILTER (WHERE arm = 'mixed'), 8) AS ft_precision_mean,
       round(stddev_pop(p) FILTER (WHERE arm = 'mixed'), 8) AS ft_precision_stdev,
       round(avg(p) FILTER (WHERE arm = 'mixed') - max(p) FILTER (WHERE arm = 'pretrained'), 8) AS delta_precision,
       round(avg(d) FILTER (WHERE arm = 'mixed') - max(d) FILTER (WHERE arm = 'pretrained'), 8) AS delta_ndcg,
       count(*) FILTER (WHERE arm = 'mixed') AS n_ft_seeds
FROM c GROUP BY 1""")
def composite_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline against seed means per prompt length."""
    n_tags = F.when(F.col("query_id") == "inst_piano", 1).when(F.col("query_id") == "inst_vocal", 2).otherwise(3)
    rows = s.metrics(spark, folder).groupBy(n_tags.alias("n_tags"), "arm", "seed", "top_k").agg(
        F.avg("precision_at_k").alias("precision_at_k"), F.avg("ndcg_delta").alias("ndcg_delta"))
    out = ablation.composite_summary(rows, K, "pretrained", "mixed")
    kept = ("pretrained_precision_at_k", "ft_precision_mean", "ft_precision_stdev", "delta_precision", "delta_ndcg")
    return _round(out, *kept).select("n_tags", *kept, "n_ft_seeds")
