"""Ranking metrics against labels and against a random ranking.

Only the best K rows per query and the label counts of the pool are needed: the ideal ranking of 0/1 labels
follows from the number of positives, and the random baseline from the mean gain. The pool is never ranked as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.functions.keys import as_col
from earmark.functions.ranking import binary_ndcg, discount, discount_sum, gain, random_hit, random_ndcg


def label_positives(pool: DataFrame, item_id: str, labels: Sequence[str], truthy: str = "one") -> DataFrame:
    """Long table (query_id, item_id) of the positive labels of a wide pool.

    ``truthy`` is the rule of the label source: ``one`` (== 1) or ``nonzero`` (!= 0).
    """
    long = pool.select(item_id, *labels).unpivot(item_id, list(labels), "query_id", "_v")
    positive = F.col("_v").try_cast("double") == 1 if truthy == "one" else F.col("_v").try_cast("double") != 0
    return long.filter(positive).select("query_id", F.col(item_id).alias("item_id"))


def label_counts(queries: DataFrame, positives: DataFrame, pool: DataFrame) -> DataFrame:
    """Per query: pool size, number of positives, prevalence."""
    counts = positives.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_positive"))
    size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        queries.join(counts, "query_id", "left")
        .withColumn("n_positive", F.coalesce("n_positive", F.lit(0).cast("long")))
        .withColumn("n_pool", size)
        .withColumn("prevalence", F.when(F.col("n_pool") > 0, F.col("n_positive") / F.col("n_pool")).otherwise(F.lit(0.0)))
    )


def cutoff_hits(ranked: DataFrame, positives: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per query and cut-off K: hits, gain sum and whether anything was hit; cut-offs without a hit have no row.

    Only best rows that are positive count, so one inner join of the short ranking with the labels is enough.
    """
    hits = ranked.join(positives, ["query_id", "item_id"])
    per_k = hits.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("top_k"))
    return per_k.groupBy("query_id", "top_k").agg(
        F.count(F.lit(1)).cast("double").alias("hits"), F.sum(discount("rank")).alias("dcg"), F.lit(1.0).alias("hit"))


def metric_matrix(queries: DataFrame, ranked: DataFrame, positives: DataFrame, pool: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per query and cut-off: P@K, nDCG@K, hit@K, each with its random expectation.

    A query without positives in the pool gets zeros.
    """
    counts = label_counts(queries, positives, pool)
    grid = counts.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    rows = grid.join(cutoff_hits(ranked, positives, ks), ["query_id", "top_k"], "left").withColumns({
        "k_eff": F.least(F.col("top_k").cast("long"), F.col("n_pool")),
        "hits": F.coalesce("hits", F.lit(0.0)), "dcg": F.coalesce("dcg", F.lit(0.0)), "hit": F.coalesce("hit", F.lit(0.0)),
    })
    ideal = discount_sum(F.least("k_eff", "n_positive"))
    rows = rows.withColumns({
        "precision_at_k": F.when(F.col("k_eff") > 0, F.col("hits") / F.col("k_eff")).otherwise(F.lit(0.0)),
        "ndcg_at_k": binary_ndcg("dcg", "k_eff", "n_positive"),
        "ndcg_random_mean": random_ndcg("prevalence", "k_eff", ideal),
        "random_hit_at_k": random_hit("n_pool", "n_positive", "top_k"),
    })
    return rows.withColumns({
        "precision_delta": F.col("precision_at_k") - F.col("prevalence"),
        "ndcg_delta": F.col("ndcg_at_k") - F.col("ndcg_random_mean"),
    }).drop("k_eff", "dcg", "hits").withColumnRenamed("hit", "hit_at_k")


def unlabelled_queries(queries: DataFrame, label_ids: Sequence[str]) -> DataFrame:
    """Queries whose id names no label column; they are reported, not evaluated."""
    return queries.filter(~F.col("query_id").isin(*label_ids))


def graded_ndcg(ranked: DataFrame, graded: DataFrame, k: int) -> DataFrame:
    """nDCG@k per query for graded relevance (query_id, item_id, relevance), ideal taken from the whole pool.

    The ideal top k comes from the number of rows per relevance level: a level that fills ranks a..b adds its
    gain times the discounts of those ranks, so a query's judged rows are counted and never sorted.
    """
    found = ranked.filter(F.col("rank") <= k).join(graded, ["query_id", "item_id"])
    dcg = found.groupBy("query_id").agg(F.sum(gain("relevance") * discount("rank")).alias("dcg"))
    above = Window.partitionBy("query_id").orderBy(F.col("relevance").desc())
    # every level has a row, so the k highest levels hold the ideal top k
    levels = graded.groupBy("query_id", "relevance").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_level", F.row_number().over(above)).filter(F.col("_level") <= k)
    upto = F.least(F.sum("n").over(above), F.lit(k))
    before = F.least(F.coalesce(F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(k))
    parts = levels.withColumns({"_to": upto, "_from": before})
    ideal = parts.groupBy("query_id").agg(F.sum(gain("relevance") * (discount_sum("_to") - discount_sum("_from"))).alias("idcg"))
    return ranked.select("query_id").distinct().join(ideal, "query_id", "left").join(dcg, "query_id", "left").select(
        "query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg_at_k"))


def random_ndcg_draws(counts: DataFrame, k: int, iterations: int = 256, seed: int = 42) -> DataFrame:
    """Mean nDCG of simulated random rankings (optional; the closed form is :func:`functions.ranking.random_ndcg`).

    Only the first k places of a ranking matter. They are drawn one after another without replacement from the
    counts of positives and others, so a draw costs k steps whatever the size of the pool. A query without positives has 0.
    """
    k_eff = F.least(F.lit(k).cast("long"), F.col("n_pool"))
    steps = F.sequence(F.lit(0).cast("long"), k_eff - 1)

    def chance(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("query_id"), F.col("_iter"), i).cast("binary"))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    def step(acc: Column, i: Column) -> Column:
        hit = chance(i) < (F.col("n_positive") - acc["hits"]) / (F.col("n_pool") - i)
        return F.struct(
            (acc["hits"] + hit.cast("long")).alias("hits"),
            (acc["dcg"] + F.when(hit, discount(i + 1)).otherwise(F.lit(0.0))).alias("dcg"))

    start = F.struct(F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("dcg"))
    draws = counts.filter((F.col("n_pool") > 0) & (F.col("n_positive") > 0)).withColumn("_iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    ideal = discount_sum(F.least(k_eff, F.col("n_positive")))
    drawn = draws.withColumn("_ndcg", F.aggregate(steps, start, step)["dcg"] / ideal)
    means = drawn.groupBy("query_id").agg(F.avg("_ndcg").alias("ndcg_random_mean"))
    return counts.select("query_id").join(means, "query_id", "left").fillna(0.0, ["ndcg_random_mean"])


def prefix_queries(tags: Sequence[tuple[str, str]]) -> list[tuple[str, int, str, list[str]]]:
    """Cumulative composite queries over ordered (tag, word) pairs: (query_id, n_tags, phrase, tag ids)."""
    out = []
    for n in range(1, len(tags) + 1):
        ids, words = [t for t, _ in tags[:n]], [w for _, w in tags[:n]]
        out.append((";".join(ids), n, " ".join(words), ids))
    return out


def composite_positives(pool: DataFrame, item_id: str, labels: str, queries: DataFrame) -> DataFrame:
    """(query_id, item_id) pairs where an item has every tag of a composite query (``tag_ids``), for any number of queries.

    Relational division: items are listed by tag, and each query is joined to the items of its rarest tag; what such an item
    has is then held against the query's other tags. A query without tags matches every item.
    """
    item = F.col(item_id).alias("item_id")
    tags = F.map_keys(F.map_filter(as_col(labels), lambda _, v: F.coalesce(v, F.lit(0)) != 0))
    asked = queries.select("query_id", F.array_distinct("tag_ids").alias("tag_ids"))
    bridge = pool.select(item, tags.alias("_tags")).select("item_id", "_tags", F.explode("_tags").alias("_tag"))
    counts = bridge.groupBy("_tag").agg(F.count(F.lit(1)).alias("_n"))
    wanted = asked.select("query_id", "tag_ids", F.explode("tag_ids").alias("_tag")).join(counts, "_tag", "left")
    # A tag that no item has is the rarest.
    rarest = wanted.groupBy("query_id", "tag_ids").agg(F.min_by("_tag", F.struct(F.coalesce("_n", F.lit(0)), F.col("_tag"))).alias("_tag"))
    found = rarest.join(bridge, "_tag").filter(F.size(F.array_except("tag_ids", "_tags")) == 0).select("query_id", "item_id")
    whole = asked.filter(F.size("tag_ids") == 0)
    if whole.isEmpty():
        return found
    every = pool.select(item, F.lit(0).alias("_all")).join(whole.select("query_id", F.lit(0).alias("_all")), "_all")
    return found.unionByName(every.select("query_id", "item_id"))


def judged_scores(judged: DataFrame, k: int) -> DataFrame:
    """Metrics per query from judged rows (query_id, query_type, rank, relevance) among the first ``k`` ranks.

    Unjudged rows are skipped; precision divides by the judged ones and the ideal is the best order of them.
    A judged list holds at most ``k`` rows per query.
    """
    first = Window.partitionBy("query_id").orderBy("rank", F.col("relevance").desc_nulls_last())
    top = judged.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= k).filter(F.col("relevance").isNotNull())
    by_rank = Window.partitionBy("query_id").orderBy("_at")
    by_value = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "_at")
    placed = top.withColumns({"_i": F.row_number().over(by_rank), "_j": F.row_number().over(by_value)})
    scored = placed.groupBy("query_id").agg(
        F.min_by("query_type", "_i").alias("query_type"),
        F.count(F.lit(1)).alias("num_judged"),
        F.avg((F.col("relevance") > 0).cast("double")).alias("precision_at_k"),
        F.max((F.col("relevance") > 0).cast("double")).alias("hitrate_at_k"),
        F.sum(gain("relevance") * discount("_i")).alias("_dcg"),
        F.sum(gain("relevance") * discount("_j")).alias("_idcg"))
    return scored.withColumn("ndcg_at_k", F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(F.lit(0.0))).drop("_dcg", "_idcg")


def judged_rollup(scores: DataFrame) -> DataFrame:
    """Mean metrics per query type and over all queries (query_type null) in one pass."""
    return scores.rollup("query_type").agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in ("precision_at_k", "hitrate_at_k", "ndcg_at_k")])


def self_hit_rate(ranked: DataFrame, n_queries: Column) -> DataFrame:
    """One row: share of queries that find themselves among their best rows (item_id equals query_id)."""
    return ranked.agg((F.count_if(F.col("query_id") == F.col("item_id")) / n_queries).alias("hit_rate"))
