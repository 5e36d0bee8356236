"""Statistics over seeds and comparison tables over arms, data sets and query sets.

A metric matrix is one long table (dataset, arm, seed, query, K). Every report below is one or two
aggregations over it; nothing is read or computed per file, seed or arm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.functions.keys import as_col
from earmark.operators.filters import tradeoff_label, verdict
from earmark.operators.ordering import place, running


def seed_stats(value: Column | str, name: str) -> list[Column]:
    """Mean and population deviation over seeds; deviation 0 for one value, both null for none."""
    value = as_col(value)
    return [F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_stdev")]


def finite_stats(value: Column | str, name: str) -> list[Column]:
    """Mean, sample deviation (0 below two values) and count over the finite values."""
    value = as_col(value)
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return [
        F.avg(finite).alias(f"{name}_mean"),
        F.coalesce(F.stddev_samp(finite), F.lit(0.0)).alias(f"{name}_stdev"),
        F.count(finite).alias(f"n_{name}_finite"),
    ]


def arm_summary(matrix: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Per group (for example dataset, arm, tag): seed statistics, with pool and positives of the first seed."""
    return matrix.filter(F.col("top_k") == k).groupBy(*by).agg(
        *seed_stats("precision_at_k", "precision"), *seed_stats("ndcg_delta", "ndcg_delta"),
        F.min_by("n_positive", "seed").alias("n_positive"), F.min_by("n_pool", "seed").alias("n_pool"),
        F.count("precision_at_k").alias("n_seeds"))


def compare_arms(matrix: DataFrame, by: Sequence[str], k: int, base: str, other: str) -> DataFrame:
    """Two arms side by side with differences and a verdict, in one aggregation."""
    def of(arm: str, column: str) -> Column:
        return F.when(F.col("arm") == arm, F.col(column))

    rows = matrix.filter((F.col("top_k") == k) & F.col("arm").isin(base, other)).groupBy(*by).agg(
        *seed_stats(of(base, "precision_at_k"), "base_precision"), *seed_stats(of(base, "ndcg_delta"), "base_ndcg_delta"),
        *seed_stats(of(other, "precision_at_k"), "other_precision"), *seed_stats(of(other, "ndcg_delta"), "other_ndcg_delta"),
        F.count(of(base, "precision_at_k")).alias("n_base_seeds"), F.count(of(other, "precision_at_k")).alias("n_seeds"))
    return (
        rows.filter((F.col("n_base_seeds") > 0) & (F.col("n_seeds") > 0))
        .withColumn("delta_precision", F.col("other_precision_mean") - F.col("base_precision_mean"))
        .withColumn("delta_ndcg", F.col("other_ndcg_delta_mean") - F.col("base_ndcg_delta_mean"))
        .withColumn("verdict", verdict("delta_precision"))
    )


def baseline_delta(summary: DataFrame, by: Sequence[str], baseline: str) -> DataFrame:
    """Every arm minus the baseline arm of the same group."""
    group = Window.partitionBy(*by)  # a group has one row per arm

    def base(column: str) -> Column:
        return F.max(F.when(F.col("arm") == baseline, F.col(column))).over(group)

    return summary.withColumns({
        "delta_precision": F.col("precision_mean") - base("precision_mean"),
        "delta_ndcg": F.col("ndcg_delta_mean") - base("ndcg_delta_mean")})


def macro_over_datasets(matrix: DataFrame, k: int, tag: str = "query_id") -> DataFrame:
    """Per arm and tag: mean over data sets of the seed means, and the map from data set to value."""
    per_dataset = arm_summary(matrix, ["dataset", "arm", tag], k)
    return per_dataset.groupBy("arm", tag).agg(
        *seed_stats("precision_mean", "precision"), *seed_stats("ndcg_delta_mean", "ndcg_delta"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "precision_mean")))).alias("by_dataset"),
        F.count(F.lit(1)).alias("n_datasets"))


def tradeoff_table(gold: DataFrame, public: DataFrame, k: int, home_arm: str, mixed_arm: str, pretrained: str = "pretrained",
                   tag: str = "query_id") -> DataFrame:
    """Two training arms by two evaluation domains: values, differences and the reading of each tag."""
    home = arm_summary(gold, ["arm", tag], k)
    away = macro_over_datasets(public, k, tag)

    def of(arm: str, column: str = "precision_mean") -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(column)))

    gold_side = home.groupBy(tag).agg(of(home_arm).alias("home_gold"), of(mixed_arm).alias("mixed_gold"))
    away_side = away.withColumn("_json", F.to_json("by_dataset")).groupBy(tag).agg(
        of(home_arm).alias("home_ood_macro"), of(mixed_arm).alias("mixed_ood_macro"), of(pretrained).alias("pretrained_ood_macro"),
        of(home_arm, "_json").alias("ood_by_dataset_home"), of(mixed_arm, "_json").alias("ood_by_dataset_mixed"))
    return (
        gold_side.join(away_side, tag, "left")
        .withColumn("gold_delta", F.col("mixed_gold") - F.col("home_gold"))
        .withColumn("ood_delta", F.col("mixed_ood_macro") - F.col("home_ood_macro"))
        .withColumn("interpretation", tradeoff_label("gold_delta", "ood_delta", tag))
    )


def per_query_table(matrix: DataFrame, k: int, baseline: str, tuned: str, query: str = "query_id") -> DataFrame:
    """Per query one row for the baseline and one for the tuned arm's seed means, where the baseline has the query."""
    rows = matrix.filter((F.col("top_k") == k) & F.col("arm").isin(baseline, tuned)).groupBy(query, "arm").agg(
        F.avg("precision_at_k").alias("precision_at_k"), F.avg("ndcg_delta").alias("ndcg_delta"),
        F.stddev_pop("precision_at_k").alias("precision_stdev_across_seeds"))
    known = matrix.filter((F.col("top_k") == k) & (F.col("arm") == baseline)).select(query).distinct()
    model = F.when(F.col("arm") == baseline, F.lit("pretrained")).otherwise(F.lit("fine_tuned"))
    stdev = F.when(F.col("arm") != baseline, F.col("precision_stdev_across_seeds"))
    return rows.join(known, query, "left_semi").withColumn("precision_stdev_across_seeds", stdev).withColumn("model", model).drop("arm")


def tier_means(per_query: DataFrame, tiers: DataFrame, query: str = "query_id") -> DataFrame:
    """Macro means per tier of queries and model. Tiers overlap, so membership is a table (tier_id, query)."""
    return per_query.join(tiers, query).groupBy("tier_id", "model").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("precision_at_k").alias("macro_precision_at_k"),
        F.avg("ndcg_delta").alias("macro_ndcg_delta"))


def cumulative_means(per_query: DataFrame, ordered: DataFrame, query: str = "query_id") -> DataFrame:
    """Macro means over the first n queries of a fixed order (query, pos), per model, with the ids in the set.

    Running sums go over range placements, so long query lists are not funnelled through one task per model. The
    id list of a set grows by its definition; it is attached from the query order.
    """
    rows = per_query.join(ordered, query)
    placed = place(rows, ["model"], ["pos"])
    sums = running(placed, ["model"], ["pos"], [
        ("_n", "count", F.lit(1)), ("_p", "sum", F.col("precision_at_k")), ("_d", "sum", F.col("ndcg_delta"))])
    return sums.select(
        "model", F.col("pos").alias("n_queries_in_set"), F.col(query).alias("last_query_id"), F.col("_n").alias("n_queries"),
        (F.col("_p") / F.col("_n")).alias("macro_precision_at_k"), (F.col("_d") / F.col("_n")).alias("macro_ndcg_delta"))


def query_set_ids(ordered: DataFrame, query: str = "query_id", sep: str = ";") -> DataFrame:
    """Per position the ids of all queries up to it, joined in order. For query sets of report size."""
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.select(
        F.col("pos").alias("n_queries_in_set"), F.array_join(F.collect_list(query).over(upto), sep).alias("query_ids_in_set"))


def composite_summary(matrix: DataFrame, k: int, baseline: str, tuned: str) -> DataFrame:
    """Per prompt length: baseline values, seed statistics of the tuned arm and the differences."""
    def of(arm: str, column: str) -> Column:
        return F.when(F.col("arm") == arm, F.col(column))

    rows = matrix.filter(F.col("top_k") == k).groupBy("n_tags").agg(
        F.max(of(baseline, "precision_at_k")).alias("pretrained_precision_at_k"),
        F.max(of(baseline, "ndcg_delta")).alias("pretrained_ndcg_delta"),
        *seed_stats(of(tuned, "precision_at_k"), "ft_precision"), *seed_stats(of(tuned, "ndcg_delta"), "ft_ndcg_delta"),
        F.count(of(tuned, "precision_at_k")).alias("n_ft_seeds"))
    return (
        rows.filter(F.col("pretrained_precision_at_k").isNotNull())
        .withColumn("delta_precision", F.col("ft_precision_mean") - F.col("pretrained_precision_at_k"))
        .withColumn("delta_ndcg", F.col("ft_ndcg_delta_mean") - F.col("pretrained_ndcg_delta"))
    )


def label_balance(df: DataFrame, labels: Sequence[str], moods: Sequence[str]) -> DataFrame:
    """Per label: positives (value other than 0), prevalence, rows, and rows without any positive mood.

    One aggregation over the wide rows; only its single result row is turned into one row per label.
    """
    flags = {c: F.coalesce(F.col(c).try_cast("double").try_cast("int"), F.lit(0)) != 0 for c in labels}
    any_mood = F.lit(False)
    for c in moods:
        any_mood = any_mood | flags[c]
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~any_mood).alias("n_no_mood"), *[F.count_if(flags[c]).alias(c) for c in labels])
    long = totals.unpivot(["n_rows", "n_no_mood"], list(labels), "label", "n_positive")
    return long.withColumn("prevalence", F.coalesce(F.try_divide("n_positive", "n_rows"), F.lit(0.0)))
