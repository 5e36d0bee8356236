import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from earmark.functions.keys import seeded_hash
from earmark.operators import ordering, sampling, selection


@pytest.fixture(autouse=True)
def several_placements(monkeypatch):
    monkeypatch.setattr(ordering, "PLACEMENTS", 8)


def test_adaptive_placements_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PLACEMENTS", None)
    df = spark.range(0, 400_000, 1, 16).select(F.sha2(F.col("id").cast("string"), 512).alias("h"), "id")
    bounds = ordering.place(df, [], ["h"]).groupBy(ordering.PLACEMENT).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).orderBy(ordering.PLACEMENT).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(bounds, bounds[1:], strict=False))
    got = ordering.with_position(df, [], ["h"], "pos").orderBy("h").select("pos").toPandas()["pos"]
    assert got.tolist() == list(range(1, 400_001))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one key; values repeat heavily."""
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"), "id",
        F.when(F.col("id") % 4 == 0, 0.5).otherwise((F.hash("id") % 1000) / 1000.0).alias("value"))
    return rows.cache()


def test_position_with_a_hot_key(spark, skewed):
    got = ordering.with_position(skewed, ["key"], ["value", "id"], "pos", size="n").toPandas()
    want = skewed.toPandas().sort_values(["key", "value", "id"])
    want["pos"] = want.groupby("key").cumcount() + 1
    want["n"] = want.groupby("key")["id"].transform("count")
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == 3000 and (merged["pos"] == merged["pos_w"]).all() and (merged["n"] == merged["n_w"]).all()


def test_hot_key_spans_several_placements(spark, skewed):
    placed = ordering.place(skewed, ["key"], ["value", "id"])
    parts = placed.filter("key = 'hot'").select(ordering.PLACEMENT).distinct().count()
    largest = placed.groupBy(ordering.PLACEMENT).count().agg(F.max("count")).first()[0]
    assert parts >= 2 and largest < 3000 / 3


def test_running_values(spark, skewed):
    placed = ordering.place(skewed, ["key"], ["id"])
    got = ordering.running(placed, ["key"], ["id"], [("s", "sum", F.col("value")), ("m", "max", F.col("value")), ("lo", "min", F.col("value"))], inclusive=False).toPandas()
    want = skewed.toPandas().sort_values(["key", "id"])
    grouped = want.groupby("key")["value"]
    want["s"] = grouped.cumsum() - want["value"]
    want["m"] = grouped.transform(lambda v: v.cummax().shift())
    want["lo"] = grouped.transform(lambda v: v.cummin().shift())
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert ((merged["s"] - merged["s_w"]).abs() < 1e-9).all()
    for c in ("m", "lo"):
        assert (merged[c].fillna(-1) == merged[f"{c}_w"].fillna(-1)).all()


def test_smallest_is_exact_beyond_one_task(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordering, "LIMIT_IN_ONE_TASK", 10)
    got = {r["id"] for r in ordering.smallest(skewed, ["value", "id"], 777).collect()}
    assert got == {r["id"] for r in skewed.orderBy("value", "id").limit(777).collect()}


def test_first_per_group_is_exact(spark, skewed):
    got = {r["id"] for r in ordering.first_per_group(skewed, ["key"], ["value", "id"], 7, ["id"]).collect()}
    pdf = skewed.toPandas().sort_values(["key", "value", "id"])
    assert got == set(pdf.groupby("key").head(7)["id"])


def test_keep_one(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "k STRING, v STRING, _ord INT")
    assert {(r["k"], r["v"]) for r in ordering.keep_one(rows, ["k"], ["_ord"]).collect()} == {("a", "x"), ("b", "z")}
    last = ordering.keep_one(rows, ["k"], ["_ord"], keep="last", n_dropped="d").collect()
    assert {(r["k"], r["v"], r["d"]) for r in last} == {("a", "y", 1), ("b", "z", 0)}


def test_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(5000)
    picks = [set(r["id"] for r in sampling.sample_exactly(df.repartition(p), "id", 1234, seed=7).collect()) for p in (1, 13)]
    assert picks[0] == picks[1] and len(picks[0]) == 1234
    assert picks[0] == {r["id"] for r in df.orderBy(seeded_hash(7, "id")).limit(1234).collect()}
    assert sampling.sample_exactly(df, "id", 9999).count() == 5000 and sampling.sample_exactly(df, "id", 0).count() == 0


@pytest.mark.parametrize("ratio", [0.1, 0.5])
def test_split_has_no_leak(spark, skewed, ratio):
    a, b = (sampling.group_split(skewed.repartition(p), "key", ratio).groupBy("key").agg(F.min("is_val").alias("lo"), F.max("is_val").alias("hi"), F.count("*").alias("n")).toPandas().set_index("key").sort_index() for p in (2, 9))
    assert (a["lo"] == a["hi"]).all() and a.equals(b)
    order = skewed.select("key").distinct().orderBy(seeded_hash(42, "key")).toPandas()["key"].tolist()
    target, taken, want = max(1, round(3000 * ratio)), 0, set()
    for key in order:
        if taken >= target:
            break
        want.add(key)
        taken += a.loc[key, "n"]
    assert want == set(a.index[a["hi"]])


def test_split_of_tiny_tables(spark):
    one = spark.createDataFrame([("a",)], "key STRING")
    assert sampling.group_split(one, "key").filter("is_val").count() == 0
    two = spark.createDataFrame([("a",), ("b",)], "key STRING")
    assert sampling.group_split(two, "key").filter("is_val").count() == 1


def brute_stratified(pdf, target, seed):
    import hashlib

    pdf = pdf.assign(h=[hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in pdf["audio_path"]]).sort_values("h")
    if len(pdf) <= target:
        return set(pdf["audio_path"])
    buckets = {b for bs in pdf["b"] for b in bs}
    quota, taken = max(1, target // len(buckets)), []
    for bucket in sorted(buckets):
        left = [p for p, bs in zip(pdf["audio_path"], pdf["b"], strict=True) if bucket in bs and p not in taken]
        taken += left[:quota]
    taken += [p for p in pdf["audio_path"] if p not in taken][: max(0, target - len(taken))]
    return set([p for p in pdf["audio_path"] if p in taken][:target])


@pytest.mark.parametrize("target", [1, 3, 5, 20, 60, 100])
def test_stratified_sample_matches_the_sequential_rule(spark, target):
    names = ["inst_piano", "inst_vocal", "mood_relaxing"]
    rows = [(f"p{i}", int(i % 3 == 0), int(i % 4 == 0), int(i % 10 == 0)) for i in range(60)]
    rows += rows[:5]  # repeated paths count once
    df = spark.createDataFrame(rows, "audio_path STRING, gold_pub_piano INT, gold_pub_vocal INT, gold_pub_relaxing INT")
    from earmark.functions.values import public_label_map

    got = [r["audio_path"] for r in sampling.stratified_sample(df, "audio_path", target, public_label_map(), seed=3).collect()]
    pdf = pd.DataFrame(sorted(set(rows)), columns=["audio_path", *names])
    pdf["b"] = [[n for n in names if r[n]] or ["none"] for _, r in pdf.iterrows()]
    assert len(got) == len(set(got)) == min(target, 60)
    assert set(got) == brute_stratified(pdf, target, 3)


def test_hard_mining(spark, skewed):
    got = sampling.mine_hard(skewed, "value", "id", 0.2).toPandas().sort_values(["value", "id"])
    want = skewed.toPandas().sort_values(["value", "id"]).head(600)
    assert got["id"].tolist() == want["id"].tolist()
    assert abs(got["rank_pct"].iloc[-1] - 0.2) < 1e-12 and abs(got["rank_pct"].iloc[0] - 1 / 3000) < 1e-12
    assert sampling.mine_hard(spark.createDataFrame([(0.5, 1)], "value DOUBLE, id INT"), "value", "id", 0.01).count() == 1
    with pytest.raises(ValueError):
        sampling.mine_hard(skewed, "value", "id", 0.0)


def test_representative_rows(spark):
    rows = [(f"s{n}", i) for n in (1, 2, 3, 4, 7) for i in range(n)]
    out = sampling.representative_rows(spark.createDataFrame(rows, "song STRING, seg INT"), "song", ["seg"]).toPandas()
    got = {s: sorted(g["position"]) for s, g in out.groupby("song")}
    assert got == {"s1": [0], "s2": [0, 1], "s3": [0, 1, 2], "s4": [0, 1, 3], "s7": [0, 3, 6]}


def test_segment_plan(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 4.9), ("c", 5.0), ("d", 30.0), ("e", 34.0), ("f", 36.1234)], "k STRING, d DOUBLE")
    out = sampling.plan_segments(df, "d").toPandas()
    got = {k: list(zip(g["start_sec"], g["end_sec"], g["duration_sec"], strict=True)) for k, g in out.sort_values("segment_index").groupby("k")}
    assert got == {"c": [(0, 5, 5)], "d": [(0, 15, 15), (15, 30, 15)], "e": [(0, 15, 15), (15, 30, 15)],
                   "f": [(0, 15, 15), (15, 30, 15), (30, 36.123, 6.123)]}


def test_cap_per_tag(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 50 == 0).alias("b"))
    out = sampling.cap_per_tag(df, "id", {"a": F.col("a"), "b": F.col("b")}, 30, seed=5)
    order = [r["id"] for r in df.filter("a").orderBy(seeded_hash(5, "id")).limit(30).collect()]
    assert {r["id"] for r in out.collect()} == set(order) | {r["id"] for r in df.filter("b").collect()}


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "key STRING, id INT")
    got = {(r["key"], r["id"]): (r["pos"], r["n"]) for r in ordering.with_position(df, ["key"], ["id"], "pos", size="n").collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), ("a", 3): (1, 1)}
    flagged = sampling.group_split(df, "key", 0.5)
    assert flagged.filter("is_val IS NULL").count() == 0


def order_key(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


@pytest.mark.parametrize("limit", [10_000, 3])
def test_smallest_cut_of_any_values(spark, limit, monkeypatch):
    """Nulls, infinities, NaN, many equal values, values of very different size."""
    monkeypatch.setattr(selection, "LIMIT_IN_ONE_TASK", limit)
    draw = random.Random(3)
    special = [None] * 5 + [math.nan] * 6 + [math.inf] * 4 + [-math.inf] * 3 + [0.5] * 60 + [-0.0, 0.0, 1e308, -1e308, 5e-324, 1e-300]
    values = special + [draw.choice((1, 1e-9, 1e9)) * draw.gauss(0, 1) for _ in range(120)]
    draw.shuffle(values)
    rows = [(v, f"k{i:03}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v DOUBLE, k STRING")
    order = sorted(rows, key=lambda r: (order_key(r[0]), r[1]))
    for n in (1, 4, 5, 6, 8, 9, 30, 80, 120, len(rows) - 11, len(rows) - 8, len(rows) - 3, len(rows)):
        cut = selection.smallest_cut(df, "v", "k", lambda total: n)
        assert sorted(r.k for r in df.filter(cut.condition("v", "k")).collect()) == sorted(k for _, k in order[:n]), n
        known = [v for v, _ in order[:n] if v is not None]
        mean = sum(known) / len(known) if known else None
        assert cut.n == n and cut.n_all == len(rows) and (cut.mean is None if mean is None else cut.mean == pytest.approx(mean, nan_ok=True))
    assert selection.smallest_cut(df.limit(0), "v", "k", lambda total: 3) is None


def test_mining_moves_no_vector(spark):
    rows = [(f"k{i}", (i * 37 % 100) / 100, [float(i)] * 8) for i in range(100)]
    df = spark.createDataFrame(rows, "k STRING, sim DOUBLE, vec ARRAY<DOUBLE>")
    hard = sampling.mine_hard(df, "sim", "k", 0.2, ranks=False)
    plan = hard._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and hard.count() == 20
    got = {r.k: r for r in sampling.hard_ranks(hard.drop("vec"), "sim", "k").collect()}
    assert {k: r.rank_pct for k, r in got.items()} == {f"k{i}": pytest.approx(n / 100) for n, i in enumerate(sorted(range(100), key=lambda i: i * 37 % 100)[:20], 1)}
    assert {round(r.mean_sim_hard, 9) for r in got.values()} == {0.095} and {round(r.mean_sim_all, 9) for r in got.values()} == {0.495}
    assert sampling.mine_hard(df.limit(0), "sim", "k").count() == 0


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_joint_quotas_at_any_prefix(spark, digits, monkeypatch):
    """Short prefixes: many cut-offs share one, and later turns depend on earlier cuts inside it."""
    from earmark.functions.values import public_label_map

    monkeypatch.setattr(sampling, "PREFIX_DIGITS", digits)
    draw = random.Random(digits)
    names = ["inst_piano", "inst_vocal", "mood_relaxing"]
    rows = [(f"p{i}", int(draw.random() < 0.5), int(draw.random() < 0.4), int(draw.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "audio_path STRING, gold_pub_piano INT, gold_pub_vocal INT, gold_pub_relaxing INT")
    pdf = pd.DataFrame(rows, columns=["audio_path", *names])
    pdf["b"] = [[n for n in names if r[n]] or ["none"] for _, r in pdf.iterrows()]
    for target in (2, 7, 40, 150, 399):
        got = sampling.stratified_sample(df, "audio_path", target, public_label_map(), seed=target)
        assert {r["audio_path"] for r in got.collect()} == brute_stratified(pdf, target, target)
