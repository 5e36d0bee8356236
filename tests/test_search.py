import numpy as np
import pytest

from earmark.operators import evaluation, search
from earmark.session import pin


def frames(spark, queries, pool):
    q = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(queries)], "query_id BIGINT, query_vec ARRAY<DOUBLE>")
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(pool)], "item_id BIGINT, item_vec ARRAY<DOUBLE>").repartition(5)
    return q, p


def brute(queries, pool, k, metric):
    scores = search.score_matrix(np.asarray(queries), np.asarray(pool), metric)
    return {(q, int(i), r + 1) for q in range(len(queries)) for r, i in enumerate(np.lexsort((np.arange(len(pool)), -scores[q]))[:k])}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    pool = np.vstack([centres[i % 6] + 0.3 * rng.normal(size=8) for i in range(600)])
    pool[::3] = pool[0]  # a third of the pool is one and the same vector
    queries = np.vstack([centres[i % 6] + 0.5 * rng.normal(size=8) for i in range(70)])
    queries[:25] = pool[0]  # and a third of the queries
    return queries, pool


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_scan_is_exact(spark, vectors, metric):
    q, p = frames(spark, *vectors)
    got = {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, 7, metric).collect()}
    assert got == brute(*vectors, 7, metric)


@pytest.fixture
def small_units(monkeypatch):
    for name, value in (("MAX_BROADCAST_QUERIES", 10), ("UNIT_ITEMS", 40), ("UNIT_QUERIES", 9), ("MAX_PIVOTS", 12)):
        monkeypatch.setattr(search, name, value)


@pytest.mark.parametrize(("metric", "k"), [("cosine", 7), ("cosine", 250), ("l2", 7), ("ip", 7)])
def test_partitioned_route_is_exact(spark, vectors, metric, k, small_units):
    q, p = frames(spark, *vectors)
    got = {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, k, metric).collect()}
    assert got == brute(*vectors, k, metric)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_both_routes_agree_on_undefined_vectors(spark, vectors, metric, small_units):
    queries, pool = (v[:120].copy() for v in vectors)
    pool[[1, 50]], pool[7], queries[[0, 30]], queries[5] = np.nan, 0, np.nan, 0
    q, p = frames(spark, queries, pool)
    got = {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, 119, metric).collect()}
    assert got == brute(queries, pool, 119, metric)
    near = {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, 3, metric).collect()}
    assert near == brute(queries, pool, 3, metric)


@pytest.mark.parametrize(("metric", "k"), [("cosine", 7), ("cosine", 250), ("l2", 7), ("ip", 7), ("ip", 1)])
@pytest.mark.parametrize("unit_bytes", [16 << 20, 3000])
def test_bounds_route_is_exact(spark, vectors, metric, k, unit_bytes, monkeypatch):
    monkeypatch.setattr(search, "UNIT_BYTES", unit_bytes)
    q, p = frames(spark, *vectors)
    got = {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, k, metric, route="bounds").collect()}
    assert got == brute(*vectors, k, metric)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_bounds_route_on_undefined_vectors(spark, vectors, metric, monkeypatch):
    monkeypatch.setattr(search, "UNIT_BYTES", 3000)
    queries, pool = (v[:120].copy() for v in vectors)
    pool[[1, 50]], pool[7], queries[[0, 30]], queries[5] = np.nan, 0, np.nan, 0
    pool[9, 2], pool[11, 1], queries[6, 0] = np.inf, -np.inf, np.inf
    q, p = frames(spark, queries, pool)
    for k in (119, 3):
        got = {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, k, metric, route="bounds").collect()}
        with np.errstate(invalid="ignore"):
            assert got == brute(queries, pool, k, metric)
    assert search.top_k(q, p.limit(0), 3, metric, route="bounds").count() == 0 and search.top_k(q.limit(0), p, 3, metric, route="bounds").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_wide_vectors_take_the_bounds_route_and_leave_little_open(spark, metric, monkeypatch):
    monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", 10)
    rng = np.random.default_rng(5)
    pool, queries = rng.normal(size=(2000, 512)), rng.normal(size=(40, 512))
    pinned = []
    monkeypatch.setattr(search, "pin", lambda df, label="": pinned.append((label, made := pin(df, label))) or made)
    q, p = frames(spark, queries, pool)
    best = search.top_k(q, p, 5, metric)
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in best.collect()} == brute(queries, pool, 5, metric)
    left = dict(pinned)["open"].count()
    assert 40 * 5 <= left < 40 * 60  # of 80,000 pairs


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for scale in (1e-6, 1.0, 1e5):
        a, b = scale * rng.normal(size=(30, 96)), scale * rng.standard_t(2, size=(200, 96))
        a[3], b[4], b[5, 0] = 0, 0, 50 * scale
        for metric in ("ip", "l2", "cosine"):
            x, y = (search.unit_rows(a), search.unit_rows(b)) if metric == "cosine" else (a, b)
            codes, step, miss, length = search.encode_bytes(y)
            low, high = search.score_bounds(x.astype(np.float32), np.linalg.norm(x, axis=1), codes, step, miss, length, metric)
            exact = search.score_matrix(a, b, metric)
            assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.5 * np.abs(exact).mean() + 1e-7


def test_no_vector_moves_for_bounds(spark, vectors):
    """Of the pool, bytes go to the units; single-precision vectors of the queries do."""
    q, p = frames(spark, *vectors)
    with pytest.raises(ValueError):
        search.top_k(q, p, 5, route="scan")
    rows = search._coded(p.select("item_id", "item_vec"), True)
    assert [f.dataType.simpleString() for f in rows.schema.fields][1] == "binary" and rows.selectExpr("max(length(code))").first()[0] == 8


def test_scores_of_many_queries(spark, vectors, small_units, monkeypatch):
    monkeypatch.setattr(search, "SCORES_IN_MEMORY", 400)
    queries, pool = vectors
    q, p = frames(spark, queries, pool)
    got = {(r["query_id"], r["item_id"]): r["score"] for r in search.score_pool(q, p, "l2").collect()}
    scores = search.score_matrix(queries, pool, "l2")
    assert len(got) == scores.size and all(abs(got[i, j] - s) < 1e-8 for (i, j), s in np.ndenumerate(scores))


def test_small_pools_and_empty_ones(spark, vectors, monkeypatch):
    queries, pool = vectors
    q, p = frames(spark, queries, pool[:3])
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, 10).collect()} == brute(queries, pool[:3], 10, "cosine")
    assert search.top_k(q, p.limit(0), 10).count() == 0 and search.top_k(q.limit(0), p, 10).count() == 0
    monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", 10)
    assert search.top_k(q, p.limit(0), 10).count() == 0
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in search.top_k(q, p, 10).collect()} == brute(queries, pool[:3], 10, "cosine")


def test_text_ids(spark):
    p = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "item_id STRING, item_vec ARRAY<FLOAT>")
    q = spark.createDataFrame([("x", [2.0, 0.1])], "query_id STRING, query_vec ARRAY<FLOAT>")
    assert [r["item_id"] for r in search.top_k(q, p, 2).orderBy("rank").collect()] == ["a", "b"]


def test_small_results_are_joined_without_shuffling_the_large_side(spark, vectors):
    q, p = frames(spark, *vectors)
    plan = search.top_k(q, p, 5).join(p, "item_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_perfect_ranking_and_published_values(spark):
    """A perfect ranking has nDCG 1; and a published row follows from its own counts."""
    pool = spark.createDataFrame([(i,) for i in range(200)], "item_id INT")
    queries = spark.createDataFrame([("perfect",), ("piano",), ("none",)], "query_id STRING")
    # published: 29 positives of 200, P@10 0.2 and nDCG@10 0.21222636597291458; hits at ranks found to give that value
    import itertools
    import math

    ideal = sum(1 / math.log2(i + 1) for i in range(1, 11))
    ranks = next(c for c in itertools.combinations(range(1, 11), 2) if abs(sum(1 / math.log2(r + 1) for r in c) / ideal - 0.21222636597291458) < 1e-12)
    positives = [("perfect", i) for i in range(5)] + [("piano", r - 1) for r in ranks] + [("piano", i) for i in range(100, 127)]
    ranked = [(q, i, i + 1) for q in ("perfect", "piano", "none") for i in range(10)]
    rows = {r["query_id"]: r for r in evaluation.metric_matrix(
        queries, spark.createDataFrame(ranked, "query_id STRING, item_id INT, rank INT"),
        spark.createDataFrame(positives, "query_id STRING, item_id INT"), pool, [10]).collect()}
    assert rows["perfect"]["ndcg_at_k"] == pytest.approx(1.0) and rows["perfect"]["hit_at_k"] == 1.0
    piano = rows["piano"]
    assert (piano["n_pool"], piano["n_positive"], piano["prevalence"], piano["precision_at_k"]) == (200, 29, 0.145, 0.2)
    assert piano["ndcg_at_k"] == pytest.approx(0.21222636597291458)
    assert piano["ndcg_random_mean"] == pytest.approx(0.13997947122700596, abs=0.02)
    assert (rows["none"]["precision_at_k"], rows["none"]["ndcg_at_k"], rows["none"]["ndcg_random_mean"]) == (0.0, 0.0, 0.0)


def test_random_draws_agree_with_the_closed_form(spark):
    counts = spark.createDataFrame([("a", 200, 29), ("b", 200, 139), ("c", 8, 3)], "query_id STRING, n_pool BIGINT, n_positive BIGINT")
    got = {r["query_id"]: r["ndcg_random_mean"] for r in evaluation.random_ndcg_draws(counts, 10, iterations=3000).collect()}
    assert got["a"] == pytest.approx(0.145, abs=0.01) and got["b"] == pytest.approx(0.695, abs=0.01)


def test_graded_ndcg_matches_brute_force(spark):
    import math

    rng = np.random.default_rng(3)
    rel = rng.integers(0, 4, size=40).astype(float)
    graded = spark.createDataFrame([("q", i, float(r)) for i, r in enumerate(rel)], "query_id STRING, item_id INT, relevance DOUBLE")
    ranked = spark.createDataFrame([("q", i, i + 1) for i in range(10)], "query_id STRING, item_id INT, rank INT")
    dcg = sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rel[:10]))
    best = sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(sorted(rel, reverse=True)[:10]))
    assert evaluation.graded_ndcg(ranked, graded, 10).first()["ndcg_at_k"] == pytest.approx(dcg / best)


def test_judged_rows(spark):
    rows = [("q1", "mood", 1, 2.0), ("q1", "mood", 2, None), ("q1", "mood", 3, 0.0), ("q1", "mood", 4, 3.0), ("q2", "style", 1, 0.0), ("q3", "style", 1, None)]
    scores = evaluation.judged_scores(spark.createDataFrame(rows, "query_id STRING, query_type STRING, rank INT, relevance DOUBLE"), 3)
    got = {r["query_id"]: (r["num_judged"], r["precision_at_k"], r["hitrate_at_k"], r["ndcg_at_k"]) for r in scores.collect()}
    assert got == {"q1": (2, 0.5, 1.0, 1.0), "q2": (1, 0.0, 0.0, 0.0)}
    rolled = {r["query_type"]: (r["queries"], r["precision_at_k"]) for r in evaluation.judged_rollup(scores).collect()}
    assert rolled == {None: (2, 0.25), "mood": (1, 0.5), "style": (1, 0.0)}


def test_label_positives_rules(spark):
    pool = spark.createDataFrame([(1, 1, 2), (2, 0, 0), (3, None, 1)], "item_id INT, a INT, b INT")
    one = {tuple(r) for r in evaluation.label_positives(pool, "item_id", ["a", "b"]).collect()}
    nonzero = {tuple(r) for r in evaluation.label_positives(pool, "item_id", ["a", "b"], truthy="nonzero").collect()}
    assert one == {("a", 1), ("b", 3)} and nonzero == {("a", 1), ("b", 1), ("b", 3)}


def test_prefix_queries():
    specs = evaluation.prefix_queries([("t1", "piano"), ("t2", "vocal")])
    assert [(q, n, p) for q, n, p, _ in specs] == [("t1", 1, "piano"), ("t1;t2", 2, "piano vocal")]


def test_memory_slices_do_not_change_results(spark, vectors, monkeypatch):
    queries, pool = vectors
    whole = list(search.best_rows_of(queries, pool, np.arange(len(pool)), 5, "cosine"))
    monkeypatch.setattr(search, "SCORES_IN_MEMORY", 1300)
    sliced = list(search.best_rows_of(queries, pool, np.arange(len(pool)), 5, "cosine"))
    assert [(q, i.tolist()) for q, i, _ in whole] == [(q, i.tolist()) for q, i, _ in sliced]


def test_undefined_scores_do_not_hide_others(spark):
    p = spark.createDataFrame([(1, [float("nan"), 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "item_id BIGINT, item_vec ARRAY<DOUBLE>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id BIGINT, query_vec ARRAY<DOUBLE>")
    assert [r["item_id"] for r in search.top_k(q, p, 3).orderBy("rank").collect()] == [2, 3, 4]


@pytest.mark.parametrize("n", [1, 3_000, 20_000, 120_000, 1_000_000])
def test_work_units_are_bounded_in_pairs(n):
    units, splits = search.work_grid(n, n, 64, 5)
    assert n / units * (n / splits) <= search.UNIT_PAIRS and n / units * 112 <= search.UNIT_BYTES and n / splits * 272 <= search.UNIT_BYTES
    assert units * splits <= 1 + 3 * (1 + n * n // search.UNIT_PAIRS)


def test_work_units_keep_partitions_of_their_own(spark, vectors, monkeypatch):
    """Bytes of a unit are few, so adaptive execution would put all of them into one task."""
    monkeypatch.setattr(search, "UNIT_PAIRS", 500)
    q, p = frames(spark, *vectors)
    found = []
    monkeypatch.setattr(search, "pin", lambda df, label="pinned", keep=search.pin: found.append((label, df.rdd.getNumPartitions())) or keep(df, label))
    assert search.top_k(q, p, 3, route="bounds").count() > 0
    units, splits = search.work_grid(p.count(), q.count(), len(p.first()["item_vec"]), 3)
    assert units * splits > 8 and dict(found)["near"] == units * splits
