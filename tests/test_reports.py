"""Statistics, classification, run analysis and refinement; published figures serve as golden values."""

import pytest
from pyspark.sql import functions as F

from earmark.functions.encoders import hash_encoder, project_features
from earmark.operators import ablation, classification, evaluation, refining, runs
from earmark.operators.filters import classify_log
from earmark.streaming import incremental

# Published P@10 per data set, arm, tag and seed (42, 43, 44).
PUBLIC = {
    ("one", "pretrained"): ((0.9, 0.9, 1.0), (0.5, 0.5, 0.5), (0.5, 0.3, 0.5)),
    ("one", "home"): ((0.6, 0.5, 0.8), (0.4, 0.2, 0.2), (0.1, 0.3, 0.2)),
    ("one", "mixed"): ((0.6, 0.6, 0.7), (0.3, 0.3, 0.2), (0.4, 0.3, 0.2)),
    ("two", "pretrained"): ((1.0, 1.0, 1.0), (0.9, 0.8, 0.9), (0.6, 0.7, 0.6)),
    ("two", "home"): ((0.9, 0.8, 0.9), (0.3, 0.3, 0.4), (0.3, 0.3, 0.3)),
    ("two", "mixed"): ((0.9, 0.9, 0.9), (0.8, 0.7, 0.7), (0.4, 0.4, 0.5)),
    ("three", "pretrained"): ((1.0, 1.0, 1.0), (0.9, 0.9, 0.9), None),
    ("three", "home"): ((1.0, 1.0, 1.0), (0.4, 0.4, 0.4), None),
    ("three", "mixed"): ((1.0, 1.0, 1.0), (0.8, 0.8, 0.8), None),
}
HOME = {"home": (0.4, 0.9, 0.5), "mixed": (0.4, 0.8, 0.5)}
TAGS = ("inst_piano", "inst_vocal", "mood_relaxing")
MATRIX = "dataset STRING, arm STRING, seed INT, query_id STRING, top_k INT, n_pool INT, n_positive INT, precision_at_k DOUBLE, ndcg_delta DOUBLE"


@pytest.fixture(scope="module")
def matrices(spark):
    public = [(d, a, 42 + i, tag, 10, 100, 10, p, p / 2) for (d, a), tags in PUBLIC.items() for tag, ps in zip(TAGS, tags, strict=True) if ps for i, p in enumerate(ps)]
    gold = [("gold", a, s, tag, 10, 200, 29, p, p / 2) for a, ps in HOME.items() for tag, p in zip(TAGS, ps, strict=True) for s in (42, 43, 44)]
    noise = [("one", "home", 42, "inst_piano", 5, 100, 10, 0.0, 0.0)]
    return spark.createDataFrame(gold, MATRIX), spark.createDataFrame(public + noise, MATRIX)


def test_published_tradeoff_table(spark, matrices):
    rows = {r["query_id"]: r for r in ablation.tradeoff_table(*matrices, 10, "home", "mixed").collect()}
    piano, vocal, relaxing = (rows[t] for t in TAGS)
    assert (piano["home_ood_macro"], piano["mixed_ood_macro"], piano["pretrained_ood_macro"]) == pytest.approx((0.8333333333, 0.8444444444, 0.9777777778))
    assert (vocal["home_ood_macro"], vocal["mixed_ood_macro"], vocal["pretrained_ood_macro"]) == pytest.approx((0.3333333333, 0.6, 0.7555555556))
    assert (relaxing["home_ood_macro"], relaxing["mixed_ood_macro"], relaxing["pretrained_ood_macro"]) == pytest.approx((0.25, 0.3666666667, 0.5333333333))
    assert vocal["gold_delta"] == pytest.approx(-0.1) and vocal["ood_delta"] == pytest.approx(0.2666666667)
    assert "No clear tradeoff" in vocal["interpretation"] and "No clear tradeoff" in piano["interpretation"]
    assert "Forgetting" in relaxing["interpretation"]


def test_macro_map_and_summary(spark, matrices):
    rows = {(r["arm"], r["query_id"]): r for r in ablation.macro_over_datasets(matrices[1], 10).collect()}
    assert rows[("mixed", "inst_vocal")]["by_dataset"] == pytest.approx({"one": 0.2666666667, "two": 0.7333333333, "three": 0.8})
    assert rows[("home", "mood_relaxing")]["n_datasets"] == 2
    summary = ablation.arm_summary(matrices[1], ["dataset", "arm", "query_id"], 10)
    one = summary.filter("dataset = 'one' AND arm = 'home' AND query_id = 'inst_piano'").first()
    assert one["precision_stdev"] == pytest.approx(0.1247219129) and one["n_seeds"] == 3
    deltas = ablation.baseline_delta(summary, ["dataset", "query_id"], "pretrained")
    assert deltas.filter("dataset = 'two' AND arm = 'mixed' AND query_id = 'inst_vocal'").first()["delta_precision"] == pytest.approx(-0.1333333333)


def test_single_seed_and_no_seed(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", None)], "k STRING, v DOUBLE")
    got = {r["k"]: (r["v_mean"], r["v_stdev"]) for r in rows.groupBy("k").agg(*ablation.seed_stats("v", "v")).collect()}
    assert got == {"a": (0.5, 0.0), "b": (None, None)}
    finite = spark.createDataFrame([(1.0,), (float("-inf"),), (float("nan"),)], "v DOUBLE").agg(*ablation.finite_stats("v", "v")).first()
    assert tuple(finite) == (1.0, 0.0, 1)


def test_arm_comparison(spark, matrices):
    rows = ablation.compare_arms(matrices[1], ["query_id"], 10, "home", "mixed").collect()
    assert {r["query_id"]: r["verdict"] for r in rows}["inst_vocal"] == "LLM arm better"


# Published confusion matrices (rows are truth) with accuracy and macro F1.
CLIPS = ((231, 198, 56), (612, 1571, 940), (773, 1524, 1352)), 0.4346148546231225, 0.38683353921291647
SONGS = ((4, 1, 0), (19, 40, 24), (29, 50, 33)), 0.385, 0.3302178455047365


@pytest.mark.parametrize("published", [CLIPS, SONGS])
def test_published_class_metrics(spark, published):
    matrix, accuracy, macro = published
    labels = ["slow", "mid-tempo", "fast"]
    pairs = [(labels[i], labels[j]) for i in range(3) for j in range(3) for _ in range(matrix[i][j])]
    df = spark.createDataFrame(pairs + [("odd", "slow")], "truth STRING, pred STRING")
    rows = {r["label"]: r for r in classification.class_metrics(classification.confusion_counts(df, "truth", "pred", labels)).collect()}
    assert rows["slow"]["accuracy"] == pytest.approx(accuracy) and rows["slow"]["macro_f1"] == pytest.approx(macro)
    assert rows["fast"]["support"] == sum(matrix[2])


def test_class_metrics_without_rows(spark):
    df = spark.createDataFrame([], "truth STRING, pred STRING")
    rows = classification.class_metrics(classification.confusion_counts(df, "truth", "pred", ["a", "b"])).collect()
    assert [(r["f1"], r["accuracy"], r["macro_f1"]) for r in rows] == [(0.0, 0.0, 0.0)] * 2


def test_majority_vote_and_ties(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 2.0), ("s", "b", 9.0), ("t", "a", 1.0), ("t", "b", 2.0), ("u", "c", 5.0)], "song STRING, label STRING, v DOUBLE")
    got = {r["song"]: (r["majority"], r["mean_value"]) for r in classification.majority_vote(df, "song", "label", "v").collect()}
    assert got == {"s": ("a", 4.0), "t": (None, 1.5), "u": ("c", 5.0)}


def test_mean_vectors_and_argmax(spark):
    df = spark.createDataFrame([("s", [0.2, 0.8]), ("s", [0.6, 0.2]), ("t", [0.5, 0.5])], "song STRING, scores ARRAY<DOUBLE>")
    means = classification.mean_vectors(df, "song", "scores", "m").withColumn("best", classification.argmax_label(F.col("m"), ["slow", "fast"]))
    assert {r["song"]: r["best"] for r in means.collect()} == {"s": "fast", "t": "slow"}


def test_zero_shot(spark):
    items = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 2.0])], "id INT, v ARRAY<FLOAT>")
    rows = {r["id"]: r for r in classification.zero_shot(items, [[1, 0], [0, 1]], ["x", "y"], "v").collect()}
    assert rows[1]["pred"] == "x" and rows[2]["pred"] == "y" and rows[2]["margin"] == pytest.approx(1.0)


# Published validation similarities of one run, epochs 1 to 6.
EPOCHS = (0.3034038855626114, 0.41055181070549396, 0.540045948999875, 0.5785702893064721, 0.4927333163978183, 0.3990627492359255)


def test_published_early_stop(spark):
    log = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate((*EPOCHS, 0.9))], "run STRING, epoch INT, val_similarity DOUBLE")
    row = runs.early_stop(log, "run", "epoch", "val_similarity", patience=2, min_epochs=5).first()
    assert (row["stop_epoch"], row["best_epoch"], row["best_metric"], row["n_logged"]) == (6, 4, pytest.approx(0.5785702893064721), 7)


def test_best_epoch_and_records(spark):
    log = spark.createDataFrame([("a", 1, None, 0.5, None), ("a", 2, None, 0.7, None), ("a", 3, None, 0.7, None), ("b", 7, 0.8, 0.8177, None), ("c", 1, None, None, 0.3)],
                                "run STRING, epoch INT, checkpoint_metric DOUBLE, val_similarity DOUBLE, train_similarity DOUBLE")
    record = spark.createDataFrame([("b", 5, 0.9079)], "run STRING, best_epoch INT, best_similarity DOUBLE")
    got = {r["run"]: (r["best_epoch"], r["best_metric"]) for r in runs.best_epoch(log, "run", record).collect()}
    assert got == {"a": (2, 0.7), "b": (5, 0.9079), "c": (1, 0.3)}


def test_completeness_rules(spark):
    log = spark.createDataFrame([("a", 6, 0.5), ("b", 1, 0.5), ("c", 6, None)], "run STRING, epoch INT, val_similarity DOUBLE")
    flagged = spark.createDataFrame([("c",), ("d",)], "run STRING")
    got = {r["run"]: r["complete"] for r in runs.run_complete(log, "run", flagged).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}
    states = runs.group_state(runs.run_complete(log, "run").withColumn("g", F.lit("all")), "g").first()
    assert (states["n_complete"], states["status"]) == (1, "partial")


def test_plateau(spark):
    vals = {"ok": [0.1, 0.2, 0.2, 0.2, 0.2], "gain": [0.1, 0.2, 0.2, 0.5, 0.5], "late": [0.3, 0.3, 0.3, 0.3, 0.3, 0.3]}
    log = spark.createDataFrame([(r, i, v, not (r == "late" and i < 4)) for r, vs in vals.items() for i, v in enumerate(vs)], "run STRING, it INT, v DOUBLE, inner_ok BOOLEAN")
    got = {r["run"]: r["stop_iteration"] for r in runs.plateau_stop(log, "run", "it", "v", 0.01, 2, F.col("inner_ok")).collect()}
    assert got == {"ok": 3, "gain": None, "late": 4}  # iterations as logged, from 0


def test_step_states(spark):
    steps = spark.createDataFrame([("g", 0, True, False), ("g", 1, False, True), ("g", 2, False, False), ("g", 3, True, False), ("h", 0, False, False)], "g STRING, step INT, done BOOLEAN, started BOOLEAN")
    got = {(r["g"], r["step"]): r["state"] for r in runs.step_states(steps, "g", "step", "done", "started").collect()}
    assert got == {("g", 0): "done", ("g", 1): "running", ("g", 2): "pending", ("g", 3): "done", ("h", 0): "next"}


def test_coverage_states(spark):
    present = spark.createDataFrame([("one", a, s) for a in ("x", "y") for s in (1, 2)] + [("two", "x", 1)], "dataset STRING, arm STRING, seed INT")
    got = {r["dataset"]: r["eval_state"] for r in runs.evaluation_coverage(present, ["one", "two", "three"], ["x", "y"], 2).collect()}
    assert got == {"one": "done", "two": "partial", "three": "pending"}


def test_log_states(spark):
    bodies = ["Domain Tradeoff\nstep\nDone.", "public OOD eval\nTraceback (most recent call last)\n", "SKIP_TRAIN=1\nx\nDone.\n", "public-dl Slurm job\n" + "\n".join(f"l{i}" for i in range(20)), "hello"]
    rows = classify_log(spark.createDataFrame(list(enumerate(bodies)), "i INT, value STRING")).orderBy("i").collect()
    assert [(r["phase"], r["state"]) for r in rows] == [
        ("domain_tradeoff", "completed"), ("public_ood_eval", "failed"), ("skipped_train", "skipped"), ("public_ood_download", "running"), ("unknown", "running")]
    assert rows[3]["tail"] == [f"l{i}" for i in range(12, 20)]


def test_label_balance(spark):
    df = spark.createDataFrame([("1", "0"), ("x", "2"), ("", "")], "inst_piano STRING, mood_epic STRING")
    got = {r["label"]: (r["n_positive"], r["n_no_mood"], r["n_rows"]) for r in ablation.label_balance(df, ["inst_piano", "mood_epic"], ["mood_epic"]).collect()}
    assert got == {"inst_piano": (1, 2, 3), "mood_epic": (1, 2, 3)}


def test_self_train_round(spark):
    rows = [(f"p{i}", f"text {i}", [float(i % 3) - 1, 1.0, 0.5, -0.5, 0.2, 0.1, 0.0, 0.3]) for i in range(20)]
    train = spark.createDataFrame(rows, "audio_path STRING, text STRING, vec ARRAY<FLOAT>")

    def load():
        return lambda texts: texts.where(texts != "text 1", None) + "!"

    hard, gated, mixed = refining.self_train_round(train, "vec", hash_encoder(), load, 0, fraction=0.5, min_text_cos=-1.0)
    counts = refining.gate_counts(gated).first()
    assert hard.count() == 10 == counts["n_in"] and counts["n_accepted"] + counts["n_rejected_sim"] + counts["n_dropped"] == 10
    assert mixed.count() == 20 + counts["n_accepted"] and mixed.filter("source = 'hard'").count() == counts["n_accepted"]
    sims = [r["sim"] for r in hard.collect()]
    assert max(sims) <= 1.0 and all(r["gate"]["sim_new"] > r["gate"]["sim_old"] for r in gated.filter("gate.accepted").collect())


def test_projection(spark):
    import numpy as np

    df = spark.createDataFrame([("a", [3.0, 4.0])], "k STRING, f ARRAY<FLOAT>")
    assert project_features(df, "f", "v", np.eye(2)).first()["v"] == pytest.approx([0.6, 0.8])


def test_stream_processes_each_key_once(spark, tmp_path):
    source, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    calls = []

    def process(rows):
        calls.append(1)
        return rows.withColumn("status", F.when(F.col("v") < 0, "failed").otherwise("ok"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), "k STRING, v DOUBLE").coalesce(1).write.mode("append").json(source)
        incremental.process_new_files(spark, source, "k STRING, v DOUBLE", process, ledger, state, "k")
        return sorted((r["k"], r["status"]) for r in incremental.read_ledger(spark, ledger, "k STRING, v DOUBLE, status STRING").collect())

    assert arrive(("a", 1.0), ("a", 1.0), ("b", -1.0)) == [("a", "ok"), ("b", "failed")]
    assert arrive(("a", 2.0), ("c", 3.0)) == [("a", "ok"), ("b", "failed"), ("c", "ok")]
    n = len(calls)
    incremental.process_new_files(spark, source, "k STRING, v DOUBLE", process, ledger, state, "k")
    assert len(calls) == n  # nothing new, nothing done


def test_batch_run_records_only_successes_when_asked(spark, tmp_path):
    from earmark.sources.jsonl import append_ledger, read_jsonl

    path = str(tmp_path / "ledger")
    work = spark.createDataFrame([("a", 1), ("b", -1)], "k STRING, v INT")
    append_ledger(spark.createDataFrame([("z", "ok")], "k STRING, status STRING"), path)

    def process(rows):
        return rows.select("k", F.when(F.col("v") < 0, "failed").otherwise("ok").alias("status"))

    for _ in range(2):
        incremental.run_pending(work, read_jsonl(spark, path, "k STRING, status STRING"), path, "k", process, record_failures=False)
    assert sorted(r["k"] for r in read_jsonl(spark, path, "k STRING, status STRING").collect()) == ["a", "z"]


def test_late_start_and_nan_metrics(spark):
    nan = float("nan")
    rows = [("a", e, m) for e, m in ((4, 0.1), (5, 0.9), (6, nan), (7, 0.2), (8, 0.3), (9, 0.95))]
    log = spark.createDataFrame(rows, "run STRING, epoch INT, val_similarity DOUBLE")
    row = runs.early_stop(log, "run", "epoch", "val_similarity", patience=3, min_epochs=5).first()
    assert (row["best_epoch"], row["stop_epoch"], row["best_metric"]) == (5, 8, 0.9)
    assert tuple(runs.best_epoch(log, "run", monitor="val_similarity").first()) == ("a", 9, 0.95)
    assert tuple(runs.best_epoch(log.filter("epoch < 9"), "run", monitor="val_similarity").first()) == ("a", 5, 0.9)


def test_key_comes_again_after_the_state_is_gone(spark, tmp_path, monkeypatch):
    source, ledger = (str(tmp_path / n) for n in ("in", "ledger"))
    done = []

    def process(rows):
        done.extend(r["k"] for r in rows.select("k").collect())
        return rows.withColumn("status", F.lit("ok"))

    def arrive(checkpoint, *keys):
        spark.createDataFrame([(k, 1.0) for k in keys], "k STRING, v DOUBLE").coalesce(1).write.mode("append").json(source)
        incremental.process_new_files(spark, source, "k STRING, v DOUBLE", process, ledger, str(tmp_path / checkpoint), "k", buckets=5)

    arrive("one", "a", "b", "a", "c")
    arrive("one", "c", "d")
    arrive("two", "a", "e")  # a new checkpoint sees all files again, and counts its batches from 0
    assert sorted(done) == ["a", "b", "c", "d", "e"]
    got = incremental.read_ledger(spark, ledger, "k STRING, v DOUBLE, status STRING").collect()
    assert sorted(r["k"] for r in got) == ["a", "b", "c", "d", "e"] and len({r["batch"].split("-")[-1] for r in got}) == 2
    state = tmp_path / "two" / "state"
    assert not state.exists() or not any(p.suffix in (".delta", ".zip") for p in state.rglob("*"))  # the stream keeps none
    incremental.compact_keys(spark, f"{ledger}_keys", str(tmp_path / "compact"), "k", "string")
    spark.createDataFrame([("a", 1.0), ("f", 1.0)], "k STRING, v DOUBLE").coalesce(1).write.mode("append").json(source)
    incremental.process_new_files(spark, source, "k STRING, v DOUBLE", process, ledger, str(tmp_path / "two"), "k", buckets=5, keys_path=str(tmp_path / "compact"))
    assert sorted(done) == ["a", "b", "c", "d", "e", "f"]


def test_batch_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    source, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k STRING, v DOUBLE").coalesce(1).write.json(source)
    write = incremental.write_jsonl

    def once(rows, path, mode):
        write(rows, path, mode)
        monkeypatch.setattr(incremental, "write_jsonl", write)
        raise OSError("lost after the ledger was written")

    monkeypatch.setattr(incremental, "write_jsonl", once)
    run = lambda: incremental.process_new_files(spark, source, "k STRING, v DOUBLE", lambda r: r.withColumn("status", F.lit("ok")), ledger, state, "k")
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert sorted(r["k"] for r in incremental.read_ledger(spark, ledger, "k STRING, status STRING").collect()) == ["a", "b"]


def test_composite_positives_of_many_queries(spark):
    import random

    draw = random.Random(2)
    tags = [f"t{i}" for i in range(60)]
    items = [(i, {t: draw.choice((0, 1, 2, None)) for t in draw.sample(tags, 12)}) for i in range(150)]
    queries = [(f"q{i}", draw.sample(tags, draw.randrange(1, 4)) + ["t0"] * (i % 2)) for i in range(10_000)] + [("none", []), ("absent", ["t1", "nowhere"]), ("twice", ["t2", "t2"])]
    pool = spark.createDataFrame(items, "id INT, labels MAP<STRING, INT>")
    got = evaluation.composite_positives(pool, "id", "labels", spark.createDataFrame(queries, "query_id STRING, tag_ids ARRAY<STRING>")).collect()
    want = {(q, i) for q, ts in queries for i, labels in items if all(labels.get(t) for t in ts)}
    assert {(r["query_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 5000 and sum(q == "none" for q, _ in want) == 150


@pytest.mark.parametrize("blocks", [1, 7, 20])
def test_zero_shot_over_blocks_of_labels(spark, blocks):
    import numpy as np

    rng = np.random.default_rng(blocks)
    labels, vectors = [f"l{i:02}" for i in range(20)], rng.normal(size=(20, 4))
    vectors[11] = vectors[3]  # a tie goes to the smaller label
    items = np.vstack([rng.normal(size=(60, 4)), vectors[3:4], np.zeros((1, 4))])
    prompts = spark.createDataFrame([(x, v.tolist()) for x, v in zip(labels, vectors)], "name STRING, vec ARRAY<DOUBLE>").repartition(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(99, None)], "id INT, v ARRAY<DOUBLE>")
    most = 8 * 4 * -(-20 // blocks)
    got = {r["id"]: (r["pred"], r["margin"]) for r in classification.zero_shot_table(df, prompts, "id", "v", "name", "vec", most).collect()}
    scores = np.round((vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ (items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-300)).T).T, 9)
    for i, row in enumerate(scores):
        order = np.argsort(-row, kind="stable")
        assert got[i][0] == labels[order[0]] and got[i][1] == pytest.approx(row[order[0]] - row[order[1]])
    assert len(got) == len(items)
    assert classification.zero_shot_table(df, prompts.limit(0), "id", "v", "name", "vec").count() == len(items)


def test_each_text_is_encoded_once(spark, tmp_path):
    import numpy as np

    from earmark.functions.encoders import encode_columns

    folder = str(tmp_path)

    def load():
        def encode(texts):
            with open(f"{folder}/{abs(hash(tuple(texts)))}-{len(texts)}", "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2)

        return encode

    rows = [(i, f"old {i % 7}", f"new {i % 5}" if i % 3 else None) for i in range(200)] + [(200, "new 1", "old 1"), (201, None, "")]
    df = spark.createDataFrame(rows, "id INT, a STRING, b STRING").repartition(6)
    got = {r["id"]: (r["va"], r["vb"]) for r in encode_columns(df, {"a": "va", "b": "vb"}, load).collect()}
    assert got == {i: ([float(len(a or "")), 1.0], [float(len(b or "")), 1.0]) for i, a, b in rows}
    told = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")[:-1]]
    assert sorted(told) == sorted({x or "" for _, a, b in rows for x in (a, b)})


def test_a_round_encodes_each_text_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        encode = hash_encoder()()

        def noted(texts):
            with open(f"{folder}/{abs(hash(tuple(texts)))}", "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return encode(texts)

        return noted

    train = spark.createDataFrame([(f"p{i}", f"text {i % 8}", [float(i % 3) - 1, 1.0, 0.5, -0.5, 0.2, 0.1, 0.0, 0.3]) for i in range(20)], "audio_path STRING, text STRING, vec ARRAY<FLOAT>")
    hard, gated, _ = refining.self_train_round(train, "vec", load, lambda: lambda texts: texts + "!", 0, fraction=0.5, min_text_cos=-1.0)
    assert hard.count() == gated.count() == 10 and {"rank_pct", "mean_sim_hard"} <= set(hard.columns) and "vec" not in hard.columns
    told = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")[:-1]]
    assert len(told) == len(set(told)) and {t for t in told if not t.endswith("!")} == {f"text {i}" for i in range(8)}


def test_plateau_of_a_log_that_starts_late(spark):
    rows = [("a", i, m) for i, m in zip(range(4, 9), (0.5, 0.6, 0.6, 0.6, 0.6))]
    log = spark.createDataFrame(rows, "run STRING, it INT, v DOUBLE")
    assert runs.plateau_stop(log, "run", "it", "v", 0.01, 2, F.lit(True)).first()["stop_iteration"] == 7


@pytest.mark.parametrize(("there", "results", "report", "state", "overall"), [
    ((), (), False, ("pending", "pending"), "pending"), (("a1",), (), False, ("partial", "pending"), "partial"), (("a1", "a2"), (), False, ("done", "next"), "partial"),
    (("a1", "a2"), (1,), False, ("done", "partial"), "partial"), (("a1", "a2"), (1, 2), False, ("done", "done"), "eval pending"), (("a1", "a2"), (1, 2), True, ("done", "done"), "done"),
    (("a1",), (1, 2), True, ("partial", "done"), "partial")])
def test_states_of_files_and_results(spark, there, results, report, state, overall):
    manifests = spark.createDataFrame([("one", "a1"), ("one", "a2")], "dataset STRING, audio_path STRING")
    inventory = spark.createDataFrame([(p,) for p in (*there, *there, "other")], "path STRING")
    present = spark.createDataFrame([("one", "x", s) for s in results], "dataset STRING, arm STRING, seed INT")
    ready = runs.audio_readiness(manifests, inventory, ["one", "two"])
    states = runs.coverage_states(ready, present, ["x"], 2)
    got = {r["dataset"]: (r["prep_state"], r["eval_state"]) for r in states.collect()}
    assert got == {"one": state, "two": ("pending", "pending")}
    assert runs.overall_state(states, report).first()["state"] == overall


def test_public_sets_with_different_tags(spark):
    from earmark.functions.encoders import encode_column
    from earmark.plans import public_evaluation as public

    rows = [(d, f"{d}{i}", [1.0, float(i)] + [0.1] * 6, int(i < 2), int(i % 2), 1) for d in ("jamendo", "openmic") for i in range(6)]
    pools = spark.createDataFrame(rows, "dataset STRING, item_id STRING, item_vec ARRAY<DOUBLE>, gold_pub_piano INT, gold_pub_vocal INT, gold_pub_relaxing INT")
    bridge = public.tag_bridge(spark).filter("dataset <> 'mtat'")
    matrix = public.public_matrix(pools, bridge, lambda df, t, v: encode_column(df, t, v, hash_encoder()), (3,))
    got = {(r["dataset"], r["query_id"]): (r["n_pool"], r["n_positive"]) for r in matrix.collect()}
    assert got == {("jamendo", "inst_piano"): (6, 2), ("jamendo", "inst_vocal"): (6, 3), ("jamendo", "mood_relaxing"): (6, 6), ("openmic", "inst_piano"): (6, 2), ("openmic", "inst_vocal"): (6, 3)}
    macro = {r["query_id"]: r["n_datasets"] for r in public.macro_rows(matrix, ["precision_at_k"]).collect()}
    assert macro == {"inst_piano": 2, "inst_vocal": 2, "mood_relaxing": 1}
