"""Public manifests, tempo evaluation and mixed corpora as whole runs over small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.constants import TEMPO_LABELS, TEMPO_PROMPTS
from earmark.functions.encoders import encode_column
from earmark.plans import corpus, public_manifests, tempo_evaluation
from earmark.sources.jsonl import append_ledger, read_jsonl


def parts():
    """The i-th prompt is the i-th unit vector; a path holds its beats and ends with the digits of its vector."""
    prompts = TEMPO_PROMPTS

    def load_prompts():
        return lambda texts: np.array([np.eye(3)[prompts.index(t)] for t in texts]).reshape(-1, 3)

    def load_sounds():
        return lambda paths: np.array([[float(c) for c in p.split("_")[-1]] for p in paths]).reshape(-1, 3)

    return {
        "measure": lambda df, path: df.withColumn("bpm", F.regexp_extract(path, r"/b(\d+)_", 1).try_cast("double")),
        "encode_audio": lambda df, c, v: encode_column(df, c, v, load_sounds), "encode_text": lambda df, c, v: encode_column(df, c, v, load_prompts), "root": "/r"}


def test_clip_run_resumes(spark, tmp_path):
    clips = ["b70_900", "b100_190", "b130_009", "bad_110", "b70_550", "b99_000", "gone_001"]
    manifest = spark.createDataFrame([(c,) for c in [*clips, " ", None]], "audio_path STRING")
    inventory = spark.createDataFrame([(f"/r/{c}",) for c in clips[:-1]] * 2, "path STRING")
    schema = "audio_path STRING, status STRING, bpm DOUBLE, gt_tempo STRING, pred_tempo STRING"
    path = str(tmp_path / "ledger")
    append_ledger(spark.createDataFrame([("b70_900", "ok", 70.0, "slow", "fast"), ("old", "ok", 1.0, "other", "slow")], schema), path)
    new = tempo_evaluation.clip_run(manifest, read_jsonl(spark, path, schema), inventory, **parts())
    got = {r["audio_path"]: r for r in new.collect() if r["audio_path"] and r["audio_path"].strip()}
    assert {k: (r["status"], r["gt_tempo"], r["pred_tempo"]) for k, r in got.items()} == {
        "b100_190": ("ok", "mid-tempo", "mid-tempo"), "b130_009": ("ok", "fast", "fast"), "bad_110": ("bpm_error", None, None), "b70_550": ("ok", "slow", "slow"),
        "b99_000": ("ok", "mid-tempo", "slow"), "gone_001": ("missing_file", None, None)}
    assert got["b70_550"]["margin_top1_top2"] == 0.0 and got["b130_009"]["scores"]["fast"] == 1.0
    assert new.filter("status = 'missing_audio_field'").count() == 2
    metrics = tempo_evaluation.run_metrics(read_jsonl(spark, path, schema), new).first()
    assert (metrics["num_valid_for_eval"], metrics["num_resumed_predictions"], metrics["num_new_predictions"], metrics["num_skipped_this_run"]) == (5, 1, 4, 4)
    assert metrics["accuracy"] == pytest.approx(3 / 5)
    append_ledger(new, path)
    again = tempo_evaluation.clip_run(manifest, read_jsonl(spark, path, schema), inventory, **parts())
    assert {r["status"] for r in again.collect()} == {"missing_audio_field"}


def test_song_run_votes_and_ties(spark):
    songs = {
        "votes": ["b70_900", "b75_090", "b130_900"], "tie": ["b70_901", "b130_109", "b100_010"], "blank": ["b70_900", " ", "gone_900"], "gone": ["b70_900", "gone_900"],
        "unmeasured": ["bad_900", "gone_900"], "none": [], "done": ["b70_900"], "one": ["b121_001"]}
    manifest = spark.createDataFrame([*songs.items(), (" ", ["b70_900"])], "source_path STRING, eval_audio_paths ARRAY<STRING>")
    inventory = spark.createDataFrame([(f"/r/{c}",) for cs in songs.values() for c in cs if not c.startswith("gone")], "path STRING")
    ledger = spark.createDataFrame([("done ", "missing_file")], "source_path STRING, status STRING")
    got = {r["source_path"]: r for r in tempo_evaluation.song_run(manifest, ledger, inventory, **parts()).collect()}
    assert {k: (r["status"], r["gt_tempo_song"], r["pred_tempo_song"]) for k, r in got.items()} == {
        "votes": ("ok", "slow", "slow"), "tie": ("ok", "mid-tempo", "slow"), "blank": ("bad_clip_path", None, None), "gone": ("missing_file", None, None),
        "unmeasured": ("bpm_error", None, None), "one": ("ok", "fast", "fast")}
    assert got["votes"]["clip_bpms"] == [70.0, 75.0, 130.0] and got["votes"]["clip_pred_tempo"] == ["slow", "mid-tempo", "slow"]
    assert got["tie"]["mean_scores_song"]["slow"] == pytest.approx((9 / np.sqrt(82) + 1 / np.sqrt(82)) / 3) and set(TEMPO_LABELS) == set(got["tie"]["mean_scores_song"].asDict())


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_wide_manifest_from_files(spark, tmp_path):
    rows = [("c1", "1", "0", "0", "a/1.mp3"), ("c2", "0", "1", "1", "a/2.mp3"), ("c3", "x", "0", "", "a/3.mp3"), ("c4", "1", "0", "1", ""), ("c5", "1.0", "0", "0", " a/5.mp3 ")]
    text = "clip_id\tpiano\tmale vocal\tmellow\tmp3_path\n" + "".join("\t".join(r) + "\n" for r in rows)
    inventory = spark.createDataFrame([("/m/mp3s/a/1.mp3", 5), ("/m/a/1.mp3", 5), ("/m/input/a/2.mp3", 0), ("/m/a/5.mp3", 1)], "path STRING, length INT")
    path = write(tmp_path / "annotations.tsv", text)
    got = {r["clip_id"]: (r["gold_pub_piano"], r["gold_pub_vocal"], r["gold_pub_relaxing"], r["audio_path"]) for r in public_manifests.read_wide_manifest(spark, path, inventory, "/m").collect()}
    assert got == {"c1": (1, 0, 0, "/m/mp3s/a/1.mp3"), "c2": (0, 1, 1, None), "c5": (1, 0, 0, "/m/a/5.mp3")}
    manifest = public_manifests.read_wide_manifest(spark, path, inventory, "/m/", cap=1, seed=1)
    assert manifest.filter("gold_pub_piano = 1").count() == 1 and public_manifests.usable_rows(manifest).count() == 1
    with pytest.raises(ValueError):
        public_manifests.read_wide_manifest(spark, write(tmp_path / "bad.tsv", "clip_id\tmp3_path\n"), inventory, "/m")


def test_long_manifest_from_files(spark, tmp_path):
    text = "Sample_Key,Instrument,Relevance\nabc1,piano,0.9\nabc1,Voice ,0.5\nabd2,piano,0.4\nabd3,drums,0.9\nabd4,voice,x\n ,piano,1\nabd5,voice,0.7\n"
    inventory = spark.createDataFrame([("/o/audio/abc/abc1.mp3", 3), ("/o/audio/abc/abc1.wav", 3), ("/o/audio/abd/abd5.ogg", 0)], "path STRING, length INT")
    got = {r["sample_key"]: (r["gold_pub_piano"], r["gold_pub_vocal"], r["gold_pub_relaxing"], r["dataset"], r["audio_path"])
           for r in public_manifests.read_long_manifest(spark, write(tmp_path / "l.csv", text), inventory, "/o").collect()}
    assert got == {"abc1": (1, 1, 0, "openmic", "/o/audio/abc/abc1.wav"), "abd5": (0, 1, 0, "openmic", None)}


@pytest.mark.parametrize(("options", "asked"), [({"mix_ratio": 0.5}, 4), ({"mix_ratio": 0.8}, 16), ({"mix_ratio": None}, 4), ({"mix_ratio": 0.5, "explicit": 2}, 2)])
def test_counters_of_a_mixed_manifest(spark, options, asked):
    schema = "audio_path STRING, gold_pub_piano INT, gold_pub_vocal INT, gold_pub_relaxing INT"
    home = spark.createDataFrame([(f"h{i}", "t") for i in range(4)], "audio_path STRING, text STRING")
    sets = {n: spark.createDataFrame([(f"{n}{i}", 1, i % 2, 0) for i in range(size)], schema) for n, size in (("a", 5), ("b", 3))}
    holdout = spark.createDataFrame([("a0",), ("a0",), ("z",), (None,), (" ",)], "audio_path STRING")
    left = {n: corpus.public_candidates(df, holdout) for n, df in sets.items()}
    mixed = corpus.mixed_manifest(home, left, **options)
    used = min(asked, 7)
    got = {r["name"]: r["n"] for r in corpus.mixed_summary(home, left, holdout, mixed, **options).collect()}
    public = {k: v for k, v in got.items() if k in ("domain_a", "domain_b")}
    assert sum(public.values()) == used and {k: v for k, v in got.items() if k not in public} == {
        "a_candidates": 4, "b_candidates": 3, "home": 4, "total": 4 + used, "holdout_paths": 2, "public_target_requested": asked, "public_target": used, "domain_home": 4}


def test_refined_texts_move_once(spark):
    """Counters and outcomes of the gate meet vectors by digests: texts are in no join, and rows pass the refiner as Arrow batches."""
    from earmark.functions.encoders import hash_encoder
    from earmark.operators import refining

    rows = spark.createDataFrame([(i, f"text {i % 7}" if i % 5 else None, [1.0, float(i)] * 4) for i in range(40)], "id long, text_orig string, v array<double>")
    answered = refining.refine_rows(rows, "text_orig", lambda: lambda texts: (texts + "!").where(texts.str.len() > 5, None), batch_rows=16)
    assert "MapInArrow" in answered._jdf.queryExecution().toString() and [r.text_new for r in answered.orderBy("id").collect()] == [f"text {i % 7}!" if i % 5 else None for i in range(40)]
    gated = refining.gate_refined(answered, "v", hash_encoder(), -9.0, -9.0)
    counts = refining.gate_counts(gated)
    joined = [line for line in counts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joined) == 2 and not any("text" in line for line in joined) and (counts.first().n_accepted, counts.first().n_dropped) == (32, 8)
    assert gated.filter("text_new is not null and gate.accepted and gate.answered").count() == 32


def test_songs_are_chosen_before_their_texts_are_joined(spark):
    from earmark.operators import refining

    clips = spark.createDataFrame([(f"s{k}.mp3", i) for k in range(3) for i in range(5)], "source_path string, segment_index int")
    texts = spark.createDataFrame([(f"/lib/s{k}.mp3", f"long text {k}") for k in range(3)], "source_path string, text string")
    ledger = spark.createDataFrame([("s1.mp3", "known")], "source_path string, text string")
    from pyspark.sql import functions as F

    new = refining.refine_songs(clips, ledger, F.upper("text"), refining.no_op(), root="/lib", order="segment_index", texts=texts)
    assert {tuple(r) for r in new.collect()} == {(f"s{k}.mp3", f"LONG TEXT {k}", f"long text {k}", "llm_full_corpus") for k in (0, 2)}


def test_split_writes_clips_without_their_texts(spark, monkeypatch):
    from earmark.plans import corpus

    written = []
    monkeypatch.setattr(corpus, "pin", lambda df, label="pinned", keep=corpus.pin: written.append(df.columns) or keep(df, label))
    meta = spark.createDataFrame([(f"data/music_db/a{k}.mp3", f"text {k}", "m", 0.5, 0) for k in range(9)], "audio string, text string, mood string, confidence double, _ord int")
    segments = spark.createDataFrame([(f"c{k}_{i}", f"data/music_db/a{k}.mp3", i, 0.0, 1.0, 1.0) for k in range(10) for i in range(3)],
                                     "segment_path string, source_path string, segment_index int, start_sec double, end_sec double, duration_sec double")
    train, val, summary = corpus.train_val_manifests(segments, meta)
    assert written and not any({"text", "mood"} & set(c) for c in written)
    rows = train.collect() + val.collect()
    assert train.columns == ["audio_path", "text", "mood", "confidence", "source_path", "segment_index", "start_sec", "end_sec", "duration_sec"]
    assert len(rows) == 27 and all(r.text == f"text {r.source_path[-5]}" and r.confidence == 0.5 for r in rows) and not {r.source_path for r in train.collect()} & {r.source_path for r in val.collect()}
    assert summary.first().matched_segment_rows == 27 and summary.first().unmatched_segment_rows == 3
