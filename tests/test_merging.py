import pytest
from pyspark.sql import functions as F

from earmark.constants import LABEL_COLUMNS
from earmark.operators import merging, refining
from earmark.operators.filters import any_flag, confidence_band, needs_refetch, review_rows, route_counts, upgrade_sheet


def test_tag_captions(spark):
    manifest = spark.createDataFrame(
        [("a__seg000.mp3", "old a", "data/music_db/a.mp3"), ("b__seg000.mp3", None, "data/music_db/b.mp3"), ("c", "c", " ")],
        "audio_path STRING, text STRING, source_path STRING")
    gold = spark.createDataFrame(
        [("/proj/data/music_db/a.mp3", {"inst_piano": 1, "inst_vocal": 0}, 0), ("data/music_db/a.mp3", {"inst_vocal": 1}, 1)],
        "source_path STRING, human_multihot MAP<STRING,INT>, _ord INT")
    rows = {r["audio_path"]: (r["text"], r["text_source"], r["text_orig"]) for r in merging.tag_captions(manifest, gold, root="/proj").collect()}
    assert rows == {"a__seg000.mp3": ("piano", "tag_primary", "old a"), "b__seg000.mp3": ("music", "tag_no_gold", "")}


def test_two_key_swap(spark):
    manifest = spark.createDataFrame([("clips/a.mp3", "a"), ("/x/b.mp3", "b"), ("c.mp3", "c")], "audio_path STRING, text STRING")
    refined = spark.createDataFrame(
        [("/proj/clips/a.mp3", "by path", 0), ("/elsewhere/a.mp3", "by name", 1), ("b.mp3", " name ", 0), ("c.mp3", "  ", 0)],
        "audio_path STRING, text STRING, _ord INT")
    rows = {r["audio_path"]: (r["text"], r["text_source"], r["text_orig"]) for r in merging.swap_captions(manifest, refined, root="/proj").collect()}
    assert rows == {"clips/a.mp3": ("by path", "llm_refined", "a"), "/x/b.mp3": ("name", "llm_refined", "b"), "c.mp3": ("c", "original", None)}


def test_song_captions_reach_all_clips(spark):
    clips = spark.createDataFrame([(f"c{i}", f"old{i}", "music_db/s.mp3", i) for i in range(2)] + [("d", "kept", "music_db/t.mp3", 0)],
                                  "audio_path STRING, text STRING, source_path STRING, _ord INT")
    songs = refining.unique_songs(clips, root="/p")
    assert {(r["song_key"], r["audio_path"]) for r in songs.collect()} == {("/p/music_db/s.mp3", "c0"), ("/p/music_db/t.mp3", "d")}
    ledger = spark.createDataFrame([("music_db/s.mp3", "stale", 0), ("/p/music_db/s.mp3", "new", 1), ("music_db/t.mp3", " ", 2)], "source_path STRING, text STRING, _ord INT")
    out = {r["audio_path"]: (r["text"], r["text_source"], r["text_orig"]) for r in merging.propagate_captions(clips, ledger, root="/p").collect()}
    assert out == {"c0": ("new", "llm_full_corpus", "old0"), "c1": ("new", "llm_full_corpus", "old1"), "d": ("kept", "original", None)}


def test_completeness(spark):
    work = spark.createDataFrame([("a",), ("a",), ("b",)], "k STRING")
    merging.require_complete(work, spark.createDataFrame([("a",), ("b",), ("x",)], "k STRING"), "k")
    with pytest.raises(RuntimeError, match="1 of 2"):
        merging.require_complete(work, spark.createDataFrame([("a",)], "k STRING"), "k")


def test_retry_rules(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k STRING")
    ledger = spark.createDataFrame([("a", "ok"), ("b", "failed"), ("b", "failed")], "k STRING, status STRING")
    assert {r["k"] for r in merging.remaining(work, ledger, "k").collect()} == {"c"}
    assert {r["k"] for r in merging.remaining(work, ledger, "k", retry_failed=True).collect()} == {"b", "c"}


def test_holdout_never_reaches_training(spark):
    pool = spark.createDataFrame([("/d/a.mp3",), ("/d/b.mp3",)], "audio_path STRING")
    held = spark.createDataFrame([(" \\d\\a.mp3 ",), (None,)], "audio_path STRING")
    assert [r[0] for r in merging.exclude_holdout(pool, held).collect()] == ["/d/b.mp3"]


def test_positional_join_checks_lengths(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i INT, l STRING")
    b = spark.createDataFrame([(7, "p"), (9, "q")], "j INT, r STRING")
    assert {(r["l"], r["r"]) for r in merging.positional_join(a, b, ["i"], ["j"]).collect()} == {("x", "p"), ("y", "q")}
    with pytest.raises(ValueError, match="row count mismatch"):
        merging.positional_join(a, b.limit(1), ["i"], ["j"])


def test_gold_merge(spark):
    cells = {c: "" for c in LABEL_COLUMNS} | {"inst_piano": "1", "mood_epic": "bad"}
    gold = spark.createDataFrame([("", "data\\a.mp3", *cells.values()), ("B", "data/b.mp3", *cells.values())],
                                 "song_name STRING, source_path STRING, " + ", ".join(f"{c} STRING" for c in LABEL_COLUMNS))
    tempo = spark.createDataFrame(
        [("data/a.mp3", "failed", None, None, None, 0), ("data/a.mp3", "ok", [100.0, 110.0], "mid-tempo", "fast", 1), ("data/b.mp3", "ok", [], "slow", "slow", 0), ("data/b.mp3", "no", [1.0], "slow", "slow", 1)],
        "source_path STRING, status STRING, clip_bpms ARRAY<DOUBLE>, gt_tempo_song STRING, pred_tempo_song STRING, _ord INT")
    empty = F.array().cast("array<string>")
    tempo = tempo.withColumns({"clip_gt_tempo": empty, "clip_pred_tempo": empty, "eval_audio_paths": empty, "mean_scores_song": F.lit(None).cast("map<string,double>")})
    meta = spark.createDataFrame([("x/a.mp3", "t", "m", 0.5, 0)], "audio STRING, text STRING, mood STRING, confidence DOUBLE, _ord INT")
    merged = merging.merge_gold(gold, tempo, meta)
    rows = {r["song_name"]: r for r in merged.collect()}
    a, b = rows["a.mp3"], rows["B"]
    assert a["human_multihot"]["inst_piano"] == 1 and a["human_multihot"]["mood_epic"] == 0
    assert a["program_tempo"]["bpm_mean"] == 105.0 and a["program_tempo"]["tempo_clap_zeroshot"] == "fast"
    assert a["program_metadata"]["audio"] == "x/a.mp3" and b["program_metadata"] is None and b["program_tempo"] is None
    assert tuple(merging.merge_summary(merged).first()) == (2, 1, 1)
    review = {r["song_name"]: r for r in review_rows(merged).collect()}
    assert review["a.mp3"]["inst_piano"] == "1" and review["a.mp3"]["tempo_bin_bpm"] == "mid-tempo" and review["B"]["tempo_bin_bpm"] == ""


def test_layers(spark):
    def layer(*rows):
        return spark.createDataFrame(list(rows), "audio STRING, text STRING, _ord INT")

    out = merging.layered_merge([layer(("a", "seed", 0), ("b", "seed", 0), (" ", "x", 0)), layer((" a ", "auto1", 0), ("a", "auto2", 1)), layer(("c", "human", 0))], "audio")
    assert {(r["audio"], r["text"]) for r in out.collect()} == {("a", "auto2"), ("b", "seed"), ("c", "human")}


def test_mixed_manifest_weights(spark):
    train = spark.createDataFrame([("a", "ta"), ("b", "tb")], "audio_path STRING, text STRING")
    hard = spark.createDataFrame([("a",), ("b",)], "audio_path STRING")
    refined = spark.createDataFrame([("a", "new", "ta", "llm_refined", 0.1, 0.9, 0)], "audio_path STRING, text STRING, text_orig STRING, text_source STRING, sim DOUBLE, error_score DOUBLE, _ord INT")
    rows = sorted((r["audio_path"], r["source"], r["text"], r["weight"]) for r in merging.add_hard_duplicates(train, hard, refined, 1).collect())
    assert rows == [("a", "hard", "new", 2.0), ("a", "orig", "ta", 1.0), ("b", "orig", "tb", 1.0)]
    assert merging.add_hard_duplicates(train, hard, refined, 1, duplicate=False).count() == 2


def test_file_resolution_prefers_the_first_candidate(spark):
    manifest = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key STRING")
    inventory = spark.createDataFrame([("/m/k1.ogg", 0), ("/m/k1.wav", 5), ("/m/k1.mp3", 5), ("/m/k2.ogg", 1)], "path STRING, length INT")
    candidates = F.array(*[F.concat(F.lit("/m/"), "key", F.lit(e)) for e in (".ogg", ".wav", ".mp3")])
    out = merging.resolve_files(manifest, candidates, inventory, "key")
    assert {(r["key"], r["audio_path"]) for r in out.collect()} == {("k1", "/m/k1.wav"), ("k2", "/m/k2.ogg"), ("k3", None)}
    assert tuple(merging.readiness(out).first()) == (3, 2, "partial")


def test_wide_flags(spark):
    rows = spark.createDataFrame([("1", "0"), ("0", "1.0"), ("", "2")], "vocals STRING, voice STRING")
    assert [r[0] for r in rows.select(any_flag(["vocals", "voice"])).collect()] == [True, True, False]


def test_confidence_routes(spark):
    rows = spark.createDataFrame([(v,) for v in (0.1, 0.4, 0.41, 0.05, None, float("nan"))], "confidence DOUBLE")
    assert [r[0] for r in rows.select(confidence_band("confidence")).collect()] == ["review", "review", "high", "low", "other", "other"]
    assert tuple(route_counts(rows).first()) == (6, 2, 1, 1, 2)


def test_refetch_and_work_list(spark):
    disk = spark.createDataFrame([("a",), ("b",), ("c",)], "audio STRING")
    known = spark.createDataFrame([("b", 0.2), ("c", 0.9), ("d", None)], "audio STRING, confidence DOUBLE")
    assert {r[0] for r in needs_refetch(disk, known, 0.35).collect()} == {"a", "b"}
    assert {r[0] for r in merging.work_list(disk, known).collect()} == {"a"}
    assert {r[0] for r in merging.work_list(disk, known, threshold=0.35).collect()} == {"a", "b", "d"}
    assert {r[0] for r in merging.work_list(disk, known, rebuild=True).collect()} == {"a", "b", "c", "d"}


def test_sheet_upgrade(spark):
    sheet = spark.createDataFrame([("s", "1.0", "x"), (" ", "1", "y")], "song_name STRING, inst_piano STRING, gone STRING")
    rows = upgrade_sheet(sheet).collect()
    assert len(rows) == 1 and rows[0]["inst_piano"] == "1" and rows[0]["mood_epic"] == "0" and "gone" not in rows[0]


def test_match_segments_counts_unmatched(spark):
    seg = spark.createDataFrame([("c1", "data/music_db/a.mp3", 0, 0.0, 15.0, 15.0), ("c2", "b.mp3", 0, 0.0, 15.0, 15.0), (None, "a.mp3", 0, 0.0, 1.0, 1.0)],
                                "segment_path STRING, source_path STRING, segment_index INT, start_sec DOUBLE, end_sec DOUBLE, duration_sec DOUBLE")
    meta = spark.createDataFrame([("a.mp3", "first", None, 0.1, 0), ("./a.mp3", "last", "calm", 0.9, 1)], "audio STRING, text STRING, mood STRING, confidence DOUBLE, _ord INT")
    rows = {r["audio_path"]: (r["text"], r["matched"]) for r in merging.match_segments(seg, meta).collect()}
    assert rows == {"c1": ("last", True), "c2": ("", False)}


def test_tag_union_and_key_sets(spark):
    a = spark.createDataFrame([("t1", "p", ["b", "a"], 0)], "track_id STRING, path STRING, tags ARRAY<STRING>, _ord INT")
    b = spark.createDataFrame([("t1", "q", ["a", "c"], 1), ("t2", "r", [], 1)], "track_id STRING, path STRING, tags ARRAY<STRING>, _ord INT")
    assert sorted(tuple(r) for r in merging.union_tags(a, b).collect()) == [("t1", "p", ["a", "b", "c"]), ("t2", "r", [])]
    keys = spark.createDataFrame([("t2",), ("t9",)], "k STRING")
    assert [r["track_id"] for r in merging.restrict_keys(b, "track_id", keys, keys).collect()] == ["t2"]
    assert [r[0] for r in merging.keys_without_rows(keys.withColumnRenamed("k", "track_id"), b, "track_id").collect()] == ["t9"]


def test_repeated_records_give_each_key_once(spark):
    from earmark.operators.merging import work_list

    disk = spark.createDataFrame([("a",), ("b",)], "audio STRING")
    known = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.1), ("b", 0.9)], "audio STRING, confidence DOUBLE")
    assert [r[0] for r in work_list(disk, known, threshold=0.35).collect()] == ["a"]
    assert [r[0] for r in needs_refetch(disk, known, 0.35).collect()] == ["a"]


def test_last_known_tempo_outlives_a_row_without_it(spark):
    from earmark.plans.gold_evaluation import gold_by_basename

    rows = [("d/a.mp3", {"inst_piano": 0}, ("slow", "fast"), 1), ("x/a.mp3", {"inst_piano": 1}, ("fast", "odd"), 2),
            ("a.mp3", {"inst_piano": 1}, None, 3), ("b.mp3", {}, ("odd", "slow"), 1), ("c.mp3", None, ("slow", "slow"), 1)]
    gold = spark.createDataFrame(rows, "source_path STRING, human_multihot MAP<STRING, INT>, program_tempo STRUCT<tempo_bin_bpm: STRING, tempo_clap_zeroshot: STRING>, _ord INT")
    found = sorted(tuple(r) for r in gold_by_basename(gold, ["inst_piano"]).collect())
    assert found == [("a.mp3", 1, "fast", "slow", "fast"), ("b.mp3", 0, None, None, None)]
