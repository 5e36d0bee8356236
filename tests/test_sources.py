import json

import pytest
from pyspark.sql import functions as F

from earmark.constants import LABEL_COLUMNS
from earmark.sources import jsonl, stores, tabular


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_is_tolerant(spark, tmp_path):
    lines = ['{"audio_path": "a.mp3", "text": "  ", "confidence": "high"}', "", "   ", "[1]", '"x"', "{broken", '{"audio_path": " "}',
             '{"audio_path": "/abs/b.mp3", "text": "b", "confidence": 0.5, "other": 1}']
    path = write(tmp_path / "m.jsonl", "\n".join(lines))
    rows = jsonl.read_jsonl(spark, path, "audio_path STRING, text STRING, confidence DOUBLE")
    usable = {r["audio_path"]: r for r in jsonl.usable_manifest(rows, root="/p").collect()}
    assert set(usable) == {"/p/a.mp3", "/abs/b.mp3"}
    assert usable["/p/a.mp3"]["text"] == "None" and usable["/p/a.mp3"]["confidence"] is None
    inventory = spark.createDataFrame([("/abs/b.mp3",)], "path STRING")
    assert [r["audio_path"] for r in jsonl.usable_manifest(rows, root="/p", inventory=inventory).collect()] == ["/abs/b.mp3"]
    assert jsonl.usable_manifest(rows, root="/p", max_rows=1).count() == 1
    with pytest.raises(Exception, match="malformed JSON line"):
        jsonl.read_jsonl(spark, path, "audio_path STRING", strict=True).collect()
    with pytest.raises(ValueError, match="no usable rows"):
        jsonl.require_rows(rows.filter("false"), "m.jsonl")


def test_strict_reader_accepts_good_files(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", '{"a": 1}\n\n[2]\n')
    assert [r["a"] for r in jsonl.read_jsonl(spark, path, "a INT", strict=True).collect()] == [1]


def test_json_array_and_map_files(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([{"audio": "x", "confidence": 0.5}, 3, "s", None, {"audio": "y"}], indent=1))
    rows = jsonl.read_json_array(spark, path, "audio STRING, confidence DOUBLE")
    assert sorted((r["audio"], r["confidence"]) for r in rows.collect()) == [("x", 0.5), ("y", None)]
    path = write(tmp_path / "m.json", json.dumps({"0": "p/a.mp3", "1": "p/b.mp3"}, indent=2))
    assert sorted(tuple(r) for r in jsonl.read_json_map(spark, path, "string").collect()) == [("0", "p/a.mp3"), ("1", "p/b.mp3")]


def test_query_set(spark, tmp_path):
    rows = [{"query_id": " q1 ", "query_type": "mood", "label": "l", "query_text": "t"}, {"query_id": "q2", "query_type": "mood", "label": "", "query_text": "t"},
            {"query_id": "q3"}]
    assert [tuple(r) for r in jsonl.read_queries(spark, write(tmp_path / "q.json", json.dumps(rows))).collect()] == [("q1", "mood", "l", "t")]
    assert {r["query_id"] for r in jsonl.read_queries(spark).collect()} == set(LABEL_COLUMNS)


def test_csv_with_mark(spark, tmp_path):
    path = write(tmp_path / "g.csv", '﻿song_name,inst_piano\n"a, ""b""",1\n')
    rows = tabular.read_csv(spark, path, required=("song_name",))
    assert tuple(rows.first()) == ('a, "b"', "1")
    with pytest.raises(ValueError, match="missing columns"):
        tabular.read_csv(spark, path, required=("clip_id",))


def test_csv_round_trip_of_hard_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y', 1 / 3), (2, None, None)], "id INT, t STRING, v DOUBLE")
    tabular.write_csv(df, str(tmp_path / "o"), ["id", "t", "v"], bom=True)
    rows = {r["id"]: (r["t"], r["v"]) for r in tabular.read_csv(spark, str(tmp_path / "o")).collect()}
    assert rows == {"1": ('say "x", y', "0.333333"), "2": (None, None)}


def test_sheets_are_matched_by_name_and_keep_line_breaks(spark, tmp_path):
    write(tmp_path / "s a" / "1.csv", 'query_id,query_type,rank,relevance,notes\nq1,mood,1,2,"two\nlines"\n')
    write(tmp_path / "s a" / "2.csv", "\ufeffrank,relevance,query_type,query_id\r\n3,1,mood,q2\r\n")
    write(tmp_path / "s a" / "3.csv", "")
    rows = tabular.read_csv(spark, str(tmp_path / "s a")).select("query_id", "rank", "notes")
    assert sorted(tuple(r) for r in rows.collect()) == [("q1", "1", "two\nlines"), ("q2", "3", None)]
    assert sorted((r["query_id"], r["rank"]) for r in tabular.read_judgements(spark, str(tmp_path / "s a")).collect()) == [("q1", 1), ("q2", 3)]
    write(tmp_path / "s a" / "4.csv", "query_id,rank\nq3,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        tabular.read_judgements(spark, str(tmp_path / "s a"))


def test_matrices_by_header(spark, tmp_path):
    write(tmp_path / "a_public" / "x_seed1.csv", "top_k,query_text,other\n5,piano,z\n")
    write(tmp_path / "a_public" / "x_seed2.csv", 'query_text,ndcg,top_k\n"piano, soft",0.5,ten\n')
    rows = tabular.read_matrices(spark, str(tmp_path), "query_text STRING, top_k INT, ndcg DOUBLE").orderBy("seed").collect()
    assert [tuple(r) for r in rows] == [("a", "x", 1, "piano", 5, None), ("a", "x", 2, "piano, soft", None, 0.5)]


def test_ragged_tsv(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS\n"
                                     "track_1\ta\tb\t01\\1.mp3\t12.5\tinstrument---piano\t mood---calm \t\ntrack_2\ta\tb\t2.mp3\t3\n")
    rows = tabular.read_ragged_tsv(spark, path).collect()
    assert [tuple(r) for r in rows] == [("track_1", "01/1.mp3", 12.5, ["instrument---piano", "mood---calm"])]


def test_matrices_and_grid(spark, tmp_path):
    for ds in ("one", "two"):
        for arm in ("base", "tuned"):
            for seed in (42, 43):
                if (ds, arm, seed) != ("two", "tuned", 43):
                    write(tmp_path / f"{ds}_public" / f"{arm}_seed{seed}.csv", f"query_text,top_k,precision_at_k\npiano,10,0.{seed}\n")
    rows = tabular.read_matrices(spark, str(tmp_path), "query_text STRING, top_k INT, precision_at_k DOUBLE")
    assert rows.count() == 7
    row = rows.filter("dataset = 'one' AND arm = 'tuned' AND seed = 43").first()
    assert (row["query_text"], row["top_k"], row["precision_at_k"]) == ("piano", 10, 0.43)
    gaps = tabular.grid_gaps(rows, ["one", "two"], ["base", "tuned"], [42, 43]).collect()
    assert [tuple(g) for g in gaps] == [("two", "tuned", 43)]
    with pytest.raises(FileNotFoundError):
        tabular.require_grid(rows, ["one", "two"], ["base", "tuned"], [42, 43])
    tabular.require_grid(rows, ["one"], ["base", "tuned"], [42, 43])


def test_inventory_is_relative(spark, tmp_path):
    write(tmp_path / "db" / "a" / "x.mp3", "1")
    write(tmp_path / "db" / "y.MP3", "22")
    write(tmp_path / "db" / "empty.mp3", "")
    files = stores.file_inventory(spark, str(tmp_path / "db"), relative_to=str(tmp_path / "db"))
    assert {(r["path"], r["length"]) for r in files.collect()} == {("a/x.mp3", 1), ("y.MP3", 2)}


def test_feature_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"k{i}", [float(i)] * 8) for i in range(3)], "cache_key STRING, features ARRAY<DOUBLE>")
    stores.append_features(rows, path)
    cache = stores.read_features(spark, path)
    manifest = spark.createDataFrame([("k0",), ("k2",)], "cache_key STRING")
    found = {r["cache_key"]: r["features"] for r in stores.lookup_features(manifest, cache, require_all=True).collect()}
    assert found == {"k0": [0.0] * 8, "k2": [2.0] * 8}
    assert stores.missing_keys(manifest, cache).isEmpty()
    more = spark.createDataFrame([("k9",)], "cache_key STRING")
    assert tuple(stores.cache_coverage(manifest.union(more), cache).first()) == (2, 3)
    with pytest.raises(Exception, match="feature missing for k9"):
        stores.lookup_features(more, cache, require_all=True).collect()


def test_labelling_sheet(spark):
    songs = spark.createDataFrame([(" a\\b.mp3 ",), ("  ",)], "source_path STRING")
    row = tabular.labelling_sheet(songs, default="").collect()
    assert len(row) == 1 and row[0]["song_name"] == "b.mp3" and row[0]["mood_epic"] == ""


def test_long_labels(spark):
    rows = spark.createDataFrame([("k1", "Piano", "0.6"), ("k1", "voice", "0.4"), ("k2", "voice ", "0.5"), ("", "piano", "1"), ("k3", "piano", "x")],
                                 "Sample_Key STRING, Instrument STRING, Relevance STRING")
    from earmark.operators.merging import instrument_flags

    flags = instrument_flags(tabular.long_labels(rows, 0.5), {"piano": "piano", "voice": "voice"})
    assert sorted(tuple(r) for r in flags.collect()) == [("k1", 1, 0), ("k2", 0, 1)]


def test_ledger_split(spark):
    rows = spark.createDataFrame([("a", "ok", "slow", "fast"), ("b", "err", "slow", "slow"), ("c", "ok", "odd", "slow"), (" ", "ok", "slow", "slow")],
                                 "audio STRING, status STRING, gt STRING, pred STRING")
    keys, valid = jsonl.split_ledger(rows, "audio", "gt", "pred", ["slow", "fast"])
    assert {r["audio"] for r in keys.collect()} == {"a", "b", "c"} and valid.count() == 2


def test_keyed_sink(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in "dacb"], "audio STRING")
    jsonl.write_keyed(df, str(tmp_path / "k"), "audio")
    parts = sorted((tmp_path / "k").glob("part-*"))
    assert [json.loads(x)["audio"] for p in parts for x in p.read_text().splitlines()] == list("abcd")


def test_null_fields_are_written(spark, tmp_path):
    jsonl.write_jsonl(spark.range(1).select("id", F.lit(None).cast("string").alias("mood")), str(tmp_path / "n"))
    line = next(p for p in (tmp_path / "n").glob("part-*") if p.stat().st_size).read_text().strip()
    assert json.loads(line) == {"id": 0, "mood": None}


def test_logs(spark, tmp_path):
    write(tmp_path / "slurm-77.out", "a\nDone.\n")
    row = stores.read_logs(spark, str(tmp_path)).first()
    assert row["job_id"] == "77" and row["value"] == "a\nDone.\n"


def test_schemas_are_valid():
    from pyspark.sql.types import StructType

    from earmark import schemas

    for name in (n for n in dir(schemas) if n.isupper()):
        assert len(StructType.fromDDL(getattr(schemas, name)).fields) > 0


def test_only_whole_objects_are_rows(spark):
    lines = ['{"a":1,"b":"x"} xyz', '{"a":2}{"a":3}', "{'a':4}", '{"a":NaN,"b":"kept"}', '{"a":5,"b":"}],"}', '{"a":6}]', '{"a":7}}', '{"a":8},null', '{"a":9},"w":2', '{"a":1,"a":10}', '{"a":11']
    rows = spark.createDataFrame([(x,) for x in lines], "value STRING")
    assert [(r["a"], r["b"]) for r in jsonl.parse_lines(rows, "a INT, b STRING").collect()] == [(None, "kept"), (5, "}],"), (10, None)]


def test_splittable_tables_with_headers_in_another_order(spark, tmp_path):
    write(tmp_path / "t" / "a.tsv", "clip_id\tpiano\tmp3_path\n1\t1\ta.mp3\n")
    write(tmp_path / "t" / "b.tsv", "﻿mp3_path\tpiano\tclip_id\nb.mp3\t0\t2\n")
    rows = tabular.read_wide_tsv(spark, str(tmp_path / "t"), ("clip_id", "piano", "mp3_path")).collect()
    assert sorted((r["clip_id"], r["piano"], r["mp3_path"]) for r in rows) == [("1", "1", "a.mp3"), ("2", "0", "b.mp3")]
    write(tmp_path / "t" / "c.tsv", "clip_id\tmp3_path\n3\tc.mp3\n")
    with pytest.raises(ValueError):
        tabular.read_wide_tsv(spark, str(tmp_path / "t"), ("clip_id", "piano", "mp3_path"))


def test_headers_are_found_without_a_sort_of_the_lines(spark, tmp_path, monkeypatch):
    heads = ["a,b", "b,a", "﻿a,b"]
    for k, head in enumerate(heads):
        # Many blocks; data lines that look like a header stand in later ones.
        write(tmp_path / f"[{k}].csv", "\n".join([head, *[f"{i},{head}" if i % 7 else heads[1] for i in range(2_000)]]))
    write(tmp_path / "empty.csv", "")
    plans, collect = [], type(spark.range(1)).collect

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(spark.range(1)), "collect", planned)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        groups = tabular._files_by_header(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    names = [[f.rsplit("/", 1)[-1].replace("\\", "") for f in g] for g in groups]
    assert names == [["[0].csv", "[2].csv"], ["[1].csv"]]
    assert plans and not any("Sort" in p for p in plans)
