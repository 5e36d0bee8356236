"""File order, line numbers and elements of large JSON files, at several block sizes."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from earmark.operators.merging import join_numbered
from earmark.operators.ordering import keep_one
from earmark.plans import source_queries
from earmark.sources import json_scan, jsonl

BLOCK = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(params=["128m", "20k", "3k"])
def blocks(spark, request):
    """Size of the part of a file that one task reads."""
    conf = {BLOCK: request.param, "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_file_order_at_any_block_size(spark, tmp_path, blocks):
    draw = random.Random(1)
    rows = [{"key": f"k{draw.randrange(40)}", "at": i, "pad": "x" * draw.randrange(60)} for i in range(1500)]
    for part, name in enumerate(("a.jsonl", "b.jsonl", "c.jsonl")):
        lines = [json.dumps(r) if r["at"] % 11 else "broken {" for r in rows[part * 500 : part * 500 + 500]]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if part else ""))
    scanned = jsonl.read_jsonl(spark, str(tmp_path), "key STRING, at INT", order="_ord", line="line")
    if blocks != "128m":
        assert scanned.inputFiles() and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    assert {(r.at, r.line) for r in scanned.collect()} == {(i, i) for i in range(1500) if i % 11}
    kept = [r for r in rows if r["at"] % 11]
    plain = jsonl.read_jsonl(spark, str(tmp_path), "key STRING, at INT", order="place")
    assert plain.columns == ["place", "key", "at"]
    for keep, pick in (("first", min), ("last", max)):
        got = {r.key: r.at for r in keep_one(plain, ["key"], ["place"], keep).collect()}
        assert got == {k: pick(r["at"] for r in kept if r["key"] == k) for k in {r["key"] for r in kept}}


def test_line_numbers_pair_files(spark, tmp_path, blocks):
    for name, field in (("left", "a"), ("right", "b")):
        (tmp_path / name).mkdir()
        for part in range(3):
            (tmp_path / name / f"{part}.jsonl").write_text("".join(json.dumps({field: part * 100 + i, "pad": field * (37 * i % 90)}) + "\n" for i in range(100)))
    a, b = (jsonl.read_jsonl(spark, str(tmp_path / n), f"{f} INT", line="n") for n, f in (("left", "a"), ("right", "b")))
    assert sorted((r.n, r.a, r.b) for r in join_numbered(a, b, "n").collect()) == [(i, i, i) for i in range(300)]
    with pytest.raises(ValueError):
        join_numbered(a, b.filter("b > 3"), "n")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.jsonl").write_text("")
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "a INT", line="n").count() == 0


def value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(draw.choice('abé,"[]{}\\: \n\t𝒳') for _ in range(draw.randrange(20)))
    if kind in (1, 2):
        return draw.choice((None, True, 7, -2.5, "x", ""))
    if kind == 3:
        return draw.randrange(10**6)
    if kind == 4:
        return [value(draw, depth + 1) for _ in range(draw.randrange(5))]
    return {f"k{i}" + draw.choice(("", ",", '"', "}")): value(draw, depth + 1) for i in range(draw.randrange(5))}


@pytest.mark.parametrize("chunk", [1, 40, 100_000])
def test_elements_of_any_array(spark, tmp_path, blocks, chunk):
    draw = random.Random(chunk)
    want = {}
    for n, indent in enumerate((None, 2, None, 1)):
        elements = [value(draw) for _ in range((120, 90, 1, 0)[n])]
        path = tmp_path / f"f{n}.json"
        path.write_text(("﻿ " if n == 0 else "") + json.dumps(elements, indent=indent, ensure_ascii=n % 2 == 0) + "\n", encoding="utf-8")
        want |= {(path.name, i): e for i, e in enumerate(elements)}
    (tmp_path / "scalar.json").write_text('"a,b", 3')
    (tmp_path / "empty.json").write_text("")
    got = json_scan.scan_elements(spark, str(tmp_path), chunk).select(F.element_at(F.split("file", "/"), -1).alias("f"), "root", "place", "text").collect()
    assert len(got) == len(want) and {r.root for r in got} == {"["}
    assert all(json.loads(r.text) == want[r.f, r.place] for r in got)


def test_maps_keep_the_last_of_a_key(spark, tmp_path, blocks):
    draw = random.Random(3)
    entries = [(f'k"{draw.randrange(50)},{{', {"v": i, "s": "}," * draw.randrange(9)}) for i in range(300)]
    text = "{" + ", ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in entries) + "}"
    (tmp_path / "m.json").write_text(text)
    got = {r.key: r.payload.v for r in jsonl.read_json_map(spark, str(tmp_path / "m.json"), "struct<v: int, s: string>", chunk=200).collect()}
    assert got == {k: v["v"] for k, v in json.loads(text).items()}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Blocks of 64 KB stand for those of 128 MB: one file, many tasks, and no task holds the file."""
    rows = [{"id": i, "text": f"line {i}, [x] " * 20} for i in range(6000)]
    (tmp_path / "big.json").write_text(json.dumps(rows, indent=1))
    before = spark.conf.get(BLOCK)
    spark.conf.set(BLOCK, "64k")
    try:
        pieces = spark.read.option("lineSep", ",").text(str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 20
        got = jsonl.read_json_array(spark, str(tmp_path), "id INT, text STRING", order="place", chunk=20_000)
        assert got.count() == 6000 and got.filter((F.col("place.place") != F.col("id")) | (F.length("text") < 200)).count() == 0
        chunks = [p for p in got.inputFiles() if "json_segments" in p]
        assert len(chunks) > 4
    finally:
        spark.conf.set(BLOCK, before)


def test_a_group_is_one_file_however_partitions_are_coalesced(spark, tmp_path):
    """Rows that are dealt by the group already, in partitions far larger than what else a group needs."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(3000).select((F.col("id") % 3).alias("part"), "id")
        place = F.row_number().over(Window.partitionBy("part").orderBy(F.md5(F.col("id").cast("string").cast("binary"))))
        element = F.to_json(F.struct("id", F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 9).alias("text")))
        source_queries._json_file(rows.select("part", place.alias("o"), element.alias("element")), "part", "o", "element", "[]", "null", str(tmp_path / "f"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for part in range(3):
        [file] = (tmp_path / "f" / f"part={part}").glob("*.txt")
        assert {r["id"] for r in json.loads(file.read_text())[:-1]} == set(range(part, 3000, 3))


def test_summaries_of_both_states():
    quotes, rise, commas = json_scan.summary('a, "b\\",[", {"c": [1, 2]}, 3')
    assert quotes == 4 and rise[0] == 0 and dict(commas[0]) == {0: 3, 2: 1}
    assert json_scan.segments('x", 1, {"a": 2}, [3', True, 1) == (['x"', " 1", ' {"a": 2}', " [3"], False)
    assert json_scan.segments(" 4]], 5] tail, 6", False, 2) == ([" 4]"], True)
