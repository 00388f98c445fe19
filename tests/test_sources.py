"""Record sources: array vs lines detection, bad-line numbers, lenient buffers, class folders."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stepwise.operators.answers import keep_last
from stepwise.sources import records as RS
from stepwise.sources.arrays import array_records


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_array_and_lines(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    arr = _write(d, "a.json", '  [\n {"id": 1, "q": "x"},\n {"id": 2, "q": "y"}\n]\n')
    lines = _write(d, "b.jsonl", '{"id": 1, "q": "x"}\n\n{"id": 2, "q": "y"}\n')
    assert sorted(r["id"] for r in RS.read_json_records(spark, arr).collect()) == [1, 2]
    assert sorted(r["id"] for r in RS.read_json_records(spark, lines).collect()) == [1, 2]


def test_bad_line_number(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    p = _write(d, "c.jsonl", '{"id": 1}\n\n{"id": 2}\n{"id": 3} junk\n{"id": 4}\n')
    with pytest.raises(ValueError, match="line 4"):
        RS.read_json_records(spark, p, validate=True)


def test_lenient_and_strict_buffers(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    assert RS.read_buffer(spark, os.path.join(d, "missing.json")).count() == 0
    assert RS.read_buffer(spark, _write(d, "empty.json", "  \n")).count() == 0
    assert RS.read_buffer(spark, _write(d, "bad.json", "[1, 2]")).count() == 0          # not objects
    one = RS.read_buffer(spark, _write(d, "one.json", '{"id": 3, "answer": null}'))
    assert one.count() == 1
    arr = RS.read_buffer(spark, _write(d, "arr.json", '[{"id": 1}, {"id": 2, "answer": "5"}]'))
    assert arr.count() == 2
    with pytest.raises(FileNotFoundError):
        RS.read_buffer(spark, os.path.join(d, "missing.json"), strict=True)


def test_class_folder(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    _write(d, "calc_results.json", '[{"original_id": 1, "reward": 0.5}]')
    _write(d, "logic_results.jsonl", '{"original_id": 2, "reward": 1.0, "extra": "k"}\n')
    df = RS.read_record_dir(spark, d, class_pattern=r"([a-z]+)_results\.jsonl?$")
    got = sorted((r["original_id"], r["source_class"]) for r in df.collect())
    assert got == [(1, "calc"), (2, "logic")]


def test_bad_line_number_across_splits(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    lines = [f'{{"id": {i}, "pad": "{"x" * 20}"}}' for i in range(1, 120001)]
    lines[97654] = "{broken"                       # line 97655
    p = _write(d, "big.jsonl", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
        assert spark.read.text(p).rdd.getNumPartitions() > 4
        assert RS.first_bad_line(spark, p)[1] == 97655
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_answer_records(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    lines = _write(d, "a.jsonl", '{"id": 1, "answer": "3"}\n[1, 2]\n{"id": 2, "answer": 4.5}\n')
    got = sorted((r["id_text"], r["answer"]) for r in RS.read_answer_records(spark, lines).collect())
    assert got == [("1", "3"), ("2", "4.5")]                      # the non-object line is dropped
    pretty = _write(d, "b.json", '{\n  "id": 7,\n  "answer": "x"\n}\n')
    assert [(r["id_text"], r["answer"]) for r in RS.read_answer_records(spark, pretty).collect()] == [("7", "x")]
    broken = _write(d, "c.jsonl", '{"id": 1}\n{"id": \n')
    with pytest.raises(ValueError, match="line 2"):
        RS.read_answer_records(spark, broken)


def _odd(rng, i):
    """Records whose texts hold brackets, quotes and escapes."""
    return {"id": i, "q": rng.choice(["a}b", '{"x"', 'say "hi\\"', "[,]", "é😀", "back\\", "new\nline", ""]),
            "n": {"k": [{"z": i}, [1, {"y": "}"}]]}, "s": [rng.choice(["}", "{", "]"])] * rng.randint(0, 3)}


@pytest.mark.parametrize("layout", [dict(indent=2), dict(separators=(",", ":")), dict(indent=1, ensure_ascii=False)])
def test_array_file_in_many_tasks(spark, layout):
    rng = random.Random(1)
    rows = [_odd(rng, i) for i in range(3000)]
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    path = _write(d, "big.json", " \n" + json.dumps(rows, **layout) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024))
        records = array_records(spark, [path]).orderBy("position").collect()
        assert len({r.position.block for r in records}) > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [json.loads(r.raw) for r in records] == rows


def test_array_elements_that_are_no_objects(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    path = _write(d, "m.json", '[1, "a}b", {"a":1}, [2,{"b":3}], {"c":[{"d":1}]}, null, "x"]')
    got = [json.loads(r.raw) for r in array_records(spark, [path]).orderBy("position").collect()]
    assert got == [1, "a}b", {"a": 1}, [2, {"b": 3}], {"c": [{"d": 1}]}, None, "x"]
    for text in ("[]", " [ \n] "):
        assert array_records(spark, [_write(d, "e.json", text)]).collect() == []


MALFORMED = ['[{"a":1}', '[{"a":1} {"b":2}]', '[{"a":1}] junk', '[{"a":1},', '[{"a":"x}', '[{"a":1},]', '[,{"a":1}]', '[{"a":1}]]',
             '[1 2]', '[{"a":1}, [5']


def test_malformed_arrays_are_seen(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    paths = [_write(d, f"bad{i}.json", text) for i, text in enumerate(MALFORMED)]
    raw = RS.raw_json_records(spark, d)
    bad = raw.where(~RS.strict_json(F.col("raw"))).select("position.file").distinct().collect()
    assert {os.path.basename(r.file) for r in bad} == {os.path.basename(p) for p in paths}
    assert RS.read_buffer(spark, paths[0]).count() == 0
    with pytest.raises(ValueError):
        RS.read_buffer(spark, paths[5], strict=True)
    with pytest.raises(Exception, match="MALFORMED|parse"):
        RS.read_json_records(spark, paths[2], schema=StructType([StructField("a", LongType())])).collect()


def test_folder_of_mixed_layouts(spark):
    rng = random.Random(2)
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    rows = {name: [_odd(rng, 100 * k + i) for i in range(50)] for k, name in enumerate(["a.json", "b c.json", "c.jsonl", "d.json"])}
    _write(d, "a.json", json.dumps(rows["a.json"], indent=4))
    _write(d, "b c.json", json.dumps(rows["b c.json"]))
    _write(d, "c.jsonl", "\n\n".join(map(json.dumps, rows["c.jsonl"])))
    _write(d, "d.json", "\n".join(map(json.dumps, rows["d.json"])))          # lines by content, whatever the suffix
    _write(d, "notes.txt", "{not read")
    df = RS.read_record_dir(spark, d, class_pattern=r"/([^/]+)\.jsonl?$")
    got = df.orderBy("position").collect()
    assert [r.id for r in got] == [r["id"] for name in sorted(rows) for r in rows[name]]
    assert [r.q for r in got] == [r["q"] for name in sorted(rows) for r in rows[name]]
    schema = StructType([StructField("id", LongType())])
    assert RS.read_record_dir(spark, d, schema=schema).agg(F.sum("id")).first()[0] == sum(r["id"] for v in rows.values() for r in v)
    _write(d, "e.jsonl", '{"id": 1}\n{"id": \n')
    with pytest.raises(ValueError, match="line 2"):
        RS.read_record_dir(spark, d)


def test_last_in_file_wins_after_a_shuffle(spark):
    d = tempfile.mkdtemp(prefix="stepwise-src-")
    rows = [{"id": i % 7, "answer": str(i)} for i in range(500)]
    for name, text in (("a.json", json.dumps(rows, indent=1)), ("a.jsonl", "\n".join(map(json.dumps, rows)))):
        path = _write(d, name, text)
        ans = RS.read_answer_records(spark, path).repartition(13, "answer")
        got = {r.id_text: r.answer for r in keep_last(ans, "id_text").collect()}
        assert got == {str(r["id"]): r["answer"] for r in rows}


def test_report_is_written_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    summary = spark.createDataFrame([(2,)], "n int")
    records = spark.createDataFrame([(i, f"r{i}") for i in (5, 1, 3)], "id int, text string")
    with pytest.raises(FileNotFoundError):
        RS.read_report(spark, path)
    folders = RS.write_report(summary, records, path, wrong=records.where("id = 3"))
    assert len(folders) == 3
    files = sorted(f for f in os.listdir(folders[1]) if f.startswith("part-"))
    ids = [json.loads(line)["id"] for f in files for line in open(f"{folders[1]}/{f}", encoding="utf-8")]
    assert ids == [1, 3, 5]                                                   # sorted by id at the sink
    broken = records.withColumn("text", F.raise_error(F.lit("broken off")).cast("string"))
    with pytest.raises(Exception, match="broken off"):
        RS.write_report(summary, records.limit(1), path, wrong=broken)
    assert RS.read_report(spark, path).count() == 3 and RS.read_report(spark, path, "wrong").first().text == "r3"
    RS.write_report(summary, records.limit(2), path)
    assert RS.read_report(spark, path, schema="id int, text string").count() == 2


def test_parquet_folder_files_follow_the_data(spark, sf):
    import __spark_entry__ as E
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name in ("pref_scan_prune", "sft_scan_head"):
            assert len(E.queries()[name](spark, sf).inputFiles()) > 3, name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
