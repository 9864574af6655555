"""SARIF in ranges, round trips, pushed filters and lost tasks."""

import io
import json
import random

import pytest

from faultline.sources import sarif


def document(n, seed=0, indent=None):
    r = random.Random(seed)
    text = lambda: r.choice(['plain', 'a "quoted" one', 'back\\slash "ruleId": {[', 'ünï\n}]', '"ruleId"', "\\", '\\"'])
    result = lambda i: {"ruleId": f"r{i % 7}", "level": r.choice(["error", "note"]), "message": {"text": text()}, "properties": {text(): [{"a": text()}, {}], "ruleId": 5}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"f{i}"}, "region": {"startLine": i}}}]}
    order = lambda d: dict(r.sample(list(d.items()), len(d)))
    runs = [{"tool": {"driver": {"name": text(), "rules": [{"id": "r1"}]}}, "results": [order(result(i)) for i in range(k, n, 3)]} for k in range(3)]
    return json.dumps({"version": "2.1.0", "runs": runs}, indent=indent, ensure_ascii=False)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [50, 333, 10_000])
def test_each_result_belongs_to_one_range(indent, size):
    data = document(60, indent=indent).encode()
    got = [r for at in range(0, len(data), size) for r in sarif.results(io.BytesIO(data), len(data), at, min(at + size, len(data)))]
    assert sorted(int(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"][1:]) for r in got) == list(range(60))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    sarif.register(spark)
    (tmp_path / "a.sarif").write_text(document(2000, 1))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.sarif").write_text(document(31, 2, 4))
    (tmp_path / "_writing-x").mkdir()
    (tmp_path / "_writing-x" / "lost.sarif").write_text(document(9))
    df = spark.read.format("sarif").option("rangeBytes", 20_000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    assert df.count() == 2031 and df.filter("location = 'f17'").count() == 2
    assert {r.line for r in df.collect()} == set(range(2000))
    assert spark.read.format("sarif").load(str(tmp_path / "sub" / "b.sarif")).count() == 31


def test_filters_reach_the_reader(spark, tmp_path):
    sarif.register(spark)
    (tmp_path / "a.sarif").write_text(document(100))
    df = spark.read.format("sarif").load(str(tmp_path))
    found = df.filter("level = 'error' AND rule_id IN ('r1', 'r2') AND line > 10")
    everything = [r for r in df.collect() if r.level == "error" and r.rule_id in ("r1", "r2") and r.line > 10]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, everything)) and everything
    reader = sarif.SarifReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("level",), "error"), GreaterThan(("line",), 3)]))
    assert [type(f) for f in left] == [GreaterThan] and reader.allowed == [(1, ["error"])]


def test_round_trip_append_overwrite_and_abort(spark, tmp_path):
    sarif.register(spark)
    out = str(tmp_path / "out")
    rows = [(f"r{i}", "note", 'm "x" \\ ü' if i % 2 else "", f"p/{i}", i if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "rule_id string, level string, message string, location string, line int").repartition(4)
    df.write.format("sarif").mode("append").save(out)
    read = lambda: sorted((tuple(r)[:5] for r in spark.read.format("sarif").load(out).collect()), key=str)
    assert read() == sorted(rows, key=str)
    df.limit(10).write.format("sarif").mode("append").save(out)
    assert len(read()) == 510
    df.limit(7).write.format("sarif").mode("overwrite").save(out)
    assert len(read()) == 7
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of a failed task
        spark.range(9).selectExpr("CAST(raise_error('no') AS STRING) AS rule_id", "'note' AS level", "'' AS message", "'p' AS location", "1 AS line").write.format("sarif").mode("append").save(out)
    assert len(read()) == 7
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    for p in (tmp_path / "out").iterdir():
        assert json.loads(p.read_text())["version"] == "2.1.0"
