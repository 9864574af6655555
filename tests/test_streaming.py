from pyspark.sql import functions as F

from faultline.streaming import flows


def test_typestate_over_two_arrivals(spark, tmp_path):
    first = [(1, 0, 1, "alloc"), (1, 0, 2, "free"), (2, 1, 1, "use")]
    later = [(1, 0, 3, "use"), (1, 0, 4, "free"), (1, 0, 5, "alloc"), (1, 0, 6, "use")]
    schema = "proc long, var int, seq int, op string"
    want = set()
    for rows, new in ((first, set()), (later, {(1, 0, 3, "CWE-416"), (1, 0, 4, "CWE-415")})):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        want |= new
        assert {tuple(r) for r in flows.drained(flows.typestate(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()} == want


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("00:10", "a"), ("00:50", "a"), ("01:10", "a")], "at string, event_type string").select(F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")).alias("ts"), "event_type")
    rows.write.parquet(str(tmp_path / "in"))
    q = flows.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]


def test_equal_findings_once_within_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "f", 3, "CWE-1"), (2, "f", 3, "CWE-1"), (3, "g", 3, "CWE-1")], "s long, location string, line int, cwe string").select(F.timestamp_seconds("s").alias("ts"), "location", "line", "cwe")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = flows.drained(flows.distinct_findings(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.location for r in got.collect()) == ["f", "g"]


def test_scan_of_arriving_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\ndef f():\n    x = input()\n    os.system(x)\n")
    (tmp_path / "src" / "b.py").write_text("def broken(:\n")
    (tmp_path / "src" / "c.js").write_text("eval(location.hash);\n")
    flows.scan_arrivals(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.line, r.type, r.source_line) for r in got) == [(1, "code_injection", 1), (4, "command_injection", 3)]
