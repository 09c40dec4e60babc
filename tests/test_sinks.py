"""Sinks read back."""

import json

from caselode.sources.sinks import json_document, markdown_lines, write_buckets, write_results


def test_buckets(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 n")
    write_buckets(df, f"{tmp_path}/b", ["n"], rows=10)
    assert spark.read.parquet(f"{tmp_path}/b").filter("n = 1").count() == 33
    assert len(list((tmp_path / "b" / "n=1").glob("*.parquet"))) >= 4


def test_results(spark, tmp_path):
    ddl = "id string, k int, success boolean, text string"
    old = [("a", 1, True, "old"), ("a", 1, False, "repeat"), ("b", 1, False, "old"), (None, 2, True, "old")]
    new = [("a", 1, True, "new"), ("b", 1, True, "new"), (None, 2, True, "new")]
    write_results(spark.createDataFrame(old, ddl), f"{tmp_path}/none", f"{tmp_path}/1", ["id", "k"])
    write_results(spark.createDataFrame(new, ddl), f"{tmp_path}/1", f"{tmp_path}/2", ["id", "k"])
    got = {tuple(r) for r in spark.read.schema(ddl).json(f"{tmp_path}/2").collect()}
    assert got == {old[0], old[1], old[3], new[1]}


def test_reports(spark):
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "variant string, n int, rate double")
    assert json.loads(json_document(df, "variant").first().document) == [{"variant": "a", "n": 1, "rate": None}, {"variant": "b", "n": 2, "rate": 0.5}]
    lines = [r.line for r in markdown_lines(df, "variant").orderBy("place").collect()]
    assert lines == ["| variant | n | rate |", "| --- | --- | --- |", "| a | 1 | - |", "| b | 2 | 50.00% |"]
