"""A generation stream that stops and starts again has each identity once; failures stay and are tried again."""

import pytest
from pyspark.sql import functions as F

from caselode.streaming.generation import generate_stream, parsed_records


def test_parsed_records(spark):
    rows = [(1, 'ok {"a": 1} end', None), (2, None, None), (3, "  ", None), (4, "nothing here", None), (5, '{"a": 2', None), (6, '{"a": 3}', "HTTP 500"), (7, '{"b": 1}', None), (8, "{}", None)]
    got = {r.id: r for r in parsed_records(spark.createDataFrame(rows, "id int, reply string, error string"), "a bigint").collect()}
    assert {i: r.error_message for i, r in got.items()} == {1: None, 2: "no_reply", 3: "no_reply", 4: "decode_error", 5: "decode_error", 6: "HTTP 500", 7: "decode_error", 8: None}
    assert got[1].parsed_answer.a == 1
    assert got[6].parsed_answer is None
    assert [r.success for i, r in sorted(got.items())] == [True, False, False, False, False, False, False, True]


def test_stopped_and_started_again(spark, tmp_path):
    asked, out, state = (f"{tmp_path}/{x}" for x in ("asked", "out", "state"))
    schema = "patient_id long, top_k int"
    stop = {"at": 1}

    def put(name, ids):
        spark.createDataFrame([(i, 5) for i in ids], schema).coalesce(1).write.json(f"{asked}/{name}")

    def call(batch):
        if stop["at"] == 0:
            raise RuntimeError("the model is gone")
        stop["at"] -= 1
        return batch.withColumn("reply", F.concat(F.lit('{"a": '), "patient_id", F.lit("}"))).withColumn("error", F.when(F.col("patient_id") == 3, "timeout"))

    def start():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(asked)
        generate_stream(stream, call, "a bigint", ["patient_id", "top_k"], out, state).awaitTermination()

    put("one", [1, 2, 3, 3])
    put("two", [2, 4])
    with pytest.raises(Exception, match="the model is gone"):
        start()
    stop["at"] = 10
    start()
    start()
    put("three", [3, 5, 1])
    start()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.patient_id, r.success) for r in rows) in ([(1, True), (2, True), (3, False), (3, False), (4, True), (5, True)],)
    assert {r.error_message for r in rows if not r.success} == {"timeout"}
    assert all(r.parsed_answer.a == r.patient_id for r in rows if r.success)
