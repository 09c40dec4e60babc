"""Trap rows of nested records: the order of maps, repeated keys, ids that aren't numbers, unknown ids."""

import pytest
from pyspark.sql import functions as F

from caselode.operators import nested
from caselode.operators.retrieval import hydrated


def test_samples(spark, tmp_path):
    drug = '{"drugid": %s, "name": "n", "caution": [{"crowd": "old", "crowd_id": %s, "caution_levelid": "7"}], "treat": null}'
    line = '{"people": {"id": "p1", "age": 3, "diagnosis": ["d"]}, "top_k_drugs": {"9": %s, "10": %s, "2": %s, "9": %s}}' % (drug % ("9", '" None "'), drug % ('"10"', "5"), drug % ("2", '""'), drug % ("99", "null"))
    (tmp_path / "s.json").write_text(line + "\n")
    row = nested.read_samples(spark, f"{tmp_path}/s.json").first()
    assert [(c.rank, c.drugid, c.drug.drugid) for c in row.candidates] == [(1, "9", "99"), (2, "10", "10"), (3, "2", "2")]
    assert [c.drug.caution[0].crowd_id for c in row.candidates] == [None, 5, None]
    assert row.candidates[0].drug.caution[0].caution_levelid == 7
    assert row.candidates[0].drug.treat == []
    assert (row.people.id, row.people.age) == ("p1", 3)


def test_distinct_by(spark):
    df = spark.sql("select array(named_struct('k', 1, 'v', 'a'), named_struct('k', null, 'v', 'b'), named_struct('k', 1, 'v', 'c'), named_struct('k', null, 'v', 'd'), named_struct('k', 0, 'v', 'e')) x, array() e")
    assert [tuple(r) for r in df.select(nested.distinct_by("x", "k").alias("y")).first().y] == [(1, "a"), (None, "b"), (0, "e")]


def test_unknown_ids(spark):
    found = spark.createDataFrame([(1, "7", 1), (1, "8", 2)], "query_id int, drugid string, rank int")
    known = spark.createDataFrame([("7", "seven")], "drugid string, name string")
    assert [r.drugid for r in hydrated(found, known, "drugid", "skip").collect()] == ["7"]
    with pytest.raises(Exception, match="not in the catalogue: 8"):
        hydrated(found, known, "drugid").agg(F.count("*")).collect()
