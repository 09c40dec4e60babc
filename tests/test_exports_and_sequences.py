"""Exports that know when they are stale, recurrent layers row by row, losses of hand-made sets, candidates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselode.operators import recurrent, retrieval, set_losses
from caselode.plans import recurrent as layers
from caselode.sources.artifacts import StaleExportError, fingerprint, load_export, write_export


def test_export_is_refused_once_an_input_changes(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    path = f"{tmp_path}/export"
    manifest = write_export({"even": (rows.filter("id % 2 = 0"), {"total": F.sum("x")})}, {"rows": rows}, path)
    assert manifest["parts"]["even"] == {"rows": 50, "total": 4900}
    assert load_export(spark, path, {"rows": rows.repartition(7)})["even"].count() == 50
    for changed in (rows.limit(99), rows.withColumn("x", F.when(F.col("id") == 3, 7).otherwise(F.col("x"))), rows.unionByName(rows), rows.withColumn("y", F.lit(1))):
        with pytest.raises(StaleExportError, match="rows"):
            load_export(spark, path, {"rows": changed})
    with pytest.raises(StaleExportError, match="other"):
        load_export(spark, path, {"rows": rows, "other": rows})
    rows.limit(10).write.mode("append").parquet(f"{path}/even")
    with pytest.raises(StaleExportError, match="were written"):
        load_export(spark, path, {"rows": rows})
    with pytest.raises(StaleExportError, match="no complete"):
        load_export(spark, f"{tmp_path}/none", {"rows": rows})
    assert fingerprint(rows.limit(0))["rows"] == "0"


def test_sequences_go_on_over_batches(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), i, r.normal(size=4).tolist(), r.normal(size=4).tolist()) for i, k in enumerate(r.choice([1, 1, 1, 2, 3], 300))]
    df = spark.createDataFrame(rows, "k long, t int, a array<double>, b array<double>").repartition(3)
    model = layers.model()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {(x.k, x.t): x.logits for x in recurrent.sequence_logits(df, "k", ["t"], ["a", "b"], model).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300
    for k in (1, 2, 3):
        states = [np.zeros((1, n)) for n in model.sizes]
        for key, t, a, b in rows:
            if key == k:
                states, out = model.step([np.array([a]), np.array([b])], states)
                assert np.allclose(got[k, t], out[0])
    assert recurrent.sequence_logits(df.limit(0), "k", ["t"], ["a", "b"], model).count() == 0


def test_set_losses(spark):
    near = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], "case_id long, similar long")
    batches = spark.createDataFrame([(1, 2, 0), (2, 2, 0), (3, 2, 1), (4, 2, 1), (5, 3, 0)], "case_id long, n long, batch long")
    items = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (2, 9), (3, 7), (4, 9), (5, 7), (5, 8)], "case_id long, drug long")
    common = set_losses.common_items(near, items, "drug")
    assert sorted(map(tuple, common.collect())) == [(1, 8), (2, 8), (5, 7), (5, 8)]
    different = set_losses.different_items(near, items, "drug")
    assert sorted(map(tuple, different.collect())) == [(1, 7), (1, 9), (2, 7), (2, 9), (3, 7), (3, 9), (4, 7), (4, 9)]
    drugs = [(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [0.6, 0.8])]
    sets = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (5, [1.0, 0.0])], "case_id long, v array<double>")
    loss = {(x.n, x.batch): x.loss for x in set_losses.augmentation_loss(near, batches, common, sets, drugs).collect()}
    cost = lambda z, y: max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))
    assert loss[2, 0] == pytest.approx((cost(0, 0) + cost(1, 1) + cost(0.8, 0)) / 3)
    assert loss[2, 1] == 0
    assert loss[3, 0] == pytest.approx((cost(1, 1) + cost(0, 1) + cost(0.6, 0)) / 3)
    between = {(x.n, x.batch): x.loss for x in set_losses.interset_loss(near, batches, different, sets, spark.createDataFrame(drugs, "drug long, v array<double>")).collect()}
    assert between[2, 0] == pytest.approx(1e-4 / (1 + math.exp(-0.4)))
    assert between[2, 1] == pytest.approx(1e-4 * 0.5)
    assert between[3, 0] == 0


def test_set_losses_of_rows_of_cases(spark):
    r = np.random.default_rng(3)
    cases = [(i, r.choice(9, 3, replace=False).tolist(), r.choice(6, r.integers(0, 4), replace=False).tolist()) for i in range(40)]
    batches = spark.createDataFrame([(3, b, cases[8 * b : 8 * b + 8]) for b in range(5)], "n long, batch long, m array<struct<case_id long, s array<long>, d array<long>>>")
    similar = set_losses.similar_cases(batches)
    near = {x.case_id: x.similar for x in similar.collect()}
    for i, s, _ in cases:
        others = [x for x in cases[i // 8 * 8 : i // 8 * 8 + 8] if x[0] != i]
        assert near[i] == min(others, key=lambda x: (-len({*s} & {*x[1]}), x[0]))[0]
    vectors = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(5)], "id long, v array<double>")
    weights = [0.5, -1.0, 0.25, 1.0]
    pairs, drugs = set_losses.compared(similar), vectors.filter("id != 2")
    units = [(x.id, (np.array(x.v) / np.linalg.norm(x.v)).tolist()) for x in drugs.orderBy("id").collect()]
    table = lambda at, name: spark.createDataFrame([(x[0], y) for x in cases for y in x[at]], f"case_id long, {name} long")
    pairs_of, sizes = similar.select("case_id", "similar"), similar.select("case_id", "n", "batch")
    held, known = table(2, "drug"), table(2, "drug").filter("drug in (0, 1, 3, 4)")
    sets = set_losses.set_vectors(set_losses.common_items(pairs_of, table(1, "id"), "id"), vectors, F.array(*map(F.lit, weights)))
    augmented = set_losses.augmentation_loss(pairs_of, sizes, set_losses.common_items(pairs_of, known, "drug"), sets, units)
    between = set_losses.interset_loss(pairs_of, sizes, set_losses.different_items(pairs_of, held, "drug"), sets, spark.createDataFrame(units, "drug long, v array<double>"))
    for want, made in ((augmented, set_losses.pair_augmentation), (between, set_losses.pair_interset)):
        wanted = {(x.n, x.batch): x.loss for x in want.collect()}
        for small in (True, False):
            assert {(x.n, x.batch): x.loss for x in made(pairs, vectors, weights, drugs, small).collect()} == pytest.approx(wanted)
    none = drugs.filter("false")
    assert set_losses.pair_augmentation(pairs, vectors, weights, none).count() == 0
    assert {x.loss for x in set_losses.pair_interset(pairs, vectors, weights, none).collect()} == {0.0}


def test_retrievers(spark):
    docs = spark.createDataFrame([(1, "red ring", "red ring"), (2, "blue bolt", "blue bolt"), (3, "red bolt", "red bolt")], "doc_id long, lexical string, dense string")
    asked = spark.createDataFrame([(10, "red ring"), (11, "")], "query_id long, query string")
    found = retrieval.retrieve(["bm25", "pyserini_bm25", "dense"], asked, docs, 2).collect()
    assert {(x.retriever, x.doc_id) for x in found if x.rank == 1} == {("bm25", 1), ("pyserini_bm25", 1), ("dense", 1)}
    assert {x.query_id for x in found} == {10}
    assert retrieval.retrieve(["bm25", "dense"], asked, docs, 0).count() == 0
    with pytest.raises(ValueError, match="no such retriever: best"):
        retrieval.retrieve(["best"], asked, docs, 2)
    names = spark.createDataFrame([(1, "one")], "doc_id long, name string")
    candidates = spark.createDataFrame([(10, 1, 1), (10, 1, 2), (10, 3, 3)], "query_id long, doc_id long, rank int")
    assert [tuple(x) for x in retrieval.hydrated(candidates, names, "doc_id", "skip").select("doc_id", "rank", "name").collect()] == [(1, 1, "one")]
    with pytest.raises(Exception, match="not in the catalogue: 3"):
        retrieval.hydrated(candidates, names, "doc_id").collect()


def test_case_report_takes_first_clean_answers(spark):
    from caselode.operators.reports import HEAD, NONE, case_report, selected_records

    schema = "run int, variant string, top_k int, seq int, patient_id string, success boolean, errors array<string>, selected array<string>, items array<struct<drugid:string,evidence_ids:array<string>,reason:string>>"
    item = [("7", ["e1", "e2"], "why")]
    rows = [(0, "v", 5, 2, "b", True, [], ["7"], item), (0, "v", 5, 1, "a", False, ["generation_failed"], [], []), (0, "v", 5, 3, "b", True, [], ["8"], []), (1, "w", 5, 1, "b", True, ["x"], ["7"], item), (1, "w", 5, 2, "c", True, [], [], []), (1, "w", 5, 3, "b", True, [], ["9"], item)]
    cases = spark.createDataFrame([("a", 1, "F", ["d"], [], [], ["7"]), ("b", 2, "M", [], ["s"], ["m"], ["7", "8"])], "patient_id string, age int, gender string, diagnosis array<string>, symptom array<string>, on_medicine array<string>, gold array<string>")
    records = spark.createDataFrame(rows, schema)
    got = selected_records(records, cases)
    assert [(r.place, r.variant, r.selected) for r in got.orderBy("place").collect()] == [(1, "v", ["7"]), (2, "w", ["9"])]
    lines = [r.line for r in case_report(got).orderBy("place").collect()]
    assert lines[:4] == HEAD
    assert lines[4] == "## 案例 1"
    assert "- 命中 gold：7" in lines
    assert "- 命中 gold：None" in lines
    assert "- 解释 1：drugid=7；证据=e1, e2；理由=why" in lines
    assert [r.line for r in case_report(selected_records(records, cases, 6).limit(0)).orderBy("place").collect()] == HEAD + NONE
