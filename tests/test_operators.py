"""Traps of single operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import metrics, retrieval, scorers
from caselode.plans import scoring
from caselode.plans.generation import validation_errors
from caselode.plans.ranking import frozen
from caselode.plans.serving import search_category
from caselode.sources.tables import last_by_key, read_jsonl, read_or_empty, write_jsonl
from caselode.streaming.windows import windowed_counts
from tests.conftest import DATA


def one(spark, column, row="1 x"):
    return spark.sql(f"select {row}").select(column.alias("v")).first().v


def test_strip_is_unicode(spark):
    assert one(spark, T.strip(F.lit("　a\t "))) == "a"


def test_lenient_int(spark):
    assert [one(spark, T.lenient_int(F.lit(v).cast("string"))) for v in (None, "", " None ", "7")] == [None, None, None, 7]


def test_json_object(spark):
    assert one(spark, T.json_object(F.lit('ok {"a":{"b":1}} bye'))) == '{"a":{"b":1}}'
    assert one(spark, T.json_object(F.lit("none"))) == "none"


@pytest.mark.parametrize(
    ("gold", "ranked", "want"),
    [
        (["a", "b", "c"], ["x", "a", "y"], {"hit": 1, "recall": 1 / 3, "precision": 1 / 3, "f1": 1 / 3, "jaccard": 1 / 5, "p1": 0, "mrr": 1 / 2}),
        ([], ["x"], dict.fromkeys(("hit", "recall", "precision", "f1", "jaccard", "p1", "mrr"), 0)),
        (["a"], [], dict.fromkeys(("hit", "recall", "precision", "f1", "jaccard", "p1", "mrr"), 0)),
    ],
)
def test_metrics(spark, gold, ranked, want):
    df = spark.createDataFrame([(gold, ranked)], "gold array<string>, ranked array<string>")
    got = df.select(*[c.alias(n) for n, c in metrics.at_k("gold", "ranked", 5).items()]).first().asDict()
    assert got == pytest.approx(want)


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 0, 2), (1, 3, 1, 2)], "case_id int, rank int, hit int, n_gold int")
    assert metrics.average_precision(df).first().average_precision == pytest.approx(0.833333)


def test_frozen_order(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 2), (1, 3, 1)], "case_id int, retrieval_rank int, rerank_rank int")
    assert [r.retrieval_rank for r in frozen(df, 2).orderBy("place").collect()] == [3, 2]


def test_validation(spark):
    rows = [(False, [1], [1], [1]), (True, [1, 2], [2, 1], [1, 2]), (True, [9], [9], [1])]
    df = spark.createDataFrame(rows, "success boolean, s array<bigint>, i array<bigint>, v array<bigint>")
    got = [r.e for r in df.select(validation_errors(F.col("success"), "s", "i", "v").alias("e")).collect()]
    assert got == [["generation_failed"], ["selected_drugids_and_items_are_not_aligned"], ["unknown_candidate:9", "unknown_item_candidate:9"]]


def test_search_order(spark):
    df = spark.createDataFrame([("ab", None), ("abc", None), ("xab", None), ("zz", "ab")], "name string, number string")
    found = df.withColumn("c", search_category("name", "number", " AB ")).orderBy("c").collect()
    assert [r.name for r in found] == ["ab", "zz", "abc", "xab"]
    assert df.filter(search_category("name", "number", "  ").isNotNull()).count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "é", None), (1, "b", 2)], "seq bigint, a string, n bigint")
    write_jsonl(df, f"{tmp_path}/x")
    schema = "seq bigint, a string, n bigint"
    assert [tuple(r) for r in read_jsonl(spark, f"{tmp_path}/x", schema, limit=1).collect()] == [(0, "é", None)]
    assert read_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    assert read_or_empty(spark, f"{tmp_path}/x", schema).count() == 2


def test_last_by_key(spark):
    df = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 2, "c")], "k string, seq int, v string")
    assert sorted((r.k, r.v) for r in last_by_key(df, "k", "seq").collect()) == [("p", "b"), ("q", "c")]


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0), (0.0, 0.0, 0.0)], "x double, y double, m double")
    got = df.agg(scorers.masked_mean(scorers.bce_with_logits(F.col("x"), F.col("y")), F.col("m")).alias("v")).first().v
    assert got == pytest.approx(0.126928, abs=1e-6)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, windowed_counts(events).collect()))


def test_scorers_read_whole_vectors_and_all_symptoms(spark, tmp_path):
    """Symptoms 500 apart stay apart, and components past the fourth count."""
    import math

    v = {i: [((i * 7 + j * 3) % 11) / 10 for j in range(6)] for i in (2, 3, 502)}
    spark.createDataFrame(list(v.items()), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cases = {1: [2, 502], 2: [2, 3]}
    spark.createDataFrame([(c, s) for c, ids in cases.items() for s in [*ids, ids[0]]], "l_orderkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    degree = {2: 2, 3: 1, 502: 1}
    score = {r.case_id: r.score for r in scoring.setattn_score(spark, str(tmp_path)).collect()}
    passed = {(r.case_id, r.component): r.value for r in scoring.bipartite_message_pass(spark, str(tmp_path)).collect()}
    turned = {(r.case_id, r.component): r.value for r in scoring.relational_convolution(spark, str(tmp_path)).collect()}
    for c, ids in cases.items():
        z = sum(math.exp(v[s][0]) for s in ids)
        assert score[c] == pytest.approx(sum((1, 2, -1, 0.5)[j % 4] * sum(math.exp(v[s][0]) * v[s][j] for s in ids) / z for j in range(6)), abs=1e-5)
        for j in range(6):
            assert passed[c, j + 1] == pytest.approx(sum(v[s][j] / degree[s] for s in ids), abs=1e-5)
            want = 0.0
            for rel in {s % 2 for s in ids}:
                of = [v[s] for s in ids if s % 2 == rel]
                want += sum(scoring.RELATIONS[rel][i % 2][j % 2] * sum(x[i] for x in of) / len(of) for i in (j // 2 * 2, j // 2 * 2 + 1))
            assert turned[c, j + 1] == pytest.approx(max(0.0, want), abs=1e-5)


def test_dense_topk_in_blocks_against_every_other_row(spark):
    """A neighbour whose id is divisible by 50 is found, a query's own row isn't, and blocks change nothing."""
    df = spark.createDataFrame([(i, [1.0, i / 100]) for i in (0, 1, 50, 51, 100, 170)], "id bigint, v array<float>")
    q, c = df.filter("id % 50 = 0").selectExpr("id query_id", "v qv"), df.selectExpr("id doc_id", "v")
    want = [(0, 1), (0, 50), (50, 51), (50, 100), (100, 170), (100, 51)]
    for block in (1, 100):
        got = retrieval.dense_topk(q, c, 2, own=False, block=block).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.doc_id) for r in got] == want


def test_terms_of_mixed_scripts(spark):
    assert one(spark, T.terms(F.lit("Take 2x 头痛发热，咳 ABC头痛"))) == ["take", "2x", "头痛", "痛发", "发热", "咳", "abc", "头痛"]
    assert one(spark, T.terms(F.lit("Don't é naïve-7"))) == one(spark, T.words(F.lit("Don't é naïve-7")))


def test_bm25_finds_chinese_inside_a_run(spark):
    docs = spark.createDataFrame([(1, "患者头痛发热三天"), (2, "患者咳嗽两天"), (3, "plain words")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "头痛"), (2, "words")], "query_id bigint, text string")
    for variant in ("okapi", "lucene"):
        got = retrieval.bm25_topk(q, docs, 5, variant=variant).collect()
        assert sorted((r.query_id, r.doc_id) for r in got) == [(1, 1), (2, 3)]


def test_pointwise_scores_are_plain_columns(spark):
    """No Scala function is in the plan: its converters could not be sent to tasks in a long session."""
    found = scoring.mllib_pointwise_rank(spark, f"{DATA}/sf0.001")
    assert "UDF" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert rows
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_that_stand_for_copies(spark):
    """A row that counts for its copies gives the scores of all of them, by joins and by products of matrices, and copies come back by id."""
    texts = ["red ring round", "blue bolt", "red bolt red", "green nut", "small nut", "old gear"]
    whole = spark.createDataFrame([(i, texts[i % 6]) for i in range(18)], "doc_id long, text string")
    once = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, copies long")
    q = spark.createDataFrame([(1, "red bolt"), (2, "nut ring"), (3, "red bolt")], "query_id long, text string")
    for variant in ("okapi", "lucene"):
        want = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_topk(q, whole, 20, variant=variant).collect()}
        for products in (False, True):
            got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_topk(q, once, 20, variant=variant, products=products).collect()}
            assert got == {k: v for k, v in want.items() if k[1] < 6}
    docs = whole.select("doc_id", F.col("text").alias("lexical"), F.col("text").alias("dense"))
    for name, variant in (("bm25", "okapi"), ("pyserini_bm25", "lucene")):
        got = retrieval.retrieve([name], q.withColumnRenamed("text", "query"), docs, 4).collect()
        assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got) == sorted((r.query_id, r.rank, r.doc_id, r.score) for r in retrieval.bm25_topk(q, whole, 4, variant=variant).collect())


def test_terms_are_counted_in_slices(spark, monkeypatch):
    """Slices of a batch give each document's counts, empty ones included."""
    texts = ["a b a", "", None, "c", "b b b", "a c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(retrieval, "SLICE", 2)
    got = {r.doc_id: (r.dl, dict(zip(r.terms, r.tfs, strict=True)), r.copies) for r in retrieval.counted_terms(docs).collect()}
    assert {k: v[1] for k, v in got.items()} == {0: {"a": 2, "b": 1}, 1: {}, 2: {}, 3: {"c": 1}, 4: {"b": 3}, 5: {"a": 1, "c": 1}}
    assert [got[k][0] for k in (0, 1, 3, 4, 5)] == [3, 0, 1, 3, 2]
    assert all(v[2] == 1 for v in got.values())
