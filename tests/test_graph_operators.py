"""Paths, catalogue, vector sums, attention and admission graphs on small graphs worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselode.operators import admissions, attention, paths
from caselode.operators import vector_sums as vector_sums_of
from caselode.operators.vector_sums import neighbour_sums, vector_sums

EDGES = "edge_id string, rel string, src string, dst string"
NODES = "id string, label string, name string, number string"


def test_paths_use_an_edge_once(spark):
    edges = spark.createDataFrame([("e1", "r", "a", "b"), ("e2", "r", "b", "a"), ("e3", "r", "b", "b"), ("e4", "r", "b", "c")], EDGES)
    starts = spark.createDataFrame([("a",)], "id string")
    got = sorted((r.depth, r.node, "".join(r.used)) for r in paths.edge_distinct_paths(starts, edges, 0, 3).collect())
    want = [(0, "a", ""), (1, "b", "e1"), (2, "a", "e1e2"), (2, "b", "e1e3"), (2, "c", "e1e4"), (3, "a", "e1e3e2"), (3, "c", "e1e3e4")]
    assert got == want  # a-b-a-b would use e1 twice, a-b-b-b e3
    assert {(r.depth, r.node) for r in paths.edge_distinct_paths(starts, edges, 2, 2).collect()} == {(2, "a"), (2, "b"), (2, "c")}


def test_typed_ends_are_those_of_paths(spark):
    r = np.random.default_rng(5)
    nodes = spark.createDataFrame([(f"n{i}", "xyz"[i % 3], None, None) for i in range(12)], NODES)
    edges = spark.createDataFrame(sorted({(f"n{a}>n{b}", "r", f"n{a}", f"n{b}") for a, b in r.integers(0, 12, (26, 2))}), EDGES)
    starts = nodes.filter("label = 'x'")
    for most in (0, 1, 3):
        for label in ("x", "y"):
            want = {(p.start, p.node) for p in paths.edge_distinct_paths(starts, edges, 0, most).collect() if "xyz"[int(p.node[1:]) % 3] == label}
            got = [(p.start, p.end) for p in paths.typed_ends(starts, nodes, edges, label, most).collect()]
            assert sorted(got) == sorted(want)


def test_path_counts_are_those_of_paths(spark):
    r = np.random.default_rng(6)
    # Nodes of 8 and more are entered by no edge; n9 starts twice.
    edges = spark.createDataFrame(sorted({(f"n{a}>n{b}", "r", f"n{a}", f"n{b}") for a, b in zip(r.integers(0, 12, 40), r.integers(0, 8, 40), strict=True)}), EDGES)
    starts = spark.createDataFrame([("n1",), ("n8",), ("n9",), ("n9",), ("none",)], "id string")
    for least, most in ((0, 3), (2, 4), (0, 0)):
        want = paths.edge_distinct_paths(starts, edges, least, most).groupBy("node", "depth").count().collect()
        assert sorted(map(tuple, paths.path_counts(starts, edges, least, most).select("node", "depth", "paths").collect())) == sorted(map(tuple, want))


def test_catalogue_lists(spark):
    nodes = [("4:g:1", "drug", "one", "C1"), ("4:g:2", "drug", "two", None), ("4:g:3", "fact", None, None), ("4:g:4", "crowd", "old", None), ("4:g:5", "crowd", None, None), ("4:g:6", "level", "never", None), ("4:g:7", "ill", "flu", None)]
    edges = [("a", "use", "4:g:1", "4:g:3"), ("b", "use", "4:g:3", "4:g:4"), ("c", "use", "4:g:3", "4:g:5"), ("d", "level", "4:g:3", "4:g:6"), ("e", "treats", "4:g:1", "4:g:7"), ("f", "treats", "4:g:7", "4:g:7")]
    out = paths.catalogue(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), "drug", ("use", "fact", "crowd", "level", "level"), {"treat": ("treats", "ill", 3)})
    rows = {r.drugid: r for r in out.collect()}
    assert set(rows) == {"1", "2"}
    assert [tuple(x) for x in rows["1"].caution] == [(4, "old", 6, "never")]
    assert [tuple(x) for x in rows["1"].treat] == [(7, "flu")]
    assert rows["2"].caution == []
    assert rows["2"].treat == []


def test_vector_sums_over_batches(spark):
    r = np.random.default_rng(1)
    key, w, v = r.integers(0, 40, 5000), r.normal(0, 300, 5000), r.normal(size=(5000, 3))
    key[:2000] = 7  # a hot key
    df = spark.createDataFrame([(int(k), float(a), x.tolist()) for k, a, x in zip(key, w, v, strict=True)], "k long, w double, v array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        plain = {x.k: (x.v, x.total) for x in vector_sums(df, ["k"], "w", "v").collect()}
        soft = {x.k: x.v for x in vector_sums(df, ["k"], "w", "v", softmax=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(plain) == set(key.tolist())
    for k in plain:
        at = key == k
        assert np.allclose(plain[k][0], (v[at] * w[at, None]).sum(0))
        assert plain[k][1] == pytest.approx(w[at].sum())
        e = np.exp(w[at] - w[at].max())
        assert np.allclose(soft[k], (v[at] * e[:, None]).sum(0) / e.sum())
    assert vector_sums(df.limit(0), ["k"], "w", "v").count() == 0


def test_edge_softmax_masks_and_large_scores():
    share = attention.edge_softmax(np.array([1000.0, 999.0, 5.0, 2.0]), np.array([1.0, 2.0, 0.0, 0.0]), np.array([0, 0, 0, 1]), 3)
    e = np.array([1.0, 2 * np.exp(-1)])
    assert np.allclose(share, [*(e / e.sum()), 0, 0])


def test_attention_of_one_case_at_a_time(spark):
    """A batch of cases gives what each case gives alone, and caps keep the first evidences and entities."""
    r = np.random.default_rng(2)
    edges = [(c, ev, en, int(r.integers(1, 4)), int(ev)) for c in range(6) for ev in range(4) for en in range(3) if r.random() < 0.7]
    e = spark.createDataFrame(edges, "case_id long, evidence long, entity long, weight long, place long")
    vectors = spark.createDataFrame([(k, i, r.normal(size=4).tolist()) for k in ("evidence", "entity") for i in range(4)], "kind string, id long, v array<double>")
    queries = spark.createDataFrame([(c, r.normal(size=4).tolist()) for c in range(6)], "case_id long, query array<double>")
    make = lambda: attention.Linear(r.normal(size=(4, 4)), r.normal(size=4))
    model = attention.QueryAttention([(make(), make(), make(), make()) for _ in range(2)], (r.normal(size=(4, 4)), 0.5), (r.normal(size=(4, 4)), 0.0))
    whole = {(x.case_id, x.kind, x.node): x.logit for x in attention.attention_logits(attention.case_graphs(e, vectors, queries, 100, 50), model).collect()}
    for c in range(6):
        alone = attention.attention_logits(attention.case_graphs(e.filter(F.col("case_id") == c), vectors, queries, 100, 50), model).collect()
        assert {(x.case_id, x.kind, x.node) for x in alone} == {k for k in whole if k[0] == c}
        assert all(x.logit == pytest.approx(whole[x.case_id, x.kind, x.node]) for x in alone)
    capped = attention.case_graphs(e, vectors, queries, 2, 1).collect()
    for row in capped:
        first = min(ev for c, ev, *_ in edges if c == row.case_id)
        assert row.evidence_ids == [first]
        assert row.entity_ids == sorted(en for c, ev, en, *_ in edges if (c, ev) == (row.case_id, first))[:2]


def test_admission_graph_with_hot_nodes(spark):
    cases = spark.createDataFrame([(i, [1, 2 + i % 3], [1 + i % 4, 5]) for i in range(60)], "case_id long, diagnosis array<long>, procedure array<long>")
    edges = admissions.global_edges(cases, 10)
    want = sorted(map(tuple, admissions.admission_edges(cases, edges, 99, 10, aligned=True).collect()))
    got = sorted(map(tuple, admissions.admission_edges(cases, edges, 99, 10, aligned=True, hot=7).collect()))
    assert got == want
    assert {r for *_, r in want} == set(range(12))
    one = [x for x in want if x[0] == 0]
    assert {(s, d) for _, s, d, r in one if r == 4} == {(99, 1), (99, 2)}
    assert {(s, d) for _, s, d, r in one if r == 7} == {(11, 99), (15, 99)}
    # As stored, no case procedure has the number of a moved one here, so no global procedure edge is met.
    assert {r for *_, r in admissions.admission_edges(cases, edges, 99, 10).collect()} == {0, 2, 4, 5, 6, 7, 8, 9}
    lists = admissions.admission_graphs(admissions.admission_edges(cases, edges, 99, 10)).collect()
    assert len(lists) == 60
    assert [x.rel for x in lists[0].edges] == sorted(x.rel for x in lists[0].edges)


def test_admission_sums_are_those_of_the_edges(spark):
    """Sums of a node's edges, broadcast or dealt, are what the edges of each case add up to."""
    cases = spark.createDataFrame([(i, [1, 2 + i % 3], [1 + i % 4, 5]) for i in range(30)] + [(30, [], [6]), (31, [7], [])], "case_id long, diagnosis array<long>, procedure array<long>")
    edges = admissions.global_edges(cases, 10)
    for aligned in (False, True):
        want = {}
        for c, s, d, r in admissions.admission_edges(cases, edges, 99, 10, aligned).collect():
            n, a, b, p = want.get((c, r), (0, 0, 0, 0))
            want[c, r] = (n + 1, a + s, b + d, p + s * d)
        for few in (0, 100):
            got = admissions.admission_sums(cases, edges, 99, 10, aligned, few=few, hot=7).collect()
            assert {(x.case_id, x.rel): (x.edges, x.src_sum, x.dst_sum, x.pair_sum) for x in got} == want


def test_neighbour_sums_over_batches(spark):
    """Vectors are added as they come, with the same sums as after a shuffle, whatever the batches cut."""
    r = np.random.default_rng(3)
    rows = [(int(d), int(s), int(s % 2), float(w)) for d, s, w in zip(r.integers(0, 40, 3000), r.integers(0, 20, 3000), r.normal(size=3000), strict=True)] + [(99, 3, 1, 1.0)] * 200
    edges = spark.createDataFrame(rows, "dst long, src long, rel long, w double").repartition(5)
    nodes = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(20)], "src long, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    try:
        for counted in (None, ["rel"]):
            a, b = ({x.dst: x.v for x in neighbour_sums(edges, nodes, ["src"], counted, small=small).collect()} for small in (True, False))
            assert len(a) == 41
            assert a.keys() == b.keys()
            assert all(np.allclose(a[k], b[k]) for k in a)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert neighbour_sums(edges.limit(0), nodes, ["src"]).count() == 0


def test_case_logits_by_rows_and_by_lists(spark):
    """Cases that get their vectors in place give the logits of cases joined with them, whatever the batches cut; ends without a vector are left out."""
    r = np.random.default_rng(4)
    edges = [(c, ev, en, int(r.integers(1, 4)), int(ev)) for c in range(30) for ev in range(5) for en in range(4) if r.random() < 0.6]
    e = spark.createDataFrame(edges, "case_id long, evidence long, entity long, weight long, place long")
    vectors = spark.createDataFrame([(k, i, r.normal(size=4).tolist()) for k in attention.KINDS for i in range(4)], "kind string, id long, v array<double>")
    queries = spark.createDataFrame([(c, c % 5) for c in range(30)], "case_id long, id long")
    make = lambda: attention.Linear(r.normal(size=(4, 4)), r.normal(size=4))
    model = attention.QueryAttention([(make(), make(), make(), make())], (r.normal(size=(4, 4)), 0.5), (r.normal(size=(4, 4)), 0.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        a, b = ({(x.case_id, x.kind, x.node): x.logit for x in attention.case_logits(e, vectors, queries, 3, 4, model, small).collect()} for small in (True, False))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {c for c, *_ in a} == {c for c in range(30) if c % 5 < 4}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_cases_are_brought_together_in_tasks_of_bounded_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, and results stay the same."""
    from caselode.plans import graphs
    from tests.conftest import DATA

    for f in (graphs.adj_normalized, graphs.entity_cap):
        want = sorted(map(tuple, f(spark, f"{DATA}/sf0.001").collect()))
        with monkeypatch.context() as m:
            m.setattr(graphs, "TASK_ROWS", 500)
            found = f(spark, f"{DATA}/sf0.001")
            assert found.rdd.getNumPartitions() >= 10
            assert sorted(map(tuple, found.collect())) == want


def test_sums_are_rounded_as_sql_rounds():
    got = vector_sums_of.rounded(np.array([0.125, -0.125, 2.5, -2.5, 0.37499999999999994, -0.004, np.inf, 1e300]), 2)
    assert got.tolist() == [0.13, -0.13, 2.5, -2.5, 0.37, 0.0, np.inf, 1e300]
    assert not np.signbit(got[5])


def test_layers_bring_edges_together_once(spark, monkeypatch):
    """Lines without a vector stay behind, the others are dealt by case once, in tasks of bounded rows, and results stay the same."""
    from caselode.plans import graphs, scoring
    from tests.conftest import DATA

    for f in (scoring.bipartite_message_pass, scoring.relational_convolution):
        want = sorted(map(tuple, f(spark, f"{DATA}/sf0.001").collect()))
        with monkeypatch.context() as m:
            m.setattr(graphs, "TASK_ROWS", 500)
            found = f(spark, f"{DATA}/sf0.001")
            assert found.rdd.getNumPartitions() >= 10
            assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        lines = plan[plan.index("RepartitionByExpression") :].splitlines()
        assert "LeftSemi" in "".join(lines[1:3])


def test_vectors_of_all_kinds_are_given_once(spark):
    """Vectors without kinds give the logits of the same vectors listed for each kind, broadcast or joined by shuffles."""
    r = np.random.default_rng(5)
    e = spark.createDataFrame([(c, ev, en, 1 + (ev + en) % 3, ev) for c in range(8) for ev in range(4) for en in range(3) if (c + ev * en) % 3], "case_id long, evidence long, entity long, weight long, place long")
    once = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(5)], "id long, v array<float>")
    thrice = once.withColumn("kind", F.explode(F.array(*map(F.lit, attention.KINDS))))
    queries = spark.createDataFrame([(c, c % 6) for c in range(8)], "case_id long, id long")
    make = lambda: attention.Linear(r.normal(size=(4, 4)), r.normal(size=4))
    model = attention.PairAttention([(make(), make())], make())
    got = [{(x.case_id, x.node): x.logit for x in attention.case_logits(e, v, queries, 100, 50, model, small).collect()} for v in (once, thrice) for small in (True, False)]
    assert len(got[0]) > 10
    assert all(x == pytest.approx(got[0]) for x in got)


@pytest.mark.parametrize("name", ["query_attention_logits", "pair_attention_logits"])
def test_more_vectors_than_can_be_broadcast(spark, monkeypatch, name):
    """Vectors count once and as floats; beyond the bound those in use are tried, and only then are vectors shuffled. Results stay the same."""
    from caselode.plans import attention as plans
    from tests.conftest import DATA

    whole, rows = f"{DATA}/sf0.001", lambda df: sorted(map(tuple, df.collect()))
    want = rows(getattr(plans, name)(spark, whole))
    for bound, small, held in ((130_000, True, 500), (60_000, True, None), (0, False, None)):
        with monkeypatch.context() as m:
            m.setattr(vector_sums_of, "NEAR", bound)
            (edges, vectors, *_), found, _ = plans.order_graphs(spark, whole)
            assert found is small
            assert vectors.count() == held if held else vectors.count() < 300
            assert rows(getattr(plans, name)(spark, whole)) == want
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        # Lines meet vectors' ids and brands before they are shuffled, and are not shuffled again to be counted.
        assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("LeftSemi")
