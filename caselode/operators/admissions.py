"""Each admission's clinical graph: its own relations and the global edges that leave its nodes, all both ways.

Diagnoses keep their numbers as nodes; procedures of global edges are numbered after them; the patient is the node after all.
Relation codes: own diagnoses 4 and back 6, own procedures 5 and 7; global diagnosis-diagnosis 0 and 8,
procedure-procedure 1 and 10, diagnosis-procedure 2 and 9, procedure-diagnosis 3 and 11.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.sources.stages import written

#: Fixed values: (code, code of the edge back) by relation.
OWN = {"diagnosis": (4, 6), "procedure": (5, 7)}
GLOBAL = {("diagnosis", "diagnosis"): (0, 8), ("procedure", "procedure"): (1, 10), ("diagnosis", "procedure"): (2, 9), ("procedure", "diagnosis"): (3, 11)}
#: A node that more admissions have is dealt to several tasks, each with so many of them.
HOT = 200_000
#: Nodes whose sums of edges are broadcast.
FEW = 500_000


def global_edges(cases: DataFrame, diagnosis_nodes: int) -> DataFrame:
    """(src_kind, src, dst, code, back) over all cases (case_id, diagnosis array, procedure array); procedures' nodes are moved by ``diagnosis_nodes``.

    All four relations come of one pass: each node of a case with each other one, kinds as their places in ``OWN``."""
    of = lambda place: lambda x: F.struct(F.lit(place).alias("kind"), x.cast("long").alias("node"))
    nodes = F.concat(*[F.transform(k, of(i)) for i, k in enumerate(OWN)])
    both = cases.select(nodes.alias("x")).select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"))
    pairs = both.filter("a.kind <> b.kind or a.node <> b.node").select(F.col("a.kind").alias("_a"), F.col("a.node").alias("src"), F.col("b.kind").alias("_b"), F.col("b.node").alias("dst")).distinct()
    moved = lambda c, kind: F.col(c) + F.when(F.col(kind) == 1, diagnosis_nodes).otherwise(0)
    places = {k: i for i, k in enumerate(OWN)}
    code = lambda at: F.coalesce(*[F.when((F.col("_a") == places[a]) & (F.col("_b") == places[b]), x[at]) for (a, b), x in GLOBAL.items()])
    kind = F.when(F.col("_a") == 0, "diagnosis").otherwise("procedure")
    return pairs.select(kind.alias("src_kind"), moved("src", "_a").alias("src"), moved("dst", "_b").alias("dst"), code(0).alias("code"), code(1).alias("back"))


def _both_ways(src: str, dst: str, code: Column, back: Column) -> Column:
    return F.array(F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), code.alias("rel")), F.struct(F.col(dst).alias("src"), F.col(src).alias("dst"), back.alias("rel")))


def own_nodes(cases: DataFrame) -> DataFrame:
    """(case_id, kind, node), each once in a case."""
    return cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("nodes")) for k in OWN])).alias("x")).select("case_id", "x.kind", F.explode("x.nodes").alias("node")).distinct()


def admission_edges(cases: DataFrame, edges: DataFrame, patient_node: int, diagnosis_nodes: int, aligned: bool = False, hot: int = HOT) -> DataFrame:
    """(case_id, src, dst, rel) of every admission.

    Global edges are taken where their source is among the case's nodes of that kind.  As stored, a case's procedures aren't
    moved behind the diagnoses as those of global edges are; ``aligned`` moves them for this test and in their own relation.

    A node in more than ``hot`` cases is split: its cases are dealt by hash, its edges go to each share.  There are at most
    total / hot such nodes, so their list can be broadcast.
    """
    nodes = _aligned(own_nodes(cases), diagnosis_nodes, aligned)
    own = nodes.withColumn("patient", F.lit(patient_node).cast("long")).select("case_id", F.inline(_both_ways("patient", "node", _own_code(0), _own_code(1))))
    met = _met(nodes, edges.withColumnsRenamed({"src_kind": "kind", "src": "node"}), hot)
    return own.unionByName(met.select("case_id", F.inline(_both_ways("node", "dst", F.col("code"), F.col("back")))))


def _own_code(at: int) -> Column:
    return F.when(F.col("kind") == "diagnosis", OWN["diagnosis"][at]).otherwise(OWN["procedure"][at])


def _aligned(nodes: DataFrame, diagnosis_nodes: int, aligned: bool) -> DataFrame:
    return nodes.withColumn("node", F.col("node") + F.when(F.col("kind") == "procedure", diagnosis_nodes).otherwise(0)) if aligned else nodes


def _met(nodes: DataFrame, of_nodes: DataFrame, hot: int) -> DataFrame:
    """``nodes`` (case_id, kind, node) with the rows of ``of_nodes`` (kind, node, ..), hot nodes dealt to shares."""
    counts = nodes.groupBy("kind", "node").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    shares = F.broadcast(counts.select("kind", "node", F.ceil(F.col("n") / hot).cast("int").alias("_shares")))
    dealt = nodes.join(shares, ["kind", "node"], "left").withColumn("_share", F.pmod(F.xxhash64("case_id"), F.coalesce("_shares", F.lit(1))).cast("int"))
    spread = of_nodes.join(shares, ["kind", "node"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    return dealt.drop("_shares").join(spread.drop("_shares"), ["kind", "node", "_share"])


def admission_sums(cases: DataFrame, edges: DataFrame, patient_node: int, diagnosis_nodes: int, aligned: bool = False, few: int = FEW, hot: int = HOT) -> DataFrame:
    """(case_id, rel, edges, src_sum, dst_sum, pair_sum): number and sums of what ``admission_edges`` gives, without making its rows.

    A node's global edges are the same in every case that has it, so they are summed once for the node; each case adds up
    its nodes' sums.  Up to ``few`` sums are broadcast; more are joined with hot nodes dealt as there."""
    nodes = _aligned(own_nodes(cases), diagnosis_nodes, aligned)
    sums = edges.groupBy(F.col("src_kind").alias("kind"), F.col("src").alias("node"), "code", "back").agg(F.count("*").alias("n"), F.sum("dst").alias("d"))
    sums = written(sums.groupBy("kind", "node").agg(F.collect_list(F.struct("code", "back", "n", "d")).alias("x")), "sums")
    many = sums.count() > few
    patient, node = F.lit(patient_node).cast("long"), F.col("node")
    part = lambda rel, n, src, dst, pair: F.struct(rel.cast("int").alias("rel"), n.alias("edges"), src.alias("src_sum"), dst.alias("dst_sum"), pair.alias("pair_sum"))
    one = F.lit(1).cast("long")
    own = F.array(part(_own_code(0), one, patient, node, patient * node), part(_own_code(1), one, node, patient, patient * node))
    there = lambda x: part(x["code"], x["n"], x["n"] * node, x["d"], x["d"] * node)
    back = lambda x: part(x["back"], x["n"], x["d"], x["n"] * node, x["d"] * node)
    both = F.concat(F.transform("x", there), F.transform("x", back))
    if many:
        rows = nodes.select("case_id", F.inline(own)).unionByName(_met(nodes, sums, hot).select("case_id", F.inline(both)))
    else:
        rows = nodes.join(F.broadcast(sums), ["kind", "node"], "left").select("case_id", F.inline(F.concat(own, F.when(F.col("x").isNotNull(), both).otherwise(F.slice(own, 1, 0)))))
    return rows.groupBy("case_id", "rel").agg(*[F.sum(c).alias(c) for c in ("edges", "src_sum", "dst_sum", "pair_sum")])


def admission_graphs(edges: DataFrame) -> DataFrame:
    """(case_id, edges array): a case's graph as one row, in the order of relations."""
    return edges.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rel", "src", "dst"))).alias("edges"))

