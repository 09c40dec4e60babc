"""Graph samples of cases: capped evidences and entities with labels, masks and weights, roles both ways; admission graphs.

A case's taken medicines (numbers divisible by 4) come before its candidates; medicines divisible by 5 are the right ones.
Evidences and entities are capped before a case is put into one row, so a row stays small whatever a case holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import table

MAX_EVIDENCES = 4
MAX_ENTITIES = 8

EVIDENCES = RANKED + f""", e0 AS (SELECT case_id, drug_id, row_number() OVER (PARTITION BY case_id ORDER BY (drug_id % 4 = 0) DESC, rank) - 1 AS evidence, drug_id % 5 = 0 AS gold FROM rk),
e1 AS (SELECT *, bool_or(gold) OVER (PARTITION BY case_id) AS answered FROM e0 WHERE evidence < {MAX_EVIDENCES}), ev AS (SELECT case_id, drug_id, evidence, gold FROM e1 WHERE answered)"""
SAMPLES = EVIDENCES + f""", n0 AS (SELECT case_id, evidence, gold, unnest(['drug', 'treat', 'ingredient']) AS kind, unnest(['drug:' || drug_id, p_type, p_brand]) AS key, unnest([0, 1, 2]) AS place FROM ev JOIN part ON drug_id = p_partkey),
n1 AS (SELECT case_id, key, min(evidence * 3 + place) AS first FROM n0 GROUP BY 1, 2),
n2 AS (SELECT case_id, key, row_number() OVER (PARTITION BY case_id ORDER BY first) - 1 AS entity FROM n1),
n3 AS (SELECT n0.case_id, entity, evidence, n0.key, kind, (kind = 'drug' AND gold)::INT AS label FROM n0 JOIN n2 ON n0.case_id = n2.case_id AND n0.key = n2.key WHERE entity < {MAX_ENTITIES - 1}),
sm AS (SELECT * FROM (SELECT *, max(label) OVER (PARTITION BY case_id) AS answered FROM n3) x WHERE answered = 1)"""


def capped_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, drug_id, evidence, gold): taken medicines, then candidates, each once and no more than the cap."""
    first = Window.partitionBy("case_id").orderBy((F.col("drug_id") % 4 != 0), "rank")
    rows = ranked_items(spark, sf_dir).withColumn("evidence", (F.row_number().over(first) - 1).cast("long")).filter(F.col("evidence") < MAX_EVIDENCES)
    return rows.select("case_id", "drug_id", "evidence", (F.col("drug_id") % 5 == 0).alias("gold"))


@query(f"WITH {EVIDENCES} SELECT case_id, evidence, drug_id, gold FROM ev")
def training_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidences of the cases that have a right one among those kept."""
    rows = capped_evidences(spark, sf_dir)
    answered = rows.filter("gold").select("case_id").distinct()
    return rows.join(answered, "case_id", "left_semi").select("case_id", "evidence", "drug_id", "gold")


def _held(spark: SparkSession, sf_dir: str, *fields: Column) -> DataFrame:
    """(case_id, x): a case's evidences in order, at most as many as the cap, each with its ``fields``."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_type", "p_brand")
    rows = capped_evidences(spark, sf_dir).join(parts, "drug_id")
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("evidence", "drug_id", "gold", *fields))).alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, x, keys): cases with a right medicine among their evidences and still among their capped entities."""
    node = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    nodes = F.array(node("drug", F.concat(F.lit("drug:"), "drug_id")), node("treat", F.col("p_type")), node("ingredient", F.col("p_brand")))
    keys = F.array_distinct(F.flatten(F.transform("x", lambda e: F.transform(e["nodes"], lambda n: n["key"]))))
    capped = _held(spark, sf_dir, nodes.alias("nodes")).withColumn("keys", F.slice(keys, 1, MAX_ENTITIES - 1))
    return capped.filter(F.exists("x", lambda e: e["gold"] & F.array_contains("keys", e["nodes"][0]["key"])))


@query(f"WITH {SAMPLES} SELECT case_id, entity, evidence, key, kind, label, round(1.0 / count(*) OVER (PARTITION BY case_id, evidence), 6) AS w FROM sm")
def bipartite_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a case's entities and evidences; the weights of an evidence sum to 1."""
    kept = F.filter("e.nodes", lambda n: F.array_contains("keys", n["key"]))
    rows = samples(spark, sf_dir).select("case_id", "keys", F.explode("x").alias("e")).withColumn("nodes", kept)
    edges = rows.select("case_id", "keys", F.col("e.evidence").alias("evidence"), F.col("e.gold").alias("gold"), F.round(1.0 / F.size("nodes"), 6).alias("w"), F.inline("nodes"))
    label = ((F.col("kind") == "drug") & F.col("gold")).cast("int")
    return edges.select("case_id", (F.array_position("keys", F.col("key")) - 1).alias("entity"), "evidence", "key", "kind", label.alias("label"), "w")


@query(f"""WITH {SAMPLES}, k AS (SELECT case_id, max(entity) + 1 AS n FROM sm GROUP BY 1), v AS (SELECT case_id, count(*) AS m, count(*) FILTER (gold) AS answers FROM ev GROUP BY 1)
SELECT case_id, repeat('1', n::INT) || repeat('0', ({MAX_ENTITIES} - n)::INT) AS entity_mask, repeat('1', m::INT) || repeat('0', ({MAX_EVIDENCES} - m)::INT) AS evidence_mask, answers FROM k JOIN v USING (case_id)""")
def sample_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places of a sample's fixed shape are in use, and how many of its evidences are right."""
    mask = lambda items, width: F.rpad(F.repeat(F.lit("1"), F.size(items)), width, "0")
    return samples(spark, sf_dir).select("case_id", mask("keys", MAX_ENTITIES).alias("entity_mask"), mask("x", MAX_EVIDENCES).alias("evidence_mask"), F.size(F.filter("x", lambda e: e["gold"])).cast("long").alias("answers"))


#: A medicine's attributes, with gaps: a case may have none at all.
@query(f"""WITH {EVIDENCES}, a AS (SELECT case_id, evidence AS entity, gold, unnest([CASE WHEN drug_id % 3 > 0 THEN p_type END, CASE WHEN drug_id % 2 = 0 THEN p_brand END]) AS label, unnest([0, 1]) AS place FROM e0 JOIN part ON drug_id = p_partkey WHERE evidence < {MAX_EVIDENCES}),
f AS (SELECT case_id, label, min(entity * 2 + place) AS first FROM a WHERE label IS NOT NULL GROUP BY 1, 2), k AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY first) - 1 AS evidence FROM f)
SELECT DISTINCT a.case_id, entity, evidence, a.label, gold AS is_answer FROM a JOIN k ON a.case_id = k.case_id AND a.label = k.label WHERE evidence < 3""")
def reversed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medicines as entities, their attributes as at most three evidences; cases without either are left out."""
    labels = F.array(F.when(F.col("drug_id") % 3 > 0, F.col("p_type")), F.when(F.col("drug_id") % 2 == 0, F.col("p_brand")))
    held = _held(spark, sf_dir, F.filter(labels, lambda t: t.isNotNull()).alias("labels"))
    keys = F.slice(F.array_distinct(F.flatten(F.transform("x", lambda e: e["labels"]))), 1, 3)
    rows = held.withColumn("keys", keys).filter("size(keys) > 0").select("case_id", "keys", F.explode("x").alias("e"))
    edges = rows.select("case_id", "keys", F.col("e.evidence").alias("entity"), F.col("e.gold").alias("is_answer"), F.explode(F.array_distinct("e.labels")).alias("label"))
    return edges.select("case_id", "entity", (F.array_position("keys", F.col("label")) - 1).alias("evidence"), "label", "is_answer").filter("evidence >= 0")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS node FROM lineitem)
SELECT case_id, 0 AS src, node AS dst, 1 AS type, 1 AS weight FROM m UNION ALL SELECT case_id, node, 0, 2, 1 FROM m""")
def medicine_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's medicines alone: edges from the patient of type 1, back of type 2, weight 1."""
    edge = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(1).alias("weight"))
    zero, node = F.lit(0).cast("long"), F.col("node")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("node")).distinct()
    return m.select("case_id", F.inline(F.array(edge(zero, node, 1), edge(node, zero, 2))))


@query("""WITH m AS (SELECT s_nationkey AS graph, max(s_suppkey) AS top FROM supplier GROUP BY 1), i AS (SELECT graph, unnest(range(top + 1)) AS node FROM m)
SELECT graph, node, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = graph AND s_suppkey = node) AS present FROM i""")
def graph_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a graph numbered without gaps up to its largest one, whether or not an edge names them."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("node"))
    whole = s.groupBy("graph").agg(F.max("node").alias("top")).select("graph", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("node"))
    return whole.join(s.distinct().withColumn("present", F.lit(True)), ["graph", "node"], "left").fillna(False, ["present"])


REQUESTS = RANKED + """, q AS (SELECT DISTINCT case_id, CASE WHEN case_id % 10 < 8 THEN 'train' ELSE 'eval' END AS split, variant, top_k, 'm' || case_id % 2 AS model FROM rk, (VALUES ('direct'), ('rerank')) v(variant), (VALUES (1), (5)) k(top_k))"""


@query(f"WITH {REQUESTS} SELECT * FROM q WHERE NOT (case_id % 6 <> 0 AND variant = 'direct' AND model = 'm1')")
def pending_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a successful record of the same case, split, variant, cut and model."""
    identity = ["case_id", "split", "variant", "top_k", "model"]
    cases = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id")).distinct()
    runs = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("top_k")) for v in ("direct", "rerank") for k in (1, 5)])
    requests = cases.select("case_id", F.when(F.col("case_id") % 10 < 8, "train").otherwise("eval").alias("split"), F.inline(runs), F.concat(F.lit("m"), F.col("case_id") % 2).alias("model")).select(*identity)
    done = requests.filter("case_id % 6 != 0 and variant = 'direct' and model = 'm1'")
    return requests.join(done, identity, "left_anti")
