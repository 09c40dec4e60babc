"""Layered attention scorers over each order's graph of suppliers (evidences) and brands (entities)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.operators import attention as A
from caselode.operators.vector_sums import near_of_used
from caselode.plans.graphs import by_case
from caselode.plans.registry import query
from caselode.sources.tables import table

#: Stand-ins for trained matrices: component i takes these shares of components i + k, and a bias by i.
MIX, SCORE, ANSWER, BACK = {0: 0.5, 1: -0.25, 7: 0.1}, {0: 1.0, 3: 0.5}, {0: 1.0, 2: 0.5}, {0: 0.75, 5: 0.3}
BIAS = 0.01
MAX_ENTITIES, MAX_EVIDENCES = 100, 50


def banded(taps: dict[int, float], d: int) -> A.Linear:
    w = np.zeros((d, d))
    for k, x in taps.items():
        w[(np.arange(d) + k) % d, np.arange(d)] += x
    return A.Linear(w, ((np.arange(d) + 1) % 3 - 1) * BIAS)


def _sql(v: str, taps: dict[int, float]) -> str:
    return f"list_transform(generate_series(1, len({v})), lambda i: {' + '.join(f'({x}) * {v}[(i - 1 + {k}) % len({v}) + 1]' for k, x in taps.items())} + ({BIAS}) * (i % 3 - 1))"


def order_graphs(spark: SparkSession, sf_dir: str) -> tuple[tuple, bool, int]:
    """Each order's edges, vectors, query and caps, and whether the vectors can be broadcast; an edge's weight is how many lines it has; vectors go by the keys' numbers.

    Ends without a vector stay behind before lines are shuffled; lines meet their brands, are brought together by order once, and edges are counted there."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_partkey", F.col("l_suppkey").alias("evidence"), "l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("cast(substring(p_brand, 7) as bigint)").alias("entity"))
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("id"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    ids = lines.select(F.col("evidence").alias("id")).union(part.select("entity")).union(owner.select("id"))
    vectors, small = near_of_used(rows, ids)
    known = F.broadcast(vectors.select("id")) if small else vectors.select("id")
    met = lambda df, end: df.join(known.withColumnRenamed("id", end), end, "left_semi")
    whole = by_case(met(lines, "evidence").join(met(part, "entity"), "l_partkey").select("case_id", "evidence", "entity", "l_linenumber"), lines)
    edges = whole.groupBy("case_id", "evidence", "entity").agg(F.count("*").alias("weight"), F.min("l_linenumber").alias("place"))
    queries = table(spark, sf_dir, "orders").join(met(owner, "id"), "o_custkey").select(F.col("o_orderkey").alias("case_id"), "id")
    return (edges, vectors, queries, MAX_ENTITIES, MAX_EVIDENCES), small, rows.agg(F.max(F.size("v"))).first()[0] or 0


GRAPHS = """vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), qu AS (SELECT o_orderkey AS case_id, v AS q FROM orders JOIN customer ON c_custkey = o_custkey JOIN vec ON vec_id = c_nationkey),
e AS (SELECT l_orderkey AS case_id, l_suppkey AS ev, substr(p_brand, 7)::BIGINT AS en, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN qu ON qu.case_id = l_orderkey GROUP BY 1, 2, 3),
ev0 AS (SELECT DISTINCT case_id, ev AS id, v FROM e JOIN vec ON vec_id = ev), en0 AS (SELECT DISTINCT case_id, en AS id, v FROM e JOIN vec ON vec_id = en)"""


# Sums of 0.0 in the SQL below turn a rounded -0.0 into 0.0, as Spark rounds.
def _round_sql(k: str, score: str, to: str, source: str, old: str, new: str, sources: str, update: str) -> str:
    """One direction of a layer: shares of the edges into ``to``, messages, new vectors."""
    return f""", {k}s AS (SELECT e.case_id, e.ev, e.en, e.n, {score} AS s, src.v AS v FROM e JOIN {sources} src ON src.case_id = e.case_id AND src.id = e.{source} JOIN {old} dst ON dst.case_id = e.case_id AND dst.id = e.{to} JOIN qu ON qu.case_id = e.case_id),
{k}w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY case_id, {to})) * n AS w FROM {k}s), {k}x AS (SELECT case_id, {to} AS id, w / sum(w) OVER (PARTITION BY case_id, {to}) AS w, v FROM {k}w),
{k}u AS (SELECT case_id, id, i, sum(w * x) AS x FROM (SELECT case_id, id, w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {k}x) GROUP BY 1, 2, 3), {k}m AS (SELECT case_id, id, list(x ORDER BY i) AS m FROM {k}u GROUP BY 1, 2),
{new} AS (SELECT o.case_id, o.id, list_transform(list_zip({update}), lambda z: greatest(z[1] + z[2], 0.0)) AS v FROM {old} o JOIN {k}m m ON m.case_id = o.case_id AND m.id = o.id)"""


def pair_sql(layers: int) -> str:
    sql = f"WITH {GRAPHS}"
    for k in range(layers):
        score = f"list_dot_product({_sql('src.v', SCORE)}, {_sql('dst.v', SCORE)})"
        update = f"{_sql('m.m', MIX)}, {_sql('o.v', MIX)}"
        sql += _round_sql(f"a{k}", score, "en", "ev", f"en{k}", f"en{k + 1}", f"ev{k}", update)
        sql += _round_sql(f"b{k}", score, "ev", "en", f"ev{k}", f"ev{k + 1}", f"en{k + 1}", update)
    return sql + f" SELECT x.case_id, id AS entity, round(list_dot_product({_sql('x.v', ANSWER)}, q), 5) + 0.0 AS logit FROM en{layers} x JOIN qu ON qu.case_id = x.case_id"


def query_sql(layers: int) -> str:
    sql = f"WITH {GRAPHS}"
    for k in range(layers):
        sql += _round_sql(f"a{k}", f"list_dot_product({_sql('src.v', SCORE)}, q)", "en", "ev", f"en{k}", f"en{k + 1}", f"ev{k}", f"{_sql('m.m', MIX)}, o.v")
        sql += _round_sql(f"b{k}", f"list_dot_product({_sql('src.v', ANSWER)}, q)", "ev", "en", f"ev{k}", f"ev{k + 1}", f"en{k + 1}", f"{_sql('m.m', BACK)}, o.v")
    head = lambda kind, t, taps, bias: f"SELECT x.case_id, '{kind}' AS kind, id AS node, round(list_dot_product(list_transform(generate_series(1, len(x.v)), lambda i: {' + '.join(f'({c}) * x.v[(i - 1 + {k}) % len(x.v) + 1]' for k, c in taps.items())}), q) + {bias}, 5) + 0.0 AS logit FROM {t} x JOIN qu ON qu.case_id = x.case_id"
    return sql + f" {head('entity', f'en{layers}', ANSWER, 0.1)} UNION ALL {head('evidence', f'ev{layers}', BACK, -0.2)}"


@query(pair_sql(2))
def pair_attention_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of attention by both ends, then each entity's answer."""
    graphs, small, d = order_graphs(spark, sf_dir)
    model = A.PairAttention([(banded(MIX, d), banded(SCORE, d))] * 2, banded(ANSWER, d))
    return A.case_logits(*graphs, model, small).select("case_id", F.col("node").alias("entity"), F.round("logit", 5).alias("logit"))


@query(query_sql(3))
def query_attention_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of attention by the case's vector, then bilinear scores of entities and evidences."""
    graphs, small, d = order_graphs(spark, sf_dir)
    layer = (banded(SCORE, d), banded(MIX, d), banded(ANSWER, d), banded(BACK, d))
    model = A.QueryAttention([layer] * 3, (banded(ANSWER, d).w, 0.1), (banded(BACK, d).w, -0.2))
    return A.case_logits(*graphs, model, small).select("case_id", "kind", "node", F.round("logit", 5).alias("logit"))
