"""Sequences of admissions: each customer's orders by date through recurrent layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.operators import recurrent as R
from caselode.operators.attention import Linear
from caselode.plans.registry import query
from caselode.sources.tables import table

#: Length of inputs and states; how many medicines are predicted.
SIZE, OUT = 4, 3


def _weights(rows: int, columns: int, kind: int) -> Linear:
    """Stand-ins for trained matrices: a rule on row, column and the layer's number."""
    i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return Linear(((i * 3 + j * 5 + kind) % 7 - 3) / 10, ((np.arange(columns) + kind) % 3 - 1) * 0.05)


def _unit(rows: int, kind: int) -> R.GatedUnit:
    pair = lambda k: (_weights(rows, SIZE, k), _weights(SIZE, SIZE, k + 1))
    return R.GatedUnit(pair(kind), pair(kind + 2), pair(kind + 4))


def model() -> R.AdmissionModel:
    return R.AdmissionModel(_unit(SIZE, 0), _unit(SIZE, 10), (_weights(2 * SIZE, SIZE, 20), _weights(SIZE, SIZE, 21)), _unit(SIZE, 30), _weights(SIZE, SIZE, 40), _weights(SIZE, SIZE, 41), (_weights(SIZE, 2 * SIZE, 42), _weights(2 * SIZE, OUT, 43)))


def _sql(x: str, rows: int, columns: int, kind: int) -> str:
    return f"list_transform(range({columns}), lambda j: list_sum(list_transform(range({rows}), lambda i: {x}[i + 1] * ((i * 3 + j * 5 + {kind}) % 7 - 3) / 10.0)) + ((j + {kind}) % 3 - 1) * 0.05)"


def _each(lists: str, what: str) -> str:
    return f"list_transform(list_zip({lists}), lambda p: {what})"


def _unit_sql(x: str, h: str, rows: int, kind: int) -> str:
    """The new state of one unit."""
    gate = lambda k: _each(f"{_sql(x, rows, SIZE, k)}, {_sql(h, SIZE, SIZE, k + 1)}", "1 / (1 + exp(-(p[1] + p[2])))")
    new = _each(f"{_sql(x, rows, SIZE, kind + 4)}, {gate(kind)}, {_sql(h, SIZE, SIZE, kind + 5)}", "tanh(p[1] + p[2] * p[3])")
    return _each(f"{gate(kind + 2)}, {new}, {h}", "(1 - p[1]) * p[2] + p[1] * p[3]")


ZERO = "[" + ", ".join(["0.0::DOUBLE"] * SIZE) + "]"
RELU = "list_transform({}, lambda v: greatest(v, 0.0))"


@query(f"""WITH RECURSIVE li AS (SELECT l_orderkey, count(*) / 7.0 AS n, avg(l_quantity) / 50 AS q, avg(l_discount) * 10 AS d, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY 1),
x AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place,
 [o_totalprice / 500000, substr(o_orderpriority, 1, 1)::INT / 5.0, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS a,
 [coalesce(n, 0), coalesce(q, 0), coalesce(d, 0), coalesce(r, 0)]::DOUBLE[] AS b FROM orders LEFT JOIN li ON l_orderkey = o_orderkey),
s AS (SELECT k, 0::BIGINT AS place, {ZERO} AS hc, {ZERO} AS hm, {ZERO} AS hj FROM (SELECT DISTINCT k FROM x) UNION ALL
 SELECT k, place, hc, hm, {_unit_sql("f", "hj", SIZE, 30)} FROM (SELECT k, place, hc, hm, hj, {_sql("g", SIZE, SIZE, 21)} AS f FROM (SELECT k, place, hc, hm, hj, {RELU.format(_sql("list_concat(hc, hm)", 2 * SIZE, SIZE, 20))} AS g
 FROM (SELECT x.k, x.place, s.hj, {_unit_sql("x.a", "s.hc", SIZE, 0)} AS hc, {_unit_sql("x.b", "s.hm", SIZE, 10)} AS hm FROM s JOIN x ON x.k = s.k AND x.place = s.place + 1)))),
t AS (SELECT x.k, x.o, {_each(f"x.a, {_sql(_sql('s.hj', SIZE, SIZE, 40), SIZE, SIZE, 41)}", "p[1] + p[2]")} AS seen FROM x JOIN s ON s.k = x.k AND s.place = x.place),
c AS (SELECT k, o, list_transform(seen, lambda v: v - list_avg(seen)) AS c FROM t), n AS (SELECT k, o, list_transform(c, lambda v: v / sqrt(list_avg(list_transform(c, lambda w: w * w)) + 0.00001)) AS v FROM c),
p AS (SELECT k, o, {_sql(RELU.format(_sql("v", SIZE, 2 * SIZE, 42)), 2 * SIZE, OUT, 43)} AS l FROM n)
SELECT k AS patient_id, o AS admission_id, round(l[1], 5) + 0.0 AS first, round(l[2], 5) + 0.0 AS second, round(l[3], 5) + 0.0 AS third FROM p""")
def admission_sequence_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every admission's logits after the patient's admissions up to it."""
    share = lambda c: F.when(c, 1.0).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") / 7).alias("n"), (F.avg("l_quantity") / 50).alias("q"), (F.avg("l_discount") * 10).alias("d"), F.avg(share(F.col("l_returnflag") == "R")).alias("r"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias("patient_id"), "o_orderdate", F.col("o_orderkey").alias("admission_id"),
        F.array(F.col("o_totalprice") / 500000, F.substring("o_orderpriority", 1, 1).cast("int") / 5, share(F.col("o_orderstatus") == "F"), share(F.col("o_orderstatus") == "O")).alias("a"),
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("n", "q", "d", "r")]).alias("b"),
    )
    out = R.sequence_logits(orders, "patient_id", ["o_orderdate", "admission_id"], ["a", "b"], model())
    return out.select("patient_id", "admission_id", *[F.round(F.col("logits")[i], 5).alias(n) for i, n in enumerate(("first", "second", "third"))])
