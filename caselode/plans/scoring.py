"""Learned scorers' forward passes on the vector table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.operators import scorers as S
from caselode.operators.vector_sums import near
from caselode.plans.graphs import by_case
from caselode.plans.registry import query
from caselode.sources.tables import table


@query("""WITH x AS (SELECT label, embedding[1]::DOUBLE * 5 AS x, CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN vec_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM embeddings)
SELECT label, round(sum((greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))) * m) / greatest(sum(m), 1.0), 6) AS loss FROM x GROUP BY 1""")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked binary cross-entropy by case."""
    y, m = F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.0), F.when(F.col("vec_id") % 3 > 0, 1.0).otherwise(0.0)
    loss = S.bce_with_logits(F.col("embedding")[0].cast("double") * 5, y)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(S.masked_mean(loss, m), 6).alias("loss"))


RELATIONS = {0: [[1.0, 0.5], [0.0, 1.0]], 1: [[-1.0, 0.0], [2.0, 1.0]]}


#: The whole job: every component of every vector; a case's symptoms have the vectors of their own numbers.
WHOLE = "s AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS vec_id FROM lineitem), c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
HEAD = (1.0, 2.0, -1.0, 0.5)


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(case_id, vec_id) of all symptoms, (vec_id, v) of all vectors, and how many components these have."""
    symptoms = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("vec_id")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return symptoms, vectors, vectors.agg(F.max(F.size("v"))).first()[0] or 0


@query(f"""WITH {WHOLE}, e AS (SELECT vec_id, exp(x) AS e FROM c WHERE i = 1), p AS (SELECT case_id, i, sum(e * x) / sum(e) AS p FROM s JOIN e USING (vec_id) JOIN c USING (vec_id) GROUP BY 1, 2)
SELECT case_id, round(sum(p * CASE i % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN -1.0 ELSE 0.5 END), 6) AS score FROM p GROUP BY 1""")
def setattn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention over a case's symptom set, then a linear head whose weights repeat over all components."""
    symptoms, vectors, dims = _whole(spark, sf_dir)
    rows = symptoms.join(vectors, "vec_id").withColumn("w", F.col("v")[0])
    pooled = S.attention_pool(rows, "case_id", "w", "v")
    return pooled.select("case_id", F.round(S.dot("pooled", F.array(*[F.lit(HEAD[i % len(HEAD)]) for i in range(dims)])), 6).alias("score"))


#: Places that the layers' results are rounded to.
DIGITS = 6


def _met(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, bool]:
    """(dst, src) of all symptoms, brought together by case once, (src, v) of all vectors, and whether these can be broadcast; symptoms without a vector add nothing and stay behind then."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.col("embedding").alias("v"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dst"), F.col("l_suppkey").alias("src"))
    small = near(vectors, "v")
    kept = lines.join(F.broadcast(vectors.select("src")), "src", "left_semi") if small else lines
    return by_case(kept, lines, "dst").distinct(), vectors, small


@query(f"""WITH {WHOLE}, d AS (SELECT vec_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT case_id, i, sum(x / n) AS x FROM s JOIN d USING (vec_id) JOIN c USING (vec_id) GROUP BY 1, 2)
SELECT case_id, i AS component, round(x, 6) AS value FROM m""")
def bipartite_message_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer over column-normalised symptom edges, a row per component."""
    edges, vectors, small = _met(spark, sf_dir)
    # A symptom's weight goes with its vector: edges are brought together by case once, and degrees are counted there.
    degree = edges.groupBy("src").agg((1 / F.count("*")).alias("w"))
    return _by_component(S.message_pass(edges, vectors.join(degree, "src"), small, DIGITS))


@query(f"""WITH {WHOLE}, a AS (SELECT case_id, vec_id % 2 AS rel, i, avg(x) AS a FROM s JOIN c USING (vec_id) GROUP BY 1, 2, 3),
b AS (SELECT case_id, rel, (i + 1) // 2 AS pair, coalesce(max(a) FILTER (i % 2 = 1), 0.0) AS a1, coalesce(max(a) FILTER (i % 2 = 0), 0.0) AS a2 FROM a GROUP BY 1, 2, 3),
t AS (SELECT case_id, pair, sum(CASE rel WHEN 0 THEN a1 ELSE -a1 + 2 * a2 END) AS v1, sum(CASE rel WHEN 0 THEN 0.5 * a1 + a2 ELSE a2 END) AS v2 FROM b GROUP BY 1, 2)
SELECT case_id, pair * 2 - 1 AS component, round(greatest(v1, 0.0), 6) AS value FROM t UNION ALL SELECT case_id, pair * 2, round(greatest(v2, 0.0), 6) FROM t""")
def relational_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relational graph layer whose matrices repeat those of the two relations along the diagonal, a row per component."""
    edges, vectors, _ = _met(spark, sf_dir)
    vectors = vectors.withColumn("v", F.col("v").cast("array<double>"))
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    weights = {r: np.kron(np.eye(-(-dims // 2)), w)[:dims, :dims] for r, w in RELATIONS.items()}
    return _by_component(S.graph_convolution(edges.withColumn("rel", F.col("src") % 2), vectors, weights, digits=DIGITS))


def _by_component(out: DataFrame) -> DataFrame:
    """(case_id, component, value) of (dst, v); components count from 1."""
    return out.select(F.col("dst").alias("case_id"), F.posexplode("v").alias("i", "x")).select("case_id", (F.col("i") + 1).cast("long").alias("component"), F.col("x").alias("value"))


@query()
def mllib_pointwise_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point-wise logistic scorer: trained on the vector table, ranked within each group of 100 ids."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0).alias("label"))
    model = LogisticRegression(maxIter=10, regParam=0.01).fit(rows.select(array_to_vector("v").alias("features"), "label"))
    # Scored by columns: the model's own transform goes through Scala functions, whose converters can't always be sent to tasks.
    margin = S.dot("v", F.array(*[F.lit(float(x)) for x in model.coefficients])) + F.lit(float(model.intercept))
    scored = rows.select("vec_id", F.floor(F.col("vec_id") / 100).alias("group_id"), F.round(S.sigmoid(margin), 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), "vec_id")))
