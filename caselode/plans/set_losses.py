"""Losses over pairs of similar orders: suppliers are symptoms, brands medicines."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.operators import set_losses as L
from caselode.plans.encoding import SIZES, in_batches
from caselode.plans.registry import ORACLES, query
from caselode.plans.sets import WEIGHTS
from caselode.sources.tables import table

LOSSES = f"""WITH {SIZES}, sim AS ({ORACLES["batch_similar_index"]}), nb AS (SELECT sim.case_id, sim.similar AS near, n, batch FROM sim JOIN b USING (case_id)),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM v),
sy AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS x FROM lineitem), dr AS (SELECT DISTINCT l_orderkey AS case_id, substr(p_brand, 7)::BIGINT AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
voc AS (SELECT DISTINCT d, v FROM dr JOIN u ON vec_id = d), cs AS (SELECT nb.case_id, a.x FROM nb JOIN sy a ON a.case_id = nb.case_id JOIN sy o ON o.case_id = nb.near AND o.x = a.x),
ca AS (SELECT case_id, v, exp(tanh(list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * [0.5, -1.0, 0.25, 1.0][i % 4 + 1])))) AS e FROM cs JOIN v ON vec_id = x),
cu AS (SELECT case_id, i, sum(e * y) / sum(e) AS y FROM (SELECT case_id, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM ca) GROUP BY 1, 2), cl AS (SELECT case_id, list(y ORDER BY i) AS y FROM cu GROUP BY 1),
cv AS (SELECT case_id, list_transform(y, lambda q: q / greatest(sqrt(list_dot_product(y, y)), 1e-12)) AS v FROM cl),
cd AS (SELECT nb.case_id, a.d FROM nb JOIN dr a ON a.case_id = nb.case_id JOIN dr o ON o.case_id = nb.near AND o.d = a.d)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases beside their similar ones, vectors, the drugs' vectors.

    A case is one row with its sets, so that similar cases, common and different parts come inside a batch's row."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr("cast(substring(p_brand, 7) as bigint)").alias("drug"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").filter("l_orderkey is not null").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    sets = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("l_suppkey").alias("s"), F.collect_set("drug").alias("d"))
    batches = in_batches(sets).persist(StorageLevel.DISK_ONLY)
    drugs = batches.select(F.explode("m").alias("x")).select(F.explode("x.d").alias("id")).distinct()
    return L.compared(L.similar_cases(batches)), vectors, drugs.join(vectors, "id")


@query(LOSSES + """, z AS (SELECT nb.n, nb.batch, nb.case_id, coalesce(list_dot_product(cv.v, voc.v), 0.0) AS z, (cd.d IS NOT NULL)::INT AS y FROM nb CROSS JOIN voc LEFT JOIN cv ON cv.case_id = nb.case_id LEFT JOIN cd ON cd.case_id = nb.case_id AND cd.d = voc.d)
SELECT n, batch, round(CASE WHEN sum(y) > 0 THEN avg(greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z)))) ELSE 0.0 END, 6) AS loss FROM z GROUP BY 1, 2""")
def common_augmentation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of common symptoms against common medicines, by batch; the vocabulary of medicines is held by the driver."""
    pairs, vectors, drugs = _parts(spark, sf_dir)
    loss = L.pair_augmentation(pairs, vectors, WEIGHTS, drugs)
    return loss.select("n", "batch", F.round("loss", 6).alias("loss"))


@query(LOSSES + """, dx AS (SELECT case_id, d FROM (SELECT nb.case_id, a.d FROM nb JOIN dr a ON a.case_id = nb.case_id UNION ALL SELECT nb.case_id, o.d FROM nb JOIN dr o ON o.case_id = nb.near) GROUP BY 1, 2 HAVING count(*) = 1),
dm AS (SELECT case_id, list(x ORDER BY i) AS m FROM (SELECT case_id, i, avg(x) AS x FROM (SELECT case_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM dx JOIN voc ON voc.d = dx.d) GROUP BY 1, 2) GROUP BY 1)
SELECT n, batch, round(CASE WHEN count(m) > 0 THEN avg(coalesce(1 / (1 + exp(-list_dot_product(cv.v, m))), 0.5)) ELSE 0.0 END, 6) AS loss FROM nb LEFT JOIN cv USING (case_id) LEFT JOIN dm USING (case_id) GROUP BY 1, 2""")
def interset_interaction_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near common symptoms are to the medicines that differ, by batch, in units of the term's weight."""
    pairs, vectors, drugs = _parts(spark, sf_dir)
    loss = L.pair_interset(pairs, vectors, WEIGHTS, drugs)
    return loss.select("n", "batch", F.round(F.col("loss") / L.INTERSET, 6).alias("loss"))
