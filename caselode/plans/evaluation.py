"""Ranking metrics, interaction rates and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.operators import metrics
from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import table

#: A case's gold items are those whose part size is at most 15.
HITS = RANKED + """, hit AS (SELECT case_id, drug_id, rank, p_size <= 15 AS gold, p_brand, p_type FROM rk JOIN part ON drug_id = p_partkey)"""
PER_CASE = HITS + """, m AS (SELECT case_id, count(*) FILTER (gold) AS n_gold, count(*) FILTER (rank <= 5) AS n_ret, count(*) FILTER (gold AND rank <= 5) AS n_hit,
  min(rank) FILTER (gold AND rank <= 5) AS first, count(*) FILTER (gold AND rank = 1) AS top1 FROM hit GROUP BY 1),
x AS (SELECT case_id, CASE WHEN n_hit > 0 THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN n_gold > 0 THEN n_hit / n_gold ELSE 0.0 END AS recall, n_hit / n_ret AS precision,
  CASE WHEN n_hit > 0 THEN 2.0 * n_hit / (n_ret + n_gold) ELSE 0.0 END AS f1, n_hit / (n_ret + n_gold - n_hit) AS jaccard, top1 * 1.0 AS p1, coalesce(1.0 / first, 0.0) AS mrr FROM m)"""
NAMES = ["hit", "recall", "precision", "f1", "jaccard", "p1", "mrr"]


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), (F.col("p_size") <= 15).alias("gold"), "p_brand", "p_type")
    return ranked_items(spark, sf_dir).join(parts, "drug_id")


def _per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _hits(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "drug_id", "gold"))).alias("x"))
    lists = lists.select("case_id", F.transform("x", lambda v: v["drug_id"]).alias("ranked"), F.transform(F.filter("x", lambda v: v["gold"]), lambda v: v["drug_id"]).alias("gold"))
    return lists.select("case_id", *[F.round(c, 6).alias(n) for n, c in metrics.at_k("gold", "ranked", 5).items()])


@query(f"WITH {PER_CASE} SELECT case_id, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in NAMES) + " FROM x")
def rank_metrics_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_case(spark, sf_dir)


@query(f"WITH {PER_CASE} SELECT case_id, round(jaccard::DOUBLE, 6) AS jaccard FROM x WHERE jaccard > 0")
def jaccard_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_case(spark, sf_dir).filter("jaccard > 0").select("case_id", "jaccard")


@query(f"WITH {PER_CASE} SELECT " + ", ".join(f"round(avg(round({n}::DOUBLE, 6)), 6) AS {n}" for n in NAMES) + " FROM x")
def metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_case(spark, sf_dir).agg(*[metrics.mean_or_zero(n).alias(n) for n in NAMES])


@query(f"""WITH {HITS}, c AS (SELECT case_id, rank, gold, sum(gold::INT) OVER (PARTITION BY case_id ORDER BY rank) AS seen, sum(gold::INT) OVER (PARTITION BY case_id) AS n_gold FROM hit)
SELECT case_id, round(coalesce(sum(CASE WHEN gold THEN seen / rank END) / nullif(max(n_gold), 0), 0.0), 6) AS average_precision FROM c GROUP BY 1""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir).withColumn("hit", F.col("gold").cast("int"))
    rows = rows.withColumn("n_gold", F.nullif(F.sum("hit").over(Window.partitionBy("case_id")), F.lit(0)))
    return metrics.average_precision(rows)


@query("""
WITH p AS (SELECT vec_id, label, 1 / (1 + exp(-10 * embedding[1]::DOUBLE)) AS p FROM embeddings), x AS (SELECT label, vec_id, p >= 0.8 AS predicted, vec_id % 7 = 0 AS gold FROM p),
m AS (SELECT label, count(*) FILTER (predicted) AS n_pred, count(*) FILTER (gold) AS n_gold, count(*) FILTER (predicted AND gold) AS n_hit FROM x GROUP BY 1)
SELECT label, n_pred, round(CASE WHEN n_pred > 0 THEN n_hit / n_pred ELSE 0.0 END, 6) AS precision, round(CASE WHEN n_gold > 0 THEN n_hit / n_gold ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN n_pred + n_gold - n_hit > 0 THEN n_hit / (n_pred + n_gold - n_hit) ELSE 0.0 END, 6) AS ja FROM m""")
def threshold_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction by threshold on a sigmoid, then precision, recall and Jaccard per case."""
    p = 1 / (1 + F.exp(-10 * F.col("embedding")[0].cast("double")))
    x = table(spark, sf_dir, "embeddings").select("label", (p >= 0.8).alias("predicted"), (F.col("vec_id") % 7 == 0).alias("gold"))
    m = x.groupBy("label").agg(F.count_if("predicted").alias("n_pred"), F.count_if("gold").alias("n_gold"), F.count_if(F.col("predicted") & F.col("gold")).alias("n_hit"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    h, n, g = F.col("n_hit"), F.col("n_pred"), F.col("n_gold")
    return m.select("label", "n_pred", ratio(h, n).alias("precision"), ratio(h, g).alias("recall"), ratio(h, n + g - h).alias("ja"))


@query(f"""WITH {HITS}, on_med AS (SELECT DISTINCT case_id, p_type FROM hit WHERE rank > 5),
x AS (SELECT h.case_id, count(*) AS n FROM hit h JOIN on_med o ON h.case_id = o.case_id AND h.p_type = o.p_type WHERE h.rank <= 5 GROUP BY 1)
SELECT c.case_id, round(coalesce(n, 0) / 5, 6) AS ddi FROM (SELECT DISTINCT case_id FROM hit) c LEFT JOIN x ON c.case_id = x.case_id""")
def ddi_interaction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first five that interact with something the case already takes; divided by five."""
    h = _hits(spark, sf_dir)
    per = h.groupBy("case_id").agg(F.collect_set(F.when(F.col("rank") > 5, F.col("p_type"))).alias("taken"), F.collect_list(F.when(F.col("rank") <= 5, F.col("p_type"))).alias("first"))
    return per.select("case_id", F.round(F.size(F.filter("first", lambda t: F.array_contains("taken", t))) / 5, 6).alias("ddi"))


@query(f"""WITH {HITS}, f AS (SELECT * FROM hit WHERE rank <= 5),
x AS (SELECT a.case_id, count(*) AS pairs, count(*) FILTER (a.p_brand = b.p_brand) AS bad FROM f a JOIN f b ON a.case_id = b.case_id AND a.rank < b.rank GROUP BY 1)
SELECT c.case_id, round(coalesce(bad / pairs, 0.0), 6) AS ddi FROM (SELECT DISTINCT case_id FROM hit) c LEFT JOIN x ON c.case_id = x.case_id""")
def ddi_pairwise_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a case's first-five pairs that are adjacent; the at most five brands of a case are compared inside its row."""
    first = _hits(spark, sf_dir).groupBy("case_id").agg(F.collect_list(F.when(F.col("rank") <= 5, F.col("p_brand"))).alias("b"))
    bad = F.aggregate("b", F.lit(0), lambda s, x: s + F.size(F.filter("b", lambda y: y == x)) - 1)
    n = F.size("b")
    return first.select("case_id", F.round(F.when(n > 1, bad / (n * (n - 1))).otherwise(0.0), 6).alias("ddi"))


@query("""
WITH e AS (SELECT user_id AS model, event_id AS epoch, value FROM events WHERE event_type = 'click'), s AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(value, 2) DESC, epoch) AS n,
 row_number() OVER (PARTITION BY model ORDER BY round(value, 2), epoch) AS m FROM e)
SELECT model, max(epoch) FILTER (n = 1) AS best_epoch, max(epoch) FILTER (m = 1) AS least_loss_epoch FROM s GROUP BY 1""")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first epoch of the highest score, and of the least loss."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("model"), F.col("event_id").alias("epoch"), F.round("value", 2).alias("v"))
    return e.groupBy("model").agg(F.max_by("epoch", F.struct("v", -F.col("epoch"))).alias("best_epoch"), F.min_by("epoch", F.struct("v", "epoch")).alias("least_loss_epoch"))
