"""Model rankings merged into cases, frozen candidate lists, exported ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import table

#: The model's scores: items of retail price over 950, best price first.
SCORED = RANKED + """, mr AS (SELECT case_id, drug_id, round(p_retailprice, 2) AS score, row_number() OVER (PARTITION BY case_id ORDER BY round(p_retailprice, 2) DESC, rank) AS rerank_rank
FROM rk JOIN part ON drug_id = p_partkey WHERE p_retailprice > 950)"""
MERGED = SCORED + """, mg AS (SELECT rk.case_id, rk.drug_id, rk.rank AS retrieval_rank, mr.rerank_rank, mr.score FROM rk LEFT JOIN mr ON rk.case_id = mr.case_id AND rk.drug_id = mr.drug_id),
fz AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(rerank_rank, 1000000000), retrieval_rank) AS place FROM mg)"""


def model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "part").filter("p_retailprice > 950").select(F.col("p_partkey").alias("drug_id"), F.round("p_retailprice", 2).alias("score"))
    scored = ranked_items(spark, sf_dir).join(prices, "drug_id")
    order = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "rank")
    return scored.select("case_id", "drug_id", "score", F.row_number().over(order).alias("rerank_rank"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the model's fields where the model ranked them; others keep what they had."""
    old = ranked_items(spark, sf_dir).select("case_id", "drug_id", F.col("rank").alias("retrieval_rank"))
    return old.join(model_ranks(spark, sf_dir), ["case_id", "drug_id"], "left")


def frozen(candidates: DataFrame, k: int) -> DataFrame:
    """The first k by model rank, then retrieval rank; unranked ones last."""
    order = Window.partitionBy("case_id").orderBy(F.coalesce("rerank_rank", F.lit(10**9)), "retrieval_rank")
    return candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


@query(f"WITH {MERGED} SELECT case_id, drug_id, retrieval_rank, rerank_rank, score FROM mg")
def apply_ranked_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)


@query(f"WITH {MERGED} SELECT case_id, drug_id, place FROM fz WHERE place <= 3")
def freeze_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen(merged(spark, sf_dir), 3).select("case_id", "drug_id", "place")


EVIDENCE = MERGED + """, ev AS (SELECT case_id, 'retrieval::' || drug_id || '::treat' AS evidence_id, retrieval_rank FROM mg),
re AS (SELECT case_id, CASE WHEN drug_id % 2 = 0 THEN 'retrieval::' || drug_id ELSE 'retrieval::' || drug_id || '::treat' END AS evidence_id, rerank_rank FROM mr),
am AS (SELECT ev.case_id, ev.evidence_id, ev.retrieval_rank, re.rerank_rank, CASE WHEN re.rerank_rank IS NULL THEN 'retrieval' ELSE 'rerank' END AS source
  FROM ev LEFT JOIN re ON ev.case_id = re.case_id AND ev.evidence_id = re.evidence_id)"""


def with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidences with the model's rank where the whole id matches; ids without a field match nothing."""
    ev = ranked_items(spark, sf_dir).select("case_id", F.concat(F.lit("retrieval::"), "drug_id", F.lit("::treat")).alias("evidence_id"), F.col("rank").alias("retrieval_rank"))
    id_ = F.when(F.col("drug_id") % 2 == 0, F.concat(F.lit("retrieval::"), "drug_id")).otherwise(F.concat(F.lit("retrieval::"), "drug_id", F.lit("::treat")))
    re = model_ranks(spark, sf_dir).select("case_id", id_.alias("evidence_id"), "rerank_rank")
    return ev.join(re, ["case_id", "evidence_id"], "left").withColumn("source", F.when(F.col("rerank_rank").isNull(), "retrieval").otherwise("rerank"))


@query(f"WITH {EVIDENCE} SELECT case_id, evidence_id, retrieval_rank, rerank_rank, source FROM am")
def apply_ranked_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_evidence(spark, sf_dir)


@query(f"WITH {EVIDENCE}, s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(rerank_rank, 1000000000), retrieval_rank) AS place FROM am) SELECT case_id, evidence_id, place FROM s WHERE place <= 2")
def select_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen(with_evidence(spark, sf_dir), 2).select("case_id", "evidence_id", "place")


def in_order(value: str | Column, place: str = "place") -> Column:
    """The values of a group joined by commas in the order of ``place``."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), v.cast("string").alias("v")))), lambda x: x["v"]), ",")


@query(f"WITH {MERGED} SELECT case_id, array_to_string(list(drug_id ORDER BY place), ',') AS visible FROM fz WHERE place <= 3 GROUP BY 1")
def visible_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen(merged(spark, sf_dir), 3).groupBy("case_id").agg(in_order("drug_id").alias("visible"))


@query(f"""WITH {SCORED}, ci2 AS (SELECT case_id, drug_id, rank FROM rk WHERE rank % 2 = 1),
x AS (SELECT mr.*, c.rank AS retrieval_rank FROM mr JOIN ci2 c ON mr.case_id = c.case_id AND mr.drug_id = c.drug_id)
SELECT case_id, drug_id, retrieval_rank, row_number() OVER (PARTITION BY case_id ORDER BY rerank_rank) AS rank, drug_id % 3 = 0 AS label FROM x""")
def export_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's ranking of candidates only, renumbered, with labels and retrieval ranks."""
    keep = ranked_items(spark, sf_dir).filter("rank % 2 = 1").select("case_id", "drug_id", F.col("rank").alias("retrieval_rank"))
    x = model_ranks(spark, sf_dir).join(keep, ["case_id", "drug_id"])
    return x.select("case_id", "drug_id", "retrieval_rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rerank_rank")).alias("rank"), (F.col("drug_id") % 3 == 0).alias("label"))


@query(f"WITH {RANKED} SELECT rk.case_id, rk.drug_id, rk.rank FROM rk WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = rk.case_id AND l_partkey = rk.drug_id AND l_returnflag = 'R')")
def candidates_not_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates minus what the case already takes."""
    taken = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("drug_id"))
    return ranked_items(spark, sf_dir).select("case_id", "drug_id", "rank").join(taken, ["case_id", "drug_id"], "left_anti")
