"""Vocabularies, encoded cases, batches and matrices in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.operators.set_losses import similar_cases
from caselode.plans.cases import RANKED, numbered, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import case_diagnoses, case_symptoms, table

SORTED = "vs AS (SELECT w, row_number() OVER (ORDER BY w) AS idx FROM (SELECT DISTINCT p_brand AS w FROM part))"
SIZES = """sz AS (SELECT l_orderkey AS case_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1),
b AS (SELECT case_id, n, (row_number() OVER (PARTITION BY n ORDER BY case_id) - 1) // 16 AS batch FROM sz)"""


@query(f"WITH {SORTED} SELECT w AS word, idx FROM vs")
def vocab_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words numbered from 1 in their order."""
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word")).distinct()
    return numbered(words, ["word"], "idx")


@query("""
WITH x AS (SELECT 0 AS split, l_orderkey AS seq, l_linenumber AS pos, l_suppkey AS w FROM lineitem WHERE l_orderkey % 10 < 8
UNION ALL SELECT 1, l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey % 10 >= 8),
f AS (SELECT w, min(split * 1000000000000 + seq * 1000 + pos) AS k FROM x GROUP BY 1)
SELECT w AS word, row_number() OVER (ORDER BY k, w) AS idx FROM f""")
def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words numbered as they first occur over the splits, train before test."""
    x = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 10 < 8, 0).otherwise(1).alias("split"), "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("word"))
    first = x.groupBy("word").agg(F.min(F.struct("split", "l_orderkey", "l_linenumber")).alias("k"))
    return numbered(first, ["k", "word"], "idx").drop("k")


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_sorted(spark, sf_dir)


@query(f"WITH {SORTED}, d AS (SELECT DISTINCT l_orderkey AS case_id, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT case_id, array_to_string(list(idx ORDER BY idx), ',') AS ids FROM d JOIN vs ON p_brand = w GROUP BY 1")
def encode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a case as ids."""
    coded = case_diagnoses(spark, sf_dir).join(_vocab(spark, sf_dir), F.col("diagnosis") == F.col("word"))
    return coded.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("idx")).cast("array<string>"), ",").alias("ids"))


@query("WITH d AS (SELECT DISTINCT l_orderkey AS case_id, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT case_id, array_to_string(list(p_brand ORDER BY p_brand), ',') AS words FROM d GROUP BY 1")
def decode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids back to words; with ``encode_cases`` the identity."""
    ids = encode_cases(spark, sf_dir).select("case_id", F.explode(F.split("ids", ",").cast("array<bigint>")).alias("idx"))
    return ids.join(_vocab(spark, sf_dir), "idx").groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("word")), ",").alias("words"))


@query(f"WITH {SORTED}, d AS (SELECT DISTINCT l_orderkey AS case_id, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT case_id, idx - 1 AS col, 1 AS v FROM d JOIN vs ON p_brand = w")
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-hot rows as coordinates, columns from 0."""
    coded = case_diagnoses(spark, sf_dir).join(_vocab(spark, sf_dir), F.col("diagnosis") == F.col("word"))
    return coded.select("case_id", (F.col("idx") - 1).alias("col"), F.lit(1).alias("v"))


def batched(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """(case_id, n, batch): cases of one symptom count in batches of ``size``.

    Places within a bucket come from counts per range of ids, so that a hot bucket isn't ordered in one task.
    """
    sized = case_symptoms(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("n"))
    placed = numbered(sized, ["n", "case_id"], "_place")
    first = placed.groupBy("n").agg(F.min("_place").alias("_first"))  # one row a bucket
    return placed.join(F.broadcast(first), "n").select("case_id", "n", F.floor((F.col("_place") - F.col("_first")) / size).alias("batch"))


def in_batches(sets: DataFrame, size: int = 16) -> DataFrame:
    """(n, batch, m): ``sets`` (case_id, s, ..) in batches as ``batched`` makes them, a batch's cases in one row."""
    placed = numbered(sets.withColumn("n", F.size("s").cast("long")), ["n", "case_id"], "_place")
    first = placed.groupBy("n").agg(F.min("_place").alias("_first"))  # one row a bucket
    dealt = placed.join(F.broadcast(first), "n").withColumn("batch", F.floor((F.col("_place") - F.col("_first")) / size))
    return dealt.groupBy("n", "batch").agg(F.array_sort(F.collect_list(F.struct(*sets.columns))).alias("m"))


@query(f"WITH {SIZES} SELECT case_id, n, batch FROM b")
def size_bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir)


@query(f"""WITH {SIZES}, s AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS w FROM lineitem),
o AS (SELECT x.case_id, y.case_id AS other, x.n, (SELECT count(*) FROM s p JOIN s q ON p.w = q.w WHERE p.case_id = x.case_id AND q.case_id = y.case_id) AS overlap
  FROM b x JOIN b y ON x.n = y.n AND x.batch = y.batch AND x.case_id <> y.case_id),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, other) AS k FROM o)
SELECT b.case_id, CASE WHEN b.n <= 2 THEN b.case_id ELSE coalesce(r.other, b.case_id) END AS similar FROM b LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON b.case_id = r.case_id""")
def batch_similar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch member of most common symptoms, the first on ties; itself where sets have two or fewer."""
    sets = case_symptoms(spark, sf_dir).groupBy("case_id").agg(F.collect_set("symptom").alias("s"))
    return similar_cases(in_batches(sets)).select("case_id", "similar")


@query(f"WITH {RANKED}, s AS (SELECT *, CASE WHEN case_id % 10 < 6 THEN 'train' WHEN case_id % 10 < 8 THEN 'test' ELSE 'eval' END AS split FROM rk) SELECT split, count(DISTINCT case_id) AS cases, count(*) AS items, max(rank) AS longest FROM s GROUP BY 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split sizes; an empty split would fail training."""
    d = F.col("case_id") % 10
    x = ranked_items(spark, sf_dir).withColumn("split", F.when(d < 6, "train").when(d < 8, "test").otherwise("eval"))
    return x.groupBy("split", "case_id").agg(F.count("*").alias("k"), F.max("rank").alias("r")).groupBy("split").agg(F.count("*").alias("cases"), F.sum("k").alias("items"), F.max("r").alias("longest"))
