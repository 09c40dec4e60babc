"""Case records: candidate lists, gold ids, lenient import."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.plans.registry import query
from caselode.sources.tables import case_items, last_by_key, table

ITEMS = "ci AS (SELECT l_orderkey AS case_id, l_partkey AS drug_id, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2)"
RANKED = ITEMS + ", rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY first_line, drug_id) AS rank FROM ci)"


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a case numbered from 1 in their order."""
    return case_items(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("first_line", "drug_id")))


@query(f"WITH {RANKED} SELECT case_id, drug_id, rank FROM rk")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_items(spark, sf_dir).select("case_id", "drug_id", "rank")


@query(f"WITH {RANKED} SELECT case_id, drug_id, rank, p_name AS name, p_brand AS maker, p_type AS treat FROM rk JOIN part ON drug_id = p_partkey")
def candidate_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their catalogue details; unknown ids are left out."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("maker"), F.col("p_type").alias("treat"))
    return ranked_items(spark, sf_dir).join(parts, "drug_id").select("case_id", "drug_id", "rank", "name", "maker", "treat")


@query(f"WITH {ITEMS} SELECT case_id, array_to_string(list(drug_id ORDER BY first_line, drug_id), ',') AS gold_ids, count(*) AS n_gold FROM ci GROUP BY 1")
def gold_ids_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered-distinct gold ids of each case."""
    held = case_items(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "drug_id"))).alias("x"))
    return held.select("case_id", F.array_join(F.transform("x", lambda v: v["drug_id"].cast("string")), ",").alias("gold_ids"), F.size("x").cast("long").alias("n_gold"))


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' None ' WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 5 = 2 THEN NULL ELSE ' ' || c_custkey END AS raw FROM customer)
SELECT c_custkey, CASE WHEN lower(trim(raw)) IN ('', 'none') THEN NULL ELSE try_cast(trim(raw) AS BIGINT) END AS id FROM x""")
def lenient_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case when c_custkey % 5 = 0 then ' None ' when c_custkey % 5 = 1 then '' when c_custkey % 5 = 2 then null else concat(' ', c_custkey) end")
    return table(spark, sf_dir, "customer").select("c_custkey", T.lenient_int(raw).alias("id"))


@query("""
WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_suppkey::VARCHAR END AS id FROM supplier)
SELECT id, row_number() OVER (ORDER BY CASE WHEN regexp_matches(id, '^[0-9]+$') THEN id::DECIMAL(38,0) ELSE 1000000000000000000 END, id) AS place FROM x""")
def import_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric ids by value, the others after them by text.  Places come from one range sort and its partition sizes."""
    ids = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.col("s_suppkey").cast("string")).alias("id"))
    key = F.when(F.col("id").rlike("^[0-9]+$"), F.col("id").cast("decimal(38,0)")).otherwise(F.lit(10**18).cast("decimal(38,0)"))
    return numbered(ids.withColumn("_k", key), ["_k", "id"], "place").drop("_k")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 over the whole table's order, without gathering it in one task.

    A range sort gives ordered partitions; their row counts, one per partition, give each partition's first number.  The
    dealt rows are kept on disk, so that counts and numbers see the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    dealt = dealt.withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)).persist(StorageLevel.DISK_ONLY)
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_before"))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_m", "_i", "_before")


@query("""
WITH x AS (SELECT conv_id, turn, role, length(text) AS chars FROM conversations)
SELECT conv_id, arg_max(role, turn) AS role, arg_max(chars, turn) AS chars FROM x GROUP BY 1""")
def ranked_case_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed scan in which the last row of a key wins."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    return last_by_key(rows, "conv_id", "turn").select("conv_id", "role", "chars")


@query(f"""
WITH {RANKED}, ev AS (SELECT case_id, drug_id, rank, unnest(['treat', 'caution', 'ingredient', 'interaction']) AS field FROM rk WHERE rank <= 3)
SELECT case_id, drug_id, rank, 'retrieval::' || drug_id || '::' || field AS evidence_id,
  CASE field WHEN 'treat' THEN p_type WHEN 'caution' THEN 'None' WHEN 'ingredient' THEN p_brand ELSE p_name END AS text
FROM ev JOIN part ON drug_id = p_partkey""")
def rag_case_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four field evidences of each of a case's first three candidates."""
    kept = ranked_items(spark, sf_dir).filter("rank <= 3").join(table(spark, sf_dir, "part"), F.col("drug_id") == F.col("p_partkey"))
    fields = {"treat": F.col("p_type"), "caution": F.lit("None"), "ingredient": F.col("p_brand"), "interaction": F.col("p_name")}
    evidence = F.array(*[F.struct(F.concat(F.lit("retrieval::"), F.col("drug_id"), F.lit(f"::{k}")).alias("evidence_id"), v.alias("text")) for k, v in fields.items()])
    return kept.select("case_id", "drug_id", "rank", F.inline(evidence))


@query("""
WITH x AS (SELECT s_suppkey, [' ' || s_name || ' ', '', NULL, n_name, n_name] AS items FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, array_to_string(list_filter(list_transform(items, lambda v: trim(v)), lambda v: v <> ''), ' ') AS query_text FROM x""")
def filter_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped items that aren't blank, joined as a query text."""
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    items = F.array(F.concat(F.lit(" "), "s_name", F.lit(" ")), F.lit(""), F.lit(None).cast("string"), "n_name", "n_name")
    return named.select("s_suppkey", F.array_join(T.filled(items), " ").alias("query_text"))
