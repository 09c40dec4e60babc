"""The case report of an experiment's runs: variants by cuts over all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.operators.reports import HEAD, case_report, selected_records
from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.generation import validation_errors
from caselode.plans.registry import query
from caselode.sources.tables import table

CUTS = (1, 2, 5)
VARIANTS = ("retrieval_direct", "tracedr_rerank")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each run and order: candidates by rank, or by falling rank for the second variant, cut; the first two
    are selected, odd orders explain them in reverse, orders divisible by 7 failed."""
    held = ranked_items(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("drug_id").cast("string").alias("d")))).alias("x"))
    grid = F.explode(F.array(*[F.struct(F.lit(i * len(CUTS) + j).alias("run"), F.lit(v).alias("variant"), F.lit(k).alias("top_k")) for i, v in enumerate(VARIANTS) for j, k in enumerate(CUTS)]))
    rows = held.select("case_id", F.transform("x", lambda v: v["d"]).alias("ids"), grid.alias("g")).select("case_id", "ids", "g.*")
    rows = rows.withColumn("visible", F.slice(F.when(F.col("variant") == VARIANTS[0], F.col("ids")).otherwise(F.reverse("ids")), F.lit(1), F.col("top_k"))).withColumn("selected", F.slice("visible", 1, 2))
    rows = rows.withColumn("explained", F.when(F.col("case_id") % 2 == 1, F.reverse("selected")).otherwise(F.col("selected"))).withColumn("success", F.col("case_id") % 7 != 0)
    item = lambda d: F.struct(d.alias("drugid"), F.array(F.concat(F.lit("retrieval::"), d, F.lit("::treat"))).alias("evidence_ids"), F.concat(F.lit("treats "), d).alias("reason"))
    return rows.select("run", "variant", "top_k", F.col("case_id").alias("seq"), F.col("case_id").cast("string").alias("patient_id"), "success", validation_errors(F.col("success"), "selected", "explained", "visible").alias("errors"), "selected", F.transform("explained", item).alias("items"))


def report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patients; pending ones have no case."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_set("p_brand")).alias("diagnosis"), F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda s: s.cast("string")).alias("symptom"),
        F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("p_name")))).alias("on_medicine"), F.collect_set(F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string"))).alias("gold"),
    )
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").join(held, "o_orderkey")
    return orders.select(F.col("o_orderkey").cast("string").alias("patient_id"), (F.col("o_custkey") % 90).alias("age"), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M").alias("gender"), "diagnosis", "symptom", "on_medicine", "gold")


@query(f"""WITH {RANKED}, gd AS (SELECT * FROM (VALUES {', '.join(f"({i * len(CUTS) + j}, '{v}', {k})" for i, v in enumerate(VARIANTS) for j, k in enumerate(CUTS))}) g(run, variant, top_k)),
vi AS (SELECT run, variant, top_k, case_id, (CASE WHEN variant = '{VARIANTS[0]}' THEN list(drug_id ORDER BY rank) ELSE list(drug_id ORDER BY rank DESC) END)[1:top_k] AS v FROM rk, gd GROUP BY 1, 2, 3, 4),
se AS (SELECT *, v[1:2] AS s, CASE WHEN case_id % 2 = 1 THEN list_reverse(v[1:2]) ELSE v[1:2] END AS e FROM vi),
li AS (SELECT l_orderkey, list(DISTINCT p_brand ORDER BY p_brand) AS d, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS y, list(DISTINCT p_name ORDER BY p_name) FILTER (l_returnflag = 'R') AS m, list(DISTINCT l_partkey) FILTER (l_partkey % 3 = 0) AS g FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
ok AS (SELECT se.*, o_custkey % 90 AS age, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, d, y, coalesce(m, []) AS m, list_filter(s, lambda x: list_contains(coalesce(g, []), x)) AS h FROM se JOIN orders ON o_orderkey = case_id AND o_orderstatus <> 'P' JOIN li ON l_orderkey = case_id WHERE case_id % 7 <> 0 AND s = e ORDER BY run, case_id LIMIT 6),
n AS (SELECT *, row_number() OVER (ORDER BY run, case_id) AS p FROM ok),
t AS (SELECT p, list_concat(['## 案例 ' || p, '- 实验组：`' || variant || '` / `top' || top_k || '`', '- patient_id：`' || case_id || '`',
 '- 患者摘要：' || age || ' 岁，' || gender || '；诊断=' || array_to_string(d, ', ') || '；症状=' || array_to_string(y, ', ') || '；当前用药=' || CASE WHEN len(m) > 0 THEN array_to_string(m, ', ') ELSE 'None' END,
 '- 预测药物：' || array_to_string(s, ', '), '- 命中 gold：' || CASE WHEN len(h) > 0 THEN array_to_string(h, ', ') ELSE 'None' END],
 list_concat(list_transform(e, lambda x, i: '- 解释 ' || i || '：drugid=' || x || '；证据=retrieval::' || x || '::treat；理由=treats ' || x), [''])) AS l FROM n),
u AS (SELECT list_concat([{', '.join(f"'{x}'" for x in HEAD)}], flatten(list(l ORDER BY p))) AS l FROM t)
SELECT (generate_subscripts(l, 1) - 1)::INT AS place, unnest(l) AS line FROM u""")
def case_analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines over the first six clean answers."""
    return case_report(selected_records(runs(spark, sf_dir), report_cases(spark, sf_dir)))
