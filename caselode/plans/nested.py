"""Candidate maps as written in files: order is rank, repeated keys keep their first place and their last value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.operators.nested import distinct_by, ordered_entries
from caselode.plans.registry import query
from caselode.sources.tables import table

LINES = "ln AS (SELECT l_orderkey AS case_id, l_partkey AS d, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, x): an order's lines in order, as (part, supplier)."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))
    return held.select("case_id", F.transform("x", lambda v: F.struct((v["l_partkey"] % 50).alias("d"), v["l_suppkey"].alias("s"))).alias("x"))


@query(f"""WITH {LINES}, k AS (SELECT case_id, d % 50 AS k, min(i) AS first, arg_max(s, i) AS value FROM ln GROUP BY 1, 2)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY first)::INT AS rank, k::VARCHAR AS drug_id, value::VARCHAR AS value FROM k""")
def candidate_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON map of each order's parts by the class of their number, parsed and ranked as it is written."""
    pair = lambda v: F.concat(F.lit('"'), v["d"].cast("string"), F.lit('": "'), v["s"].cast("string"), F.lit('"'))
    written = _lines(spark, sf_dir).select("case_id", F.concat(F.lit("{"), F.array_join(F.transform("x", pair), ", "), F.lit("}")).alias("json"))
    entries = ordered_entries(F.map_entries(F.from_json("json", "map<string,string>")))
    return written.select("case_id", F.inline(entries)).withColumnRenamed("key", "drug_id")


@query(f"WITH {LINES}, f AS (SELECT case_id, d % 50 AS k, min(i) AS first, arg_min(s, i) AS s FROM ln GROUP BY 1, 2) SELECT case_id, string_agg(k || ':' || s, ' ' ORDER BY first) AS firsts FROM f GROUP BY 1")
def distinct_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines, the first of each class of part, in order."""
    once = F.transform(distinct_by("x", "d"), lambda v: F.concat_ws(":", v["d"].cast("string"), v["s"].cast("string")))
    return _lines(spark, sf_dir).select("case_id", F.array_join(once, " ").alias("firsts"))
