"""The encoded export: vocabularies, rows of indexes and edges, written once with counts and read back if still current."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.plans.cases import numbered
from caselode.plans.registry import query
from caselode.sources.artifacts import load_export, write_export
from caselode.sources.stages import shared_dir, written
from caselode.sources.tables import table


def encoded_parts(lineitem: DataFrame) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    """Sorted vocabularies of suppliers and parts from 1, each order's indexes, and the edges between the two."""
    held = lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("symptom"), F.col("l_partkey").alias("drug"))
    words = {k: written(numbered(held.select(F.col(k).alias("word")).distinct(), ["word"], "idx"), f"vocabulary-{k}") for k in ("symptom", "drug")}
    coded = held
    for k, w in words.items():
        coded = coded.join(w.select(F.col("word").alias(k), F.col("idx").alias(f"{k}_idx")), k)
    pairs = written(coded.select("case_id", F.col("symptom_idx").alias("i"), F.col("drug_idx").alias("j")), "coded")
    rows = pairs.groupBy("case_id").agg(F.sort_array(F.collect_set("i")).alias("symptoms"), F.sort_array(F.collect_set("j")).alias("drugs"))
    listed = {k: (w, {"items": F.count("word"), "most": F.max("idx")}) for k, w in words.items()}
    return listed | {
        "rows": (rows, {"items": F.sum(F.size("symptoms") + F.size("drugs")), "most": F.max(F.size("drugs")).cast("long")}),
        "edges": (pairs.select("i", "j").distinct(), {"items": F.sum("i"), "most": F.max("j")}),
    }


@query("""WITH s AS (SELECT l_suppkey AS w, row_number() OVER (ORDER BY l_suppkey) AS i FROM (SELECT DISTINCT l_suppkey FROM lineitem)), d AS (SELECT l_partkey AS w, row_number() OVER (ORDER BY l_partkey) AS j FROM (SELECT DISTINCT l_partkey FROM lineitem)),
r AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b FROM lineitem GROUP BY 1), e AS (SELECT DISTINCT i, j FROM lineitem JOIN s ON s.w = l_suppkey JOIN d ON d.w = l_partkey)
SELECT 'symptom' AS part, count(*) AS rows, count(*) AS items, max(i) AS most, count(*) AS read FROM s UNION ALL SELECT 'drug', count(*), count(*), max(j), count(*) FROM d
UNION ALL SELECT 'rows', count(*), sum(a + b)::BIGINT, max(b), count(*) FROM r UNION ALL SELECT 'edges', count(*), sum(i)::BIGINT, max(j), count(*) FROM e""")
def encoded_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the export's manifest counted while it was written, beside the rows that are read back."""
    lineitem = table(spark, sf_dir, "lineitem")
    path = f"{shared_dir(spark)}/caselode/export-{uuid.uuid4().hex}"
    manifest = write_export(encoded_parts(lineitem), {"lineitem": lineitem}, path)
    counted = spark.createDataFrame([(n, c["rows"], c["items"], c["most"]) for n, c in manifest["parts"].items()], "part string, rows long, items long, most long")
    read = None
    for name, rows in load_export(spark, path, {"lineitem": lineitem}).items():
        part = rows.agg(F.count("*").alias("read")).select(F.lit(name).alias("part"), "read")
        read = part if read is None else read.unionByName(part)
    return counted.join(read, "part")
