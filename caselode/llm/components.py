"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang each node's neighbours (``large``: the larger ones; else the smaller ones and itself) on its least."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(least, "u")
    if large:
        return hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for every node that has an edge.

    ``edges`` has columns u and v of one orderable type.  Each round is written to the shared folder; rounds grow with
    the logarithm of the longest path.
    """
    now = written(edges.select("u", "v").filter("u != v").distinct(), "edges")
    before = None
    while True:
        # The sum of hashes is a fingerprint of the edge set: equal twice running means that nothing moves any more.
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark.n == 0:
            break
        before = mark
        new = written(_star(_star(now, True), False), "edges")
        drop_written(now, now.sparkSession)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
