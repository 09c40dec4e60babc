"""Ranking metrics per case over (gold, ranked) arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions.text import divide


def at_k(gold: str, ranked: str, k: int) -> dict[str, Column]:
    """hit, recall, precision (over the returned length), F1, Jaccard, P@1 and MRR of the first k."""
    g, r = F.array_distinct(gold), F.slice(F.col(ranked), 1, k)
    common = F.size(F.array_intersect(r, g))
    p, rec = divide(common, F.size(r)), divide(common, F.size(g))
    first = F.array_min(F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(g, x), i + 1)), lambda x: x.isNotNull()))
    return {
        "hit": F.when(common > 0, 1.0).otherwise(0.0),
        "recall": rec,
        "precision": p,
        "f1": divide(2 * p * rec, p + rec),
        "jaccard": divide(common, F.size(F.array_union(r, g))),
        "p1": F.when(F.coalesce(F.array_contains(g, F.try_element_at(r, F.lit(1))), F.lit(False)), 1.0).otherwise(0.0),
        "mrr": F.coalesce(1.0 / first, F.lit(0.0)),
    }


def average_precision(ranked: DataFrame, case: str = "case_id", rank: str = "rank", hit: str = "hit") -> DataFrame:
    """Sum of precision at each hit over the number of hits; ``ranked`` has ``n_gold``."""
    seen = F.sum(hit).over(Window.partitionBy(case).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_seen", seen).groupBy(case).agg(F.round(F.coalesce(F.sum(F.when((F.col(hit) == 1) & (F.col("_seen") <= F.col("n_gold")), F.col("_seen") / F.col(rank))) / F.max("n_gold"), F.lit(0.0)), 6).alias("average_precision"))


def mean_or_zero(c: str) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
