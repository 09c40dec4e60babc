"""Vector preparation shared by the two vector searches: valid rows, equal vectors as one, shards, merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8
#: A shard's vectors: at most so many, and at most about so many bytes of doubles.
SHARD_ROWS, SHARD_BYTES, LEAST_SHARDS = 4096, 64 << 20, 12
#: Shards go to tasks by hash, over so many times as many tasks, so that few tasks get two.
SPREAD = 4


def shards_for(vectors: DataFrame, vec: str, least: int = LEAST_SHARDS, rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> int:
    """How many shards hold ``vectors``, by rows and by bytes; where they may hold more than ``SHARD_ROWS``, still as many as keep tasks busy."""
    got = vectors.agg(F.count("*").alias("n"), F.sum(F.size(vec).cast("long")).alias("components")).first()
    return max(least, -(-got.n // rows), min(LEAST_SHARDS, -(-got.n // SHARD_ROWS)), -(-8 * (got.components or 0) // size))


def finite(v: str, zero_ok: bool) -> Column:
    """True for a vector without null, NaN or infinite components, of one or more (and, unless ``zero_ok``, with one that isn't 0)."""
    whole = F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole if zero_ok else whole & F.exists(v, lambda x: x != 0), F.lit(False))


def collapsed(vectors: DataFrame, id_: str, vec: str, keep: int) -> DataFrame:
    """One row per different vector with its ``keep`` smallest ids, ascending.

    A result of k rows needs at most k + 1 ids of equal vectors (one may be the query's own), so with ``keep`` of k + 1
    nothing is lost.  Repeated rows count once, before any cut.  A hot vector's rows are cut to ``keep`` within salted
    parts first.
    """
    salted = vectors.dropDuplicates([id_, vec]).withColumn("_salt", F.pmod(F.xxhash64(id_), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy(vec, "_salt").orderBy(id_))
    first = salted.withColumn("_n", rank).filter(F.col("_n") <= keep).drop("_n", "_salt")
    again = first.withColumn("_n", F.row_number().over(Window.partitionBy(vec).orderBy(id_))).filter(F.col("_n") <= keep)
    return again.groupBy(vec).agg(F.sort_array(F.collect_list(id_)).alias("ids"))


def top_k(found: DataFrame, query: str, id_: str, k: int) -> DataFrame:
    """The k rows of highest ``score`` for each query, ties to the smaller id, with ``rank`` from 1."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(id_))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
