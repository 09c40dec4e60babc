"""Losses between a case's sets and those of the similar case of its batch: their common part and their difference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.operators.scorers import attention_pool, dot, sigmoid
from caselode.operators.vector_sums import linear, matrix, near, vector_sums
from caselode.sources.shipping import ship

#: Fixed value: weight of the term between sets.
INTERSET = 1e-4
#: Cases whose vectors are in a task's memory at a time.
SLICE = 2048


def similar_cases(batches: DataFrame) -> DataFrame:
    """(n, batch, case_id, similar, mine, its) of batches (n, batch, m), m the cases (case_id, s, ..) of one in order: the
    member of most common ``s``, the first on ties, with both rows; itself where sets have two or fewer.

    A batch is compared inside its row.
    """
    other = lambda x: F.filter("m", lambda y: y["case_id"] != x["case_id"])
    best = lambda x: F.array_min(F.transform(other(x), lambda y: F.struct((-F.size(F.array_intersect(x["s"], y["s"]))).alias("o"), y["case_id"].alias("k"), y.alias("y"))))["y"]
    pick = F.transform("m", lambda x: F.struct(x.alias("mine"), F.when(F.col("n") <= 2, x).otherwise(F.coalesce(best(x), x)).alias("its")))
    return batches.select("n", "batch", F.inline(pick)).select("n", "batch", F.col("mine.case_id").alias("case_id"), F.col("its.case_id").alias("similar"), "mine", "its")


def compared(similar: DataFrame) -> DataFrame:
    """(n, batch, case_id, common, shared, different): common ``s`` of a case and its similar one, ``d`` that both have, ``d`` that one has."""
    mine, its = F.col("mine.d"), F.col("its.d")
    return similar.select("n", "batch", "case_id", F.array_intersect("mine.s", "its.s").alias("common"), F.array_intersect(mine, its).alias("shared"), F.concat(F.array_except(mine, its), F.array_except(its, mine)).alias("different"))


def common_items(near: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(case_id, item) of what a case of ``near`` (case_id, similar) shares with its similar case."""
    other = items.select(F.col("case_id").alias("similar"), item)
    return near.join(items, "case_id").join(other, ["similar", item]).select("case_id", item)


def different_items(near: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(case_id, item) of what one of the two has and the other lacks."""
    mine = near.join(items, "case_id").select("case_id", item)
    its = near.join(items.select(F.col("case_id").alias("similar"), item), "similar").select("case_id", item)
    both = mine.unionByName(its).groupBy("case_id", item).agg(F.count("*").alias("_n"))
    # A case that is its own similar one differs from itself in nothing: each item then comes twice.
    return both.filter("_n = 1").select("case_id", item)


def set_vectors(members: DataFrame, vectors: DataFrame, weights: Column) -> DataFrame:
    """(case_id, v): attention over a case's members (case_id, id) by the tanh of their product with ``weights``, of length one."""
    rows = members.join(vectors, "id").withColumn("a", F.tanh(dot(weights, "v")))
    # The length is a column of its own: inside the lambda it would be worked out for each component.
    pooled = attention_pool(rows, "case_id", "a", "v").withColumn("_length", F.greatest(F.sqrt(dot("pooled", "pooled")), F.lit(1e-12)))
    return pooled.select("case_id", F.expr("transform(pooled, x -> x / _length)").alias("v"))


def with_zeros(cases: DataFrame, found: DataFrame, dims: int) -> DataFrame:
    """A zero vector for cases without members."""
    return cases.join(found, "case_id", "left").withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), dims)))


def augmentation_loss(near: DataFrame, batches: DataFrame, common: DataFrame, common_sets: DataFrame, drugs: list[tuple[int, list[float]]]) -> DataFrame:
    """(n, batch, loss): mean cross-entropy of the common sets' products with all drugs against the common drugs, or 0
    where a batch has none in common.

    ``common`` (case_id, drug), ``common_sets`` (case_id, v); ``drugs`` are the vocabulary's unit vectors.
    """
    place = F.create_map(*[F.lit(x) for i, (d, _) in enumerate(drugs) for x in (d, i + 1)])
    cases = with_zeros(batches.join(near.select("case_id"), "case_id"), common_sets, len(drugs[0][1]))
    logits = linear(cases.withColumn("_k", F.lit(0)), "v", {0: np.array([v for _, v in drugs]).T}, "_k")
    held = common.groupBy("case_id").agg(F.collect_list(place[F.col("drug")]).alias("_at"))
    none = F.array().cast("array<int>")
    rows = logits.join(held, "case_id", "left").withColumn("_at", F.coalesce("_at", none))
    all_ = F.aggregate("v", F.lit(0.0), lambda s, z: s + F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
    right = F.aggregate("_at", F.lit(0.0), lambda s, i: s + F.element_at("v", i))
    mean = F.sum(all_ - right) / (F.count("*") * len(drugs))
    return rows.groupBy("n", "batch").agg(F.when(F.sum(F.size("_at")) > 0, mean).otherwise(0.0).alias("loss"))


def interset_loss(near: DataFrame, batches: DataFrame, different: DataFrame, common_sets: DataFrame, drugs: DataFrame) -> DataFrame:
    """(n, batch, loss): ``INTERSET`` times the mean sigmoid of each common set's product with the mean of the drugs that differ,
    or 0 where none in the batch differ.  ``different`` (case_id, drug), ``drugs`` (drug, v)."""
    summed = vector_sums(different.join(drugs, "drug").withColumn("w", F.lit(1.0)), ["case_id"], "w", "v")
    means = summed.select("case_id", F.transform("v", lambda x: x / F.col("total")).alias("_mean"))
    rows = batches.join(near.select("case_id"), "case_id").join(common_sets, "case_id", "left").join(means, "case_id", "left")
    score = F.coalesce(sigmoid(dot("v", "_mean")), F.lit(0.5))
    return rows.groupBy("n", "batch").agg(F.when(F.count("_mean") > 0, INTERSET * F.avg(score)).otherwise(0.0).alias("loss"))


def _held(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a table (id, v) that is small enough for every executor."""
    whole = vectors.filter("v is not null").select(F.col("id").cast("long"), "v").orderBy("id").toArrow()
    return whole.column("id").to_numpy(), matrix(whole.column("v")).astype(float)


def _sums(column: pa.ListArray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each list of ids the sum of their ``rows``; ids are in order and may repeat, unknown ones count nothing."""
    found = column.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    lo, hi = np.searchsorted(ids, found, "left"), np.searchsorted(ids, found, "right")
    out = np.zeros((len(column), rows.shape[1]))
    times = hi - lo
    owner, at = np.repeat(owner, times), np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    if len(owner):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[heads]] = np.add.reduceat(rows[at], heads)
    return out


def _scored(pairs: DataFrame, vectors: DataFrame, weights: list[float], score: Callable, small: bool | None) -> DataFrame:
    """(n, batch, x, y) of each case of ``compared``: what ``score`` makes of the rows and their common sets' unit vectors.

    Where the vectors can be broadcast, rows go to tasks as lists of ids and no vector is ever sent; else common sets are made by joins.
    """
    ship(pairs.sparkSession)
    small = near(vectors, "v") if small is None else small
    shared = None
    if small:
        ids, v = _held(vectors)
        e = np.exp(np.tanh(v @ np.resize(weights, v.shape[1]))) if len(v) else np.zeros(0)
        shared = pairs.sparkSession.sparkContext.broadcast((ids, np.c_[e[:, None] * v, e]))
        rows = pairs.withColumn("v", F.lit(None).cast("array<double>"))
    else:
        dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
        members = pairs.select("case_id", F.explode("common").alias("id"))
        rows = pairs.join(set_vectors(members, vectors, F.array(*[F.lit(float(x)) for x in np.resize(weights, dims)])), "case_id", "left")

    def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row has a common set, and its vector or zeros."""
        if shared is not None:
            got = _sums(batch.column(2), *shared.value)
            there = got[:, -1] > 0
            mean = got[:, :-1] / np.where(there, got[:, -1], 1)[:, None]
            return there, mean / np.maximum(np.sqrt((mean * mean).sum(1, keepdims=True)), 1e-12)
        there = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        held = matrix(batch.column(5).drop_null())
        out = np.zeros((batch.num_rows, held.shape[1]))
        out[there] = held
        return there, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            x, y = score(batch.column(3), batch.column(4), *units(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.astype(float)), pa.array(y.astype(float))], names=["n", "batch", "x", "y"])

    longs = lambda c: F.col(c).cast("array<long>").alias(c)
    return rows.select(F.col("n").cast("long"), F.col("batch").cast("long"), *map(longs, ("common", "shared", "different")), "v").mapInArrow(run, "n long, batch long, x double, y double")


def _vocabulary(drugs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and unit vectors of the drugs (id, v); the driver holds the vocabulary of medicines."""
    ids, v = _held(drugs)
    return ids, v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def pair_augmentation(pairs: DataFrame, vectors: DataFrame, weights: list[float], drugs: DataFrame, small: bool | None = None) -> DataFrame:
    """``augmentation_loss`` of the rows of ``compared``: common sets by attention over ``vectors`` (id, v) with ``weights``, against ``drugs`` (id, v)."""
    ids, units = _vocabulary(drugs)
    if not len(ids):
        return pairs.select("n", "batch", F.lit(0.0).alias("loss")).limit(0)

    def score(shared: pa.ListArray, _, there: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right, loss = _sums(shared, ids, np.c_[units, np.ones(len(ids))]), np.full(len(there), len(ids) * np.log(2))
        if there.any():
            z = v[there] @ units.T
            loss[there] = (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))).sum(1) - (v[there] * right[there, :-1]).sum(1)
        return loss, right[:, -1]

    found = _scored(pairs, vectors, weights, score, small)
    return found.groupBy("n", "batch").agg(F.when(F.sum("y") > 0, F.sum("x") / (F.count("*") * len(ids))).otherwise(0.0).alias("loss"))


def pair_interset(pairs: DataFrame, vectors: DataFrame, weights: list[float], drugs: DataFrame, small: bool | None = None) -> DataFrame:
    """``interset_loss`` of the rows of ``compared``; see ``pair_augmentation``."""
    ids, units = _vocabulary(drugs)

    def score(_, different: pa.ListArray, there: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, got = np.full(len(there), 0.5), _sums(different, ids, np.c_[units, np.ones(len(ids))])
        both = there & (got[:, -1] > 0)
        if both.any():
            x[both] = 1 / (1 + np.exp(-(v[both] * got[both, :-1]).sum(1) / got[both, -1]))
        return x, got[:, -1] > 0

    found = _scored(pairs, vectors, weights, score, small)
    return found.groupBy("n", "batch").agg(F.when(F.sum("y") > 0, INTERSET * F.avg("x")).otherwise(0.0).alias("loss"))
