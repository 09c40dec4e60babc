"""Forward passes of learned scorers as joins and grouped sums over long-form weights.

Weights are tables or literals that training elsewhere has made; nothing here trains them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.operators.vector_sums import linear, near, neighbour_sums, vector_sums


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def masked_mean(v: Column, m: Column) -> Column:
    return F.sum(v * m) / F.greatest(F.sum(m), F.lit(1.0))


def attention_pool(rows: DataFrame, key: str, score: str, value: str) -> DataFrame:
    """Softmax over a group's ``score``, then the weighted sum of its vectors."""
    return vector_sums(rows, [key], score, value, softmax=True).select(key, F.col("v").alias("pooled"))


def message_pass(edges: DataFrame, nodes: DataFrame, small: bool | None = None, digits: int | None = None) -> DataFrame:
    """One bipartite layer: weighted sums of neighbours' vectors; ``edges`` (dst, src), ``nodes`` (src, v), and w in either."""
    return neighbour_sums(edges, nodes, ["src"], small=small, digits=digits)


def graph_convolution(edges: DataFrame, nodes: DataFrame, weights: dict[int, np.ndarray], digits: int | None = None) -> DataFrame:
    """A relational layer: mean over each relation's neighbours, its matrix, sum over relations, then ReLU.

    ``edges`` (dst, src, rel), ``nodes`` (src, v); ``weights`` has a square matrix per relation.
    """
    # A matrix times a mean is the mean of what the matrix makes of the nodes, of which there are fewer than edges.
    kinds = nodes.withColumn("rel", F.explode(F.array(*[F.lit(r).cast(dict(edges.dtypes)["rel"]) for r in weights])))
    turned = linear(kinds.select("src", "rel", "v"), "v", weights, "rel")
    return neighbour_sums(edges.withColumn("w", F.lit(1.0)), turned, ["src", "rel"], ["rel"], relu=True, small=near(nodes, "v"), digits=digits)
