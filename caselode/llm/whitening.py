"""Embedding whitening in two passes over integer vectors (operator 12).

Entries become integers, so that the first pass adds them exactly: sums and counts are whole numbers of any size, and the
mean is their quotient.  The second pass takes n * x - S, which is exact, as the centred vector (times n), and sums outer
products by matrix multiplication, block by block; treeAggregate merges the blocks' matrices.  The driver, which holds
one matrix of d x d, finds eigenvectors by LAPACK's symmetric solver and broadcasts the projection.

Defined results: vectors that are null or hold null, NaN or infinite entries take no part; repeated rows each get a
result, but the fit counts each distinct integer vector once; a null id is kept; vectors of another length are fitted
and whitened apart, by their own length's rows; an empty vector has no components and gives no rows; a direction
without variance (rank deficits, a single vector) is whitened to 0 and left out of the identity error; entries past
2^52 are held to it; a deviation past 64 bits is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written

#: Entries of a fit's integer vectors lie within this, far inside what doubles hold exactly.
LIMIT = 1 << 52
#: Most bytes of covariance matrices that the driver holds, over all lengths of vectors.
MATRIX_BYTES = 1 << 30
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """What is fitted for vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray = field(repr=False)  # eigenvalues, falling
    vectors: np.ndarray = field(repr=False)  # d x d, a column for each component
    trace: float = 0.0

    def scales(self, components: int) -> np.ndarray:
        """One over the square root of each eigenvalue; 0 for directions without variance."""
        e = self.values[:components]
        least = max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps
        return np.where(e > least, 1 / np.sqrt(np.where(e > least, e, 1)), 0.0)


def integers(vec: str, factor: int = 64, shift: int = 1_000_000) -> Column:
    """floor(factor * c) + shift for each entry c, as long."""
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * factor).cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return F.transform(vec, lambda c: held(c).cast("long") + F.lit(shift))


def finite(vec: str) -> Column:
    return F.coalesce(F.col(vec).isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def matrices(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The column's vectors by length: (row numbers, matrix)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths := column.value_lengths().to_numpy(zero_copy_only=False))
    return {int(d): (rows := np.flatnonzero(lengths == d), flat[(ends[rows] - d)[:, None] + np.arange(d)]) for d in np.unique(lengths) if d}


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of longs in whole numbers: halves of 32 bits can't overflow in a block."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they hold it, else Python's integers."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums))
    return x * n - np.array(sums, np.int64) if most <= LONG else x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled(x, n, sums).astype(np.float64) / n


def _tree(parts: DataFrame, merge, zero, depth: int = 3):
    """treeAggregate over the one row that each partition made."""
    return parts.rdd.treeAggregate(zero, merge, merge, depth)


def _partials(fit_list: DataFrame, one, kinds: str):
    """A row per partition and length; ``one(state, d, x)`` adds a block to the length's state and gives the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for d, (_, x) in matrices(batch.column(0)).items():
                state[d] = one(state.get(d), d, x)
        for d, (n, numbers) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([numbers], pa.binary())], names=["d", "n", "numbers"])

    return fit_list.select("x").mapInArrow(run, kinds)


PARTIAL = "d long, n long, numbers binary"


def _sums_of(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """First pass: per length, how many vectors and their exact sums."""

    def one(state, d, x):
        old = [int(s) for s in state[1].split(b",")] if state else [0] * d
        return (state[0] if state else 0) + len(x), b",".join(str(a + b).encode() for a, b in zip(old, exact_sums(x), strict=True))

    def merge(total, row):
        for d, n, sums in [(row.d, row.n, [int(s) for s in bytes(row.numbers).split(b",")])] if hasattr(row, "numbers") else [(d, *v) for d, v in row.items()]:
            m, old = total.get(d, (0, [0] * d))
            total[d] = (m + n, [a + b for a, b in zip(old, sums, strict=True)])
        return total

    return _tree(_partials(fit_list, one, PARTIAL), merge, {})


def _products_of(fit_list: DataFrame, block, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of outer products of what ``block(d, x)`` makes of each block of vectors, by length."""

    def one(state, d, x):
        c = block(d, x)
        made = c.T @ c
        if state:
            made += np.frombuffer(state[1]).reshape(made.shape)
        return (state[0] if state else 0) + len(x), made.tobytes()

    def merge(total, row):
        for d, a in [(row.d, np.frombuffer(bytes(row.numbers)).reshape(sizes[row.d], -1))] if hasattr(row, "numbers") else row.items():
            total[d] = total[d] + a if d in total else a
        return total

    return _tree(_partials(fit_list, one, PARTIAL), merge, {})


def fit(fit_list: DataFrame) -> dict[int, Whitening]:
    """Both passes over the column ``x`` of distinct long vectors; one fit for each length of vectors."""
    sums = _sums_of(fit_list)
    if (held := sum(8 * d * d for d in sums)) > MATRIX_BYTES:
        raise ValueError(f"covariances of {held} bytes; MATRIX_BYTES allows {MATRIX_BYTES}")
    products = _products_of(fit_list, lambda d, x: centred(x, *sums[d]), {d: d for d in sums})
    found = {}
    for d, (n, s) in sums.items():
        v = products[d] / n
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        found[d] = Whitening(n, s, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(v)))
    return found


def identity_errors(fit_list: DataFrame, fits: dict[int, Whitening], components: int) -> dict[int, float]:
    """Third pass, a check: the whitened fit list's covariance against the identity, over directions with variance."""
    ready = {d: (w.n, w.sums, w.vectors[:, :components] * w.scales(components)) for d, w in fits.items()}

    def block(d: int, x: np.ndarray) -> np.ndarray:
        n, sums, projection = ready[d]
        return centred(x, n, sums) @ projection

    products = _products_of(fit_list, block, {d: min(d, components) for d in fits})
    return {d: float(np.abs(products[d] / w.n - np.diag((w.scales(components) > 0).astype(float))).max(initial=0)) for d, w in fits.items()}


def project(rows: DataFrame, fits: dict[int, Whitening], components: int) -> DataFrame:
    """(id, x) to (id, d, deviation, whitened array<double>): the projection is broadcast."""
    ready = rows.sparkSession.sparkContext.broadcast({d: (w.n, w.sums, w.vectors[:, :components] * w.scales(components)) for d, w in fits.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (at, x) in matrices(batch.column(1)).items():
                n, sums, projection = ready.value[d]
                y = scaled(x, n, sums)
                small = y.dtype != object and math.isqrt(LONG // d) > int(np.abs(y).max(initial=0))
                squares = (y * y).sum(1).tolist() if small else [s if (s := sum(int(v) ** 2 for v in row)) <= LONG else None for row in y]
                white = (y.astype(np.float64) / n) @ projection
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), d)), pa.array(squares, pa.int64()), lists], names=["id", "d", "deviation", "whitened"])

    return rows.select(F.col("id").cast("long"), "x").mapInArrow(run, "id long, d long, deviation long, whitened array<double>")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, 16 components, on integers floor(64 c) + 1,000,000."""
    rows = table(spark, sf_dir, "embeddings").filter(finite("embedding")).select(F.col("vec_id").alias("id"), integers("embedding").alias("x"))
    fit_list = written(rows.select("x").distinct(), "whitening")
    fits = fit(fit_list)
    errors = identity_errors(fit_list, fits, 16)
    made = [(d, i + 1, w.n, float(w.values[i] / w.trace) if w.trace > 0 else 0.0, errors[d]) for d, w in fits.items() for i in range(min(16, d))]
    facts = spark.createDataFrame(made, "d long, component int, n long, explained double, identity_error double")
    each = project(rows, fits, 16).select("id", "d", "deviation", F.posexplode("whitened").alias("_at", "whitened")).withColumn("component", F.col("_at") + 1)
    # A row for each length and component: MATRIX_BYTES bounds how many lengths there are.
    return each.join(F.broadcast(facts), ["d", "component"]).select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
