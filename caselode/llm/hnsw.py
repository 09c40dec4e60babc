"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard (operator 9).

Vectors are dealt to shards by hash; each shard's task builds its graph and stores it as flat neighbour arrays, one
index row per shard.  Queries stream past every shard's graph in blocks and the shards' results are merged.  Inner
product is searched as nearness of vectors padded to one length, which turns largest product into smallest distance.
All steps run for a block of queries at once, so that the work inside is array arithmetic.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; equal vectors are one
node with its smallest ids; vectors meet only vectors of their own dimension; repeated rows with one id count once; an id
of several vectors is a candidate with each of them and asks with the smallest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written
from caselode.llm.vectors import SPREAD, collapsed, finite, shards_for, top_k

INDEX = "shard string, dim int, nodes long, vectors binary, ids array<array<long>>, levels array<struct<members:binary,neighbours:binary,width:int>>"


def _sims(padded: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.matmul(padded[ids], queries[:, :, None])[:, :, 0]


def beam(padded: np.ndarray, flat: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` most similar nodes found from ``entry`` (a column of start nodes per query), -1 where fewer."""
    b, n = len(queries), len(flat)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no neighbour"
    ids = np.full((b, ef), n)
    sims = np.full((b, ef), -np.inf, np.float32)
    start = entry[:, :ef]
    ids[:, : start.shape[1]] = start
    dup = np.zeros(start.shape, bool)
    order = np.argsort(start, axis=1, kind="stable")
    ordered = np.take_along_axis(start, order, 1)
    np.put_along_axis(dup, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    ids[:, : start.shape[1]][dup] = n
    got = _sims(padded, queries, np.minimum(ids[:, : start.shape[1]], n - 1))
    got[ids[:, : start.shape[1]] == n] = -np.inf
    sims[:, : start.shape[1]] = got
    seen[rows, ids] = True
    done = ids == n
    active = np.arange(b)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        pick = np.argpartition(-open_, min(expand, ef) - 1, axis=1)[:, :expand]
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        keep = live.any(1)
        active, pick, live = active[keep], pick[keep], live[keep]
        if not len(active):
            break
        r = np.arange(len(active))[:, None]
        done[active[:, None], pick] = True
        at = np.where(live, ids[active[:, None], pick], n)
        near = np.where(at[:, :, None] < n, flat[np.minimum(at, n - 1)], n).reshape(len(active), -1)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        seen[active[:, None], near] = True
        near.sort(axis=1)
        near = near[:, : max(1, int((near < n).sum(1).max()))]
        s = _sims(padded, queries[active], np.minimum(near, n - 1))
        s[near == n] = -np.inf
        all_ids = np.concatenate([ids[active], near], 1)
        all_sims = np.concatenate([sims[active], s], 1)
        all_done = np.concatenate([done[active], near == n], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active], sims[active], done[active] = all_ids[r, top], all_sims[r, top], all_done[r, top]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = ids[rows, order], sims[rows, order]
    return np.where(sims > -np.inf, ids, -1), sims


def diverse(padded: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates by falling similarity, those nearer to the node than to any chosen one; then the best of the rest."""
    b, c = ids.shape
    v = padded[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    worst = np.full((b, c), -np.inf, np.float32)  # largest similarity to a chosen one
    for j in range(c):
        ok = (ids[:, j] >= 0) & (worst[:, j] < sims[:, j]) & (chosen.sum(1) < width)
        chosen[:, j] = ok
        worst = np.where(ok[:, None], np.maximum(worst, between[:, j]), worst)
    key = np.where(ids < 0, 2, np.where(chosen, 0, 1)) * c + np.arange(c)
    order = np.argsort(key, axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1).astype(np.int32)


def build_level(padded: np.ndarray, width: int, ef: int, entry_of, batch: int = 512) -> np.ndarray:
    """Neighbours of all nodes of one level, inserted batch by batch."""
    n = len(padded)
    flat = np.full((n, width), -1, np.int32)
    made = 0
    while made < n:
        take = np.arange(made, min(n, made + min(batch, max(64, made))))
        q = padded[take]
        cross = q @ q.T
        np.fill_diagonal(cross, -np.inf)
        c = min(ef, len(take))
        part = np.argpartition(-cross, c - 1, axis=1)[:, :c]
        ids, sims = take[part], np.take_along_axis(cross, part, 1)
        ids = np.where(sims > -np.inf, ids, -1)
        if made:
            found, s = beam(padded[:made], flat[:made], q, entry_of(q, made), ef)
            ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, s], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        flat[take] = diverse(padded, ids, sims, width)
        # Back links: each target's old and new neighbours compete again.
        src, dst = np.repeat(take, width), flat[take].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", padded[src], padded[dst]), dst))
        src, dst = src[order], dst[order]
        targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, counts)
        new = np.full((len(targets), width), -1)
        fits = place < width
        new[np.repeat(np.arange(len(targets)), counts)[fits], place[fits]] = src[fits]
        both = np.concatenate([flat[targets], new], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        s = np.where(both >= 0, _sims(padded, padded[targets], np.maximum(both, 0)), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        flat[targets] = diverse(padded, np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1), width)
        made = int(take[-1]) + 1
    return flat


class Graph:
    """Levels from the highest: (members as positions in the shard, flat neighbours as positions in the level)."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]] | None = None):
        norms = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        self.padded = np.concatenate([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], 1).astype(np.float32)
        self.levels = levels or []

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = 16, ef: int = 64, seed: int = 7) -> Graph:
        self, n = cls(vectors), len(vectors)
        height = (-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        for level in range(int(height.max(initial=0)), -1, -1):
            members = np.flatnonzero(height >= level)
            # A level's own order starts with the members of the level above, so those are always there to enter by.
            members = members[np.argsort(-height[members], kind="stable")]
            above = len(self.levels[-1][0]) if self.levels else 0

            def entry(q: np.ndarray, made: int, above: int = above) -> np.ndarray:
                if above and made >= above:
                    return np.maximum(self.descend(q, 2), 0)
                return np.zeros((len(q), 1), int)

            flat = build_level(self.padded[members], 2 * m if level == 0 else m, ef, entry)
            self.levels.append((members, flat))
        return self

    def descend(self, q: np.ndarray, keep: int) -> np.ndarray:
        """Positions in the lowest level made so far + 1: members of the level above come first there."""
        at = np.zeros((len(q), 1), int)
        for members, flat in self.levels:
            found, _ = beam(self.padded[members], flat, q, at, 8, 2)
            at = np.where(found[:, :keep] >= 0, found[:, :keep], 0)
        return at

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        q = np.pad(queries.astype(np.float32), ((0, 0), (0, 1)))
        at = np.zeros((len(q), 1), int)
        for members, flat in self.levels[:-1]:
            found, _ = beam(self.padded[members], flat, q, at, 8, 2)
            at = np.where(found[:, :2] >= 0, found[:, :2], 0)
        members, flat = self.levels[-1]
        found, _ = beam(self.padded[members], flat, q, at, max(ef, k))
        return np.where(found[:, :k] >= 0, members[np.maximum(found[:, :k], 0)], -1)


def build_index(vectors: DataFrame, shards: int, k: int, m: int = 16, ef_build: int = 96) -> DataFrame:
    """The stored index of (id, vec), a row per shard, written to the shared folder."""
    nodes = collapsed(vectors.select("id", "vec").filter(finite("vec", False)), "id", "vec", k + 1)
    placed = nodes.withColumn("shard", F.concat_ws("-", F.size("vec"), F.pmod(F.xxhash64("vec"), F.lit(shards))))

    def run(key, batch):  # without type hints: Spark would take them for its own
        flat = batch.column("vec").combine_chunks()
        n = len(flat)
        vectors64 = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        g = Graph.build(vectors64.astype(np.float32), m, ef_build)
        levels = [{"members": a.astype(np.int32).tobytes(), "neighbours": f.tobytes(), "width": f.shape[1]} for a, f in g.levels]
        schema = pa.schema([("shard", pa.string()), ("dim", pa.int32()), ("nodes", pa.int64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("levels", pa.list_(pa.struct([("members", pa.binary()), ("neighbours", pa.binary()), ("width", pa.int32())])))])
        return pa.Table.from_pylist([{"shard": key[0].as_py(), "dim": vectors64.shape[1], "nodes": n, "vectors": vectors64.tobytes(), "ids": batch.column("ids").to_pylist(), "levels": levels}], schema=schema)

    return written(placed.repartition(SPREAD * shards, "shard").groupBy("shard").applyInArrow(run, INDEX), "hnsw")


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = 192, block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each (id, vec) query's k nearest, its own id left out."""
    shards = index.select("shard", "dim")
    valid = queries.select("id", "vec").filter(finite("vec", False)).groupBy("id").agg(F.min("vec").alias("vec"))
    # Each query goes to each shard of its dimension: the stated query set against all rows.
    visits = valid.join(F.broadcast(shards), F.size("vec") == F.col("dim")).select("shard", "id", F.col("vec").cast("array<double>").alias("vec"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("nodes", "long"), ("vectors", "binary"), ("ids", "array<array<long>>"), ("levels", index.schema["levels"].dataType))]
    stream = index.select("shard", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vec"), "nodes", "vectors", "ids", "levels").unionByName(visits.select("shard", "id", "vec", *empty))
    count = SPREAD * max(1, index.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = vectors = ids = None

        def answer(qids: list[int], q: np.ndarray) -> pa.RecordBatch:
            out_q, out_v, out_s = [], [], []
            for at in range(0, len(qids), block):
                part = q[at : at + block]
                found = graph.search(part, k + 1, ef)
                scores = np.einsum("bkd,bd->bk", vectors[np.maximum(found, 0)], part)
                for qid, f, s in zip(qids[at : at + block], found, scores, strict=True):
                    hits = sorted((-float(x), i) for x, node in zip(s, f, strict=True) if node >= 0 for i in ids[node] if i != qid)[:k]
                    out_q += [qid] * len(hits)
                    out_v += [i for _, i in hits]
                    out_s += [-x for x, _ in hits]
            return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            made = np.array([x is not None for x in batch.column("nodes").to_pylist()])
            cuts = [0, *np.flatnonzero(made).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if made[lo]:
                    row = part.slice(0, 1).to_pylist()[0]
                    vectors = np.frombuffer(row["vectors"]).reshape(row["nodes"], -1)
                    levels = [(np.frombuffer(x["members"], np.int32).astype(int), np.frombuffer(x["neighbours"], np.int32).reshape(-1, x["width"])) for x in row["levels"]]
                    graph, ids = Graph(vectors, levels), row["ids"]
                    part = part.slice(1)
                if part.num_rows:
                    q = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    yield answer(part.column("id").to_pylist(), q)

    near = stream.repartition(count, "shard").sortWithinPartitions("shard", F.col("nodes").asc_nulls_last()).mapInArrow(run, "query_id long, vec_id long, score double")
    return top_k(near, "query_id", "vec_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth vector's 20 nearest."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = build_index(vectors, shards_for(vectors.filter(finite("vec", False)), "vec"), 20)
    return search_index(index, vectors.filter("id % 20 = 0"), 20)
