"""Exact top-k search by largest integer inner product on an impact-ordered index (operator 10).

Each shard keeps, for every dimension, posting segments of one quantised impact level: the nodes whose value lies in the
level's range.  A query visits segments score-at-a-time, those of the highest possible contribution first.  After
each portion a bound is drawn: in each dimension where a node hasn't been met it can still gain what that dimension's next
segment gives at most.  Nodes that cannot reach the k-th best exact score so far are out; the rest may be members.
Processing stops once few enough are left (``MEMBERS``), or all segments are done; either way the proof has excluded every
other node, and those left are rescored, so results are exact.

Defined results: vectors that are null or hold null or non-finite components take no part; zero vectors do; equal vectors
are one node with its smallest ids; vectors meet only vectors of their own dimension; repeated rows with one id count
once; an id of several vectors is a candidate with each of them and asks with the smallest; components and scores past 64 bits are held to a long's range; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written
from caselode.llm.vectors import SPREAD, collapsed, finite, shards_for, top_k

#: A search ends once at most this share of a shard may be members: rescoring is one product of matrices, whose components cost
#: about a tenth of a visited posting.
MEMBERS = 0.6
#: Nodes of the highest bounds, so many times k, are rescored after each portion for the k-th best score so far.
PROBES = 8
#: Share of the postings before the first bound of a shard's first query is drawn; earlier ones exclude hardly a node.
FIRST = 0.4
#: A bound that leaves too many nodes is drawn again after this share more.  Each bound goes over all postings visited so far, so a
#: query starts nearly where the one before it ended (``EASE`` less), and most draw only one.
STEP, EASE = 0.05, 0.01
#: A shard's vectors: larger shards have higher k-th best scores, and each query is sent to fewer of them.
SHARD_ROWS, SHARD_BYTES = 16384, 16 << 20
INDEX = "shard string, dim int, nodes long, vectors binary, ids array<array<long>>, postings binary, seg_dim binary, seg_start binary, seg_low binary, seg_high binary"


def build_segments(v: np.ndarray, levels: int = 64) -> dict[str, np.ndarray]:
    """Posting segments of an integer matrix: per dimension, nodes by falling value, cut at ``levels`` impact levels."""
    n, d = v.shape
    step = max(1, int(np.abs(v).max(initial=0)) * 2 // levels)
    postings, dims, starts, lows, highs, at = [], [], [], [], [], 0
    for j in range(d):
        order = np.argsort(-v[:, j], kind="stable")
        values = v[order, j]
        level = values // step
        cuts = np.r_[0, np.flatnonzero(level[1:] != level[:-1]) + 1]
        ends = np.r_[cuts[1:], n]
        postings.append(order)
        dims += [j] * len(cuts)
        starts += (at + cuts).tolist()
        highs += values[cuts].tolist()
        lows += values[ends - 1].tolist()
        at += n
    return {"postings": np.concatenate(postings).astype(np.int32), "seg_dim": np.array(dims, np.int64), "seg_start": np.array([*starts, at], np.int64), "seg_low": np.array(lows, np.int64), "seg_high": np.array(highs, np.int64)}


def prepared(v: np.ndarray, seg: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The segments with what every query needs of them, worked out once: lengths, each dimension's first segment, and the vectors as
    floats, whose products are machine matrix products."""
    n, d = v.shape
    values = v.astype(float)
    return seg | {"lengths": np.diff(seg["seg_start"]), "nodes": seg["postings"].astype(np.intp), "values": values, "short": v.astype(np.float32), "first": np.searchsorted(seg["seg_dim"], np.arange(d + 1)), "largest": np.abs(values).max(initial=0)}


def search_segments(v: np.ndarray, seg: dict[str, np.ndarray], q: np.ndarray, k: int, first: float = FIRST) -> tuple[np.ndarray, np.ndarray, float]:
    """(every node whose exact score may be among the k best, its score, share of the postings that were visited).

    ``first`` is the share before the first bound; any gives the same best nodes.
    """
    n, d = v.shape
    seg = seg if "nodes" in seg else prepared(v, seg)
    most = d * float(seg["largest"]) * float(np.abs(q.astype(float)).max(initial=0))
    if n and most >= 2.0**62:
        # Past 64 bits no bound can be drawn in machine numbers: all nodes, in Python's integers, held to a long's range.
        exact = v.astype(object) @ q.astype(object)
        return np.arange(n), np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], object), 1.0
    if n <= k or most >= 2.0**51:  # bounds are sums of doubles of at most three times this, whole numbers up to 2^53
        return np.arange(n), v @ q, 1.0
    dims, lengths, begin, nodes, from_ = seg["seg_dim"], seg["lengths"], seg["seg_start"], seg["nodes"], seg["first"]
    # All sums of a score are whole numbers, which short floats hold up to 2^24.
    values = seg["short"] if most < 2.0**24 else seg["values"]
    asked, each = q.astype(values.dtype), q[dims]
    gain = np.maximum(each * seg["seg_low"], each * seg["seg_high"])
    order = np.argsort(-gain)
    total = np.cumsum(lengths[order])
    floor = -np.inf
    while True:
        at = min(len(order), int(np.searchsorted(total, first * n * d)) + 1)
        # A dimension's segments lie by falling values, so by falling gains, or by rising ones where the query is negative: those visited
        # are its first or its last ones, and what it can still give is the gain of the one next to them.
        gone = np.bincount(dims[order[:at]], minlength=d)
        low = np.where(q >= 0, from_[:-1], from_[1:] - gone)
        high = low + gone
        left = np.where(gone < np.diff(from_), gain[np.clip(np.where(q >= 0, high, low - 1), 0, len(gain) - 1)], 0)
        # A node starts with what all dimensions can still give; where it is met, the segment's gain takes the place of that.
        seen = np.repeat(low - np.cumsum(gone) + gone, gone) + np.arange(at)
        met = np.concatenate([nodes[x:y] for x, y in zip(begin[low].tolist(), begin[high].tolist(), strict=True)])
        bound = left.sum() + np.bincount(met, weights=np.repeat((gain[seen] - left[dims[seen]]).astype(float), lengths[seen]), minlength=n)
        probes = np.argpartition(bound, max(0, n - PROBES * k))[max(0, n - PROBES * k) :]
        floor = max(floor, int(np.partition(values.take(probes, axis=0) @ asked, -k)[-k]))
        alive = np.flatnonzero(bound >= floor)
        # The proof holds at any time; it ends the search once it leaves few nodes enough.
        if len(alive) <= max(k, MEMBERS * n) or at >= len(order):
            break
        first += STEP
    return alive, (values.take(alive, axis=0) @ asked).astype(np.int64), float(total[at - 1]) / (n * d)


def best_nodes(nodes: np.ndarray, scores: np.ndarray, k: int) -> tuple[list, list]:
    """The nodes, and their scores, that no k others exceed; equal scores all stay."""
    best = scores >= np.sort(scores)[-k] if len(scores) > k else np.ones(len(scores), bool)
    return nodes[best].tolist(), scores[best].tolist()


def build_index(vectors: DataFrame, shards: int, k: int) -> DataFrame:
    """The stored index of integer vectors (id, vec array<bigint>), a row per shard."""
    nodes = collapsed(vectors.select("id", "vec"), "id", "vec", k + 1)
    placed = nodes.withColumn("shard", F.concat_ws("-", F.size("vec"), F.pmod(F.xxhash64("vec"), F.lit(shards))))
    names = [c.strip().split()[0] for c in INDEX.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())), *[pa.binary()] * 5)

    def run(key, batch):  # without type hints: Spark would take them for its own
        flat = batch.column("vec").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)
        row = {"shard": key[0].as_py(), "dim": v.shape[1], "nodes": len(v), "vectors": v.tobytes(), "ids": batch.column("ids").to_pylist()} | {c: a.tobytes() for c, a in build_segments(v).items()}
        return pa.Table.from_pylist([row], schema=pa.schema(list(zip(names, kinds, strict=True))))

    return written(placed.repartition(SPREAD * shards, "shard").groupBy("shard").applyInArrow(run, INDEX), "impact")


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, its own id left out, ties to the smaller id."""
    valid = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    visits = valid.join(F.broadcast(index.select("shard", "dim")), F.size("vec") == F.col("dim")).select("shard", "id", "vec")
    own = [c.strip().split()[0] for c in INDEX.split(", ") if not c.strip().startswith(("shard", "dim"))]
    stream = index.select("shard", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<bigint>").alias("vec"), *own).unionByName(visits.select("*", *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in own]))
    count = SPREAD * max(1, index.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = seg = ids = None
        first = FIRST
        for batch in batches:
            made = [x is not None for x in batch.column("nodes").to_pylist()]
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                if made[i]:
                    row = batch.slice(i, 1).to_pylist()[0]
                    v = np.frombuffer(row["vectors"], np.int64).reshape(row["nodes"], -1)
                    seg = {c: np.frombuffer(row[c], np.int32 if c == "postings" else np.int64) for c in ("postings", "seg_dim", "seg_start", "seg_low", "seg_high")}
                    seg, ids, first = prepared(v, seg), row["ids"], FIRST
                    continue
                qid = batch.column("id")[i].as_py()
                q = batch.column("vec")[i].values.to_numpy(zero_copy_only=False)
                nodes, scores, share = search_segments(v, seg, q, k + 1, first)
                first = share - EASE if share < 1 else FIRST
                nodes, scores = best_nodes(nodes, scores, k + 1)
                hits = sorted((-s, x) for s, node in zip(scores, nodes, strict=True) for x in ids[node] if x != qid)[:k]
                for column, values in zip(out, ([qid] * len(hits), [x for _, x in hits], [-s for s, _ in hits]), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    best = stream.repartition(count, "shard").sortWithinPartitions("shard", F.col("nodes").asc_nulls_last()).mapInArrow(run, "query_id long, vec_id long, score long")
    return top_k(best, "query_id", "vec_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fiftieth vector's 5 highest scores over vectors of floor(256 x)."""
    raw = table(spark, sf_dir, "embeddings").filter(finite("embedding", True))
    vectors = raw.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    return search_index(build_index(vectors, shards_for(vectors, "vec", 1, SHARD_ROWS, SHARD_BYTES), 5), vectors.filter("id % 50 = 0"), 5)
