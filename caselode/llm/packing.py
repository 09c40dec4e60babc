"""Best-fit packing of documents into token sequences (operator 1).

Hierarchical residual packing.  Every partition packs its own pieces best-fit decreasing, block by block, and emits the
bins that are nearly full.  Bins left underfull become items: partitions are merged ``fan_in`` to one and their
items packed best-fit again.  A bin whose room is less than the smallest item left is emitted where it is, as nothing can
fill it any more.  Merging ends with one partition, or once rounds hardly save a bin; then what is left is emitted where it is.
A merged partition holds about ``block_rows`` items at most, which is also the most pieces (plus one bin) in memory.

Defined results: a null or empty text is a document of the end token alone; only documents over ``capacity`` are cut;
repeated rows are separate documents; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written
from caselode.llm.tokens import chunk_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A round that leaves more than this share of its bins, in as many partitions, is the last.
SAVING = 0.99
PACKED = PIECES + ", item_id long, offset long, done boolean, fill long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of each document: ids from the tokenizer, then ``end_id``; cut at ``capacity``."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = chunk_cache(tokenizer_path).ids
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py()) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    for column, v in zip(out, (keys[i], n, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.

    Open bins are kept by free space; the lowest set bit at or above an item's size is the tightest bin.
    """
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += size
        if left := space - size:
            free[left].append(at)
            mask |= 1 << left
    return bins, offsets, np.asarray(fills, np.int64)


def pack(pieces: DataFrame, capacity: int = 4096, near_full: float = 0.995, fan_in: int = 8, block_rows: int = 65_536) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (PIECES columns)."""

    def packer(level: int, last: bool):
        full = 1 if last else int(capacity * near_full)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made = TaskContext.get().partitionId(), 0

            def flush(t: pa.Table) -> pa.RecordBatch:
                nonlocal made
                length, item, at = (t.column(n).to_numpy() for n in ("length", "item_id", "offset"))
                new = np.r_[True, item[1:] != item[:-1]] if level else np.ones(len(item), bool)
                index = np.cumsum(new) - 1
                sizes = np.bincount(index, weights=length).astype(np.int64)
                bins, base, fills = best_fit(sizes, capacity)
                ids = (np.int64(level) << 56) + (np.int64(part) << 32) + made + np.arange(len(fills))
                made += len(fills)
                cols = [t.column(n).combine_chunks() for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
                more = [pa.array(ids[bins][index]), pa.array(base[index] + (at if level else 0)), pa.array((fills >= full)[bins][index]), pa.array(fills[bins][index])]
                return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols] + more, names=["doc_id", "piece", "start", "length", "ids_crc32", "item_id", "offset", "done", "fill"])

            held: list[pa.RecordBatch] = []
            rows = 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                while rows >= block_rows:
                    t = pa.Table.from_batches(held)
                    cut = block_rows
                    if level:  # a bin's rows stay together
                        item = t.column("item_id").to_numpy()
                        starts = np.flatnonzero(item[1:] != item[:-1]) + 1
                        cut = int(starts[starts <= block_rows][-1]) if (starts <= block_rows).any() else 0
                    if not cut:
                        break
                    yield flush(t.slice(0, cut).combine_chunks())
                    t = t.slice(cut)
                    held, rows = t.to_batches(), t.num_rows
            if rows:
                yield flush(pa.Table.from_batches(held).combine_chunks())

        return run

    level, parts = 0, max(1, pieces.rdd.getNumPartitions())
    now = pieces.select(*[c.split()[0] for c in PIECES.split(", ")], F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("offset"))
    done, before = [], None
    while True:
        last = parts == 1
        out = written(now.mapInArrow(packer(level, last), PACKED), f"pack-{level}")
        # Bins left by fill, a row for each fill; a bin's first piece stands for it.
        fills = {r.fill: r["count"] for r in out.filter("not done and offset = 0").groupBy("fill").count().collect()}
        # Where even the smallest item left has no place, a bin is as full as it can be.
        room = capacity - min(fills, default=0)
        bins = sum(n for fill, n in fills.items() if fill <= room)
        fewer = max(-(-parts // fan_in), -(-bins // block_rows))
        if last or not bins or (before is not None and fewer >= parts and bins > SAVING * before):
            done.append(out)
            break
        done.append(out.filter(F.col("done") | (F.col("fill") > room)))
        level, parts, before = level + 1, fewer, bins
        now = out.filter(~F.col("done") & (F.col("fill") <= room)).drop("done", "fill").repartitionByRange(parts, "item_id").sortWithinPartitions("item_id", "offset")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("item_id").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, **options) -> DataFrame:
    """Tokenize and pack: PIECES columns with ``sequence_id`` and ``offset``."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, **options)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
