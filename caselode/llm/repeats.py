"""Removal of byte strings that an earlier document holds, by column-wise suffix arrays (operator 11).

Every string of ``WINDOW`` bytes that also starts in a document of a smaller id is removed; the rest stays.

1. Documents are written once, in chunks of about ``CHUNK_BYTES``, as a table bucketed by chunk, so that later joins move
   only what is small.
2. Each window has an anchor, the least hash of its grams of ``GRAM`` bytes; neighbouring windows with one anchor are a run.
   Equal windows have equal anchors.  Chunks send four bytes for each of their anchors to the anchor's bucket, buckets
   send back those that two documents have.  Runs of other anchors can't repeat and end here.
3. Runs with a shared anchor, each different one once per chunk, go to the anchor's bucket as strings.  There the
   collection's Burrows-Wheeler transform and common prefixes are built column by column (``suffixes.py``), one symbol
   of each string a round; suffixes with ``WINDOW`` or more common bytes are the equal windows, and the least id among
   them goes back to the chunks.
4. Chunks mark what is to go and return what is left.

The files of the method are the chunks and buckets, read and written in sequence in the shared folder and in shuffles;
within a task the transform is in arrays, as a machine-local file would be lost with its executor.  A chunk has each
anchor and each run once, so copies of a text or passage in a third of all documents cost one string a chunk.

Defined results: a null or empty text has no bytes; documents under ``WINDOW`` bytes are kept; a document without id
keeps all its bytes and removes nothing; documents that share an id don't remove from one another; repeated rows are
documents; repeats within one document alone stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import bucketed, table, written
from caselode.llm.suffixes import window_minima

WINDOW, GRAM = 50, 24
#: Windows of one run at most, as many as one place of a gram can rule; longer ones (of repeated grams) are cut.
LONGEST_RUN = WINDOW - GRAM + 1
#: Text of a chunk and of a bucket of anchors; suffixes in one construction; windows hashed at a time.
CHUNK_BYTES, BUCKET_BYTES, BATCH, BLOCK = 4 << 20, 4 << 20, 1 << 16, 1 << 15
FACTOR = 0x9E3779B97F4A7C15
CHUNK = "chunk long, ids array<long>, ends array<long>, data binary"
RUN = np.dtype([("piece", "<u4"), ("start", "u1"), ("length", "u1"), ("owner", "<i8")])


def chunks_of(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(id, data) rows gathered into chunks: ids, where each document ends, all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal made, ids, texts, size
            ends = np.cumsum([len(t) for t in texts])
            columns = [pa.array([(part << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())]
            made, ids, texts, size = made + 1, [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "ends", "data"])

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(id_)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, CHUNK)


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of each gram, by doubling the length that a polynomial covers."""
    power = lambda k: np.uint64(pow(FACTOR, k, 1 << 64))
    whole, have, part, size = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if gram & size:  # the grams' lower bits come first
            whole, have = (part if whole is None else whole[: len(data) - have - size + 1] * power(size) + part[have : have + len(data) - have - size + 1]), have + size
        if 2 * size > gram:
            break
        part, size = part[:-size] * power(size) + part[size:], 2 * size
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    return whole


def _sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored_runs(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of all runs; ``valid`` says where a window may start."""
    found = []
    for at in range(0, len(data) - WINDOW + 1, BLOCK):
        ok = valid[at : at + BLOCK]
        if not ok.any():
            continue
        anchor = _sliding_minima(_hashes(data[at : at + BLOCK + WINDOW - 1], GRAM), WINDOW - GRAM + 1)
        ok = ok[: len(anchor)]
        cut = np.ones(len(anchor) + 1, bool)
        cut[1:-1] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        cuts = np.flatnonzero(cut)
        starts, counts = cuts[:-1], np.diff(cuts)
        use = ok[starts]
        found.append((starts[use] + at, counts[use], anchor[starts[use]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, counts, anchors = map(np.concatenate, zip(*found, strict=True))
    if len(counts) and counts.max() > LONGEST_RUN:
        times = -(-counts // LONGEST_RUN)
        step = _within(times) * LONGEST_RUN
        starts, anchors = np.repeat(starts, times) + step, np.repeat(anchors, times)
        counts = np.minimum(np.repeat(counts, times) - step, LONGEST_RUN)
    return starts, counts, anchors


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, after one another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in the sorted list."""
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values if len(listed) else np.zeros(len(values), bool)


@dataclass
class Chunk:
    """A chunk's documents and their runs, in the order of anchors."""

    ids: np.ndarray
    known: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    anchors: np.ndarray
    docs: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch, i: int) -> Chunk:
        listed = batch.column("ids")[i].values
        known = np.array(listed.is_valid())
        ids, ends = np.array(listed.fill_null(0)), np.array(batch.column("ends")[i].values)
        data = np.frombuffer(batch.column("data")[i].as_py(), np.uint8)
        valid = np.zeros(len(data), bool)
        begins = np.append(0, ends[:-1])
        for a, b in zip(begins[known].tolist(), ends[known].tolist(), strict=True):
            valid[a : max(a, b - WINDOW + 1)] = True
        starts, counts, anchors = anchored_runs(data, valid)
        order = np.argsort(anchors, kind="stable")
        starts = starts[order]
        return Chunk(ids, known, ends, data, starts, counts[order], anchors[order], np.searchsorted(ends, starts, "right"))

    def only(self, shared: np.ndarray, buckets: int) -> Chunk:
        """With the runs whose anchors are among ``shared`` (bucket and lower half as one number)."""
        key = bucket_of(self.anchors, buckets) << np.uint64(32) | self.anchors & np.uint64(0xFFFFFFFF)
        use = _among(key, shared)
        return Chunk(self.ids, self.known, self.ends, self.data, self.starts[use], self.counts[use], self.anchors[use], self.docs[use])

    def pieces(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(different runs as strings, each with the window's overhang; the run's string; the least id of each)."""
        raw, number, text = self.data.tobytes(), {}, []
        of = np.empty(len(self.starts), np.int64)
        for i, (s, n) in enumerate(zip(self.starts.tolist(), self.counts.tolist(), strict=True)):
            piece = raw[s : s + n + WINDOW - 1]
            at = number.setdefault(piece, len(text))
            if at == len(text):
                text.append(piece)
            of[i] = at
        least = np.full(len(text), np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.ids[self.docs])
        return text, of, least


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that anchors in order are in the order of buckets."""
    return ((anchors >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _slices(anchors: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of anchors in order."""
    of = bucket_of(anchors, buckets)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, int)
    return [(int(of[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _batch(names: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def anchors_sent(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket, the lower halves of the chunk's anchors: those of one document, those of more."""
    names = "bucket int, chunk long, once binary, more binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk.read(batch, i)
                head = np.flatnonzero(np.r_[True, c.anchors[1:] != c.anchors[:-1]]) if len(c.anchors) else np.zeros(0, int)
                last = np.append(head[1:], len(c.anchors)) - 1
                # Runs of one anchor are in the order of documents.
                more, anchors = c.ids[c.docs[head]] != c.ids[c.docs[last]], c.anchors[head]
                low = anchors.astype(np.uint32)
                rows = [(b, low[x:y][~more[x:y]].tobytes(), low[x:y][more[x:y]].tobytes()) for b, x, y in _slices(anchors, buckets)]
                chunk = batch.column("chunk")[i].as_py()
                yield _batch(names, [[r[0] for r in rows], [chunk] * len(rows), [r[1] for r in rows], [r[2] for r in rows]])

    return chunks.select("chunk", "ids", "ends", "data").mapInArrow(run, names)


def anchors_shared(sent: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket, which of its anchors two or more documents have."""
    names = "chunk long, bucket int, anchors binary"

    def run(key, rows):  # without type hints: Spark would take them for its own
        blobs = [(o or b"") + (m or b"") for o, m in zip(rows.column("once").to_pylist(), rows.column("more").to_pylist(), strict=True)]
        twice = np.frombuffer(b"".join(rows.column("more").to_pylist()), np.uint32)
        whole = np.sort(np.concatenate([np.frombuffer(b"".join(blobs), np.uint32), twice]))
        shared = np.unique(whole[1:][whole[1:] == whole[:-1]])
        out = []
        for chunk, blob in zip(rows.column("chunk").to_pylist(), blobs, strict=True):
            own = np.frombuffer(blob, np.uint32)
            if len(own := own[_among(own, shared)]):
                out.append((chunk, key[0].as_py(), own.tobytes()))
        return pa.Table.from_batches([_batch(names, [[r[k] for r in out] for k in range(3)])])

    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, names)


def per_chunk(rows: DataFrame, column: str) -> DataFrame:
    """A chunk's blobs of all buckets in one row; a chunk's size bounds them."""
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", column)).alias(column))


def _shared_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    found = batch.column("anchors")[i].as_py() or []
    parts = [np.frombuffer(x["anchors"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"]) << np.uint64(32) for x in found]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def pieces_sent(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket, its different runs with shared anchors: strings, their lengths, least ids and anchors."""
    names = "bucket int, chunk long, data binary, lengths binary, least binary, anchors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk.read(batch, i).only(_shared_of(batch, i), buckets)
                text, of, least = c.pieces()
                anchors = np.empty(len(text), np.uint64)
                anchors[of] = c.anchors
                lengths = np.array([len(t) for t in text], np.uint8)
                rows = [(b, b"".join(text[x:y]), lengths[x:y].tobytes(), least[x:y].tobytes(), anchors[x:y].astype(np.uint32).tobytes()) for b, x, y in _slices(anchors, buckets)]
                yield _batch(names, [[r[0] for r in rows], [batch.column("chunk")[i].as_py()] * len(rows), *([r[k] for r in rows] for k in range(1, 5))])

    return chunks.select("chunk", "ids", "ends", "data", "anchors").mapInArrow(run, names)


def owners_found(pieces: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket, runs of windows whose least owner is smaller than the chunk's own least id for that string."""
    names = "chunk long, bucket int, owners binary"

    def run(key, rows):
        number: dict[bytes, int] = {}
        of, least_of, sizes = [], [], []
        anchors: list[int] = []
        for data, lengths, least, low in zip(*(rows.column(c).to_pylist() for c in ("data", "lengths", "least", "anchors")), strict=True):
            ends = np.cumsum(sizes_here := np.frombuffer(lengths, np.uint8).astype(np.int64))
            mine = []
            for a, b, anchor in zip((ends - sizes_here).tolist(), ends.tolist(), np.frombuffer(low, np.uint32).tolist(), strict=True):
                at = number.setdefault(data[a:b], len(anchors))
                if at == len(anchors):
                    anchors.append(anchor)
                mine.append(at)
            of.append(np.array(mine, np.int64))
            least_of.append(np.frombuffer(least, np.int64))
            sizes.append(sizes_here - WINDOW + 1)
        owner = np.full(len(anchors), np.iinfo(np.int64).max)
        for a, b in zip(of, least_of, strict=True):
            np.minimum.at(owner, a, b)
        offsets, found = construct(list(number), np.array(anchors, np.uint32), owner)
        out = []
        for chunk, mine, least, counts in zip(rows.column("chunk").to_pylist(), of, least_of, sizes, strict=True):
            m = found[np.repeat(offsets[mine], counts) + _within(counts)]
            piece, inside = np.repeat(np.arange(len(mine)), counts), _within(counts)
            less = m < np.repeat(least, counts)
            head = less & np.r_[True, ~less[:-1] | (m[1:] != m[:-1]) | (piece[1:] != piece[:-1])][: len(less)]
            at = np.flatnonzero(head)
            if not len(at):
                continue
            runs = np.empty(len(at), RUN)
            runs["piece"], runs["start"], runs["owner"] = piece[at], inside[at], m[at]
            runs["length"] = np.add.reduceat(less.astype(np.int64), at)  # between heads only windows of the run are marked
            out.append((chunk, key[0].as_py(), runs.tobytes()))
        return pa.Table.from_batches([_batch(names, [[r[k] for r in out] for k in range(3)])])

    return pieces.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, names)


def construct(texts: list[bytes], anchors: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each string's first window, least owner per window).  Strings of different anchors share no window, so
    constructions take whole anchors, about ``BATCH`` bytes at a time."""
    order = np.argsort(anchors, kind="stable")
    data = np.frombuffer(b"".join([texts[i] for i in order.tolist()]), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    windows = lengths - WINDOW + 1
    offsets = np.cumsum(windows) - windows
    found = np.empty(int(windows.sum()), np.int64)
    ends, names = np.cumsum(lengths[order]), anchors[order]
    at = 0
    while at < len(order):
        begin = int(ends[at - 1]) if at else 0
        to = int(np.searchsorted(ends, begin + BATCH, "right"))
        to = int(np.searchsorted(names, names[min(max(to, at + 1), len(order)) - 1], "right"))
        use = order[at:to]
        made = window_minima(data[begin : ends[to - 1]], ends[at:to] - lengths[use] - begin, lengths[use], owner[use], WINDOW)
        found[np.repeat(offsets[use], windows[use]) + _within(windows[use])] = made
        at = to
    return offsets, found


def marked(c: Chunk, found: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    cover = np.zeros(len(c.data), bool)
    if not len(c.starts):
        return cover
    text, of, least = c.pieces()
    windows = np.array([len(t) for t in text], np.int64) - WINDOW + 1
    offsets = np.cumsum(windows) - windows
    owner = np.repeat(least, windows)
    anchors = np.empty(len(text), np.uint64)
    anchors[of] = c.anchors
    begins = {b: x for b, x, _ in _slices(anchors, buckets)}
    for bucket, blob in found:
        runs = np.frombuffer(blob, RUN)
        counts = runs["length"].astype(np.int64)
        owner[np.repeat(offsets[begins[bucket] + runs["piece"]] + runs["start"], counts) + _within(counts)] = np.repeat(runs["owner"], counts)
    inside = _within(c.counts)
    hit = owner[np.repeat(offsets[of], c.counts) + inside] < np.repeat(c.ids[c.docs], c.counts)
    begun = np.zeros(len(c.data), np.int32)
    begun[(np.repeat(c.starts, c.counts) + inside)[hit]] = 1
    total = np.cumsum(begun, dtype=np.int32)
    total[WINDOW:] -= total[:-WINDOW].copy()
    return total > 0


KEPT = "id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"


def kept_bytes(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per document: its length, the spans that go and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk.read(batch, i).only(_shared_of(batch, i), buckets)
                cover = marked(c, [(x["bucket"], x["owners"]) for x in batch.column("owners")[i].as_py() or []], buckets)
                begins = np.append(0, c.ends[:-1])
                edge = np.zeros(len(cover) + 1, bool)
                edge[begins] = True
                first = np.flatnonzero(cover & (edge[:-1] | ~np.append(False, cover[:-1])))
                edge[c.ends] = True
                last = np.flatnonzero(cover & (edge[1:] | ~np.append(cover[1:], False)))
                of = np.searchsorted(c.ends, first, "right")
                counts = np.append(0, np.cumsum(np.bincount(of, minlength=len(c.ends)))).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(first - begins[of]), pa.array(last - first + 1)], names=["start", "length"])
                stays = [b - a - np.count_nonzero(cover[a:b]) for a, b in zip(begins.tolist(), c.ends.tolist(), strict=True)]
                stay = np.append(0, np.cumsum(stays)).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(c.ends), [None, pa.py_buffer(stay), pa.py_buffer(c.data[~cover])])
                yield pa.RecordBatch.from_arrays([pa.array(c.ids, mask=~c.known), pa.array(c.ends - begins), pa.ListArray.from_arrays(pa.array(counts), spans), kept], names=["id", "n_bytes", "spans", "kept"])

    return chunks.select("chunk", "ids", "ends", "data", "anchors", "owners").mapInArrow(run, KEPT)


def remove_repeats(docs: DataFrame, id_: str, text: str, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_bytes, spans, kept) of each document."""
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))
    chunks = bucketed(chunks_of(rows, chunk_bytes), "chunk", max(buckets, -(-total // chunk_bytes)), "repeats")
    # The lists that chunks get are small beside them: they are the side that is hashed, and chunks stay where they are.
    shared = written(per_chunk(anchors_shared(anchors_sent(chunks, buckets), buckets), "anchors"), "anchors").hint("shuffle_hash")
    owners = per_chunk(owners_found(pieces_sent(chunks.join(shared, "chunk"), buckets), buckets), "owners").hint("shuffle_hash")
    return kept_bytes(chunks.join(shared, "chunk", "left").join(owners, "chunk", "left"), buckets)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 50 bytes."""
    found = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
