"""Deterministic sharded WARC writer and reader (operator 4).

Records are range-sorted by key, so that a shard covers a key range; each task writes its range into files that roll at
a compressed size.  Headers and digests are made anew from the payload.  A file is written under a temporary name that
carries the attempt; the driver then renames the files that successful attempts report and writes a manifest.  A rerun
of a task makes the same bytes under another temporary name, so a lost executor costs only its tasks, and files that no
manifest lists are removed.

Defined results: a null payload is empty; a null key is written last with the text ``null`` in its URI; of records with
equal payloads of ``min_payload`` bytes or more the one with the smallest key is the response, the others revisit it (rows
that repeat the smallest key are all responses); an empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import new_path, table, written

MANIFEST = "shard int, part int, temporary string, file string, records long, compressed_bytes long, sha256 string"
RECORD = "record_key long, record_type string, target_uri string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"
EPOCH = "2000-01-01T00:00:00Z"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _record_id(key: object, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}"


def record_bytes(key: object, uri: str, payload: bytes, refers: object | None) -> bytes:
    """One WARC/1.1 record, a response with its payload or a revisit with its header block alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_record_id(key, digest)}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Record-Key: {key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_record_id(refers, digest)}>", f"X-Refers-To-Key: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(records: DataFrame, min_payload: int = 0) -> DataFrame:
    """(record_key, payload_sha, refers_to) of the records that repeat the payload of a smaller key.

    Only keys and digests meet on a digest; counts are combined before the shuffle and a hot digest's rows are split by
    the adaptive skew join.
    """
    meta = records.filter(F.octet_length("payload") >= min_payload).select("record_key", F.sha1("payload").alias("payload_sha"))
    first = meta.groupBy("payload_sha").agg(F.min("record_key").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return meta.join(first, "payload_sha").filter("record_key > refers_to or (record_key is null and refers_to is not null)").distinct()


def write_warc(records: DataFrame, again: DataFrame, out: str, shards: int, roll_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Write (record_key, target_uri, payload) under ``out``; returns the manifest.

    ``again`` (see ``revisits``) travels in the same range sort, each of its rows just before the records of its key, so
    that payloads are shuffled once.
    """
    spark = records.sparkSession
    files, at = _filesystem(out)
    files.create_dir(f"{at}/_temporary", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = _filesystem(out)
        made, stream, sha, size, count = [], None, None, 0, 0
        now, refer = None, {}

        def close() -> None:
            stream.close()
            part = len(made)
            made.append((shard, part, f"_temporary/{shard:06d}-{part:04d}-{attempt}.warc.gz", f"{shard:06d}-{part:04d}.warc.gz", count, size, sha.hexdigest()))

        for batch in batches:
            for key, uri, payload, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                key, payload = key.as_py(), payload.as_py() or b""
                if key != now:
                    now, refer = key, {}
                if digest.is_valid:
                    refer[digest.as_py()] = refers.as_py()
                    continue
                original = refer.get(hashlib.sha1(payload).hexdigest()) if refer else None
                packed = gzip.compress(record_bytes(key, uri.as_py() or "about:blank", payload, original), level, mtime=0)
                if stream is not None and size + len(packed) > roll_bytes:
                    close()
                    stream = None
                if stream is None:
                    stream = store.open_output_stream(f"{root}/_temporary/{shard:06d}-{len(made):04d}-{attempt}.warc.gz", compression=None)
                    sha, size, count = hashlib.sha256(), 0, 0
                stream.write(packed)
                sha.update(packed)
                size, count = size + len(packed), count + 1
        if stream is not None:
            close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = records.select("record_key", F.regexp_replace("target_uri", r"[\r\n]", "").alias("target_uri"), "payload", F.lit(None).cast("string").alias("payload_sha"), F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(again.select("record_key", "payload_sha", "refers_to"), allowMissingColumns=True)
    key = F.col("record_key").asc_nulls_last()
    sorted_ = rows.repartitionByRange(shards, key).sortWithinPartitions(key, F.col("payload_sha").asc_nulls_last(), "target_uri")
    manifest = written(sorted_.mapInArrow(write, MANIFEST), "warc-manifest")
    lines = []
    for row in manifest.orderBy("shard", "part").toLocalIterator():  # one row per file
        files.move(f"{at}/{row.temporary}", f"{at}/{row.file}")
        lines.append(json.dumps({k: row[k] for k in ("file", "records", "compressed_bytes", "sha256")}))
    files.delete_dir(f"{at}/_temporary")
    with files.open_output_stream(f"{at}/MANIFEST.tmp") as s:
        s.write("\n".join(lines).encode())
    files.move(f"{at}/MANIFEST.tmp", f"{at}/MANIFEST.jsonl")
    return manifest.drop("temporary")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields | {"payload": None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]}


def read_warc(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """The records of the files that a manifest lists, streamed member by member; a digest that doesn't match raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        store, root = _filesystem(out)

        def members(name: str) -> Iterator[bytes]:
            with store.open_input_stream(f"{root}/{name}", compression=None) as s:
                rest, inflate, parts = b"", zlib.decompressobj(31), []
                while data := (rest or s.read(1 << 16)):  # what a member leaves over is copied, so it is kept short
                    rest = b""
                    parts.append(inflate.decompress(data))
                    if inflate.eof:
                        rest = inflate.unused_data
                        yield b"".join(parts)
                        inflate, parts = zlib.decompressobj(31), []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["record_key", "record_type", "target_uri", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for data in members(name):
                    f = parse_record(data)
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["payload"] is not None and base64.b32encode(hashlib.sha1(f["payload"]).digest()).decode() != digest:
                        raise ValueError(f"payload digest differs in {name}")
                    key, refers = f["X-Record-Key"], f.get("X-Refers-To-Key")
                    rows.append((None if key == "None" else int(key), f["WARC-Type"], f["WARC-Target-URI"], f["WARC-Record-ID"].strip("<>"), refers and int(refers), digest, int(f["X-Payload-Length"]), f["payload"]))
                    held += len(data)
                    if held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    names = manifest.select("file")
    return names.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(read, RECORD.replace("refers_to string", "refers_to long"))


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all ``pages`` and read them back."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_key"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    out = new_path(spark, "warc")
    shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    manifest = write_warc(pages, revisits(pages), out, shards, roll_bytes=256 << 20)
    back = read_warc(spark, manifest, out)
    return back.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
