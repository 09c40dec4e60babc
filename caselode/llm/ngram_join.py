"""N-gram Jaccard join of whole texts (operator 5): a grouped prefix join that is exact.

1. One scan makes each document's shingle set, a 128-bit key of that set (documents with equal sets are one *member*) and
   hashed counts of all shingles.  The counts only order shingles from rare to common; any order gives the same links.
2. A second scan emits, per member, the rarest shingles that a partner must share one of: its prefix.  Members with
   identical prefix and size form one *group*, so a token's bucket holds groups.  Buckets are apart by size class: a member
   is in its own class and, by its shorter prefix as the smaller of a pair, in that of its largest possible partner.
3. Star round: in each bucket every group meets one leader, the group in which the token comes earliest (the least edited
   text of a family), and in each group every member meets the least one.  Verified links make components.
4. Rest: buckets that still hold members of several components are expanded, and every pair of members in different
   components that passes the size, position and bitmap bounds (each a proof, none a guess) is verified.
   Before sets are compared, pairs must pass a bitmap as wide as their sets are large, so that few sets are ever sent.
   Pairs inside one component cannot change a result and are never made, so a family of k copies costs about k pairs.

Defined results: null or empty texts have no shingles and link with nothing; texts of fewer words than a shingle are one
shingle; repeated rows share a component; further columns of the input are ignored; an empty table gives no rows.  Rows go
by a hash of id and text, so rows of null id link like others, and two texts of one id link only if their sets do.  A
component is named by its least id (null where it has none); unlinked texts of one id can give two components one name, which
``survivors`` keeps apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.llm.common import drop_written, kept, table, written
from caselode.llm.components import connected_components
from caselode.llm.shingles import shingle_set

#: Hashed counts, 16 MB as ranks whatever the corpus holds, and those in one row on their way.
SKETCH_BITS = 24
CHUNK = 65_536
SCANNED = "doc_id long, key long, n_shingles long, member binary, chunk int, counts binary"
PREFIXED = "member binary, grp binary, n_shingles long, b0 long, b1 long, b2 long, b3 long, wide binary, tokens array<long>, places array<int>"
#: The most rows of (key, member) sent to every executor, about 40 MB; beyond it the texts are shuffled instead.
BROADCAST_ROWS = 1_000_000
#: Member keys that a task remembers to skip copies; later copies are emitted again and dropped after the shuffle.
SEEN_MEMBERS = 500_000
#: A size class spans this power of the largest ratio that linked sizes can have.
CLASS_SPAN = 4
#: Tokens counted more often than this, and than four times the mean, are hot: their buckets are never put into one task.
HOT_ROWS = 100_000
CLASS_STEP = np.uint64(0x9E3779B97F4A7C15)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def packed_counts(counts: np.ndarray) -> bytes:
    """Which counts there are, a bit each, then those less one, a byte each, ending at 255; deflated."""
    there = counts > 0
    return zlib.compress(np.packbits(there).tobytes() + np.minimum(counts[there] - 1, 255).astype(np.uint8).tobytes(), 1)


def unpacked_counts(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(packed), np.uint8)
    counts = np.unpackbits(data[: CHUNK // 8]).astype(np.int64)
    counts[counts > 0] += data[CHUNK // 8 :]
    return counts


def _scan(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        names = [c.split()[0] for c in SCANNED.split(", ")]
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                np.add.at(total, (s & mask).astype(np.int64), 1)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        chunks = total.reshape(-1, CHUNK)
        parts = [(int(i), packed_counts(chunks[i])) for i in np.flatnonzero(chunks.any(1))]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=names)

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, SCANNED)


def _commonness(scanned: DataFrame) -> np.ndarray:
    """Rank of each hashed count, a byte each: 16 MB whatever the corpus holds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = unpacked_counts(counts.as_py())
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        ranks = {c: np.minimum(255, 8 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for c, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(ranks), pa.int32()), pa.array(list(ranks.values()), pa.binary())], names=["chunk", "ranks"])

    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in scanned.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, ranks binary").toLocalIterator():
        ranks[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.ranks, np.uint8)
    return ranks


def wide_bits(s: np.ndarray) -> bytes:
    """Parity bitmap of a set, two to four bits for each shingle and 256 at least."""
    width = 256
    while width < 2 * len(s):
        width *= 2
    return np.packbits(np.bincount(((s >> np.uint64(28)) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Different bits of two bitmaps, the wider one folded to the other's width; sets differ by at least as many shingles."""
    x, y, n, m = int.from_bytes(a), int.from_bytes(b), 4 * len(a), 4 * len(b)
    while n > m:
        x, n = (x >> n) ^ (x & ((1 << n) - 1)), n // 2
    while m > n:
        y, m = (y >> m) ^ (y & ((1 << m) - 1)), m // 2
    return (x ^ y).bit_count()


def size_classes(size: int, num: int, den: int) -> range:
    """The classes in which a set meets its partners: its own, and further ones up to its largest partner's."""
    span = CLASS_SPAN * np.log(den / num)
    return range(int(np.log(size) / span), int(np.log(max(size, size * den // num)) / span) + 1)


def _prefixes(docs: DataFrame, n: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    seen = sum(np.bincount(ranks[at : at + CHUNK], minlength=256) for at in range(0, len(ranks), CHUNK))
    mean = float(seen @ (2.0 ** (np.arange(256) / 8.0) - 1)) / len(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, min(255, int(8 * np.log2(1 + HOT_ROWS + 4 * mean)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (order, hot), mask = shared.value, np.uint64((1 << SKETCH_BITS) - 1)
        names = [c.split()[0] for c in PREFIXED.split(", ")]

        seen: set[bytes] = set()  # copies within a task are emitted once

        def flush(out: list) -> pa.RecordBatch:
            bits = np.stack([o[3] for o in out])
            ends = np.cumsum([0, *(len(o[4]) for o in out)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o[4] for o in out]).view(np.int64)))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o[5] for o in out])))
            cols = [pa.array([o[i] for o in out], k) for i, k in ((0, pa.binary()), (1, pa.binary()), (2, pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)), pa.array([o[6] for o in out], pa.binary()), tokens, places], names=names)

        for batch in batches:
            out: list = []
            for text in batch.column(0):
                s = shingle_set(text.as_py(), n)
                if not len(s) or (member := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                if len(seen) < SEEN_MEMBERS:
                    seen.add(member)
                k = len(s) - -(-num * len(s) // den) + 1
                rank = order[(s & mask).astype(np.int64)]
                chosen = np.lexsort((s, rank))[:k]
                prefix = s[chosen]
                place = (2 * np.arange(k) + (rank[chosen] > hot)).astype(np.int32)
                flips = np.bincount(((s >> np.uint64(20)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
                group = hashlib.blake2b(prefix.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest()
                own, *larger = size_classes(len(s), num, den)
                few = len(s) - -(-2 * num * len(s) // (num + den)) + 1
                tokens = np.concatenate([prefix + CLASS_STEP * np.uint64(own), *(prefix[:few] + CLASS_STEP * np.uint64(c) for c in larger)])
                places = np.concatenate([place, *(place[:few] for _ in larger)])
                out.append((member, group, len(s), np.packbits(flips.astype(np.uint8)).view(np.int64), tokens, places, wide_bits(s)))
                if len(out) >= 2000:
                    yield flush(out)
                    out = []
            if out:
                yield flush(out)

    return docs.select("text").mapInArrow(run, PREFIXED)


def _may_link(a: str, b: str, num: int, den: int):
    """Size, position and bitmap bounds between two bucket rows, by prefix of their columns.

    Each different shingle flips one bit of a bitmap, so two sets differ by at least as many shingles as bits.
    """
    size = F.least(f"{a}n_shingles", f"{b}n_shingles") * den >= F.greatest(f"{a}n_shingles", f"{b}n_shingles") * num
    room = F.least(F.col(f"{a}n_shingles") - F.col(f"{a}pos"), F.col(f"{b}n_shingles") - F.col(f"{b}pos"))
    both = F.col(f"{a}n_shingles") + F.col(f"{b}n_shingles")
    apart = sum((F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}b0").bitwiseXOR(F.col(f"{b}b0"))))
    return size & (room * (num + den) >= both * num) & (apart * (num + den) <= both * (den - num))


def _paired(light: DataFrame, num: int, den: int) -> DataFrame:
    """The bucket rows that can have a partner in their bucket, by sizes and positions.

    In order of size, a row's next neighbour is its best larger partner: where sizes or the row's position rule that one
    out, no larger one can link.  A row's smaller partners are rows that may have a larger one.
    """
    once = light.repartition("token").groupBy("token", "m").agg(F.first("place").alias("place"), F.first("n").cast("long").alias("n"))
    in_order = Window.partitionBy("token").orderBy("n", "m")
    following = F.lead("n").over(in_order)
    room = F.col("n") - F.expr("place div 2")
    up = F.coalesce((F.col("n") * den >= F.col("_next") * num) & (room * (num + den) >= (F.col("n") + F.col("_next")) * num), F.lit(False))
    seen = once.withColumn("_next", following).withColumn("_up", up)
    below = F.max(F.when(F.col("_up"), F.col("n"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("_below", below).filter(F.col("_up") | (F.col("_below") * den >= F.col("n") * num)).select("token", "m", "place")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("member")).unionByName(pairs.select(F.col("v").alias("member"))).distinct()


def _close(pairs: DataFrame, prefixed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the wide bitmaps leave possible."""
    spark = pairs.sparkSession
    ends = written(_ends(pairs), "ends")
    few = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    wide = prefixed.select("member", "n_shingles", "wide").join(few, "member").dropDuplicates(["member"])
    a, b = (wide.select(F.col("member").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("nu").to_pylist(), batch.column("nv").to_pylist(), strict=True)
            keep = [bits_apart(x.as_py(), y.as_py()) * (num + den) <= (k + m) * (den - num) for x, y, (k, m) in zip(batch.column("wu"), batch.column("wv"), sizes, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    close = written(pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "wu", "wv").mapInArrow(run, "u binary, v binary"), "close")
    drop_written(ends, spark)
    return close


def _verified(pairs: DataFrame, prefixed: DataFrame, docs: DataFrame, owners: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of members that do link.  Sets are made anew for the members in close pairs only."""
    spark = docs.sparkSession
    met = written(pairs.select("u", "v").distinct(), "pairs")
    pairs = _close(met, prefixed, num, den)
    drop_written(met, spark)
    needed = written(owners.join(_ends(pairs), "member"), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows have one key: their set is made once in a task
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                members, sets = [], []
                for member, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if member in seen:
                        continue
                    s = shingle_set(text.as_py(), n)
                    # Another text of the same key is no text of this member.
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == member:
                        members.append(member)
                        sets.append(s.view(np.int64))
                        if len(seen) < SEEN_MEMBERS:
                            seen.add(member)
                if not members:
                    continue
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), lists], names=["member", "shingles"])

    keys = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    made = docs.select(row_key().alias("key"), "text").join(keys, "key").select("member", "text").mapInArrow(run, "member binary, shingles array<long>")
    # One shuffle by member, which both joins below use as it lies.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = kept(made.repartition(parts, "member").dropDuplicates(["member"]))
    a = sets.select(F.col("member").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("member").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("su", "sv")))
    links = written(both.filter(F.col("common") * (den + num) >= (F.size("su") + F.size("sv")) * num).select("u", "v"), "links")
    sets.unpersist()
    drop_written(pairs, spark)
    drop_written(needed, spark)
    return links


def _labelled(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, n_shingles, label) of every row; rows of one component have one label, rows without shingles none."""
    scanned = kept(_scan(docs, n))
    ranks = _commonness(scanned)
    rows = scanned.filter("chunk is null").select("doc_id", "key", "n_shingles", "member")
    owners = rows.filter("n_shingles > 0").groupBy("member").agg(F.min("key").alias("key"))
    prefixed = kept(_prefixes(docs, n, num, den, ranks))
    # Members go by a short hash here; should two share one, both come back from the join below.
    light = prefixed.select(F.xxhash64("member").alias("m"), F.col("n_shingles").cast("int").alias("n"), F.inline(F.arrays_zip("tokens", "places"))).toDF("m", "n", "token", "place")
    held = _paired(light.filter("place % 2 = 0"), num, den).unionByName(light.filter("place % 2 = 1").groupBy("token", "m").agg(F.first("place").alias("place"))).select("token", "m", F.expr("place div 2").alias("pos"))
    members = prefixed.groupBy("member").agg(*[F.first(c).alias(c) for c in ("grp", "n_shingles", "b0", "b1", "b2", "b3")])
    buckets = written(held.join(members.withColumn("m", F.xxhash64("member")), "m").drop("m"), "buckets")

    # Star round.
    bits = ("b0", "b1", "b2", "b3")
    by_group = buckets.groupBy("token", "grp").agg(F.min_by(F.struct("member", "pos", "n_shingles", *bits), "member").alias("g")).select("token", "g.*")
    leader = by_group.groupBy("token").agg(F.min(F.struct("pos", "n_shingles", "member", *bits)).alias("l"))
    met = by_group.select("token", *[F.col(c).alias(f"a_{c}") for c in ("member", "pos", "n_shingles", *bits)]).join(leader.select("token", *[F.col(f"l.{c}").alias(f"b_{c}") for c in ("member", "pos", "n_shingles", *bits)]), "token")
    star = met.filter("a_member != b_member").filter(_may_link("a_", "b_", num, den)).select(F.col("a_member").alias("u"), F.col("b_member").alias("v"))
    heads = buckets.groupBy("grp").agg(F.min("member").alias("v"), F.max("member").alias("w")).filter("v != w").select("grp", "v")
    inside = buckets.select("grp", F.col("member").alias("u")).distinct().join(heads, "grp").filter("u != v").select("u", "v")
    links = _verified(star.unionByName(inside), prefixed, docs, owners, n, num, den)
    labels = written(connected_components(links), "labels")

    # Rest: buckets with members of several components.
    named = buckets.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))
    mixed = named.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("labels")).filter("labels > 1").select("token", "major")
    open_ = written(named.join(mixed, "token"), "open")
    a = open_.filter("label != major").select(*[F.col(c).alias(f"a_{c}") for c in ("token", "member", "label", "pos", "n_shingles", "b0", "b1", "b2", "b3")])
    b = open_.select(*[F.col(c).alias(f"b_{c}") for c in ("token", "member", "label", "major", "pos", "n_shingles", "b0", "b1", "b2", "b3")])
    once = (F.col("b_label") == F.col("b_major")) | (F.col("a_member") < F.col("b_member"))
    rest = a.join(b, (F.col("a_token") == F.col("b_token")) & (F.col("a_label") != F.col("b_label")) & once & _may_link("a_", "b_", num, den))
    more = _verified(rest.select(F.col("a_member").alias("u"), F.col("b_member").alias("v")), prefixed, docs, owners, n, num, den)
    final = written(connected_components(links.unionByName(more)), "labels")

    whole = rows.join(final.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))
    whole = written(whole.select("doc_id", "key", "n_shingles", "label"), "labelled")
    for df in (scanned, prefixed):
        df.unpersist()
    for df in (buckets, open_, links, more, labels, final):
        drop_written(df, docs.sparkSession)
    return whole


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose shingle sets have Jaccard ``num/den`` or more are linked."""
    whole = _labelled(docs, n, num, den)
    least = whole.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return whole.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def survivors(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without shingles.

    A component's row is the one of the least id, nulls last, then of the least hash of id and text.  Rows of the same id
    and text are one; rows without an id and without shingles can't be told to be copies and all stay.
    """
    whole = _labelled(docs, n, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = whole.filter("label is not null").groupBy("label").agg(F.min(order).alias("o")).select("o.doc_id", "o.key")
    stay = first.unionByName(whole.filter("label is null and doc_id is not null").select("doc_id", "key").distinct())
    keyed = docs.withColumn("_key", row_key()).alias("l")
    kept_ = keyed.join(stay.alias("r"), (F.col("l._key") == F.col("r.key")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi").drop("_key")
    nameless = docs.filter(F.col("doc_id").isNull() & F.coalesce(~F.col("text").rlike(r"[^\t\n\x0B\f\r ]"), F.lit(True)))
    return kept_.dropDuplicates(["doc_id", "text"]).unionByName(nameless)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
