"""Operators 11 to 13 against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA

queries = pytest.importorskip("caselode.llm.queries")
from caselode.llm import repair, repeats, suffixes, whitening  # noqa: E402

SF = f"{DATA}/sf0.001"


# Operator 13


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """All edits in the order of (cost, audit); the first that ends well."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in made)
        if not re.fullmatch("s?(ua)*u?", initials) or any(not r for r, _ in made):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*made, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                more = cost + (faults[i] == "truncated")
                heapq.heappush(heap, (more, audit + "K", i + 1, (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, (*made, (new, text))))
    raise AssertionError


def repaired_by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged_by_hand(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, made = cheapest(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_against_all_edits(spark):
    r = random.Random(4)
    rows = [(c if c else None, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "", None, "s"]), r.choice(["a.", "b!", "c", " ", None, "é?\n", "a."])) for c in range(60) for _ in range(r.randint(1, 6))]
    rows += [(100, 3, "user", "x.")] * 3 + [(101, -(2**63), "user", "x."), (101, 2**63 - 1, "user", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"gone": F.lit("x"), "again": F.lit(1), "_key": F.lit(2), "_copy": F.lit(3)})
    want = repaired_by_hand(rows)
    want[101] = (2**63 - 1 if want[101][0] > 2**63 - 1 else want[101][0], *want[101][1:])
    made = repair.repair(repair.damaged(df))
    assert {x.conv_id: tuple(x[f] for f in FIELDS) for x in made.collect()} == want
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


def test_repaired_turns_have_the_digest(spark):
    rows = repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    made = repair.repair(rows)
    turns = {}
    for x in sorted(repair.repaired_turns(rows, made).collect(), key=lambda x: (x.conv_id, x.position)):
        turns.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for x in made.collect():
        assert x.repaired_sha256 == hashlib.sha256("\n".join(turns.get(x.conv_id, [])).encode()).hexdigest()


def test_repair_query(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: tuple(x[f] for f in FIELDS) for x in queries.queries()["op13_conversation_repair"](spark, SF).collect()}
    assert got == repaired_by_hand(rows)


@pytest.mark.parametrize("roles", ["x", "ux", "sua", "a", "uuax"])
def test_frozen_audits(monkeypatch, roles):
    """Audits come out alike however often their tails are frozen, and long conversations take constant work a row."""
    r = random.Random(roles)
    rows = [(i, r.choice(roles) + "ser", f"{i}.", r.random() < 0.2) for i in range(400)]
    found = []
    for tail in (10**9, 1, 3):
        monkeypatch.setattr(repair, "TAIL", tail)
        state = repair.Repair(1)
        for row in rows:
            state.add(*row)
        found.append(state.row())
    assert found[0] == found[1] == found[2]


# Operator 12


def whitened_by_hand(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    c = u - u.mean(0)
    v = c.T @ c / len(u)
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    k = min(16, len(e))
    return len(u), ((len(u) * x - u.sum(0)) ** 2).sum(1), (x - u.mean(0)) @ p[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def check_whitening(found, ids, vectors):
    n, deviation, white, explained = whitened_by_hand(vectors)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(ids) * white.shape[1]
    for j in range(white.shape[1]):
        mine = np.array([got[i, j + 1].whitened for i in ids])
        assert min(np.abs(mine - white[:, j]).max(), np.abs(mine + white[:, j]).max()) < 1e-6
    for at, i in enumerate(ids):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, deviation[at])
        assert r.explained == pytest.approx(explained[0], rel=1e-6)
        assert r.identity_error < 1e-8


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(queries.queries()["op12_embedding_whitening"](spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_of_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(3)
    good = [(i, r.normal(0, 3, 4).tolist()) for i in range(40)]
    rows = [*good, *[(100 + i, good[0][1]) for i in range(5)], (900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [1.0, float("inf"), 2.0, 3.0]), (904, []), (905, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"d": F.lit("x"), "component": F.lit(0), "n": F.lit(9), "x": F.lit(1), "label": F.lit(1)})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.queries()["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    use = [x for x in rows if x[0] < 900]
    check_whitening([x for x in out if x.vec_id != 905], [i for i, _ in use], [v for _, v in use])
    alone = [x for x in out if x.vec_id == 905]
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained) for x in alone] == [(1, 1, 0, 0.0, 0.0)]
    df.limit(0).write.parquet(f"{tmp_path}/empty/embeddings.parquet")
    assert queries.queries()["op12_embedding_whitening"](spark, f"{tmp_path}/empty").count() == 0


def test_whitening_is_exact_far_from_zero(spark):
    """Sums past 64 bits, directions without variance."""
    big = 1 << 52
    x = [[big - 3, 5, -big], [big - 1, 5, -big + 2], [big, 5, -big + 1], [big - 2, 5, -big + 7]]
    fits = whitening.fit(spark.createDataFrame([(v,) for v in x] * 1, "x array<long>"))
    w = fits[3]
    assert w.sums == [sum(c) for c in zip(*x, strict=True)]
    c = np.array(x, object) * 4 - np.array(w.sums, object)
    v = (c.astype(float) / 4).T @ (c.astype(float) / 4) / 4
    assert np.allclose(np.sort(w.values), np.linalg.eigvalsh(v))
    assert (w.scales(3) > 0).tolist() == [True, True, False]


# Operator 11


def removed_by_hand(docs):
    low = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            low[b[p : p + 50]] = min(low.get(b[p : p + 50], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found_by(frame):
    return sorted([(x.id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in frame.collect()], key=repr)


def test_window_minima():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(5, 20))) for _ in range(60)] + [b"aaaaaaaaaa"] * 3
    owners = np.array([r.randint(0, 40) for _ in texts])
    lengths = np.array([len(t) for t in texts])
    found = suffixes.window_minima(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, owners, 5)
    low = {}
    for t, o in zip(texts, owners, strict=True):
        for i in range(len(t) - 4):
            low[t[i : i + 5]] = min(low.get(t[i : i + 5], 99), o)
    assert found.tolist() == [low[t[i : i + 5]] for t in texts for i in range(len(t) - 4)]


def test_transform_is_that_of_sorted_suffixes():
    texts = [b"banana", b"ananas", b"nab", b"banana"]
    lengths = np.array([len(t) for t in texts])
    before, common = suffixes.insert_columns(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    suffix = sorted((t[i:], k, t[i - 1] + 1 if i else 0) for k, t in enumerate(texts) for i in range(len(t) + 1))
    assert before.tolist() == [b for *_, b in suffix]
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0] + [prefix(a[0], b[0]) for a, b in zip(suffix, suffix[1:], strict=False)]


def test_repeats_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(x) for x in queries.queries()["op11_suffix_array_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    want = removed_by_hand(docs)
    assert sorted(got, key=repr) == want
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_repeats_in_odd_documents(spark, chunk):
    passage = "the same long passage that is shared among documents, over and over again, é ü. "
    docs = [(3, None), (1, ""), (1, passage), (2, passage), (2, passage + "x"), (5, "a" * 400), (6, "b" + "a" * 300), (None, passage), (7, "zz" + passage * 3), (7, passage * 2), (9, "short"), (4, "\0" * 80 + passage), (8, passage[:49]), (10, passage[:50]), (-4, passage[20:])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "chunk": F.lit("c"), "data": F.lit(1), "bucket": F.lit(None)})
    assert found_by(repeats.remove_repeats(df, "doc_id", "text", chunk, 64)) == removed_by_hand(docs)
    assert repeats.remove_repeats(df.limit(0), "doc_id", "text").count() == 0


# Operator 10: what the proof saves


def test_impact_index_stops_early_and_is_exact():
    from caselode.llm.impact_index import build_segments, search_segments

    r = np.random.default_rng(0)
    for v in (np.floor(256 * r.normal(0, 0.125, (3000, 64))).astype(np.int64), r.integers(-3, 4, (500, 8)), np.zeros((40, 4), np.int64), r.integers(-(2**24), 2**24, (60, 3))):
        seg, shares = build_segments(v), []
        for q in v[::37]:
            nodes, scores, share = search_segments(v, seg, q, 6)
            assert (scores == v[nodes] @ q).all()
            # All nodes of the sixth-best score or more are there, so that ties can go by id.
            whole = v @ q
            assert set(np.flatnonzero(whole >= np.sort(whole)[-6]).tolist()) <= set(nodes.tolist())
            shares.append(share)
        if len(v) == 3000:
            assert np.median(shares) < 0.5


def test_one_id_with_two_vectors(spark):
    from caselode.llm import hnsw, impact_index

    rows = [(1, [5, 0]), (1, [0, 7]), (2, [3, 3]), (3, [0, 9])]
    df = spark.createDataFrame(rows, "id long, vec array<long>")
    out = impact_index.search_index(impact_index.build_index(df, 2, 5), df.filter("id = 1"), 5).collect()
    # Its smallest vector asks: (0, 7).
    assert [(x.vec_id, x.score) for x in sorted(out, key=lambda x: x.rank)] == [(3, 63), (2, 21)]
    found = hnsw.search_index(hnsw.build_index(df.withColumn("vec", F.col("vec").cast("array<double>")), 2, 5), df.withColumn("vec", F.col("vec").cast("array<double>")).filter("id = 1"), 5)
    assert [x.vec_id for x in found.orderBy("rank").collect()] == [3, 2]


def test_impact_index_hands_on_best_nodes_only():
    from caselode.llm.impact_index import best_nodes, build_segments, prepared, search_segments

    r = np.random.default_rng(4)
    v = np.floor(256 * r.normal(size=(2000, 16))).astype(np.int64)
    seg = prepared(v, build_segments(v))
    for q in v[::250]:
        whole = v @ q
        nodes, scores = best_nodes(*search_segments(v, seg, q, 6)[:2], 6)
        assert sorted(nodes) == np.flatnonzero(whole >= np.sort(whole)[-6]).tolist()
        assert scores == whole[nodes].tolist()
    past = np.array([1 << 62, -(1 << 63), (1 << 63) - 1], object)
    assert best_nodes(np.arange(3), past, 2) == ([0, 2], [1 << 62, (1 << 63) - 1])


def test_impact_index_search_starts_where_the_last_one_ended(monkeypatch):
    from caselode.llm import impact_index

    r = np.random.default_rng(5)
    v = np.floor(256 * r.normal(0, 0.125, (4000, 64))).astype(np.int64)
    seg, first, bounds, partition = impact_index.prepared(v, impact_index.build_segments(v)), impact_index.FIRST, [], np.argpartition
    for q in v[::200]:
        whole = v @ q
        for start in (0.05, 0.4, 1.0):
            nodes, scores, _ = impact_index.search_segments(v, seg, q, 6, start)
            assert (scores == whole[nodes]).all()
            assert set(np.flatnonzero(whole >= np.sort(whole)[-6]).tolist()) <= set(nodes.tolist())
    monkeypatch.setattr(np, "argpartition", lambda *a, **k: bounds.append(1) or partition(*a, **k))
    for q in v[::40]:
        first = impact_index.search_segments(v, seg, q, 6, first)[2] - impact_index.EASE
    # A bound goes over all postings visited so far: most queries draw one.
    assert len(bounds) < 1.5 * len(v[::40])


def test_shards_of_the_impact_index_follow_the_rows(spark):
    from caselode.llm.impact_index import SHARD_BYTES, SHARD_ROWS
    from caselode.llm.vectors import shards_for

    at = lambda n, d: shards_for(spark.range(n).select(F.array_repeat(F.lit(1), d).alias("vec")), "vec", 1, SHARD_ROWS, SHARD_BYTES)
    assert [at(0, 1), at(5000, 1), at(50_000, 1), at(400_000, 1), at(20_000, 1024)] == [1, 2, 12, 25, 10]
