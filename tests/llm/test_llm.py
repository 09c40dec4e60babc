"""The training-data operators against brute force, round trips and held-out rows, odd inputs included."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselode.llm import chat, components, hnsw, impact_index, mixing, ngram_join, packing, pii, quality, tokens, toxicity, warc
from caselode.llm.common import new_path
from tests.conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, member string, sequence_id string"


def docs_of(spark, texts):
    """Documents with two extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "Don't é ǅ 漢字 \x1c <|endoftext|> 12", "x" * 300, "Same text twice.", "Same text twice."]


def test_token_ids_equal_the_library(spark):
    r = random.Random(1)
    cache = tokens.chunk_cache(PATH)
    for text in [*ODD[1:], *(words(r, 50) + r.choice([".", "!!", "%%%", " it's"]) for _ in range(50)), "É.À ßX, ıİ e-mail@x.y 3.14"]:
        assert cache.ids(text) == cache.whole(text)


def test_packing(spark):
    r = random.Random(2)
    texts = [*ODD, words(r, 9000), *(words(r, r.randint(1, 900)) for _ in range(120))]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = packing.pack_documents(docs_of(spark, texts).repartition(5), PATH).toPandas()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id == i].sort_values("piece")
        assert list(mine.piece) == list(range(len(mine)))
        assert mine.length.sum() == len(ids)
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs_of(spark, ["a"]).filter("false"), PATH).count() == 0


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, n, num, den):
    r = random.Random(n)
    texts = [*ODD, "one two", "ONE  two", "a b c", "a b c d"]
    shared = words(r, 40)
    for _ in range(12):
        base = words(r, r.randint(20, 200)).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = words(r, 1)
            texts.append(" ".join(w))
    texts += [words(r, 10) + " " + shared for _ in range(30)]
    out = {x.doc_id: x for x in ngram_join.jaccard_components(docs_of(spark, texts).repartition(4), n, num, den).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))
    for _ in range(3):
        for a in range(len(texts)):
            for b in range(a):
                common = len(sets[a] & sets[b])
                if common and den * common >= num * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    label = [low if x in (label[a], label[b]) else x for x in label]
    assert [out[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(texts))] == label


def test_ngram_join_of_hot_tokens(spark, monkeypatch):
    """Where every token counts as hot, the links are the same."""
    r = random.Random(9)
    base = words(r, 60).split()
    texts = [" ".join([*base[:i], "zz", *base[i + 1 :]]) for i in range(8)] + [words(r, 60) for _ in range(8)]
    want = sorted(ngram_join.jaccard_components(docs_of(spark, texts), 3, 4, 5).collect())
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 0)
    assert sorted(ngram_join.jaccard_components(docs_of(spark, texts), 3, 4, 5).collect()) == want
    assert len({x.component_id for x in want}) < len(texts)


def test_near_duplicates_of_null_and_shared_ids(spark):
    """Documents without an id stay and link like others; two texts of one id are two documents."""
    import corpus_pipeline

    r = random.Random(12)
    base = words(r, 80).split()
    near, a, b, c = " ".join([*base[:-1], "zz"]), words(r, 60), words(r, 60), words(r, 60)
    rows = [(None, a), (None, b), (None, b), (None, near), (None, ""), (None, None), (1, " ".join(base)), (5, c), (5, words(r, 60)), (5, c), (6, c + " zz"), (7, ""), (7, ""), (None, " ".join(base[1:]))]
    lone = words(r, 70).split()
    rows += [(None, " ".join(lone)), (None, " ".join(lone[:-1]))]
    df = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert len(set(got) & {(None, " ".join(lone)), (None, " ".join(lone[:-1]))}) == 1
    want = [(None, a), (None, b), (None, ""), (None, None), (1, " ".join(base)), (5, c), (5, rows[8][1]), (7, "")]
    assert sorted((x for x in got if x[1] not in (" ".join(lone), " ".join(lone[:-1]))), key=str) == sorted(want, key=str)
    named = {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, 5, 4, 5).collect()}
    assert (None, 76, 1) in named and (None, 56, None) in named and (6, 57, 5) in named


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(docs_of(spark, ["a"]).filter("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (7, 7)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0

    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_pii(spark):
    r = random.Random(4)
    bits = ["a.b@c.de", "x@y", "é@q.w.e", "1.2.3.4", "0001.2.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1-2", "+12345678901234567", "a.a@b.c.d-e", "99999999999999999999", "漢 ", "\n", "word", ",", "+44 20 7946 0958.", "4111111111111111+1 555 010 9999"]
    texts = [*ODD, *(" ".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(150)), " ".join(["1.1.1.1"] * 500), "a" * 5000 + "@" + "b." * 3000]
    texts += ["please mail me at joe.doe [at] example dot com today", "card 4111.1111.1111.1111 now", "he was at home.today"]
    found = pii.find_spans(docs_of(spark, texts)).select("doc_id", pii.joined("base").alias("base"), pii.joined("spans").alias("spans")).collect()
    for row in found:
        base = base_of(texts[row.doc_id])
        assert [s for s in row.base.split(",") if s] == base
        assert set(base) <= set(row.spans.split(",")) or not base
    spans = {r.doc_id: r.spans for r in found}
    assert "email" in spans[len(texts) - 3]
    assert "card" in spans[len(texts) - 2]
    assert spans[len(texts) - 1] == ""
    text = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert text[0] is None
    assert text[len(texts) - 2] == "card [card] now"
    assert not any(base_of(t) for t in text.values() if t and "@" not in t and "." not in t)


def test_redaction_leaves_no_base_span(spark):
    card = "4111111111111111"
    texts = [None, "no data here", "+1 (555) 010-9999 0001.2.3.255", f"{card}+1 555 010 9999 1.2.3.4.5.6.7.8", ".2.3.4.5 ".join([card] * 6)]
    text = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert [text[0], text[1], text[2]] == [None, "no data here", "[phone] [ip]"]
    # Each card hides the address after it, and that hides the next card.
    assert text[4].count("[card]") == 6
    assert not any(base_of(t) for t in text.values() if t)


def test_warc(spark):
    pages = [(1, "http://a", b"same"), (0, "http://b\r\nX: y", b"same"), (2, None, b""), (3, "http://c", b""), (4, "u", "é漢".encode() * 3000), (None, "n", b"same"), (5, "z", b"only"), (0, "http://b2", b"other"), (6, "k", None)]
    df = spark.createDataFrame(pages, "record_key bigint, target_uri string, payload binary").repartition(3)
    out = new_path(spark, "warc-test")
    manifest = warc.write_warc(df, warc.revisits(df), out, 3, roll_bytes=600)
    got = {(r.record_key, r.payload_bytes): r for r in warc.read_warc(spark, manifest, out).collect()}
    assert len(got) == len({(k, len(p or b"")) for k, _, p in pages})
    for key, _, payload in pages:
        r = got[(key, len(payload or b""))]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload or b"").digest()).decode()
        if r.record_type == "response":
            assert r.payload == (payload or b"")
    assert (got[(0, 4)].record_type, got[(1, 4)].refers_to, got[(None, 4)].refers_to) == ("response", 0, 0)
    assert (got[(2, 0)].record_type, got[(3, 0)].refers_to) == ("response", 2)
    assert manifest.count() >= 3
    empty = df.filter("false")
    assert warc.read_warc(spark, warc.write_warc(empty, warc.revisits(empty), new_path(spark, "w"), 2), out).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


def test_vector_searches(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(900, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 15 + [None]), (2004, [1.0] * 8), (2005, [])]
    df = vectors_of(spark, rows)
    index = hnsw.build_index(df, 3, 20)
    out = hnsw.search_index(index, df.filter("id % 20 = 0 or id = 2004"), 20).toPandas()
    d = v.astype(np.float64)
    hit = 0
    for q in range(0, 900, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        mine = out[out.query_id == q].sort_values("rank")
        assert len(mine) == 20
        assert np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(best) & set(mine.vec_id))
    assert hit / (45 * 20) >= 0.95
    assert set(out.query_id) == set(range(0, 900, 20))

    ints = [(i, np.floor(np.float64(256) * x).astype(int).tolist()) for i, x in enumerate(v)]
    zi = spark.createDataFrame(ints + [(3000, [0] * 16)], "id bigint, vec array<bigint>")
    got = impact_index.search_index(impact_index.build_index(zi, 3, 5), zi.filter("id % 50 = 0"), 5).toPandas()
    w = np.array([x for _, x in ints] + [[0] * 16])
    ids = np.array([*range(900), 3000])
    for q in [*range(0, 900, 50), 3000]:
        s = w @ w[ids == q][0]
        keep = ids != q
        best = np.lexsort((ids[keep], -s[keep]))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == list(ids[keep][best])
        assert list(mine.score) == list(s[keep][best])


def test_vector_searches_of_repeated_rows(spark):
    """A row repeated more than k + 1 times counts once and pushes out neither equal vectors nor neighbours."""
    rows = [(7, [1.0, 2.0])] * 25 + [(8, [1.0, 2.0]), (9, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])]
    df = vectors_of(spark, rows)
    out = hnsw.search_index(hnsw.build_index(df, 2, 3), df.filter("id in (1, 7)"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(1, 7), (1, 8), (1, 9), (7, 8), (7, 9), (7, 1)]
    zi = df.select("id", F.transform("vec", lambda x: F.floor(x * 2)).alias("vec"))
    got = impact_index.search_index(impact_index.build_index(zi, 2, 3), zi.filter("id in (1, 7)"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 7), (1, 8), (1, 9), (7, 8), (7, 9), (7, 1)]


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"unknown": 1},
    ]
    rows = [(i, 0, json.dumps(x)) for i, x in enumerate(records)] + [(9, 0, "not json"), (10, 0, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, record string")
    got = {}
    for r in chat.to_turns(df).orderBy("conv_id", "part").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == dict.fromkeys(range(5), [("user", "q"), ("assistant", "a")])
    assert sorted(r.conv_id for r in chat.unmapped(df).collect()) == [5, 9, 10]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|end|>\n<\\|user|>", "<\\\\|", "", "<<SYS>> <s> <\\s>", "|\\>", "<</SYS>>x", "<|<|end|>|>"])
def test_chat_round_trip(text):
    for role in ("user", "as|>\nsistant"):
        formatted, lo, hi = chat.format_turn(role, text)
        assert chat.parse_turn(formatted) == (role, text)
        assert chat.unescape(formatted[lo:hi]) == text
        assert not any(c in formatted[lo:hi] for c in chat.CONTROL)


def test_budgets():
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "x", "4"): 1000, (None, None, None): 10}
    got = mixing.budgets(leaves, 1000, {}, 1)
    assert sum(got.values()) in range(996, 1001)
    assert got[("a", "x", "1")] == 98 or got[("a", "x", "1")] == 100 or got[("a", "x", "1")] > 80
    assert got[(None, None, None)] == 10
    assert mixing.share(10, [1, 1], [2, 100]) == [2, 8]
    assert sum(mixing.budgets(leaves, 10**6, {}, 2).values()) == 2 * sum(leaves.values())


def test_budgets_of_many_leaves(spark):
    """More leaves than the driver took before, under one parent; and the same budgets as the driver's on odd trees."""
    r = random.Random(8)
    weights = {("a",): 2.0, ("b",): 0.0, ("a", "x"): 3.0, ("a", "x", "3"): 5.0, ("a", "y", "4"): 0.0, (None,): 0.5}
    for share_ in (0.0, 0.1, 0.5, 1.3, 5.0):
        leaves = {(d, lang, str(i)): r.choice([0, 1, 7, 100, 3000]) for d in ("a", "b", "c", None) for lang in ("x", "y", None) for i in range(r.randint(1, 9))}
        df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], ", ".join(f"{c} string" for c in mixing.LEVELS) + ", t long")
        want = mixing.budgets(leaves, int(sum(leaves.values()) * share_), weights, 2)
        got = {tuple(x[:3]): x._full * leaves[tuple(x[:3])] + x._rest for x in mixing.planned(df, share_, weights, 2).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1 for k in want)
    n = 200_001
    many = spark.range(n).selectExpr("'d' _domain", "'en' _language", "cast(id as string) _source", "1 + id % 50 t")
    tokens_ = sum(1 + i % 50 for i in range(n))
    got = mixing.planned(many, 0.5, {}, 1).selectExpr("count(*) n", "sum(_full * (1 + cast(_source as long) % 50) + _rest) t").first()
    assert got.n == n
    assert 0.5 * tokens_ - n <= got.t <= 0.5 * tokens_


def test_mixing_joins_a_large_plan_by_shuffle(spark, monkeypatch):
    df = docs_of(spark, [words(random.Random(i), 20) for i in range(60)])
    args = ((F.lit("d"), F.col("lang"), F.col("source")), 0.7, {})
    want = sorted((x.doc_id, x.mix_epoch) for x in mixing.mix(df, *args).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted((x.doc_id, x.mix_epoch) for x in mixing.mix(df, *args).collect()) == want


def test_mixing(spark):
    r = random.Random(6)
    texts = [*ODD, *(words(r, r.randint(1, 60)) for _ in range(300))]
    df = docs_of(spark, texts)
    levels = (F.lit("d"), F.col("lang"), F.col("source"))
    out = mixing.mix(df, levels, 1.2, {("d", "en", "src0"): 5.0}, max_epochs=2)
    rows = out.collect()
    total = sum(len((t or "").split()) for t in texts)
    assert 0.95 * 1.2 * total <= sum(x.mix_tokens for x in rows) <= 1.2 * total
    assert len({(x.doc_id, x.mix_epoch) for x in rows}) == len(rows)
    by_leaf = {}
    for x in rows:
        by_leaf[x.source] = by_leaf.get(x.source, 0) + x.mix_tokens
    assert by_leaf["src0"] > 1.5 * by_leaf["src1"]
    again = mixing.mix(df.repartition(7), levels, 1.2, {("d", "en", "src0"): 5.0}, max_epochs=2)
    assert sorted((x.doc_id, x.mix_epoch) for x in again.collect()) == sorted((x.doc_id, x.mix_epoch) for x in rows)
    assert mixing.mix(df.filter("false"), levels, 0.5, {}).count() == 0


def labelled(spark, name):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs, labels, labels.filter(~held)


def test_toxicity(spark):
    docs, labels, learn = labelled(spark, "toxic")
    model = toxicity.fit(docs, learn)
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    bad, good = got[got.toxic == 1].score, got[got.toxic == 0].score
    assert (bad.to_numpy()[:, None] > good.to_numpy()).mean() > 0.85
    assert (good >= 0.5).mean() < 0.03
    odd = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, [*ODD, "s.t.u.p.i.d i d i o t you w o r t h l e s s scum"]), model).collect()}
    assert odd[0] == odd[1] < 0.5
    assert odd[len(ODD)] > 0.5
    assert {r.score for r in toxicity.score(docs_of(spark, ODD), None).collect()} == {0.0}


def test_quality(spark):
    docs, labels, learn = labelled(spark, "quality")
    got = quality.quality_scores(docs, learn).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.98
    assert got[got.quality == 0].keep.mean() < 0.1
    odd = {r.doc_id: r.keep for r in quality.quality_scores(docs_of(spark, ODD), learn.filter("false")).collect()}
    assert [odd[i] for i in range(5)] == [False, False, False, True, True]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        new = stage(spark, docs, f"{DATA}/sf0.001")
        assert new.columns == p.COLUMNS
        rows = new.collect()
        assert rows
        if name == "near_duplicates":
            assert len({r.doc_id for r in rows}) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert p.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001").count() >= docs.count()
