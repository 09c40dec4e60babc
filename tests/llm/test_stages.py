"""Stages of the pipeline and registered queries on odd rows: nulls in any column, empty texts, repeats, empty tables."""

import hashlib
import re

import pytest

from tests.conftest import DATA

queries = pytest.importorskip("caselode.llm.queries")
import corpus_pipeline as P  # noqa: E402

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, base int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix strong potions in the old stone tower by the sea"


def odd(spark):
    rows = [
        (1, PROSE, "en", "a", 9, "k", 1), (1, PROSE, "en", "a", 9, "k", 1), (2, PROSE + " today", "en", "b", 9, None, None), (3, None, "en", "a", None, None, 2), (4, "", None, None, 0, "", 3),
        (None, "mail a@b.cd or call +49 151 2345678 soon please my dear old friend", "de", None, 5, "x", None), (5, "one two", None, "c", 7, "y", 4), (6, "word " * 9000 + "a@b.cd", "en", "a", None, "z", 5), (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("stage"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    odd(spark).write.parquet(f"{where}/documents.parquet")
    return where


def test_near_duplicate_stage(spark, folder):
    out = P.near_duplicate_stage(spark, odd(spark), folder)
    assert out.columns == P.COLUMNS
    kept = sorted(((r.doc_id, (r.text or "")[:9]) for r in out.collect()), key=repr)
    # The second text is near the first and the first row stands twice; all others stay.
    assert kept == sorted([(1, PROSE[:9]), (3, ""), (4, ""), (None, "mail a@b."), (5, "one two"), (6, "word word"), (None, "")], key=repr)


def test_pii_stage(spark, folder):
    out = P.pii_stage(spark, odd(spark), folder).collect()
    assert len(out) == 9
    texts = [r.text for r in out if r.text]
    assert any(t.startswith("mail [email] or call [phone] soon") for t in texts)
    assert any(t.endswith("word [email]") for t in texts)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out)


def test_quality_mixing_and_packing_stages(spark, folder):
    docs = odd(spark)
    for name in ("quality", "mixing"):
        out = dict(P.STAGES)[name](spark, docs, folder)
        assert out.columns == P.COLUMNS
        assert set(out.select("doc_id", "text").collect()) <= set(docs.select("doc_id", "text").collect())
    packed = P.packing_stage(spark, docs, folder).collect()
    assert sum(1 for r in packed if r.piece == 0) == 9
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_of_nothing(spark, folder):
    for name, stage in P.STAGES:
        assert stage(spark, odd(spark).limit(0), folder).count() == 0, name


@pytest.mark.parametrize("name", ["op2_toxicity", "op6_quality_classifier", "op8_mixing", "op1_best_fit_packing", "op3_pii_spans"])
def test_registered_queries_on_odd_and_empty_tables(spark, folder, tmp_path, name):
    run = queries.queries()[name]
    if name not in ("op8_mixing", "op1_best_fit_packing"):
        assert run(spark, folder).count() == 9
    else:
        assert run(spark, folder).count() > 0
    odd(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert run(spark, str(tmp_path)).count() == 0


def test_base_spans_by_regular_expressions(spark):
    """The registered query's base digests against Python's regular expressions."""

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(d[::-1])) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, body):
        d = re.sub("[^0-9]", "", body)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in body.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.queries()["op3_pii_spans"](spark, SF).collect():
        found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, texts[r.doc_id], re.ASCII) if valid(k, m.group(0))]
        joined = ",".join(x[2] for x in sorted(found))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_turns_of_one_number_go_by_role_and_text(spark, tmp_path):
    rows = [(1, 0, "ab", "x"), (1, 0, "a", "z"), (1, 0, "a", "<s>"), (1, 0, "a", "<a>"), (1, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.turns_sha256 for r in queries.queries()["op7_chat_formatting"](spark, str(tmp_path)).collect()}
    want = "".join(f"{r}\n{t}\n" for r, t in [("a", "<a>"), ("a", "<s>"), ("a", "z"), ("ab", "x"), ("user", "")])
    assert got[1] == hashlib.sha256(want.encode()).hexdigest()
