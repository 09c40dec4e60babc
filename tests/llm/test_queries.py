"""The registered operator queries: against their SQL, or brute force where SQL has no way to say it."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_queries import rows

queries = pytest.importorskip("caselode.llm.queries")
SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows([[r[i] for i in order] for r in found.fetchall()]) == rows(df.select(*columns).collect())


def test_nearest_neighbours_recall(spark):
    out = queries.queries()["op9_nearest_neighbours"](spark, SF).toPandas()
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, v = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), np.float64)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        keep = ids != q
        best = ids[keep][np.lexsort((ids[keep], -s[keep]))[:20]]
        mine = out[out.query_id == q].sort_values("rank").vec_id
        hit, total = hit + len(set(best) & set(mine)), total + len(best)
    assert hit / total >= 0.95


def test_kernel_against_explicit_subsequences():
    """The folded features are those of an explicit gapped three-letter subsequence kernel."""
    from itertools import combinations

    from caselode.llm import toxicity as T

    def explicit(w):
        c, out = T.codes([w])[0].tolist(), {}
        for i, j, k in combinations(range(len(c)), 3):
            if k - i < T.SPAN:
                f = (c[i] * T.SYMBOLS + c[j]) * T.SYMBOLS + c[k]
                out[f] = out.get(f, 0) + T.DECAY ** (k - i - 2)
        norm = sum(x * x for x in out.values()) ** 0.5
        return {f: x / norm for f, x in out.items()}

    words = ["idiot", "idxiot", "iddiot", "hello", "ab"]
    made = T.kernel_features(words)
    for w, row in zip(words, made, strict=True):
        want = explicit(w)
        assert set(np.flatnonzero(row)) == set(want)
        assert all(abs(row[f] - x) < 1e-5 for f, x in want.items())
    assert made[0] @ made[1] > 3 * (made[0] @ made[3])


def test_site_means_are_shrunk(spark):
    """Each path's mean lies between its own and its host's, nearer to its own the more documents it has."""
    from caselode.llm import quality

    r = np.random.default_rng(3)
    data = [(f"h{h}", f"p{p}", float(np.clip(0.3 + 0.05 * h + 0.05 * p + 0.1 * r.normal(), 0.01, 0.99))) for h in range(6) for p in range(3) for _ in range(3 if p == 0 else 200)]
    df = spark.createDataFrame(data, "_host string, _path string, _p double")
    sites, overall = quality.site_means(df)
    got = {(x._h, x._q): x._site for x in sites.collect()}
    assert overall == pytest.approx(np.mean([p for _, _, p in data]))
    own = {k: np.mean([p for h, q, p in data if (h, q) == k]) for k in got}
    far = [abs(got[k] - own[k]) for k in got if k[1] == "p0"]
    near = [abs(got[k] - own[k]) for k in got if k[1] != "p0"]
    assert len(got) == 18
    assert np.mean(near) < np.mean(far)


def test_clashing_names(spark):
    """Columns named like the operators' own pass through; maps too."""
    from caselode.llm import mixing, pii, quality

    df = spark.createDataFrame([(i, f"one two three {i} a@b.cd", "en", "src1", 9, 1.0) for i in range(12)], "doc_id long, text string, lang string, source string, mix_tokens long, _upper double")
    df = df.withColumn("_row", F.create_map(F.lit("k"), F.lit(1))).withColumn("base", F.lit(5)).withColumn("text2", F.lit("z"))
    mixed = mixing.mix(df, mixing.tree(df), 0.5, {})
    assert mixed.count() > 0
    assert {"_upper", "_row", "base", "mix_epoch"} <= set(mixed.columns)
    scored = quality.quality_scores(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    assert scored.count() == 12
    assert {r.text for r in pii.redact(df).collect()} == {f"one two three {i} [email]" for i in range(12)}
    assert pii.redact(df).columns == df.columns


def test_spans_are_learned(spark):
    """Thresholds are finite, lines of another seed are found, and many matches in one text are quick."""
    from caselode.llm import pii

    _, least = pii.fitted(spark)
    assert set(least) == {"email", "ip", "card", "phone"}
    assert all(np.isfinite(m) for m in least.values())
    lines = pii.examples_table(spark, 600, 77)
    got = pii.find_spans(lines).select("label", (F.size("spans") > F.size("base")).alias("added"), (F.size("spans") > 0).alias("any")).toPandas()
    assert got[got.added].label.mean() >= 0.9
    assert got[got.label == 1]["any"].mean() >= 0.9
    many = spark.createDataFrame([(" ".join(["a@b.cd"] * 6000),)], "text string")
    assert pii.redact(many).first().text == " ".join(["[email]"] * 6000)


def test_bins_that_nothing_fills(spark):
    """Pieces of which no two fit together leave at once, and none is lost."""
    from caselode.llm import packing

    pieces = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L start", "2100 + id % 1900 length", "0L ids_crc32").repartition(6)
    out = packing.pack(pieces, block_rows=512)
    assert out.select("sequence_id").distinct().count() == out.count() == 3000
    assert out.filter("shiftrightunsigned(sequence_id, 56) > 0").count() == 0
