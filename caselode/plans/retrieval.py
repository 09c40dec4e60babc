"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import metrics, retrieval
from caselode.plans.registry import query
from caselode.sources.tables import table

BM25_SQL = """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
%s,
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id AS query_id, doc_id, round(sum(qtf * idf * tf * %s / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""
OKAPI = """i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM raw CROSS JOIN st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0)"""
LUCENE = "idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM raw CROSS JOIN st)"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents").select("doc_id", "text")


@query(BM25_SQL % (OKAPI, "2.5") + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(*_both(spark, sf_dir), 5)


@query(BM25_SQL % (LUCENE, "1.0") + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def bm25_lucene_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(*_both(spark, sf_dir), 5, variant="lucene")


@query("""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY 1""")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, _ = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", T.words("text"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark),
g AS (SELECT item_id, unnest(CASE WHEN length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END) AS term FROM w)
SELECT item_id, term, count(*) AS tf FROM g GROUP BY 1, 2""")
def cjk_bigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, _ = retrieval.postings(table(spark, sf_dir, "benchmark"), "item_id", T.bigrams("text"))
    return tf.select(F.col("doc_id").alias("item_id"), "term", "tf")


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END) AS term FROM w)
SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2""")
def cjk_bigram_document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, _ = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", T.bigrams("text"))
    return tf.select("doc_id", "term", "tf")


@query("""
WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
  round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against every row but their own."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.dense_topk(q, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), 10, own=False)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text; items are the small, stated side."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return table(spark, sf_dir, "documents").join(F.broadcast(items), F.expr("contains(text, item)")).select(F.col("item_id").alias("query_id"), "doc_id")


@query(BM25_SQL % (OKAPI, "2.5") + """,
gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
g AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
h AS (SELECT r.query_id, count(*) AS n_hit, min(rank) AS first FROM r JOIN gold ON r.query_id = gold.query_id AND r.doc_id = gold.doc_id WHERE rank <= 5 GROUP BY 1),
m AS (SELECT b.item_id, CASE WHEN n_hit > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(n_hit / n_gold, 0.0) AS recall, coalesce(1.0 / first, 0.0) AS mrr
      FROM benchmark b LEFT JOIN g ON b.item_id = g.query_id LEFT JOIN h ON b.item_id = h.query_id)
SELECT count(*) AS n, round(avg(hit)::DOUBLE, 6) AS hit, round(avg(recall)::DOUBLE, 6) AS recall, round(avg(mrr)::DOUBLE, 6) AS mrr, count(*) FILTER (hit = 0) AS failures FROM m""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25_topk(*_both(spark, sf_dir), 5)
    ranked = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranked"))
    gold = _gold(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    none = F.array().cast("array<bigint>")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(ranked, "query_id", "left").join(gold, "query_id", "left").select("query_id", F.coalesce("ranked", none).alias("ranked"), F.coalesce("gold", none).alias("gold"))
    m = metrics.at_k("gold", "ranked", 5)
    scored = cases.select(*[m[c].alias(c) for c in ("hit", "recall", "mrr")])
    return scored.agg(F.count("*").alias("n"), *[metrics.mean_or_zero(c).alias(c) for c in ("hit", "recall", "mrr")], F.count_if(F.col("hit") == 0).alias("failures"))


@query("""
SELECT doc_id, lower(trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS normal, length(text) AS chars, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_words,
  contains(lower(text), 'the ') AS has_the, replace(source, 'src', 'source-') AS origin FROM documents WHERE lang IS NOT NULL""")
def project_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang is not null")
    return docs.select("doc_id", F.lower(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("normal"), F.length("text").cast("long").alias("chars"), F.size(T.words("text")).cast("long").alias("n_words"), F.lower("text").contains("the ").alias("has_the"), F.replace("source", F.lit("src"), F.lit("source-")).alias("origin"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100")
def scan_limit_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows in file order, by the stored sequence."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn").limit(100)


@query("""
WITH x AS (SELECT conv_id, turn, role, 'bm25' AS retriever FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, role, 'dense' FROM conversations WHERE role = 'assistant')
SELECT retriever, count(*) AS n, min(conv_id) AS first_conv FROM x GROUP BY 1""")
def retriever_registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several named retrievers as one table."""
    rows = table(spark, sf_dir, "conversations")
    named = {"bm25": rows.filter("role = 'user'"), "dense": rows.filter("role = 'assistant'")}
    whole = None
    for name, df in named.items():
        part = df.select("conv_id", F.lit(name).alias("retriever"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("retriever").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))
