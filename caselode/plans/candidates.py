"""Candidate sets: named retrievers over the catalogue's texts, and their results with catalogue details.

Suppliers play the patients: the types of parts in their large lines are diagnoses, these parts' brands symptoms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import retrieval as R
from caselode.plans.registry import ORACLES, query
from caselode.plans.retrieval import LUCENE, OKAPI
from caselode.plans.texts import dense_document_text, lexical_document_text, medicines
from caselode.sources.tables import table

NAMES = ["bm25", "pyserini_bm25", "dense"]


def catalogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lexical, dense) of all medicines: what each kind of retriever reads."""
    lexical, dense = (f(spark, sf_dir).select(F.col("drug_id").alias("doc_id"), F.col("text").alias(n)) for n, f in (("lexical", lexical_document_text), ("dense", dense_document_text)))
    return lexical.join(dense, "doc_id")


def patient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): diagnoses, then symptoms, stripped, blank ones left out, joined by spaces."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 48").join(part, F.col("l_partkey") == F.col("p_partkey"))
    held = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("p_type")).alias("d"), F.sort_array(F.collect_set("p_brand")).alias("s"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").join(held, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    items = F.concat(F.coalesce("d", none), F.coalesce("s", none))
    return rows.select(F.col("s_suppkey").alias("query_id"), F.array_join(T.filled(items), " ").alias("query"))


def _bm25(name: str, idf: str, gain: str) -> str:
    """One retriever's tables, under names of its own."""
    own = idf.replace("i0", f"{name}_i").replace("idf AS", f"{name}_idf AS").replace("FROM i0", f"FROM {name}_i")
    return f"""{own}, {name}_s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * {gain} / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM q JOIN {name}_idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1, 2)"""


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
# Texts that Chinese retrieval reads: these hold runs of two such characters at most, which are their own pairs; in the instruction they are longer.
PAIRS = "flatten(list_transform({}, lambda w: CASE WHEN regexp_matches(w, '^[\\x{{1100}}-\\x{{FFFF}}]') AND length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END))"
HASHED = "list_transform(range({0}), lambda i: len(list_filter(list_transform({1}, lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT % {0}), lambda c: c = i))::DOUBLE)"


def _texts(name: str) -> str:
    return ORACLES[name]


CANDIDATES = f"""WITH lx AS ({_texts("lexical_document_text")}), dx AS ({_texts("dense_document_text")}),
pt AS (SELECT s_suppkey AS query_id, coalesce(string_agg(x, ' ' ORDER BY kind, x), '') AS query FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, unnest([1, 2]) AS kind, unnest([p_type, p_brand]) AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48) ON l_suppkey = s_suppkey GROUP BY 1),
tok AS (SELECT drug_id AS doc_id, unnest({WORDS.format("text")}) AS term FROM lx), tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), raw AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({WORDS.format("query")}) AS term FROM pt) GROUP BY 1, 2),
{_bm25("bm25", OKAPI, "2.5")}, {_bm25("pyserini_bm25", LUCENE, "1.0")},
qv AS (SELECT query_id, {HASHED.format(R.HASHED, PAIRS.format(WORDS.format("'" + R.INSTRUCTION + "' || query")))} AS v FROM pt WHERE query <> ''),
dv AS (SELECT drug_id AS doc_id, {HASHED.format(R.HASHED, PAIRS.format(WORDS.format("text")))} AS v FROM dx),
dense_s AS (SELECT query_id, doc_id, round(list_dot_product(qv.v, dv.v) / (greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-12) * greatest(sqrt(list_dot_product(dv.v, dv.v)), 1e-12)), 6) AS score FROM qv, dv),
a AS (SELECT 'bm25' AS retriever, * FROM bm25_s UNION ALL SELECT 'pyserini_bm25', * FROM pyserini_bm25_s UNION ALL SELECT 'dense', * FROM dense_s),
r AS (SELECT *, row_number() OVER (PARTITION BY retriever, query_id ORDER BY score DESC, doc_id) AS rank FROM a)"""


@query(CANDIDATES + " SELECT retriever, query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def retriever_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best medicines for each patient by each retriever."""
    return R.retrieve(NAMES, patient_texts(spark, sf_dir), catalogue_texts(spark, sf_dir), 10)


@query(CANDIDATES + f""", k AS (SELECT r.*, p_name, p_brand, count(*) OVER (PARTITION BY retriever, query_id) AS held FROM r JOIN part ON p_partkey = doc_id WHERE rank <= 10)
SELECT retriever, query_id, rank, doc_id AS drug_id, p_name AS name, p_brand AS maker FROM k""")
def candidate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patient's candidates with their catalogue details; an id that the catalogue lacks is an error."""
    found = retriever_candidates(spark, sf_dir).withColumnRenamed("doc_id", "drug_id")
    details = medicines(spark, sf_dir).select("drug_id").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("maker")), "drug_id")
    return R.hydrated(found, details, "drug_id").select("retriever", "query_id", "rank", "drug_id", "name", "maker")
