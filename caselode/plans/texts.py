"""Texts of catalogue rows and patients: cautions, evidence, document and query texts, list arguments, number formats.

Parts play the catalogue's medicines: the words of a part's type are what it treats, its brand an ingredient, its size and
container status a caution with a level that may be absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.plans.registry import query
from caselode.sources.tables import table

MEDICINES = """md AS (SELECT p_partkey AS drug_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name,
 CASE WHEN p_partkey % 7 = 0 THEN [] ELSE list_transform(string_split(p_type, ' '), lambda t: CASE WHEN length(t) % 5 = 0 THEN NULL ELSE t END) END AS treats,
 CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [p_brand, NULL, 'size ' || p_size] END AS ingredients,
 [{'crowd': ' all', 'level': CASE WHEN p_size % 2 = 0 THEN 'avoid' END}, {'crowd': p_brand, 'level': ' never '}, {'crowd': ' ', 'level': CASE WHEN p_size % 3 = 0 THEN '' END}] AS cautions FROM part),
mv AS (SELECT *, list_filter(treats, lambda t: t IS NOT NULL) AS tr, list_filter(ingredients, lambda t: t IS NOT NULL) AS ing,
 list_filter(list_transform(list_filter(cautions, lambda c: c.level IS NOT NULL), lambda c: trim(c.crowd || c.level)), lambda t: t <> '') AS cau FROM md)"""


def medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drug_id, name, treats, ingredients, cautions) with gaps of each kind."""
    key = F.col("p_partkey")
    none = F.array().cast("array<string>")
    treats = F.transform(F.split("p_type", " "), lambda t: F.when(F.length(t) % 5 != 0, t))
    caution = lambda crowd, level: F.struct(crowd.alias("crowd"), level.alias("level"))
    size = F.col("p_size")
    cautions = F.array(caution(F.lit(" all"), F.when(size % 2 == 0, "avoid")), caution(F.col("p_brand"), F.lit(" never ")), caution(F.lit(" "), F.when(size % 3 == 0, "")))
    ingredients = F.array("p_brand", F.lit(None).cast("string"), F.concat(F.lit("size "), size))
    return table(spark, sf_dir, "part").select(key.alias("drug_id"), F.when(key % 11 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(key % 7 == 0, none).otherwise(treats).alias("treats"), F.when(key % 5 == 0, none).otherwise(ingredients).alias("ingredients"), cautions.alias("cautions"))


def visible_cautions(cautions: Column | str) -> Column:
    """Crowd and level of the cautions that have a level, stripped; blank ones are left out."""
    shown = F.transform(F.filter(cautions, lambda c: c["level"].isNotNull()), lambda c: T.strip(F.concat(c["crowd"], c["level"])))
    return F.filter(shown, lambda t: t != "")


def present(items: Column | str) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def or_none(items: Column, separator: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, separator)).otherwise("None")


@query(f"WITH {MEDICINES} SELECT drug_id, array_to_string(cau, ';') AS cautions, len(cau) AS n FROM mv")
def visible_caution_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = visible_cautions("cautions")
    return medicines(spark, sf_dir).select("drug_id", F.array_join(shown, ";").alias("cautions"), F.size(shown).cast("long").alias("n"))


@query(f"""WITH {MEDICINES} SELECT drug_id, '治疗:' || CASE WHEN len(tr) > 0 THEN array_to_string(tr, ', ') ELSE 'None' END || ' || 禁用:' || CASE WHEN len(cau) > 0 THEN array_to_string(cau, ', ') ELSE 'None' END
 || ' || 成分:' || CASE WHEN len(ing) > 0 THEN array_to_string(ing, ', ') ELSE 'None' END AS text FROM mv""")
def lexical_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What BM25 indexes of a medicine."""
    parts = [F.lit("治疗:"), or_none(present("treats"), ", "), F.lit(" || 禁用:"), or_none(visible_cautions("cautions"), ", "), F.lit(" || 成分:"), or_none(present("ingredients"), ", ")]
    return medicines(spark, sf_dir).select("drug_id", F.concat(*parts).alias("text"))


@query(f"""WITH {MEDICINES} SELECT drug_id, '药品:' || CASE WHEN name = '' THEN 'None' ELSE name END || ' || 治疗:' || CASE WHEN len(treats) = 0 THEN 'None' ELSE array_to_string(tr, '、') END AS text FROM mv""")
def dense_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dense encoder reads: no treatment listed is "None", treatments that are all null are empty."""
    treats = F.when(F.size("treats") == 0, "None").otherwise(F.array_join(present("treats"), "、"))
    return medicines(spark, sf_dir).select("drug_id", F.concat(F.lit("药品:"), F.when(F.col("name") == "", "None").otherwise(F.col("name")), F.lit(" || 治疗:"), treats).alias("text"))


@query("""WITH s AS (SELECT l_orderkey AS case_id, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS ids FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, 'age ' || (o_custkey % 90) || '  ||  ' || o_orderstatus || '  ||  ' || o_orderpriority || '  ||  ' || coalesce(array_to_string(ids, ', '), 'None') AS text
FROM orders LEFT JOIN s ON o_orderkey = case_id""")
def patient_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patient's fields in fixed order; the separator has two spaces on each side."""
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("ids"))
    fields = [F.concat(F.lit("age "), F.col("o_custkey") % 90), F.col("o_orderstatus"), F.col("o_orderpriority"), F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("None"))]
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left").select(F.col("o_orderkey").alias("case_id"), F.concat_ws("  ||  ", *fields).alias("text"))


@query("""WITH x AS (SELECT c_custkey, ' ' || c_custkey || ', ,' || c_mktsegment || ' ,, ' || c_nationkey AS raw FROM customer),
y AS (SELECT c_custkey, list_filter(list_transform(string_split(raw, ','), lambda t: trim(t)), lambda t: t <> '') AS parts FROM x)
SELECT c_custkey, array_to_string(parts, '|') AS parts, list_sum(list_transform(list_filter(parts, lambda t: regexp_matches(t, '^[0-9]+$')), lambda t: t::BIGINT))::BIGINT AS total FROM y""")
def list_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma-separated argument: items stripped, blank ones left out, whole numbers cast."""
    raw = F.concat(F.lit(" "), "c_custkey", F.lit(", ,"), "c_mktsegment", F.lit(" ,, "), "c_nationkey")
    parts = T.filled(F.split(raw, ","))
    total = F.aggregate(F.filter(parts, lambda t: t.rlike("^[0-9]+$")), F.lit(0).cast("long"), lambda a, t: a + t.cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(parts, "|").alias("parts"), total.alias("total"))


@query("""SELECT o_orderpriority, printf('%.2f%%', 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS failed, printf('%.4f', count(*)::DOUBLE / 7) AS seventh FROM orders GROUP BY 1""")
def percentage_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.format_string("%.2f%%", 100.0 * done / F.count("*")).alias("failed"), F.format_string("%.4f", F.count("*").cast("double") / 7).alias("seventh"))


@query("SELECT event_id, string_split('4:' || event_type || ':' || user_id, ':')[-1]::BIGINT AS node FROM events")
def element_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number at the end of an element id."""
    element = F.concat(F.lit("4:"), "event_type", F.lit(":"), "user_id")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.split(element, ":"), -1).cast("long").alias("node"))


@query("SELECT doc_id, regexp_replace(lower(text), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stripped and in lower case."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("normal"))
