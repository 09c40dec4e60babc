"""Generation records with reasons and evidences: all eight validation errors, the rates of the report, and list joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import table

#: An order's answer: ranks 1 and 2 are selected, odd orders list them in reverse; one in seven failed, one in eleven has no
#: answer; reasons are blank for every fifth item, evidence ids are missing for every third and unknown for every fourth.
RECORDS = RANKED + """, an AS (SELECT case_id, case_id % 7 <> 0 AS success, case_id % 11 = 0 AS missing, list(drug_id ORDER BY rank) FILTER (rank <= 2) AS selected,
 CASE WHEN case_id % 2 = 1 THEN list(drug_id ORDER BY rank DESC) FILTER (rank <= 2) ELSE list(drug_id ORDER BY rank) FILTER (rank <= 2) END AS items,
 list(drug_id ORDER BY rank) FILTER (rank <> 2) AS visible FROM rk GROUP BY 1),
er AS (SELECT case_id, success, missing, CASE WHEN NOT success THEN ['generation_failed'] WHEN missing THEN ['missing_structured_answer'] ELSE
 list_concat(list_concat(CASE WHEN selected <> items THEN ['selected_drugids_and_items_are_not_aligned'] ELSE [] END,
  list_transform(list_filter(selected, lambda x: NOT list_contains(visible, x)), lambda x: 'unknown_candidate:' || x)),
  flatten(list_transform(items, lambda x: list_filter([CASE WHEN NOT list_contains(visible, x) THEN 'unknown_item_candidate:' || x END, CASE WHEN x % 5 = 0 THEN 'empty_reason:' || x END,
   CASE WHEN x % 3 = 0 THEN 'empty_evidence_ids:' || x END, CASE WHEN x % 3 <> 0 AND x % 4 = 0 THEN 'unknown_evidence:' || x || ':e' || x || '::x' END], lambda e: e IS NOT NULL)))) END AS errors FROM an)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, success, selected, items, visible, visible_evidences); ``items`` is null where there is no answer."""
    x = ranked_items(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "drug_id"))).alias("x"))
    ids = lambda keep: F.transform(F.filter("x", keep), lambda v: v["drug_id"])
    selected = ids(lambda v: v["rank"] <= 2)
    listed = F.when(F.col("case_id") % 2 == 1, F.reverse(selected)).otherwise(selected)
    evidence = lambda d: F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 4 == 0, F.array(F.concat(F.lit("e"), d, F.lit("::x")))).otherwise(F.array(F.concat(F.lit("e"), d)))
    items = F.transform(listed, lambda d: F.struct(d.alias("drug_id"), F.when(d % 5 == 0, " ").otherwise("fits").alias("reason"), evidence(d).alias("evidence_ids")))
    return x.select("case_id", (F.col("case_id") % 7 != 0).alias("success"), selected.alias("selected"), F.when(F.col("case_id") % 11 != 0, items).alias("items"), ids(lambda v: v["rank"] != 2).alias("visible"), F.transform("x", lambda v: F.concat(F.lit("e"), v["drug_id"])).alias("visible_evidences"))


def record_errors() -> Column:
    """Ordered errors of a record: a failed one or one without an answer has that error alone."""
    none = F.array().cast("array<string>")
    error = lambda test, *parts: F.when(test, F.array(F.concat(*parts))).otherwise(none)

    def of_item(i: Column) -> Column:
        d = i["drug_id"]
        unknown = F.transform(F.filter(i["evidence_ids"], lambda e: ~F.array_contains("visible_evidences", e)), lambda e: F.concat(F.lit("unknown_evidence:"), d, F.lit(":"), e))
        return F.concat(error(~F.array_contains("visible", d), F.lit("unknown_item_candidate:"), d), error(T.strip(i["reason"]) == "", F.lit("empty_reason:"), d), error(F.size(i["evidence_ids"]) == 0, F.lit("empty_evidence_ids:"), d), unknown)

    aligned = error(F.col("selected") != F.transform("items", lambda i: i["drug_id"]), F.lit("selected_drugids_and_items_are_not_aligned"))
    candidates = F.transform(F.filter("selected", lambda d: ~F.array_contains("visible", d)), lambda d: F.concat(F.lit("unknown_candidate:"), d))
    checks = F.concat(aligned, candidates, F.flatten(F.transform("items", of_item)))
    return F.when(~F.col("success"), F.array(F.lit("generation_failed"))).when(F.col("items").isNull(), F.array(F.lit("missing_structured_answer"))).otherwise(checks)


@query(f"WITH {RECORDS} SELECT case_id, array_to_string(errors, ';') AS errors FROM er")
def validate_record_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight errors of a generation record, in order."""
    return records(spark, sf_dir).select("case_id", F.array_join(record_errors(), ";").alias("errors"))


_HAS = "len(list_filter(errors, lambda e: starts_with(e, '{}'))) > 0"
RATES = {
    "structure_legal_rate": "len(errors) = 0",
    "field_complete_rate": "success AND NOT missing AND NOT " + _HAS.format("empty_"),
    "selection_alignment_rate": "NOT " + _HAS.format("selected_"),
    "candidate_refs_valid_rate": "NOT " + _HAS.format("unknown_candidate") + " AND NOT " + _HAS.format("unknown_item_candidate"),
    "evidence_refs_valid_rate": "NOT " + _HAS.format("unknown_evidence") + " AND NOT " + _HAS.format("empty_evidence_ids"),
    "reason_fields_valid_rate": "NOT " + _HAS.format("empty_reason"),
}


@query(f"WITH {RECORDS} SELECT count(*) AS n, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(count(*) FILTER (success AND NOT missing) / count(*), 6) AS structured_answer_rate, " + ", ".join(f"round(count(*) FILTER ({test}) / count(*), 6) AS {name}" for name, test in RATES.items()) + " FROM er")
def generation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rates of structure, fields and references; 0 where there are no records."""
    r = records(spark, sf_dir).withColumn("errors", record_errors())
    has = lambda *starts: F.exists("errors", lambda e: F.rlike(e, F.lit("^(" + "|".join(starts) + ")")))
    answered = F.col("success") & F.col("items").isNotNull()
    tests = {
        "success_rate": F.col("success"),
        "structured_answer_rate": answered,
        "structure_legal_rate": F.size("errors") == 0,
        "field_complete_rate": answered & ~has("empty_"),
        "selection_alignment_rate": ~has("selected_"),
        "candidate_refs_valid_rate": ~has("unknown_candidate", "unknown_item_candidate"),
        "evidence_refs_valid_rate": ~has("unknown_evidence", "empty_evidence_ids"),
        "reason_fields_valid_rate": ~has("empty_reason"),
    }
    return r.agg(F.count("*").alias("n"), *[F.round(T.divide(F.count_if(c), F.count("*")), 6).alias(k) for k, c in tests.items()])


@query(f"""WITH {RECORDS}, sel AS (SELECT case_id, unnest(selected) AS drug_id, generate_subscripts(selected, 1) AS place FROM an WHERE success)
SELECT case_id, place, drug_id, p_name AS name FROM sel JOIN part ON drug_id = p_partkey""")
def selected_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected ids joined to their candidates, in the order of selection."""
    chosen = records(spark, sf_dir).filter("success").select("case_id", F.posexplode("selected").alias("i", "drug_id"))
    return chosen.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("name")), "drug_id").select("case_id", (F.col("i") + 1).cast("long").alias("place"), "drug_id", "name")


@query("""WITH x AS (SELECT l_orderkey AS case_id, l_suppkey AS id, l_linenumber AS line, l_partkey AS part FROM lineitem),
k AS (SELECT case_id, id, min({'line': line, 'part': part}) AS first, max({'line': line, 'part': part}) AS last FROM x GROUP BY 1, 2)
SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY first, id) AS place, last.part AS part FROM k""")
def last_write_keeps_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries with one key the last one's value stands at the first one's place."""
    entry = F.struct("l_linenumber", "l_partkey")
    kept = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("id")).agg(F.min(entry).alias("first"), F.max(entry).alias("last"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("first", "id"))
    return kept.select("case_id", "id", place.alias("place"), F.col("last.l_partkey").alias("part"))


@query(f"""WITH {RANKED}, b AS (SELECT case_id, list(drug_id ORDER BY rank) FILTER (drug_id % 4 = 0) AS taken, list(drug_id ORDER BY rank) FILTER (rank <= 3) AS top FROM rk GROUP BY 1)
SELECT case_id, array_to_string(list_concat(coalesce(taken, []), coalesce(top, [])), ',') AS bag, len(list_distinct(list_concat(coalesce(taken, []), coalesce(top, [])))) AS different FROM b""")
def bag_of_taken_and_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medicines taken, then the best candidates; repeats stay."""
    x = ranked_items(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "drug_id"))).alias("x"))
    ids = lambda keep: F.transform(F.filter("x", keep), lambda v: v["drug_id"])
    bag = F.concat(ids(lambda v: v["drug_id"] % 4 == 0), ids(lambda v: v["rank"] <= 3))
    return x.select("case_id", F.array_join(bag.cast("array<string>"), ",").alias("bag"), F.size(F.array_distinct(bag)).cast("long").alias("different"))


@query("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS item, 1 / (1 + exp(-unnest(embedding)::DOUBLE)) AS p FROM embeddings)
SELECT vec_id, item, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 6) DESC, item) AS rank, item % 10 = label AS candidate FROM e""")
def items_by_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each row by falling probability, ties to the smaller item, with the candidate mask in long form."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select("vec_id", "label", (F.col("i") + 1).cast("long").alias("item"), F.round(1 / (1 + F.exp(-F.col("x").cast("double"))), 6).alias("p"))
    return p.select("vec_id", "item", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("p"), "item")).alias("rank"), (F.col("item") % 10 == F.col("label")).alias("candidate"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 8 THEN 0 WHEN o_orderkey % 10 = 8 THEN 1 ELSE 2 END AS part FROM orders)
SELECT id, ['train', 'test', 'eval'][part + 1] AS split, (SELECT count(*) FROM s b WHERE b.part < s.part) + row_number() OVER (PARTITION BY part ORDER BY id) AS place FROM s""")
def split_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, test and eval one after the other, numbered through."""
    from caselode.plans.cases import numbered

    digit = F.col("o_orderkey") % 10
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(digit < 8, 0).when(digit == 8, 1).otherwise(2).alias("part"))
    names = F.array(*[F.lit(x) for x in ("train", "test", "eval")])
    return numbered(rows, ["part", "id"], "place").select("id", names[F.col("part")].alias("split"), "place")


