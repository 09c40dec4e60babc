"""Prompts, resumed generation, validated answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import table

#: A request is a user turn, a record an assistant turn; one in six failed.
REQUESTS = """rq AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'),
rc AS (SELECT conv_id, turn - 1 AS turn, length(text) AS n, conv_id % 6 <> 0 AS success FROM conversations WHERE role = 'assistant')"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("n"), (F.col("conv_id") % 6 != 0).alias("success"))


@query(f"WITH {REQUESTS} SELECT conv_id, turn, n FROM rq WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.success AND rc.conv_id = rq.conv_id AND rc.turn = rq.turn)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a successful record of the same identity."""
    return requests(spark, sf_dir).join(records(spark, sf_dir).filter("success").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


@query(f"WITH {REQUESTS} SELECT conv_id, turn, n, success FROM rc WHERE EXISTS (SELECT 1 FROM rc k WHERE k.success AND k.conv_id = rc.conv_id AND k.turn = rc.turn)")
def preserved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of identities that succeeded, their failed repeats too."""
    r = records(spark, sf_dir)
    return r.join(r.filter("success").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")


@query(f"""WITH {RANKED}, p AS (SELECT case_id, rank, '- [' || drug_id || '] ' || p_name || ' | ' || p_type AS line FROM rk JOIN part ON drug_id = p_partkey WHERE rank <= 3)
SELECT case_id, count(*) AS candidates, length('Case ' || case_id || chr(10) || array_to_string(list(line ORDER BY rank), chr(10))) AS tokens FROM p GROUP BY 1""")
def prompt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of a case's visible candidates; its length in characters is the token estimate."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_name", "p_type")
    line = F.concat(F.lit("- ["), "drug_id", F.lit("] "), "p_name", F.lit(" | "), "p_type")
    rows = ranked_items(spark, sf_dir).filter("rank <= 3").join(parts, "drug_id").select("case_id", "rank", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("case_id").agg(F.count("*").alias("candidates"), lines.alias("l")).select("case_id", "candidates", F.length(F.concat(F.lit("Case "), "case_id", F.lit("\n"), "l")).cast("long").alias("tokens"))


@query("""SELECT event_id, regexp_extract('answer: ' || props || ' end', '\\{.*\\}', 0, 's') AS body, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object inside a reply, and its typed field."""
    reply = F.concat(F.lit("answer: "), "props", F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(reply).alias("body"), F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "k bigint")["k"].alias("k"))


#: An order's answer: its items of rank 1 and 2 are selected; odd orders list them in reverse; orders divisible by 7 failed.
ANSWERS = RANKED + """, an AS (SELECT case_id, case_id % 7 <> 0 AS success, list(drug_id ORDER BY rank) FILTER (rank <= 2) AS selected,
 CASE WHEN case_id % 2 = 1 THEN list(drug_id ORDER BY rank DESC) FILTER (rank <= 2) ELSE list(drug_id ORDER BY rank) FILTER (rank <= 2) END AS items,
 list(drug_id ORDER BY rank) FILTER (rank <> 2) AS visible, list(drug_id ORDER BY rank) FILTER (drug_id % 3 = 0) AS gold FROM rk GROUP BY 1)"""
ERRORS = ANSWERS + """, er AS (SELECT *, CASE WHEN NOT success THEN ['generation_failed'] ELSE
 list_concat(list_concat(CASE WHEN selected <> items THEN ['selected_drugids_and_items_are_not_aligned'] ELSE [] END,
  list_transform(list_filter(selected, lambda x: NOT list_contains(visible, x)), lambda x: 'unknown_candidate:' || x)),
  list_transform(list_filter(items, lambda x: NOT list_contains(visible, x)), lambda x: 'unknown_item_candidate:' || x)) END AS errors FROM an)"""
EVAL = ERRORS + """, ge AS (SELECT case_id, success, len(errors) AS n_errors, CASE WHEN success THEN len(list_intersect(selected, coalesce(gold, []))) ELSE 0 END AS n_hit,
  CASE WHEN success THEN len(selected) ELSE 0 END AS n_pred, len(coalesce(gold, [])) AS n_gold, list_contains(errors, 'selected_drugids_and_items_are_not_aligned') AS misaligned FROM er)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranked_items(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "drug_id"))).alias("x"))
    ids = lambda keep: F.transform(F.filter("x", keep), lambda v: v["drug_id"])
    selected = ids(lambda v: v["rank"] <= 2)
    return x.select("case_id", (F.col("case_id") % 7 != 0).alias("success"), selected.alias("selected"), F.when(F.col("case_id") % 2 == 1, F.reverse(selected)).otherwise(selected).alias("items"), ids(lambda v: v["rank"] != 2).alias("visible"), ids(lambda v: v["drug_id"] % 3 == 0).alias("gold"))


def validation_errors(success: Column, selected: str, items: str, visible: str) -> Column:
    """Ordered errors of an answer; a failed one has that error alone."""
    unknown = lambda ids, name: F.transform(F.filter(ids, lambda x: ~F.array_contains(visible, x)), lambda x: F.concat(F.lit(name + ":"), x))
    none = F.array().cast("array<string>")
    aligned = F.when(F.col(selected) != F.col(items), F.array(F.lit("selected_drugids_and_items_are_not_aligned"))).otherwise(none)
    return F.when(~success, F.array(F.lit("generation_failed"))).otherwise(F.concat(aligned, unknown(selected, "unknown_candidate"), unknown(items, "unknown_item_candidate")))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).withColumn("errors", validation_errors(F.col("success"), "selected", "items", "visible"))


@query(f"WITH {ERRORS} SELECT case_id, array_to_string(errors, ';') AS errors FROM er")
def validate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("case_id", F.array_join("errors", ";").alias("errors"))


@query(f"WITH {ERRORS} SELECT split_part(e, ':', 1) AS error, count(*) AS n FROM (SELECT unnest(errors) AS e FROM er) GROUP BY 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by kind, repeats counted."""
    return validated(spark, sf_dir).select(F.explode("errors").alias("e")).groupBy(F.element_at(F.split("e", ":"), 1).alias("error")).agg(F.count("*").alias("n"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("success"), F.array_distinct("selected")).otherwise(F.array().cast("array<bigint>"))
    v = validated(spark, sf_dir).withColumn("p", predicted)
    n_hit, n_pred, n_gold = F.size(F.array_intersect("p", "gold")), F.size("p"), F.size("gold")
    precision, recall = T.divide(n_hit, n_pred), T.divide(n_hit, n_gold)
    exact = F.sort_array("p") == F.sort_array("gold")
    return v.select("case_id", "success", F.size("errors").alias("n_errors"), precision.alias("precision"), recall.alias("recall"), T.divide(2 * precision * recall, precision + recall).alias("f1"), (n_hit > 0).alias("hit"), exact.alias("exact"), F.array_contains("errors", "selected_drugids_and_items_are_not_aligned").alias("misaligned"))


_RATES = """CASE WHEN n_pred > 0 THEN n_hit / n_pred ELSE 0.0 END AS precision, CASE WHEN n_gold > 0 THEN n_hit / n_gold ELSE 0.0 END AS recall,
 CASE WHEN n_hit > 0 THEN 2.0 * n_hit / (n_pred + n_gold) ELSE 0.0 END AS f1, n_hit > 0 AS hit, n_hit = n_pred AND n_hit = n_gold AS exact, misaligned, success, n_errors"""


@query(f"WITH {EVAL}, r AS (SELECT case_id, {_RATES} FROM ge) SELECT case_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, hit, exact FROM r")
def generation_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer; a failed one predicts nothing, and nothing matches nothing exactly."""
    return evaluated(spark, sf_dir).select("case_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "hit", "exact")


@query(f"""WITH {EVAL}, r AS (SELECT {_RATES} FROM ge) SELECT count(*) AS n, count(*) FILTER (success) AS success, count(*) FILTER (n_errors = 0) AS legal, count(*) FILTER (NOT misaligned) AS aligned,
 count(*) FILTER (hit) AS hit, count(*) FILTER (exact) AS exact, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM r""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    return e.agg(F.count("*").alias("n"), F.count_if("success").alias("success"), F.count_if(F.col("n_errors") == 0).alias("legal"), F.count_if(~F.col("misaligned")).alias("aligned"), F.count_if("hit").alias("hit"), F.count_if("exact").alias("exact"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("precision", "recall", "f1")])


GRID = "gd AS (SELECT v.variant, k.top_k FROM (VALUES ('retrieval_direct'), ('rerank')) v(variant) CROSS JOIN (VALUES (1), (2), (5)) k(top_k))"


@query(f"WITH {RANKED}, {GRID} SELECT variant, top_k, count(*) AS items, count(DISTINCT case_id) AS cases FROM gd JOIN rk ON rank <= top_k AND (variant = 'retrieval_direct' OR drug_id % 2 = 0) GROUP BY 1, 2")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant by top-k runs, six small rows against which items are counted."""
    grid = spark.sql("select v.variant, k.top_k from values ('retrieval_direct'), ('rerank') v(variant) cross join values (1), (2), (5) k(top_k)")
    x = ranked_items(spark, sf_dir).join(F.broadcast(grid), (F.col("rank") <= F.col("top_k")) & ((F.col("variant") == "retrieval_direct") | (F.col("drug_id") % 2 == 0)))
    return x.groupBy("variant", "top_k", "case_id").agg(F.count("*").alias("k")).groupBy("variant", "top_k").agg(F.sum("k").alias("items"), F.count("*").alias("cases"))


@query("SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, '| ' || role || ' | ' || count(*) || ' |' AS line FROM conversations GROUP BY 1")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown line per run."""
    per = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    return per.withColumn("line", F.concat(F.lit("| "), "role", F.lit(" | "), "n", F.lit(" |")))


@query(f"WITH {ERRORS} SELECT case_id, array_to_string(selected, ',') AS selected FROM er WHERE success AND len(errors) = 0 ORDER BY case_id LIMIT 6")
def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six clean answers, for the case report."""
    return validated(spark, sf_dir).filter(F.col("success") & (F.size("errors") == 0)).orderBy("case_id").limit(6).select("case_id", F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"))


@query(f"WITH {ANSWERS} SELECT success, count(*) AS n, sum(len(selected)) AS picked FROM (SELECT success, selected FROM an WHERE success UNION ALL SELECT success, selected FROM an WHERE NOT success) GROUP BY 1")
def preserved_union_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and new records as one result."""
    a = answers(spark, sf_dir).select("success", "selected")
    return a.filter("success").unionByName(a.filter("not success")).groupBy("success").agg(F.count("*").alias("n"), F.sum(F.size("selected")).alias("picked"))

