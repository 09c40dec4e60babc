"""The case report: the first clean answers of all runs, with their cases, as the lines of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The document's head, and its line where no answer is clean.
HEAD = ["# RAG 案例分析", "", "以下内容来自当前小样本验证，可直接作为论文案例分析草稿。", ""]
NONE = ["- 当前小样本验证未筛出可用案例，请增大 `--limit` 后重跑。", ""]


def selected_records(records: DataFrame, cases: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` records, one for each patient, cut and variant, that succeeded without errors and whose case is there.

    ``records`` (run, variant, top_k, seq, patient_id, success, errors, ...): runs in their order, records in theirs.
    ``cases`` (patient_id, ...); of cases with one id any row counts, so they should be unique.  Adds ``place`` from 1.
    """
    clean = records.filter(F.col("success") & (F.size("errors") == 0)).join(cases.select("patient_id"), "patient_id", "left_semi")
    first = Window.partitionBy("patient_id", "top_k", "variant").orderBy("run", "seq")
    once = clean.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    few = once.orderBy("run", "seq", "patient_id").limit(most)
    # A handful of rows, numbered in one task.
    return few.withColumn("place", F.row_number().over(Window.orderBy("run", "seq", "patient_id"))).join(cases, "patient_id")


def listed(items: Column, separator: str = ", ") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, separator)).otherwise("None")


def case_report(selected: DataFrame) -> DataFrame:
    """(place, line) of the document over ``selected`` records, which have ``age, gender, diagnosis, symptom, on_medicine, gold``
    of their case and ``selected`` and ``items`` (drugid, evidence_ids, reason) of their answer; ids are text."""
    hits = F.filter("selected", lambda d: F.array_contains("gold", d))
    fixed = F.array(
        F.concat(F.lit("## 案例 "), "place"),
        F.concat(F.lit("- 实验组：`"), "variant", F.lit("` / `top"), "top_k", F.lit("`")),
        F.concat(F.lit("- patient_id：`"), "patient_id", F.lit("`")),
        F.concat(F.lit("- 患者摘要："), "age", F.lit(" 岁，"), "gender", F.lit("；诊断="), listed(F.col("diagnosis")), F.lit("；症状="), listed(F.col("symptom")), F.lit("；当前用药="), listed(F.col("on_medicine"))),
        F.concat(F.lit("- 预测药物："), listed(F.col("selected"))),
        F.concat(F.lit("- 命中 gold："), listed(hits)),
    )
    reasons = F.transform("items", lambda x, i: F.concat(F.lit("- 解释 "), (i + 1).cast("string"), F.lit("：drugid="), x["drugid"], F.lit("；证据="), F.array_join(x["evidence_ids"], ", "), F.lit("；理由="), x["reason"]))
    held = selected.select("place", F.concat(fixed, reasons, F.array(F.lit(""))).alias("lines")).agg(F.array_sort(F.collect_list(F.struct("place", "lines"))).alias("x"))
    texts = lambda lines: F.array(*map(F.lit, lines))
    body = F.when(F.size("x") > 0, F.flatten(F.transform("x", lambda r: r["lines"]))).otherwise(texts(NONE))
    return held.select(F.posexplode(F.concat(texts(HEAD), body)).alias("place", "line"))
