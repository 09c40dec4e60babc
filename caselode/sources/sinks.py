"""Sinks of cases and results: folders by bucket, results rewritten beside new ones, small JSON and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.sources.tables import read_or_empty, write_jsonl


def write_buckets(df: DataFrame, path: str, by: list[str], rows: int = 1_000_000) -> None:
    """One folder for each bucket; rows keep the task they are in, so a hot bucket gets many files, of ``rows`` rows at most."""
    df.write.option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)


def write_results(new: DataFrame, old_path: str, path: str, identity: list[str], success: str = "success") -> None:
    """Old records of identities that succeeded, then the new records of all others, whole, under a new ``path``.

    An absent ``old_path`` counts as empty.  Identities compare null-safely.
    """
    old = read_or_empty(new.sparkSession, old_path, new.schema)
    done = old.filter(F.col(success)).select(*identity).distinct()
    kept = old.alias("a").join(done.alias("b"), _same(identity), "left_semi")
    write_jsonl(kept.unionByName(new.alias("a").join(done.alias("b"), _same(identity), "left_anti")), path)


def _same(identity: list[str]):
    on = F.lit(True)
    for c in identity:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return on


def json_document(report: DataFrame, key: str) -> DataFrame:
    """One row, ``document``: a report of a few rows by variant as one JSON array in the order of ``key``."""
    held = report.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.struct(*report.columns).alias("row")))).alias("x"))
    return held.select(F.to_json(F.transform("x", lambda r: r["row"]), {"ignoreNullFields": "false"}).alias("document"))


def markdown_lines(report: DataFrame, key: str) -> DataFrame:
    """(place, line): head, rule, then a line for each row by ``key``; doubles as percentages of two digits."""
    cells = [F.when(F.col(c).isNotNull(), F.format_string("%.2f%%", 100 * F.col(c))) if t == "double" else F.col(c).cast("string") for c, t in report.dtypes]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | ", "-"), F.lit(" |"))
    held = report.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), line.alias("line")))).alias("x"))
    head = F.array(F.lit("| " + " | ".join(report.columns) + " |"), F.lit("| " + " | ".join("---" for _ in report.columns) + " |"))
    return held.select(F.posexplode(F.concat(head, F.transform("x", lambda r: r["line"]))).alias("place", "line"))
