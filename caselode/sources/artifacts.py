"""Exports of encoded tables with a manifest that tells whether they are still those of their inputs.

Each part is written in one pass, which counts its rows on the way.  The manifest is written last: an export without one
isn't complete.  Inputs are known by their contents, whatever the order or the files of their rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StaleExportError(ValueError):
    """An export that is incomplete, or whose inputs have changed."""


def fingerprint(rows: DataFrame) -> dict[str, str]:
    """Row count, and sum and exclusive or of the rows' hashes."""
    hashed = F.xxhash64(*rows.columns)
    got = rows.select(hashed.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor")).first()
    return {"columns": ",".join(f"{n}:{t}" for n, t in rows.dtypes), "rows": str(got.rows), "sum": str(got["sum"]), "xor": str(got.xor)}


def write_export(parts: dict[str, tuple[DataFrame, dict[str, Column]]], inputs: dict[str, DataFrame], path: str) -> dict:
    """Write each part, (rows, what to count of them), below ``path``, then the manifest, which is returned."""
    spark = next(iter(inputs.values())).sparkSession
    manifest = {"inputs": {n: fingerprint(df) for n, df in inputs.items()}, "parts": {}}
    for name, (rows, counts) in parts.items():
        seen = Observation()
        rows.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in counts.items()]).write.parquet(f"{path}/{name}")
        manifest["parts"][name] = seen.get
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise StaleExportError(f"no complete export at {path}")
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def load_export(spark: SparkSession, path: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The parts of an export, if its inputs are what they were and its parts have the rows that were counted."""
    manifest = read_manifest(spark, path)
    found = {n: fingerprint(df) for n, df in inputs.items()}
    if changed := sorted(n for n in found.keys() | manifest["inputs"].keys() if found.get(n) != manifest["inputs"].get(n)):
        raise StaleExportError(f"changed since the export: {', '.join(changed)}")
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["parts"]}
    for name, rows in parts.items():
        if (n := rows.count()) != manifest["parts"][name]["rows"]:
            raise StaleExportError(f"{name} has {n} rows; {manifest['parts'][name]['rows']} were written")
    return parts
