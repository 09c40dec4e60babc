"""Reading tables and the role views that case records take on them; reading and writing JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None, seq: str = "seq") -> DataFrame:
    """JSON lines with a declared schema; a bad line fails.  ``limit`` takes the first rows by the stored ``seq``."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.orderBy(seq).limit(limit) if limit is not None else rows


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8 that keep null fields."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of ``path``, or none where it doesn't exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


def last_by_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by ``seq``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), seq).alias("_r")).select(key, "_r.*")


def case_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, drug_id, first_line): an order's parts in order, each once."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("drug_id")).agg(F.min("l_linenumber").alias("first_line"))


def case_symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("symptom")).distinct()


def case_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("case_id"), F.col("p_brand").alias("diagnosis")).distinct()
