"""Shared folder, written stages and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from caselode.sources.shipping import ship

__all__ = ["bucketed", "drop_written", "kept", "new_path", "shared_dir", "ship", "table", "written"]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, in local mode only: on a cluster a
    machine-local folder would lose rows, so that raises instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="caselode-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/caselode/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` in the shared folder as a table bucketed by ``key``: joins on the key leave its rows where they are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    named = f"caselode_{path.rsplit('-', 1)[1]}"
    df.write.option("path", path).option("compression", "zstd").option("parquet.enable.dictionary", "false").bucketBy(min(buckets, 100_000), key).saveAsTable(named)
    return spark.table(named)


def kept(df: DataFrame) -> DataFrame:
    """Keep ``df`` on executors' disks while several jobs read it.  Its lineage stays, so lost parts are made again."""
    return df.persist(StorageLevel.DISK_ONLY)


def drop_written(df_or_path, spark: SparkSession) -> None:
    """Delete a written stage that no later step reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    for p in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
