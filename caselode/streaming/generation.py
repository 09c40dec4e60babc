"""Generation as a resumable stream: requests come in micro-batches, replies are parsed, failures stay as records of their own.

A batch's records are written to a folder of its number, anew where the batch is run again, so that a stream that stops
anywhere and starts again has each request once.  Requests whose identity has succeeded in earlier batches are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType

from caselode.functions import text as T

#: Why a record has no answer.
NO_REPLY, NOT_JSON = "no_reply", "decode_error"


def parsed_records(replies: DataFrame, answer: DataType | str, reply: str = "reply", error: str = "error") -> DataFrame:
    """``replies`` with ``success``, ``error_message`` and ``parsed_answer``: the typed object from the first brace to the last.

    A call's own ``error`` comes first; then a missing reply; then one without an object of this kind.
    """
    found: Column = F.from_json(T.json_object(reply), answer, {"mode": "PERMISSIVE"})
    blank = F.coalesce(T.strip(reply) == "", F.lit(True))
    # Of text that isn't an object, every field is null; an object may leave some out.
    empty = F.coalesce(F.to_json(found) == "{}", F.lit(True)) & (T.json_object(reply) != "{}")
    why = F.when(F.col(error).isNotNull(), F.col(error)).when(blank, NO_REPLY).when(empty, NOT_JSON)
    return replies.withColumn("error_message", why).withColumn("success", F.col("error_message").isNull()).withColumn("parsed_answer", F.when(F.col("success"), found))


def generate_stream(requests: DataFrame, call: Callable[[DataFrame], DataFrame], answer: DataType | str, identity: list[str], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; ``call`` adds ``reply`` and ``error`` to a batch of requests.  Identities aren't null.

    Records lie below ``path`` as ``batch=<number>``.
    """

    def each(batch: DataFrame, number: int) -> None:
        done = succeeded(batch, path, identity, number)
        pending = batch if done is None else batch.join(done, identity, "left_anti")
        once = pending.dropDuplicates(identity)
        parsed_records(call(once), answer).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def succeeded(batch: DataFrame, path: str, identity: list[str], before: int) -> DataFrame | None:
    """Identities that succeeded in batches before this one; None where nothing has been written."""
    spark = batch.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if before == 0 or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).filter((F.col("batch") < before) & F.col("success")).select(*identity).distinct()
