"""Extras that the reference does not have: its batch results as a stream's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.plans.registry import query
from caselode.sources.tables import table
from caselode.streaming.generation import parsed_records
from caselode.streaming.windows import remaining, windowed_counts


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums; the same function runs on a stream with a watermark."""
    return windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.value > 50 AND d.user_id = e.user_id AND d.event_type = e.event_type)")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user and type have no finished event yet: what a resumed stream hands on, here of the batch table."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return remaining(events, events.filter("value > 50"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("""WITH r AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'no object' ELSE 'answer: ' || props || ' end' END AS reply, CASE WHEN event_type = 'error' THEN 'HTTP 500' END AS error FROM events),
p AS (SELECT event_id, event_type, coalesce(error, CASE WHEN reply IS NULL THEN 'no_reply' WHEN NOT contains(reply, '{') THEN 'decode_error' END) AS error_message, regexp_extract(reply, '\\{.*\\}') AS body FROM r)
SELECT event_type, coalesce(error_message, '') AS error_message, count(*) AS n, coalesce(sum(CASE WHEN error_message IS NULL THEN json_extract_string(body, '$.k')::BIGINT END), 0)::BIGINT AS total FROM p GROUP BY 1, 2""")
def generation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies parsed, with failures as records of their own, by kind."""
    key = F.col("event_id")
    reply = F.when(key % 11 == 0, None).when(key % 7 == 0, "no object").otherwise(F.concat(F.lit("answer: "), "props", F.lit(" end")))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", reply.alias("reply"), F.when(F.col("event_type") == "error", "HTTP 500").alias("error"))
    found = parsed_records(rows, "k bigint")
    return found.groupBy("event_type", F.coalesce("error_message", F.lit("")).alias("error_message")).agg(F.count("*").alias("n"), F.coalesce(F.sum("parsed_answer.k"), F.lit(0)).alias("total"))
