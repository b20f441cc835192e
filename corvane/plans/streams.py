"""Queries that run a stream through and return its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import twins
from .registry import query


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.drained(twins.hourly(twins.event_stream(spark, sf_dir)), "complete").withColumn("total", F.round("total", 4))


@query("SELECT user_id AS stream, event_id % 100 AS entity, arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END, (ts, event_id)) AS op, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = twins.event_stream(spark, sf_dir).select(F.col("user_id").alias("stream"), (F.col("event_id") % 100).alias("entity"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "event_id", "ts")
    return twins.drained(twins.journal_fold(e), "complete")


@query("SELECT event_id % 50 AS stream, event_id // 50 + 1 + CASE WHEN event_id % 50 = 7 AND event_id >= 107 THEN 1 ELSE 0 END AS sequence, CASE WHEN event_id % 50 = 7 AND event_id >= 107 THEN 'conflict' ELSE 'applied' END AS status FROM events")
def journal_apply_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    gap = F.when((n % 50 == 7) & (n >= 107), 1).otherwise(0)
    e = twins.event_stream(spark, sf_dir).select((n % 50).alias("stream"), (F.floor(n / 50) + 1 + gap).cast("long").alias("sequence"))
    return twins.drained(twins.apply_batches(e), "append")
