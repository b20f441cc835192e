"""Telemetry queries (A6, A7), and windowed ones that Spark adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import view, with_views
from .registry import query

LAYERS = ["retrieval", "cache", "compression", "shell_filtering", "ccr"]
LAYER = "CASE WHEN layer IN ('retrieval', 'cache', 'compression', 'shell_filtering', 'ccr') THEN layer WHEN cache_hit THEN 'cache' ELSE 'unknown' END"
SUMS = "count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens_sent, CAST(sum(tokens * 3) AS BIGINT) AS tokens_saved, round(avg(latency_ms), 6) AS latency, count(*) FILTER (cache_hit) AS hits, round(100.0 * sum(tokens * 3) / sum(tokens * 4), 6) AS reduction, round(100.0 * count(*) FILTER (cache_hit) / count(*), 6) AS hit_rate"


def sums() -> list[Column]:
    """Counts, sums, averages and guarded shares."""
    saved, base = F.sum(F.col("tokens") * 3), F.sum(F.col("tokens") * 4)
    hits = F.count_if("cache_hit")
    return [F.count("*").alias("requests"), F.sum("tokens").alias("tokens_sent"), saved.alias("tokens_saved"), F.round(F.avg("latency_ms"), 6).alias("latency"), hits.alias("hits"), F.round(F.try_divide(F.lit(100.0) * saved, base), 6).alias("reduction"), F.round(F.try_divide(F.lit(100.0) * hits, F.count("*")), 6).alias("hit_rate")]


def layer() -> Column:
    """The known layer, else cache for a hit, else unknown."""
    return F.when(F.col("layer").isin(LAYERS), F.col("layer")).when(F.col("cache_hit"), "cache").otherwise("unknown")


@query(f"{with_views('telemetry')} SELECT {SUMS} FROM telemetry")
def telemetry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "telemetry").agg(*sums())


@query(f"{with_views('telemetry')} SELECT {LAYER} AS known_layer, {SUMS} FROM telemetry GROUP BY 1")
def telemetry_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "telemetry").groupBy(layer().alias("known_layer")).agg(*sums())


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def telemetry_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: tumbling hours in event time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, count(*) AS n FROM s GROUP BY user_id, k")
def watch_debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-10: bursts of events of a user with less than six hours between them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "n")
