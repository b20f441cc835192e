"""Queries on the event journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journal as J
from ..sources.views import view, with_views
from .registry import query

V = with_views("journal")
FOLD = "fold AS (SELECT stream, entity, max(sequence) AS sequence, arg_max(op, sequence) AS op, arg_max(digest, sequence) AS digest FROM journal GROUP BY 1, 2)"


@query(f"{V}, {FOLD} SELECT stream, entity, CAST(sequence AS INTEGER) AS sequence, digest FROM fold WHERE op <> 'delete'")
def journal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.folded(view(spark, sf_dir, "journal"))


@query(f"{V}, {FOLD} SELECT stream, entity, CAST(sequence AS INTEGER) AS sequence FROM fold WHERE op = 'delete'")
def journal_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.tombstones(view(spark, sf_dir, "journal"))


@query(f"{V}, m AS (SELECT stream, sequence, sequence - lag(sequence) OVER (PARTITION BY stream ORDER BY sequence) AS step FROM journal WHERE entity <> 13) SELECT stream, count(*) AS events, CAST(min(sequence) AS INTEGER) AS first, CAST(max(sequence) + 1 AS INTEGER) AS next, count(*) FILTER (step <> 1) AS gaps FROM m GROUP BY 1")
def journal_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.contiguity(view(spark, sf_dir, "journal").where("entity <> 13"))


@query(f"{V} SELECT stream, CAST((sequence - 1) // 10 AS BIGINT) AS chunk, count(*) AS events, CAST(min(sequence) AS INTEGER) AS first, CAST(max(sequence) AS INTEGER) AS last FROM journal GROUP BY 1, 2")
def journal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.chunks(view(spark, sf_dir, "journal"), 10)


@query(f"{V} SELECT stream, CAST(sequence AS INTEGER) AS sequence, op, entity FROM journal WHERE sequence > 5 AND sequence <= 12")
def journal_read_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.after(view(spark, sf_dir, "journal"), 5, 7).select("stream", "sequence", "op", "entity")


@query(f"{V}, {FOLD} SELECT stream, sha256(string_agg(concat(CAST(entity AS VARCHAR), ':', digest), '|' ORDER BY entity)) AS manifest FROM fold WHERE op <> 'delete' GROUP BY 1")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.manifests(J.folded(view(spark, sf_dir, "journal")))


@query(f"{V}, b AS (SELECT stream, min(sequence) AS first, max(sequence) AS last, count(*) AS n FROM journal WHERE sequence > 3 AND NOT (stream % 5 = 0 AND sequence = 5) GROUP BY 1) SELECT stream, CASE WHEN last - first + 1 <> n THEN 'cursor_conflict' WHEN first = CASE stream % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1000 END + 1 THEN 'applied' WHEN stream % 4 = 2 THEN 'duplicate' WHEN stream % 4 = 3 THEN 'idempotency_conflict' ELSE 'cursor_conflict' END AS status FROM b")
def journal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "journal").where("sequence > 3 AND NOT (stream % 5 = 0 AND sequence = 5)")
    known = events.groupBy("stream").agg(F.xxhash64(F.array_sort(F.collect_list("event_id"))).alias("k"))
    r = F.col("stream") % 4
    cursors = known.select("stream", F.when(r == 0, 3).when(r == 1, 2).otherwise(1000).alias("cursor"), F.when(r == 3, F.col("k") + 1).otherwise(F.col("k")).alias("known"))
    return J.applied(events, cursors)


@query("WITH RECURSIVE e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_id % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'complete' WHEN 2 THEN 'claim' ELSE CASE WHEN event_id % 20 = 3 THEN 'cancel' ELSE 'complete' END END AS action, concat('agent', event_id % 3) AS actor FROM events), r AS (SELECT DISTINCT id, 0::BIGINT AS k, 'pending' AS state, '' AS agent FROM e UNION ALL SELECT r.id, e.k, CASE WHEN action = 'claim' AND state = 'pending' THEN 'claimed' WHEN action = 'complete' AND state = 'claimed' AND agent = actor THEN 'completed' WHEN action = 'cancel' AND state IN ('pending', 'claimed') THEN 'cancelled' ELSE state END, CASE WHEN action = 'claim' AND state = 'pending' THEN actor ELSE agent END FROM r JOIN e ON e.id = r.id AND e.k = r.k + 1) SELECT id, arg_max(state, k) AS state, arg_max(agent, k) AS agent FROM r GROUP BY 1")
def handoff_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 4
    action = F.when(m.isin(0, 2), "claim").when((m == 3) & (F.col("event_id") % 20 == 3), "cancel").otherwise("complete")
    events = e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("sequence"), action.alias("action"), F.concat(F.lit("agent"), F.col("event_id") % 3).alias("actor"))
    return J.handoff_states(events)


@query("SELECT user_id % 50 AS key, min(event_id) AS event_id FROM events GROUP BY 1")
def idempotent_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("key"), "event_id")
    return J.first_of_key(e, "key", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'quarantined' WHEN event_id % 4 = 0 THEN 'duplicate' ELSE 'accepted' END AS status FROM events")
def remote_ingest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-9: every ninth event names another repository than its stream's; every fourth is there already."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    repository = F.when(F.col("event_id") % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    events = e.select("event_id", F.col("user_id").alias("stream"), repository.alias("repository"))
    return J.ingested(events, e.select(F.col("user_id").alias("stream"), F.col("user_id").alias("repository")), e.where("event_id % 4 = 0").select("event_id"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS seq FROM events WHERE event_type <> 'view' AND user_id % 6 > 0 GROUP BY 1, 2), l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY seq) AS lines FROM f GROUP BY 1) SELECT b.user_id AS batch, CASE WHEN b.user_id % 5 >= 3 THEN 'quarantined' WHEN lines IS NULL THEN 'acknowledged' ELSE 'claimed' END AS status, CAST(CASE WHEN b.user_id % 5 >= 3 OR lines IS NULL THEN 0 ELSE b.user_id % 5 + 1 END AS INTEGER) AS attempt, CASE WHEN b.user_id % 5 >= 3 OR lines IS NULL THEN '' ELSE lines END AS lines FROM (SELECT DISTINCT user_id FROM events) b LEFT JOIN l USING (user_id)")
def pending_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-12: a user's events are a batch's lines; views, and all of every sixth user's, are blank."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when((F.col("event_type") == "view") | (F.col("user_id") % 6 == 0), "").otherwise(F.col("event_type"))
    pending = e.select(F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), line.alias("line"))
    attempts = e.select(F.col("user_id").alias("batch"), (F.col("user_id") % 5).cast("int").alias("attempts")).distinct()
    return J.claimed(pending, attempts).withColumn("lines", F.array_join("lines", ","))
