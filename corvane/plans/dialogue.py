"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialogue as D
from ..sources.views import view, with_views
from .registry import query
from .retrieval import SIM, vectors, wanted

V = with_views("turns")
TOK = "CAST((strlen(text) + 3) // 4 AS BIGINT)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "turns")


@query(f"{V} SELECT thread_id, count(DISTINCT session_id) AS sessions, count(*) AS turns FROM turns GROUP BY 1")
def thread_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.thread_list(turns(spark, sf_dir))


@query(f"{V} SELECT id, turn, role FROM turns WHERE session_id = 3 ORDER BY turn, id LIMIT 500")
def session_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.session_turns(turns(spark, sf_dir), 3).select("id", "turn", "role")


@query(f"{V} SELECT session_id, count(*) AS turns, coalesce(max(CASE WHEN turn = 0 THEN role END), '') AS label FROM turns WHERE thread_id = 2 GROUP BY 1")
def thread_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    found = turns(spark, sf_dir).where("thread_id = 2").groupBy("session_id")
    return found.agg(F.count("*").alias("turns"), F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("role"))), F.lit("")).alias("label"))


CUT = "CASE WHEN length(text) > 200 THEN concat(left(text, 197), '...') ELSE text END"


@query(f"{V}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, id) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM turns), m AS (SELECT *, rn > 1 AND rn < n AND file_id % 3 = 0 AS middle FROM p), k AS (SELECT *, sum(middle::INT) OVER (PARTITION BY session_id ORDER BY rn) AS k FROM m) SELECT session_id, string_agg({CUT}, chr(10) ORDER BY rn) AS digest FROM k WHERE rn = 1 OR rn = n OR (middle AND k <= 10) GROUP BY 1")
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.digests(turns(spark, sf_dir).withColumn("anchored", F.col("file_id") % 3 == 0))


@query(f"{V}, r AS (SELECT file_id, id, {TOK} AS tokens, row_number() OVER (PARTITION BY file_id ORDER BY turn DESC, id) AS rn, sum({TOK}) OVER (PARTITION BY file_id ORDER BY turn DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM turns) SELECT file_id, id, tokens, CAST(used AS BIGINT) AS used FROM r WHERE rn <= 20 AND used <= 300")
def turns_for_files_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("tokens", T.estimate_tokens(F.col("text")))
    return D.within_budget(t, "file_id", [F.desc("turn"), "id"], "tokens", 300).select("file_id", "id", "tokens", "used")


@query(f"{with_views('turns', 'files')} SELECT DISTINCT t.id, t.session_id, t.thread_id, f.path FROM turns t JOIN files f ON f.id = t.file_id WHERE f.id IN (3, 17, 42)")
def turns_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    files = view(spark, sf_dir, "files").where(F.col("id").isin(3, 17, 42)).select(F.col("id").alias("file_id"), "path")
    return turns(spark, sf_dir).join(files, "file_id").select("id", "session_id", "thread_id", "path").distinct()


@query(f"{V}, w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS name FROM turns), n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT 'the') SELECT id, name FROM w WHERE name IN (SELECT name FROM n) AND length(name) >= 3")
def auto_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.lower(F.split("p_name", " ")[0]).alias("name")).unionByName(spark.range(1).select(F.lit("the").alias("name"))).distinct()
    return D.auto_anchors(turns(spark, sf_dir), names)


@query(f"{V}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT t.id, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 4) AS similarity FROM turns t JOIN embeddings e ON e.vec_id = t.file_id, q ORDER BY similarity DESC, t.id LIMIT 20")
def turn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors have unit length, and a turn's is that of its file."""
    from ..functions.vectors import dot

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("file_id"), "embedding")
    q = F.array(*[F.lit(float(x)) for x in e.where("file_id = 0").first().embedding])
    found = turns(spark, sf_dir).join(e, "file_id").select("id", F.round(dot(F.col("embedding"), q), 4).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "id").limit(20)


@query("SELECT event_id AS id, event_type AS status FROM events WHERE event_type = 'purchase' AND user_id = 7 ORDER BY ts, event_id LIMIT 500")
def handoff_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.where("event_type = 'purchase' AND user_id = 7").orderBy("ts", "event_id").limit(500).select(F.col("event_id").alias("id"), F.col("event_type").alias("status"))


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no vector yet."""
    d, e = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return d.join(e, d["doc_id"] == e["vec_id"], "left_anti").select(F.col("doc_id").alias("id"))


@query("SELECT doc_id AS id, source FROM documents ORDER BY doc_id DESC LIMIT 50")
def observations_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    return D.listed_observations(view(spark, sf_dir, "observations"), 50)


@query(f"SELECT k.id, d.source, k.similarity FROM (SELECT e.vec_id AS id, {SIM} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id IN (SELECT doc_id FROM documents) ORDER BY 2 DESC, 1 LIMIT 30) k JOIN documents d ON d.doc_id = k.id")
def observations_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 with a query."""
    return D.listed_observations(view(spark, sf_dir, "observations"), 30, vectors(spark, sf_dir), wanted(spark, sf_dir))
