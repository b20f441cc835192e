"""Logical tables over the star schema: each view is a DataFrame here and the same SQL for cross-checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: How many files there are; what speaks of a file by number is dealt out over all of them.
N_FILES = "(SELECT count(*) FROM documents)"

#: The views, in SQL that Spark and DuckDB read alike.
VIEWS = {
    "files": "SELECT doc_id AS id, concat(source, '/', lang, '/', CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END, 'doc_', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, lang AS language, text AS content FROM documents",
    "symbols": f"SELECT p_partkey AS id, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 40 AS VARCHAR(20))) AS name, lower(p_type) AS kind, p_partkey % {N_FILES} AS file_id, CAST((p_partkey % 200) * 5 + 1 AS INT) AS start_line, CAST((p_partkey % 200) * 5 + 1 + p_size AS INT) AS end_line, concat(replace(p_name, ' ', '_'), '(', p_brand, ')') AS signature, CASE WHEN p_partkey % 9 > 0 THEN replace(p_brand, '#', '') END AS owner, p_size % 5 - 1 AS arity FROM part",
    "edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE WHEN (a.l_partkey + b.l_partkey) % 3 = 0 THEN 'calls' ELSE 'imports' END AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_returnflag = 'R' AND b.l_linestatus = 'F'",
    "file_edges": f"SELECT DISTINCT src % {N_FILES} AS src, dst % {N_FILES} AS dst FROM (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_returnflag = 'R' AND b.l_linestatus = 'F') e",
    "hunks": f"SELECT o_orderkey AS id, o_orderkey % {N_FILES} AS file_id, CAST(o_orderkey % 900 + 1 AS INT) AS start_line, CAST(o_orderkey % 900 + 1 + o_custkey % 20 AS INT) AS end_line, o_custkey % 25 AS revision FROM orders",
    "calls": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % {N_FILES} AS file_id, CAST(l_partkey % 1000 AS INT) AS line, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 40 AS VARCHAR(20))) AS callee, CASE l_linenumber WHEN 2 THEN 'this' WHEN 3 THEN concat('Brand', CAST(l_suppkey % 25 + 1 AS VARCHAR(20))) WHEN 4 THEN concat('brand', CAST(l_suppkey % 25 + 1 AS VARCHAR(20))) WHEN 5 THEN 'Self' ELSE '' END AS qualifier, CAST(l_quantity AS INT) % 5 - 1 AS argument_count, CASE WHEN l_suppkey % 4 > 0 THEN concat('Brand', CAST(l_suppkey % 25 + 1 AS VARCHAR(20))) END AS caller_owner, CASE WHEN l_linenumber = 6 THEN l_partkey ELSE -1 END AS caller FROM lineitem JOIN part ON p_partkey = l_partkey",
    "observations": "SELECT doc_id AS id, text AS content, 0.25 * (doc_id % 12) AS authority, source, lang FROM documents",
    "turns": f"SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 16 AS thread_id, turn, role, text, (conv_id * 7 + turn) % {N_FILES} AS file_id FROM conversations",
    "telemetry": "SELECT event_id AS id, event_type AS kind, CAST(floor(value * 10) AS BIGINT) AS latency_ms, user_id, user_id % 3 = 0 AS cache_hit, CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'cache' WHEN 'purchase' THEN 'compression' ELSE 'custom' END AS layer, event_id % 1000 AS tokens FROM events",
    "journal": "SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id % 100 AS entity, sha256(CAST(event_id AS VARCHAR(20))) AS digest, event_id FROM events",
    "capabilities": "SELECT s_suppkey AS id, s_nationkey AS repository, s_nationkey % 5 AS context, l_partkey AS part, l_returnflag AS flag, CAST(l_quantity AS INT) AS quantity FROM supplier JOIN lineitem ON l_suppkey = s_suppkey",
}


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """The Parquet tables of ``sf_dir`` as temporary views."""
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


TABLES = ("supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def n_files(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table; lazily planned, so that unused columns never leave the scan."""
    register(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])])
    sql = VIEWS[name]
    if N_FILES in sql:  # a count that Parquet footers answer; as a literal it keeps plans plain
        sql = sql.replace(N_FILES, f"{n_files(spark, sf_dir)}L")
    sql = sql.replace("VARCHAR(20)", "STRING").replace("sha256(", "sha2(").replace("AS STRING)) AS digest", "AS STRING), 256) AS digest")
    return spark.sql(sql)


def with_views(*names: str) -> str:
    """The WITH clause of these views for a SQL cross-check."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
