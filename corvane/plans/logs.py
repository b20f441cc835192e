"""Queries on command output, packing and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import logs as L
from ..operators import pack as P
from .registry import query

LINE = "concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'Warning' ELSE 'note' END, ': user ', CAST(user_id AS VARCHAR), ' k ', CAST(event_id % 7 AS VARCHAR))"
LEVEL = "CASE WHEN regexp_matches(lower(line), 'fatal|panic') THEN 'fatal' WHEN regexp_matches(lower(line), 'error|exception|failed|failure|can''t |cannot ') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn' WHEN contains(lower(line), 'debug') THEN 'debug' WHEN contains(lower(line), 'trace') THEN 'trace' WHEN regexp_matches(lower(line), 'info|started |consumed ') THEN 'info' ELSE 'other' END"
MESSAGE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[0-9]...-..-.. [^ ]* ', ''), '^.{0,79}?: ', ''), '\\b[0-9]+\\b', '#', 'g'), '\\s+', ' ', 'g'))"
TOK = "CAST((strlen(text) + 3) // 4 AS BIGINT)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    word = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "INFO").when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "purchase", "Warning").otherwise("note")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), word, F.lit(": user "), F.col("user_id").cast("string"), F.lit(" k "), (F.col("event_id") % 7).cast("string"))
    return e.select("event_id", line.alias("line"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(f"SELECT {LEVEL} AS level, count(*) AS n FROM (SELECT {LINE} AS line FROM events) GROUP BY 1")
def log_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.level_histogram(lines(spark, sf_dir))


@query(f"SELECT {LEVEL} AS level, {MESSAGE} AS message, count(*) AS n FROM (SELECT {LINE} AS line FROM events) GROUP BY 1, 2 HAVING count(*) >= 2")
def log_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeats(lines(spark, sf_dir))


@query("WITH l AS (SELECT source AS file, doc_id * 10000 + generate_subscripts(string_split(text, chr(10)), 1) AS number, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT file, number FROM l WHERE contains(line, 'License')), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY number) AS rn, count(*) OVER (PARTITION BY file) AS total FROM m) SELECT file, number, total FROM r WHERE rn <= 5")
def grep_per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = docs(spark, sf_dir).where(F.contains("text", F.lit("License"))).select(F.col("source").alias("file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.contains("line", F.lit("License")))
    return L.matches_by_file(each.select("file", (F.col("doc_id") * 10000 + F.col("n") + 1).alias("number")), 5).select("file", "number", "total")


@query("WITH d AS (SELECT concat('src/f', CAST(user_id % 9 AS VARCHAR), '.ts') AS file, concat('TS', CAST(event_id % 5 AS VARCHAR)) AS code, CASE WHEN event_id % 3 = 0 THEN 'warning' ELSE 'error' END AS severity FROM events WHERE event_type = 'error') SELECT file, code, severity, count(*) AS n FROM d GROUP BY 1, 2, 3")
def diagnostics_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    kind = F.when(F.col("event_id") % 3 == 0, "warning").otherwise("error")
    file, code = F.concat(F.lit("src/f"), F.col("user_id") % 9, F.lit(".ts")), F.concat(F.lit("TS"), F.col("event_id") % 5)
    tsc = F.concat(file, F.lit("(1,2): "), kind, F.lit(" "), code, F.lit(": text"))
    lint = F.concat(file, F.lit(":1:2: "), kind, F.lit(": text ["), code, F.lit("]"))
    return L.diagnostics(e.select(F.when(F.col("event_id") % 2 == 0, tsc).otherwise(lint).alias("line")))


@query("SELECT count(*) FILTER (event_type = 'click') AS added, count(*) FILTER (event_type = 'error') AS removed, count(*) FILTER (event_type IN ('view', 'purchase')) AS changed FROM events")
def package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    word = F.when(F.col("event_type") == "click", "added a@1").when(F.col("event_type") == "error", "removed b@2").when(F.col("event_type") == "view", "changed c@3").when(F.col("event_type") == "purchase", "updated d@4").otherwise("done")
    return L.package_counts(e.select(word.alias("line")))


@query(f"WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, text, array_to_string(l[1:2], chr(10)) AS t2, array_to_string(l[1:5], chr(10)) AS t5, array_to_string(l[1:9], chr(10)) AS t9 FROM s) SELECT doc_id, {TOK} > 400 AS changed, length(CASE WHEN {TOK} <= 400 THEN text WHEN {TOK.replace('text', 't9')} <= 400 THEN t9 WHEN {TOK.replace('text', 't5')} <= 400 THEN t5 WHEN {TOK.replace('text', 't2')} <= 400 THEN t2 ELSE left(text, 1600) END) AS kept FROM c")
def output_tightened(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = L.tightened(docs(spark, sf_dir).select("doc_id", "text"), [2, 5, 9], 400)
    return cut.select("doc_id", "changed", F.length("output").cast("long").alias("kept"))


@query(f"WITH r AS (SELECT source AS query, doc_id AS id, {TOK} AS body_tokens, 20::BIGINT AS signature_tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), z AS (SELECT *, CASE WHEN rank <= 10 THEN least(body_tokens, 181) ELSE signature_tokens END AS tokens FROM r WHERE rank <= 20), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM z) SELECT query, id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 10 THEN 'body' ELSE 'signature' END AS form, tokens, CAST(used AS BIGINT) AS used FROM u WHERE used <= CASE WHEN rank <= 10 THEN 1800 ELSE 2000 END")
def capsule_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = docs(spark, sf_dir).select(F.col("source").alias("query"), F.col("doc_id").alias("id"), T.estimate_tokens(F.col("text")).alias("body_tokens"), F.lit(20).cast("long").alias("signature_tokens"))
    return P.capsule(r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id"))), 2000)


@query()
def augment_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision depends on those before, so SQL can't say it; tests hold it against a plain loop."""
    r = docs(spark, sf_dir).select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return P.skipping(r, 2000)


@query(f"SELECT artifact_id, any_value(tokens) AS tokens, any_value(saved) AS saved FROM (SELECT sha256(text) AS artifact_id, {TOK} AS tokens, {TOK} - least({TOK}, 100) - 16 AS saved FROM documents) WHERE saved > 0 GROUP BY 1")
def recoverable_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.artifacts(docs(spark, sf_dir).select("text"), 100)


@query("WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, sha256(CASE WHEN len(l) > 10 THEN concat(array_to_string(l[1:6], chr(10)), chr(10), '... ', CAST(len(l) - 9 AS VARCHAR), ' lines ...', chr(10), array_to_string(l[len(l) - 2:], chr(10))) ELSE text END) AS digest FROM s")
def compress_body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elided(docs(spark, sf_dir).select("doc_id", "text"), 10).select("doc_id", F.sha2("output", 256).alias("digest"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \\t\\r]+$', '')), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.compact_lines(F.col("text")), 256).alias("digest"))


@query()
def output_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the kind of each page and document by its marks."""
    return docs(spark, sf_dir).select("doc_id", T.content_class(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
