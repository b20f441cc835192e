"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as X
from ..operators import retrieval as R
from ..sources.views import view, with_views
from .registry import query

TERMS = ["the", "ation", "ment"]
WORDS = ["the", "of", "license"]
LEX = r"list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^0-9a-z\x{{0080}}-\x{{10FFFF}}]+'), lambda t: strlen(t) >= 2)"
DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
SIM = f"round({DOT.format('e.embedding', 'q.embedding')} / (sqrt({DOT.format('e.embedding', 'e.embedding')}) * sqrt({DOT.format('q.embedding', 'q.embedding')})), 6)"
KNN = f"SELECT e.vec_id AS id, {SIM} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT {{0}}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")


def wanted(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row."""
    return vectors(spark, sf_dir).where("id = 0").first().embedding


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id")


def hits_sql(terms: list[str], column: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower({column}), '{t}') THEN 1 ELSE 0 END" for t in terms)


@query(f"""WITH s AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS semantic_rank FROM ({KNN.format(80)})),
l AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS lexical_rank FROM (SELECT doc_id AS id, {hits_sql(TERMS, 'text')} AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, id LIMIT 80),
f AS (SELECT coalesce(s.id, l.id) AS id, semantic_rank, lexical_rank, coalesce(1 / (60 + CAST(semantic_rank AS DOUBLE)), 0) + coalesce(1 / (60 + CAST(lexical_rank AS DOUBLE)), 0) AS rrf FROM s FULL JOIN l ON s.id = l.id)
SELECT f.id, CAST(coalesce(semantic_rank, 0) AS INTEGER) AS semantic_rank, CAST(coalesce(lexical_rank, 0) AS INTEGER) AS lexical_rank, round(rrf * least(greatest(0.25 * (d.doc_id % 12), 0.5), 2.0), 8) AS score FROM f JOIN documents d ON d.doc_id = f.id ORDER BY score DESC, f.id LIMIT 20""")
def memory_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.memory_search(view(spark, sf_dir, "observations"), vectors(spark, sf_dir), wanted(spark, sf_dir), TERMS, 20)


@query(KNN.format(48))
def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn(vectors(spark, sf_dir), "embedding", wanted(spark, sf_dir), 48).select("id", "similarity")


@query(f"SELECT label, id, similarity FROM (SELECT e.label, e.vec_id AS id, {SIM} AS similarity, row_number() OVER (PARTITION BY e.label ORDER BY {SIM} DESC, e.vec_id) AS rn FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rn = 1")
def best_symbol_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).withColumn("similarity", F.round(R.V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in wanted(spark, sf_dir)])), 6))
    return R.best_by(scored, "label", "similarity")


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({LEX.format('text')}) AS term FROM documents) GROUP BY 1, 2")
def lexical_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(docs(spark, sf_dir))


@query(f"SELECT count(*) AS n, round(avg(len({LEX.format('text')})), 6) AS average FROM documents")
def lexical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(docs(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({LEX.format('text')}) AS term FROM documents) GROUP BY 1")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


BM25 = f"""t AS (SELECT doc_id AS id, {LEX.format('text')} AS t FROM documents),
e AS (SELECT id, len(t) AS length, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(WORDS))} FROM t),
c AS (SELECT count(*) AS n, avg(length) AS average, {', '.join(f'sum((tf{k} > 0)::BIGINT) AS df{k}' for k in range(3))} FROM e),
bm AS (SELECT id, round({' + '.join(f'CASE WHEN tf{k} > 0 THEN ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END' for k in range(3))}, 6) AS score FROM e, c WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"""


@query(f"WITH {BM25} SELECT id, score FROM bm")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5, over the stored index; the first call in a session builds it."""
    return X.bm25(X.stored(spark, sf_dir, docs(spark, sf_dir)), WORDS)


@query(f"WITH {BM25} SELECT id, score FROM bm")
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 without an index: one pass over the texts."""
    return R.bm25(docs(spark, sf_dir), WORDS)


@query(f"""WITH {BM25}, s AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS semantic_rank FROM ({KNN.format(100)})),
l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lexical_rank FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 100))
SELECT coalesce(s.id, l.id) AS id, CAST(coalesce(semantic_rank, 0) AS INTEGER) AS semantic_rank, CAST(coalesce(lexical_rank, 0) AS INTEGER) AS lexical_rank, round(coalesce(1 / (60 + CAST(semantic_rank AS DOUBLE)), 0) + coalesce(1 / (60 + CAST(lexical_rank AS DOUBLE)), 0), 8) AS rrf FROM s FULL JOIN l ON s.id = l.id""")
def hybrid_rrf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic = R.ranked(R.knn(vectors(spark, sf_dir), "embedding", wanted(spark, sf_dir), 100), "similarity", "semantic_rank", 100)
    lexical = R.ranked(X.bm25(X.stored(spark, sf_dir, docs(spark, sf_dir)), WORDS), "score", "lexical_rank", 100)
    return R.fused(semantic, lexical).select("id", F.coalesce("semantic_rank", F.lit(0)).alias("semantic_rank"), F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.round("rrf", 8).alias("rrf"))


@query(f"SELECT doc_id AS id, {hits_sql(TERMS, 'text')} AS hits FROM documents WHERE {hits_sql(TERMS, 'text')} > 0")
def memory_lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_hits(view(spark, sf_dir, "observations"), TERMS)


@query("WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_./-]+'), lambda x: length(x) BETWEEN 2 AND 64) AS t FROM documents), f AS (SELECT id, term, min(i) AS i FROM (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM w) GROUP BY 1, 2) SELECT w.id, coalesce((SELECT list(term ORDER BY i)[1:8] FROM f WHERE f.id = w.id), []) AS terms FROM w")
def memory_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", F.slice(T.memory_terms(F.col("text"), 200), 1, 8).alias("terms"))


@query("SELECT doc_id AS id FROM (SELECT doc_id, source AS tag FROM documents UNION SELECT doc_id, lang FROM documents UNION SELECT doc_id, concat('quality', quality) FROM labels) WHERE tag IN ('src0', 'en', 'quality1') GROUP BY 1 HAVING count(DISTINCT tag) = 3")
def relational_division_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_all_tags(tags(spark, sf_dir), ["src0", "en", "quality1"])


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return d.select("id", F.col("source").alias("tag")).unionByName(d.select("id", F.col("lang").alias("tag"))).unionByName(labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("quality"), "quality").alias("tag")))


@query("SELECT doc_id AS id, list_sort(list(tag)) AS tags FROM (SELECT DISTINCT doc_id, source AS tag FROM documents UNION SELECT doc_id, lang FROM documents UNION SELECT doc_id, concat('quality', quality) FROM labels) GROUP BY 1")
def observation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query(with_views("symbols", "files") + " SELECT s.id, f.path, s.name, s.start_line FROM symbols s JOIN files f ON s.file_id = f.id WHERE contains(lower(s.name), 'blue') ORDER BY f.path, s.start_line, s.id LIMIT 50")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring of a name whatever its case, 50 at most, in order of path and line."""
    found = view(spark, sf_dir, "symbols").where(F.contains(F.lower("name"), F.lit("blue")))
    files = view(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path")
    return found.join(files, "file_id").select("id", "path", "name", "start_line").orderBy("path", "start_line", "id").limit(50)


@query(with_views("symbols", "files") + " SELECT 'file' AS kind, path AS name, id FROM files WHERE contains(path, 'src1') UNION ALL SELECT 'symbol', name, id FROM symbols WHERE contains(name, 'red')")
def path_and_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal substrings, so % and _ mean themselves."""
    files, symbols = view(spark, sf_dir, "files"), view(spark, sf_dir, "symbols")
    return files.where(F.contains("path", F.lit("src1"))).select(F.lit("file").alias("kind"), F.col("path").alias("name"), "id").unionByName(symbols.where(F.contains("name", F.lit("red"))).select(F.lit("symbol").alias("kind"), "name", "id"))
