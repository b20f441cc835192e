"""Queries on code, re-ranking and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as T
from ..operators import evidence as E
from ..operators import ranking as R
from ..operators import retrieval as S
from ..sources import registry as G
from ..sources.views import view, with_views
from .registry import query
from .retrieval import KNN, vectors, wanted

V = with_views("symbols", "files")
KINDS = "('function', 'method', 'class', 'struct', 'promo', 'standard', 'economy')"


@query(f"{V} SELECT s.id, f.path, s.kind, s.start_line FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = split_part('x.blue_widget_7', '.', 2) OR s.name = 'red_gear_3' ORDER BY CASE WHEN s.kind IN {KINDS} THEN 0 ELSE 1 END, f.path, s.start_line, s.id LIMIT 25")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names, the qualifier stripped; code-like kinds first."""
    names = [n.split(".")[-1] for n in ("x.blue_widget_7", "red_gear_3")]
    files = view(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path")
    found = view(spark, sf_dir, "symbols").where(F.col("name").isin(names)).join(files, "file_id")
    first = F.when(F.col("kind").isin("function", "method", "class", "struct", "promo", "standard", "economy"), 0).otherwise(1)
    return found.orderBy(first, "path", "start_line", "id").limit(25).select("id", "path", "kind", "start_line")


@query(f"{V} SELECT file_id, arg_max(id, (start_line, -end_line, -id)) AS id FROM symbols WHERE 300 BETWEEN start_line AND end_line GROUP BY 1")
def symbol_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost symbol around line 300 of each file."""
    at = view(spark, sf_dir, "symbols").where("start_line <= 300 AND end_line >= 300")
    return at.groupBy("file_id").agg(F.max_by("id", F.struct("start_line", -F.col("end_line"), -F.col("id"))).alias("id"))


TERMS = ["blue", "gear"]
IDF = {"blue": 1.5, "gear": 2.5}


def has(term: str, column: str) -> str:
    return f"list_contains(list_filter(regexp_split_to_array(lower({column}), '[^0-9a-z]+'), lambda t: length(t) >= 2), '{term}')"


@query(f"{V} SELECT s.id, round(1.0::DOUBLE + CASE WHEN s.name = 'blue_gear' THEN 100 ELSE 0 END + {' + '.join(f'CASE WHEN {has(t, chr(115) + chr(46) + chr(110) + chr(97) + chr(109) + chr(101))} THEN {4 * IDF[t]} ELSE 0 END + CASE WHEN {has(t, chr(102) + chr(46) + chr(112) + chr(97) + chr(116) + chr(104))} THEN {1.5 * IDF[t]} ELSE 0 END' for t in TERMS)}, 6) AS score FROM symbols s JOIN files f ON f.id = s.file_id")
def field_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path")
    scored = view(spark, sf_dir, "symbols").join(files, "file_id").withColumn("score", F.lit(1.0))
    return R.boosted(scored, TERMS, IDF, "blue gear").select("id", F.round("score", 6).alias("score"))


@query(f"{V} SELECT file_id, list_sort(list(DISTINCT name)) AS names FROM symbols GROUP BY 1")
def file_symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "symbols").groupBy("file_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


@query(f"WITH k AS ({KNN.format(48)}), l AS (SELECT vec_id AS id, vec_id % 10 + 1.0 AS score FROM embeddings WHERE vec_id % 3 = 0) SELECT k.id, round(similarity + 0.1 * coalesce(CAST(score AS DOUBLE) / (SELECT CAST(max(score) AS DOUBLE) FROM l), 0), 6) AS similarity FROM k LEFT JOIN l USING (id)")
def lexical_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.knn(vectors(spark, sf_dir), "embedding", wanted(spark, sf_dir), 48)
    lexical = vectors(spark, sf_dir).where("id % 3 = 0").select("id", (F.col("id") % 10 + 1.0).alias("score"))
    return R.bonus(near, lexical, 0.1).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH k AS ({KNN.format(48)}), x AS (SELECT p_partkey AS id FROM part WHERE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 40 AS VARCHAR)) IN ('blue_widget_7', 'red_gear_3') ORDER BY 1 LIMIT 8) SELECT coalesce(k.id, x.id) AS id, CASE WHEN x.id IS NULL THEN 1 ELSE 0 END AS priority, CASE WHEN x.id IS NULL THEN similarity ELSE 1.0 END AS similarity FROM k FULL JOIN x ON k.id = x.id")
def identifier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.knn(vectors(spark, sf_dir), "embedding", wanted(spark, sf_dir), 48)
    return R.identifiers_first(near, view(spark, sf_dir, "symbols"), "where is blue_widget_7 and red_gear_3 used")


@query(f"{V}, t AS (SELECT file_id, split_part(name, '_', 1) AS term FROM symbols UNION SELECT file_id, split_part(name, '_', 2) FROM symbols), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), b AS (SELECT file_id, max(id % 7) AS best FROM symbols GROUP BY 1), e AS (SELECT file_id, sum(0.008 * ln(1 + 1001.0 / (df + 1))) AS extra FROM t JOIN d USING (term) WHERE term IN ('blue', 'red', 'gear') GROUP BY 1) SELECT file_id, round(best + coalesce(extra, 0), 6) AS score FROM b LEFT JOIN e USING (file_id)")
def file_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = view(spark, sf_dir, "symbols")
    terms = symbols.select("file_id", F.explode(F.split("name", "_")).alias("term")).distinct()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    wanted_terms = terms.where(F.col("term").isin("blue", "red", "gear")).join(df, "term")
    scored = symbols.select("file_id", (F.col("id") % 7).cast("double").alias("score"))
    return R.files_by_best(scored, wanted_terms, 1000).withColumn("score", F.round("score", 6))


@query()
def greedy_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pick depends on those before; tests hold it against a plain loop."""
    symbols = view(spark, sf_dir, "symbols")
    return R.companions(symbols.select("file_id", "id", F.split("name", "_").alias("terms")))


@query(f"SELECT vec_id AS id, len(embedding) AS size FROM embeddings WHERE len(embedding) = 64")
def vector_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid_vectors(vectors(spark, sf_dir), 64).select("id", F.size("embedding").cast("long").alias("size"))


@query(f"{V} SELECT s.id, left(concat_ws(' | ', f.path, replace(lower(s.name), '_', ' '), s.signature, left(f.content, 200)), 700) AS document FROM symbols s JOIN files f ON f.id = s.file_id")
def symbol_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path", F.col("content").alias("docstring"))
    return R.symbol_document(view(spark, sf_dir, "symbols").join(files, "file_id")).select("id", "document")


REGISTRY = "r AS (SELECT s_suppkey AS repository, s_nationkey AS stream, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE concat('/r/', CAST(s_suppkey AS VARCHAR)) END AS root, CASE WHEN s_suppkey % 4 = 0 THEN [] ELSE [concat('g', CAST(s_suppkey % 3 AS VARCHAR))] END AS groups FROM supplier)"


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    root = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("/r/"), k.cast("string")))
    groups = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), (k % 3).cast("string"))))
    return s.select(k.alias("repository"), F.col("s_nationkey").alias("stream"), root.alias("root"), groups.alias("groups"))


@query(f"WITH {REGISTRY} SELECT stream, min(repository) AS repository FROM r WHERE list_contains(groups, 'g1') GROUP BY 1")
def registry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.selected(repositories(spark, sf_dir), "g1").select("stream", "repository")


@query(f"WITH {REGISTRY}, d AS (SELECT stream FROM r GROUP BY 1 HAVING count(*) > 1) SELECT repository, 'duplicate_stream' AS issue FROM r WHERE stream IN (SELECT stream FROM d) UNION ALL SELECT repository, 'missing_root' FROM r WHERE root = '' UNION ALL SELECT repository, 'no_group' FROM r WHERE len(groups) = 0")
def registry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.issues(repositories(spark, sf_dir))


@query(f"WITH {REGISTRY} SELECT repository FROM r WHERE root <> '' AND repository % 2 = 0")
def registry_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repositories(spark, sf_dir)
    return G.pruned(r, r.where("root <> '' AND repository % 2 = 0").select("root")).select("repository")


@query(f"WITH {REGISTRY} SELECT repository, len(groups) AS n_groups, root FROM r")
def signature_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records to JSON text and back."""
    r = repositories(spark, sf_dir)
    text = r.select(G.as_json(F.struct("repository", "root", "groups")).alias("j"))
    back = text.select(F.from_json("j", "repository bigint, root string, groups array<string>").alias("s"))
    return back.select("s.repository", F.size("s.groups").cast("long").alias("n_groups"), "s.root")


@query("SELECT user_id AS stream, count(*) AS n FROM events WHERE user_id % 5 <> 0 GROUP BY 1 UNION ALL SELECT user_id, count(*) FILTER (event_id % 2 = 0) FROM events WHERE user_id % 5 = 0 GROUP BY 1")
def replace_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-6."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("stream"), "event_id")
    return G.replaced(e, e.where("stream % 5 = 0 AND event_id % 2 = 0")).groupBy("stream").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN user_id = 3 THEN 100003 ELSE user_id END AS stream, count(*) AS n FROM events GROUP BY 1")
def reidentify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-7."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("stream"))
    return G.reidentified(e, 3, 100_003).groupBy("stream").agg(F.count("*").alias("n"))


@query(with_views("files", "file_edges") + " SELECT DISTINCT e.src AS id FROM file_edges e JOIN files f ON f.id = e.dst WHERE contains(f.path, 'src1/')")
def cross_repo_stem_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import one whose path holds a stem."""
    named = view(spark, sf_dir, "files").where(F.contains("path", F.lit("src1/"))).select(F.col("id").alias("dst"))
    return view(spark, sf_dir, "file_edges").join(named, "dst", "left_semi").select(F.col("src").alias("id")).distinct()


@query()
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """needs a state machine over characters; tests give cases."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    return code.stripped(p).select("id", F.length("content").alias("n"))


@query()
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs a parser; tests give cases."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.concat(F.lit("p"), "page_id", F.lit(".js")).alias("path"), F.col("html").alias("content"))
    return code.parse_files(p).select("id", F.size("symbols").alias("n_symbols"), F.size("calls").alias("n_calls"), "skeleton")


@query()
def data_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs an ordered pass over statements; tests give cases."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").alias("body"))
    return code.traces(p)


@query("SELECT doc_id AS id, sha256(concat(CAST(strlen(source) AS VARCHAR), ':', source, '|', CAST(strlen(lang) AS VARCHAR), ':', lang, '|')) AS fingerprint FROM documents")
def canonical_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, F13."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), T.canonical_fingerprint(F.col("source"), F.col("lang")).alias("fingerprint"))


@query(f"SELECT e.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY 2 DESC, 1 LIMIT 20")
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14."""
    found = E.filtered_knn(vectors(spark, sf_dir), wanted(spark, sf_dir), {"label": 3}, 20)
    return found.select("id", F.round("similarity", 4).alias("similarity"))


@query("SELECT user_id % 40 AS queue, count(*) AS entries FROM events GROUP BY 1 HAVING count(*) >= 250 OR max(event_id % 997) >= 990")
def queues_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-13."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return E.due(e.select((F.col("user_id") % 40).alias("queue"), (F.col("event_id") % 997).alias("age_seconds")), 250, 990)


@query(f"{V} SELECT id, name FROM symbols ORDER BY id LIMIT 100")
def capped_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    return E.capped(view(spark, sf_dir, "symbols").select("id", "name"), 100)[0]


@query(f"{V} SELECT id, path FROM files WHERE id % 3 = 0 AND starts_with(path, 'src1') AND path LIKE '%.txt'")
def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here the roots are folders that start with src1."""
    files = view(spark, sf_dir, "files").select("id", "path")
    found = files.where("id % 3 = 0").where(F.startswith("path", F.lit("src1")))
    return files.join(found.select("path"), "path", "left_semi").where(F.endswith("path", F.lit(".txt"))).select("id", "path")


@query("SELECT doc_id AS id, doc_id % 2 = 0 AS timestamp_ok, doc_id % 3 <> 0 AS uuid_ok FROM documents")
def identity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and the calendar."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"))
    stamp = F.when(F.col("id") % 2 == 0, "2024-02-29T10:00:00Z").otherwise("2023-02-29T10:00:00Z")
    uuid = F.when(F.col("id") % 3 != 0, "123e4567-e89b-42d3-a456-426614174000").otherwise("123e4567-e89b-72d3-a456-426614174000")
    return d.select("id", F.coalesce(E.valid_timestamp(stamp), F.lit(False)).alias("timestamp_ok"), E.valid_uuid(uuid).alias("uuid_ok"))


@query(with_views("symbols", "file_edges") + " SELECT f.file_id, count(*) AS n FROM symbols f WHERE EXISTS (SELECT 1 FROM file_edges e WHERE e.src = f.file_id) AND NOT EXISTS (SELECT 1 FROM file_edges e WHERE e.dst = f.file_id) GROUP BY 1")
def existence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins."""
    symbols, edges = view(spark, sf_dir, "symbols"), view(spark, sf_dir, "file_edges")
    return symbols.join(edges, symbols["file_id"] == edges["src"], "left_semi").join(edges, symbols["file_id"] == edges["dst"], "left_anti").groupBy("file_id").agg(F.count("*").alias("n"))


@query(with_views("turns") + " SELECT id, CASE WHEN file_id > 0 THEN file_id ELSE -1 END AS anchor FROM turns WHERE session_id = 5")
def turn_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: anchors of a session's turns; ids that aren't positive are none, -1 here."""
    return view(spark, sf_dir, "turns").where("session_id = 5").select("id", F.when(F.col("file_id") > 0, F.col("file_id")).otherwise(-1).alias("anchor"))


@query("SELECT doc_id AS id, length(text) AS n, left(text, 40) AS head FROM documents WHERE doc_id IN (1, 5, 9, 40)")
def skeleton_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files in one scan; the list reaches it as a filter."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isin(1, 5, 9, 40))
    return d.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"), F.substring("text", 1, 40).alias("head"))
