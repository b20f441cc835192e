"""Queries over dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..sources.views import view, with_views
from .registry import query

E = with_views("edges")
FE = with_views("file_edges", "files")
TEST = r"(regexp_matches(path, '/(tests?|__tests__|spec|testing)/') OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '[._](test|spec)\.[^/]*$') OR regexp_matches(path, 'Tests?\.(java|kt|cs)$'))"
DEGREE = "deg AS (SELECT id, sum(o) AS n_out, sum(i) AS n_in, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1)"
TARGETS = [3, 17, 42, 99, 150]


def numbers(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query(f"{E}, {DEGREE} SELECT id, CAST(n_out AS BIGINT) AS n_out, CAST(n_in AS BIGINT) AS n_in, degree FROM deg ORDER BY degree DESC, id LIMIT 50")
def top_files_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(view(spark, sf_dir, "edges")).orderBy(F.desc("degree"), "id").limit(50)


@query(f"{with_views('edges', 'symbols')}, {DEGREE} SELECT s.id, s.name, s.kind, CAST(coalesce(n_out, 0) AS BIGINT) AS n_out, CAST(coalesce(n_in, 0) AS BIGINT) AS n_in, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM symbols s LEFT JOIN deg USING (id)")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "symbols").select("id", "name", "kind").join(G.degrees(view(spark, sf_dir, "edges")), "id", "left")
    return found.select("id", "name", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in", "degree")])


@query(f"{FE} SELECT dst AS target, list_sort(list(DISTINCT src)) AS dependents FROM file_edges WHERE dst IN (3, 17, 42, 99, 150) GROUP BY 1")
def impact_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.direct_dependents(view(spark, sf_dir, "file_edges"), TARGETS)


@query(f"{FE} SELECT DISTINCT src AS id, path FROM file_edges JOIN files ON files.id = src WHERE dst IN (3, 17, 42, 99, 150) AND src NOT IN (3, 17, 42, 99, 150)")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import the surface and aren't part of it."""
    found = view(spark, sf_dir, "file_edges").where(F.col("dst").isin(TARGETS) & ~F.col("src").isin(TARGETS)).select(F.col("src").alias("id")).distinct()
    return found.join(view(spark, sf_dir, "files").select("id", "path"), "id")


@query(f"{FE} SELECT DISTINCT f.id, f.path FROM files f LEFT JOIN file_edges e ON e.src = f.id AND e.dst < 50 WHERE {TEST.replace('path', 'f.path')} AND (e.src IS NOT NULL OR f.id < 50)")
def tests_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files among the importers of a surface and the surface itself."""
    surface = view(spark, sf_dir, "files").where("id < 50").select("id")
    importers = view(spark, sf_dir, "file_edges").where("dst < 50").select(F.col("src").alias("id"))
    files = view(spark, sf_dir, "files").where(T.is_test_path(F.col("path"))).select("id", "path")
    return files.join(surface.unionByName(importers), "id", "left_semi")


@query(f"{FE} SELECT DISTINCT a.id, b.id AS peer FROM files a JOIN files b ON a.id <> b.id AND a.id % 10 = b.id % 10 WHERE EXISTS (SELECT 1 FROM file_edges e WHERE (e.src = a.id AND e.dst = b.id) OR (e.src = b.id AND e.dst = a.id))")
def definition_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers with the same stem (here: last digit) that an edge joins either way; from the edges, so no pairs are enumerated."""
    edges = view(spark, sf_dir, "file_edges").where("src <> dst AND src % 10 = dst % 10")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("peer")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("peer")))
    return both.distinct()


@query(f"{FE}, w AS (SELECT src, dst FROM file_edges UNION SELECT dst, src FROM file_edges), r AS (SELECT id, 0 AS depth FROM files WHERE id < 20 UNION SELECT w.dst, r.depth + 1 FROM r JOIN w ON w.src = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def file_bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reached(view(spark, sf_dir, "file_edges"), numbers(spark, list(range(20))), 2, both=True)


@query(f"""{FE}, w AS (SELECT src, dst, 0 AS direction FROM file_edges UNION SELECT dst, src, 1 FROM file_edges),
l0 AS (SELECT id, row_number() OVER (ORDER BY id) AS place, strlen(content) AS size FROM files WHERE id < 20),
a1 AS (SELECT w.dst AS id, min((l0.place, direction, w.dst)) AS spot FROM l0 JOIN w ON w.src = l0.id WHERE w.dst NOT IN (SELECT id FROM l0) GROUP BY 1),
l1 AS (SELECT a1.id, row_number() OVER (ORDER BY spot) AS place, coalesce(strlen(content), 0) AS size, sum(coalesce(strlen(content), 0)) OVER (ORDER BY spot) AS bytes FROM a1 LEFT JOIN files f ON f.id = a1.id),
a2 AS (SELECT w.dst AS id, min((l1.place, direction, w.dst)) AS spot FROM l1 JOIN w ON w.src = l1.id WHERE l1.bytes < 192000 AND w.dst NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1) GROUP BY 1),
l2 AS (SELECT a2.id, coalesce(strlen(content), 0) AS size, (SELECT max(bytes) FROM l1) + sum(coalesce(strlen(content), 0)) OVER (ORDER BY spot) AS bytes FROM a2 LEFT JOIN files f ON f.id = a2.id)
SELECT id, depth, CAST(size AS BIGINT) AS size, CAST(bytes AS BIGINT) AS bytes, depth = 0 OR bytes < 192000 AS expands FROM (SELECT id, 0 AS depth, size, 0 AS bytes FROM l0 UNION ALL SELECT id, 1, size, bytes FROM l1 UNION ALL SELECT id, 2, size, bytes FROM l2)""")
def file_bfs_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 with a budget of 120,000 tokens, so that some nodes of depth 1 expand and others don't."""
    sizes = view(spark, sf_dir, "files").select("id", F.octet_length("content").cast("long").alias("size"))
    return G.budgeted(view(spark, sf_dir, "file_edges"), numbers(spark, list(range(20))), sizes, 2, 120_000)


@query(f"{E}, r AS (SELECT dst AS id, 0 AS depth FROM edges WHERE dst < 40 UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def symbol_bfs_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    return G.reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), edges.where("dst < 40").select(F.col("dst").alias("id")), 3)


@query(f"{E}, r AS (SELECT dst AS id FROM edges WHERE dst < 10 UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.id) SELECT id FROM r WHERE id >= 10")
def reachability_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on a handler, however far; the handlers themselves aside."""
    edges = view(spark, sf_dir, "edges")
    found = G.reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), edges.where("dst < 10").select(F.col("dst").alias("id")))
    return found.where("id >= 10").select("id")


COMPONENT = "w AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), n AS (SELECT DISTINCT src AS id FROM w), r AS (SELECT id, id AS root FROM n UNION SELECT w.dst, r.root FROM r JOIN w ON w.src = r.id), c AS (SELECT id, min(root) AS component FROM r GROUP BY 1)"


@query(f"{E}, {COMPONENT} SELECT component, count(*) AS symbols FROM c GROUP BY 1")
def symbol_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.components(nodes, edges).groupBy("component").agg(F.count("*").alias("symbols"))


@query(f"{E}, {COMPONENT} SELECT component, count(DISTINCT (least(src, dst), greatest(src, dst))) AS relation_count FROM edges JOIN c ON c.id = src WHERE src <> dst GROUP BY 1")
def community_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct undirected links of each community."""
    edges = G.cut(view(spark, sf_dir, "edges"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = edges.where("src <> dst").join(G.components(nodes, edges), F.col("id") == F.col("src"))
    return found.select("component", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("component").agg(F.count("*").alias("relation_count"))


@query(f"""{E}, d AS (SELECT DISTINCT src, dst, kind, CASE WHEN (src + dst) % 4 = 0 THEN 'inferred' ELSE 'observed' END AS evidence FROM edges),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, kind, evidence) AS rn FROM d) WHERE rn <= 8),
r AS (SELECT DISTINCT src AS node, src AS entry, [src] AS path, CAST([] AS STRUCT(dst BIGINT, kind VARCHAR, evidence VARCHAR)[]) AS edges, false AS stop FROM d WHERE src % 5 = 0 AND NOT src % 3 = 1 UNION ALL SELECT x.dst, r.entry, list_append(r.path, x.dst), list_append(r.edges, {{'dst': x.dst, 'kind': x.kind, 'evidence': x.evidence}}), x.dst % 3 = 1 FROM r JOIN x ON x.src = r.node WHERE NOT r.stop AND NOT list_contains(r.path, x.dst) AND len(r.path) < 6),
live AS (SELECT count(*) AS n FROM r WHERE NOT stop AND ((len(path) = 6 AND node IN (SELECT src FROM d)) OR node IN (SELECT src FROM d GROUP BY 1 HAVING count(*) > 8)))
SELECT array_to_string(path, ',') AS path, array_to_string(list_transform(edges, lambda e: e.kind), ',') AS kinds, array_to_string(list_transform(edges, lambda e: e.evidence), ',') AS evidence, (SELECT n > 0 FROM live) OR (SELECT count(*) > 50 FROM r WHERE stop) AS truncated FROM r WHERE stop ORDER BY entry, edges LIMIT 50""")
def execution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges").withColumn("evidence", F.when((F.col("src") + F.col("dst")) % 4 == 0, "inferred").otherwise("observed"))
    entries = edges.where("src % 5 = 0 AND NOT src % 3 = 1").select(F.col("src").alias("id")).distinct()
    found = G.simple_paths(edges, entries, edges.where("dst % 3 = 1").select(F.col("dst").alias("id")), depth=5)
    return found.select(F.array_join("path", ",").alias("path"), F.array_join("kinds", ",").alias("kinds"), F.array_join("evidence", ",").alias("evidence"), "truncated")


@query(f"{with_views('edges', 'symbols')} SELECT s.id, count(e.src) AS n FROM symbols s LEFT JOIN edges e ON e.src = s.id OR e.dst = s.id GROUP BY 1")
def or_join_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reference_counts(view(spark, sf_dir, "symbols"), view(spark, sf_dir, "edges"))


@query(f"{with_views('edges', 'symbols')} SELECT name, count(*) AS n FROM symbols s JOIN edges e ON e.src = s.id OR e.dst = s.id GROUP BY 1 ORDER BY n DESC, name LIMIT 500")
def most_referenced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, D6."""
    symbols = view(spark, sf_dir, "symbols")
    counts = G.reference_counts(symbols, view(spark, sf_dir, "edges")).where("n > 0")
    return symbols.select("id", "name").join(counts, "id").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(500)


@query(f"{with_views('edges', 'symbols')} SELECT e.src, a.name AS src_name, e.dst, b.name AS dst_name, e.kind FROM edges e JOIN symbols a ON a.id = e.src LEFT JOIN symbols b ON b.id = e.dst")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the names of both ends."""
    names = view(spark, sf_dir, "symbols").select("id", "name")
    edges = view(spark, sf_dir, "edges")
    first = edges.join(names.withColumnsRenamed({"id": "src", "name": "src_name"}), "src")
    return first.join(names.withColumnsRenamed({"id": "dst", "name": "dst_name"}), "dst", "left").select("src", "src_name", "dst", "dst_name", "kind")


@query(f"{with_views('edges', 'symbols')} SELECT DISTINCT s.id, s.name, s.file_id, s.start_line FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst < 100 ORDER BY s.file_id, s.start_line, s.id LIMIT 100")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    wanted = view(spark, sf_dir, "edges").where("dst < 100").select(F.col("src").alias("id"))
    return view(spark, sf_dir, "symbols").join(wanted, "id", "left_semi").select("id", "name", "file_id", "start_line").orderBy("file_id", "start_line", "id").limit(100)


@query(f"{with_views('edges', 'symbols')} SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE kind = 'calls') AS calls, (SELECT count(DISTINCT file_id) FROM symbols) AS files, (SELECT count(*) FROM documents) AS known_files")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row aggregates side by side."""
    symbols = view(spark, sf_dir, "symbols").agg(F.count("*").alias("symbols"), F.countDistinct("file_id").alias("files"))
    edges = view(spark, sf_dir, "edges").agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "calls").alias("calls"))
    files = view(spark, sf_dir, "files").agg(F.count("*").alias("known_files"))
    return symbols.join(F.broadcast(edges)).join(F.broadcast(files)).select("symbols", "edges", "calls", "files", "known_files")  # one row each
