"""Queries on what source files declare, provide and call; the files are written from the documents' numbers.

Each cross-check states what a file's number makes it say, not how it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as T
from ..operators import contracts as K
from ..operators import evidence as E
from ..operators import journal as J
from ..operators import kinds, logs, pack, ranking
from ..sources.files import diff_hunks
from ..sources.views import view, with_views
from ..storage import new_path
from .registry import query

#: What file n says, by n modulo 10; {n} is its number.
FILES = {
    0: ["const app = express();", 'app.get("/d{n}", function show{n}(q, r) {{ r.json({{ id: 1, "name": {{ a: 2 }}, tags: [1, 2] }}) }})', 'router.post("/d{n}/items", async function add{n}(q, r) {{ return {{ id: 2, ...rest }} }})', 'app.use("/static", files)'],
    1: ["def call{n}():", '    return requests.get("https://Svc{n}.local/items/{n}?x=1")', "", "def other(url):", "    return client.post(url)"],
    2: ["@app.route('/p{n}', methods=['GET', 'POST'])", "def page():", "    return 1", "", '@router.put("/q{n}")', "def put():", "    db.save(1)"],
    3: ['const BROKER = "Main{n}"', 'const TOPIC = "orders.{n}"', "function push() {{ producer.send(TOPIC, 1) }}"],
    4: ['topic = "orders.{n}"', "subscribe(topic, onOrder)"],
    5: ["openapi: 3.0.0", "paths:", "  /pets/{n}:", "    get:", "      operationId: listPets{n}", "    post:", "      operationId: 'addPet'", "  /other:", "    delete:", "      operationId: drop.other"],
    6: ['syntax = "proto3";', "package shop.p{n};", "service Orders{n} {{", "  rpc Place (A) returns (B);", "  rpc Cancel(A) returns (B);", "}}", "service Empty {{ }}"],
    7: ["asyncapi: 2.0.0", "servers:", "  main:", "    url: broker:9092", "channels:", "  user/{n}:", "    publish:", "      message: x"],
    8: ["public class Orders{m} {{", "  public Reply place(Request r) {{ return null; }}", "  public Reply unknown(Request r) {{ return null; }}", "}}"],
    9: ["Orders{m}.Orders{m}Client stub;", "stub.PlaceAsync(x);", "stub.MissingAsync(x);"],
}
EXTENSIONS = ["ts", "py", "py", "js", "js", "yaml", "proto", "yaml", "java", "cs"]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, path, text), one for each document. {m} is the number of the last file of kind 6."""
    n = F.col("doc_id")
    text, path = F.lit(""), F.lit("")
    for kind, lines in FILES.items():
        whole = "\n".join(lines).replace("{{", "{").replace("}}", "}")
        filled = F.replace(F.replace(F.lit(whole), F.lit("{n}"), n.cast("string")), F.lit("{m}"), (n - n % 10 + 6).cast("string"))
        text = F.when(n % 10 == kind, filled).otherwise(text)
        path = F.when(n % 10 == kind, F.concat(F.when(n % 20 == 0, "app/").otherwise("src/"), F.lit("d"), n.cast("string"), F.lit(f"/route.{EXTENSIONS[kind]}"))).otherwise(path)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(n.alias("file"), path.alias("path"), text.alias("text"))


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def methods(files: DataFrame) -> DataFrame:
    split = F.split("identity", r"\|")
    return K.protobuf_rows(files).select(split[1].alias("service"), split[2].alias("method"), "identity")


N = "CAST(doc_id AS VARCHAR)"
M = "CAST(doc_id - doc_id % 10 + 6 AS VARCHAR)"


def stated(*rows: str) -> str:
    """A union of rows, each with the kind of file that says so."""
    return " UNION ALL ".join(f"SELECT doc_id AS file, {r}" for r in rows)


ROUTES_SQL = stated(
    f"'express' AS framework, 'GET' AS method, concat('/d', {N}) AS path FROM documents WHERE doc_id % 10 = 0",
    f"'express', 'POST', concat('/d', {N}, '/items') FROM documents WHERE doc_id % 10 = 0",
    "'express', 'USE', '/static' FROM documents WHERE doc_id % 10 = 0",
    f"'flask', 'ANY', concat('/p', {N}) FROM documents WHERE doc_id % 10 = 2",
    f"'fastapi', 'PUT', concat('/q', {N}) FROM documents WHERE doc_id % 10 = 2",
    f"'nextjs', 'ANY', concat('/d', {N}) FROM documents WHERE doc_id % 20 = 0",
)


@query(ROUTES_SQL)
def route_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    return K.route_rows(sources(spark, sf_dir))


@query("SELECT framework, count(*) AS routes FROM (SELECT 'express' AS framework FROM documents, (VALUES (1), (2), (3)) WHERE doc_id % 10 = 0 UNION ALL SELECT 'nextjs' FROM documents WHERE doc_id % 20 = 0) GROUP BY 1")
def routes_of_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of some frameworks alone."""
    return K.route_rows(sources(spark, sf_dir)).where(F.col("framework").isin("express", "nextjs")).groupBy("framework").agg(F.count("*").alias("routes"))


@query(stated(
    f"'http' AS surface, 'provider' AS role, concat('GET|/d', {N}) AS identity FROM documents WHERE doc_id % 10 = 0",
    f"'http', 'provider', concat('POST|/d', {N}, '/items') FROM documents WHERE doc_id % 10 = 0",
    f"'http', 'consumer', concat('svc', {N}, '.local|GET|/items/', {N}) FROM documents WHERE doc_id % 10 = 1",
    f"'topic', 'provider', concat('kafka|main', {N}, '|orders.', {N}) FROM documents WHERE doc_id % 10 = 3",
    "'topic', 'consumer', '' FROM documents WHERE doc_id % 10 = 4",
    f"'grpc', 'provider', concat('shop.p', {M}, '|Orders', {M}, '|Place') FROM documents WHERE doc_id % 10 = 8",
    f"'grpc', 'consumer', concat('shop.p', {M}, '|Orders', {M}, '|Place') FROM documents WHERE doc_id % 10 = 9",
    "'grpc', 'consumer', '' FROM documents WHERE doc_id % 10 = 9",
))
def observed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    files = sources(spark, sf_dir)
    return E.observed(files, methods(files))


@query(stated(
    f"'GET' AS method, concat('/pets/', {N}) AS path, concat('listPets', {N}) AS operation FROM documents WHERE doc_id % 10 = 5",
    f"'POST', concat('/pets/', {N}), 'addPet' FROM documents WHERE doc_id % 10 = 5",
    "'DELETE', '/other', 'drop.other' FROM documents WHERE doc_id % 10 = 5",
))
def openapi_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    return K.openapi_rows(lines_of(sources(spark, sf_dir)))


@query(stated(*[f"concat('shop.p', {N}, '|Orders', {N}, '|{rpc}') AS identity FROM documents WHERE doc_id % 10 = 6" for rpc in ("Place", "Cancel")]))
def protobuf_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2."""
    return K.protobuf_rows(sources(spark, sf_dir))


@query(stated(f"'provider' AS role, concat('user/', {N}) AS channel FROM documents WHERE doc_id % 10 = 7"))
def asyncapi_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    return E.asyncapi(sources(spark, sf_dir))


@query(stated(
    f"0 AS n, concat('call', {N}) AS owner FROM documents WHERE doc_id % 10 = 1",
    f"1, concat('call', {N}) FROM documents WHERE doc_id % 10 = 1",
    f"2, concat('call', {N}) FROM documents WHERE doc_id % 10 = 1",
    "3, 'other' FROM documents WHERE doc_id % 10 = 1",
    "4, 'other' FROM documents WHERE doc_id % 10 = 1",
))
def nearest_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5."""
    return E.nearest_function(lines_of(sources(spark, sf_dir).where("file % 10 = 1")))


@query("SELECT doc_id AS file, 'gone' AS change, CAST(doc_id % 10 AS BIGINT) AS version FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'new', CAST(doc_id % 10 + 100 AS BIGINT) FROM documents WHERE doc_id % 3 = 0")
def evidence_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: evidence that a new reading replaces: rows that went and rows that came."""
    old = sources(spark, sf_dir).select("file", (F.col("file") % 10).alias("version"))
    new = old.withColumn("version", F.when(F.col("file") % 3 == 0, F.col("version") + 100).otherwise(F.col("version")))
    return E.changes(old, new)


@query(stated("0 AS response, 'id,name,tags' AS keys, true AS closed FROM documents WHERE doc_id % 10 = 0", "1, '', false FROM documents WHERE doc_id % 10 = 0"))
def response_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8."""
    found = E.response_shapes(sources(spark, sf_dir).where("file % 10 = 0").select(F.col("file").alias("id"), F.col("text").alias("body")))
    return found.select(F.col("id").alias("file"), "response", F.array_join("keys", ",").alias("keys"), "closed")


@query("SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'http_handler' WHEN 3 THEN 'topic_handler' WHEN 8 THEN 'grpc_handler' WHEN 1 THEN 'output_external_http' WHEN 2 THEN 'output_persistence' ELSE 'symbol' END AS kind FROM documents")
def execution_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files stand for symbols."""
    files = sources(spark, sf_dir)
    return E.execution_nodes(files.withColumnRenamed("file", "id"), E.observed(files, methods(files)).withColumnRenamed("file", "id"))


@query("WITH s AS (SELECT p_partkey AS id, p_partkey % 50 AS file_id, p_partkey // 50 AS place FROM part), c AS (SELECT * FROM s WHERE place = 0), j AS (SELECT s.file_id, s.id, CASE WHEN s.place IN (1, 2) THEN 6 ELSE 0 END + CASE WHEN s.place % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s.place = 4 THEN 1 ELSE 0 END AS score FROM s JOIN c USING (file_id) WHERE s.place > 0) SELECT file_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, id) AS rn FROM j WHERE score > 0) WHERE rn <= 3")
def symbol_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbol of a file calls its next two; every third calls the first; the fifth shares a long word with it."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    place, file = F.expr("p_partkey div 50"), F.col("p_partkey") % 50
    body = F.when(place == 0, "begin s1_() s2_() longword1").otherwise(F.concat(F.lit("pass "), F.when(place % 3 == 0, "s0_() ").otherwise(""), F.when(place == 4, "longword1").otherwise("short")))
    symbols = part.select(F.col("p_partkey").alias("id"), file.alias("file_id"), F.concat(F.lit("s"), place.cast("string"), F.lit("_")).alias("name"), body.alias("body"))
    return E.expanded(symbols.where("name = 's0_'"), symbols.where("name <> 's0_'"))


@query("WITH s AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS t, p_size % 3 = 0 AS code, p_size * 1.0::DOUBLE AS score FROM part), d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM s) GROUP BY 1) SELECT id, round(score + coalesce((SELECT sum(0.009 * ln(1 + ((SELECT count(*) FROM s) + 1.0) / (df + 1))) FROM d WHERE s.code AND term IN ('blue', 'ring') AND list_contains(s.t, term)), 0), 6) AS score FROM s")
def covered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the symbols are functions."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    symbols = part.select(F.col("p_partkey").alias("id"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"), F.when(F.col("p_size") % 3 == 0, "function").otherwise("class").alias("kind"), F.col("p_size").cast("double").alias("score"))
    df = symbols.select("id", F.explode(F.array_distinct(T.lexical_terms(F.col("name")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return ranking.name_coverage(symbols, ["blue", "ring"], df, part.count()).select("id", F.round("score", 6).alias("score"))


TERMS_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^0-9a-z\x{0080}-\x{10FFFF}]+'), lambda t: strlen(t) >= 2)"
ALIAS_ROWS = ", ".join(f"('{w}', {len(more)})" for w, more in T.ALIASES.items())


@query(f"WITH t AS (SELECT doc_id AS id, unnest({TERMS_SQL}) AS term FROM documents), k AS (SELECT id, 1 + coalesce(n, 0) AS n FROM t LEFT JOIN (VALUES {ALIAS_ROWS}) a(word, n) ON a.word = t.term WHERE term NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)})) SELECT doc_id AS id, CAST(coalesce(n, 0) AS INTEGER) AS terms FROM documents LEFT JOIN (SELECT id, sum(n) AS n FROM k GROUP BY 1) s ON s.id = doc_id")
def query_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many terms a text is searched for with, stop words out and aliases in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(F.size(T.query_terms(F.col("text"))), F.lit(0)).alias("terms"))


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE -1 END AS INTEGER) AS arity FROM part")
def signature_arities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """none, one with a nested list, two behind self, two with a quoted comma, and no parentheses."""
    forms = F.array(*[F.lit(x) for x in ("def f()", "f(Map<int, List<int>> a)", "def f(self, a, b=(1, 2))", "f(a = 'x, y', b)", "value")])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int")).alias("signature"))
    return rows.select("id", F.pandas_udf(lambda s: s.map(code.arity), "int")("signature").alias("arity"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN '["array[2]", "number"]' ELSE concat('{"id": "number", "name": "string", "on": "boolean", "sub": {"a": {"b": "object[1]"}, "n": "null"}}') END AS summary FROM part""")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects, lists, and what isn't JSON."""
    text = F.when(F.col("p_partkey") % 4 == 0, "{not json").when(F.col("p_partkey") % 4 == 1, "[1, 2]").otherwise(F.concat(F.lit('{"id": '), F.col("p_partkey").cast("string"), F.lit(', "name": "'), "p_name", F.lit('", "on": true, "sub": {"n": null, "a": {"b": {"c": 1}}}}')))
    return E.json_summaries(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), text.alias("text")))


@query("WITH p AS (SELECT s_suppkey AS id, 100 + s_suppkey * 37 % 900 AS tokens FROM supplier WHERE s_nationkey = 3), u AS (SELECT id, CASE WHEN tokens <= 4000 * 0.6 / (SELECT count(*) FROM p) THEN 'full' ELSE 'skeleton' END AS form, CASE WHEN tokens <= 4000 * 0.6 / (SELECT count(*) FROM p) THEN tokens ELSE tokens // 8 END AS tokens FROM p), s AS (SELECT s_suppkey AS id, (100 + s_suppkey * 37 % 900) // 8 AS tokens, sum((100 + s_suppkey * 37 % 900) // 8) OVER (ORDER BY s_nationkey, s_suppkey) AS run FROM supplier WHERE s_nationkey <> 3) SELECT id, form, CAST(tokens AS BIGINT) AS tokens FROM u UNION ALL SELECT id, 'support', tokens FROM s WHERE run + (SELECT coalesce(sum(tokens), 0) FROM u) <= 4000")
def file_capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivots are one nation's suppliers, the others support them."""
    tokens = F.lit(100) + F.col("s_suppkey") * 37 % 900
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("rank"), tokens.alias("tokens"), F.expr("(100 + s_suppkey * 37 % 900) div 8").alias("skeleton_tokens"))
    return E.by_files(rows.where("rank = 3"), rows.where("rank <> 3"), 4000)


def order_tasks(spark: SparkSession, sf_dir: str) -> int:
    """A task for every 100,000 orders, by a count that Parquet footers answer."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count() // 100_000 + 1


@query("SELECT o_orderkey AS source, CAST(b AS BIGINT) AS block, concat('Case', CAST(b AS VARCHAR)) AS name, CASE WHEN o_orderkey % (b + 1) = 0 THEN 'failed' ELSE 'passed' END AS status, 2 + CASE WHEN o_orderkey % (b + 1) = 0 THEN 1 ELSE 0 END AS n_lines FROM orders, (VALUES (1), (2), (3)) v(b)")
def test_output_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's output has three tests, of which some fail."""
    b = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("b")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("source"), b)
    failed = F.col("source") % (F.col("b") + 1) == 0
    lines = F.array(F.concat(F.lit("=== RUN Case"), F.col("b").cast("string")), F.lit("  step"), F.when(failed, "--- FAIL: it"))
    each = rows.select("source", "b", F.posexplode(F.array_compact(lines)).alias("k", "line"))
    intro = rows.where("b = 1").select("source", F.lit(0).alias("n"), F.lit("starting").alias("line"))
    return logs.test_blocks(intro.unionByName(each.select("source", (F.col("b") * 10 + F.col("k")).alias("n"), "line")), order_tasks(spark, sf_dir))


@query("SELECT doc_id AS id, sha256(concat(CAST(strlen(source) AS VARCHAR), ':', source, '|4:8000|2:e1|1:2|5:dense|')) AS key FROM documents WHERE doc_id % 2 = 1")
def capsule_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the epoch e1, under their keys."""
    epoch = F.when(F.col("doc_id") % 2 == 1, "e1").otherwise("e0")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), epoch.alias("epoch"), T.canonical_fingerprint(F.col("source"), F.lit("8000"), epoch, F.lit("2"), F.lit("dense")).alias("key"))
    return E.current(rows, "e1").select("id", "key")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS bounded_context, CAST(s_suppkey % 3 AS INTEGER) AS n_contracts FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0")
def declared_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declaration files are written and read; another version and entries without a name are left out."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    entry = F.struct(k.cast("string").alias("id"), F.when(k % 5 != 0, F.col("s_name")).alias("name"), F.col("s_nationkey").cast("string").alias("bounded_context"), F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < k % 3), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("contracts"))
    path = new_path(spark, "declarations")
    s.select(F.when(k % 7 == 0, 2).otherwise(1).alias("schema_version"), F.array(entry).alias("capabilities")).write.json(path)
    found = E.declarations(spark, path, lines=True)
    return found.select("id", "name", "bounded_context", F.size("contracts").alias("n_contracts"))


@query("SELECT o_orderkey AS source, concat('src/f', CAST(o_orderkey % 9 AS VARCHAR), '.py') AS path, CAST(o_custkey + 1 AS INTEGER) AS start_line, CAST(o_custkey + o_orderkey % 4 AS INTEGER) AS end_line FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, concat('src/f', CAST(o_orderkey % 9 AS VARCHAR), '.py'), 70, 70 FROM orders")
def diff_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a diff of one file with a hunk, which may only delete, and one of a single line."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    lines = F.array(F.lit("--- a/x"), F.concat(F.lit("+++ b/src/f"), (o % 9).cast("string"), F.lit(".py")), F.concat(F.lit("@@ -1,3 +"), (c + 1).cast("string"), F.lit(","), (o % 4).cast("string"), F.lit(" @@ def f")), F.lit("-gone"), F.lit("@@ -60 +70 @@"), F.lit("+new"))
    return diff_hunks(spark.read.parquet(f"{sf_dir}/orders.parquet").select(o.alias("source"), F.posexplode(lines).alias("n", "line")))


EVERY_KIND = [*kinds.EMBEDDED, "constant", "variable", "import", "parameter"]


@query(f"WITH s AS (SELECT p_partkey AS id, list_extract([{', '.join(repr(k) for k in EVERY_KIND)}], CAST(p_partkey % {len(EVERY_KIND)} + 1 AS INTEGER)) AS kind, CASE p_size % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'javascript' END AS language FROM part) SELECT kind, language, count(*) AS n FROM s WHERE kind NOT IN ('variable', 'import', 'parameter') AND (kind <> 'constant' OR language <> 'python') GROUP BY 1, 2")
def embeddable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    kind = F.element_at(F.array(*map(F.lit, EVERY_KIND)), (F.col("p_partkey") % len(EVERY_KIND) + 1).cast("int"))
    language = F.when(F.col("p_size") % 3 == 0, "typescript").when(F.col("p_size") % 3 == 1, "python").otherwise("javascript")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(kind.alias("kind"), language.alias("language"))
    return kinds.embeddable(rows).groupBy("kind", "language").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, 'table' AS came_from, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'side', sha256(text) FROM documents WHERE doc_id % 2 = 1")
def recovered_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11 for many ids: the table has every second artifact, side files have all."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("content"))
    found = E.recovered_all(rows.where("artifact_id % 2 = 0"), rows, rows.select("artifact_id"))
    return found.select(F.col("artifact_id").alias("id"), "came_from", F.sha2("content", 256).alias("digest"))


@query("SELECT o_orderkey AS query, CAST(i AS INTEGER) AS rank, CASE WHEN i <= 2 THEN 'body' WHEN i <= 5 THEN 'caller' ELSE 'skeleton' END AS form, CAST(CASE WHEN i <= 2 THEN 300 WHEN i <= 5 THEN 40 ELSE 60 END AS BIGINT) AS tokens FROM orders, generate_series(1, 9) g(i) WHERE i <= 5 OR o_orderkey % 3 > 0 AND i <= 5 + o_orderkey % 3")
def symbol_capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: two pivots, three callers, then the support that fits; budgets differ by order."""
    each = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("rank"), (F.lit(720) + F.col("o_orderkey") % 3 * 60).alias("budget"))
    role = F.when(F.col("rank") <= 2, "pivot").when(F.col("rank") <= 5, "caller").otherwise("support")
    return pack.symbol_capsule(each.select("query", "rank", "budget", role.alias("role"), F.lit(300).alias("body_tokens"), F.lit(40).alias("signature_tokens"), F.lit(60).alias("skeleton_tokens")), order_tasks(spark, sf_dir))


SECTIONS = {
    "capability_evidence": ("id", "context", "part"),
    "edge": ("src", "dst", "kind"),
    "embedding": ("vec_id", "label"),
    "files": ("path", "content"),
    "route": ("method", "path", "file", "framework"),
    "symbols": ("file_id", "kind", "name", "signature"),
}
SECTION_TABLES = {"capability_evidence": "capabilities", "edge": "edges", "embedding": "embeddings", "files": "files", "symbols": "symbols", "route": "routes"}


def section_sql(name: str) -> str:
    values = ", ".join(f"strlen(coalesce(CAST({c} AS VARCHAR), '')), ':', coalesce(CAST({c} AS VARCHAR), ''), '|'" for c in SECTIONS[name])
    return f"SELECT '{name}' AS section, sha256(concat({values})) AS h FROM {SECTION_TABLES[name]}"


@query(f"{with_views('files', 'symbols', 'edges', 'capabilities')}, routes AS ({ROUTES_SQL}), r AS ({' UNION ALL '.join(map(section_sql, SECTIONS))}), b AS (SELECT section, left(h, 4) AS bucket, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM r GROUP BY 1, 2), s AS (SELECT section, sha256(string_agg(concat(bucket, d), ',' ORDER BY concat(bucket, d))) AS digest FROM b GROUP BY 1) SELECT section, digest FROM s UNION ALL SELECT '', sha256(string_agg(concat(section, ':', digest), ',' ORDER BY concat(section, ':', digest))) FROM s")
def manifest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: six sections of what an index holds."""
    tables = {n: view(spark, sf_dir, SECTION_TABLES[n]) for n in ("capability_evidence", "edge", "files", "symbols")}
    tables |= {"embedding": spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "route": K.route_rows(sources(spark, sf_dir))}
    return J.section_digests({n: tables[n].select(*SECTIONS[n]) for n in SECTIONS})
