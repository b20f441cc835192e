"""Evidence operators on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import evidence as E


def test_observed(spark):
    methods = spark.createDataFrame([("Orders", "Place", "a|Orders|Place"), ("Orders", "Cancel", "a|Orders|Cancel"), ("Orders", "Cancel", "b|Orders|Cancel")], "service string, method string, identity string")
    files = [
        ("f", "x.js", "app.post('/a', function h() {})\napp.get('b', function h() {})\nrouter.get('/c', named)"),
        ("g", "x.py", "requests.get(\"https://Host/b?q=1\")\nrequests.get(url)"),
        ("h", "x.js", "BROKER = 'Main'\nTOPIC = 't'\nproducer.send(TOPIC)"),
        ("i", "x.js", "topic: 't'\nsubscribe(topic, f)"),
        ("j", "x.cs", "Orders.OrdersClient c;\nc.PlaceAsync(1);\nc.CancelAsync(1);"),
        ("k", "X.java", "class Orders { public R place(Q q) {} public R cancel(Q q) {} }"),
        ("l", "x.cs", "c.PlaceAsync(1);"),
        ("m", "x.js", None),
    ]
    got = {tuple(r) for r in E.observed(spark.createDataFrame(files, "file string, path string, text string"), methods).collect()}
    assert got == {
        ("f", "http", "provider", "POST|/a"),
        ("g", "http", "consumer", "host|GET|/b"),
        ("h", "topic", "provider", "kafka|main|t"),
        ("i", "topic", "consumer", ""),
        ("j", "grpc", "consumer", "a|Orders|Place"),
        ("j", "grpc", "consumer", ""),
        ("k", "grpc", "provider", "a|Orders|Place"),
        ("l", "grpc", "consumer", ""),
    }


def test_asyncapi(spark):
    one = "asyncapi: 2.0\nservers:\n  main:\n    url: mq\nchannels:\n  orders.created:\n    publish:\n      x: 1\n"
    two = one + "  orders.gone:\n    subscribe:\n"
    got = {(r.file, r.role, r.channel) for r in E.asyncapi(spark.createDataFrame([("a", one), ("b", two), ("c", "x")], "file string, text string")).collect()}
    assert got == {("a", "provider", "orders.created"), ("b", "unknown", "orders.created"), ("b", "unknown", "orders.gone")}


def test_nearest_function(spark):
    lines = spark.createDataFrame([("f", 1, "x"), ("f", 2, "function a() {"), ("f", 3, "y"), ("f", 4, "def b():"), ("f", 5, "z")], "file string, n int, line string")
    assert [r.owner for r in E.nearest_function(lines).orderBy("n").collect()] == [None, "a", "a", "b", "b"]


def test_differs(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,), (1,)], "x int")
    assert not E.differs(a, b) and E.differs(a, b.distinct())


def test_shapes(spark):
    body = "if (x) return res.json({ id: 1, 'total': {a: 2}, name });\nreturn res.json({...rest, id});"
    got = [(r.response, r["keys"], r.closed) for r in E.response_shapes(spark.createDataFrame([(1, body)], "id long, body string")).orderBy("response").collect()]
    assert got[0] == (0, ["id", "name", "total"], True) and got[-1][2] is False


def test_execution_nodes(spark):
    symbols = spark.createDataFrame([(1, "x"), (2, "db.save(x)"), (3, "fetch(u)"), (4, "y")], "id long, text string")
    proof = spark.createDataFrame([(1, "http", "provider"), (4, "http", "consumer")], "id long, surface string, role string")
    assert {r.id: r.kind for r in E.execution_nodes(symbols, proof).collect()} == {1: "http_handler", 2: "output_persistence", 3: "output_external_http", 4: "symbol"}


def test_capped(spark):
    rows, more = E.capped(spark.range(10), 4)
    assert [r.id for r in rows.collect()] == [0, 1, 2, 3] and more and not E.capped(spark.range(4), 4)[1]


def test_json_summary(spark):
    assert json.loads(E.json_summary('{"b": [1, 2], "a": {"x": null, "y": true}}')) == {"a": {"x": "null", "y": "boolean"}, "b": ["array[2]", "number"]}
    rows = spark.createDataFrame([(1, "[]"), (2, "no"), (3, None)], "id long, text string")
    assert {r.id: r.summary for r in E.json_summaries(rows).collect()} == {1: '["array[0]"]', 2: "", 3: ""}


def test_validation(spark):
    rows = spark.createDataFrame([("2024-02-29T10:00:00Z", True), ("2023-02-29T10:00:00Z", False), ("2024-02-29", False)], "v string, want boolean")
    assert all(bool(r.got) == r.want for r in rows.select(E.valid_timestamp(F.col("v")).alias("got"), "want").collect())
    ids = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", True), ("123e4567", False)], "v string, want boolean")
    assert all(r.got == r.want for r in ids.select(E.valid_uuid(F.col("v")).alias("got"), "want").collect())
    assert spark.createDataFrame([(b"a\xffb",)], "b binary").select(E.valid_utf8(F.col("b")).alias("t")).first().t == "a�b"


def test_incremental_files_and_declarations(spark, tmp_path):
    files = spark.createDataFrame([("/r/a.py",), ("/r/b.txt",), ("/x/c.py",), ("/r/d.py",)], "path string")
    assert [r.path for r in E.wanted_files(files, files.where("path <> '/r/d.py'"), "/r", [".py"]).collect()] == ["/r/a.py"]
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 1, "capabilities": [{"id": "i", "name": "n", "contracts": ["c"]}, {"id": "j"}]}))
    assert [(r.id, r.contracts) for r in E.declarations(spark, str(tmp_path / "d.json")).collect()] == [("i", ["c"])]


def test_artifacts_cache_and_queues(spark):
    table, side = spark.createDataFrame([("a", "1")], "artifact_id string, content string"), spark.createDataFrame([("a", "2"), ("b", "3")], "artifact_id string, content string")
    assert [E.recovered(table, side, k).first().content for k in "ab"] == ["1", "3"] and E.recovered(table, side, "z").isEmpty()
    keys = spark.range(1).select(E.cache_key("q", 1, "e", "v", "m").alias("a"), E.cache_key("q1", 1, "e", "v", "m").alias("b")).first()
    assert keys.a != keys.b
    queue = spark.createDataFrame([("a", 1)] * 3 + [("b", 90), ("c", 5)], "queue string, age_seconds int")
    assert {r.queue for r in E.due(queue, 3, 60).collect()} == {"a", "b"}
    assert E.synced(lambda: table, lambda t: False, lambda: side)[1] == "rebuilt"


def test_file_packing_and_expansion(spark):
    pivots = spark.createDataFrame([(1, 1, 20, 5), (2, 2, 200, 10)], "id long, rank int, tokens long, skeleton_tokens long")
    support = spark.createDataFrame([(3, 1, 0, 30), (4, 2, 0, 30), (5, 3, 0, 30)], "id long, rank int, tokens long, skeleton_tokens long")
    assert {(r.id, r.form) for r in E.by_files(pivots, support, 100).collect()} == {(1, "full"), (2, "skeleton"), (3, "support"), (4, "support")}
    chosen = spark.createDataFrame([(1, 1, "run", "calls helper with configuration")], "file_id long, id long, name string, body string")
    others = spark.createDataFrame([(1, 2, "helper", "x"), (1, 3, "other", "run it"), (1, 4, "third", "configuration"), (1, 5, "none", "y"), (2, 6, "helper", "run")], "file_id long, id long, name string, body string")
    assert [(r.id, r.score) for r in E.expanded(chosen, others).orderBy("id").collect()] == [(2, 6), (3, 1), (4, 1)]


def test_filtered_knn(spark):
    rows = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "n", [1.0, 0.0]), (3, "m", [0.0, 1.0])], "id long, model string, embedding array<double>")
    assert [r.id for r in E.filtered_knn(rows, [1.0, 0.0], {"model": "m"}, 2).collect()] == [1, 3]
    with pytest.raises(ValueError):
        E.filtered_knn(rows, [1.0], {}, 201)
