"""Operators on literal rows, with the outcomes that their rules ask for."""

import math
import random

from pyspark.sql import functions as F

from corvane.functions import code
from corvane.functions import text as T
from corvane.operators import capability, contracts, dialogue, graph, index, intervals, journal, kinds, logs, pack, ranking, resolve, retrieval, sync
from corvane.sources import files as sources
from corvane.streaming import twins


def column(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("o")).first().o


def test_terms(spark):
    got = column(spark, lambda v: T.memory_terms(v, 4), "Session_Start session_start auth/token.cpp X exact-match ninth tenth")
    assert got == ["session_start", "auth/token.cpp", "exact-match", "ninth"]
    assert column(spark, T.lexical_terms, "parseHTTPFile a é x1, Ünder") == ["parse", "httpfile", "é", "x1", "ünder"]
    assert column(spark, T.normalized_name, "parseUser-ID  v2") == "parse user id v2"
    assert column(spark, T.estimate_tokens, "éé") == 1
    assert column(spark, T.truncated, "x" * 300) == "x" * 197 + "..."


def test_log_lines_and_classes(spark):
    assert column(spark, T.normalized_message, "2024-01-02 03:04:05.678 ERROR: user 5  at 0x1f 77") == "user # at 0x1f #"
    assert column(spark, T.normalized_message, "Jan  2 03:04:05 host kernel: oom 12") == "oom #"
    assert column(spark, T.log_level, "it cannot be") == "error"
    for text, kind in (("", "text"), ('  {"a": 1}\n', "json"), ("diff --git a b\n@@ -1 +1 @@", "diff"), ("x [error] a\ny [info] b", "log"), ("import x", "source"), ("# t\n- a", "markdown"), ("a\x00b", "binary"), ("plain", "text")):
        assert column(spark, T.content_class, text) == kind, text


def test_query_terms(spark):
    assert column(spark, T.query_terms, "como salvar the Estado, x2") == ["salvar", "save", "persist", "persistence", "estado", "state", "x2"]


def test_name_coverage(spark):
    scored = spark.createDataFrame([(1, "save_state", "function", 1.0), (2, "save_state", "class", 1.0), (3, "other", "method", 1.0)], "id long, name string, kind string, score double")
    df = spark.createDataFrame([("save", 3), ("state", 1)], "term string, df long")
    got = {r.id: r.score for r in ranking.name_coverage(scored, ["save", "gone"], df, 9).collect()}
    assert math.isclose(got[1], 1 + 0.009 * math.log(1 + 10 / 4)) and got[2] == got[3] == 1.0


def test_kinds(spark):
    symbols = spark.createDataFrame([(1, "method", "go"), (2, "variable", "go"), (3, "constant", "go"), (4, "constant", "typescript")], "id long, kind string, language string")
    assert [r.id for r in kinds.embeddable(symbols).orderBy("id").collect()] == [1, 4]
    assert [kinds.simple_name(n) for n in ("a::b", "a.b.c", "x#y", "z")] == ["b", "c", "y", "z"]
    spans = spark.createDataFrame([(1, 1, 1, 50, "class"), (2, 1, 5, 20, "method"), (3, 1, 6, 8, "method"), (4, 2, 6, 7, "method")], "id long, file_id long, start_line int, end_line int, kind string")
    assert {r.id: r.owner for r in intervals.owners(spans).collect()} == {2: 1, 3: 2}
    assert {r.id: r.owner for r in intervals.owners(spans, kinds.OWNERS).collect()} == {2: 1, 3: 1}


def test_operations_rank_files(spark):
    scored = spark.createDataFrame([(1, 1.0), (2, 1.0)], "file_id long, score double")
    terms = spark.createDataFrame([(1, "save", 1), (1, "load", 1), (2, "save", 1)], "file_id long, term string, df long")
    got = {r.file_id: r.score for r in ranking.files_by_best(scored, terms, 9, ["save", "load"]).collect()}
    each = 0.008 * math.log(1 + 10 / 2)
    assert math.isclose(got[1], 1 + 2 * each + 0.07) and math.isclose(got[2], 1 + each)


def test_paths(spark):
    for path, yes in (("src/tests/a.py", True), ("src/test_a.py", True), ("src/a_test.go", True), ("a.spec.ts", True), ("x/PayTests.java", True), ("src/attest.py", False), ("contest/a.py", False)):
        assert column(spark, T.is_test_path, path) is yes, path
    assert column(spark, T.url_host, "https://API.example.com:80/v1?q") == "api.example.com"
    assert column(spark, T.url_path, "https://a.b") == "/"


def test_rank_fusion(spark):
    s = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, semantic_rank int")
    x = spark.createDataFrame([(30, 1), (40, 2), (10, 3)], "id long, lexical_rank int")
    got = {r.id: r.rrf for r in retrieval.fused(s, x).collect()}
    assert len(got) == 4 and max(got, key=got.get) in (10, 30) and math.isclose(got[10], 1 / 61 + 1 / 63)


def test_authority_weighs(spark):
    obs = spark.createDataFrame([(1, "a", 0.01), (2, "a", 1.0), (3, "a", 99.0), (4, "zzz", float("nan"))], "id long, content string, authority double")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2])], "id long, embedding array<double>")
    got = retrieval.memory_search(obs, vec, [1.0, 0.0], ["zzz"], 4).collect()
    assert [r.id for r in got][0] == 3 and [r.id for r in got][-1] == 1


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish")], "id long, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, ["cat"]).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert got == {1: round(want(1, 2), 6), 2: round(want(2, 3), 6)}


def test_components_and_reach(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.range(60), edges).collect()}
    assert got == {i: root(i) for i in range(60)}
    depth, frontier = {5: 0}, {5}
    while frontier:
        frontier = {b for a, b in pairs if a in frontier} - depth.keys()
        depth |= dict.fromkeys(frontier, max(depth.values()) + 1)
    start = spark.createDataFrame([(5,)], "id long")
    assert {r.id: r.depth for r in graph.reached(edges, start).collect()} == depth
    assert {r.id: r.depth for r in graph.reached(edges, start, 1).collect()} == {k: v for k, v in depth.items() if v <= 1}


def test_execution_paths(spark):
    rows = [("a", "d"), ("d", "e"), ("d", "f"), ("d", "a"), ("b", "d"), ("c", "f")]
    edges = spark.createDataFrame([(*r, "calls", "observed" if r != ("d", "f") else "inferred") for r in rows], "src string, dst string, kind string, evidence string")
    entries, stops = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("e",), ("f",)], "id string")
    got = graph.simple_paths(edges, entries, stops).collect()
    assert [r.path for r in got] == [["a", "d", "e"], ["a", "d", "f"], ["b", "d", "e"], ["b", "d", "f"], ["c", "f"]]
    assert got[1].kinds == ["calls", "calls"] and got[1].evidence == ["observed", "inferred"] and got[1].uncertain == [False, True] and not got[1].truncated
    for limits in ({"most": 2}, {"branching": 2}, {"depth": 1}):
        assert all(r.truncated for r in graph.simple_paths(edges, entries, stops, **limits).collect()), limits
    assert len(graph.simple_paths(edges, entries, stops, branching=2, most=2).collect()) == 2
    assert [r.path for r in graph.simple_paths(edges, stops, stops).collect()] == [["e"], ["f"]]  # an entry that is an end


def brute_budgeted(edges, start, size, most, limit):
    """The queue of the rule, one node after the other."""
    seen, queue, used, out = set(start), [(n, 0) for n in sorted(start)], 0, {}
    while queue:
        node, depth = queue.pop(0)
        used += size.get(node, 0) if depth else 0
        expands = depth == 0 or used < limit
        out[node] = (depth, used, expands)
        if expands and depth < most:
            for ends in (sorted({b for a, b in edges if a == node}), sorted({a for a, b in edges if b == node})):
                for n in ends:
                    if n not in seen:
                        seen.add(n)
                        queue.append((n, depth + 1))
    return out


def test_budgeted_search_stops_at_what_does_not_expand(spark):
    rng = random.Random(12)
    for limit_tokens in (0, 60, 100_000):
        pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
        size = {n: rng.randrange(0, 30) for n in range(36)}
        frame = spark.createDataFrame(pairs, "src long, dst long")
        sizes = spark.createDataFrame(list(size.items()), "id long, size long")
        got = graph.budgeted(frame, spark.createDataFrame([(1,), (7,)], "id long"), sizes, 3, limit_tokens).collect()
        assert {r.id: (r.depth, r.bytes, r.expands) for r in got} == brute_budgeted(pairs, [1, 7], size, 3, limit_tokens * 4 * 40 // 100)


def test_call_resolution(spark):
    symbols = [(1, "run", 1, "Alpha", 1, False), (2, "run", 1, "Beta", 2, False), (3, "run", 2, "Service", 1, False), (4, "run", 2, "Other", 1, False), (5, "go", 3, None, None, True), (6, "go", 4, None, -1, False), (7, "self_run", 5, "S", 0, False), (8, "self_run", 5, "S", 1, False)]
    calls = [
        ("qualifier and arity", 1, "run", "Beta", 2, None, -1, (2, 152)),
        ("the receiver", 2, "run", "this", 1, "Service", -1, (3, 152)),
        ("no hints", 2, "run", "", -1, None, -1, (3, 22)),
        ("implicit owner", 9, "run", "", -1, "other", -1, (4, 42)),
        ("capital of another owner", 1, "run", "Gamma", -1, None, -1, (1, -78)),
        ("small letters of another owner", 1, "run", "gamma", -1, None, -1, (1, 22)),
        ("tests give way", 9, "go", "", 3, None, -1, (6, 2)),
        ("self", 5, "self_run", "self", 0, "S", -1, (7, 152)),
        ("its own caller", 5, "self_run", "self", 0, "S", 7, None),
        ("unknown name", 5, "nothing", "", 0, None, -1, None),
    ]
    c = spark.createDataFrame([x[:7] for x in calls], "id string, file_id long, callee string, qualifier string, argument_count int, caller_owner string, caller long")
    got = {r.id: (r.target, r.score) for r in resolve.best_targets(c, spark.createDataFrame(symbols, "id long, name string, file_id long, owner string, arity int, test boolean")).collect()}
    assert got == {x[0]: x[7] for x in calls if x[7]}


def test_self_loops_count_once(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    assert {r.id: r.n for r in graph.reference_counts(spark.range(4), edges).collect()} == {0: 0, 1: 2, 2: 1, 3: 0}


TRUTH = {
    "exact": ({"name": "pay", "contracts": "Auth", "endpoints": "POST/a", "events": "e", "structure": "x", "tests": "t"}, {}, "exact_duplicate"),
    "convergent": ({"name": "inv", "contracts": "Inv", "endpoints": "POST/i", "events": "e"}, {}, "convergent_capability"),
    "primitive": ({"contracts": "Key", "endpoints": "POST/k", "events": "r"}, {}, "shared_primitive_candidate"),
    "special": ({"contracts": "Pol", "structure": "p"}, {"endpoints": ("l", "r")}, "local_specialization"),
    "coincidence": ({"name": "same"}, {"context": ("c1", "c2")}, "semantic_coincidence"),
    "weak": ({"name": "weak"}, {}, "insufficient_evidence"),
}


def test_classification(spark):
    for case, (shared, own, want) in TRUTH.items():
        rows = [(i, i, s, f"{case}{e}") for i in (1, 2) for s, e in shared.items()]
        rows += [(i, i, s, v[i - 1]) for i in (1, 2) for s, v in own.items() if s != "context"]
        signatures = [(i, i, own.get("context", ("c", "c"))[i - 1]) for i in (1, 2)]
        rows += [(3, 1, s, f"{case}{e}") for s, e in shared.items()]  # of the first one's repository
        found = capability.candidates(spark.createDataFrame(rows, "id long, repository long, signal string, element string"), spark.createDataFrame([*signatures, (3, 1, "z")], "id long, repository long, context string")).collect()
        assert {(r.a, r.b) for r in found} == {(1, 2), (2, 3)}
        assert next(r for r in found if r.b == 2).classification == want, case


def test_semantic_hint_alone(spark):
    elements = spark.createDataFrame([(1, 1, "name", "a"), (2, 2, "name", "b")], "id long, repository long, signal string, element string")
    signatures = spark.createDataFrame([(1, 1, None), (2, 2, None)], "id long, repository long, context string")
    hints = spark.createDataFrame([(1, 2, 0.99)], "a long, b long, raw double")
    (r,) = capability.candidates(elements, signatures, hints).collect()
    assert r.classification == "insufficient_evidence" and r.confidence <= 0.4 and "fewer than two signals" in r.invalidators


def test_fan_out(spark):
    """Whatever the block, the greedy choice over all pairs."""
    rng = random.Random(13)
    rows = [(a, b, float(rng.randrange(12))) for a in range(14) for b in range(a + 1, 14)]
    want, used = [], {}
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(want) < 17 and used.get(a, 0) < 3 and used.get(b, 0) < 3:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b))
    for block in (1, 7, 1000):
        got = capability.fanned_out(spark.createDataFrame(rows, "a long, b long, final_score double"), per_capability=3, most=17, block=block).collect()
        assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_drift(spark):
    d, o = spark.createDataFrame([("a",), ("b",), ("d",)], "key string"), spark.createDataFrame([("b",), ("c",), ("d",), ("d",)], "key string")
    assert {r.key: r.status for r in capability.drift(d, o).collect()} == {"a": "declaration_without_observed", "b": "matched", "c": "observed_without_declaration", "d": "ambiguous_match"}


def test_contract_links(spark):
    rows = [
        (1, "orders", "http", "provider", "orders|POST|/v1", ""), (2, "billing", "http", "consumer", "orders|POST|/v1", ""), (3, "orders", "http", "consumer", "orders|POST|/v1", ""),
        (4, "a", "grpc", "declaration", "pkg|S|M", ""), (5, "a", "grpc", "provider", "pkg|S|M", ""), (6, "b", "grpc", "consumer", "S|M", ""), (7, "b", "grpc", "consumer", "S|Other", ""),
        (8, "x", "topic", "declaration", "t1", "provider"), (9, "y", "topic", "declaration", "t1", "consumer"),
        (10, "o", "openapi", "declaration", "o|getThing", ""), (11, "o", "http", "declaration", "o|GET|/t", "operationId=getThing"), (12, "c", "http", "consumer", "o|GET|/t", ""),
    ]
    got = {(r.provider, r.consumer, r.basis) for r in contracts.links(spark.createDataFrame(rows, "id long, repository string, surface string, role string, identity string, detail string")).collect()}
    assert got == {(1, 2, "exact"), (5, 6, "declaration_resolved"), (8, 9, "exact"), (10, 12, "exact")}


def test_field_verdicts(spark):
    accesses = spark.createDataFrame([("l", f, "o", q, d) for f, q, d in (("id", True, False), ("amount", True, False), ("discount", False, False), ("", False, True))], "link string, field string, origin string, required boolean, dynamic boolean")
    fields = spark.createDataFrame([("l", "id", True), ("l", "status", True)], "link string, field string, guaranteed boolean")
    for closed, amount in ((True, "proven"), (False, "possible")):
        shapes = spark.createDataFrame([("l", closed, "observed")], "link string, closed boolean, closure string")
        assert {r.field: r.verdict for r in contracts.field_verdicts(accesses, shapes, fields).collect()} == {"": "unknown", "amount": amount, "discount": "possible", "id": "compatible"}


def test_declared_contracts(spark):
    yaml = ["paths:", "  /orders:", "    get:", "      operationId: listOrders", "    post:", "      operationId: 'createOrder'"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(yaml)], "file string, n int, line string")
    assert {(r.method, r.path, r.operation) for r in contracts.openapi_rows(lines).collect()} == {("GET", "/orders", "listOrders"), ("POST", "/orders", "createOrder")}
    proto = "package shop.v1;\nservice Orders { rpc Get (A) returns (B); rpc Put(C) returns (D); }"
    files = spark.createDataFrame([("p", proto)], "file string, text string")
    assert {r.identity for r in contracts.protobuf_rows(files).collect()} == {"shop.v1|Orders|Get", "shop.v1|Orders|Put"}
    routes = spark.createDataFrame([("r", "x.js", "app.get('/a', f)\n@app.post(\"/b\")\n@bp.route('/c', methods=['PUT'])"), ("n", "app/users/[id]/route.ts", ""), ("p", "pages/api/auth.ts", None), ("q", "src/route.ts", "")], "file string, path string, text string")
    assert {(r.framework, r.method, r.path) for r in contracts.route_rows(routes).collect()} == {("express", "GET", "/a"), ("fastapi", "POST", "/b"), ("flask", "ANY", "/c"), ("nextjs", "ANY", "/users/[id]"), ("nextjs", "ANY", "/api")}


def test_handoffs(spark):
    rows = [(1, 1, "claim", "a"), (1, 2, "claim", "b"), (1, 3, "complete", "b"), (1, 4, "complete", "a"), (1, 5, "cancel", "a"), (2, 1, "complete", "a"), (2, 2, "cancel", "x"), (3, 1, "claim", "a"), (3, 2, "claim", "a")]
    got = {r.id: (r.state, r.agent) for r in journal.handoff_states(spark.createDataFrame(rows, "id long, sequence int, action string, actor string")).collect()}
    assert got == {1: ("completed", "a"), 2: ("cancelled", ""), 3: ("claimed", "a")}


def test_journal(spark):
    rows = [(1, 1, "upsert", "a", "x"), (1, 2, "upsert", "b", "y"), (1, 3, "delete", "a", "z"), (2, 1, "upsert", "a", "q"), (2, 3, "upsert", "a", "r")]
    events = spark.createDataFrame(rows, "stream long, sequence long, op string, entity string, digest string")
    assert {(r.stream, r.entity, r.digest) for r in journal.folded(events).collect()} == {(1, "b", "y"), (2, "a", "r")}
    assert {(r.stream, r.entity) for r in journal.tombstones(events).collect()} == {(1, "a")}
    assert {r.stream: (r.gaps, r.next) for r in journal.contiguity(events).collect()} == {1: (0, 4), 2: (1, 4)}


def test_digests_and_budget(spark):
    turns = spark.createDataFrame([(i, 1, i, f"t{i}", i % 2 == 0) for i in range(30)], "id long, session_id long, turn long, text string, anchored boolean")
    lines = dialogue.digests(turns).first().digest.split("\n")
    assert lines[0] == "t0" and lines[-1] == "t29" and len(lines) == 12
    sized = turns.withColumn("tokens", F.lit(10))
    assert dialogue.within_budget(sized, "session_id", ["id"], "tokens", 35).count() == 3


def test_logs(spark):
    lines = spark.createDataFrame([("FATAL x",), ("warning: y 1",), ("WARN y 2",), ("warning: y 2",), ("information",)], "line string")
    assert {r.level: r.n for r in logs.level_histogram(lines).collect()} == {"fatal": 1, "warn": 3, "info": 1}
    assert [(r.message, r.n) for r in logs.repeats(lines).collect()] == [("y #", 2)]
    diags = spark.createDataFrame([("a.ts(1,2): error TS1: m",), ("a.ts(3,4): error TS1: n",), ("b.cc:1:2: warning: unused [-Wunused]",), ("noise",)], "line string")
    assert {(r.file, r.code, r.severity, r.n) for r in logs.diagnostics(diags).collect()} == {("a.ts", "TS1", "error", 2), ("b.cc", "-Wunused", "warning", 1)}
    blocks = spark.createDataFrame([("s", i, x) for i, x in enumerate(["head", "=== RUN TestA", "ok", "=== RUN TestB", "--- FAIL: TestB"])], "source string, n int, line string")
    assert {r.name: (r.status, r.n_lines) for r in logs.test_blocks(blocks).collect()} == {"TestA": ("passed", 2), "TestB": ("failed", 2)}


def test_packing(spark):
    rows = [("q", i, i, t) for i, t in enumerate([50, 40, 30, 20, 10])]
    got = pack.skipping(spark.createDataFrame(rows, "query string, id long, rank int, tokens long"), 100).first()
    used, kept = 0, []
    for _, i, _, t in rows:
        if used + t <= 100:
            used, kept = used + t, [*kept, i]
    assert (got.used, got.kept) == (used, kept)


def test_companions(spark):
    rows = [(1, 1, ["a", "b"]), (1, 2, ["b", "c", "d"]), (1, 3, ["a"]), (2, 4, []), (2, 5, ["x"])]
    got = {r.file_id: r.chosen for r in ranking.companions(spark.createDataFrame(rows, "file_id long, id long, terms array<string>")).collect()}
    assert got == {1: [2, 1], 2: [5]}


def test_code():
    assert code.without_comments('a = "//x"; // c\n/* m\nn */b') == 'a = "//x"; \n\nb'
    assert code.without_comments("x = '#' # y", hashes=True) == "x = '#' "
    assert [code.arity(s) for s in ("run(self, value)", "run(self)", "f()", "f(a, b: Map<K, V>, c = (1, 2))", "x")] == [1, 0, 0, 3, -1]
    python = "import os\nfrom a.b import c\nclass A:\n    def f(self, x):\n        return g(x, 1)\n"
    symbols, imports, calls = code.parsed("m.py", python)
    assert [(s[0], s[1], s[2], s[3]) for s in symbols] == [("A", "class", 3, 5), ("f", "method", 4, 5)] and imports == ["os", "a.b"] and calls == [("g", "", 2, 5)]
    assert code.skeleton("m.py", python) == "class A\n  def f(self, x)"
    js = "import {x} from './y';\nexport function run(a, b) {\n  // call()\n  return svc.go(a);\n}\n"
    symbols, imports, calls = code.parsed("m.ts", js)
    assert [(s[0], s[1], s[2], s[3]) for s in symbols] == [("run", "function", 2, 5)] and imports == ["./y"] and ("go", "svc", 1, 4) in calls
    assert code.parsed("bad.py", "def (") == ([], [], [])


def test_data_traces():
    assert code.traced("const q = req.body;\nconst s = q;\ndb.query(s);") == ("confirmed", "db.query")
    assert code.traced("const q = req.body;\nconst s = clean(q);\ndb.query(s);")[0] == "unknown"
    assert code.traced("let s = 'x';\nif (a) {\n  s = req.query;\n}\ndb.query(s);")[0] == "unknown"
    assert code.traced("const q = req.body;\ndb.query('select 1');") == ("none", "")


def test_ignore_rules_and_diffs(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/build/x.o", "build/y", "src/a.py", "src/keep/a.log", "b.log", "src/deep/er/z.tmp", "doc/q1.md")], "path string")
    got = {r.path for r in sources.kept_paths(paths, ["build/", "*.log", "!src/keep/*.log", "src/**/*.tmp", "/doc/q?.md"]).collect()}
    assert got == {"src/a.py", "src/keep/a.log"}
    diff = ["diff --git a/x b/x", "+++ b/x", "@@ -1,2 +3,4 @@", "@@ -9 +12 @@", "+++ b/y", "@@ -5,3 +4,0 @@"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(diff)], "source string, n int, line string")
    assert {(r.path, r.start_line, r.end_line) for r in sources.diff_hunks(lines).collect()} == {("x", 3, 6), ("x", 12, 12)}


def test_file_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/m.py").write_text("def f():\n    return 1\n")
    (tmp_path / "n.txt").write_text("x")
    tree = sources.tree(spark, str(tmp_path), "*.py")
    assert [r.content for r in tree.collect()] == ["def f():\n    return 1\n"]
    (r,) = code.parse_files(tree.select(F.lit(1).cast("long").alias("id"), "path", "content")).collect()
    assert r.symbols[0].name == "f" and r.skeleton == "def f()"


def test_snapshots(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, hash string"), spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id long, hash string")
    assert {r.id: r.status for r in sync.diff(old, new).collect()} == {1: "deleted", 2: "unchanged", 3: "changed", 4: "added"}
    assert {r.id: r.hash for r in sync.upserted(old, new).collect()} == {1: "a", 2: "b", 3: "x", 4: "d"}


def test_applied_stream_keeps_its_cursor(spark, tmp_path):
    schema = "stream long, sequence long"
    for k, rows in enumerate(([(1, 1), (1, 2)], [(1, 2), (1, 3), (2, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path))
        if k == 0:
            assert {(r.sequence, r.status) for r in twins.drained(twins.apply_batches(stream), "append").collect()} == {(1, "applied"), (2, "applied")}
    got = [(r.stream, r.sequence, r.status) for r in twins.drained(twins.apply_batches(spark.readStream.schema(schema).parquet(str(tmp_path))), "append").collect()]
    assert sorted(got) == [(1, 1, "applied"), (1, 2, "applied"), (1, 2, "duplicate"), (1, 3, "applied"), (2, 2, "conflict")]


def test_stored_index_scores_as_a_scan(spark):
    texts = ["the cat and the hat", None, "", "a hat of felt; the end", "nothing here", "the the the", "Hat hat HAT the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    built = index.build(docs)
    for terms in (["the", "hat"], ["absent"], ["felt"], []):
        want = {r.id: r.score for r in retrieval.bm25(docs.where("text is not null").unionByName(docs.where("text is null").withColumn("text", F.lit(""))), terms).collect()} if terms else {}
        assert {r.id: r.score for r in index.bm25(built, terms).collect()} == want, terms
    assert index.stored(spark, "k", docs) is index.stored(spark, "k", docs)


def test_imports_resolve_by_stage(spark):
    files = [(1, "src/auth.py"), (2, "tests/test_auth.py"), (3, "lib/users/index.ts"), (4, "core/mod.rs"), (5, "types/api.d.ts"), (6, "other/src/auth.py"), (7, "noext")]
    asked = [(9, "./auth", 1), (9, " ../src/auth ", 6), (6, "src/auth", 1), (9, "../lib/users", 3), (9, "app::core::thing", 4), (9, "api", 5), (9, "res://src/auth.py", 1), (9, "res://auth.py", -1), (9, "test_auth", 2), (2, "test_auth", -1), (9, "a", -1), (9, "", -1), (9, "pkg.auth.Login", 1), (9, "noext", -1)]
    spec = spark.createDataFrame([a[:2] for a in asked], "from_file long, specifier string")
    got = {(r.from_file, r.specifier): r.target for r in resolve.resolved_imports(spec, spark.createDataFrame(files, "id long, path string")).collect()}
    assert got == {a[:2]: a[2] for a in asked}


def test_declarations_against_what_is_observed(spark):
    schema = "id string, name string, context string, contracts array<string>"
    observed = spark.createDataFrame([("a", "pay", "x", ["c", "d"]), ("b", "pay", None, ["c"]), ("c", "lone", "x", []), ("d", "bare", "x", [])], schema)
    declared = spark.createDataFrame([("1", "pay", "x", ["c"]), ("2", "pay", "y", ["c"]), ("3", "gone", "", ["c"]), ("4", "bare", "", [])], schema)
    got = {r.id: (r.status, r.declaration, r.score) for r in capability.declaration_drift(observed, declared).collect()}
    assert got == {"a": ("matched", "1", 0.8), "b": ("ambiguous_match", None, None), "c": ("observed_without_declaration", None, None), "d": ("matched", "4", 0.6), "3": ("declaration_without_observed", None, None)}


def test_section_digests_see_every_row(spark):
    def of(rows, more=()):
        table = spark.createDataFrame(rows, "a long, b string").repartition(3)
        return {r.section: r.digest for r in journal.section_digests({"x": table, "y": spark.createDataFrame([(1, *more)] if more else [(1, "z")], "a long, b string")}).collect()}

    rows = [(i, f"v{i}") for i in range(50)] + [(7, None)]
    first = of(rows)
    assert set(first) == {"x", "y", ""} and first == of(rows[::-1])
    for other in (rows[1:], [*rows, rows[0]], [(0, "w"), *rows[1:]]):
        changed = of(other)
        assert changed["x"] != first["x"] and changed["y"] == first["y"] and changed[""] != first[""]


def test_pending_writes(spark):
    pending = [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (1, 4, "a"), (2, 1, ""), (3, 1, "c"), (4, 1, "d")]
    got = journal.claimed(spark.createDataFrame(pending, "batch long, seq long, line string"), spark.createDataFrame([(1, 2), (3, 3)], "batch long, attempts int"))
    assert {r.batch: (r.status, r.attempt, r.lines) for r in got.collect()} == {1: ("claimed", 3, ["a", "b"]), 2: ("acknowledged", 0, []), 3: ("quarantined", 0, []), 4: ("claimed", 1, ["d"])}
