"""Steps whose rows must not grow with the square of a key's rows: results against plain loops, and rows that joins make."""

import random

from corvane.operators import capability, resolve
from corvane.plans import sources


def joined_rows(df):
    """The rows of ``df``, and the most that one join of its plan made."""
    rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
    return rows, most


def test_calls_of_a_common_name(spark):
    rng = random.Random(5)
    owners = [None, "Alpha", "alpha", "Beta", ""]
    symbols = [(k, rng.choice(["run", "go"]), rng.randrange(4), rng.choice(owners), rng.choice([None, -1, 0, 1]), rng.random() < 0.5) for k in range(300)]
    calls = [(k, rng.randrange(5), rng.choice(["run", "go", "none"]), rng.choice([None, "", "this", "SELF", "Alpha", "beta", "Gamma"]), rng.choice([None, -1, 0, 1]), rng.choice([None, "Alpha", "beta", ""]), rng.randrange(-1, 40)) for k in range(300)]

    def score(c, s):
        qualifier, owner, mine = c[3] or "", s[3], c[5]
        expected = mine if qualifier.lower() in ("this", "self") and mine is not None else qualifier
        if expected != "" and owner is not None:
            named = 100 if owner.lower() == expected.lower() else -100 if expected[0].isupper() else 0
        else:
            named = 40 if qualifier == "" and None not in (owner, mine) and owner.lower() == mine.lower() else 0
        given, takes = -1 if c[4] is None else c[4], -1 if s[4] is None else s[4]
        fits = 0 if given < 0 or takes < 0 else 30 if given == takes else -10
        return 20 * (c[1] == s[2]) + 2 * (not s[5]) + named + fits

    want = {}
    for c in calls:
        best = min(((-score(c, s), s[0]) for s in symbols if s[1] == c[2]), default=None)
        if best and best[1] != c[6]:
            want[c[0]] = (best[1], -best[0])
    got, most = joined_rows(resolve.best_targets(spark.createDataFrame(calls, "id long, file_id long, callee string, qualifier string, argument_count int, caller_owner string, caller long"), spark.createDataFrame(symbols, "id long, name string, file_id long, owner string, arity int, test boolean")))
    assert {r.id: (r.target, r.score) for r in got} == want
    assert most <= len(calls)


def test_pairs_leave_no_block(spark):
    """Scores and ranks against a plain loop over several blocks, and pairs that are formed are never dealt out."""
    rng = random.Random(9)
    ids = {k * 3: k % 4 for k in range(60)}
    have = {(k, s): {rng.randrange(25) for _ in range(rng.randrange(7))} for k in ids for s in ("name", "events")}
    rows = [(k, ids[k], s, str(e)) for (k, s), found in have.items() for e in found]
    raws = {(a, b, s): len(have[a, s] & have[b, s]) / len(have[a, s] | have[b, s]) for a in ids for b in ids if a < b and ids[a] != ids[b] for s in ("name", "events") if have[a, s] & have[b, s]}
    rank = {}
    for k in ids:
        for s in ("name", "events"):
            for n, key in enumerate(sorted((x for x in raws if k in x[:2] and x[2] == s), key=lambda x: (-raws[x], x)), 1):
                if n <= 5:
                    rank[key] = min(n, rank.get(key, n))
    total = sum(w / 61 for w in capability.WEIGHTS.values())
    want = {}
    for (a, b, s), _ in raws.items():
        want[a, b] = want.get((a, b), 0) + (capability.WEIGHTS[s] / (60 + rank[a, b, s]) / total if (a, b, s) in rank else 0)
    was, capability.BLOCK = capability.BLOCK, 7
    try:
        elements = spark.createDataFrame(rows, "id long, repository long, signal string, element string")
        signatures = spark.createDataFrame([(k, r, "c") for k, r in ids.items()], "id long, repository long, context string")
        scores = capability.similarities(elements)
        plan = scores._jdf.queryExecution().executedPlan().toString()  # before it has run, so without stages
        assert plan.count("Exchange ") == 1 and "Join" not in plan, plan  # of members
        assert {(r.a, r.b, r.signal): r.raw for r in scores.collect()} == raws
        found = {(r.a, r.b): r.final_score for r in capability.candidates(elements, signatures, most=5).collect()}
        some = capability.candidates(elements, signatures, most=5, nodes=spark.createDataFrame([(k,) for k in (0, 9, 30, 63)], "id long")).collect()
    finally:
        capability.BLOCK = was
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-12 for p in want)
    assert {(r.a, r.b): r.final_score for r in some} == {p: found[p] for p in found if {*p} <= {0, 9, 30, 63}}


def test_declarations_of_a_common_name(spark):
    rng = random.Random(3)
    schema = "id string, name string, context string, contracts array<string>"
    side = lambda mark, n: [(f"{mark}{k}", rng.choice(["pay", "log", None, f"{k}"]), rng.choice([None, "", "x", "y"]), [rng.choice("cde")]) for k in range(n)]
    observed, declared = side("o", 120), side("d", 120)
    fits = lambda o, d: o[1] is not None and o[1] == d[1] and (not o[2] or not d[2] or o[2] == d[2])
    want = {}
    for o in observed:
        found = [d for d in declared if fits(o, d)]
        want[o[0]] = ("observed_without_declaration", None) if not found else ("ambiguous_match", None) if len(found) > 1 else ("matched", found[0][0])
    want |= {d[0]: ("declaration_without_observed", None) for d in declared if not any(fits(o, d) for o in observed)}
    got, most = joined_rows(capability.declaration_drift(spark.createDataFrame(observed, schema), spark.createDataFrame(declared, schema)))
    assert {r.id: (r.status, r.declaration) for r in got} == want
    assert most <= 2 * len(observed)


def dealt_over(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_blocks_grow_with_orders(spark, tmp_path):
    spark.range(250_000).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert sources.order_tasks(spark, str(tmp_path)) == 3
    assert ", 3)" in dealt_over(sources.test_output_blocks(spark, str(tmp_path)))


def test_tasks_of_capsules_grow_with_orders(spark, tmp_path):
    spark.range(250_000).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert ", 3)" in dealt_over(sources.symbol_capsule(spark, str(tmp_path)))
