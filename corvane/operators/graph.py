"""Graph operators over (src, dst) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed as cut


def degrees(edges: DataFrame) -> DataFrame:
    """A1, A2: (id, n_out, n_in, degree); both endpoints in one shuffle, counted before it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"), F.count("*").alias("degree"))


def direct_dependents(edges: DataFrame, targets: list[int]) -> DataFrame:
    """G1: (target, dependents), the sources of edges into each target, sorted."""
    return edges.where(F.col("dst").isin(targets)).groupBy(F.col("dst").alias("target")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def reached(edges: DataFrame, start: DataFrame, most: int | None = None, both: bool = False) -> DataFrame:
    """(id, depth) of nodes reachable from ``start`` (id), by the least number of steps.

    One join a step, from the new frontier alone; visited nodes are taken out by an anti-join, and each step is
    checkpointed, so neither plan nor frontier grows with the depth. ``both`` follows edges either way.
    """
    way = edges.select("src", "dst")
    if both:
        way = way.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    way = way.distinct()
    seen = frontier = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = frontier.join(way, frontier["id"] == way["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def numbered(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``rows`` with ``place`` (from 1) and ``run``, the running sum of ``value``, in ``order``.

    Rows are sorted by range and summed within each partition; one row a partition tells what lies before it, so no
    task sees them all.
    """
    dealt = cut(rows.orderBy(order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("total"))
    own = Window.partitionBy("part").orderBy(order)
    return dealt.join(F.broadcast(base), "part").withColumn("place", F.col("n") + F.row_number().over(own)).withColumn("run", F.col("total") + F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("part", "n", "total")


def budgeted(edges: DataFrame, start: DataFrame, sizes: DataFrame, most: int, budget_tokens: int) -> DataFrame:
    """(id, depth, size, bytes, expands) of nodes reached from ``start`` (id) along edges either way, within a budget.

    Nodes are visited by depth, and within one in the order of the node that reached them, outgoing edges first, then
    by id. ``bytes`` counts the sizes up to and with the node, those of ``start`` aside. Once 40 % of the budget (four
    bytes a token) is reached nodes are still visited but don't expand, so what only they lead to isn't reached.
    """
    limit = budget_tokens * 4 * 40 // 100
    way = edges.select("src", "dst", F.lit(0).alias("direction")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("direction"))).distinct()
    known = sizes.groupBy("id").agg(F.max("size").cast("long").alias("size"))
    first = numbered(start.select("id").distinct().withColumn("none", F.lit(0).cast("long")), "id", "none")
    level = cut(first.join(known, "id", "left").select("id", F.lit(0).alias("depth"), F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("expands"), "place"))
    seen, total = level, 0
    for depth in range(1, most + 1):
        step = level.where("expands").join(way, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.struct("place", "direction", F.col("dst").alias("own"))).alias("at"))
        fresh = step.select(F.col("dst").alias("id"), "at").join(seen, "id", "left_anti").join(known, "id", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
        bytes_ = (F.lit(total) + F.col("run")).cast("long")
        level = cut(numbered(fresh, "at", "size").select("id", F.lit(depth).alias("depth"), "size", bytes_.alias("bytes"), (bytes_ < limit).alias("expands"), "place"))
        total = level.agg(F.max("bytes")).first()[0]
        if total is None:
            break
        seen = seen.unionByName(level)
    return seen.select("id", "depth", "size", "bytes", "expands")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being its smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): rows never outgrow the edges, each
    step is an aggregate and an equi-join, and the rounds grow with the logarithm of a component's size.
    Empty edges give an empty table; self-loops and repeated edges are harmless.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: larger neighbours go to the smallest of a node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(large.join(low, "a").select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return now.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.min("e.component").alias("component"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the smallest id connected by edges (src, dst); isolated nodes are their own."""
    roots = connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def simple_paths(edges: DataFrame, entries: DataFrame, stops: DataFrame, depth: int = 8, branching: int = 8, most: int = 50) -> DataFrame:
    """(path, kinds, evidence, uncertain, truncated): paths without repeats from entries to the first stop node.

    ``edges`` are (src, dst, kind, evidence). A node follows its first ``branching`` different edges by target, kind
    and evidence; a path has ``depth`` edges at most, and the first ``most`` in that order are given. ``uncertain``
    says for each edge whether it isn't observed, ``truncated`` whether any of the three limits left something out.
    """
    each = edges.select("src", "dst", "kind", "evidence").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("dst", "kind", "evidence")))
    narrow = each.where(F.col("rn") <= branching).select("src", F.struct("dst", "kind", "evidence").alias("edge"))
    wide = each.where(F.col("rn") == branching + 1).select(F.col("src").alias("at"), F.lit(True).alias("wide"))
    leads = each.where("rn = 1").select(F.col("src").alias("at"), F.lit(True).alias("leads"))
    stop = stops.select(F.col("id").alias("at"), F.lit(True).alias("stop")).distinct()
    live = entries.select(F.col("id").alias("at"), F.col("id").alias("entry"), F.array("id").alias("path"), F.array().cast(f"array<{narrow.schema['edge'].dataType.simpleString()}>").alias("edges"))
    done, clipped = None, False
    for length in range(depth + 1):
        marked = cut(live.join(stop, "at", "left").join(wide, "at", "left").join(leads, "at", "left"))
        ended = marked.where("stop").select("entry", "path", "edges")
        done = ended if done is None else done.unionByName(ended)
        going = marked.where("stop IS NULL AND leads")
        clipped = clipped or not going.where(F.lit(length == depth) | F.col("wide")).isEmpty()
        if length < depth:
            step = going.select("at", "entry", "path", "edges").join(narrow, going["at"] == narrow["src"]).where(~F.array_contains("path", F.col("edge.dst")))
            live = step.select(F.col("edge.dst").alias("at"), "entry", F.concat("path", F.array("edge.dst")).alias("path"), F.concat("edges", F.array("edge")).alias("edges"))
    first = cut(done.orderBy("entry", "edges").limit(most + 1))
    clipped = clipped or first.count() > most
    return first.orderBy("entry", "edges").limit(most).select("path", F.col("edges.kind").alias("kinds"), F.col("edges.evidence").alias("evidence"), F.transform("edges.evidence", lambda e: e != "observed").alias("uncertain"), F.lit(clipped).alias("truncated"))


def reference_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n) of edges that touch each node, a self-loop once; two equi-joins in place of a join on OR."""
    touch = edges.select(F.col("src").alias("id")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id")))
    return nodes.select("id").join(touch.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
