"""Token-budget packing and recoverable artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def capsule(rows: DataFrame, budget: int, k: int = 10) -> DataFrame:
    """B1: of (query, id, rank, body_tokens, signature_tokens), what a capsule of ``budget`` tokens holds.

    The first ``k`` are bodies, each cut to its share (120 to 350 tokens), while the sum stays within 90 % of the
    budget; the next ``k`` are signatures in what is left. The sums run inside each query's own few rows.
    """
    cap = min(350, max(120, budget // (k + 1)))
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    body = F.col("rank") <= k
    sized = rows.where(F.col("rank") <= 2 * k).withColumn("tokens", F.when(body, F.least("body_tokens", F.lit(cap))).otherwise(F.col("signature_tokens")))
    run = sized.withColumn("used", F.sum("tokens").over(order))
    limit = F.when(body, int(budget * 0.9)).otherwise(budget)
    return run.where(F.col("used") <= limit).select("query", "id", "rank", F.when(body, "body").otherwise("signature").alias("form"), "tokens", "used")


def symbol_capsule(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """B2: of (query, rank, role, budget, body_tokens, signature_tokens, skeleton_tokens), what a symbol capsule holds.

    Pivots are whole, their callers are signatures, support is skeletons, in that order and by rank within it. What
    comes before counts first: a row is in while the sum with it stays within the query's budget. A task sorts the rows of
    its queries; ``tasks`` says over how many they are dealt, else the session does.
    """
    turn = F.when(F.col("role") == "pivot", 0).when(F.col("role") == "caller", 1).otherwise(2)
    form = F.element_at(F.array(F.lit("body"), F.lit("caller"), F.lit("skeleton")), F.col("turn") + 1)
    tokens = F.when(F.col("turn") == 0, F.col("body_tokens")).when(F.col("turn") == 1, F.col("signature_tokens")).otherwise(F.col("skeleton_tokens"))
    order = Window.partitionBy("query").orderBy("turn", "rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.select("query", "rank", "budget", turn.alias("turn"), "body_tokens", "signature_tokens", "skeleton_tokens").select("query", "rank", "budget", "turn", tokens.cast("long").alias("tokens"))
    dealt = sized.repartition(tasks, "query") if tasks else sized
    run = dealt.withColumn("used", F.sum("tokens").over(order))
    return run.where(F.col("used") <= F.col("budget")).select("query", "rank", form.alias("form"), "tokens")


def skipping(rows: DataFrame, budget: int) -> DataFrame:
    """Rows in order of rank, each kept if it still fits what the kept ones leave; a fold over each query's rows."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    fits = lambda acc, r: acc["used"] + r["tokens"] <= budget
    step = lambda acc, r: F.struct((acc["used"] + F.when(fits(acc, r), r["tokens"]).otherwise(0)).alias("used"), F.when(fits(acc, r), F.array_append(acc["kept"], r["id"])).otherwise(acc["kept"]).alias("kept"))
    ordered = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens")))).alias("r"))
    return ordered.select("query", F.aggregate("r", start, step).alias("s")).select("query", "s.used", "s.kept")


def artifacts(texts: DataFrame, least: int, marker: int = 16) -> DataFrame:
    """(artifact_id, tokens, saved) of texts whose head and marker save tokens; equal texts are one artifact."""
    kept = F.least(T.estimate_tokens(F.col("text")), F.lit(least))
    sized = texts.select(F.sha2("text", 256).alias("artifact_id"), T.estimate_tokens(F.col("text")).alias("tokens"), (T.estimate_tokens(F.col("text")) - kept - marker).alias("saved"))
    return sized.where("saved > 0").dropDuplicates(["artifact_id"])


def elided(rows: DataFrame, lines: int) -> DataFrame:
    """Texts over ``lines`` lines keep 60 % of that from the head and 30 % from the tail, with a marker between."""
    all_lines = F.split("text", "\n")
    n, head, tail = F.size(all_lines), int(lines * 0.6), max(1, int(lines * 0.3))
    marker = F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines ..."))
    cut = F.concat(F.slice(all_lines, 1, head), F.array(marker), F.slice(all_lines, -tail, tail))
    return rows.withColumn("output", F.when(n > lines, F.array_join(cut, "\n")).otherwise(F.col("text")))
