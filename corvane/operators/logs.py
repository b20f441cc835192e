"""Summaries of command output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def level_histogram(lines: DataFrame) -> DataFrame:
    """Lines of each level."""
    return lines.groupBy(T.log_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"))


def repeats(lines: DataFrame, least: int = 2) -> DataFrame:
    """Messages that repeat once numbers are #, with their level."""
    return lines.groupBy(T.log_level(F.col("line")).alias("level"), T.normalized_message(F.col("line")).alias("message")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def diagnostics(lines: DataFrame) -> DataFrame:
    """(file, code, severity, n) of compiler and lint lines like ``path(1,2): error TS1: text`` and ``path:1:2: warning: text [code]``."""
    tsc, lint = r"^([^\s(:]+)\((\d+),(\d+)\): (error|warning) (\w+):", r"^([^\s:]+):(\d+):(\d+): (error|warning): .*\[([\w./-]+)\]\s*$"
    of = lambda k: F.when(F.col("line").rlike(tsc), F.regexp_extract("line", tsc, k)).otherwise(F.regexp_extract("line", lint, k))
    return lines.where(F.col("line").rlike(tsc) | F.col("line").rlike(lint)).groupBy(of(1).alias("file"), of(5).alias("code"), of(4).alias("severity")).agg(F.count("*").alias("n"))


def matches_by_file(matches: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` matches of each file, with how many it has."""
    w = Window.partitionBy("file")
    return matches.withColumn("rn", F.row_number().over(w.orderBy("number"))).withColumn("total", F.count("*").over(w)).where(F.col("rn") <= cap)


def package_counts(lines: DataFrame) -> DataFrame:
    """Packages added, removed and changed; an update is a change."""
    low = F.lower("line")
    return lines.agg(F.count_if(low.rlike(r"^(\+|add(ed)?|install(ed|ing)?)\b?")).alias("added"), F.count_if(low.rlike(r"^(-|remov(ed|ing)|uninstall)")).alias("removed"), F.count_if(low.rlike(r"^(~|chang(ed|ing)|updat(ed|ing)|upgrad)")).alias("changed"))


def test_blocks(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """(source, block, name, status, n_lines): a line that starts a test opens a block, and its worst mark is its status.

    A task sorts the lines of its sources; ``tasks`` says over how many they are dealt, else the session does.
    """
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.regexp_extract("line", r"^(?:\[ RUN      \]|=== RUN|test) +(\S+)", 1)
    # what a line says is read before lines are dealt out, so the texts stay where they are
    said = lines.select("source", "n", start.alias("name"), F.col("line").rlike(r"(?i)\bFAIL(ED)?\b").cast("int").alias("bad"))
    dealt = said.repartition(tasks, "source") if tasks else said
    marked = dealt.withColumn("block", F.sum((F.col("name") != "").cast("int")).over(w)).where("block > 0")
    bad = F.max("bad")
    return marked.groupBy("source", "block").agg(F.max("name").alias("name"), F.when(bad == 1, "failed").otherwise("passed").alias("status"), F.count("*").alias("n_lines"))


def tightened(rows: DataFrame, caps: list[int], budget: int) -> DataFrame:
    """Each text cut to the largest of ``caps`` lines that fits the token budget; none fits: cut by bytes. Shorter texts stay as they are."""
    lines = F.split("text", "\n")
    out = F.substring("text", 1, budget * 4)
    for cap in sorted(caps):
        cut = F.array_join(F.slice(lines, 1, cap), "\n")
        out = F.when(T.estimate_tokens(cut) <= budget, cut).otherwise(out)
    whole = T.estimate_tokens(F.col("text")) <= budget
    return rows.withColumn("output", F.when(whole, F.col("text")).otherwise(out)).withColumn("changed", ~whole)
