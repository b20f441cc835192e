"""Conversation memory (A20, R15, R16, T-16, D1-D5, J4, J5, P9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval

from ..functions import text as T


def thread_list(turns: DataFrame) -> DataFrame:
    """Sessions and turns of each thread."""
    return turns.groupBy("thread_id").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("turns"))


def session_turns(turns: DataFrame, session: int, limit: int = 500) -> DataFrame:
    """D1."""
    return turns.where(F.col("session_id") == session).orderBy("turn", "id").limit(limit)


def digests(turns: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, digest): the first turn, up to ``most`` anchored ones between, and the last, cut to 200 characters each."""
    by = Window.partitionBy("session_id")
    place = turns.withColumn("rn", F.row_number().over(by.orderBy("turn", "id"))).withColumn("n", F.count("*").over(by))
    marked = place.withColumn("middle", (F.col("rn") > 1) & (F.col("rn") < F.col("n")) & F.col("anchored"))
    ranked = marked.withColumn("k", F.sum(F.col("middle").cast("int")).over(by.orderBy("rn")))
    kept = ranked.where((F.col("rn") == 1) | (F.col("rn") == F.col("n")) | (F.col("middle") & (F.col("k") <= most)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", T.truncated(F.col("text")).alias("t")))), lambda x: x["t"])
    return kept.groupBy("session_id").agg(F.array_join(lines, "\n").alias("digest"))


def within_budget(turns: DataFrame, by: str, order: list, tokens: str, budget: int, most: int = 20) -> DataFrame:
    """Each group's first ``most`` turns in order, up to the first that doesn't fit the budget."""
    w = Window.partitionBy(by).orderBy(*order)
    return turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def auto_anchors(turns: DataFrame, names: DataFrame) -> DataFrame:
    """T-16: (id, name) where a turn's text holds a name as a whole word; words meet names in one equi-join."""
    words = turns.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+"))).alias("name"))
    return words.join(names.where(F.length("name") >= 3), "name", "left_semi").select("id", "name")


def listed_observations(rows: DataFrame, limit: int, vectors: DataFrame | None = None, wanted: list[float] | None = None) -> DataFrame:
    """Observations (id, source): the newest, or, with a query vector, those whose vectors are nearest, ties by id."""
    if wanted is None:
        return rows.orderBy(F.desc("id")).limit(limit).select("id", "source")
    near = retrieval.knn(vectors.join(rows.select("id"), "id", "left_semi"), "embedding", wanted, limit)
    return rows.join(near.select("id", "similarity"), "id").select("id", "source", "similarity")
