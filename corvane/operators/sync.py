"""Snapshots, syncs and edits (S5-S7, T-11, C17, G13)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, status) of every row of either snapshot (id, hash)."""
    both = old.select("id", F.col("hash").alias("a")).join(new.select("id", F.col("hash").alias("b")), "id", "full")
    return both.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("status"))


def upserted(old: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``changed`` in place of those of the same key."""
    return old.join(changed.select(key), key, "left_anti").unionByName(changed)


def sync_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """C17: stale if it failed, synced if its epoch is new, recovered if it was stale, else unchanged."""
    both = new.join(old.select("id", F.col("epoch").alias("before"), F.col("stale")), "id", "left")
    status = F.when(F.col("failed"), "stale").when(F.col("before").isNull() | (F.col("before") != F.col("epoch")), "synced").when(F.col("stale"), "recovered").otherwise("unchanged")
    return both.select("id", status.alias("status"))


def renamed_lines(files: DataFrame, old: str, new: str) -> DataFrame:
    """(id, number, new_line) of lines that hold ``old`` as a whole word."""
    word = rf"\b{re.escape(old)}\b"
    lines = files.where(F.contains("content", F.lit(old))).select("id", F.posexplode(F.split("content", "\n")).alias("n", "line")).where(F.col("line").rlike(word))
    return lines.select("id", (F.col("n") + 1).alias("number"), F.regexp_replace("line", word, new).alias("new_line"))
