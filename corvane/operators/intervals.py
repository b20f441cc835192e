"""Line-interval joins: always an equi-join on the file, with the range as its condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, hunk) of spans that share a line with a hunk of the same file."""
    h = hunks.select(F.col("id").alias("hunk"), F.col("file_id").alias("f"), F.col("start_line").alias("h_start"), F.col("end_line").alias("h_end"))
    return spans.join(h, (spans["file_id"] == h["f"]) & (spans["start_line"] <= h["h_end"]) & (spans["end_line"] >= h["h_start"])).select(spans["id"], "hunk")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, owner), the smallest span around each (id, file_id, line); ties by span id; none: left out."""
    s = spans.select(F.col("id").alias("owner"), F.col("file_id").alias("f"), "start_line", "end_line")
    inside = (points["file_id"] == s["f"]) & points["line"].between(s["start_line"], s["end_line"])
    size = F.col("end_line") - F.col("start_line")
    return points.join(s, inside).groupBy(points["id"]).agg(F.min_by("owner", F.struct(size, "owner")).alias("owner"))


def owners(spans: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, owner), the smallest other span of the file that contains a span, of one of ``kinds`` if these are given."""
    o = (spans.where(F.col("kind").isin(kinds)) if kinds else spans).select(F.col("id").alias("owner"), F.col("file_id").alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    around = (spans["file_id"] == o["f"]) & (o["a"] <= spans["start_line"]) & (o["b"] >= spans["end_line"]) & (o["owner"] != spans["id"])
    return spans.join(o, around).groupBy("id").agg(F.min_by("owner", F.struct(F.col("b") - F.col("a"), "owner")).alias("owner"))
