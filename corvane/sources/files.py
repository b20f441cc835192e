"""File trees and diffs as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, hash, byte_size) of all files below ``root``, listed and read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("byte_size"))


def glob_pattern(glob: str) -> str:
    """A rule as a regular expression over a whole path. ``*`` and ``?`` stay within a folder, ``**`` doesn't."""
    anchored, folder = glob.startswith("/"), glob.endswith("/")
    body = glob.strip("/")
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return ("^" if anchored else "^(?:.*/)?") + out + ("(?:/.*)?$" if folder else "$")


def kept_paths(paths: DataFrame, rules: list[str]) -> DataFrame:
    """The rows whose ``path`` the rules leave; ``!`` negates, and the last rule that matches decides."""
    ignored = F.lit(False)
    for rule in rules:
        negated = rule.startswith("!")
        ignored = F.when(F.col("path").rlike(glob_pattern(rule.removeprefix("!"))), F.lit(not negated)).otherwise(ignored)
    return paths.where(~ignored)


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(source, path, start_line, end_line) of a unified diff's new side, from (source, n, line); pure deletions are left out."""
    order = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("path", F.last(F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 4096)), ignorenulls=True).over(order))
    hunk = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1)
    count = F.regexp_extract("line", r"^@@ -\S+ \+\d+,(\d+)", 1)
    found = named.where(F.col("line").rlike(r"^@@ -\S+ \+\d+")).select("source", "path", hunk.cast("int").alias("start_line"), F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -\\\\S+ \\\\+\\\\d+,(\\\\d+)', 1) AS INT)")).alias("n"))
    return found.where("n > 0").select("source", "path", "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))
