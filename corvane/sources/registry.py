"""Several repositories as one table (S9, S10, S13, D8, T-6, T-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def federated(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The Parquet tables of all repositories with their name beside each row, and (name, error) of those that can't be read."""
    out, failed = None, []
    for name, path in sorted(paths.items()):
        try:
            part = spark.read.parquet(path).withColumn("repository_id", F.lit(name))
        except Exception as error:  # noqa: BLE001  a repository that fails is reported, not raised
            failed.append((name, str(error).split("\n")[0]))
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, failed


def selected(registry: DataFrame, group: str | None = None) -> DataFrame:
    """Rows of the group (or all), one for each stream, the smallest repository first."""
    rows = registry if group is None else registry.where(F.array_contains("groups", group))
    return rows.groupBy("stream").agg(F.min_by(F.struct(*registry.columns), "repository").alias("r")).select("r.*")


def issues(registry: DataFrame) -> DataFrame:
    """(repository, issue) of entries that are incomplete or share a stream."""
    shared = registry.groupBy("stream").agg(F.count("*").alias("n")).where("n > 1").select("stream", F.lit(True).alias("twice"))
    j = registry.join(shared, "stream", "left")
    found = F.array_compact(F.array(F.when(F.col("twice"), "duplicate_stream"), F.when(F.col("root") == "", "missing_root"), F.when(F.size("groups") == 0, "no_group")))
    return j.select("repository", F.explode(found).alias("issue"))


def pruned(registry: DataFrame, live: DataFrame) -> DataFrame:
    """The registry without entries whose root isn't among the live ones."""
    return registry.join(live, "root", "left_semi")


def as_json(record: Column) -> Column:
    """A nested signature as text; ``from_json`` with its schema reads it back."""
    return F.to_json(record)


def replaced(snapshot: DataFrame, stream: DataFrame, key: str = "stream") -> DataFrame:
    """T-6: ``snapshot`` with all rows of the streams in ``stream`` replaced."""
    return snapshot.join(stream.select(key).distinct(), key, "left_anti").unionByName(stream)


def reidentified(rows: DataFrame, old: int, new: int) -> DataFrame:
    """T-7: a stream under its new name."""
    return rows.withColumn("stream", F.when(F.col("stream") == old, new).otherwise(F.col("stream")))
