"""Boosts, re-ranking and companions of retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def boosted(scored: DataFrame, terms: list[str], idf: dict[str, float], query: str) -> DataFrame:
    """(id, name, path, score) with 4 idf for each term in the name, 1.5 idf for each in the path, 100 for the name itself."""
    name, path = T.lexical_terms(F.col("name")), T.lexical_terms(F.col("path"))
    extra: Column = F.when(T.normalized_name(F.col("name")) == query, 100.0).otherwise(0.0)
    for t in terms:
        extra = extra + F.when(F.array_contains(name, t), 4 * idf[t]).otherwise(0.0) + F.when(F.array_contains(path, t), 1.5 * idf[t]).otherwise(0.0)
    return scored.withColumn("score", F.col("score") + extra)


def bonus(similar: DataFrame, lexical: DataFrame, weight: float) -> DataFrame:
    """Similarity plus ``weight`` times the lexical score as a share of the best one."""
    best = lexical.agg(F.max("score").alias("best"))
    j = similar.join(lexical, "id", "left").join(F.broadcast(best))  # one row
    return j.select("id", (F.col("similarity") + weight * F.coalesce(F.try_divide("score", F.col("best")), F.lit(0.0))).alias("similarity"))


def identifiers_first(candidates: DataFrame, symbols: DataFrame, query: str, most: int = 8) -> DataFrame:
    """Definitions of identifiers that the query names come first, at similarity 1; then the others."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lit(query), F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), 0))).alias("name")
    named = symbols.sparkSession.range(1).select(token).where(F.col("name").rlike(".[A-Z0-9_]")).limit(most)
    exact = symbols.join(F.broadcast(named), "name", "left_semi").orderBy("id").limit(most).select("id", F.lit(1.0).alias("similarity"), F.lit(0).alias("priority"))
    rest = candidates.select("id", "similarity", F.lit(1).alias("priority"))
    return exact.unionByName(rest).groupBy("id").agg(F.min("priority").alias("priority"), F.max("similarity").alias("similarity"))


def name_coverage(scored: DataFrame, wanted: list[str], df: DataFrame, n: int) -> DataFrame:
    """Functions and methods gain 0.009 ln(1 + (n + 1) / (df + 1)) for each wanted term in their name.

    ``scored`` is (id, name, kind, score), ``df`` (term, df) the number of names with each term.
    """
    terms = scored.where(F.col("kind").isin("function", "method")).select("id", F.explode(F.array_distinct(T.lexical_terms(F.col("name")))).alias("term")).where(F.col("term").isin(*wanted))
    gain = terms.join(df, "term", "left").groupBy("id").agg(F.sum(0.009 * F.log(1 + (n + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("gain"))
    return scored.join(gain, "id", "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0))).drop("gain")


def files_by_best(scored: DataFrame, terms: DataFrame, n: int, operations: list[str] | None = None) -> DataFrame:
    """(file_id, score): the best symbol of a file, plus 0.008 ln(1 + (n + 1) / (df + 1)) for each query term its symbols cover.

    0.07 more if they cover two of the ``operations`` that the query names.
    """
    best = scored.groupBy("file_id").agg(F.max("score").alias("best"))
    covered = terms.select("file_id", "term", "df").distinct().groupBy("file_id").agg((F.sum(0.008 * F.log(1 + (n + 1) / (F.col("df") + 1))) + F.when(F.count_if(F.col("term").isin(operations or [""])) >= 2, 0.07).otherwise(0.0)).alias("extra"))
    return best.join(covered, "file_id", "left").select("file_id", (F.col("best") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def companions(symbols: DataFrame, most: int = 2) -> DataFrame:
    """For each file up to ``most`` symbols that cover the most query terms not covered yet; ties by id.

    ``symbols`` is (file_id, id, terms). Greedy cover of a file's few candidates, as a fold that the engine runs.
    """
    rows = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "terms"))).alias("s"))
    state = F.struct(F.array().cast("array<string>").alias("covered"), F.array().cast("array<bigint>").alias("chosen"))

    def pick(acc: Column, _: Column) -> Column:
        gain = lambda s: F.size(F.array_except(s["terms"], acc["covered"]))
        best = F.array_max(F.transform(F.col("s"), lambda s: F.struct(gain(s).alias("gain"), (-s["id"]).alias("low"), s["terms"].alias("terms"))))
        more = best["gain"] > 0
        return F.struct(F.when(more, F.array_union(acc["covered"], best["terms"])).otherwise(acc["covered"]).alias("covered"), F.when(more, F.array_append(acc["chosen"], (-best["low"]).cast("bigint"))).otherwise(acc["chosen"]).alias("chosen"))

    return rows.select("file_id", F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, pick).alias("a")).select("file_id", F.col("a.chosen").alias("chosen"))


def valid_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """Rows whose vector has the dimension and is finite."""
    if not 1 <= dimension <= 65_536:
        raise ValueError("dimension must be from 1 to 65536")
    return rows.where((F.size("embedding") == dimension) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def stale_vectors(rows: DataFrame, model: str) -> DataFrame:
    """Rows whose vector is missing or another model's."""
    return rows.where(F.col("embedding").isNull() | ~F.col("model_id").eqNullSafe(F.lit(model)))


def symbol_document(rows: DataFrame, most: int = 700) -> DataFrame:
    """Path, words of the name, signature and the first 200 characters of the docstring, cut to ``most`` characters."""
    parts = F.concat_ws(" | ", "path", T.normalized_name(F.col("name")), "signature", F.substring("docstring", 1, 200))
    return rows.withColumn("document", F.substring(parts, 1, most))


def fail_soft(first: Callable[[], DataFrame], second: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The first search, or the second if it fails; True says that it did."""
    try:
        found = first()
        found.schema  # noqa: B018  analysis errors show here
        return found, False
    except Exception:  # noqa: BLE001  whatever a store raises
        return second(), True


def window_rank(rows: DataFrame, by: str, score: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id")))
