"""Ranked retrieval: vector, BM25, rank fusion and memory search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

K1, B, RRF = 1.2, 0.75, 60


def knn(rows: DataFrame, vector: str, wanted: list[float], k: int, id_col: str = "id") -> DataFrame:
    """The k rows nearest to ``wanted`` by cosine, ties by id; each partition keeps k, so one task gets k a partition."""
    target = F.array(*[F.lit(float(x)) for x in wanted])
    return rows.withColumn("similarity", F.round(V.cosine(F.col(vector), target), 6)).orderBy(F.desc("similarity"), id_col).limit(k)


def ranked(rows: DataFrame, score: str, name: str, most: int, id_col: str = "id") -> DataFrame:
    """The best ``most`` rows with their rank; the limit comes first, so the window sees ``most`` rows and no more."""
    best = rows.orderBy(F.desc(score), id_col).limit(most)
    return best.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def postings(docs: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """A3: (id, term, tf), a document's terms counted."""
    return docs.select(F.col(id_col).alias("id"), F.explode(T.lexical_terms(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """A4: number of documents, and their average length in terms."""
    return docs.select(F.size(T.lexical_terms(F.col(text))).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def bm25(docs: DataFrame, terms: list[str], text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, score) of documents with any of ``terms``.

    One pass over the texts: the postings of the wanted terms alone are kept, beside each document's length.
    """
    each = docs.select(F.col(id_col).alias("id"), T.lexical_terms(F.col(text)).alias("t")).select("id", F.size("t").alias("length"), *[(F.size("t") - F.size(F.array_remove("t", term))).alias(f"tf{k}") for k, term in enumerate(terms)])
    stats = each.agg(F.count("*").alias("n"), F.avg("length").alias("average"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))])
    joined = each.where(" OR ".join(f"tf{k} > 0" for k in range(len(terms)))).join(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))).otherwise(0.0)
    return joined.select("id", F.round(score, 6).alias("score"))


def fused(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of (id, semantic_rank) and (id, lexical_rank)."""
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return first.select("id", "semantic_rank").join(second.select("id", "lexical_rank"), "id", "full").withColumn("rrf", part("semantic_rank") + part("lexical_rank"))


def lexical_hits(docs: DataFrame, terms: list[str], text: str = "content") -> DataFrame:
    """How many of the terms a text contains, those with none left out."""
    low = F.lower(F.col(text))
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return docs.select("id", hits.alias("hits")).where("hits > 0")


def memory_search(observations: DataFrame, vectors: DataFrame, wanted: list[float], terms: list[str], limit: int = 20) -> DataFrame:
    """Semantic and lexical ranks of observations, fused and weighted by authority within 0.5 and 2."""
    most = min(500, max(20, 4 * limit))
    semantic = ranked(knn(vectors, "embedding", wanted, most), "similarity", "semantic_rank", most)
    lexical = ranked(lexical_hits(observations, terms), "hits", "lexical_rank", most)
    weight = F.when(F.isnan("authority"), 1.0).otherwise(F.least(F.greatest(F.col("authority"), F.lit(0.5)), F.lit(2.0)))
    both = fused(semantic, lexical).join(observations.select("id", "authority"), "id").withColumn("score", F.round(F.col("rrf") * weight, 8))
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("semantic_rank", "lexical_rank")]  # 0: not in that list
    return both.select("id", *ranks, "score").orderBy(F.desc("score"), "id").limit(limit)


def best_by(rows: DataFrame, group: str, score: str, id_col: str = "id") -> DataFrame:
    """The best row of each group, ties by id; a struct maximum, so it combines before the shuffle."""
    return rows.groupBy(group).agg(F.max_by(F.struct(id_col, score), F.struct(F.col(score), -F.col(id_col))).alias("b")).select(group, f"b.{id_col}", f"b.{score}")


def with_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids that carry every tag."""
    return tags.where(F.col("tag").isin(wanted)).groupBy("id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(wanted)).select("id")
