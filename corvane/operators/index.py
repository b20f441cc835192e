"""A stored inverted index (A3-A5, J3): postings by term, written once, of which a query reads its terms alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import new_path
from .retrieval import K1, B

BUCKETS = 32


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """Where the postings (bucket, term, id, tf, length) and the corpus statistics (n, average) are."""

    spark: SparkSession
    path: str

    def postings(self, terms: list[str]) -> DataFrame:
        """Those of ``terms``: whole buckets are pruned as folders, other terms by the statistics of sorted files."""
        rows = self.spark.read.schema("term string, id long, tf long, length int, bucket int").parquet(f"{self.path}/postings")
        wanted = [F.lit(t) for t in terms]
        return rows.where(F.col("bucket").isin(*map(bucket_of, wanted)) & F.col("term").isin(*wanted)) if terms else rows.limit(0)

    def stats(self) -> DataFrame:
        return self.spark.read.schema("n long, average double").parquet(f"{self.path}/stats")


def build(docs: DataFrame, text: str = "text", id_col: str = "id") -> Index:
    """Writes the index of ``docs`` in the shared folder.

    Files are ranges of (bucket, term, id), so a frequent term is spread over several tasks and a rare one is a few
    rows of one file.
    """
    spark = docs.sparkSession
    index = Index(spark, new_path(spark, "index"))
    terms = docs.select(F.col(id_col).cast("long").alias("id"), T.lexical_terms(F.col(text)).alias("t")).select("id", F.coalesce(F.size("t"), F.lit(0)).alias("length"), "t")
    counted = terms.select("id", "length", F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    dealt = counted.withColumn("bucket", bucket_of(F.col("term"))).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    dealt.select("term", "id", "tf", "length", "bucket").write.partitionBy("bucket").parquet(f"{index.path}/postings")
    terms.agg(F.count("*").alias("n"), F.avg("length").alias("average")).write.parquet(f"{index.path}/stats")
    return index


def stored(spark: SparkSession, key: str, docs: DataFrame) -> Index:
    """The index of ``docs``, built at the first call for ``key`` in this application."""
    known = stored.__dict__.setdefault("known", {})
    place = (spark.sparkContext.applicationId, key)
    if place not in known:
        known[place] = build(docs)
    return known[place]


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """(id, score) of documents with any of ``terms``, from the postings of these terms and two small aggregates."""
    rows = index.postings(terms)
    frequency = F.broadcast(rows.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term
    joined = rows.join(frequency, "term").join(F.broadcast(index.stats()))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return joined.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
