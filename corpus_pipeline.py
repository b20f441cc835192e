"""A corpus pipeline: language, near duplicates, benchmark passages, private data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, language, packing, pii, simhash
from corvane.llm.common import table, within, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labels teach; those without a letter, or too unsure, go. Null texts go,
    repeated rows stay or go together."""
    model = language.fit(docs)
    return language.with_language(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.3)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates: SimHash fingerprints over five-word shingles, then similarity 0.8.

    Null and blank texts are copies of one another. Rows that share a doc_id stay or go together."""
    found = simhash.similar_documents(docs, shingle=5, similarity=0.8)
    gone = written(found.where("doc_id <> component_id").select("doc_id"), "gone")
    return within(docs, gone, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold eight consecutive words of any benchmark item. Items of fewer words are no evidence and
    drop nothing; null texts stay, and rows that share a doc_id stay or go together."""
    found = decontamination.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=8, least_items=1, least_words=8)
    gone = written(found.where("contaminated").select("doc_id"), "gone")
    return within(docs, gone, "left_anti")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of private data; keeps every row, null texts and repeated rows too."""
    found = pii.pseudonymize(docs, pii.session_key(spark))
    return found.select(*[F.col("private.text").alias("text") if c == "text" else F.length("private.text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 4096 tokens, repeated rows once each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii_pseudonyms", private_data),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization, fingerprints and pseudonyms aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
