"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import text_runs

UNKNOWN = "und"
#: Bytes of text that a worker judges at once.
RUN_BYTES = 4_000_000


def words_of(chunk: str) -> list[str]:
    """Runs of letters, lower-cased."""
    if chunk.isalpha():
        return [chunk.lower()]
    return "".join(c if c.isalpha() else " " for c in chunk).lower().split()


def grams_of(word: str, n: int) -> list[str]:
    """The word's n-grams, its edges marked; words shorter than n have none."""
    edged = f"<{word}>"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language of known words and n-grams."""

    languages: list[str]
    words: dict[str, list[float]]
    grams: dict[int, dict[str, list[float]]]

    def scores(self, word: str) -> list[float]:
        """Log frequencies of a known word; else the mean over its known n-grams of the longest n that has any."""
        found = self.words.get(word)
        if found is not None:
            return found
        for n in sorted(self.grams, reverse=True):
            known = [g for g in map(self.grams[n].get, grams_of(word, n)) if g is not None]
            if known:
                return [sum(column) / len(known) for column in zip(*known)]
        return [0.0] * len(self.languages)


def log_table(rows: list[tuple[str, str, int]], languages: list[str]) -> dict[str, list[float]]:
    """Smoothed log frequencies by language of (language, string, count)."""
    place = {x: k for k, x in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for language, string, n in rows:
        counts.setdefault(string, np.zeros(len(languages)))[place[language]] += n
    totals = sum(counts.values(), np.zeros(len(languages)))
    base = np.log(totals + 0.5 * (len(counts) + 1))
    return {s: (np.log(c + 0.5) - base).tolist() for s, c in counts.items()}


def fit(labelled: DataFrame, rows_per_language: int = 4000, words_per_language: int = 10_000, grams_per_language: int = 4000, longest: int = 5) -> LanguageModel:
    """The model of ``labelled`` (text, lang), null texts and labels aside.

    Fitted on about ``rows_per_language`` rows of each language, taken by a hash of their text: a documented bound
    on what training reads into counts. The model keeps the most frequent words and n-grams of each language,
    ties by string, so its size depends on the number of languages alone; that is what is collected.
    """
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {})
    share = F.lit(None)
    for language in languages:
        share = F.when(F.col("lang") == language, F.lit(min(1.0, rows_per_language / sizes[language]))).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, language in zip(batch.column(0), batch.column(1).to_pylist()):
                counts.update((language, w) for chunk in text.as_py().split() for w in words_of(chunk))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "s", "n"])

    words = chosen.mapInArrow(count, "lang string, s string, n long").groupBy("lang", "s").agg(F.sum("n").alias("n"))
    edged = F.concat(F.lit("<"), "s", F.lit(">"))
    grams = words.select("lang", "n", edged.alias("e"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size")).where(F.length("e") >= F.col("size"))
    grams = grams.select("lang", "n", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("e") - F.col("size") + 1), lambda i: F.substring("e", i, F.col("size")))).alias("s"))
    both = words.select("lang", F.lit(0).alias("size"), "s", "n").unionByName(grams.groupBy("lang", "size", "s").agg(F.sum("n").alias("n")))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "s")))
    kept = ranked.where(F.col("rank") <= F.when(F.col("size") == 0, words_per_language).otherwise(grams_per_language)).select("lang", "size", "s", "n").collect()
    tables: dict[int, list] = {}
    for r in kept:
        tables.setdefault(r["size"], []).append((r.lang, r.s, r.n))
    return LanguageModel(languages, log_table(tables.get(0, []), languages), {n: log_table(tables[n], languages) for n in tables if n})


def judged(model: LanguageModel, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and score of each text; a text's sums are those of its chunks, each different chunk scored once."""
    width = len(model.languages)
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    chunks = parts.values.dictionary_encode()
    rows = []  # log frequencies, and the number of words
    for chunk in chunks.dictionary.to_pylist():
        found = [model.scores(word) for word in words_of(chunk)]
        rows.append([*(found[0] if len(found) == 1 else map(sum, zip(*found)) if found else [0.0] * width), len(found)])
    table = np.array(rows, np.float64).reshape(-1, width + 1)
    codes, bounds = chunks.indices.to_numpy(), parts.offsets.to_numpy()
    names, scores = [], []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        total = table[codes[low:high]].sum(axis=0)
        if not width or not total[width]:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(total[:width].argmax())
        names.append(model.languages[best])
        scores.append(1 / float(np.exp((total[:width] - total[best]) / math.sqrt(total[width])).sum()))
    return names, scores


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): each row of ``docs`` as a struct beside the language of its whole text; one narrow pass.

    A null text, one without a letter, or a model without languages gives ``und`` and 0. Ties go to the first
    language by name. Repeated rows give repeated results, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            texts = pc.fill_null(whole.column(0).field(text_col), "")
            names, scores = [], []
            for part in text_runs(texts, RUN_BYTES):
                for out, found in zip((names, scores), judged(model, part)):
                    out.extend(found)
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for ``docs`` (doc_id, text, lang), learnt from rows that aren't held out."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))), **options)
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
