"""Toxicity categories by a classifier chain: linear models, each fed the probabilities of those before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_runs, written
from .language import words_of

#: Bytes of text that a worker judges at once.
RUN_BYTES = 6_000_000


@dataclass
class Rows:
    """Sparse binary rows: ``ids`` of row k lie from ``bounds[k]`` to ``bounds[k + 1]``; ``dense`` holds further features."""

    ids: np.ndarray
    bounds: np.ndarray
    dense: np.ndarray

    def dot(self, weights: np.ndarray, more: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.ids])])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.dense @ more

    def back(self, errors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.ids, np.repeat(errors, np.diff(self.bounds)), width), self.dense.T @ errors

    def some(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)
        return Rows(self.ids[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]), self.dense[keep])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    """An L2-regularised logistic model."""

    weights: np.ndarray
    more: np.ndarray
    bias: float

    @staticmethod
    def fit(rows: Rows, labels: np.ndarray, known: np.ndarray, l2: float = 1e-4, steps: int = 150) -> Linear:
        """Adam over all rows at once; deterministic. Words that aren't ``known`` to this model keep a weight of zero."""
        width = len(known)
        w = np.zeros(width + rows.dense.shape[1] + 1)
        m, v, n = np.zeros_like(w), np.zeros_like(w), max(1, len(labels))
        for step in range(1, steps + 1):
            error = (logistic(rows.dot(w[:width], w[width:-1]) + w[-1]) - labels) / n
            sparse, dense = rows.back(error, width)
            grad = np.concatenate([sparse * known, dense, [error.sum()]]) + l2 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return Linear(w[:width], w[width:-1], float(w[-1]))

    def probabilities(self, rows: Rows) -> np.ndarray:
        return logistic(rows.dot(self.weights, self.more) + self.bias)


@dataclass
class Chain:
    """``links[k]`` is the model of ``categories[k]``; it also reads the probabilities of the categories before."""

    categories: list[str]
    words: dict[str, int]
    links: list[Linear]

    def probabilities(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = Rows(ids, bounds, np.zeros((len(bounds) - 1, 0)))
        out = []
        for link in self.links:
            out.append(link.probabilities(rows))
            rows = Rows(ids, bounds, np.column_stack([rows.dense, logits(out[-1])]))
        return np.column_stack(out)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = 20_000, words_per_category: int = 2000, least_rows: int = 4, folds: int = 5) -> Chain:
    """The chain of ``docs`` (doc_id, text) with ``labels`` (doc_id and a 0/1 column for each category, in the chain's order).

    Fitted on about ``most_rows`` labelled rows, taken by a hash of doc_id: a documented bound, and the reason why
    the labels' side of the join may be broadcast. A model's features are the words with the largest standardised
    log-odds for each category among those in ``least_rows`` of its rows or more, ties by the word. The probabilities
    that a later model is trained on come from models that haven't seen the row, neither its label in their weights
    nor in their choice of words (``folds`` folds by a hash of the text, so copies are in one). Rows with a null text
    or label are left out, repeated rows count as often as they are there; with no rows left every probability is a
    half. A category named like doc_id or text isn't allowed.
    """
    if {"doc_id", "text"} & set(categories) or len(set(categories)) < len(categories):
        raise ValueError("categories need names of their own")
    labels = labels.select("doc_id", *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]).dropna()
    share = min(1.0, most_rows / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({w for chunk in text.as_py().split() for w in words_of(chunk)}) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(words, pa.list_(pa.string()))], ["fold", "labels", "words"])

    labels = F.array(*[f"y{k}" for k in range(len(categories))])
    sample = written(chosen.select("text", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(folds)).cast("int").alias("fold"), labels.alias("labels")).mapInArrow(distinct, "fold int, labels array<double>, words array<string>"), "sample")
    sums = [F.coalesce(F.sum(F.col("labels")[k]), F.lit(0.0)).alias(f"n{k}") for k in range(len(categories))]
    by_fold = {r.fold: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), *sums).collect()}  # a row for each fold
    # model -1 is of all rows, model f of those outside fold f
    models = [(m, *(float(sum(r[c] for f, r in by_fold.items() if f != m)) for c in ("n", *(f"n{k}" for k in range(len(categories)))))) for m in range(-1, folds)]
    sizes = sample.sparkSession.createDataFrame(models, ", ".join(["m int", "rows double", *(f"rows{k} double" for k in range(len(categories)))]))
    per_fold = sample.select("fold", "labels", F.explode("words").alias("word")).groupBy("word", "fold").agg(F.count("*").alias("n"), *sums)
    counts = per_fold.withColumn("m", F.explode(F.array(*[F.lit(m) for m in range(-1, folds)]))).where("m <> fold").groupBy("m", "word").agg(F.sum("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(categories))])
    counts = counts.where(F.col("n") >= least_rows).join(F.broadcast(sizes), "m")
    scored = None
    for k in range(len(categories)):
        with_it, without = F.col(f"rows{k}"), F.col("rows") - F.col(f"rows{k}")
        a, b = F.col(f"n{k}") + 0.5, F.col("n") - F.col(f"n{k}") + 0.5
        odds = F.log(a / (with_it - a + 1)) - F.log(b / (without - b + 1))
        one = counts.select("m", F.lit(k).alias("k"), "word", F.abs(odds / F.sqrt(1 / a + 1 / b)).alias("z"))
        scored = one if scored is None else scored.unionByName(one)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("m", "k").orderBy(F.desc("z"), "word"))).where(F.col("rank") <= words_per_category)
    chosen_words = [(r.m, r.word) for r in ranked.select("m", "word").distinct().collect()]  # bounded by the parameters
    words = {w: i for i, w in enumerate(sorted({w for _, w in chosen_words}))}
    known_to = np.zeros((folds + 1, len(words)))
    for m, w in chosen_words:
        known_to[m + 1, words[w]] = 1.0
    known = sample.sparkSession.sparkContext.broadcast(words)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            ids = [[i for i in map(get, ws) if i is not None] for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["fold", "labels", "ids"])

    local = sample.mapInArrow(numbered, "fold int, labels array<double>, ids array<int>").orderBy("fold", "ids", "labels").toPandas()  # most_rows rows
    sizes = np.array([len(x) for x in local.ids], np.int64)
    ids = np.concatenate([*local.ids, np.zeros(0, np.int32)]).astype(np.int64)
    rows, fold = Rows(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.zeros((len(local), 0))), local.fold.to_numpy()
    links = []
    for k in range(len(categories)):
        y = np.array([x[k] for x in local.labels])
        links.append(Linear.fit(rows, y, known_to[0]))
        unseen = np.full(len(y), y.mean() if len(y) else 0.5)
        for f in range(folds):
            inside = fold == f
            if inside.any() and not inside.all():
                unseen[inside] = Linear.fit(rows.some(~inside), y[~inside], known_to[f + 1]).probabilities(rows.some(inside))
        rows = Rows(rows.ids, rows.bounds, np.column_stack([rows.dense, logits(unseen)]))
    return Chain(list(categories), words, links)


def judged(chain: Chain, texts: pa.Array) -> np.ndarray:
    """The probabilities of each text (rows) and category; each different chunk is looked up once."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    chunks = parts.values.dictionary_encode()
    of_chunk = [[i for i in map(chain.words.get, words_of(c)) if i is not None] for c in chunks.dictionary.to_pylist()]
    hit = np.array([bool(x) for x in of_chunk], bool)
    codes, bounds = chunks.indices.to_numpy(), parts.offsets.to_numpy()
    ids = [sorted({i for c in own[hit[own]].tolist() for i in of_chunk[c]}) if len(own) else [] for own in (codes[a:b] for a, b in zip(bounds[:-1], bounds[1:]))]
    flat = np.array([i for x in ids for i in x], np.int64)
    return chain.probabilities(flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> ...): the chain's probabilities for every whole text; one narrow pass.

    A null or wordless text is judged by the models' biases alone. Repeated rows give repeated results, an empty
    table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            p = np.concatenate([judged(chain, part) for part in text_runs(batch.column(1), RUN_BYTES)] or [np.zeros((0, len(names)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *names])

    names = [f"p_{c}" for c in chain.categories]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"`{x}` double" for x in names)]))
