"""Text quality as perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, text_runs, written

#: Stand before the first symbol of a text, at its start, and at its end; in texts they count as ``OTHER``.
PAD, START, END, OTHER = "\x00", "\x02", "\x03", "\x1a"
RESERVED = re.compile(f"[{PAD}{START}{END}]")
#: Bytes of text that a worker takes apart at once, and of a block whose n-grams are looked up together.
RUN_BYTES, BLOCK_BYTES = 4_000_000, 96_000_000
#: Texts dealt out are most of the disk in use; up to this level zstd costs a worker few seconds a GB.
ZSTD_LEVEL = 6
#: Texts on their way to a block: runs of rows (doc_id, lang, text) in compressed Arrow streams.
PACKED = pa.schema([pa.field("m", pa.int32(), False), pa.field("block", pa.int32(), False), pa.field("packed", pa.binary(), False)])
#: A block's windows as they leave it.
WINDOWS = pa.schema([pa.field("m", pa.int32(), False), pa.field("block", pa.int32(), False), pa.field("g", pa.string(), False)])


class Symbols:
    """The symbols of some texts end to end, and for each symbol to be predicted its window: it and what comes before.

    White space counts as one space, so windows reach across words. A window is a number: its symbols' places in
    this run's alphabet are its digits.
    """

    def __init__(self, texts: list[str], order: int):
        self.order, head = order, PAD * (order - 2) + START
        parts = [RESERVED.sub(OTHER, " ".join(t.split())) for t in texts]
        points = np.frombuffer("".join(f"{head}{p}{END}" for p in parts).encode("utf-32-le"), np.uint32)
        # an alphabet of up to 2 ** 21 symbols is numbered anew, so that windows of a usual one fit in 64 bits
        present = np.bincount(points, minlength=1)
        self.alphabet = np.nonzero(present)[0].astype(np.uint32)
        number = np.zeros(len(present), np.uint64)
        number[self.alphabet] = np.arange(len(self.alphabet))
        digits, base = number[points], max(2, len(self.alphabet))
        if base**order >= 1 << 64:
            raise OverflowError
        codes = np.zeros(max(0, len(digits) - order + 1), np.uint64)
        for k in range(order):
            codes = codes * np.uint64(base) + digits[k : k + len(codes)]
        sizes = np.array([len(p) + 1 for p in parts], np.int64)  # symbols to predict
        starts = np.concatenate([[0], np.cumsum(sizes + order - 1)])[:-1]
        keep = np.ones(len(codes), bool)
        for k in range(1, order):  # windows that begin in the text before
            at = starts[1:] - k
            keep[at[at < len(codes)]] = False
        self.codes, self.sizes, self.base = codes[keep], sizes, base

    def strings(self, codes: np.ndarray, padding: str = "") -> pa.Array:
        """The windows as strings, without ``padding`` at their start."""
        points, rest = np.empty((len(codes), self.order), np.uint32), codes.copy()
        for k in range(self.order - 1, -1, -1):
            rest, digit = np.divmod(rest, np.uint64(self.base))
            points[:, k] = self.alphabet[digit]
        flat = points.tobytes().decode("utf-32-le")
        n = self.order
        return pa.array([flat[i : i + n].lstrip(padding) if padding else flat[i : i + n] for i in range(0, len(flat), n)], pa.string())


def symbol_runs(texts: pa.Array, order: int) -> Iterator[Symbols]:
    """The texts in runs; one whose alphabet is too large for 64 bits is halved, a single text cut where it has to be."""
    for run in text_runs(texts, RUN_BYTES):
        waiting = [run.to_pylist()]
        while waiting:
            part = waiting.pop()
            try:
                yield Symbols(part, order)
            except OverflowError:
                if len(part) == 1:
                    raise ValueError(f"a text has too many different symbols for windows of {order}") from None
                waiting += [part[len(part) // 2 :], part[: len(part) // 2]]


def fold_of(text: Column, folds: int) -> Column:
    """Copies of a text are in one fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(folds)).cast("int")


def gram_counts(texts: DataFrame, order: int, folds: int) -> DataFrame:
    """(m, g, n): windows of the full order, and shorter ones at the start of texts, over all ``texts`` of folds other than m."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(0).to_numpy()
            for f in range(folds):
                for run in symbol_runs(batch.column(1).filter(pa.array(fold == f)), order):
                    codes, counts = np.unique(run.codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), f, np.int32)), run.strings(codes, PAD), pa.array(counts.astype(np.int64))], ["fold", "g", "n"])

    counted = texts.select(fold_of(F.col("text"), folds).alias("fold"), "text").mapInArrow(count, "fold int, g string, n long")
    others = F.array(*[F.lit(m) for m in range(folds)])
    each = counted.groupBy("fold", "g").agg(F.sum("n").alias("n")).withColumn("m", F.explode(others)).where("m <> fold" if folds > 1 else "true")
    return each.groupBy("m", "g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """(m, d1, d2, d3): Chen and Goodman's discounts from the counts of counts; plain values where those are too few."""
    n = counts.groupBy("m").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return n.select("m", *[F.when(enough, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(float(k)))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)])


def train(raw: DataFrame, order: int) -> DataFrame:
    """(m, g, delta, bow): each model m as weights that add up; g = '' has the log probability of an unseen symbol.

    A symbol's log probability is that of its unigram, plus, for each longer n-gram that ends there, ``bow`` of its
    context and ``delta`` of the n-gram, each where the table has it. Counts (``raw``: m, g, n) are of all trusted
    text; lower orders count different left neighbours. All steps are aggregates and equi-joins on n-grams.
    """
    raw = written(raw, "grams")
    counts = {order: raw.where(F.length("g") == order)}
    for k in range(order - 1, 0, -1):
        continued = counts[k + 1].groupBy("m", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"))
        counts[k] = written(continued.unionByName(raw.where(F.length("g") == k)).groupBy("m", "g").agg(F.sum("n").alias("n")), f"order{k}")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    with_cut = lambda k: counts[k].join(F.broadcast(discounts(counts[k])), "m").select("m", "g", "n", cut.alias("cut"))  # noqa: E731  a row for each model
    one = with_cut(1)
    base = one.groupBy("m").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n") / (F.count("*") + 1)).alias("unseen"))
    p = one.join(F.broadcast(base), "m").select("m", "g", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("unseen")).alias("p"))
    weights = p.select("m", "g", F.log("p").alias("delta"), F.lit(0.0).alias("bow")).unionByName(base.select("m", F.lit("").alias("g"), F.log("unseen").alias("delta"), F.lit(0.0).alias("bow")))
    for k in range(2, order + 1):
        split = with_cut(k).select("m", "g", "n", "cut", F.substring("g", 1, k - 1).alias("h"), F.substring("g", 2, k - 1).alias("s"))
        context = split.groupBy("m", "h").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        joined = split.join(context, ["m", "h"]).join(p.select("m", F.col("g").alias("s"), F.col("p").alias("lower")), ["m", "s"])
        p = written(joined.select("m", "g", "gamma", "lower", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")), f"p{k}")
        weights = weights.unionByName(p.select("m", "g", (F.log("p") - F.log("gamma") - F.log("lower")).alias("delta"), F.lit(0.0).alias("bow")))
        weights = weights.unionByName(context.select("m", F.col("h").alias("g"), F.lit(0.0).alias("delta"), F.log("gamma").alias("bow")))
    return written(weights.groupBy("m", "g").agg(F.sum("delta").alias("delta"), F.sum("bow").alias("bow")), "weights")


def window_scores(windows: DataFrame, weights: DataFrame, order: int) -> DataFrame:
    """(m, g, score): the log probability of the last symbol of each different window (of ``order`` symbols, padding at the start of texts) after those before it.

    The sharded count join, from short to long: a window's score is that of its suffix, which is shared by many,
    plus the weights of the window and of its context where the table has them. No step has more rows than there are
    different windows, and no key more than there are symbols.
    """
    wanted = {order: windows.select("m", "g")}
    for n in range(order - 1, 0, -1):
        wanted[n] = wanted[n + 1].select("m", F.expr("substring(g, 2)").alias("g")).distinct()
    unseen = F.broadcast(weights.where("g = ''").select("m", F.col("delta").alias("unseen")))  # a row for each model
    of_size = lambda n: weights.where(F.length("g") == n)
    score = wanted[1].join(of_size(1).select("m", "g", "delta"), ["m", "g"], "left").join(unseen, "m", "left").select("m", "g", F.coalesce("delta", "unseen", F.lit(0.0)).alias("score"))
    for n in range(2, order + 1):
        each = wanted[n].join(of_size(n).select("m", "g", "delta"), ["m", "g"], "left").select("m", "g", "delta", F.expr("substring(g, 2)").alias("suffix"), F.expr("substring(g, 1, length(g) - 1)").alias("context"))
        each = each.join(of_size(n - 1).select("m", F.col("g").alias("context"), "bow"), ["m", "context"], "left").join(score.select("m", F.col("g").alias("suffix"), F.col("score").alias("lower")), ["m", "suffix"])
        score = each.select("m", "g", (F.col("lower") + F.coalesce("delta", F.lit(0.0)) + F.coalesce("bow", F.lit(0.0))).alias("score"))
    return score.select("m", "g", F.col("score").cast("float").alias("score"))


def looked_up(codes: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each code; all are known, and ``known`` is sorted. Most are found at once in a table of slots."""
    bits = max(8, int(len(known) * 4).bit_length())
    slot = lambda c: ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot(known)] = np.arange(len(known))
    at = table[slot(codes)]
    missed = np.nonzero(known[at] != codes)[0]
    at[missed] = np.searchsorted(known, codes[missed])
    return values[at]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, block, packed) of rows (doc_id, lang, text, m, block): each batch's rows of a block in runs, whole and in order."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))
    for batch in batches:
        places = np.stack([batch.column(k).to_numpy() for k in (3, 4)], axis=1)
        for m, block in np.unique(places, axis=0).tolist():
            rows, low = batch.select([0, 1, 2]).filter(pa.array((places == (m, block)).all(axis=1))), 0
            for run in text_runs(rows.column(2), RUN_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows.slice(low, len(run)))
                low += len(run)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=PACKED)


def unpacked(streams: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The runs of rows that ``packed`` made, one at a time."""
    for stream in streams:
        with pa.ipc.open_stream(stream.as_buffer()) as reader:
            yield from reader


def perplexities(docs: DataFrame, weights: DataFrame, order: int, folds: int) -> DataFrame:
    """(doc_id, lang, symbols, perplexity) of every whole text of ``docs`` (doc_id, text, lang), under the model of its fold.

    Texts are dealt out in blocks once, compressed. Each block's different windows meet their scores in a join and come back to
    the block, so a task holds one block's texts and windows, and the model is nowhere whole.
    """
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_BYTES * folds)))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("*", fold_of(F.col("text"), folds).alias("m"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    dealt = placed.mapInArrow(packed, "m int NOT NULL, block int NOT NULL, packed binary NOT NULL").repartition(partitions, "m", "block")

    def windows_of(key: tuple, table: pa.Table) -> pa.Table:
        runs = [run.strings(np.unique(run.codes)) for batch in unpacked(table.column("packed")) for run in symbol_runs(batch.column(2), order)]
        found = pa.chunked_array(runs, pa.string()).unique()
        return pa.Table.from_arrays([pa.array(np.full(len(found), key[k].as_py(), np.int32)) for k in (0, 1)] + [found], schema=WINDOWS)

    # columns that are never null keep the optimiser from adding filters to some readers of the exchange and not to others
    windows = dealt.groupBy("m", "block").applyInArrow(windows_of, "m int NOT NULL, block int NOT NULL, g string NOT NULL").repartition(partitions, "m", "g")
    # the least block is asked for so that both readers of the exchange want the same columns and share it
    distinct = windows.groupBy("m", "g").agg(F.min("block").alias("least")).where("least >= 0")
    scores = window_scores(distinct, weights, order)
    back = windows.join(scores, ["m", "g"]).select("m", "block", "g", "score")

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        names, values = found.column("g").combine_chunks(), found.column("score").to_numpy()
        sums, symbols, named = [np.zeros(0)], [np.zeros(0, np.int64)], []
        for batch in unpacked(texts.column("packed")):
            named.append(batch.select([0, 1]))
            for run in symbol_runs(batch.column(2), order):
                known = np.unique(run.codes)
                own = values[pc.index_in(run.strings(known), value_set=names).to_numpy()].astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(run.sizes)])[:-1]
                sums.append(np.add.reduceat(looked_up(run.codes, known, own), starts))
                symbols.append(np.where(run.sizes > 1, run.sizes, 0))  # a text without a word has its end alone
        rows = pa.Table.from_batches(named)
        return pa.table({"doc_id": rows.column(0), "lang": rows.column(1), "score": pa.array(np.concatenate(sums)), "symbols": pa.array(np.concatenate(symbols))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = dealt.groupBy("m", "block").cogroup(back.groupBy("m", "block")).applyInArrow(score, f"doc_id {kind}, lang string, score double, symbols long")
    return both.select("doc_id", "lang", "symbols", F.when(F.col("symbols") > 0, F.exp(-F.col("score") / F.col("symbols"))).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, order: int = 5, quantile: float = 0.98, folds: int = 2) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for ``docs`` (doc_id, text, lang).

    Texts are in folds by a hash of their words, and each is judged by the model of the ``trusted`` rows (doc_id,
    text) in other folds, so trusted documents are as unseen as others. All trusted text counts, and all models
    together see all of it. A language's threshold is the ``quantile`` of its trusted documents' perplexities; a
    language without any takes that of all. A document is kept up to its threshold, that value included; one without
    a word isn't, and neither is any if nothing is trusted. Null texts have no word, a null language is one of its
    own. Each row has its own result, repeated doc_ids too; an empty table gives an empty one; further columns
    aren't read.
    """
    plain = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    weights = train(gram_counts(trusted.where("text is not null").select("text"), order, folds), order)
    release(docs.sparkSession)
    scored = written(perplexities(plain, weights, order, folds), "perplexities")
    known = scored.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").where("perplexity is not null")
    by_lang = known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    overall = known.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    out = scored.join(F.broadcast(by_lang.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row for each language
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
