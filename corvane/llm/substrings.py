"""Repeated word windows across documents, found level by level at doubling lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs

RUN_BYTES = 8_000_000
EMPTY = np.zeros(0, np.int64)
#: What a row of a level is: seen once in its run, the first of several there, or one of the others, which needs no comparison.
ONCE, SEVERAL, SETTLED = 0, 1, 2


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(23)) | (b >> np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def doubled(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ``length``-word windows, each made of those of its two halves."""
    if length == 1:
        return words
    half = doubled(words, length // 2)
    step = length // 2
    out = mixed(half[: len(half) - step], half[step:])
    if length % 2:
        out = mixed(out[: len(words) - length + 1], words[length - 1 :])
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word of the texts, end to end, and the bounds of each text in them."""
    import xxhash

    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = parts.values.dictionary_encode()
    digest = xxhash.xxh3_128_digest
    known = words.dictionary.to_pylist()
    own = np.frombuffer(b"".join(map(digest, known)), np.uint64).reshape(-1, 2)
    filled = np.array([bool(w) for w in known], bool)
    codes, bounds = words.indices.to_numpy(), parts.offsets.to_numpy()
    if not len(codes):
        return own[:0, 0], own[:0, 1], np.zeros(len(bounds), np.int64)
    keep = filled[codes]
    found = own[codes[keep]]
    return found[:, 0], found[:, 1], np.concatenate([[0], np.cumsum(keep)])[bounds]


def levels(window: int, shortest: int) -> list[int]:
    """The lengths to go through, each at most twice the one before, the last being ``window``."""
    lengths = [window]
    while lengths[0] >= 2 * shortest:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def window_starts(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a window inside one text starts, and the number of that text."""
    size = int(bounds[-1])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.nonzero(np.arange(size) + window <= bounds[doc + 1])[0] if size else EMPTY
    return starts, doc


def anchors_of(short: np.ndarray, starts: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each window the place of the least-hashed (leftmost of these) of the ``length``-word windows inside it.

    It depends on the window's words alone, so equal windows have equal anchors; some windows in a row share theirs.
    """
    if not len(starts):
        return EMPTY
    return sliding_window_view(short, window - length + 1)[starts].argmin(axis=1) + starts


def level_rows(key: np.ndarray, doc_id: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """(key, doc_id, at, kind) of a run's windows of one length; of equal ones only the first is to be compared."""
    order = np.lexsort((at, doc_id, key))
    key, doc_id, at = key[order], doc_id[order], at[order]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    several = np.append(same[1:], False)[: len(key)]
    kind = np.where(same, SETTLED, np.where(several, SEVERAL, ONCE)).astype(np.int8)
    key = np.where(same, mixed(doc_id.view(np.uint64), at.astype(np.uint64)), key)  # settled: these pass through any task
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc_id), pa.array(at.astype(np.int32)), pa.array(kind)], ["key", "doc_id", "at", "kind"])


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at) of the windows that occur more than once; rows come sorted by key."""
    last = held = None  # the key before this batch, and its row where nothing yet says that it repeats
    for batch in batches:
        settled = batch.column(3).to_numpy() == SETTLED
        yield batch.filter(pa.array(settled)).select([1, 2])
        batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        before = np.concatenate([[last is not None and key[0] == last], key[1:] == key[:-1]])
        if held is not None and key[0] == last:
            yield held
        stays = before | np.append(before[1:], False) | (batch.column(3).to_numpy() == SEVERAL)
        yield batch.filter(pa.array(stays)).select([1, 2])
        last = key[-1]
        held = None if stays[-1] else batch.slice(batch.num_rows - 1).select([1, 2])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array | None]]:
    """(doc_ids, texts, surviving starts) in runs of bounded size."""
    for batch in batches:
        low = 0
        for texts in text_runs(batch.column(1), RUN_BYTES):
            part = batch.slice(low, len(texts))
            low += len(texts)
            yield part.column(0).to_numpy(), texts, part.column(2) if part.num_columns > 2 else None


def flags(marks: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """True for every word of a run at which a surviving window starts."""
    out = np.zeros(int(bounds[-1]) + 1, bool)
    for k, own in enumerate(marks):
        if own.is_valid:
            at = own.values.to_numpy() + bounds[k]
            out[at[at < bounds[k + 1]]] = True
    return out[:-1]


def shortest_level(window: int, length: int):
    """The first level: the anchors of all full windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in runs_of(batches):
            words, _, bounds = word_hashes(texts)
            starts, doc = window_starts(bounds, window)
            short = doubled(words, length) if len(starts) else words
            at = np.unique(anchors_of(short, starts, window, length))
            yield level_rows(short[at], ids[doc[at]], at - bounds[doc[at]])

    return run


def next_level(window: int, before: int, length: int):
    """A level between: each surviving window of ``before`` words is extended to ``length``, to the right and to the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in runs_of(batches):
            words, _, bounds = word_hashes(texts)
            starts, doc = window_starts(bounds, length)
            alive = np.nonzero(flags(marks, bounds))[0]
            at = np.unique(np.concatenate([alive, alive + before - length]))
            at = at[np.isin(at, starts)]
            # an extension to the left must not begin in the text before
            own = doubled(words, length)[at] if len(at) else words[:0]
            yield level_rows(own, ids[doc[at]], at - bounds[doc[at]])

    return run


def last_level(window: int, before: int, length: int):
    """The last level: rows (key, doc_id, at, windows, mask) of the full windows that hold a surviving one of ``before`` words.

    Windows with one anchor (of ``length`` words) lie side by side and travel as one row: 64 bits of each window,
    from other word hashes than the anchor's. What a run alone shows to repeat is marked and not compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in runs_of(batches):
            words, others, bounds = word_hashes(texts)
            starts, doc = window_starts(bounds, window)
            survives = flags(marks, bounds)
            alive = np.concatenate([[0], np.cumsum(survives)])
            starts = starts[alive[starts + window - before + 1] > alive[starts]] if len(starts) else starts
            if not len(starts):
                continue
            short = doubled(words, length)
            least = anchors_of(short, starts, window, length)
            if before == length:  # the survivors are anchors themselves
                starts, least = starts[survives[least]], least[survives[least]]
                if not len(starts):
                    continue
            change = np.concatenate([[True], (np.diff(least) != 0) | (np.diff(starts) != 1)])
            first = np.nonzero(change)[0]
            at, n = starts[first], np.diff(np.append(first, len(starts)))
            key, own, windows = short[least[first]], doc[at], doubled(others, window)[starts]
            ends = np.cumsum(n)
            content = mixed(mixed(windows[ends - n], windows[ends - 1]), key + n.astype(np.uint64))  # together these hold all its words
            order = np.lexsort((at - bounds[own], ids[own]))
            sent = np.zeros(len(key), bool)
            _, index, group = np.unique(content[order], return_index=True, return_inverse=True)
            sent[order[index]] = True
            original = np.empty(len(key), np.int64)
            original[order] = order[index][group]
            place = at - bounds[own]
            twin = (ids[own] == ids[own[original]]) & (place == place[original])  # of a repeated row: neither is earlier
            late = ~sent & ~twin
            offsets = np.concatenate([[0], np.cumsum(n[sent])]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(windows[np.repeat(sent, n)].view(np.int64)))
            yield rows(key[sent], ids[own[sent]], place[sent], hashes, None)
            yield rows(mixed(ids[own[late]].view(np.uint64), place[late].astype(np.uint64)), ids[own[late]], place[late], None, (np.int64(1) << n[late]) - 1)  # settled

    def rows(key, doc, at, windows, mask) -> pa.RecordBatch:
        size, kind = len(key), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(at.astype(np.int32)), pa.nulls(size, kind) if windows is None else windows, pa.nulls(size, pa.int64()) if mask is None else pa.array(mask)], ["key", "doc_id", "at", "windows", "mask"])

    return run


def late_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, mask) of the windows that aren't the first with their words; rows come by key, document and place."""
    last, seen, fresh, place = None, EMPTY, EMPTY, None  # of the key that the batch before ended with, and of its last row
    for batch in batches:
        settled = pc.is_valid(batch.column(4))
        yield batch.filter(settled).select([1, 2, 4])
        batch = batch.filter(pc.invert(settled))
        if not batch.num_rows:
            continue
        key, doc, at = (batch.column(k).to_numpy() for k in range(3))
        n = np.diff(batch.column(3).offsets.to_numpy())
        tails = batch.column(3).flatten().to_numpy()
        row = np.repeat(np.arange(len(key)), n)
        codes = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))[row]
        order = np.lexsort((tails, codes))  # stable: of equal windows the earliest comes first
        new = np.concatenate([[True], (codes[order][1:] != codes[order][:-1]) | (tails[order][1:] != tails[order][:-1])])
        first = np.empty(len(row), np.int64)
        first[order] = row[order[new]][np.cumsum(new) - 1]
        late = (doc[row] != doc[first]) | (at[row] != at[first])
        if last == key[0]:
            stop = int(n[key == last].sum())  # rows of the carried key come first
            twin = (doc[row[:stop]] == place[0]) & (at[row[:stop]] == place[1]) & np.isin(tails[:stop], fresh)
            late[:stop] |= np.isin(tails[:stop], seen) & ~twin
        of_key = key[row] == key[-1]
        at_end = of_key & (doc[row] == doc[-1]) & (at[row] == at[-1])
        carried = fresh if last == key[-1] and place == (doc[-1], at[-1]) else fresh[:0]
        fresh, place = np.union1d(carried, tails[at_end & ~late]), (doc[-1], at[-1])
        seen = np.union1d(seen, tails[of_key]) if last == key[-1] else np.unique(tails[of_key])
        last = key[-1]
        ends = np.cumsum(n)
        bit = np.arange(len(row)) - (ends - n)[row]
        mask = np.add.reduceat(np.where(late, np.int64(1) << bit, 0), ends - n)
        some = pa.array(mask > 0)
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(some), batch.column(2).filter(some), pa.array(mask).filter(some)], ["doc_id", "at", "mask"])


def repeated_windows(texts: DataFrame, window: int = 20, shortest: int = 10) -> DataFrame:
    """(doc_id, at, mask) for ``texts`` (doc_id, text): bit k of ``mask`` says that the window starting at word at + k also starts earlier.

    Level by level: of the shortest length only each full window's anchor is taken, which loses no window. Windows
    that occur once are dropped; those that repeat are extended to twice their length, and so on up to ``window``,
    where the earliest of each is found. Equal windows collapse within each run of texts before a shuffle, so a
    common passage sends a row a run. The last comparison is over 128 bits of independent word hashes: among N
    windows N² / 2¹²⁹ false matches are to be expected.
    """
    lengths = levels(window, shortest)
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    survivors, before = None, lengths[0]
    for length in lengths[:-1]:
        made = texts.mapInArrow(shortest_level(window, length), LEVEL) if survivors is None else with_marks(texts, survivors).mapInArrow(next_level(window, before, length), LEVEL)
        dealt = made.repartition(partitions, "key").sortWithinPartitions("key")
        survivors, before = dealt.mapInArrow(repeated, "doc_id long, at int").groupBy("doc_id").agg(F.collect_list("at").alias("marks")), length
    rows = with_marks(texts, survivors).mapInArrow(last_level(window, before, lengths[0]), "key long, doc_id long, at int, windows array<long>, mask long")
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "doc_id", "at").mapInArrow(late_windows, "doc_id long, at int, mask long")


LEVEL = "key long, doc_id long, at int, kind tinyint"


def with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, marks) for every row of ``texts``."""
    return texts.join(marks, "doc_id", "left").select("doc_id", "text", "marks")


def covered(n: int, window: int, marks: list[dict] | None) -> np.ndarray:
    """Which of a document's n words a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks or ():
        mask, at = m["mask"], m["at"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            edge[at + low] += 1
            edge[min(at + low + window, n)] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:n]) > 0


def without_repeats(docs: DataFrame, window: int = 20, shortest: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that a window repeated from earlier covers.

    Earlier is a smaller doc_id, or the same document further up. ``kept`` holds the words left, joined by one
    space. A null text has no words. doc_id is an integer; rows that share one are forms of one document: none is
    earlier than another, and each loses what any of them loses. An empty table gives an empty one; other columns
    aren't read. Texts are dealt out by doc_id once, for all levels and the result.
    """
    if not 2 <= window <= 100 or not 1 <= shortest:
        raise ValueError("window must be from 2 to 100 words, and shortest 1 at least")
    if window < 2 * shortest:
        shortest = max(1, window // 2)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = plain.repartition(partitions, "doc_id")
    marks = repeated_windows(texts, window, shortest).groupBy("doc_id").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    both = with_marks(texts, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part, marks in runs_of(batches):
            words, removed, kept = [], [], []
            for text, own_marks in zip(part, marks):
                own = text.as_py().encode().split()
                gone = covered(len(own), window, own_marks.as_py())
                words.append(len(own))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(own, gone.tolist()) if not g) if removed[-1] else b" ".join(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    """The result of ``without_repeats`` with the SHA-256 of what is kept in its place."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
