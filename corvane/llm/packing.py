"""Packing of token sequences into bins by a grouping genetic algorithm on distributed islands."""

from __future__ import annotations

import json
import os
import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_runs, written
from .token_counts import ODD_SPACE, byte_alphabet

#: The pre-tokenizer's pattern of the word-end vocabulary (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of text that a worker tokenizes at once.
RUN_BYTES = 4_000_000


class WordIds:
    """Ids of texts by way of their distinct white-space-free chunks.

    Neither the normalizer nor the pre-tokenizer of the word-end vocabulary looks across white space, so a
    text's ids are those of its chunks in order, and a batch needs each distinct chunk's ids only once. The
    end-of-word mark is a byte that UTF-8 never uses.
    """

    def __init__(self, spec: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, described, alphabet = Tokenizer.from_str(spec), json.loads(spec), byte_alphabet()
        self.special = [t["content"] for t in described["added_tokens"]]
        self.odd = re.compile("|".join([*map(re.escape, self.special), ODD_SPACE.pattern])).search
        ranks = {}
        for entry, number in described["model"]["vocab"].items():
            if entry not in self.special:
                word = entry.removesuffix("</w>")
                ranks[bytes(alphabet[c] for c in word) + (b"\xff" if word != entry else b"")] = number
        self.merge = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(WORD_PATTERN).findall
        self.marks = {c: self.merge(c.encode() + b"\xff") for c in ",."}

    def chunk(self, chunk: str) -> list[int]:
        plain = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # no final sigma: letters are lowered one by one
        if plain.isalpha():
            return self.merge(plain.encode() + b"\xff")
        if plain[:-1].isalpha() and plain[-1] in self.marks:
            return self.merge(plain[:-1].encode() + b"\xff") + self.marks[plain[-1]]
        if self.odd(chunk) or not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):  # letters that are newer than Python's tables
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return [i for w in self.split(plain) for i in self.merge(w.encode() + b"\xff")]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = parts.values.dictionary_encode()
        pool, ends = array("I"), np.zeros(len(words.dictionary) + 1, np.int64)
        for k, chunk in enumerate(words.dictionary.to_pylist()):
            pool.extend(self.chunk(chunk))
            ends[k + 1] = len(pool)
        ids, codes, bounds = np.frombuffer(pool, np.uint32).astype("<u4"), words.indices.to_numpy(), parts.offsets.to_numpy()
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = codes[low:high]
            sizes = ends[own + 1] - ends[own]
            stops = np.cumsum(sizes)
            total = int(stops[-1]) if high > low else 0
            yield ids[np.repeat(ends[own] - stops + sizes, sizes) + np.arange(total)]


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, then ``end_id``, cut at ``capacity``.

    One narrow pass. Null text is empty: one piece that holds ``end_id`` alone.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary: a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, step = WordIds(shared.value), np.array([end_id], "<u4").tobytes(), capacity * 4
        for batch in batches:
            rows, owns = [], (own for part in text_runs(batch.column(1), RUN_BYTES) for own in ids.of(part))
            for doc, own in zip(batch.column(0).to_pylist(), owns):
                tokens = own.tobytes() + end
                rows += [(doc, k, k * capacity, len(part) // 4, zlib.crc32(part)) for k, part in enumerate(tokens[at : at + step] for at in range(0, len(tokens), step))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], size: list[int], bins: list[list[int]], room: list[int]) -> None:
    """Puts ``items`` (in the order given) into the fullest bin that still takes them, else into a new one."""
    free = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in items:
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
        else:
            k, r = len(bins), best_fit.capacity
            bins.append([i])
            room.append(0)
        room[k] = r - size[i]
        if room[k] > 0:
            insort(free, (room[k], k))


def fitness(room: list[int], capacity: int) -> float:
    """Fewer bins first; among equals the one with the most uneven fill, which leaves room that can be used."""
    return -len(room) + sum((1 - r / capacity) ** 2 for r in room) / (len(room) + 1)


class Island:
    """One population of packings of the same items."""

    def __init__(self, size: list[int], capacity: int, seed: int, people: int):
        self.size, self.capacity, self.rng, self.people = size, capacity, random.Random(seed), people
        self.least = -(-sum(size) // capacity)
        self.pool: list[tuple[float, list[list[int]], list[int]]] = []

    def add(self, bins: list[list[int]]) -> None:
        room = [self.capacity - sum(self.size[i] for i in b) for b in bins]
        self.pool.append((fitness(room, self.capacity), bins, room))
        self.pool.sort(key=lambda x: -x[0])
        del self.pool[self.people :]

    def pack(self, order: list[int], bins: list[list[int]]) -> list[list[int]]:
        best_fit.capacity = self.capacity
        bins = [list(b) for b in bins]
        best_fit(order, self.size, bins, [self.capacity - sum(self.size[i] for i in b) for b in bins])
        return bins

    def found(self) -> None:
        """First packings: best fit by falling size, and by sizes that are shaken more and more."""
        for k in range(self.people):
            order = sorted(range(len(self.size)), key=lambda i: (-self.size[i] * (1 + 0.1 * k * self.rng.random()), i))
            self.add(self.pack(order, []))
            if self.done():
                return

    def done(self) -> bool:
        return bool(self.pool) and len(self.pool[0][1]) <= self.least

    def cross(self, mother: tuple, father: tuple) -> list[list[int]]:
        """Whole well-filled bins of the father are injected; the mother's bins that repeat their items go, and what they alone held is best-fitted."""
        ranked = sorted(range(len(father[1])), key=lambda k: (father[2][k], self.rng.random()))
        injected = [father[1][k] for k in ranked[: max(1, int(len(ranked) * self.rng.uniform(0.2, 0.6)))]]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in mother[1]:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in taken]
        return self.pack(sorted(displaced, key=lambda i: -self.size[i]), injected + kept)

    def shake(self, one: tuple) -> list[list[int]]:
        """Mutation: the emptiest bins and a few others are dissolved and packed anew."""
        order = sorted(range(len(one[1])), key=lambda k: -one[2][k] * self.rng.random())
        gone = set(order[: max(2, len(order) // 20)])
        return self.pack(sorted((i for k in gone for i in one[1][k]), key=lambda i: -self.size[i]), [b for k, b in enumerate(one[1]) if k not in gone])

    def evolve(self, generations: int) -> None:
        for _ in range(generations):
            if self.done() or len(self.pool[0][1]) < 2:
                return
            mother, father = self.rng.choice(self.pool), self.rng.choice(self.pool)
            self.add(self.cross(mother, father) if mother is not father else self.shake(mother))


def evolve_shards(items: DataFrame, capacity: int, shard_size: int, islands: int, epochs: int, people: int, generations: int, salt: int) -> DataFrame:
    """(id, length, shard, bin): each shard's best packing over all its islands.

    Shards hold about ``shard_size`` pieces whatever the input, so no task grows with it. A shard's islands are
    rows of their own, evolve in tasks of their own, and pass their elite to the next island between epochs.
    """
    n = items.count()
    shards = max(1, -(-n // shard_size))
    schema = "shard long, island int, id array<long>, length array<long>, bin array<int>, score double"

    def found(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id"], ascending=[False, True])
        return shown(key, group.id.to_numpy(), group.length.to_numpy(), None)

    def again(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("score", ascending=False, kind="stable")
        first = group.iloc[0]
        return shown(key, first.id, first.length, group.bin.tolist())

    def shown(key: tuple, ids: np.ndarray, lengths: np.ndarray, elites: list | None) -> pd.DataFrame:
        island = Island([int(x) for x in lengths], capacity, hash((int(key[0]), int(key[1]), salt, elites is None)), people)
        for elite in elites or ():
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(elite):
                bins.setdefault(int(b), []).append(i)
            island.add(list(bins.values()))
        if not island.done():
            island.found()
        island.evolve(generations)
        score, bins, _ = island.pool[0]
        numbers = np.empty(len(lengths), np.int32)
        for k, b in enumerate(bins):
            numbers[b] = k
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "id": [ids], "length": [lengths], "bin": [numbers], "score": [score]})

    shard = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(shards))
    state = items.select("id", "length", shard.alias("shard"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")).groupBy("shard", "island").applyInPandas(found, schema)
    for _ in range(epochs - 1):
        state = written(state, "islands")  # each epoch is a pass of its own: a lost executor repeats one at most
        moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        state = state.unionByName(moved).groupBy("shard", "island").applyInPandas(again, schema)
    best = state.groupBy("shard").agg(F.max_by(F.struct("id", "length", "bin"), F.struct("score", -F.col("island"))).alias("s"))
    return best.select("shard", F.explode(F.arrays_zip("s.id", "s.length", "s.bin")).alias("x")).select("x.id", "x.length", "shard", "x.bin")


def pack(pieces: DataFrame, capacity: int = 4096, shard_size: int = 2048, islands: int = 2, epochs: int = 2, people: int = 4, generations: int = 12) -> DataFrame:
    """(id, sequence_id, offset) for ``pieces`` (id, length), none longer than ``capacity``; each id is a number of its own.

    Round one packs shards of a bounded number of pieces; what their poorly filled bins hold is dealt out anew
    and packed in round two, so the loss is about a bin for each shard of leftovers. Full pieces are sequences
    of their own. Empty input gives an empty table. Where a sequence holds several pieces they lie in the order
    of their ids, gapless from 0.
    """
    args = (capacity, shard_size, islands, epochs, people, generations)
    first = written(evolve_shards(pieces.select("id", "length"), *args, salt=1), "packed")
    load = first.groupBy("shard", "bin").agg(F.sum("length").alias("load")).where(F.col("load") < int(capacity * 0.97))
    left = first.join(load, ["shard", "bin"], "left_semi").select("id", "length")
    second = evolve_shards(left, *args, salt=2)
    number = lambda top: (F.lit(top << 62) + F.shiftleft(F.col("shard"), 20) + F.col("bin")).alias("sequence_id")
    placed = first.join(load, ["shard", "bin"], "left_anti").select("id", "length", number(0)).unionByName(second.select("id", "length", number(1)))
    before = Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("id", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 4096, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): ``docs`` tokenized, cut and packed.

    The pieces are written once, numbered, so no text is tokenized twice and each row of ``docs`` has pieces of its
    own, repeated rows and doc_ids too. Null text is empty, an empty table gives an empty result, other columns
    aren't read.
    """
    pieces = written(token_pieces(docs, vocabulary_path, capacity).withColumn("id", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity, **options), "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
