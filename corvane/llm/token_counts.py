"""Token counts by a whole-token shortcut in front of a byte-level BPE vocabulary."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_runs

#: The pre-tokenizer's pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A chunk ends where white space begins, so no pre-token spans two of them.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python alone, not to the tokenizer's library.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Entries of a worker's chunk cache before it starts anew; bounds memory, never changes a count.
CACHE = 500_000
RUN_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def prove_whole(spec: str) -> frozenset[str]:
    """Offline proof: the vocabulary's strings that the tokenizer encodes, alone, as the one token they name."""
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_str(spec), byte_alphabet()
    special = {t["content"] for t in json.loads(spec)["added_tokens"]}
    strings = []
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry in special or any(c not in alphabet for c in entry):
            continue
        try:
            strings.append((bytes(alphabet[c] for c in entry).decode(), number))
        except UnicodeDecodeError:
            continue
    found = tokenizer.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, number), e in zip(strings, found) if e.ids == [number])


class ChunkCounter:
    """Counts tokens of texts: whole-token pre-tokens at once; only the others are merged, by rank."""

    def __init__(self, spec: str, whole: frozenset[str]):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.whole = Tokenizer.from_str(spec), whole
        alphabet, described = byte_alphabet(), json.loads(spec)
        self.special = [t["content"] for t in described["added_tokens"] if t["special"]]
        ranks = {bytes(alphabet[c] for c in entry): number for entry, number in described["model"]["vocab"].items() if entry not in self.special}
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(PATTERN).findall
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.cache: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        whole, merge, cache = self.whole, self.merge, self.cache
        for chunk in chunks:
            word, end = (chunk[:-1], 1) if chunk[-1] in ",." else (chunk, 0)
            if word.isalpha() or word[1:].isalpha() and word[0] == " ":  # letters, perhaps after a space, are one pre-token
                cache[chunk] = end + (1 if word in whole else len(merge(word.encode())))
            else:
                cache[chunk] = sum(1 if t in whole else len(merge(t.encode())) for t in self.split(chunk))

    def counts(self, texts: list[str]) -> list[int]:
        out, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if ODD_SPACE.search(text):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False))
                continue
            pieces = [text]
            if self.cut and any(s in text for s in self.special):
                pieces = self.cut.split(text)
                out[i] = len(pieces) - 1
            parts += [(i, CHUNK.findall(p)) for p in pieces if p]
        if len(self.cache) > CACHE:
            self.cache.clear()
        unknown = set().union(*(p for _, p in parts)) - self.cache.keys() if parts else set()
        if unknown:
            self.learn(unknown)
        get = self.cache.__getitem__
        for i, chunks in parts:
            out[i] += sum(map(get, chunks))
        return out


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``; one narrow pass, no shuffle.

    ``vocabulary_path`` is a ``tokenizers`` JSON file of a byte-level BPE, read once by the driver. Special
    strings inside texts count as the library counts them. A null text is empty: 0 bytes, 0 tokens. Repeated
    rows give repeated results, an empty table an empty one; columns other than the two named are not read.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, prove_whole(spec)))  # one vocabulary: a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(*shared.value)
        for batch in batches:
            texts, counts = batch.column(2).to_pylist(), []
            for part in in_runs(texts, map(len, texts), RUN_CHARS):
                counts += counter.counts(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
