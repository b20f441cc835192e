"""Benchmark decontamination as a prefix-filtered join of item windows; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates words after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item windows that are broadcast at most (each about 200 bytes); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Bits of the filter before that shuffle: 262,144 cells of 64, however many windows there are.
FILTER_BITS = 1 << 24
#: Stands behind a document's last word; no word holds this character.
END = "\x00"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII. Null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


def item_windows(items: DataFrame, window: int, item_id: str, text_col: str, least_words: int = 1) -> DataFrame:
    """(item_id, words): every ``window`` consecutive words of an item, each window once; a shorter item is one window."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") >= max(1, least_words))
    last = F.greatest(F.size("w") - window, F.lit(0))
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, F.lit(window)))).alias("words")).distinct()


def with_prefix(windows: DataFrame) -> DataFrame:
    """(words, word, at, size): each different window's rarest word and its place in it.

    A window is contained only as a whole, so of its words, ordered by rarity, a prefix of one is enough. Rarity
    is the number of different windows with the word; ties go to the longer word, then by text, then to the left.
    """
    distinct = windows.select("words").distinct()
    each = distinct.select("words", F.posexplode("words").alias("at", "word"))
    rarity = each.groupBy("word").agg(F.countDistinct("words").alias("n"))
    rarest = F.min(F.struct(F.col("n"), -F.length("word"), F.col("word"), F.col("at"))).alias("r")
    return each.join(rarity, "word").groupBy("words").agg(rarest).select("words", F.col("r.word").alias("word"), F.col("r.at").alias("at"), F.size("words").alias("size"))


def occurrences(docs: DataFrame, windows: DataFrame, small: bool, window: int, doc_id: str, text_col: str) -> DataFrame:
    """(doc_id, start, size, words) of every place where a window occurs, and a row (doc_id, start = number of words, 0) for each document.

    Each document word probes the windows' prefix words. Length and positional bounds (the window begins and ends
    inside the document) and the exact comparison are conditions of the join, so only true occurrences are rows.
    """
    prefix = with_prefix(windows)
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    return broadcast_join(words, prefix) if small else shuffled_join(words, prefix, window)


def broadcast_join(words: DataFrame, prefix: DataFrame) -> DataFrame:
    """The windows go to the texts; the row that ends a document comes from the same pass over its text."""
    closing = prefix.sparkSession.range(1).select(F.array().cast("array<string>").alias("words"), F.lit(END).alias("word"), F.lit(0).alias("at"), F.lit(0).alias("size"))
    prefix = F.broadcast(prefix.unionByName(closing))
    each = words.select("doc_id", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("place", "word"))
    start = F.col("place") - F.col("at")
    inside = (start >= 0) & (start + F.col("size") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("words"))
    return each.join(prefix, (each.word == prefix.word) & inside).select("doc_id", start.alias("start"), "size", "words")


def shuffled_join(words: DataFrame, prefix: DataFrame, window: int) -> DataFrame:
    """Words that may be prefix words go to the windows, each with the words that a window around it can hold.

    What may be is told by a table of bits of the prefix words' hashes, whose size is fixed (FILTER_BITS), so most
    words stay where they are; the rest is a join by word. The rows that end documents are a narrow pass of their own.
    """
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = prefix.select(hashed("word").alias("h")).groupBy(F.shiftright("h", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    each = words.select("doc_id", "w", F.posexplode("w").alias("place", "word")).withColumn("h", hashed("word")).withColumn("cell", F.shiftright("h", 6))
    probing = each.join(F.broadcast(bits), "cell").where(F.expr("shiftrightunsigned(bits, cast(h & 63 as int)) & 1") == 1)
    before = F.least(F.col("place"), F.lit(window - 1))
    probing = probing.select("doc_id", "place", "word", before.alias("before"), F.slice("w", F.col("place") - before + 1, F.lit(2 * window - 1)).alias("around"))
    start = F.col("before") - F.col("at")
    inside = (start >= 0) & (start + F.col("size") <= F.size("around")) & (F.slice("around", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("words"))
    found = probing.join(prefix, (probing.word == prefix.word) & inside).select("doc_id", (F.col("place") - F.col("at")).alias("start"), "size", "words")
    return found.unionByName(words.select("doc_id", F.size("w").alias("start"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("words")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, least_items: int = 2, least_words: int = 1, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) for each document.

    ``n_hit`` counts the words inside any occurrence of an item window, ``item_ids`` are the items with an occurring
    window, as sorted strings; a document is contaminated from ``least_items`` such items on. Null texts have no
    words, and items of fewer than ``least_words`` no windows. Repeated items count by id, once each; doc_id should be unique, as
    rows that share one are counted together. Empty tables of either side are allowed.
    """
    windows = item_windows(items, window, item_id, text_col, least_words)
    small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    found = occurrences(docs, windows, small, window, doc_id, text_col)
    # places and windows once each: a document's rows are bounded by its words and the windows at each place
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("size")
    new = F.greatest(F.lit(0), stop - F.greatest(F.col("start"), F.coalesce(F.max(stop).over(before), F.lit(0))))
    places = found.withColumn("new", new)
    # rows that end a document get a key of their own, else all of them would meet under the empty window
    own = F.when(F.col("size") > 0, F.col("words")).otherwise(F.array(F.concat(F.lit(END), F.col("doc_id").cast("string"))))
    by_window = places.withColumn("words", own).groupBy("doc_id", "words").agg(F.sum("new").alias("hit"), F.max(F.when(F.col("size") == 0, F.col("start"))).alias("n_words"))
    owners = windows.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    joined = by_window.join(F.broadcast(owners) if small else owners, "words", "left")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("ids", F.array().cast("array<string>"))))))
    out = joined.groupBy("doc_id").agg(F.coalesce(F.max("n_words"), F.lit(0)).cast("long").alias("n_words"), F.sum("hit").alias("n_hit"), ids.alias("item_ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("item_ids") >= least_items).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
