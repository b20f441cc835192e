"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, connected_components, group_runs, release, within, written

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Shingles whose bits are summed at once; bounds a worker's memory for very long texts.
BLOCK = 65_536
#: Shingles of a block of a bucket (8 MB); one task compares two blocks at a time.
SET_BLOCK = 1_000_000
#: Sets up to so many shingles have twice the fingerprints; rows of a slot that are all held against one another.
FEW, SLOT = 8, 256
#: How often documents and their groups name the least of one another to be gathered.
ROUNDS = 2


def words_and_bounds(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words joined by one space, and where each begins and ends."""
    words = [w.encode() for w in WORD.findall(text.translate(ASCII_LOWER))]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; no words: zero."""
    import xxhash

    joined, starts, ends = words_and_bounds(text or "")
    n = len(starts)
    if not n:
        return 0
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()) if n >= shingle else [(0, len(joined))]
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while block := [digest(joined[a:b], seed) for a, b in itertools.islice(spans, BLOCK)] if n >= shingle else ([digest(joined, seed)] if not total else []):
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, ...): one 64-bit fingerprint, as a signed long, for each seed: fp, fp1, fp2 and so on."""
    names = ["fp", *(f"fp{k}" for k in range(1, len(seeds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[fingerprint(t.as_py(), shingle, s) for s in seeds] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k in range(len(seeds)))], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names)]))


def radii(bits: int, distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment. Pigeonhole: if every segment differed by more than its radius,
    the whole would differ by more than ``distance``; for that the radii need add up to distance - segments + 1."""
    widths = [bits // segments + (k < bits % segments) for k in range(segments)]
    least, extra = divmod(max(0, distance - segments + 1), segments)
    out, shift = [], 0
    for k, width in enumerate(widths):
        out.append((shift, width, least + (segments - 1 - k < extra)))  # wider balls in the narrower segments
        shift += width
    return out


def near_pairs(prints: DataFrame, distance: int = 4, segments: int = 3, fp: str = "fp", accepted: int | None = None, stars: bool = False, apart: str | None = None) -> DataFrame:
    """(fp_a, fp_b) with fp_a < fp_b for every two different values of ``fp`` within ``distance`` bits, whole.

    ``accepted`` (from ``distance`` on) also lets through those further apart that the same probes meet. ``stars``
    keeps one fingerprint of each table slot, so the pairs are no more than the probes; ``apart`` names a column of
    ``prints`` that has to differ, and is for a later search. One after the other they cover large groups of near copies
    without listing their pairs.

    The table holds each distinct fingerprint under each of its segments' values; the probes enumerate the Hamming
    ball around each segment. Of two segments that differ by a mask only the one with the mask's lowest bit
    unset probes, which halves the probes. The complete distance is verified inside the join, so candidates that
    fail it are never rows.
    """
    if stars and apart:
        raise ValueError("stars and apart are for searches of their own")
    plan = radii(64, distance, segments)
    distinct = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(apart).alias("group")) if apart else prints.select(F.col(fp).alias("fp")).distinct()
    mine, others = (["group"], [F.col("group").alias("other_group")]) if apart else ([], [])

    def key(shift: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    table = distinct.select(F.col("fp").alias("other"), F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), key(s, w).alias("key")) for k, (s, w, _) in enumerate(plan)])).alias("e"), *others).select("other", "e.segment", "e.key", *(["other_group"] if apart else []))
    if stars:
        table = table.groupBy("segment", "key").agg(F.min("other").alias("other"))
    balls = []
    for k, (shift, width, radius) in enumerate(plan):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]
        own = distinct.select("fp", *mine, F.lit(k).alias("segment"), key(shift, width).alias("own"), F.explode(F.array(*map(F.lit, masks)).cast("array<bigint>")).alias("mask"))
        if not stars:
            own = own.where(F.expr("own & mask & -mask") == 0)
        balls.append(own.select("fp", *mine, "segment", F.expr("own ^ mask").alias("key"), (F.col("mask") == 0).alias("same")))
    probes = balls[0]
    for ball in balls[1:]:
        probes = probes.unionByName(ball)
    match = (probes.segment == table.segment) & (probes.key == table.key) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= (accepted or distance)) & (F.col("fp") != F.col("other"))
    match = match & (F.col("group") != F.col("other_group")) if apart else match
    match = match if stars else match & (~F.col("same") | (F.col("fp") < F.col("other")))
    return probes.join(table, match).select(F.least("fp", "other").alias("fp_a"), F.greatest("fp", "other").alias("fp_b")).distinct()


def fewest_steps(n: int, distance: int) -> int:
    """How many segments make a search among ``n`` fingerprints cheapest: probes, and what each meets in its slot."""
    def steps(segments: int) -> float:
        return sum(sum(math.comb(width, r) for r in range(radius + 1)) * (1 + n / 2**width) for _, width, radius in radii(64, distance, segments))

    return min(range(2, 9), key=steps)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id reachable by links.

    Copies collapse to one fingerprint before any search, so groups of copies make no pairs; links stay between
    different fingerprints. Of a group of near ones, each is held against the least of each slot first, then those
    that are still apart against one another, so no group lists its pairs. ``segments`` sets the table's segments; by
    default the row count does, which changes the work and never the result. A null or blank text has fingerprint
    zero and links like any other. Repeated doc_ids give repeated rows, an empty table an empty one; further columns
    aren't read.
    """
    prints = written(fingerprints(docs, shingle, (seed,), id_col, text_col), "fingerprints")
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    segments = segments or fewest_steps(first.count(), distance)
    a, b = first.select(F.col("fp").alias("fp_a"), F.col("first").alias("a")), first.select(F.col("fp").alias("fp_b"), F.col("first").alias("b"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.join(a, "fp_a").join(b, "fp_b").select("a", "b")

    def grouped(links: DataFrame) -> DataFrame:
        found = connected_components(links)
        return first.join(found, first["first"] == found["node"], "left").select("fp", "first", F.coalesce("component", "first").alias("group"))

    stars = written(ends(near_pairs(first, distance, segments, stars=True)), "stars")
    groups = written(grouped(stars), "groups")
    rest = ends(near_pairs(groups, distance, segments, apart="group"))
    classes = grouped(written(stars.unionByName(rest), "links")).select("fp", F.col("group").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seeds: int = 24, distance: int = 40, small: int = 500_000) -> DataFrame:
    """(doc_id, component_id) of documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Documents of equal shingle sets (by 128 bits of hash) are linked to the first of them, which alone is searched
    with. Multi-index hashing over ``seeds`` SimHash fingerprints of a set: each is cut into segments of 16 bits, and
    documents that share any segment are candidates if 128 bits, those of the first two fingerprints, differ by
    ``distance`` at most. One bit of two sets of similarity 0.8 differs with probability 0.152 where sets are large,
    so they meet with probability 0.9992; sets of few shingles have twice the seeds, as their bits differ oftener. All
    are verified on the sets of whole texts. The first and the last document of each group of candidates are held
    against its others; then groups whose documents are still in different components are compared within tasks,
    which return spanning forests and never the pairs of a group. Groups that share documents over several slots are
    gathered first, so a document is held once for each gathering and not for each slot. Ids under ``small`` rows are broadcast, more are
    shuffled. Only documents with a partner come back.

    Null and blank texts have one empty shingle each, so they are copies of one another. Rows that share a doc_id are
    one document with any of their texts; an empty table gives an empty one; further columns aren't read.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = written(docs.select("doc_id", "text").mapInArrow(lambda batches: signatures(batches, shingle, seeds), "doc_id long, high long, low long, n int, fps array<long>"), "signatures")
    first = written(signed.groupBy("high", "low").agg(F.min("doc_id").alias("first")), "first")
    same = written(signed.select("doc_id", "high", "low").join(first, ["high", "low"]).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "same")
    keys = F.expr("explode(flatten(transform(fps, (f, k) -> transform(array(0, 1, 2, 3), s -> shiftleft(cast(4 * k + s as bigint), 16) | (shiftrightunsigned(f, 16 * s) & 65535L)))))")
    every = signed.join(same.select(F.col("b").alias("doc_id")), "doc_id", "left_anti").select(keys.alias("key"), "doc_id", "n", F.col("fps")[0].alias("fp"), F.col("fps")[1].alias("fp1"))
    slots = every.repartition(partitions, "key").sortWithinPartitions("key", "doc_id")
    groups = written(slots.mapInArrow(lambda batches: near_groups(batches, distance), "key long, low long, high long, doc_id long, n int"), "groups")
    del every, slots
    release(docs.sparkSession)
    members = written(gathered(groups), "members")

    ends = members.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    stars = members.join(ends, "key").select("doc_id", F.explode(F.array("low", "high")).alias("star")).where("doc_id <> star")
    pairs = written(stars.select(F.least("star", "doc_id").alias("a"), F.greatest("star", "doc_id").alias("b")).distinct(), "pairs")
    texts = within(docs.select("doc_id", "text"), members.select("doc_id").distinct(), "left_semi", small)
    sets = written(texts.mapInArrow(lambda batches: shingle_sets(batches, shingle), "doc_id long, shingles array<long>"), "shingles")
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = pairs.join(x, "a").join(y, "b").where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")
    links = written(same.unionByName(near), "links")
    so_far = connected_components(links)
    known = written(members.join(so_far, members["doc_id"] == so_far["node"], "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "known")
    # groups of three documents at most have had all their pairs verified
    weights = known.groupBy("key", "component").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    mixed = weights.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("parts")).where("parts > 1 and docs > 3")
    # the largest component of a group meets the rest, not itself; both are in blocks of about SET_BLOCK shingles, so no tile
    # grows with the group, and a group of one block each is sent once
    blocks = lambda n: F.ceil(n / SET_BLOCK).cast("int")
    plan = mixed.select("key", F.col("main.component").alias("main"), blocks(F.col("total") - F.col("main.n")).alias("rest"), blocks(F.col("main.n")).alias("mains"))
    block = F.when(F.col("component") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("doc_id"), "mains")).otherwise(F.pmod(F.xxhash64("doc_id"), "rest")).cast("int")
    apart = known.join(plan, "key").withColumn("block", block)
    others = F.expr("if(block >= rest, sequence(0, rest - 1), filter(sequence(0, rest + mains - 1), b -> b <> block))")
    tiles = apart.withColumn("other", F.explode(others)).select("key", F.least("block", "other").cast("long").alias("low"), F.greatest("block", "other").cast("long").alias("high"), "doc_id", "component")
    held = tiles.join(sets, "doc_id").select("key", "low", "high", "doc_id", "component", "shingles")
    dealt = held.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    across = dealt.mapInArrow(lambda batches: links_across(batches, similarity), "a long, b long")
    found = connected_components(links.unionByName(written(across.distinct(), "across")))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def gathered(groups: DataFrame) -> DataFrame:
    """(key, doc_id, n): groups of slots (key, low, doc_id, n) that share documents, put together under one key.

    A document names the least ``low`` of its groups, a group follows the least its documents name, and both once more.
    Each group goes to one key whole, so its documents meet there, and slots of the same documents count once."""
    named = groups.withColumn("to", F.col("low"))
    for _ in range(ROUNDS):
        named = named.withColumn("to", F.min("to").over(Window.partitionBy("doc_id"))).withColumn("to", F.min("to").over(Window.partitionBy("key")))
    return named.groupBy(F.col("to").alias("key"), "doc_id").agg(F.max("n").alias("n"))


def links_across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): for each tile (rows of one key, low and high) links that connect all of its documents of different
    components that similar pairs connect; each document out of the tile's largest component is held against all."""
    for tiles, bounds in group_runs(batches, 3):
        out_a, out_b = [], []
        ids, components, shingles = tiles.column(3).to_numpy(), tiles.column(4).to_numpy(), tiles.column(5).combine_chunks()
        flat, starts = np.asarray(shingles.values), np.asarray(shingles.offsets)
        for low, high in zip(bounds[:-1], bounds[1:]):
            own, n = components[low:high].copy(), np.diff(starts[low : high + 1])
            names, sizes = np.unique(own, return_counts=True)
            if len(names) < 2:
                continue
            at = starts[low:high] - starts[low]
            _, codes, often = np.unique(flat[starts[low] : starts[high]], return_inverse=True, return_counts=True)
            # prefix filter: of the rarest n - similarity * n + 1 shingles of each set, similar ones have one in common
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((codes, often[codes], of))
            first = order[np.arange(len(codes)) - np.repeat(at, n) <= np.repeat(n - np.ceil(similarity * n - 1e-6), n)]
            first = first[often[codes[first]] > 1]
            shared, holders = codes[first], of[first]
            by = np.argsort(shared, kind="stable")
            begin, end = (np.searchsorted(shared[by], shared, side).tolist() for side in ("left", "right"))
            own_first = np.searchsorted(holders, np.arange(len(n) + 1))
            posted = holders[by]
            mark = np.zeros(len(often), np.int32)
            for i in np.nonzero(own != names[sizes.argmax()])[0]:
                met = [posted[begin[k] : end[k]] for k in range(own_first[i], own_first[i + 1])]
                met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
                met = met[(own[met] != own[i]) & (similarity * np.maximum(n[met], n[i]) <= np.minimum(n[met], n[i]) + 1e-6)]
                if not len(met):
                    continue
                mine, heads = codes[at[i] : at[i] + n[i]], np.cumsum(n[met]) - n[met]
                mark[mine] = 1
                common = np.add.reduceat(mark[codes[np.repeat(at[met] - heads, n[met]) + np.arange(n[met].sum())]], heads)
                mark[mine] = 0
                for j in met[common >= similarity * (n[met] + n[i] - common)]:
                    if own[j] != own[i]:
                        out_a.append(int(ids[low + i]))
                        out_b.append(int(ids[low + j]))
                        own[own == own[j]] = own[i]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(out_a, out_b), pa.int64()), pa.array(np.maximum(out_a, out_b), pa.int64())], ["a", "b"])


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles; one of nothing for a text without words."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    joined, starts, ends = words_and_bounds(text or "")
    n = len(starts)
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()) if n >= shingle else [(0, len(joined))]
    return np.array(sorted({digest(joined[a:b]) for a, b in spans}), np.uint64)


def shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles): the hashes of each text's different shingles."""
    for batch in batches:
        out = [shingle_set(text.as_py(), shingle).view(np.int64) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def set_fingerprints(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A SimHash fingerprint for each seed: 64 majority bits over the hashes, each mixed anew with the seed."""
    n, ones = len(found), np.zeros((8, len(seeds), 8), np.int64)
    for at in range(0, n, 255):  # a byte of a lane counts one bit, up to 255
        h = (found[None, at : at + 255] ^ seeds[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        lanes = (h[None] >> np.arange(8, dtype=np.uint64)[:, None, None]) & np.uint64(0x0101010101010101)
        ones += lanes.sum(axis=2, dtype="<u8").view(np.uint8).reshape(ones.shape)
    return np.packbits(2 * ones.transpose(1, 2, 0).reshape(-1, 64) > n, axis=1, bitorder="little").view("<u8")[:, 0]


def signatures(batches: Iterator[pa.RecordBatch], shingle: int, seeds: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, high, low, n, fps): two halves of a hash of a text's shingle set, its size, and the set's fingerprints."""
    import xxhash

    drawn = np.random.default_rng(42).integers(0, 1 << 64, 2 * seeds, np.uint64)
    for batch in batches:
        out = []
        for text in batch.column(1):
            found = shingle_set(text.as_py(), shingle)
            halves = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            out.append((int(halves[0]), int(halves[1]), len(found), set_fingerprints(found, drawn if len(found) <= FEW else drawn[:seeds]).view(np.int64)))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", "high", "low", "n", "fps"])


def near_groups(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(key, low, high, doc_id, n): the documents of a slot (rows of one key: key, doc_id, n, fp, fp1) that chains of
    ``distance`` bits at most connect, a key for each such group by its members alone, and its least and greatest doc_id."""
    for slots, bounds in group_runs(batches, 1):
        ids, n = slots.column(1).to_numpy(), slots.column(2).to_numpy()
        fp, fp1 = (slots.column(k).to_numpy().view(np.uint64) for k in (3, 4))
        sizes, starts = np.diff(bounds), np.asarray(bounds[:-1])
        ends = np.repeat(starts + sizes, sizes)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, step = np.nonzero(np.repeat(sizes <= SLOT, sizes))[0], 1
        while len(left := left[left + step < ends[left]]):
            near = np.bitwise_count(fp[left] ^ fp[left + step]) + np.bitwise_count(fp1[left] ^ fp1[left + step]) <= distance
            out_a.append(left[near])
            out_b.append(left[near] + step)
            step += 1
        for low in starts[sizes > SLOT].tolist():
            rest, reached = np.arange(low, ends[low]), []
            while len(rest):  # what is reached is held against what isn't, so a group of near copies is gone through once
                if not reached:
                    reached, rest = [rest[0]], rest[1:]
                at = reached.pop()
                near = np.bitwise_count(fp[rest] ^ fp[at]) + np.bitwise_count(fp1[rest] ^ fp1[at]) <= distance
                out_a.append(np.full(int(near.sum()), at))
                out_b.append(rest[near])
                reached += rest[near].tolist()
                rest = rest[~near]
        a, b, label = np.concatenate(out_a), np.concatenate(out_b), np.arange(len(ids))
        while (differ := label[a] != label[b]).any():
            a, b = a[differ], b[differ]
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while (label[label] != label).any():
                label = label[label]
        rows = np.nonzero(np.bincount(label, minlength=len(ids))[label] > 1)[0]
        rows = rows[np.argsort(label[rows], kind="stable")]
        if not len(rows):
            continue
        heads = np.nonzero(np.diff(label[rows], prepend=-1))[0]
        lengths = np.diff([*heads, len(rows)])
        mixed = (ids[rows].view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        of = lambda function, values: np.repeat(function.reduceat(values, heads), lengths)
        low, high = of(np.minimum, ids[rows]), of(np.maximum, ids[rows])
        columns = [of(np.add, mixed ^ (mixed >> np.uint64(33))).view(np.int64), low, high, ids[rows], n[rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c[low < high]) for c in columns], ["key", "low", "high", "doc_id", "n"])


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
