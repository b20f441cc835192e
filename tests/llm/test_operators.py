"""Each operator against brute force on small tables with nulls, blanks, repeats, ties and further columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")

from corvane.llm import decontamination, embeddings, language, packing, pii, quality, simhash, substrings, token_counts, toxicity  # noqa: E402

RNG = random.Random(5)
WORDS = ["alpha", "Beta", "gamma", "é", "DÉJÀ", "x1", "the", "of", "ñandú", "foo,bar", "."]
PASSAGE = " ".join(RNG.choice(WORDS) for _ in range(30))


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [None, "", "   ", "one", "one two three", "!!! ???", "12 34", "a\tb\nc\x0bd  e ", "same same " * 40]
    base += [sentence(RNG.randint(1, 60)) for _ in range(20)]
    base += [base[-1], base[-1], base[-2] + " tail", PASSAGE, "start " + PASSAGE, PASSAGE + " end " + PASSAGE, " ".join(f"w{i}" for i in range(3000))]
    base += ["x<|endoftext|> y  <|endoftext|>z", "Σίσυφος ΟΔΟΣ İ", "tab\x1cbed \x85 next word"]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "lang?", "src", f"fp{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, `private col` int").repartition(3)


def collected(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def empty(df):
    return df.where("1 = 0")


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = collected(token_counts.token_counts(docs, path, limit=20))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 20)
    assert token_counts.token_counts(empty(docs), path).count() == 0


def held_packing(rows, got, capacity):
    """The pieces of every row are there with the library's ids, and sequences are gapless; returns their number."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for doc, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        parts = [(k, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
        want += [(doc, k, k * capacity, len(x), zlib.crc32(x.tobytes())) for k, x in parts]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, texts):
    path = P.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=64, shard_size=16).collect()
    assert held_packing(list(enumerate(texts)), got, 64) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_packing_of_repeated_rows(spark):
    """Equal rows, doc_ids shared by different texts, letters newer than Python's tables, and a clashing column."""
    rows = [(1, "one two")] * 3 + [(1, "three four five " * 9), (2, None), (2, None), (3, "\u1c89 \ua7cb a\ua7dcb"), (4, "x " * 21000)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, sequence_id int")
    got = packing.pack_documents(table, P.path("word_bpe_49k.json"), capacity=64).collect()
    held_packing(rows, got, 64)


def fewest_bins(sizes, capacity):
    """Brute force: the least number of bins, by depth-first search."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if sizes[k] <= room and room not in rooms[:i]:
                place(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_packing_against_the_fewest_bins(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(15, 60) for _ in range(13)), reverse=True)
        got = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, length long"), 100).collect()
        assert len({r.sequence_id for r in got}) == fewest_bins(sizes, 100)


def test_genetic_packing_beats_or_equals_best_fit():
    rng = random.Random(1)
    size = [rng.choice([20, 27, 33, 41, 47, 53]) for _ in range(120)]
    island = packing.Island(size, 100, 3, 6)
    island.found()
    before = len(island.pool[0][1])
    island.evolve(60)
    bins = island.pool[0][1]
    assert sorted(i for b in bins for i in b) == list(range(120))
    assert all(sum(size[i] for i in b) <= 100 for b in bins)
    assert island.least <= len(bins) <= before


def brute_fingerprint(text, k, seed=42):
    lowered = (text or "").translate(simhash.ASCII_LOWER)
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("distance", [0, 2, 4, 7])
def test_simhash(docs, texts, distance):
    prints = [brute_fingerprint(t, 4) for t in texts]
    want = components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= distance)
    got = collected(simhash.near_duplicates(docs, 4, distance).withColumn("hex", simhash.as_hex(simhash.F.col("fp"))))
    assert {i: (r["hex"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(texts))}


def test_simhash_finds_every_near_pair(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    for b in list(base):
        base += [b ^ sum(1 << x for x in rng.sample(range(64), k)) for k in range(1, 7)]
    signed = [b - (1 << 64) if b >> 63 else b for b in base]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert {(r.fp_a, r.fp_b) for r in simhash.near_pairs(prints, 4).collect()} == want
    assert simhash.near_pairs(empty(prints), 4).count() == 0


def test_similar_documents(docs, texts):
    sets = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(simhash.ASCII_LOWER))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    want = components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == dict(enumerate(want))


def test_similar_documents_apart_from_the_first_of_a_class(spark):
    """One repeated shingle makes over half of each text, so fingerprints over repeats are all equal."""
    junk, tails = "same " * 400, [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    texts = [junk + tails[0], junk + tails[1], junk + tails[1], junk + tails[1] + " more", junk + tails[2], tails[2] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_similar_documents_meet_at_the_threshold(spark):
    """Pairs at Jaccard 0.805, just over the threshold, each of 300 words of which the last 32 differ."""
    rows = []
    for k in range(300):
        shared = " ".join(f"w{k}x{i}" for i in range(268))
        rows += [(2 * k + side, shared + "".join(f" {'ab'[side]}{k}x{i}" for i in range(32))) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert all(doc // 2 == c // 2 for doc, c in found.items())
    assert len(found) >= 0.99 * len(rows)


def brute_set_fingerprint(hashes, seed):
    """64 majority bits, one by one."""
    mask, counts = (1 << 64) - 1, [0] * 64
    for x in hashes:
        h = ((x ^ seed) * 0xFF51AFD7ED558CCD) & mask
        h = ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & mask
        h ^= h >> 33
        counts = [c + (h >> b & 1) for b, c in enumerate(counts)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(hashes))


@pytest.mark.parametrize("distance", [-1, 12, 40])
def test_similar_documents_come_from_simhash(spark, distance):
    """Candidates are pairs that share 16 bits of some SimHash fingerprint, and differ by ``distance`` of 128 at most."""
    rng = random.Random(61)
    texts = []
    for size in [4, 6, 9, 12, 30, 60, 300, 600] * 4:
        words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        texts += [" ".join(words), " ".join(words + ["more"] * (1 + size // 40)), " ".join(words[: -max(1, size // 12)] + ["end"]), " ".join(words)]
    sets = [simhash.shingle_set(t, 5).tolist() for t in texts]
    drawn = np.random.default_rng(42).integers(0, 1 << 64, 48, np.uint64).tolist()
    prints = [[brute_set_fingerprint(s, seed) for seed in drawn[: 48 if len(s) <= 8 else 24]] for s in sets]

    def linked(i, j):
        common = len(set(sets[i]) & set(sets[j]))
        meet = any((a ^ b) >> (16 * k) & 0xFFFF == 0 for a, b in zip(prints[i], prints[j]) for k in range(4))
        close = sum((prints[i][k] ^ prints[j][k]).bit_count() for k in (0, 1)) <= distance
        return sets[i] == sets[j] or (meet and close and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common))

    want = components(len(texts), linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, distance=distance).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == dict(enumerate(want))


def test_groups_of_a_slot():
    """Slots of few and of very many rows, over several batches, against plain loops."""
    import pyarrow as pa

    rng = random.Random(62)
    rows = []
    for key, size in enumerate([1, 2, 7, 40, 256, 257, 700]):
        bases = [rng.getrandbits(128) for _ in range(1 + size // 4)]
        rows += [(key, 1000 * key + i, i, rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 8)))) for i in range(size)]
    halves = lambda x: [h - (1 << 64) if h >> 63 else h for h in (x >> 64, x & ((1 << 64) - 1))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "n", "fp", "fp1"), (k, d, n, *halves(x)))) for k, d, n, x in rows])
    got = [r for out in simhash.near_groups((batch.slice(at, 100) for at in range(0, len(rows), 100)), 12) for r in out.to_pylist()]
    root = components(len(rows), lambda i, j: rows[i][0] == rows[j][0] and (rows[i][3] ^ rows[j][3]).bit_count() <= 12)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i][1])
    want = {(min(g), max(g), d) for g in groups.values() for d in g if len(g) > 1}
    assert {(r["low"], r["high"], r["doc_id"]) for r in got} == want and len(got) == len(want)
    assert len({r["key"] for r in got}) == sum(len(g) > 1 for g in groups.values())


@pytest.mark.parametrize("block", [1_000_000, 2_000])
def test_a_large_group_of_near_copies_is_held_once(spark, monkeypatch, block):
    """Near copies on either side of the threshold share slot after slot; each is held once, not for each slot, whatever the tiles."""
    rng, counts = random.Random(63), {}
    base, texts = [f"w{i}" for i in range(60)], []
    for _ in range(240):
        words = list(base)
        for at in rng.sample(range(5, 55), rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    keep = simhash.written

    def counted(df, name):
        out = keep(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    want = components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == dict(enumerate(want))
    assert 20 < len(set(want)) < 200 and counts["members"] <= 2 * len(texts) and counts["pairs"] <= 4 * len(texts)


def test_links_of_a_tile():
    """The prefix filter of a tile against all pairs: the same documents end up connected."""
    import pyarrow as pa

    rng, rows = random.Random(64), []
    for tile, size in enumerate([2, 3, 30, 120]):
        bases = [rng.sample(range(400), rng.randint(1, 40)) for _ in range(1 + size // 6)]
        for i in range(size):
            kept = sorted({x if rng.random() < 0.93 else rng.randrange(400) for x in rng.choice(bases)})
            rows.append({"key": tile, "low": 0, "high": 1, "doc_id": 1000 * tile + i, "component": 1000 * tile + i - i % 2, "shingles": kept})
    schema = pa.schema([(c, pa.int64()) for c in ("key", "low", "high", "doc_id", "component")] + [("shingles", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    got = {(r["a"], r["b"]) for out in simhash.links_across((batch.slice(at, 50) for at in range(0, len(rows), 50)), 0.8) for r in out.to_pylist()}
    ids = [r["doc_id"] for r in rows]

    def similar(i, j):
        a, b = set(rows[i]["shingles"]), set(rows[j]["shingles"])
        return rows[i]["key"] == rows[j]["key"] and len(a & b) >= 0.8 * len(a | b)

    same = lambda i, j: rows[i]["component"] == rows[j]["component"]
    assert got and all(similar(ids.index(a), ids.index(b)) for a, b in got)
    assert components(len(rows), lambda i, j: same(i, j) or (ids[i], ids[j]) in got or (ids[j], ids[i]) in got) == components(len(rows), lambda i, j: same(i, j) or similar(i, j))


def test_short_similar_documents_meet(spark):
    """Pairs of four and five shingles, whose fingerprints differ by more bits than those of long texts."""
    rows = [(2 * k + side, " ".join(f"w{k}x{i}" for i in range(8 + side))) for k in range(300) for side in (0, 1)]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id // 2 == r.component_id // 2 for r in found) and len(found) >= 0.99 * len(rows)


def brute_language(rows, text, longest=5):
    """The dealt rule, word by word: known words, then ever shorter n-grams, over uncut counts of ``rows``."""
    languages = sorted({lang for t, lang in rows if t is not None and lang is not None})
    split = lambda t: "".join(c if c.isalpha() else " " for c in t or "").lower().split()
    tables = [defaultdict(lambda: defaultdict(int)) for _ in range(longest + 1)]
    for t, lang in rows:
        if t is not None and lang is not None:
            for w in split(t):
                tables[0][w][lang] += 1
                for n in range(1, longest + 1):
                    for i in range(len(w) + 2 - n + 1):
                        tables[n][f"<{w}>"[i : i + n]][lang] += 1
    totals = [{x: sum(c[x] for c in t.values()) for x in languages} for t in tables]
    log = lambda n, s, x: np.log(tables[n][s][x] + 0.5) - np.log(totals[n][x] + 0.5 * (len(tables[n]) + 1))
    sums, words = dict.fromkeys(languages, 0.0), split(text)
    for w in words:
        if w in tables[0]:
            found = [{x: log(0, w, x) for x in languages}]
        else:
            found = []
            for n in range(longest, 0, -1):
                grams = [f"<{w}>"[i : i + n] for i in range(len(w) + 2 - n + 1)]
                found = [{x: log(n, g, x) for x in languages} for g in grams if g in tables[n]]
                if found:
                    break
        for x in languages:
            sums[x] += sum(f[x] for f in found) / max(1, len(found))
    if not words or not languages:
        return "und", 0.0
    best = max(languages, key=lambda x: sums[x])
    return best, 1 / sum(np.exp((sums[x] - sums[best]) / len(words) ** 0.5) for x in languages)


def test_language_against_brute_force(spark):
    """Ties, repeated rows, a long text, clashing names, nulls."""
    rng = random.Random(21)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "fghij"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))), x) for i, x in enumerate(list(letters) * 20)]
    rows += [(70, None, "aa"), (71, "", None), (72, "zzz", None), (73, "c d", None), (74, "1 2", "bb"), (75, "é中", None), (76, "abcde fghij " * 20_000, None), rows[0], rows[0]]
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, row string, score double")
    taught = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    got = language.identify(table).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        lang, score = brute_language(taught, texts[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=1e-9, abs=1e-12)), texts[r.doc_id][:40]


def brute_repeats(rows, window):
    """What each of the rows (doc_id, text) keeps, in the order of the rows."""
    first, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), (doc, k))
            first[tuple(words[k : k + window])] = min(first[tuple(words[k : k + window])], (doc, k))
    gone = defaultdict(set)
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (doc, k):
                gone[doc] |= set(range(k, k + window))
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        kept = [w for k, w in enumerate(words) if k not in gone[doc]]
        out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "shortest"), [(5, 10), (20, 10), (20, 3), (24, 3), (21, 2)])
def test_substrings(docs, texts, window, shortest):
    """One level, two, and more of them; PASSAGE and a long text repeat."""
    got = substrings.digest(substrings.without_repeats(docs, window, shortest)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(list(enumerate(texts)), window))
    assert substrings.without_repeats(empty(docs), window, shortest).count() == 0


def test_substrings_of_repeated_rows_and_ties(spark):
    """Rows that share a doc_id aren't earlier than one another; the same passage at many places, over small batches."""
    rng = random.Random(8)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(26)) for _ in range(3)]
    rows = []
    for i in range(60):
        text = " ".join([f"u{i}x{k}" for k in range(rng.randint(0, 6))] + [rng.choice(passages)] + [f"v{i}x{k}" for k in range(rng.randint(0, 6))] + [rng.choice(passages)])
        rows += [(i, text)] * (1 + (i % 7 == 0))
    rows += [(100, "z " * 500), (101, "z " * 45)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for shortest in (10, 5):
            got = substrings.digest(substrings.without_repeats(table, 20, shortest)).collect()
            assert sorted(map(tuple, got)) == sorted(brute_repeats(rows, 20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def words8(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(simhash.ASCII_LOWER))


def test_decontamination(spark, docs, texts):
    items = [(10, PASSAGE), (9, PASSAGE[3:]), (2, "one two three"), (3, None), (4, ""), (5, "...."), (6, sentence(9)), (6, texts[12]), (7, "One TWO three")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for small in (200_000, 0):  # broadcast and shuffled
        decontamination.BROADCAST_WINDOWS = small
        got = collected(decontamination.digest(decontamination.decontaminate(docs, table)))
        for i, t in enumerate(texts):
            words, hit, ids = words8(t), set(), set()
            for item, text in items:
                own = words8(text)
                for k in range(max(1, len(own) - 7)) if own else ():
                    w = own[k : k + 8]
                    for at in range(len(words) - len(w) + 1):
                        if words[at : at + len(w)] == w:
                            hit |= set(range(at, at + len(w)))
                            ids.add(str(item))
            digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            assert {k: got[i][k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")} == {"n_words": len(words), "n_hit": len(hit), "n_items": len(ids), "items_sha256": digest, "contaminated": len(ids) >= 2}, (i, t)
    decontamination.BROADCAST_WINDOWS = 200_000
    assert decontamination.decontaminate(docs, empty(table)).where("n_items > 0").count() == 0
    assert decontamination.decontaminate(empty(docs), table).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    near = np.repeat(base[:10], 6, axis=0) + 0.05 * rng.standard_normal((60, 16))
    rows = [[float(x) for x in v] for v in np.concatenate([base, near, base[:5], base[:5]])]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e200] * 16, [1e-200] * 16]
    table = spark.createDataFrame([(i, v, "n") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links string")

    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unit(v):
        x = np.array(v) / max(map(abs, v))
        return x / np.linalg.norm(x)

    units = [unit(v) if usable(v) else None for v in rows]
    linked = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.95
    want = components(len(rows), linked)
    for block in (2048, 4):  # whole buckets, and buckets in blocks
        embeddings.BLOCK = block
        got = collected(embeddings.near_duplicates(table), "vec_id")
        for i in range(len(rows)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(linked(i, j) for j in range(len(rows)) if j != i), want[i], want[i] == i), i
    embeddings.BLOCK = 2048
    assert embeddings.near_duplicates(empty(table)).count() == 0


def test_language(spark):
    rng = random.Random(4)
    vocabulary = {"aa": ["foo", "bar", "bazar", "foob"], "bb": ["xyx", "yyz", "zyxz", "xxy"]}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(12)) + ".", k) for i, k in ((i, "ab"[i % 2] * 2) for i in range(200))]
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "foob", None), (903, "zyxzy", None), (904, "中文", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collected(language.identify(table))
    for i, text, lang in rows[:200]:
        assert got[i]["lang_pred"] == lang and 0.5 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert (got[902]["lang_pred"], got[903]["lang_pred"]) == ("aa", "bb")  # an unseen word, by its n-grams
    assert got[904]["lang_pred"] in ("aa", "bb")
    assert language.identify(empty(table)).count() == 0
    model = language.fit(empty(table))
    assert {r.lang_pred for r in language.with_language(table, model).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        low, toxic = int(i % 4 == 0), int(i % 5 == 0)
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(15)] + ["junk"] * low + ["nasty"] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words), low, toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, low int, toxic int")
    chain = toxicity.fit(table, table.where("doc_id < 300"), ["low", "toxic"])
    more = spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")
    got = collected(toxicity.classify(table.select("doc_id", "text").unionByName(more), chain))
    for i, _, low, toxic in rows[300:]:
        assert (got[i]["p_low"] > 0.5, got[i]["p_toxic"] > 0.5) == (bool(low), bool(toxic))
    assert got[1000]["p_toxic"] == got[1001]["p_toxic"] < 0.5
    none = toxicity.fit(table, empty(table), ["low", "toxic"])
    assert toxicity.classify(table, none).count() == 400
    assert toxicity.classify(empty(table), chain).count() == 0


def brute_chain(rows, folds, words_per_category, least, text):
    """A chain of dense models, fitted by the same descent, one matrix at a time. ``rows`` are (words, labels, fold)."""
    vocabulary = sorted({w for words, _, _ in rows for w in words})
    x = np.array([[w in words for w in vocabulary] for words, _, _ in rows], float)
    fold = np.array([f for _, _, f in rows])
    targets = np.array([labels for _, labels, _ in rows], float)

    def chosen(keep):
        out = set()
        for k in range(targets.shape[1]):
            y, scored = targets[keep][:, k], []
            for j, w in enumerate(vocabulary):
                n, n1 = x[keep][:, j].sum(), (x[keep][:, j] * y).sum()
                if n >= least:
                    a, b = n1 + 0.5, n - n1 + 0.5
                    odds = np.log(a / (y.sum() - a + 1)) - np.log(b / (len(y) - y.sum() - b + 1))
                    scored.append((-round(abs(odds / np.sqrt(1 / a + 1 / b)), 12), w))
            out |= {w for _, w in sorted(scored)[:words_per_category]}
        return np.array([w in out for w in vocabulary], float)

    def fit(features, y, mask):
        w = np.zeros(features.shape[1] + 1)
        free = np.concatenate([mask, np.ones(len(w) - len(mask))])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 151):
            error = (toxicity.logistic(features @ w[:-1] + w[-1]) - y) / max(1, len(y))
            grad = np.append(features.T @ error, error.sum()) * free + 1e-4 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return w

    asked = np.array([[w in text for w in vocabulary]], float)
    features, out, everything = x, [], np.ones(len(rows), bool)
    for k in range(targets.shape[1]):
        y = targets[:, k]
        w = fit(features, y, chosen(everything))
        out.append(float(toxicity.logistic(asked @ w[:-1] + w[-1])[0]))
        unseen = np.zeros(len(y))
        for f in range(folds):
            inside = fold == f
            own = fit(features[~inside], y[~inside], chosen(~inside))
            unseen[inside] = toxicity.logistic(features[inside] @ own[:-1] + own[-1])
        features = np.column_stack([features, toxicity.logits(unseen)])
        asked = np.column_stack([asked, toxicity.logits(np.array([out[-1]]))])
    return out


def test_toxicity_against_brute_force(spark):
    """Words are ranked within folds; repeated rows, ties by word, clashing names, a long text."""
    rng = random.Random(22)
    rows = []
    for i in range(120):
        low, toxic = int(rng.random() < 0.4), int(rng.random() < 0.3)
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "tempor"]) for _ in range(4)] + ["junk"] * (low and rng.random() < 0.8) + ["nasty"] * (toxic and rng.random() < 0.8) + [f"x{rng.randrange(30)}"]
        rows.append((i, " ".join(words), low, toxic))
    rows += rows[:2]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows[:120]] + [(300, None, 0.1), (301, "nasty lorem " * 15_000, 0.1)], "doc_id long, text string, p_low double")
    labels = spark.createDataFrame([(i, low, toxic) for i, _, low, toxic in rows] + [(5, None, 1), (999, 1, 1)], "doc_id long, low int, toxic int")
    folds = {r.doc_id: r.f for r in docs.select("doc_id", toxicity.F.pmod(toxicity.F.xxhash64(toxicity.F.lit("fold"), "text"), toxicity.F.lit(3)).alias("f")).collect()}
    texts = {i: t for i, t, _, _ in rows} | {300: "", 301: "nasty lorem"}
    chain = toxicity.fit(docs, labels, ["low", "toxic"], words_per_category=4, least_rows=3, folds=3)
    taught = sorted((({w for c in t.split() for w in language.words_of(c)}, (low, toxic), folds[i]) for i, t, low, toxic in rows), key=lambda r: r[2])
    got = collected(toxicity.classify(docs, chain))
    for i in (0, 3, 17, 300, 301):
        want = brute_chain(taught, 3, 4, 3, {w for c in texts[i].split() for w in language.words_of(c)})
        assert (got[i]["p_low"], got[i]["p_toxic"]) == (pytest.approx(want[0], rel=1e-6), pytest.approx(want[1], rel=1e-6)), i
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels, ["low", "low"])


def symbols_of(text):
    return "\x02" + " ".join((text or "").split()) + "\x03"


def brute_kneser_ney(texts, order):
    grams = defaultdict(int)
    for t in texts:
        if t is not None:
            s = symbols_of(t)
            for i in range(1, len(s)):
                grams[s[max(0, i - order + 1) : i + 1]] += 1
    counts = {order: {g: n for g, n in grams.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        low = defaultdict(int)
        for g in counts[k + 1]:
            low[g[1:]] += 1
        for g, n in grams.items():
            if len(g) == k:
                low[g] += n
        counts[k] = dict(low)

    def discount(table):
        n = [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]

    d = {k: discount(t) for k, t in counts.items()}
    cut = lambda k, n: d[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        table = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if k == 1:
            total = sum(table.values())
            base = sum(cut(1, n) for n in table.values()) / total / (len(table) + 1)
            return (table[g] - cut(1, table[g])) / total + base if g in table else base
        if not table:
            return p(g[1:])
        total = sum(table.values())
        return max(0, table.get(g, 0) - (cut(k, table[g]) if g in table else 0)) / total + sum(cut(k, n) for n in table.values()) / total * p(g[1:])

    def perplexity(text):
        s = symbols_of(text)
        return float(np.exp(-np.mean([np.log(p(s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s))]))) if len(s) > 2 else None

    return perplexity


QUALITY_TEXTS = ["banana bandana  anna", "nab ban bananas, and", "an banana nab", "and\tand bad dab", None, "", "zzq !!", "banana banana", "nab banana an", " ", "a" * 9000]


@pytest.mark.parametrize(("block", "order"), [(64_000_000, 3), (20, 4), (20, 2)])
def test_quality_perplexity(spark, monkeypatch, block, order):
    """One block of texts, and many; repeated rows have a result each."""
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(QUALITY_TEXTS)] + [(0, QUALITY_TEXTS[0], "x")], "doc_id long, text string, lang string")
    weights = quality.train(quality.gram_counts(table.where("doc_id < 5 and text is not null").limit(9).dropDuplicates(["doc_id"]), order, 1), order)
    got = quality.perplexities(table, weights, order, 1).collect()
    brute = brute_kneser_ney(QUALITY_TEXTS[:4], order)
    assert sorted(r.doc_id for r in got) == [0, *range(len(QUALITY_TEXTS))]
    for r in got:
        want = brute(QUALITY_TEXTS[r.doc_id])
        assert r.perplexity == (None if want is None else pytest.approx(want, rel=1e-5)), r.doc_id


def test_texts_are_dealt_out_compressed(monkeypatch):
    """Every row comes back in its block, whole and in order, from far fewer bytes."""
    import pyarrow as pa

    monkeypatch.setattr(quality, "RUN_BYTES", 20_000)
    rng = random.Random(63)
    words = ["".join(rng.choice("abcdefgh\u00e9") for _ in range(6)) for _ in range(500)]
    rows = [{"doc_id": i // 2, "lang": rng.choice(["x", None]), "text": " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 50, 2000]))), "m": rng.randrange(2), "block": rng.randrange(3)} for i in range(200)]
    kind = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string()), ("m", pa.int32()), ("block", pa.int32())])
    batch = pa.RecordBatch.from_pylist(rows, kind)
    out = pa.Table.from_batches(list(quality.packed(iter([batch.slice(0, 90), batch.slice(90, 0), batch.slice(90)]))), quality.PACKED)
    for m in range(2):
        for block in range(3):
            mine = [r for r in out.to_pylist() if (r["m"], r["block"]) == (m, block)]
            got = [r for part in quality.unpacked(pa.chunked_array([[r["packed"] for r in mine]], pa.binary())) for r in part.to_pylist()]
            assert got == [{k: r[k] for k in ("doc_id", "lang", "text")} for r in rows if (r["m"], r["block"]) == (m, block)]
    assert sum(len(r["packed"]) for r in out.to_pylist()) < 0.6 * sum(len(r["text"].encode()) for r in rows)


def test_texts_are_dealt_out_small():
    """Runs of texts take at least a twelfth less than at the library's own level of compression."""
    import pyarrow as pa

    rng = np.random.default_rng(65)
    words = np.array(["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 10))) for _ in range(20_000)])
    phrases = np.array([" ".join(rng.choice(words, rng.integers(2, 6))) for _ in range(2_000)])
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.7 else rng.choice(words) for _ in range(120)) for _ in range(600)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(["x"] * 600), pa.array(texts), pa.array([0] * 600, pa.int32()), pa.array([0] * 600, pa.int32())], ["doc_id", "lang", "text", "m", "block"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    got = sum(len(r) for out in quality.packed(iter([rows])) for r in out.column(2).to_pylist())
    assert got <= 11 / 12 * sink.getvalue().size


def test_quality_against_brute_force(spark):
    """Held-out folds, thresholds by language with ties, null languages, and what is kept."""
    rng = random.Random(9)
    letters = {"en": "abcde", None: "xyzuv", "fr": "mnopq"}
    rows = []
    for i in range(90):
        lang = ["en", None, "fr"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))), lang))
    rows += [(200 + i, t, "en") for i, t in enumerate(QUALITY_TEXTS)] + [(300, "abc abc", "new"), (301, "%% ## @@", "new"), rows[3], rows[3], rows[8]]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, perplexity int")
    trusted = table.where("doc_id < 60").select("doc_id", "text")
    folds = {r.doc_id: r.f for r in table.select("doc_id", quality.fold_of(quality.F.coalesce("text", quality.F.lit("")), 2).alias("f")).collect()}
    models = [brute_kneser_ney([t for i, t, _ in rows if i < 60 and folds[i] != m], 3) for m in (0, 1)]
    value = {i: models[folds[i]](t) for i, t, _ in rows}
    known = defaultdict(list)
    for i, _, lang in rows:
        if i < 60 and value[i] is not None:
            known[lang].append(value[i])
            known["all of them"].append(value[i])
    limit = {k: sorted(v)[-(-9 * len(v) // 10) - 1] for k, v in known.items()}
    got = quality.classify(table, trusted, order=3, quantile=0.9).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    for r in got:
        threshold = limit.get(r.lang, limit["all of them"])
        assert r.threshold == pytest.approx(threshold, rel=1e-5)
        assert r.perplexity == (None if value[r.doc_id] is None else pytest.approx(value[r.doc_id], rel=1e-5))
        if value[r.doc_id] is None or abs(value[r.doc_id] - threshold) > 1e-4 * threshold:
            assert r.kept == (value[r.doc_id] is not None and value[r.doc_id] <= threshold)
    assert not any(r.kept for r in quality.classify(table, empty(trusted)).collect())
    assert quality.classify(empty(table), trusted).count() == 0


def test_pii(spark):
    key = b"k"
    text = "card 4111 1111 1111 1111 or 4111111111111111, not 1234567890123456; born 1999-12-31, 31.12.1999; 10.0.0.1 and 300.1.1.1; a.b@mail.example.com +1 (017) 555-7713 IBAN DE89 3704 0044 0532 0130 00 SSN 123-45-6789 token = \"04dbebab91ab85687d33eeaaf9ac6\" v1.2"
    table = spark.createDataFrame([(0, text, 1), (1, None, 2), (2, "", 3), (3, "nothing here, version 3.", 4), (4, "again 4111-1111-1111-1111", 5)], "doc_id long, text string, `odd name` int")
    got = {r.row.doc_id: r for r in pii.pseudonymize(table, key).collect()}
    new = got[0].private.text
    for kept in ("1234567890123456", "300.1.1.1", "v1.2", "@mail.example.com", "+1 ("):
        assert kept in new
    for gone in ("4111", "1999", "10.0.0.1", "a.b@", "555-7713", "DE89", "123-45-6789", "04dbebab91"):
        assert gone not in new
    assert sorted(s.kind for s in got[0].private.spans) == sorted(["card", "card", "date", "date", "ip", "email", "phone", "iban", "ssn", "secret"])
    card = re.search(r"card ([\d ]{19})", new)[1].replace(" ", "")
    assert card in new.replace(" ", "", 0) and pii.luhn_digit(card[:-1]) == card[-1]
    assert got[4].private.text == "again " + "-".join(card[i : i + 4] for i in range(0, 16, 4))  # the same value stays linked
    assert got[1].private.text is None and got[2].private.text == "" and got[3].private.text == "nothing here, version 3."
    assert got[0].row["odd name"] == 1
    f = pii.Feistel(key)
    assert sorted(f.permuted(i, 777, "t") for i in range(777)) == list(range(777))
    assert pii.Feistel(b"other").text("4111", "card") != f.text("4111", "card") or pii.Feistel(b"other").text("9999", "x") != f.text("9999", "x")


def test_pii_links_a_value_in_every_layout(spark):
    f = pii.Pseudonyms(b"k")
    digits = lambda x: re.sub(r"\D", "", x)
    for layouts in (["+49 30 12345678", "+493012345678", "+49-30-1234-5678", "+49 (30) 12345678"], ["+1 (212) 555-0142", "(212) 555-0142", "212-555-0142", "+12125550142", "+1 212.555.0142"], ["+352 27 12 34 56", "+35227123456"]):
        found = [f.spans(x) for x in layouts]
        assert all(len(x) == 1 and x[0][2] == "phone" for x in found), layouts
        new = {digits(x[0][3]).removeprefix("1") if layouts[0].startswith("+1 ") and len(digits(x[0][3])) == 11 else digits(x[0][3]) for x in found}
        assert len(new) == 1 and not new & set(map(digits, layouts)), layouts
    assert digits(f.phone("+49 (0)30 12345678")) == "490" + digits(f.phone("+49 30 12345678"))[2:]
    assert f.email("Ann.B@x.org").lower() == f.email("ann.b@X.org").lower() and f.email("Ann.B@x.org")[0].isupper()
    assert f.date("1999-12-31").split("-") == f.date("31.12.1999").split(".")[::-1]


def brute_pseudonyms(text):
    """Plain replacement of the forms that the texts of the next test hold."""
    f = pii.Pseudonyms(b"k")
    text = re.sub(r"(?<=mail )[^\s,]+", lambda m: f.email(m[0]), text)
    text = re.sub(r"(?<=card )\d{16}", lambda m: f.card(m[0]), text)
    return re.sub(r"(?<=on )\d{4}-\d\d-\d\d", lambda m: f.date(m[0]), text)


def test_pii_against_brute_force(spark):
    """Long texts, repeated rows, clashing names and an empty table."""
    rng = random.Random(11)
    rows = []
    for i in range(30):
        parts = [rng.choice(["plain words", "mail a%d.x@mail.example.org" % (i % 5), "card 4111111111111111", "card 5500005555555559", "on 2001-0%d-17" % rng.randint(1, 9)]) for _ in range(rng.choice([1, 5, 4000]))]
        rows.append((i // 2, ", ".join(parts), "row"))
    table = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, private string")
    got = sorted((r.row.doc_id, r.row.text, r.private.text) for r in pii.pseudonymize(table, b"k").collect())
    assert got == sorted((i, t, brute_pseudonyms(t)) for i, t, _ in rows + rows[:3])
    assert pii.pseudonymize(empty(table), b"k").count() == 0
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32


@pytest.mark.parametrize(
    ("text", "private"),
    [
        ("pay ES91 2100 0418 4502 0005 1332 for it", ["ES91 2100 0418 4502 0005 1332"]),
        ("AT611904300234573201 is his, SE4550000000058398257466 from us", ["AT611904300234573201", "SE4550000000058398257466"]),
        ("BE68 5390 0754 7034 FROM US", ["BE68 5390 0754 7034"]),
        ("card 4111 1111 1111 1111 123 ok", ["4111 1111 1111 1111"]),
        ("card 4111-1111-1111-1111 12/25", ["4111-1111-1111-1111"]),
        ("card 4111111111111111-123", ["4111111111111111"]),
        ("part 4111-1111-1111-1111-123", []),
        ("on 12/25/2024 and 25/12/2024, not 13/32/2024", ["12/25/2024", "25/12/2024"]),
    ],
)
def test_pii_ends_where_the_value_does(text, private):
    found = pii.Pseudonyms(b"k").spans(text)
    assert [text[start:end] for start, end, _, _ in found] == private
    assert all(len(new) == end - start and new != text[start:end] for start, end, _, new in found)


def test_repeated_rows_and_clashing_names(spark):
    """Each row has a result of its own where the operator's docstring says so."""
    from tokenizers import Tokenizer

    rows = [(1, "one two three four five six", "t")] * 3 + [(2, "one two three four five six", "t"), (3, None, "t"), (3, None, "t"), (4, "x " * 30_000, "t")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, n_tokens string, fp int, id int")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((d, len(library.encode(t or "", add_special_tokens=False))) for d, t, _ in rows)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1)] * 3 + [(2, 1), (3, 3), (3, 3), (4, 4)]
    assert simhash.near_duplicates(empty(docs)).count() == 0 and simhash.similar_documents(empty(docs)).count() == 0
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()} == {(1, 1), (2, 1)}
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    got = decontamination.decontaminate(docs, items).collect()  # rows that share a doc_id are counted together
    assert {(r.doc_id, r.n_items) for r in got} == {(1, 1), (2, 1), (3, 0), (4, 0)}
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 2 + [(2, [2.0, 4.0], 0), (5, None, 0), (5, None, 0)], "vec_id long, embedding array<double>, h1 int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (5, 0, 5), (5, 0, 5)]


def test_simhash_of_a_star_of_near_fingerprints(spark, monkeypatch):
    """A chain and a ball of fingerprints, whatever the segments; their pairs are never all listed."""
    rng = random.Random(41)
    base = rng.getrandbits(64)
    prints = [base ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)]
    for _ in range(20):
        prints.append(prints[-1] ^ sum(1 << x for x in rng.sample(range(64), 4)))
    prints += [rng.getrandbits(64) for _ in range(20)]
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: table)
    want = components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    for segments in (2, 3, None):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table.withColumn("text", simhash.F.lit("")), segments=segments).collect()}
        assert got == dict(enumerate(want)), segments
    assert simhash.fewest_steps(1000, 4) >= simhash.fewest_steps(10**10, 4) == 2
