"""The pipeline on the smallest tables: each stage's decisions against what it was given."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import test_operators as brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from corvane.llm import simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "12 34 !", "en", "s", 7), (10_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(odd).cache()
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    after = {r.doc_id: r for r in docs.collect()}
    assert not {10_000, 10_001, 10_002} & after.keys()
    texts = [before[i].text for i in after]
    assert len(set(texts)) == len(texts)  # no exact copy is left
    assert all(after[i].lang == before[i].lang for i in after)
    assert len(after) > 0.7 * len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def brute_pipeline(rows, items):
    """(doc_id, text) of what the four filtering stages leave, by plain loops over all documents and pairs."""
    kept = []
    taught = [(t, lang) for _, t, lang in rows]
    for doc, text, lang in rows:
        predicted, score = brute.brute_language(taught, text)
        if predicted != "und" and score >= 0.3:
            kept.append((doc, text))
    sets = []
    for _, text in kept:
        words = re.findall("[^\x20\x09-\x0d]+", text.translate(simhash.ASCII_LOWER))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    classes = brute.components(len(kept), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = [row for i, row in enumerate(kept) if classes[i] == i]
    windows = set()
    for text in items:
        words = brute.words8(text)
        windows |= {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
    clean = []
    for doc, text in kept:
        words = brute.words8(text)
        if not any(tuple(words[k : k + 8]) in windows for k in range(len(words) - 7)):
            clean.append((doc, brute.brute_pseudonyms(text)))
    return clean


def test_run_against_brute_force(spark, tmp_path):
    """The whole of run(): languages, copies and near copies in chains, passages of items, private data, odd rows."""
    rng = random.Random(31)
    letters = {"aa": "abcdehi", "bb": "opqrstu"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6)))
    sentence = lambda lang, n: [word(lang) for _ in range(n)]
    items = [" ".join(sentence("aa", 20)) for _ in range(4)] + ["abba", None, ""]
    rows = []
    for i in range(70):
        lang = "aa" if i % 2 else "bb"
        words = sentence(lang, rng.choice([3, 30, 80, 200]))
        if i % 9 == 0:
            words[len(words) // 2 : len(words) // 2] = items[i % 4].split()[3:12]
        if i % 7 == 0:
            words += ["mail", f"ann.{i}@mail.example.org", "card", "4111111111111111", "on", "2001-02-03", "abba"]
        rows.append((i, " ".join(words), lang))
    for i in range(1, 61, 6):  # copies, near copies, and chains of these
        words = rows[i][1].split()
        rows += [(100 + i, rows[i][1], "aa"), (200 + i, " ".join(words + sentence("aa", max(0, len(words) // 40))), "aa"), (300 + i, " ".join(words[: len(words) // 2]), "aa")]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 34 !", None), (403, "12 34 !", "aa"), (404, "abehi " * 9000, None)]
    table = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.set("spark.corvane.pii.key", "k")
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.corvane.pii.key")
    want = brute_pipeline(rows, items)
    assert {r.doc_id for r in got} == {d for d, _ in want} and 20 < len(want) < 80
    assert brute.held_packing(want, got, 4096) <= -(-sum(r.length for r in got) // 4096) + 1


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
