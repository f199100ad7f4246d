import random

import numpy as np

from veritrail.llm import alike
from veritrail.llm.alike import alike_components, keep_first


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def brute(texts):
    """{id: smallest id linked by similarity 0.8 or more}, from all pairs."""
    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if j < i and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 400))]
        for _ in range(10):  # copies, from nearly equal ones to such below 0.8, some with a common passage
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + (passage if rng.random() < 0.3 else [])))
    texts += ["", " ", "a b", "A  b", "a b c", texts[0], texts[0].upper()]
    texts = dict(enumerate(texts))
    want = brute(texts)
    assert 20 < len(set(want.values())) < 110
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in alike_components(docs).collect()} == want
    assert {r["doc_id"] for r in keep_first(docs).collect()} == set(want.values())


def test_large_keys_are_compared_block_by_block(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    line, texts = "all of these words stand in every one of the texts".split(), []
    for _ in range(40):  # texts of a few groups that share a line, with sizes all over
        base = [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(line + copy))
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(alike, "common_shingles", lambda nodes: np.empty(0, np.uint64))  # else the line is in few prefixes
    monkeypatch.setattr(alike, "TILE_SHINGLES", 100)
    got = alike_components(docs, key_rows=8)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(texts)


def test_a_line_in_many_documents(spark):
    rng = random.Random(5)
    line = "permission is granted to use this text in any way"
    texts = {i: line + " " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(25)) for i in range(20_000)}
    texts |= {20_000 + i: texts[i].replace("permission", "Permission") for i in range(0, 20_000, 4000)}
    texts |= {40_000 + i: texts[i] + " more" for i in range(1, 20_000, 4000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in alike_components(docs).collect()}
    assert got == {i: i % 20_000 for i in texts}


def test_pairs_at_the_limit_are_compared_by_whole_hashes(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(304)]  # 300 shingles
    texts = {0: " ".join(base)} | {i: " ".join(base[:304 - i] + [word() for _ in range(i)]) for i in range(1, 60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, seen = brute(texts), []
    once = alike.alike_pairs
    monkeypatch.setattr(alike, "alike_pairs", lambda *a, **b: (seen.append(len(a) > 3), once(*a, **b))[1])
    assert {r["doc_id"]: r["component_id"] for r in alike_components(docs).collect()} == want
    assert any(seen)


def test_common_shingles_are_found_in_bounded_counters(spark, monkeypatch):
    monkeypatch.setattr(alike, "COMMON_SHARE", 16)
    rng = random.Random(6)
    rows = [([1, 2][: 1 + i % 2] + [rng.randrange(10**9) for _ in range(3)],) for i in range(2000)]
    got = alike.common_shingles(spark.createDataFrame(rows, "first array<long>").repartition(7))
    assert {1, 2} <= set(got.tolist()) and len(got) <= 32


def test_stage_keeps_one_of_alike_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    got = corpus_pipeline.keep_one_of_each(spark, docs, "/root/testdata/sf0.01")
    assert {r["doc_id"] for r in got.collect()} == set(want.values())


def test_odd_rows(odd_docs, no_docs):
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 2, 4, 6, 7, 8, 9, 10]
    assert keep_first(no_docs).count() == 0
