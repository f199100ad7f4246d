import random
import re

import numpy as np
import pytest
import xxhash

from veritrail.llm.components import components
from veritrail.llm.simhash import fingerprint, keep_first, near_duplicates, near_edges, segments


def slow_fingerprint(text, words=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "A b", "one two three four", "É è\u00a0x A\x0bB\x1cC d e f", "to be or not to be " * 40, "中文 字 A-Z b"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_hash_is_the_engines(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert row["h"] & (2**64 - 1) == fingerprint("one two three four")


def brute_components(fps, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("key_rows", [4096, 7, 1])
@pytest.mark.parametrize("distance", [4, 3, 0])
def test_links_are_those_of_all_pairs(spark, key_rows, distance):
    rng = random.Random(distance)
    centre = rng.getrandbits(64)
    fps = {0, 2**64 - 1, centre} | {rng.getrandbits(64) for _ in range(60)}
    for _ in range(250):  # dense groups and chains around some centres
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    root = {r["node"]: r["root"] for r in components(near_edges(nodes, distance, key_rows)).collect()}
    got, want = {}, {}
    for i, x in enumerate(signed):
        got.setdefault(root.get(x, x), set()).add(i)
    for i, r in enumerate(brute_components(fps, distance)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_segments_cover_all_bits():
    for distance in range(8):
        cut = segments(distance)
        assert sum(w for _, w in cut) == 64 and distance // len(cut) <= 1


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(200)]
    edges = spark.createDataFrame([*chain, *hub, (5, 5), (7, 6), (6, 7)], "u long, v long")
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    assert root == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(201)}}
    assert components(edges.where("false")).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    fps = [slow_fingerprint(r["text"]) for r in rows]
    roots = brute_components(fps, 4)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    for r, fp, root in zip(rows, fps, roots, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{fp:016x}", least[root])


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert blank == {2}  # ids 2 (empty), 3 (null) and a null id (white space)
    assert near_duplicates(no_docs).count() == 0
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert ids == [-1, 0, 2, 4, 6, 7, 8, 9, 10]
    assert keep_first(no_docs).count() == 0


def test_large_numbers_of_bits_are_unsigned():
    assert np.bitwise_count(np.array([-1], np.int64).view(np.uint64))[0] == 64
