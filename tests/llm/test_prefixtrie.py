import hashlib
import math
import random
import zlib

import pytest

from veritrail.llm import prefixtrie
from veritrail.llm.prefixtrie import prefix_trie
from veritrail.llm.spillqueue import SpillingQueue

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows of the trie from (conv_id, turn, role, text) whose turns differ."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    done, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below = [done[k] for k in kids.get(node, [])]
        done[node] = (sum(x[0] for x in below) or 1, mine + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), *done[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return sorted(map(tuple, prefix_trie(df, **how).select(*COLUMNS).collect()), key=lambda r: r[:2])


def made_up(rng, convs, long=0):
    rows = []
    for c in range(convs):
        words = ["a", "b", "é", None]
        turns = [("user" if i % 2 else rng.choice(["user", None]), rng.choice(words) if rng.random() < 0.9 else f"own {c}") for i in range(rng.randrange(1, 12))]
        if rows and rng.random() < 0.3:  # a copy of an earlier conversation, or of its start
            other = rng.randrange(c)
            turns = [r[2:] for r in rows if r[0] == other][:rng.randrange(1, 14)]
        rows += [(c, 3 * i if i else None, *t) for i, t in enumerate(turns)]
    if long:
        rows += [(convs + 5, i, "user", f"t{i % 7}") for i in range(long)]
        rows += [(convs + 6, i, "user", f"t{i % 7}") for i in range(long - 40)]
    return rows


@pytest.mark.parametrize("shard_convs,queue_rows", [(1024, 1 << 18), (3, 2), (1, 1)])
def test_trie_is_that_of_all_prefixes(spark, shard_convs, queue_rows, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SHARDS", 1 << 30)
    rows = made_up(random.Random(5), 90)
    assert trie(spark, rows, shard_convs=shard_convs, queue_rows=queue_rows) == brute(rows)


def test_long_conversations_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 16)
    monkeypatch.setattr(prefixtrie, "SHARDS", 1 << 30)
    rows = made_up(random.Random(6), 20, long=300)
    assert trie(spark, rows, shard_convs=2, queue_rows=4) == brute(rows)


def test_hot_parents_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "HOT_ROWS", 3)
    rows = [(c, t, "user", "same" if t < 9 else f"{c}") for c in range(60) for t in range(10)]
    assert trie(spark, rows) == brute(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = sorted(map(tuple, prefix_trie(df).select(*COLUMNS).collect()), key=lambda r: r[:2])
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "in no conversation"), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, None, None, None), (0, None, None, ""), (1, 5, "", "x" * 100_000),
        (7, None, None, None), (2**50 + 1, 1, "user", "a"), (-3, 1, "user", "a"), (12, 0, "user", "ü🙂\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("c", "d", "m", "n", "k1", "pos", "chunk", "part", "at", "bytes"):
        df = df.withColumn(name, df["role"])
    got = sorted(map(tuple, prefix_trie(df).select(*COLUMNS).collect()), key=lambda r: r[:2])
    # repeated rows are turns of their own: give them numbers of their own
    apart = [(c, -9 + i if t is None else 10 * t + i, r, x) for i, (c, t, r, x) in enumerate(rows)]
    assert got == brute(apart)
    assert prefix_trie(df.where("false")).count() == 0 and prefix_trie(df).columns == COLUMNS


def test_queue_spills_and_stays_sorted():
    rng = random.Random(2)
    for limit in (1, 2, 7, 1000):
        queue, held = SpillingQueue(2, limit), []
        for _ in range(3000):
            if held and rng.random() < 0.45:
                assert queue.least() == min(held)
                row = queue.pop()
                held.remove(row)
            else:
                row = (rng.randrange(500), rng.randrange(-9, 9))
                queue.push(row)
                held.append(row)
        while held:
            row = queue.pop()
            assert row == min(held)
            held.remove(row)
        assert not queue and queue.least() is None
