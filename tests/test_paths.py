"""Paths between given nodes against a plain search."""

import random

from veritrail.operators.graph import path_between


def brute(edges, payment, source, target, depth):
    near = {}
    for p, a, b in edges:
        if p == payment:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    best = {source: source}
    front = dict(best)
    for hop in range(depth + 1):
        if target in best:
            return hop if target in front else 0, best[target]
        new = {}
        for n, path in front.items():
            for m in near.get(n, ()):
                if m not in best:
                    new[m] = min(new.get(m, "~"), f"{path} > {m}")
        best |= new
        front = new
    return None, None


def test_paths_between_given_nodes(spark):
    rng = random.Random(7)
    edges = [(f"p{rng.randrange(3)}", f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(110)]
    pairs = [(f"p{rng.randrange(3)}", f"n{rng.randrange(42):02d}", f"n{rng.randrange(42):02d}") for _ in range(80)]
    df = spark.createDataFrame(edges, "payment_id string, src string, dst string")
    for depth in (1, 4, 5):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in path_between(df, spark.createDataFrame(pairs, "payment_id string, source string, target string"), depth).collect()}
        assert set(got) == set(pairs)
        for pair, (length, path, exhausted) in got.items():
            assert (length, path) == brute(edges, *pair, depth), pair
            if exhausted:  # final, whatever the depth
                assert path is None and brute(edges, *pair, 60) == (None, None)


def test_a_search_that_ends_says_so(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "c", "d"), ("p", "d", "e"), ("p", "e", "f"), ("p", "f", "g")], "payment_id string, src string, dst string")
    pairs = spark.createDataFrame([("p", "a", "c"), ("p", "c", "g"), ("p", "a", "x"), ("p", "a", "a")], "payment_id string, source string, target string")
    got = {r["target"]: tuple(r)[3:] for r in path_between(edges, pairs, 3).collect()}
    assert got == {"c": (None, None, True), "g": (None, None, False), "x": (None, None, True), "a": (0, "a", False)}
