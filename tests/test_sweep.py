"""Many evaluation times in one pass, and joins by time, against recomputation from scratch."""

import random

from pyspark.sql import functions as F

from tests.builders import US, obs, observations
from veritrail.functions.skew import as_of_join, running_sums, time_chunks
from veritrail.operators import integrity, structure, sweep

HOUR = 3600


def random_observations(seed, n, payments):
    rng = random.Random(seed)
    values = {"PAYMENT_STATUS": ["authorized", "captured", "failed"], "PAYMENT_AMOUNT": ["100", "200", "300"], "PAYMENT_CURRENCY": ["INR", "USD"],
              "PAYMENT_EVENT": ["order.paid", "payment.failed"], "PAYMENT_METHOD": ["upi", " "]}
    rows = []
    for i in range(n):
        kind = rng.choice(list(values))
        at = rng.choice([0, 1, 2.5, HOUR, 5 * HOUR, 30 * HOUR]) + rng.choice([0, 0.5, 7 * HOUR])
        until = rng.choice([None, None, at, at + 1, at + 5 * HOUR, at + 60 * HOUR])
        rows.append(obs(i, kind, rng.choice(values[kind]), rng.randrange(8), rng.choice(["PROVIDER_WEBHOOK", "PROVIDER_API", "INTERNAL_SYSTEM", "LEDGER", "MAIL"]),
                        at, rng.choice(payments), until_s=until))
    return rows


def test_sweep_equals_recomputation_at_every_time(spark):
    rows = observations(spark, random_observations(5, 160, ["p1", "p1", "p1", "p2", "p3"]))
    scoped = structure.structure_scope(rows)
    times = [US + int(s * 1_000_000) for s in (-1, 0, 1, 2.5, 3, HOUR, 4 * HOUR, 5 * HOUR + 1, 12 * HOUR, 31 * HOUR, 80 * HOUR, 900 * HOUR)]
    points = scoped.select("payment_id").distinct().select("payment_id", F.explode(F.array(*[F.lit(t) for t in times])).alias("eval_us"))
    got = sweep.dimensions_at(scoped, rows, points)
    seen = rows.withColumn("eval_us", F.explode(F.array(*[F.lit(t) for t in times]))).where("observed_us <= eval_us")
    claims = structure.payment_claims(structure.build_claims(structure.claim_rows(seen)))
    want = integrity.dimensions(scoped, claims, times).where("total_count > 0")
    columns = sorted(set(want.columns) & set(got.columns))
    assert {"stale_count", "source_count", "state_conflicts", "multi_source_claims", "consistency"} <= set(columns)
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert key(got) == key(want) and len(key(got)) > 25


def test_own_times_in_place_and_spread_are_the_same(spark, monkeypatch):
    rows = random_observations(9, 170, ["p1", "p1", "p2", "p3", "p4"])
    rows = [(*r[:6], None, *r[7:10], None, *r[11:]) if i % 11 == 0 else r for i, r in enumerate(rows)] + rows[:5]  # no source, no event, repeated
    df = observations(spark, [*rows, obs(900, "PAYMENT_STATUS", "failed", None, "MAIL", 3, "p5")])
    scoped = structure.structure_scope(df)
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    in_place, spread = key(sweep.dimensions_own(scoped, False)), key(sweep.dimensions_own(scoped, True))
    times = [r[0] for r in scoped.select("observed_us").distinct().collect()]
    seen = df.withColumn("eval_us", F.explode(F.array(*[F.lit(t) for t in times]))).where("observed_us <= eval_us")
    want = integrity.dimensions(scoped, structure.payment_claims(structure.build_claims(structure.claim_rows(seen))), times)
    want = want.join(scoped.selectExpr("payment_id", "observed_us AS eval_us").distinct(), ["payment_id", "eval_us"])
    names = sorted(sweep.dimensions_own(scoped, False).columns)
    assert in_place == spread == sorted(map(tuple, want.select(names).collect()), key=str) and len(in_place) > 25
    monkeypatch.setattr(sweep, "MANY", 40)  # p1 is spread, the others are not
    assert key(sweep.by_size(scoped, lambda part, spread: sweep.dimensions_own(part(scoped), spread))) == in_place


def test_observations_of_own_times_are_moved_once(spark):
    scoped = structure.structure_scope(observations(spark, random_observations(1, 20, ["p1", "p2"])))
    plan = sweep.counters_in_place(scoped)._jdf.queryExecution().executedPlan().toString()
    # the observations, and first times of statuses by value and by payment
    assert plan.count("Exchange hashpartitioning") == 3, plan


def test_as_of_join_of_small_keys(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4), ("a", None, 5)], "k string, t long, i long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), (None, 1, "n")], "k string, s long, v string")
    for spread in (False, True):
        got = as_of_join(left, right, ["k"], "t", "s", ["v"], spread).collect()
        assert sorted(map(tuple, got)) == [("a", 1, 2, None), ("a", 5, 1, "y"), ("b", 9, 3, None)], spread


def test_running_sums_over_chunks(spark):
    rng = random.Random(2)
    rows = sorted({("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", US + rng.randrange(10**11)) for _ in range(600)})
    rows = [(k, t, rng.randrange(-5, 9)) for k, t in rows]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = {(r["k"], r["t"]): r["v"] for r in running_sums(df, ["k"], ["t"], time_chunks(F.col("t")), ["v"]).collect()}
    assert got == {(k, t): sum(v for j, s, v in rows if j == k and s <= t) for k, t, _ in rows}


def test_as_of_join_carries_the_latest_row_forward(spark):
    rng = random.Random(3)
    time = lambda: US + rng.choice([rng.randrange(10), rng.randrange(10**7), rng.randrange(10**11)])
    key = lambda: "hot" if rng.random() < 0.8 else f"k{rng.randrange(6)}"
    left = [(key(), time(), i) for i in range(400)]
    right = [(key(), time(), rng.choice([None, "a", "b"]), i) for i in range(300)]
    right += [(k, t, "tie", 1000 + i) for i, (k, t, _, _) in enumerate(right[:60])] + [(k, t, "same", 2000 + i) for i, (k, t, _) in enumerate(left[:60])]
    got = as_of_join(
        spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, s long, v string, j long"), ["k"], "t", "s", ["j", "v"])
    want = []
    for k, t, i in left:
        found = max(((s, j, v) for r, s, v, j in right if r == k and s <= t), default=(None, None, None), key=lambda x: x[:2])
        want.append((k, t, i, found[1], found[2]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
