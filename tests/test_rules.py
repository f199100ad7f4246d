"""Rules on small inputs with known answers."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import random

import pytest
from builders import US, event, events, obs, observations
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions.skew import near_sums, prefix_before, previous_value
from veritrail.operators import canonical, conflicts, coverage, defense, evalmetrics, evolution, facts, graph, integrity
from veritrail.operators import relations, reliability, risk, search, structure, trace
from veritrail.sources import landing

HOUR = 3600


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- landing ---------------------------------------------------------------------------------

def test_hmac_matches_library(spark):
    body = '{"event":"payment.captured","id":"é"}'
    want = hmac.new(b"s3cret", body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(body, want), (body, want[::-1]), (body, None)], "body string, signature string")
    assert [r.verified for r in landing.verify_signatures(df, "s3cret").collect()] == [True, False, False]


def test_long_secret_is_hashed_first(spark):
    secret = "x" * 100
    want = hmac.new(secret.encode(), b"b", hashlib.sha256).hexdigest()
    assert spark.range(1).select(E.hmac_sha256(secret, F.lit("b")).alias("h")).first().h == want


def test_bad_json_is_rejected_and_unsupported_dropped(spark):
    good = '{"id":"e1","event":"order.paid","created_at":1700000000,"payload":{"payment":{"entity":{"id":"p"}},"order":{"entity":{"id":"o","amount":99900,"currency":"INR","customer_id":"c"}}}}'
    other = '{"id":"e2","event":"refund.processed","payload":{}}'
    df = spark.createDataFrame([(1, good), (2, other), (3, "{oops")], "event_id bigint, body string").withColumn(
        "received_at", F.timestamp_seconds(F.lit(1700000001)))
    assert {r.event_id: r.rejected for r in landing.landing(df).collect()} == {1: False, 2: False, 3: True}
    n = rows(landing.normalize_bodies(df))
    assert len(n) == 1 and (n[0]["entity_id"], n[0]["amount_minor"], n[0]["customer_id"]) == ("o", 99900, "c")


def test_append_if_absent_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id bigint, v string")
    path = str(tmp_path / "t")
    landing.append_if_absent(df, path, ["id"])
    landing.append_if_absent(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_append_looks_only_where_the_batch_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, day string")
    path = str(tmp_path / "t")
    landing.append_if_absent(df, path, ["id"], ["day"])
    landing.append_if_absent(spark.createDataFrame([(2, "b"), (3, "b"), (4, "c")], df.schema), path, ["id"], ["day"])
    assert sorted((r.id, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "b"), (4, "c")]


# --- scope, replay, risk ---------------------------------------------------------------------------

def test_order_evidence_is_listed_once(spark):
    rows = [obs(1), obs(2, until_s=-1), obs(3, at_s=99)] + [(4, "ORDER_STATUS", "order", "o1", *obs(4)[4:])]
    data = observations(spark, rows)
    payments = spark.createDataFrame([("p1", "o1"), ("p2", "o1"), ("p3", None)], "payment_id string, order_id string")
    got = {r.evidence_id: (r.payment_id, r.inclusion_status, r.reason, r.payments) for r in search.evidence_scope(data, payments, US + 10_000_000).collect()}
    assert got == {1: ("p1", "INCLUDED", None, 1), 2: ("p1", "EXCLUDED", "INVALIDATED", 1), 3: ("p1", "EXCLUDED", "OBSERVED_AFTER_EVALUATION_TIME", 1),
                   4: (None, "EXCLUDED", "OUTSIDE_EVALUATION_SCOPE", 2)}
    assert {(r.payment_id, r.evidence_id) for r in search.order_candidates(data, payments).collect()} == {("p1", 4), ("p2", 4)}


def test_replay_finds_changed_lost_and_foreign_records(spark):
    cols = "payment_id string, eval_us bigint, methodology_version string, overall_status string, freshness string, source string, independence string, consistency string"
    good = ("STRONG", "CURRENT", "PRIMARY", "MULTI", "CONSISTENT")
    recorded = spark.createDataFrame([("same", 1, "EIS_V1", *good), ("edited", 1, "EIS_V1", "WEAK", *good[1:]), ("old", 1, "EIS_V0", *good), ("lost", 1, "EIS_V1", *good)], cols)
    again = spark.createDataFrame([(p, 1, "EIS_V1", *good) for p in ("same", "edited", "old")], cols)
    got = {r.payment_id: (r.verification, r.differing) for r in evolution.replay_verify(recorded, again).collect()}
    assert got["same"] == ("MATCH", "") and got["edited"] == ("REPLAY_MISMATCH", "overall_status")
    assert got["old"][0] == "METHODOLOGY_UNAVAILABLE" and got["lost"][0] == "INCOMPLETE"


@pytest.mark.parametrize("score, status", [(100, "STRONG"), (76, "STRONG"), (75.9, "ADEQUATE"), (51, "ADEQUATE"), (26, "WEAK"), (25.9, "CRITICAL"), (0, "CRITICAL")])
def test_dimension_status(spark, score, status):
    assert spark.range(1).select(risk.dimension_status(F.lit(float(score)))).first()[0] == status


# --- fold ----------------------------------------------------------------------------------------

def advance(state, rows):
    """Apply (rank, status, time) events, in arrival order, to one payment's state."""
    rank, status, captured, last, count = state
    for r, s, t in rows:
        if r > rank or (r == rank and t > last):
            rank, status = r, s
            captured = captured or s == "captured"
        last = max(last, t)
        count += 1
    return rank, status, captured, last, count


def sequential(evs):
    rank = {"authorized": 2, "captured": 3, "failed": 3, "paid": 3}
    status = {"payment.authorized": "authorized", "payment.captured": "captured", "payment.failed": "failed", "order.paid": "paid"}
    out = {}
    for e in sorted(evs, key=lambda e: (e[12], e[0])):
        s, t = status[e[3]], e[11]
        out[e[4]] = advance(out.get(e[4], (-1, "unknown", False, t.replace(year=1900), 0)), [(rank[s], s, t)])
    return {p: v[1:3] for p, v in out.items()}


def test_fold_equals_sequential_policy_for_any_arrival_order(spark):
    rnd = random.Random(7)
    kinds = ["payment.authorized", "payment.captured", "payment.failed", "order.paid"]
    evs = [event(i, rnd.choice(kinds), f"p{i % 60}", rnd.randrange(0, 40000), rnd.randrange(0, 40000)) for i in range(600)]
    got = {r.payment_id: (r.status, r.captured) for r in canonical.fold_payments(canonical.normalize_events(events(spark, evs))).collect()}
    assert got == sequential(evs)


def test_fold_fills_missing_values_and_keeps_captured(spark):
    evs = [event(1, "payment.captured", seen_s=0, amount=0, order="", method=None), event(2, "payment.failed", seen_s=5, amount=49900, order="o9"),
           event(3, "payment.authorized", seen_s=9, amount=1)]
    r = rows(canonical.fold_payments(canonical.normalize_events(events(spark, evs))))[0]
    assert (r["status"], r["captured"], r["amount_minor"], r["order_id"], r["method"]) == ("failed", True, 49900, "o9", "upi")


def test_fold_zero_amount_only(spark):
    r = rows(canonical.fold_payments(canonical.normalize_events(events(spark, [event(1, amount=0), event(2, seen_s=1, amount=None)]))))[0]
    assert r["amount_minor"] == 0


def test_minimal_event_yields_only_present_fields(spark):
    n = canonical.normalize_events(events(spark, [event(1, "payment.authorized", amount=None, order=None, currency=None, method=None)]))
    assert sorted(r.evidence_type for r in canonical.extract_evidence(n).collect()) == ["PAYMENT_EVENT", "PAYMENT_STATUS"]


# --- skew helpers against brute force --------------------------------------------------------------

def test_chunked_windows_match_brute_force(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(3)}", rnd.randrange(0, 500), i, rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t bigint, i bigint, v bigint")
    got = {(r.i): r.m for r in prefix_before(df, ["k"], ["t", "i"], [F.floor(F.col("t") / 10), F.floor(F.col("t") / 50)], F.col("v"), "max", "m").collect()}
    prev = {(r.i): r.p for r in previous_value(df, ["k"], ["t", "i"], [F.floor(F.col("t") / 10), F.floor(F.col("t") / 50)], F.col("v"), "p").collect()}
    slots = df.groupBy("k", "t").agg(F.count("*").alias("n"))
    near = {(r.k, r.t): (r.before, r.around) for r in near_sums(slots, ["k"], "t", 20, "n").collect()}
    for k, t, i, _v in data:
        before = sorted((b, j, w) for kk, b, j, w in data if kk == k and (b, j) < (t, i))
        assert got[i] == (max(w for *_, w in before) if before else None)
        assert prev[i] == (before[-1][2] if before else None)
        assert near[(k, t)] == (sum(kk == k and t - 20 <= b <= t for kk, b, *_ in data), sum(kk == k and abs(b - t) <= 20 for kk, b, *_ in data))


# --- quality -------------------------------------------------------------------------------------

@pytest.mark.parametrize("etype,age,want", [
    ("PAYMENT_STATUS", 4 * HOUR - 1, "CURRENT"), ("PAYMENT_STATUS", 4 * HOUR, "AGING"), ("PAYMENT_STATUS", 48 * HOUR, "STALE"),
    ("PAYMENT_AMOUNT", 7 * 24 * HOUR - 1, "CURRENT"), ("PAYMENT_CURRENCY", 30 * 24 * HOUR, "STALE"), ("PAYMENT_METHOD", 24 * HOUR, "AGING"),
    ("PAYMENT_EVENT", -1, "UNKNOWN")])
def test_freshness_boundaries(spark, etype, age, want):
    df = spark.createDataFrame([(etype, US)], "evidence_type string, observed_us bigint")
    assert df.select(E.freshness_state(F.col("observed_us"), F.lit(US + age * 1_000_000)).alias("s")).first().s == want


@pytest.mark.parametrize("source,etype,authority,directness", [
    ("PROVIDER_WEBHOOK", "PAYMENT_EVENT", "PRIMARY", "DIRECT"), ("PROVIDER_WEBHOOK", "PAYMENT_STATUS", "PRIMARY", "DERIVED"),
    ("PROVIDER_API", "PAYMENT_STATUS", "PRIMARY", "DIRECT"), ("INTERNAL_SYSTEM", "PAYMENT_EVENT", "SECONDARY", "DERIVED"),
    ("RUMOUR", "PAYMENT_EVENT", "TERTIARY", "INFERRED")])
def test_source_quality(spark, source, etype, authority, directness):
    df = spark.createDataFrame([(source, etype)], "s string, e string")
    r = df.select(E.authority(F.col("s")).alias("a"), E.directness(F.col("s"), F.col("e")).alias("d")).first()
    assert (r.a, r.d) == (authority, directness)


@pytest.mark.parametrize("a,b,want", [
    ("created", "captured", "VALID_FORWARD"), ("paid", "captured", "SAME_STATE"), ("captured", "failed", "CONTRADICTORY_TERMINAL"),
    ("captured", "authorized", "INVALID_BACKWARD"), ("captured", "refunded", "VALID_FORWARD"), (" Captured", "REFUNDED ", "VALID_FORWARD")])
def test_transitions(spark, a, b, want):
    assert spark.range(1).select(E.transition(F.lit(a), F.lit(b)).alias("t")).first().t == want


# --- structure -------------------------------------------------------------------------------------

def snapshot(spark, sizes):
    ids = itertools.count(1)
    data = [obs(next(ids), value=f"v{e}", event=e, vtype="STRING") for e, n in enumerate(sizes, 1) for _ in range(n)]
    return rows(structure.structure_snapshot(structure.structure_scope(observations(spark, data))))[0]


def test_concentration(spark):
    one, two = snapshot(spark, [4]), snapshot(spark, [8, 2])
    assert (one["group_hhi"], one["largest_group_size"]) == (1.0, 4)
    assert (two["group_hhi"], two["largest_group_size"], two["distinct_events"]) == (0.68, 8, 2)


@pytest.mark.parametrize("data,kind", [
    ([obs(1)], "SINGLE_OBSERVATION"), ([obs(1), obs(2)], "SAME_SOURCE_CORROBORATION"),
    ([obs(1), obs(2, event=2, at_s=9)], "TEMPORAL_CORROBORATION"), ([obs(1), obs(2, event=2, source="PROVIDER_API")], "MULTI_SOURCE_CORROBORATION")])
def test_corroboration(spark, data, kind):
    c = structure.corroboration(structure.build_claims(structure.claim_rows(observations(spark, data))))
    assert [r.corroboration_type for r in c.collect()] == [kind]


# --- conflicts and facts: counts against listed pairs ------------------------------------------------

def random_obs(seed, n=60, payments=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ev = rnd.randrange(12)
        pay = f"p{ev % payments}"
        etype, value, vtype = rnd.choice([
            ("PAYMENT_STATUS", rnd.choice(["captured", "failed", "authorized"]), "ENUM"), ("PAYMENT_AMOUNT", rnd.choice(["1", "2", "3"]), "INTEGER_MINOR_UNITS"),
            ("PAYMENT_CURRENCY", rnd.choice(["INR", "USD"]), "STRING"), ("PAYMENT_ORDER_RELATIONSHIP", rnd.choice(["o1", "o2"]), "STRING"),
            ("PAYMENT_EVENT", "x", "ENUM")])
        kind = ["payment.captured", "payment.failed", "order.paid"][ev % 3]
        out.append(obs(i, etype, value, event=ev, at_s=ev * 2.5, payment=pay, vtype=vtype, event_type=kind, source=rnd.choice(["PROVIDER_WEBHOOK", "PROVIDER_API"])))
    return out


def listed(spark, o):
    fr = facts.fact_rows(canonical.payment_scope(o))
    return fr, facts.decisions_of(fr, fr.select("evidence_id"))


@pytest.mark.parametrize("seed", [1, 2])
def test_decision_counts_equal_listed_decisions(spark, seed):
    fr, pairs = listed(spark, observations(spark, random_obs(seed)))
    want = {(r.payment_id, r.result, r.rule_id): r.n for r in pairs.groupBy("payment_id", "result", "rule_id").agg(F.count("*").alias("n")).collect()}
    got = {(r.payment_id, r.result, r.rule_id): r.pair_count for r in facts.reconcile_counts(fr).collect()}
    assert got == want
    ends = pairs.select("result", "rule_id", F.explode(F.array("observation_a_id", "observation_b_id")).alias("evidence_id"))
    want = {(r.evidence_id, r.result, r.rule_id): r.n for r in ends.groupBy("evidence_id", "result", "rule_id").agg(F.count("*").alias("n")).collect()}
    got = {(r.evidence_id, r.result, r.rule_id): r.partners for r in facts.observation_decisions(fr).collect()}
    assert got == want


@pytest.mark.parametrize("a,b,result,rule", [
    (obs(1), obs(2), "SAME_FACT", "SAME_PROVIDER_EVENT_V1"), (obs(1), obs(2, event=2, at_s=1), "SAME_FACT", "SAME_FACT_DIFFERENT_SOURCE_V1"),
    (obs(1), obs(2, event=2, at_s=5), "SAME_FACT", "SAME_FACT_DIFFERENT_SOURCE_V1"), (obs(1), obs(2, event=2, at_s=5.1), "UNKNOWN", "TEMPORAL_AMBIGUITY_V1"),
    (obs(1), obs(2, value="failed", event=2), "CONFLICTING_FACT", "CONFLICTING_VALUE_V1"),
    (obs(1), obs(2, "PAYMENT_AMOUNT", "5", vtype="STRING"), "RELATED_FACT", "DIFFERENT_LIFECYCLE_V1"),
    (obs(1), obs(2, "PAYMENT_AMOUNT", "5", event=2, vtype="STRING"), "DIFFERENT_FACT", "INSUFFICIENT_INFORMATION_V1"),
    (obs(1, event_type="payment.captured"), obs(2, event=2, event_type="payment.failed", value="failed"), "RELATED_FACT", "DIFFERENT_LIFECYCLE_V1")])
def test_reconciliation_rules(spark, a, b, result, rule):
    fr, pairs = listed(spark, observations(spark, [a, b]))
    assert [(r.result, r.rule_id) for r in pairs.collect()] == [(result, rule)]
    assert [(r.result, r.rule_id, r.pair_count) for r in facts.reconcile_counts(fr).collect()] == [(result, rule, 1)]


def test_duplicate_observation_makes_one_fact(spark):
    f = rows(facts.build_facts(facts.fact_rows(canonical.payment_scope(observations(spark, [obs(1), obs(2)])))))
    assert [(x["observation_count"], x["distinct_source_count"]) for x in f] == [(2, 1)]


@pytest.mark.parametrize("seed", [4, 5])
def test_conflict_sets_equal_listed_conflicts(spark, seed):
    claims = structure.payment_claims(structure.build_claims(structure.claim_rows(observations(spark, random_obs(seed)))))
    pairs = conflicts.partners_of(claims, claims.select("payment_id", "claim_id"))
    want = {(r.payment_id, r.claim_type): r.n for r in pairs.groupBy("payment_id", "claim_type").agg(F.count("*").alias("n")).collect()}
    got = {(r.payment_id, r.claim_type): r.conflict_count for r in conflicts.conflict_sets(claims).collect()}
    assert got == want
    prof = {r.payment_id: r.value_conflicts + r.relationship_conflicts for r in conflicts.conflict_profile(claims).collect()}
    for p, n in prof.items():
        assert n == sum(v for (q, _), v in want.items() if q == p)


@pytest.mark.parametrize("gap,first,second,want", [
    (1.5, "captured", "failed", ("STATE_CONFLICT", "HIGH")), (2.0, "authorized", "captured", ("ORDERING_AMBIGUITY", "INFO")),
    (60, "authorized", "captured", None), (60, "captured", "authorized", ("TEMPORAL_CONFLICT", "MEDIUM")), (60, "captured", "failed", ("STATE_CONFLICT", "HIGH"))])
def test_status_conflicts(spark, gap, first, second, want):
    data = [obs(1, value=first), obs(2, value=second, event=2, at_s=gap)]
    claims = structure.payment_claims(structure.build_claims(structure.claim_rows(observations(spark, data))))
    got = [(r.conflict_type, r.severity) for r in conflicts.status_conflicts(claims).collect()]
    assert got == ([want] if want else [])


def test_relationship_counts_equal_listed_edges(spark):
    po = canonical.payment_scope(observations(spark, random_obs(8)))
    pairs = relations.related_to(po, po.select("evidence_id"))
    want = {r.payment_id: r.n for r in pairs.filter("relationship_type = 'INDEPENDENCE_CANDIDATE'").groupBy("payment_id").agg(F.count("*").alias("n")).collect()}
    got = {r.payment_id: r.independence_pairs for r in relations.pair_totals(observations(spark, random_obs(8))).collect()}
    assert {k: v for k, v in got.items() if v} == want


# --- integrity, coverage, reliability ---------------------------------------------------------------

def decide(spark, data, at=US + 60_000_000):
    o = observations(spark, data)
    claims = structure.payment_claims(structure.build_claims(structure.claim_rows(o)))
    return rows(integrity.integrity(integrity.dimensions(structure.structure_scope(o), claims, (at,))))[0]


@pytest.mark.parametrize("data,status", [
    ([obs(1, at_s=120)], "INSUFFICIENT_DATA"), ([obs(1), obs(2, value="failed", event=2, at_s=9)], "UNRESOLVED"), ([obs(1, source="RUMOUR")], "WEAK"),
    ([obs(1, source="PROVIDER_API"), obs(2, "PAYMENT_EVENT", "captured", event=2, at_s=1), obs(3, "PAYMENT_EVENT", "captured", event=3, at_s=2, source="PROVIDER_API")], "VERY_STRONG"),
    ([obs(1)], "STRONG"), ([obs(1, until_s=30)], "INSUFFICIENT_DATA")])
def test_gates(spark, data, status):
    assert decide(spark, data)["overall_status"] == status


def test_future_rows_and_order_do_not_matter(spark):
    data = [obs(1), obs(2, "PAYMENT_AMOUNT", "5", vtype="STRING")]
    base = decide(spark, data)
    shuffled = decide(spark, data[::-1])
    assert base == shuffled
    later = decide(spark, [*data, obs(3, "PAYMENT_METHOD", "upi", event=9, at_s=999)])
    assert later["evidence_count"] == base["evidence_count"]


def test_coverage_states(spark):
    data = [obs(1), obs(2, "PAYMENT_AMOUNT", "5", vtype="STRING"), obs(3, "PAYMENT_CURRENCY", "INR", vtype="STRING")]
    po = canonical.payment_scope(observations(spark, data))
    pay = spark.createDataFrame([("p1", "captured", True), ("p2", "failed", False)], "payment_id string, status string, captured boolean")
    none = spark.createDataFrame([], "payment_id string, value_conflicts bigint, temporal_conflicts bigint")
    fs = facts.build_facts(facts.fact_rows(po))
    res = coverage.coverage_results(coverage.payment_flags(pay, fs, po, none))
    got = {(r.payment_id, r.requirement_id): (r.requirement_type, r.observed_state) for r in res.collect()}
    assert got[("p1", "REQ_PAYMENT_CREATION")] == ("REQUIRED", "PRESENT")
    assert got[("p1", "REQ_PAYMENT_CAPTURED")] == ("REQUIRED", "PARTIAL")
    assert got[("p1", "REQ_REFUND_RECORD")] == ("NOT_APPLICABLE", "NOT_APPLICABLE")
    assert got[("p2", "REQ_FAILURE_REASON")] == ("REQUIRED", "MISSING")
    status = {r.payment_id: r.overall_status for r in coverage.coverage_summary(res).collect()}
    assert status == {"p1": "SUBSTANTIALLY_COMPLETE", "p2": "INSUFFICIENT"}


@pytest.mark.parametrize("data,open_n,state", [
    ([obs(1)], 0, "HIGH"), ([obs(1)], 1, "LIMITED"), ([obs(1), obs(2)], 0, "MODERATE"), ([obs(1, source="INTERNAL_SYSTEM")], 0, "MODERATE"),
    ([obs(1, source="RUMOUR")], 0, "LIMITED"), ([obs(1, source="UNKNOWN")], 0, "UNKNOWN"), ([obs(1, value=" ", vtype="STRING")], 0, "UNRELIABLE")])
def test_fact_reliability(spark, data, open_n, state):
    fr = facts.fact_rows(canonical.payment_scope(observations(spark, data)))
    found = spark.createDataFrame([("p1", open_n)], "payment_id string, n bigint")
    assert [r.overall_state for r in reliability.fact_reliability(fr, found).collect()] == [state]


# --- evolution and traces -----------------------------------------------------------------------------

def history(spark, points):
    data = [obs(1), obs(2, "PAYMENT_AMOUNT", "5", event=2, at_s=100, vtype="STRING"), obs(3, value="failed", event=3, at_s=200)]
    o = observations(spark, data)
    claims = structure.payment_claims(structure.build_claims(structure.claim_rows(o)))
    return integrity.integrity(integrity.dimensions(structure.structure_scope(o), claims, points))


POINTS = (US + 50_000_000, US + 150_000_000, US + 250_000_000)


def test_state_changes_and_causes(spark):
    pairs = evolution.with_previous(evolution.state_snapshot(history(spark, POINTS)))
    ch = rows(evolution.change_causes(evolution.state_diff(pairs)))
    assert {(c["dimension"], c["change_type"], c["direct_cause"], c["magnitude"]) for c in ch} >= {("EVIDENCE", "NEW_EVIDENCE", "NEW_EVIDENCE", "MINOR")}


def test_trace_chain_detects_tampering(spark):
    t = trace.canonical_trace(history(spark, POINTS)).cache()
    again = trace.canonical_trace(history(spark, POINTS))
    assert sorted(r.trace_hash for r in t.collect()) == sorted(r.trace_hash for r in again.collect())
    assert trace.chain_verify(t).first().status == "CHAIN_VALID"
    assert trace.chain_verify(trace.canonical_trace(history(spark, POINTS[:1]))).first().status == "CHAIN_START"
    mid = F.col("eval_us") == POINTS[1]
    edited = t.withColumn("content", F.when(mid, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    assert trace.chain_verify(edited).first().issues == "HASH_MISMATCH"
    dropped = trace.chain_verify(t.filter(~mid)).first()
    assert dropped.issues == "BROKEN_LINK_HASH,BROKEN_LINK_ID"
    late = trace.chain_verify(t.filter(F.col("eval_us") > POINTS[0])).first()
    assert "DANGLING_PREVIOUS_HASH" in late.issues


def test_set_digest_ignores_order_but_not_content(spark):
    d = lambda ids: spark.createDataFrame([(str(i),) for i in ids], "x string").agg(*evolution.set_digest(F.sha2("x", 256))).first()
    assert d([1, 2, 3]) == d([3, 1, 2]) != d([1, 2, 4])


# --- graph ---------------------------------------------------------------------------------------------

def test_reach_and_paths(spark):
    e = spark.createDataFrame([("p", "a", "b", "E"), ("p", "b", "c", "E"), ("p", "c", "a", "E"), ("p", "a", "d", "E"), ("p", "d", "c", "E"), ("q", "a", "z", "E")],
                              "payment_id string, src string, dst string, edge_type string")
    roots = spark.createDataFrame([("p", "a", "a")], "payment_id string, root string, node string")
    assert {r.node: r.depth for r in graph.reach(e, roots, 3, ["payment_id"]).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    got = {r.node: r.path for r in graph.paths(e, roots, 3).collect()}
    assert got == {"a": "a", "b": "a > b", "c": "a > c", "d": "a > d"}


# --- defense --------------------------------------------------------------------------------------------

LINK = ("claim_id string, evidence_id bigint, link_type string, evidence_type string, value string, source_type string, source_reference string, "
        "observed_us bigint, valid_until_us bigint")


def link(i, etype, value, kind="SUPPORTING", source="MERCHANT_DOCUMENT", ref=None, at=0, until=None):
    return ("c1", i, kind, etype, value, source, ref or f"r{i}", US + at, until)


FULL = [link(1, "DELIVERY_PROOF", "delivered", source="CARRIER_API"), link(2, "PAYMENT_ID_MATCH", "p1"), link(3, "ORDER_ID_MATCH", "o1")]


def verdict(spark, links, at=US + 10):
    claims = spark.createDataFrame([("c1", "k1", "p1", "o1")], "claim_id string, case_id string, payment_reference string, order_reference string")
    return defense.claim_verdicts(claims, spark.createDataFrame(links, LINK), at).first().label


@pytest.mark.parametrize("links,label", [
    (FULL, "SUPPORTED"), (FULL + FULL[:1], "SUPPORTED"), (FULL[::-1], "SUPPORTED"), (FULL + [link(4, "REVIEW", "nice")], "SUPPORTED"), ([], "UNKNOWN"),
    (FULL[1:], "INSUFFICIENT_EVIDENCE"), (FULL + [link(9, "DELIVERY_STATUS", "lost", "CONTRADICTING")], "CONTRADICTED"),
    ([link(1, "DELIVERY_PROOF", "in_transit")] + FULL[1:], "UNKNOWN"), ([FULL[0], link(2, "PAYMENT_ID_MATCH", "p9"), FULL[2]], "INSUFFICIENT_EVIDENCE"),
    ([FULL[0], link(2, "PAYMENT_ID_MATCH", "p1", ref="same"), link(3, "ORDER_ID_MATCH", "o1", ref="same")], "INSUFFICIENT_EVIDENCE"),
    ([link(1, "DELIVERY_PROOF", "delivered", source="UNVERIFIED_FEED")] + FULL[1:], "INSUFFICIENT_EVIDENCE"),
    ([link(1, "DELIVERY_PROOF", "delivered", at=99)] + FULL[1:], "INSUFFICIENT_EVIDENCE"),
    ([link(1, "DELIVERY_PROOF", "delivered", until=US + 5)] + FULL[1:], "INSUFFICIENT_EVIDENCE"),
    ([link(1, "DELIVERY_PROOF", "delivered", until=US + 10)] + FULL[1:], "SUPPORTED")])
def test_verdicts(spark, links, label):
    assert verdict(spark, links) == label


def test_future_delivery_counts_later(spark):
    links = [link(1, "DELIVERY_PROOF", "delivered", at=99), *FULL[1:]]
    assert (verdict(spark, links, US + 10), verdict(spark, links, US + 200)) == ("INSUFFICIENT_EVIDENCE", "SUPPORTED")


def test_claims_from_text(spark):
    df = spark.createDataFrame([(1, "Hello. The box was Delivered on march 3rd, 2025. Bye."), (2, "nothing here"), (3, "sent 2024-05-06")], "id bigint, t string")
    got = {(r.id, r.claim_type): (r.claim_text, r.normalized_value) for r in defense.extract_claims(df, "id", "t").collect()}
    assert got[(1, "DELIVERY_COMPLETED")][0] == "the box was delivered on march 3rd, 2025"
    assert got[(1, "DELIVERY_DATE")][1] == "2025-03-03" and got[(3, "DELIVERY_DATE")][1] == "2024-05-06"
    assert (2, None) in got and (3, "SHIPMENT_DISPATCHED") in got


def test_extraction_hook(spark):
    def provider(batches):
        for b in batches:
            yield b.assign(claim_type="CUSTOM")[["id", "claim_type"]]
    df = spark.createDataFrame([(1, "x")], "id bigint, t string")
    assert defense.extract_with(df, provider, "id bigint, claim_type string").first().claim_type == "CUSTOM"


def test_metrics_and_kappa(spark):
    preds = spark.createDataFrame([("SUPPORTED", "SUPPORTED")] * 3 + [("SUPPORTED", "UNKNOWN"), ("CONTRADICTED", "CONTRADICTED")], "expected_label string, predicted string")
    m = {r.label: r for r in evalmetrics.class_metrics(evalmetrics.confusion_matrix(preds)).collect()}
    assert (m["SUPPORTED"].precision, m["SUPPORTED"].recall) == (1.0, 0.75) and m["INSUFFICIENT_EVIDENCE"].precision is None
    rated = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "first string, second string")
    assert evalmetrics.cohens_kappa(rated).first().kappa == 0.4
