"""Queries whose plans or tables once grew faster than their input."""

import pytest
from pyspark.sql import functions as F

from veritrail.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ("claim_support", "edges_for_payment", "fact_lineage", "observation_decisions"))
def test_nothing_that_grows_is_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in plan_of(catalog.queries()[name](spark, sf))


def test_edge_types_connect_what_is_said(spark, sf):
    """Searches only look at edges by these types, so none may connect anything else."""
    from veritrail.operators import graph

    kind = lambda c: F.substring_index(c, ":", 1)
    for name, kinds in (("investigation_edges", graph.INVESTIGATION), ("lineage_edges", graph.LINEAGE)):
        edges = catalog.queries()[name](spark, sf)
        found = {tuple(r) for r in edges.select("edge_type", kind("src"), kind("dst")).distinct().collect()}
        assert found <= {(k, *way) for k in kinds for way in graph.KINDS[k]}


def test_a_search_moves_only_edges_it_can_use(spark, sf):
    from veritrail.operators import graph

    ways = graph.ways_of(graph.INVESTIGATION)
    assert graph.hops_to(ways, "src") == {"src": 0, "ev": 1, "evt": 2, "hook": 2, "claim": 2, "pay": 3, "conf": 3, "ord": 4, "cust": 4, "snap": 4}
    assert ("STATE_TRANSITION", "chg", "state", True) in graph.ways_of(graph.LINEAGE)  # both ways along it, and against it
    rows = [("p", "pay:p", "evt:1", "HAS_EVENT"), ("p", "evt:1", "ev:1", "PRODUCED_EVIDENCE"), ("p", "ev:1", "src:A", "FROM_SOURCE"),
            ("p", "pay:p", "ord:1", "HAS_ORDER"), ("p", "evt:1", "hook:1", "DERIVED_FROM_WEBHOOK"), ("p", "ev:1", "hook:1", "DERIVED_FROM_WEBHOOK")]
    edges = spark.createDataFrame(rows * 2, "payment_id string, src string, dst string, edge_type string")
    roots = spark.createDataFrame([("p", "pay:p", "pay:p")], "payment_id string, root string, node string")
    assert graph.steps_along(edges, [("HAS_EVENT", "evt", "pay", True)], ["payment_id"]).distinct().collect() == [("p", "evt:1", "pay:p")]
    typed = lambda df: sorted(map(tuple, df.collect()))
    assert typed(graph.reach(edges, roots, 4, ["payment_id"], "pay", graph.INVESTIGATION)) == typed(graph.reach(edges, roots, 4, ["payment_id"]))
    ends = "node = 'src:A'"
    found = typed(graph.paths(edges, roots, 3, ends, "pay", "src", graph.INVESTIGATION))
    assert found == typed(graph.paths(edges, roots, 3).where(ends)) == [("p", "src:A", 3, "pay:p > evt:1 > ev:1 > src:A")]
    pairs = spark.createDataFrame([("p", "ord:1", "src:A"), ("p", "ord:1", "src:B")], "payment_id string, source string, target string")
    assert typed(graph.path_between(edges, pairs, 5, ("ord", "src"), graph.INVESTIGATION)) == typed(graph.path_between(edges, pairs, 5))


def test_dependencies_of_a_delivery(spark):
    """Against a plain search, over chains, cycles and repeated edges; more hops reach more."""
    from veritrail.operators import graph

    pairs = [(16, 17), (17, 18), (18, 19), (19, 16), (16, 17), (-15, -14), (-14, -13), (33, 33)]
    rel = spark.createDataFrame([(a, b, "DEPENDS_ON") for a, b in pairs], "source_id long, target_id long, relationship_type string")
    for depth in (0, 1, 5):
        want = {}
        for a in {a for a, _ in pairs}:
            seen = {a}
            for _ in range(1 + depth):
                seen |= {y for x, y in pairs if x in seen}
            if seen - {a}:
                near = [y for x, y in pairs if x == a]
                want[a] = (len(near), len(set(near)), len(seen - {a}) - len(set(near)))
        assert {r[0]: tuple(r)[1:] for r in graph.dependencies(rel, depth).collect()} == want


@pytest.mark.parametrize("name", ("decision_replay", "decision_diff", "change_explanation"))
def test_states_write_only_what_they_look_at(spark, sf, name, monkeypatch):
    from veritrail.plans import frames, history

    written = []
    monkeypatch.setattr(frames, "cut_lineage", lambda df: written.append(set(df.columns)) or df)
    monkeypatch.setattr(history, "cut_lineage", lambda df: written.append(set(df.columns)) or df)
    catalog.queries()[name](spark, sf)
    wide = {"evidence_id", "claim_id", "fact_hash", "distinct_source_count", "n_webhooks", "source_reference"}
    assert len(written) == 3 and not any(wide & columns for columns in written)


def test_rounds_are_not_multiplied_into_one_another(spark, sf):
    assert plan_of(catalog.queries()["evidence_dependencies"](spark, sf)).count("shiftright(") < 6


def _at_times(spark, points):
    """Observations of two payments with sources, events and times that are null or repeated, and copies of them as visible at each time."""
    from builders import US, obs, observations
    from veritrail.operators.quality import at_points

    rows = [obs(1, at_s=0), obs(2, at_s=4, event=2, source="PROVIDER_API"), obs(3, value="failed", at_s=11, event=3), obs(4, value="failed", at_s=11, event=3),
            obs(5, "PAYMENT_AMOUNT", "10", at_s=3, vtype="STRING", until_s=9), obs(6, "PAYMENT_AMOUNT", "12", at_s=9, event=2, vtype="STRING"),
            obs(7, payment="p2", at_s=20, source="FILE"), obs(8, payment="p2", at_s=5.5, event=None, source=None), obs(9, value=" ", at_s=1, source="UNKNOWN")]
    rows.append((*obs(10)[:11], None, None, None))  # without a time
    seen = observations(spark, rows).withColumn("payment_id", F.col("subject_id"))
    times = [US + int(t * 1_000_000) for t in points]
    return seen, at_points(seen, times), times


def test_times_in_one_pass_equal_a_copy_of_the_rows_for_each(spark):
    """Claims, conflicts and facts at several times against those built from what was visible at each."""
    from veritrail.operators import conflicts, facts, integrity, structure

    seen, copies, times = _at_times(spark, (-1, 2, 10, 30))
    typed = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    want = conflicts.conflict_profile(structure.payment_claims(structure.build_claims(structure.claim_rows(copies.drop("payment_id")))))
    got = conflicts.conflict_profile_at(structure.claims_through(structure.claim_rows(seen.drop("payment_id")), times), times)
    assert typed(got, want.columns) == typed(want, want.columns) and want.count() == 5
    per_time = [integrity.evidence_profile(seen, (t,)) for t in times]
    joint = integrity.evidence_profile(seen, times)
    cols = joint.columns
    assert typed(joint, cols) == sorted(x for p in per_time for x in typed(p, cols))
    last = {r["payment_id"]: r for r in per_time[-1].collect()}
    assert [last["p1"][c] for c in ("total_count", "evidence_count", "source_count", "distinct_sources", "distinct_events")] == [7, 6, 3, 3, 3]
    assert [last["p2"][c] for c in ("total_count", "source_count", "distinct_sources", "distinct_events")] == [2, 1, 1, 1]
    scope = lambda df: facts.fact_rows(df.drop("subject_id"))
    cols = ["payment_id", "eval_us", "fact_type", "canonical_value", "first_us", "observation_count", "fact_hash", "status"]
    assert typed(facts.facts_through(scope(seen), times), cols) == typed(facts.build_facts(scope(copies)), cols)


def test_pairs_of_a_fact_across_slots(spark):
    """Two observations within reach, in one slot or two, against all pairs; a fact without any time is left out."""
    from builders import obs, observations
    from veritrail.functions import vocab as V
    from veritrail.operators import facts, reliability

    reach = V.RECONCILIATION_WINDOW_US / 1e6
    sets = [(0,), (0, 0), (0, reach), (0, reach + 0.000001), (0.5, 0.5 + reach), (4.999999, 5), (1, 7, 13), (1, 7, 11.9), (-3, 1), (0, 10)]
    rows = [obs(100 * i + j, event=100 * i + j, at_s=t, payment=f"p{i}") for i, times in enumerate(sets) for j, t in enumerate(times)]
    rows.append((*obs(9999, payment="timeless")[:11], None, None, None))
    found = facts.fact_rows(observations(spark, rows).withColumnRenamed("subject_id", "payment_id"))
    got = {r["payment_id"]: (r["n"], r["has_pair"]) for r in reliability.fact_support(found).collect()}
    us = lambda t: round(t * 1e6)
    near = lambda ts: any(abs(us(a) - us(b)) <= V.RECONCILIATION_WINDOW_US for i, a in enumerate(ts) for b in ts[:i])
    assert got == {f"p{i}": (len(ts), near(ts)) for i, ts in enumerate(sets)}


@pytest.mark.parametrize("name, most", (("fact_reliability", 0), ("uncertainty", 0), ("history_reliability", 0)))
def test_reliability_puts_nothing_in_order(spark, sf, name, most):
    assert plan_of(catalog.queries()[name](spark, sf)).count("Window") <= most


@pytest.mark.parametrize("name", ("risk_score", "risk_dimensions", "weakest_strongest"))
def test_risk_writes_a_row_a_payment(spark, sf, name, monkeypatch):
    from veritrail.plans import frames

    written = []
    monkeypatch.setattr(frames, "cut_lineage", lambda df: written.append(set(df.columns)) or df)
    catalog.queries()[name](spark, sf)
    assert len(written) == 2 and not any({"evidence_id", "claim_id"} & columns for columns in written)


@pytest.mark.parametrize("name", ("history_integrity", "changes_by_dimension", "structure_snapshot"))
def test_distinct_counts_make_no_copies_of_rows(spark, sf, name):
    assert "Expand" not in plan_of(catalog.queries()[name](spark, sf))


@pytest.mark.parametrize("name", ("lineage_edges", "lineage_nodes"))
def test_lineage_computes_integrity_once(spark, sf, name, monkeypatch):
    from veritrail.plans import frames

    written = []
    monkeypatch.setattr(frames, "cut_lineage", lambda df: written.append(set(df.columns)) or df)
    catalog.queries()[name](spark, sf)
    assert len(written) == 1 and "overall_status" in written[0]
