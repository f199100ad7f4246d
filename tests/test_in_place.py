"""What is derived payment by payment moves events, and is the same for payments that are spread over tasks."""

from datetime import datetime, timedelta, timezone

import pytest

from veritrail.plans import catalog, frames

NAMES = (
    "observation_decisions", "structure_view", "history_coverage", "history_reliability", "risk_score", "risk_dimensions",
    "weakest_strongest", "decision_replay", "decision_diff", "change_explanation", "lineage_edges", "lineage_nodes", "investigation_graph")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Payments of one to a dozen events over some weeks; null values, and rows that come twice or share an id."""
    day = datetime(2024, 1, 2, tzinfo=timezone.utc)
    kinds = ("click", "purchase", "error", "signup", "view")
    rows = []
    for i in range(90):
        user, at = i * i % 7, day + timedelta(days=i % 4 * 7, seconds=i * i * 37 % 600)
        rows.append((i, at, user, kinds[i * 3 % 5 if i % 11 else 3], float(i % 5) * 10, f'{{"k": {i * 13 % 100}}}'))
    rows += [rows[3], rows[4], (5, day, 1, "signup", 3.0, '{"k": 8}'), (100, day, None, "signup", 3.0, '{"k": 8}'), (101, None, 2, "click", 3.0, '{"k": 4}'),
             (102, day, 2, None, 3.0, '{"k": 4}'), (103, day, 2, "signup", None, None), (104, day, 2, "signup", 1.0, '{"k": 22}'), (105, day, 99, "signup", 1.0, None)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_folds_in_place_and_spread_are_the_same(spark, odd):
    from veritrail.operators import canonical

    events = frames.Frames(spark, odd).normalized
    spread = rows_of(canonical.fold_payments(events))
    assert spread == rows_of(canonical.fold_payments(events, False))
    assert not any("pay_99_" in row for row in spread)  # its only event has no time of arrival


@pytest.mark.parametrize("name", NAMES)
def test_only_events_are_moved(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("REPARTITION_BY_COL" in line for line in moved), moved


@pytest.mark.parametrize("name", ("observation_decisions", "structure_view", "history_reliability", "risk_score", "lineage_edges"))
def test_large_payments_are_as_others(spark, odd, name, monkeypatch):
    want = rows_of(catalog.queries()[name](spark, odd))
    assert want
    monkeypatch.setattr(frames, "MANY", 5)  # some payments lie in one task and some do not
    assert rows_of(catalog.queries()[name](spark, odd)) == want


def test_track_comparison_makes_predictions_once(spark, sf):
    plan = catalog.queries()["track_comparison"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan  # only their counts are read again


@pytest.mark.parametrize("name, module", (("claim_support", "evidence"), ("edges_for_payment", "graphs")))
def test_edges_are_found_on_the_row_of_their_event(spark, odd, name, module, monkeypatch):
    df = catalog.queries()[name](spark, odd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("REPARTITION_BY_COL" in line for line in moved), moved
    want = rows_of(df)
    assert want
    monkeypatch.setattr(f"veritrail.plans.{module}.MANY", 1)
    assert rows_of(catalog.queries()[name](spark, odd)) == want


def test_edges_inside_a_claim_are_counted(spark, monkeypatch):
    from builders import event, events
    from veritrail.functions import vocab as V
    from veritrail.operators import canonical, relations, structure

    monkeypatch.setitem(V.CLAIM_OF, "PAYMENT_METHOD", ("PAYMENT_STATUS", "STATUS", "lower"))  # two observations of an event make one claim
    rows = canonical.by_subject(canonical.normalize_events(events(spark, [event(1, method="Captured"), event(2, method="upi")])))
    edges = relations.event_edges(rows.withColumn("claims", structure.claim_in_slots()), "subject_type", "subject_id", "claims")
    got = structure.claim_support(structure.claim_rows(canonical.subject_evidence(rows)), structure.inner_edges(edges)).collect()
    assert sorted((r["total_support"], r["dependency_count"]) for r in got if r["dependency_count"]) == [(3, 2)]


def test_a_side_without_new_nodes_is_not_searched_on(spark, monkeypatch):
    from veritrail.operators import graph

    written, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    edges = spark.createDataFrame([("p", a, b) for a, b in zip("abcde", "bcdef")], "payment_id string, src string, dst string")
    pairs = spark.createDataFrame([("p", "a", "x"), ("p", "a", "f")], "payment_id string, source string, target string")
    got = {r["target"]: tuple(r)[3:] for r in graph.path_between(edges, pairs, 5).collect()}
    assert got == {"x": (None, None, True), "f": (5, "a > b > c > d > e > f", False)}
    fronts = [df for df in written if "text" in df.columns]
    assert not fronts[0].where("target = 'x'").isEmpty() and fronts[2].where("target = 'x'").isEmpty()


def test_reach_in_place_is_reach(spark):
    from veritrail.operators import graph

    ways = [("pay:p", "evt:1", "HAS_EVENT"), ("pay:p", "evt:2", "HAS_EVENT"), ("evt:1", "ev:1", "PRODUCED_EVIDENCE"), ("evt:2", "ev:2", "PRODUCED_EVIDENCE"),
            ("evt:1", "hook:1", "DERIVED_FROM_WEBHOOK"), ("ev:1", "hook:1", "DERIVED_FROM_WEBHOOK"), ("ev:1", "claim:c", "SUPPORTS_CLAIM"), ("pay:p", "conf:x", "HAS_CONFLICT"),
            ("conf:x", "claim:c", "INVOLVES_CLAIM"), ("ev:2", "src:S", "FROM_SOURCE")]
    edges = spark.createDataFrame([(p, *w) for p in ("p", "q") for w in ways] * 2, "payment_id string, src string, dst string, edge_type string")
    roots = spark.createDataFrame([("p", "pay:p", "pay:p"), ("p", "other", "pay:p"), ("q", "pay:p", "pay:p")], "payment_id string, root string, node string")
    for depth in (1, 2, 4):
        want = rows_of(graph.reach(edges, roots, depth, ["payment_id"], "pay", graph.INVESTIGATION))
        assert rows_of(graph.reach_in_place(edges, roots, depth, ["payment_id"], "pay", graph.INVESTIGATION)) == want
