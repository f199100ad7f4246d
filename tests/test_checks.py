"""Registered queries against their SQL on the smallest data; VERITRAIL_ALL=1 runs every one."""

from __future__ import annotations

import os

import pytest

from check import compare, open_tables
from veritrail.plans import catalog

CORE = (
    "webhook_landing", "signature_verify", "event_dedup", "fold_payments", "extract_evidence", "relationships", "structure_snapshot",
    "conflicts", "reconcile_pairs", "coverage_summary", "payment_reliability", "integrity", "integrity_rules", "payment_funnel", "risk_score",
    "fraud_signals", "trend_buckets", "decision_diff", "canonical_trace", "chain_verify", "defense_case_verdict", "class_metrics",
    "stateful_payment", "shortest_path", "evidence_scope", "normalize_event", "replay_verify", "trace_verify", "high_value_recent", "risk_dimensions", "stream_trend",
)
NAMES = tuple(catalog.queries()) if os.environ.get("VERITRAIL_ALL") else CORE


@pytest.fixture(scope="module")
def tables(sf):
    return open_tables(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, tables, name):
    status, _, _ = compare(spark, tables, name, catalog.queries()[name], catalog.checks()[name], sf, True)
    assert status == "ok", status


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(catalog.checks())
