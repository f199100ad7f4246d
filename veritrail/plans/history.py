"""Snapshots, evolution, replay, diff and audit traces."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import skew
from veritrail.functions import vocab as V
from veritrail.operators import evolution, trace
from veritrail.plans.evidence import GATED, dims_sql, fresh
from veritrail.plans.frames import EVAL_POINTS, T1, T2, T_EVAL, at
from veritrail.plans.oracle_base import TRANSITION, case
from veritrail.plans.registry import VIEWS, query, view
from veritrail.session import cut_lineage  # noqa: F401  tests count what is written

T_ASOF = at("2024-01-25T00:00:00")


def _depends_on(name: str, base: str) -> bool:
    refs = [r for r in re.findall(r"\bv_\w+", VIEWS[name]) if r in VIEWS and r != name]
    return base in refs or any(_depends_on(r, base) for r in refs)


def _visible_at(t: int, tag: str, wanted: str) -> str:
    """Copies of `wanted` and the views under it that see only observations up to `t`; returns its name."""
    new = f"v_{tag}_{wanted[2:]}"
    if new in VIEWS:
        return new
    if wanted == "v_obs":
        view(new, f"SELECT * FROM v_obs WHERE observed_us <= {t}")
        return new
    sql = VIEWS[wanted]
    for ref in sorted(set(re.findall(r"\bv_\w+", sql)), key=len, reverse=True):
        if ref in VIEWS and (ref == "v_obs" or _depends_on(ref, "v_obs")):
            sql = re.sub(rf"\b{ref}\b", _visible_at(t, tag, ref), sql)
    view(new, sql)
    return new


def over_points(name: str, sql: str) -> None:
    """`sql` has {t} for the time and {x:view} for a view as visible then; the union becomes a view."""
    parts = []
    for i, t in enumerate(EVAL_POINTS):
        text = re.sub(r"\{x:(\w+)\}", lambda m: _visible_at(t, f"at{i}", m.group(1)), sql)
        parts.append(text.replace("{t}", str(t)))
    view(name, " UNION ALL ".join(parts))


over_points("v_cov_at", "SELECT {t} AS eval_us, * FROM {x:v_cov_summary}")
over_points("v_rel_at", "SELECT {t} AS eval_us, * FROM {x:v_pay_rel}")
over_points("v_int_at", "SELECT * FROM {x:v_integrity} WHERE eval_us = {t}")
over_points("v_facts_at", "SELECT {t} AS eval_us, payment_id, count(*) AS fact_count FROM {x:v_facts} GROUP BY ALL")
LANE = "sum(('0x' || substr(sha256(CAST(evidence_id AS VARCHAR)), {}, 15)) :: BIGINT) :: VARCHAR"
over_points("v_in_at", f"SELECT {{t}} AS eval_us, payment_id, count(*) AS observation_count, {LANE.format(1)} AS lane0, {LANE.format(16)} AS lane1 FROM {{x:v_pobs}} GROUP BY ALL")
view("v_state", """
SELECT *, sha256(concat_ws('|', payment_id, eval_us, observation_count, lane0, lane1, fact_count, conflict_count)) AS input_fingerprint,
  sha256(concat_ws('|', coverage_status, required_present, required_missing, reliability_state, integrity_status, freshness, source, independence, corroboration, consistency, conflict_count)) AS result_fingerprint
FROM (SELECT c.payment_id, c.eval_us, coalesce(n.observation_count, 0) AS observation_count, coalesce(fact_count, 0) AS fact_count, coalesce(i.source_count, 0) AS source_count, coalesce(i.conflict_count, 0) AS conflict_count,
    c.overall_status AS coverage_status, required_present, required_missing, r.overall_state AS reliability_state, coalesce(i.overall_status, 'INSUFFICIENT_DATA') AS integrity_status,
    coalesce(freshness, 'UNKNOWN') AS freshness, coalesce(source, 'UNKNOWN') AS source, coalesce(independence, 'UNKNOWN') AS independence, coalesce(corroboration, 'UNKNOWN') AS corroboration,
    coalesce(consistency, 'NO_DETECTED_CONFLICT') AS consistency, coalesce(lane0, '0') AS lane0, coalesce(lane1, '0') AS lane1
  FROM v_cov_at c JOIN v_rel_at r ON r.payment_id = c.payment_id AND r.eval_us = c.eval_us LEFT JOIN v_int_at i ON i.payment_id = c.payment_id AND i.eval_us = c.eval_us
  LEFT JOIN v_facts_at f ON f.payment_id = c.payment_id AND f.eval_us = c.eval_us LEFT JOIN v_in_at n ON n.payment_id = c.payment_id AND n.eval_us = c.eval_us)""")


@query("history_coverage", "SELECT payment_id, eval_us, overall_status, required_present, required_missing FROM v_cov_at")
def _(f):
    return f.by_payment(lambda own: own.coverage_at).select("payment_id", "eval_us", "overall_status", "required_present", "required_missing")


@query("history_reliability", "SELECT payment_id, eval_us, facts_assessed, overall_state FROM v_rel_at")
def _(f):
    return f.by_payment(lambda own: own.reliability_at)


@query("history_integrity", "SELECT payment_id, eval_us, overall_status, evidence_count, conflict_count FROM v_int_at")
def _(f):
    """Strict point in time: claims and conflicts from what was visible as well."""
    return f.integrity_at.select("payment_id", "eval_us", "overall_status", "evidence_count", "conflict_count")


view("v_snap", """
SELECT payment_id, eval_us, overall_status, evidence_count, source_count, claim_count, conflict_count, open_conflict_count, corroboration, independence, freshness, consistency, source, 'EIS_V1' AS methodology_version FROM v_int_at""")


@query("state_snapshot", "SELECT * EXCLUDE (source) FROM v_snap")
def _(f):
    return evolution.state_snapshot(f.integrity_at)


@query("history_state", "SELECT payment_id, count(*) AS snapshots, min(eval_us) AS first_us, max(eval_us) AS last_us FROM v_snap GROUP BY 1")
def _(f):
    return evolution.state_snapshot(f.integrity_at).groupBy("payment_id").agg(
        F.count("*").alias("snapshots"), F.min("eval_us").alias("first_us"), F.max("eval_us").alias("last_us"))


@query("latest_snapshot", "SELECT payment_id, max(eval_us) AS eval_us, arg_max(overall_status, eval_us) AS overall_status, count(*) AS history_count FROM v_snap GROUP BY 1")
def _(f):
    return evolution.latest_snapshot(evolution.state_snapshot(f.integrity_at)).select("payment_id", "eval_us", "overall_status", "history_count")


@query("asof_integrity", f"SELECT payment_id, max(eval_us) AS eval_us, arg_max(overall_status, eval_us) AS overall_status FROM v_snap WHERE eval_us <= {T_ASOF} GROUP BY 1")
def _(f):
    return evolution.latest_snapshot(evolution.state_snapshot(f.integrity_at), T_ASOF).select("payment_id", "eval_us", "overall_status")


@query("asof_structure", f"""
SELECT payment_id, max(eval_us) AS eval_us, arg_max(distinct_sources, eval_us) AS distinct_sources, arg_max(distinct_events, eval_us) AS distinct_events FROM v_int_at WHERE eval_us <= {T_ASOF} GROUP BY 1""")
def _(f):
    snaps = f.integrity_at.select("payment_id", "eval_us", "distinct_sources", "distinct_events")
    return evolution.latest_snapshot(snaps, T_ASOF).drop("history_count")


@query("asof_quality", f"SELECT evidence_id, max(eval_us) AS eval_us, arg_max(freshness_state, eval_us) AS freshness_state FROM v_quality WHERE eval_us <= {T_ASOF} GROUP BY 1")
def _(f):
    from veritrail.operators.quality import quality_snapshot
    snaps = quality_snapshot(f.observations, EVAL_POINTS).filter(F.col("eval_us") <= T_ASOF)
    return snaps.groupBy("evidence_id").agg(F.max("eval_us").alias("eval_us"), F.max_by("freshness_state", "eval_us").alias("freshness_state"))


# --- each payment at its own times ------------------------------------------------------------------
# the definition: claims, conflicts and quality recomputed from what was visible at each time of each payment
view("v_own_times", "SELECT DISTINCT payment_id, observed_us AS eval_us FROM v_scope")
view("v_own_claims", """
SELECT e.payment_id, e.eval_us, claim_id, claim_type, claim_key, canonical_value, count(*) AS observation_count, count(DISTINCT source_type) AS n_sources, min(observed_us) AS earliest_us,
  CASE canonical_value WHEN 'paid' THEN 'captured' ELSE canonical_value END AS st
FROM v_own_times e JOIN v_claim_rows r ON r.subject_type = 'payment' AND r.subject_id = e.payment_id AND r.observed_us <= e.eval_us GROUP BY ALL""")
view("v_own_conflicts", f"""
SELECT payment_id, eval_us, count(*) AS conflict_count, count(*) FILTER (WHERE open) AS open_conflict_count FROM (
  SELECT payment_id, eval_us, transition_type = 'CONTRADICTORY_TERMINAL' OR NOT near AS open FROM (
    SELECT a.payment_id, a.eval_us, b.earliest_us - a.earliest_us <= {V.CLOCK_TOLERANCE_US} AS near, {TRANSITION} AS transition_type
    FROM v_own_claims a JOIN v_own_claims b ON a.payment_id = b.payment_id AND a.eval_us = b.eval_us AND (a.earliest_us, a.claim_id) < (b.earliest_us, b.claim_id)
    WHERE a.claim_type = 'PAYMENT_STATUS' AND a.claim_key = 'STATUS' AND b.claim_type = 'PAYMENT_STATUS' AND b.claim_key = 'STATUS')
  WHERE near OR transition_type NOT IN ('SAME_STATE', 'VALID_FORWARD')
  UNION ALL SELECT a.payment_id, a.eval_us, true FROM v_own_claims a JOIN v_own_claims b
    ON a.payment_id = b.payment_id AND a.eval_us = b.eval_us AND a.claim_type = b.claim_type AND a.claim_id < b.claim_id
  WHERE a.claim_type IN ('PAYMENT_AMOUNT', 'PAYMENT_CURRENCY', 'ORDER_ASSOCIATION')) GROUP BY ALL""")
view("v_own_profile", """
SELECT t.payment_id, t.eval_us, coalesce(claim_count, 0) AS claim_count, coalesce(multi_observation_claims, 0) AS multi_observation_claims, coalesce(multi_source_claims, 0) AS multi_source_claims,
  coalesce(conflict_count, 0) AS conflict_count, coalesce(open_conflict_count, 0) AS open_conflict_count
FROM v_own_times t LEFT JOIN (SELECT payment_id, eval_us, count(*) AS claim_count, count(*) FILTER (WHERE observation_count >= 2) AS multi_observation_claims,
    count(*) FILTER (WHERE n_sources >= 2) AS multi_source_claims FROM v_own_claims GROUP BY ALL) p ON p.payment_id = t.payment_id AND p.eval_us = t.eval_us
LEFT JOIN v_own_conflicts c ON c.payment_id = t.payment_id AND c.eval_us = t.eval_us""")
view("v_own_dims", dims_sql(
    "v_own_profile c JOIN v_own_times p ON p.payment_id = c.payment_id AND p.eval_us = c.eval_us", "v_own_times e ON e.payment_id = s.payment_id"))
view("v_own", GATED + "v_own_dims")
_OWN = ["payment_id", "eval_us", "overall_status", "evidence_count", "source_count", "claim_count", "conflict_count", "open_conflict_count",
        "freshness", "source", "independence", "corroboration", "consistency", "stale_count", "distinct_sources", "distinct_events"]


@query("history_integrity_own", f"SELECT {', '.join(_OWN)} FROM v_own")
def _(f):
    """Integrity after every observation of a payment."""
    return f.integrity_own.select(*_OWN)


_PROCESSED = "SELECT payment_id, event_id, processed_us FROM v_norm"


@query("asof_integrity_processed", f"""
SELECT p.payment_id, p.event_id, s.eval_us, s.overall_status, s.evidence_count FROM ({_PROCESSED}) p ASOF LEFT JOIN v_own s ON s.payment_id = p.payment_id AND s.eval_us <= p.processed_us""")
def _(f):
    """What was known about the integrity of a payment when each of its events was processed."""
    return f.integrity_as_processed(["eval_us", "overall_status", "evidence_count"]).drop("processed_us")


@query("asof_structure_processed", f"""
SELECT p.payment_id, p.event_id, s.eval_us, s.distinct_sources, s.distinct_events FROM ({_PROCESSED}) p ASOF LEFT JOIN v_own s ON s.payment_id = p.payment_id AND s.eval_us <= p.processed_us""")
def _(f):
    return f.integrity_as_processed(["eval_us", "distinct_sources", "distinct_events"]).drop("processed_us")


@query("asof_quality_processed", f"""
SELECT p.payment_id, p.event_id, s.evidence_id, s.observed_us, {fresh('p.processed_us')} AS freshness_state
FROM ({_PROCESSED}) p ASOF LEFT JOIN (SELECT payment_id, evidence_id, observed_us, evidence_type FROM v_pobs WHERE evidence_type = 'PAYMENT_STATUS'
  QUALIFY row_number() OVER (PARTITION BY payment_id, observed_us ORDER BY evidence_id DESC) = 1) s ON s.payment_id = p.payment_id AND s.observed_us <= p.processed_us""")
def _(f):
    """The latest status observation when each event was processed, and how fresh it was then."""
    status = f.payment_obs.where("evidence_type = 'PAYMENT_STATUS'").withColumn("at_us", F.col("observed_us"))
    found = skew.as_of_join(f.processed, status, ["payment_id"], "processed_us", "at_us", ["observed_us", "evidence_id", "evidence_type"])
    return found.select("payment_id", "event_id", "evidence_id", "observed_us", F.when(
        F.col("evidence_id").isNull(), "STALE").otherwise(E.freshness_state(F.col("observed_us"), F.col("processed_us"))).alias("freshness_state"))


# --- evolution -----------------------------------------------------------------------------------
_TRACKED = (*evolution.TRACKED, "methodology_version")
view("v_steps", f"""
SELECT * FROM (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in _TRACKED)}, lag(eval_us) OVER w AS p_eval_us FROM v_snap WINDOW w AS (PARTITION BY payment_id ORDER BY eval_us)) WHERE p_eval_us IS NOT NULL""")
_CR = {"UNKNOWN": 0, "SINGLE_OBSERVATION": 1, "PARTIALLY_CORROBORATED": 2, "STRONGLY_CORROBORATED": 3}


def _change(cond: str, dim: str, kind: str, col: str) -> str:
    return f"SELECT *, '{dim}' AS dimension, {kind} AS change_type, CAST(p_{col} AS VARCHAR) AS previous_value, CAST({col} AS VARCHAR) AS current_value FROM v_steps WHERE {cond}"


def _moved(col: str, dim: str, a: str, b: str) -> str:
    return _change(f"{col} <> p_{col}", dim, f"CASE WHEN {col} > p_{col} THEN '{a}' ELSE '{b}' END", col)


view("v_changes", " UNION ALL ".join([
    _moved("evidence_count", "EVIDENCE", "NEW_EVIDENCE", "EVIDENCE_REMOVED"), _moved("source_count", "SOURCE", "NEW_SOURCE", "SOURCE_LOST"),
    _change("corroboration <> p_corroboration", "CORROBORATION",
            f"CASE WHEN {case('corroboration', _CR)} > {case('p_corroboration', _CR)} THEN 'CORROBORATION_INCREASED' ELSE 'CORROBORATION_DECREASED' END", "corroboration"),
    _change("independence <> p_independence", "INDEPENDENCE", "'INDEPENDENCE_CHANGED'", "independence"),
    _change("freshness <> p_freshness", "FRESHNESS", "'FRESHNESS_CHANGED'", "freshness"),
    _moved("open_conflict_count", "CONSISTENCY", "CONFLICT_CREATED", "CONFLICT_RESOLVED"),
    _change("open_conflict_count = p_open_conflict_count AND consistency <> p_consistency", "CONSISTENCY", "'FRESHNESS_CHANGED'", "consistency"),
    _change("overall_status <> p_overall_status", "INTEGRITY", "'INTEGRITY_CHANGED'", "overall_status")]))


@query("state_changes", "SELECT payment_id, eval_us, p_eval_us, overall_status, p_overall_status, evidence_count, p_evidence_count FROM v_steps")
def _(f):
    return evolution.with_previous(evolution.state_snapshot(f.integrity_at)).select(
        "payment_id", "eval_us", "p_eval_us", "overall_status", "p_overall_status", "evidence_count", "p_evidence_count")


def _pairs(f):
    return evolution.with_previous(evolution.state_snapshot(f.integrity_at))


@query("state_diff", "SELECT payment_id, eval_us, dimension, change_type, previous_value, current_value FROM v_changes")
def _(f):
    return evolution.state_diff(_pairs(f)).select("payment_id", "eval_us", "dimension", "change_type", "previous_value", "current_value")


_GAP = "abs({0} - {1})"
view("v_causes", f"""
SELECT payment_id, eval_us, dimension, change_type, previous_value, current_value,
  CASE WHEN evidence_count > p_evidence_count THEN 'NEW_EVIDENCE'
    WHEN change_type = 'FRESHNESS_CHANGED' AND evidence_count = p_evidence_count AND {case('freshness', V.FRESHNESS_RANK)} < {case('p_freshness', V.FRESHNESS_RANK)} THEN 'TIME_PASSAGE'
    WHEN open_conflict_count > p_open_conflict_count THEN 'CONFLICT' WHEN open_conflict_count < p_open_conflict_count THEN 'CONFLICT_RESOLUTION'
    WHEN source_count <> p_source_count THEN 'SOURCE_CHANGE' WHEN starts_with(change_type, 'CORROBORATION') AND evidence_count <> p_evidence_count THEN 'NEW_EVIDENCE' ELSE 'UNKNOWN_CAUSE' END AS direct_cause,
  CASE WHEN evidence_count > p_evidence_count THEN 'DIRECT'
    WHEN change_type = 'FRESHNESS_CHANGED' AND evidence_count = p_evidence_count AND {case('freshness', V.FRESHNESS_RANK)} < {case('p_freshness', V.FRESHNESS_RANK)} THEN 'DIRECT'
    WHEN open_conflict_count <> p_open_conflict_count THEN 'DIRECT' WHEN source_count <> p_source_count OR starts_with(change_type, 'CORROBORATION') THEN 'INFERRED' ELSE 'UNKNOWN' END AS causality,
  CASE WHEN change_type = 'INTEGRITY_CHANGED' THEN [NULL, 'MINOR', 'MODERATE', 'MAJOR', 'MAJOR'][{_GAP.format(case('current_value', V.INTEGRITY_TIER), case('previous_value', V.INTEGRITY_TIER))} + 1]
    WHEN dimension = 'FRESHNESS' THEN [NULL, 'MINOR', 'MODERATE', 'MAJOR'][{_GAP.format(case('current_value', V.FRESHNESS_RANK), case('previous_value', V.FRESHNESS_RANK))} + 1]
    WHEN dimension = 'EVIDENCE' THEN CASE WHEN abs(evidence_count - p_evidence_count) = 1 THEN 'MINOR' WHEN abs(evidence_count - p_evidence_count) <= 4 THEN 'MODERATE' ELSE 'MAJOR' END END AS magnitude,
  concat_ws(' ', dimension, 'changed from', previous_value, 'to', current_value) AS explanation FROM v_changes""")


@query("state_change_cause", "SELECT * FROM v_causes")
def _(f):
    return evolution.change_causes(evolution.state_diff(_pairs(f)))


@query("changes_by_dimension", "SELECT payment_id, eval_us, change_type, direct_cause FROM v_causes WHERE dimension = 'INTEGRITY'")
def _(f):
    changes = evolution.change_causes(evolution.state_diff(_pairs(f)))
    return changes.filter(F.upper(F.lit("integrity")) == F.col("dimension")).select("payment_id", "eval_us", "change_type", "direct_cause")


@query("recompute", """
SELECT s.payment_id, s.eval_us, s.overall_status, s.p_overall_status AS previous_status, coalesce(n, 0) AS changes, n IS NULL AS no_material_change
FROM v_steps s LEFT JOIN (SELECT payment_id, eval_us, count(*) AS n FROM v_changes GROUP BY ALL) c ON c.payment_id = s.payment_id AND c.eval_us = s.eval_us""")
def _(f):
    pairs = _pairs(f)
    return evolution.recompute(pairs, evolution.state_diff(pairs))


# --- replay and diff -------------------------------------------------------------------------------
def _shared(f):
    """What the parts of a state share, written once: rows a payment or a payment and time, of which several parts are derived.

    Observations, their claims and facts are made from the events where they are needed. They are many times the input.
    """
    return f.keeping("payments", "profile_at", "coverage_at")


def _states(f):
    inputs = evolution.input_fingerprint(f.payment_obs_at, ["payment_id", "eval_us"])
    return evolution.decision_state(f.payments_at, inputs, f.facts_at, f.coverage_at, f.reliability_at, f.integrity_at)


@query("decision_replay", "SELECT * EXCLUDE (lane0, lane1) FROM v_state")
def _(f):
    return f.by_payment(lambda own: _states(_shared(own)))


view("v_fact_diff", f"""
SELECT payment_id, fact_type, canonical_value, count(*) FILTER (WHERE observed_us <= {T1}) AS n1, count(*) AS n2 FROM v_fact_rows WHERE observed_us <= {T2} GROUP BY ALL""")


@query("fact_diff", "SELECT *, CASE WHEN n1 = 0 THEN 'ADDED' WHEN n2 > n1 THEN 'CHANGED' ELSE 'UNCHANGED' END AS category FROM v_fact_diff")
def _(f):
    return evolution.fact_diff(f.fact_rows, T1, T2)


view("v_source_diff", f"""
SELECT payment_id, coalesce(string_agg(source_type, ',' ORDER BY source_type) FILTER (WHERE first <= {T1}), '') AS sources_t1, string_agg(source_type, ',' ORDER BY source_type) AS sources_t2,
  coalesce(string_agg(source_type, ',' ORDER BY source_type) FILTER (WHERE first > {T1}), '') AS added, CASE WHEN bool_or(first > {T1}) THEN 'SOURCE_DIVERSITY_INCREASED' ELSE 'NO_SOURCE_CHANGE' END AS diversity
FROM (SELECT payment_id, source_type, min(observed_us) AS first FROM v_pobs WHERE observed_us <= {T2} GROUP BY ALL) GROUP BY 1""")


@query("source_set_diff", "SELECT * FROM v_source_diff")
def _(f):
    return evolution.source_set_diff(f.payment_obs, T1, T2)


view("v_ddiff", f"""
SELECT a.payment_id, a.integrity_status AS integrity_status_1, b.integrity_status AS integrity_status_2, a.coverage_status AS coverage_status_1, b.coverage_status AS coverage_status_2,
  a.reliability_state AS reliability_state_1, b.reliability_state AS reliability_state_2, a.conflict_count AS conflict_count_1, b.conflict_count AS conflict_count_2,
  coalesce(facts_added, 0) AS facts_added, coalesce(facts_changed, 0) AS facts_changed, coalesce(added, '') AS sources_added,
  concat_ws(',', CASE WHEN facts_added > 0 THEN 'EVIDENCE_ADDED' END, CASE WHEN facts_changed > 0 THEN 'EVIDENCE_CHANGED' END, CASE WHEN diversity = 'SOURCE_DIVERSITY_INCREASED' THEN 'SOURCE_ADDED' END,
    CASE WHEN b.conflict_count > a.conflict_count THEN 'CONFLICT_ADDED' END, CASE WHEN b.conflict_count < a.conflict_count THEN 'CONFLICT_RESOLVED' END,
    CASE WHEN a.coverage_status <> b.coverage_status OR a.required_present <> b.required_present OR a.required_missing <> b.required_missing THEN 'COVERAGE_CHANGED' END,
    CASE WHEN a.reliability_state <> b.reliability_state THEN 'RELIABILITY_CHANGED' END,
    CASE WHEN (a.integrity_status, a.freshness, a.source, a.independence, a.corroboration, a.consistency) <> (b.integrity_status, b.freshness, b.source, b.independence, b.corroboration, b.consistency) THEN 'INTEGRITY_CHANGED' END) AS change_categories
FROM v_state a JOIN v_state b ON a.payment_id = b.payment_id AND a.eval_us = {T1} AND b.eval_us = {T2}
LEFT JOIN (SELECT payment_id, count(*) FILTER (WHERE n1 = 0) AS facts_added, count(*) FILTER (WHERE n1 > 0 AND n2 > n1) AS facts_changed FROM v_fact_diff GROUP BY 1) f ON f.payment_id = a.payment_id
LEFT JOIN v_source_diff s ON s.payment_id = a.payment_id""")


def _diff(f):
    def build(own):
        own = _shared(own)
        return evolution.decision_diff(_states(own), evolution.fact_diff(own.fact_rows, T1, T2), evolution.source_set_diff(own.payment_obs, T1, T2), T1, T2)
    return f.only_at(T1, T2).by_payment(build)


@query("decision_diff", "SELECT * FROM v_ddiff")
def _(f):
    return _diff(f)


@query("change_explanation", """
SELECT payment_id, CASE WHEN e = '' THEN 'no change' ELSE e END AS explanation FROM (SELECT payment_id, concat_ws('; ', CASE WHEN facts_added > 0 THEN facts_added || ' new facts' END,
  CASE WHEN facts_changed > 0 THEN facts_changed || ' facts gained observations' END, CASE WHEN sources_added <> '' THEN 'new sources: ' || sources_added END,
  CASE WHEN conflict_count_2 > conflict_count_1 THEN (conflict_count_2 - conflict_count_1) || ' new conflicts' END,
  CASE WHEN coverage_status_1 <> coverage_status_2 THEN 'coverage ' || coverage_status_1 || ' -> ' || coverage_status_2 END,
  CASE WHEN reliability_state_1 <> reliability_state_2 THEN 'reliability ' || reliability_state_1 || ' -> ' || reliability_state_2 END,
  CASE WHEN integrity_status_1 <> integrity_status_2 THEN 'integrity ' || integrity_status_1 || ' -> ' || integrity_status_2 END) AS e FROM v_ddiff)""")
def _(f):
    return evolution.change_explanation(_diff(f))


@query("replay_verify", f"""
SELECT payment_id, eval_us, CASE WHEN r.payment_id IS NULL THEN 'INCOMPLETE' WHEN d = '' THEN 'MATCH' ELSE 'REPLAY_MISMATCH' END AS verification, d AS differing FROM (
  SELECT a.payment_id, a.eval_us, b.payment_id AS found, concat_ws(',', {', '.join(f"CASE WHEN a.{c} <> b.{c} THEN '{c}' END" for c in evolution.REPLAYED)}) AS d
  FROM v_integrity a LEFT JOIN v_int_at b ON b.payment_id = a.payment_id AND b.eval_us = a.eval_us) r""".replace("r.payment_id IS NULL", "found IS NULL"))
def _(f):
    """Evaluations as recorded over the whole scope against recomputations from what was visible at each time."""
    recorded = f.integrity_history.withColumn("methodology_version", F.lit(V.METHODOLOGY))
    return evolution.replay_verify(recorded, f.integrity_at)


# --- traces ------------------------------------------------------------------------------------------
view("v_content", f"""
SELECT *, '{{"conflict_count":' || conflict_count || ',"dimensions":{{"consistency":"' || consistency || '","corroboration":"' || corroboration || '","freshness":"' || freshness || '","independence":"' || independence || '","source":"' || source
  || '"}},"evaluated_at":"' || strftime(make_timestamp(eval_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '","evidence_count":' || evidence_count || ',"methodology_version":"EIS_V1","overall_status":"' || overall_status
  || '","payment_id":"' || payment_id || '","source_count":' || source_count || '}}' AS content, sha256(payment_id || '|' || eval_us || '|EIS_V1') AS trace_id FROM v_integrity""")
_H = "sha256('{{\"content\":' || {0} || ',\"previous_trace_hash\":' || {1} || '}}')"
view("v_chain1", f"SELECT payment_id, {_H.format('content', chr(39) + 'null' + chr(39))} AS h, trace_id FROM v_content WHERE eval_us = {T1}")
view("v_chain2", f"""SELECT c.payment_id, {_H.format('content', "'" + '"' + "' || p.h || '" + '"' + "'")} AS h, c.trace_id, p.h AS ph, p.trace_id AS pid FROM v_content c JOIN v_chain1 p ON p.payment_id = c.payment_id WHERE eval_us = {T2}""")
view("v_chain3", f"""SELECT c.payment_id, {_H.format('content', "'" + '"' + "' || p.h || '" + '"' + "'")} AS h, c.trace_id, p.h AS ph, p.trace_id AS pid FROM v_content c JOIN v_chain2 p ON p.payment_id = c.payment_id WHERE eval_us = {T_EVAL}""")
view("v_traces", """
SELECT c.payment_id, c.eval_us, c.trace_id, c.content, h.h AS trace_hash, pid AS previous_trace_id, ph AS previous_trace_hash, c.overall_status
FROM v_content c JOIN (SELECT trace_id, h, ph, pid FROM v_chain2 UNION ALL SELECT trace_id, h, ph, pid FROM v_chain3 UNION ALL SELECT trace_id, h, NULL, NULL FROM v_chain1) h ON h.trace_id = c.trace_id""")


@query("canonical_trace", "SELECT payment_id, eval_us, trace_id, content, trace_hash, previous_trace_id, previous_trace_hash FROM v_traces")
def _(f):
    return f.traces.select("payment_id", "eval_us", "trace_id", "content", "trace_hash", "previous_trace_id", "previous_trace_hash")


@query("chain_links", "SELECT payment_id, eval_us, trace_id, previous_trace_id, previous_trace_hash FROM v_traces")
def _(f):
    return f.traces.select("payment_id", "eval_us", "trace_id", "previous_trace_id", "previous_trace_hash")


@query("trace_list", "SELECT payment_id, trace_id, eval_us, overall_status, trace_hash FROM v_traces")
def _(f):
    return f.traces.select("payment_id", "trace_id", "eval_us", "overall_status", "trace_hash")


_AGAIN = _H.format("content", "CASE WHEN previous_trace_hash IS NULL THEN 'null' ELSE '\"' || previous_trace_hash || '\"' END")
view("v_checked", f"""
SELECT payment_id, trace_id, trace_hash = {_AGAIN} AS hash_ok, row_number() OVER w = 1 AS is_first,
  previous_trace_hash IS NOT DISTINCT FROM lag(trace_hash) OVER w AS hash_linked, previous_trace_id IS NOT DISTINCT FROM lag(trace_id) OVER w AS id_linked
FROM v_traces WINDOW w AS (PARTITION BY payment_id ORDER BY eval_us, trace_id)""")


@query("trace_verify", "SELECT payment_id, trace_id, CASE WHEN hash_ok THEN 'VALID' ELSE 'INVALID' END AS verification FROM v_checked")
def _(f):
    return trace.trace_verify(f.traces)


@query("chain_verify", """
SELECT payment_id, n AS verified_count, CAST(bad AS BIGINT) AS problems, issues,
  CASE WHEN bad > 0 THEN 'CHAIN_INVALID' WHEN n = 1 THEN 'CHAIN_START' ELSE 'CHAIN_VALID' END AS status FROM (
  SELECT payment_id, count(*) AS n, sum(CAST(NOT hash_ok AS INT) + CAST(NOT hash_linked AS INT) + CAST(NOT id_linked AS INT)) AS bad,
    concat_ws(',', CASE WHEN bool_or(NOT id_linked) THEN 'BROKEN_LINK_ID' END, CASE WHEN bool_or(NOT hash_linked) THEN 'BROKEN_LINK_HASH' END, CASE WHEN bool_or(NOT hash_ok) THEN 'HASH_MISMATCH' END) AS issues
  FROM v_checked GROUP BY 1)""")
def _(f):
    return trace.chain_verify(f.traces)


_DIMS_TEXT = ",".join(trace.DIMENSIONS)
view("v_trace_events", f"""
WITH s AS (SELECT payment_id, eval_us, evidence_count, list_position(['INSUFFICIENT_DATA', 'UNRESOLVED', 'WEAK', 'VERY_STRONG', 'STRONG', 'LIMITED'], overall_status) AS stop FROM v_integrity WHERE eval_us = {T_EVAL}),
g AS (SELECT payment_id, eval_us, g + 3 AS seq, 'RULE_EXECUTED' AS event_type, 'EIS_V1.' || ['INSUFFICIENT_DATA', 'UNRESOLVED', 'WEAK', 'VERY_STRONG', 'STRONG', 'LIMITED'][g] || ':' || (g = stop) AS detail FROM s JOIN (SELECT unnest(range(1, 7)) AS g) ON g <= stop)
SELECT * FROM g UNION ALL SELECT payment_id, eval_us, 1, 'TRACE_STARTED', 'EVALUATION' FROM s UNION ALL SELECT payment_id, eval_us, 2, 'EVIDENCE_SCOPED', CAST(evidence_count AS VARCHAR) FROM s
UNION ALL SELECT payment_id, eval_us, 3, 'DIMENSIONS_COMPUTED', '{_DIMS_TEXT}' FROM s
UNION ALL SELECT payment_id, eval_us, stop + 4, 'TRACE_FINALIZED', 'COMPLETED' FROM s""")


@query("trace_events", "SELECT * FROM v_trace_events")
def _(f):
    return trace.trace_events(f.dimensions_now)


@query("trace_detail", f"""
SELECT t.payment_id, t.trace_id, t.overall_status, e.seq, e.event_type FROM v_traces t JOIN v_trace_events e ON e.payment_id = t.payment_id AND e.eval_us = t.eval_us""")
def _(f):
    return f.traces.select("payment_id", "eval_us", "trace_id", "overall_status").join(
        trace.trace_events(f.dimensions_now).select("payment_id", "eval_us", "seq", "event_type"), ["payment_id", "eval_us"]).drop("eval_us")


_SECT = ["evidence_count", "source_count", *trace.DIMENSIONS, "conflict_count", "overall_status"]


@query("trace_diff", f"""
SELECT payment_id, CASE WHEN d = '' THEN 'MATCH' ELSE 'MISMATCH' END AS comparison, nullif(split_part(d, ',', 1), '') AS first_difference, d AS differences FROM (
  SELECT a.payment_id, concat_ws(',', {', '.join(f"CASE WHEN a.{s} IS DISTINCT FROM b.{s} THEN '{s}' END" for s in _SECT)}) AS d
  FROM v_integrity a JOIN v_integrity b ON a.payment_id = b.payment_id AND a.eval_us = {T1} AND b.eval_us = {T2})""")
def _(f):
    h = f.only_at(T1, T2).integrity_history
    return trace.trace_diff(h.filter(F.col("eval_us") == T1), h.filter(F.col("eval_us") == T2))


@query("trace_for_snapshot", """
SELECT s.payment_id, s.eval_us, arg_min(t.trace_id, t.traced_us) AS trace_id FROM v_snap s LEFT JOIN (SELECT payment_id, trace_id, eval_us + (ascii(right(payment_id, 1)) % 9) * 1000000 AS traced_us FROM v_traces) t
 ON t.payment_id = s.payment_id AND abs(t.traced_us - s.eval_us) <= 5000000 GROUP BY ALL""")
def _(f):
    """Traces are finalised 0-8 s after the evaluation; those later than 5 s find no snapshot."""
    t = f.traces.select("payment_id", "trace_id", (F.col("eval_us") + F.ascii(F.right("payment_id", F.lit(1))) % 9 * 1_000_000).alias("traced_us"))
    return trace.trace_for_snapshot(evolution.state_snapshot(f.integrity_at), t)


@query("risk_trend", """
SELECT payment_id, eval_us, greatest(0.0, least(100.0, base - CASE WHEN open_conflict_count > 0 THEN 15 ELSE 0 END + 10)) :: DOUBLE AS score FROM (
  SELECT *, CASE WHEN overall_status IN ('VERY_STRONG', 'STRONG') THEN 85 WHEN overall_status = 'LIMITED' THEN 60 WHEN overall_status IN ('WEAK', 'UNRESOLVED') THEN 25 ELSE 50 END AS base,
    row_number() OVER (PARTITION BY payment_id ORDER BY eval_us DESC) AS rn FROM v_snap) WHERE rn <= 50""")
def _(f):
    from veritrail.operators.risk import risk_trend
    return risk_trend(evolution.state_snapshot(f.integrity_at))
