"""Base views of the SQL checks: the driver tables mapped onto the data model."""

from __future__ import annotations

from veritrail.functions import vocab as V
from veritrail.plans.frames import T_EVAL
from veritrail.plans.registry import view
from veritrail.sources.driver_tables import EVENT_TYPE_MAP, FAILURE_KEYS


def case(expr: str, mapping: dict, default: str | None = None) -> str:
    def lit(x):
        return str(x) if isinstance(x, (int, float)) else f"'{x}'"
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    tail = "" if default is None else f" ELSE {default if not isinstance(default, str) else repr(default)}"
    return f"CASE {expr} {arms}{tail} END"


def inlist(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FAIL_LIST = "[" + ", ".join(f"'{x}'" for x in FAILURE_KEYS) + "]"

view("v_raw", "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS observed_us FROM events")
view("v_ev", f"""
SELECT event_id, k, 'evt_' || event_id AS provider_event_id,
  {case('event_type', EVENT_TYPE_MAP)} AS event_type,
  'pay_' || user_id || '_' || strftime(ts, '%Y%m%d') AS payment_id,
  CASE WHEN k % 11 <> 0 THEN 'order_' || user_id || '_' || (k % 3) END AS order_id,
  'cust_' || user_id AS customer_id,
  CASE WHEN k % 13 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS amount_minor,
  CASE WHEN k % 10 = 0 THEN 'USD' ELSE 'INR' END AS currency,
  ['upi', 'card', 'netbanking', 'wallet'][k % 4 + 1] AS method,
  CASE WHEN k % 5 = 0 THEN 'INTERNAL_SYSTEM' WHEN k % 5 = 1 THEN 'PROVIDER_API' ELSE 'PROVIDER_WEBHOOK' END AS source_type,
  observed_us, observed_us + (k % 7) * 1000000 AS received_us,
  observed_us + (k % 7 + k % 12) * 1000000 AS processed_us,
  CASE WHEN k % 17 = 0 THEN observed_us + 3 * 86400000000 END AS expires_us,
  CASE WHEN k % 25 = 0 THEN 'FAILED' WHEN k % 25 = 1 THEN 'RECEIVED' ELSE 'PROCESSED' END AS processing_status,
  k % 6 AS retry_count,
  CASE WHEN event_type = 'error' AND k % 16 <> 5
       THEN 'Bank replied: ' || {FAIL_LIST}[k % 10 + 1] || ' (code ' || k || ')' END AS error_text
FROM v_raw""")
view("v_norm", f"""
SELECT *, CASE WHEN event_type = 'order.paid' THEN 'order' ELSE 'payment' END AS entity_type,
  CASE WHEN event_type = 'order.paid' THEN order_id ELSE payment_id END AS entity_id,
  {case('event_type', V.EVENT_STATUS)} AS status
FROM v_ev WHERE event_type IN {inlist(V.SUPPORTED_EVENTS)}""")
view("v_deliveries", """
SELECT event_id * 2 + d AS webhook_event_id, CASE WHEN k % 23 <> 0 THEN provider_event_id END AS provider_event_id,
  event_type, payment_id, processing_status, k, received_us + d * 60000000 AS received_us
FROM v_ev JOIN (SELECT * FROM (VALUES (0), (1)) t(d)) ON d = 0 OR k % 9 = 0""")
# the fold, written as its definition: a status sticks when it is the first of the top rank or strictly latest so far
view("v_fold_rows", f"""
SELECT *, {case('status', V.STATUS_RANK, '0')} :: BIGINT AS rank,
  row_number() OVER (PARTITION BY payment_id ORDER BY received_us, event_id) AS arrival,
  max(observed_us) OVER (PARTITION BY payment_id ORDER BY received_us, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_before
FROM v_norm""")
view("v_pay_status", """
SELECT payment_id, arg_max(status, arrival) AS status, bool_or(status = 'captured') AS captured FROM (
  SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY arrival) AS nth FROM (
    SELECT *, max(rank) OVER (PARTITION BY payment_id) AS top FROM v_fold_rows) WHERE rank = top)
WHERE nth = 1 OR observed_us > seen_before GROUP BY 1""")
view("v_payments", """
SELECT f.payment_id, any_value(s.status) AS status, any_value(s.captured) AS captured,
  arg_min(order_id, arrival) FILTER (WHERE order_id <> '') AS order_id,
  arg_min(customer_id, arrival) FILTER (WHERE customer_id <> '') AS customer_id,
  coalesce(arg_min(amount_minor, arrival) FILTER (WHERE amount_minor <> 0), max(amount_minor) FILTER (WHERE arrival = 1)) AS amount_minor,
  arg_min(currency, arrival) FILTER (WHERE currency <> '') AS currency,
  arg_min(method, arrival) FILTER (WHERE method <> '') AS method,
  min(observed_us) AS first_us, max(observed_us) AS last_us, count(*) AS event_count
FROM v_fold_rows f JOIN v_pay_status s ON s.payment_id = f.payment_id GROUP BY 1""")
view("v_obs", """
SELECT event_id * 16 + slot AS evidence_id, evidence_type, subject_type, subject_id, value, value_type, source_type,
  CAST(event_id AS VARCHAR) AS source_reference, event_type, event_id AS webhook_event_id, event_id AS payment_event_id,
  observed_us, expires_us AS valid_until_us,
  CASE WHEN subject_type = 'order' AND k % 2 = 0 THEN payment_id END AS prov_payment_id
FROM (
  SELECT *, 0 AS slot, 'PAYMENT_EVENT' AS evidence_type, 'payment' AS subject_type, payment_id AS subject_id, event_type AS value, 'ENUM' AS value_type FROM v_norm
  UNION ALL SELECT *, 1, 'PAYMENT_STATUS', 'payment', payment_id, status, 'ENUM' FROM v_norm
  UNION ALL SELECT *, 2, 'PAYMENT_AMOUNT', 'payment', payment_id, CAST(amount_minor AS VARCHAR), 'INTEGER_MINOR_UNITS' FROM v_norm
  UNION ALL SELECT *, 3, 'PAYMENT_CURRENCY', 'payment', payment_id, currency, 'STRING' FROM v_norm
  UNION ALL SELECT *, 4, 'PAYMENT_METHOD', 'payment', payment_id, method, 'ENUM' FROM v_norm
  UNION ALL SELECT *, 5, 'PAYMENT_ORDER_RELATIONSHIP', 'payment', payment_id, order_id, 'STRING' FROM v_norm
  UNION ALL SELECT *, 6, 'ORDER_STATUS', 'order', order_id, 'paid', 'ENUM' FROM v_norm WHERE entity_type = 'order' AND order_id IS NOT NULL
  UNION ALL SELECT *, 7, 'ORDER_AMOUNT', 'order', order_id, CAST(amount_minor AS VARCHAR), 'INTEGER_MINOR_UNITS' FROM v_norm WHERE entity_type = 'order' AND order_id IS NOT NULL
  UNION ALL SELECT *, 8, 'ORDER_CURRENCY', 'order', order_id, currency, 'STRING' FROM v_norm WHERE entity_type = 'order' AND order_id IS NOT NULL
) WHERE value IS NOT NULL""")
view("v_pobs", "SELECT *, subject_id AS payment_id FROM v_obs WHERE subject_type = 'payment'")
view("v_claim_rows", f"""
SELECT *, sha256(concat_ws('|', subject_type, subject_id, claim_type, claim_key, canonical_value)) AS claim_id FROM (
  SELECT *, {case('evidence_type', {t: c[0] for t, c in V.CLAIM_OF.items()})} AS claim_type,
    {case('evidence_type', {t: c[1] for t, c in V.CLAIM_OF.items()})} AS claim_key,
    CASE {case('evidence_type', {t: c[2] for t, c in V.CLAIM_OF.items()})}
      WHEN 'lower' THEN lower(trim(value)) WHEN 'upper' THEN upper(trim(value)) ELSE trim(value) END AS canonical_value
  FROM v_obs WHERE value <> '')""")
view("v_claims", """
SELECT claim_id, subject_type, subject_id, claim_type, claim_key, canonical_value, count(*) AS observation_count,
  count(DISTINCT source_type) AS n_sources, count(DISTINCT payment_event_id) AS n_events,
  count(DISTINCT webhook_event_id) AS n_webhooks, count(DISTINCT observed_us) AS n_times,
  min(observed_us) AS earliest_us, max(observed_us) AS latest_us
FROM v_claim_rows GROUP BY ALL""")
view("v_pclaims", "SELECT *, subject_id AS payment_id FROM v_claims WHERE subject_type = 'payment'")
# every conflicting pair of claims, as the definition has it
view("v_states", f"""
SELECT *, CASE canonical_value WHEN 'paid' THEN 'captured' ELSE canonical_value END AS st
FROM v_pclaims WHERE claim_type = 'PAYMENT_STATUS' AND claim_key = 'STATUS'""")
FORWARD = " OR ".join(f"(a.st = '{x}' AND b.st = '{y}')" for x, y in V.VALID_TRANSITIONS)
TERMINAL = inlist(V.TERMINAL_STATES)
TRANSITION = f"""CASE WHEN a.st = b.st THEN 'SAME_STATE' WHEN {FORWARD} THEN 'VALID_FORWARD'
  WHEN a.st IN {TERMINAL} AND b.st IN {TERMINAL} THEN 'CONTRADICTORY_TERMINAL' ELSE 'INVALID_BACKWARD' END"""
view("v_status_conflicts", f"""
SELECT *, CASE WHEN transition_type = 'CONTRADICTORY_TERMINAL' THEN 'HIGH' WHEN near THEN 'INFO' ELSE 'MEDIUM' END AS severity,
  CASE WHEN transition_type = 'CONTRADICTORY_TERMINAL' THEN 'STATE_CONFLICT' WHEN near THEN 'ORDERING_AMBIGUITY' ELSE 'TEMPORAL_CONFLICT' END AS conflict_type
FROM (SELECT a.payment_id, least(a.claim_id, b.claim_id) AS claim_a_id, greatest(a.claim_id, b.claim_id) AS claim_b_id,
    a.canonical_value AS from_value, b.canonical_value AS to_value, b.earliest_us - a.earliest_us AS delta_us,
    b.earliest_us - a.earliest_us <= {V.CLOCK_TOLERANCE_US} AS near, {TRANSITION} AS transition_type
  FROM v_states a JOIN v_states b ON a.payment_id = b.payment_id AND (a.earliest_us, a.claim_id) < (b.earliest_us, b.claim_id))
WHERE near OR transition_type NOT IN ('SAME_STATE', 'VALID_FORWARD')""")
view("v_value_pairs", """
SELECT a.payment_id, a.claim_type, a.claim_id AS claim_a_id, b.claim_id AS claim_b_id,
  CASE WHEN a.claim_type = 'ORDER_ASSOCIATION' THEN 'RELATIONSHIP_CONFLICT' ELSE 'VALUE_CONFLICT' END AS conflict_type, 'HIGH' AS severity
FROM v_pclaims a JOIN v_pclaims b ON a.payment_id = b.payment_id AND a.claim_type = b.claim_type AND a.claim_id < b.claim_id
WHERE a.claim_type IN ('PAYMENT_AMOUNT', 'PAYMENT_CURRENCY', 'ORDER_ASSOCIATION')""")
view("v_conflict_pairs", """
SELECT payment_id, claim_a_id, claim_b_id, conflict_type, severity FROM v_status_conflicts
UNION ALL SELECT payment_id, claim_a_id, claim_b_id, conflict_type, severity FROM v_value_pairs""")
view("v_fact_rows", f"""
SELECT *, sha256(concat_ws('|', payment_id, fact_type, canonical_value)) AS fact_hash FROM (
  SELECT *, coalesce({case('evidence_type', V.FACT_OF_ATTRIBUTE)}, {case('event_type', V.FACT_OF_EVENT)}, 'PAYMENT_STATUS_OBSERVED') AS fact_type,
    CASE WHEN value_type = 'ENUM' THEN lower(trim(value)) ELSE trim(value) END AS canonical_value
  FROM v_pobs)""")
view("v_facts", """
SELECT payment_id, fact_type, canonical_value, fact_hash, min(observed_us) AS first_us, max(observed_us) AS last_us,
  count(*) AS observation_count, greatest(count(DISTINCT source_type), 1) AS distinct_source_count,
  min(evidence_id) AS first_evidence_id
FROM v_fact_rows GROUP BY ALL""")
view("v_fact_pairs", f"""
SELECT a.payment_id, a.evidence_id AS observation_a_id, b.evidence_id AS observation_b_id,
  CASE WHEN a.webhook_event_id = b.webhook_event_id AND a.fact_hash = b.fact_hash THEN 'SAME_FACT'
       WHEN a.webhook_event_id = b.webhook_event_id AND a.fact_type <> b.fact_type THEN 'RELATED_FACT'
       WHEN a.fact_type <> b.fact_type AND a.fact_type IN {inlist(V.LIFECYCLE_FACTS)} AND b.fact_type IN {inlist(V.LIFECYCLE_FACTS)} THEN 'RELATED_FACT'
       WHEN a.fact_type = b.fact_type AND a.canonical_value <> b.canonical_value THEN 'CONFLICTING_FACT'
       WHEN a.fact_type = b.fact_type AND abs(a.observed_us - b.observed_us) <= {V.RECONCILIATION_WINDOW_US} THEN 'SAME_FACT'
       WHEN a.fact_type = b.fact_type THEN 'UNKNOWN' ELSE 'DIFFERENT_FACT' END AS result,
  CASE WHEN a.webhook_event_id = b.webhook_event_id AND a.fact_hash = b.fact_hash THEN 'SAME_PROVIDER_EVENT_V1'
       WHEN a.webhook_event_id = b.webhook_event_id AND a.fact_type <> b.fact_type THEN 'DIFFERENT_LIFECYCLE_V1'
       WHEN a.fact_type <> b.fact_type AND a.fact_type IN {inlist(V.LIFECYCLE_FACTS)} AND b.fact_type IN {inlist(V.LIFECYCLE_FACTS)} THEN 'DIFFERENT_LIFECYCLE_V1'
       WHEN a.fact_type = b.fact_type AND a.canonical_value <> b.canonical_value THEN 'CONFLICTING_VALUE_V1'
       WHEN a.fact_type = b.fact_type AND abs(a.observed_us - b.observed_us) <= {V.RECONCILIATION_WINDOW_US} THEN 'SAME_FACT_DIFFERENT_SOURCE_V1'
       WHEN a.fact_type = b.fact_type THEN 'TEMPORAL_AMBIGUITY_V1' ELSE 'INSUFFICIENT_INFORMATION_V1' END AS rule_id
FROM v_fact_rows a JOIN v_fact_rows b ON a.payment_id = b.payment_id AND a.evidence_id < b.evidence_id""")
