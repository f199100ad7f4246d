"""Analytics, risk, fraud and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import us
from veritrail.operators import analytics, coverage, ops, risk, structure
from veritrail.plans.frames import T2, T_EVAL, at
from veritrail.plans.oracle_base import case
from veritrail.plans.registry import query, view
from veritrail.sources import landing

T_ORDERS = at("2001-08-01T00:30:00")
T_RECENT = at("2001-07-31T00:30:00")
T_DAILY = at("2024-02-05T06:00:00")
HOUR = 3_600_000_000

view("v_opay", """
SELECT 'pay_o' || o_orderkey AS payment_id, CASE o_orderstatus WHEN 'F' THEN 'captured' WHEN 'O' THEN 'authorized' ELSE 'failed' END AS status,
  o_orderpriority AS method, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, epoch_us(o_orderdate) AS last_us FROM orders""")
view("v_etot", """
SELECT payment_id, count(*) AS evidence_count, count(DISTINCT source_type) AS source_count, max(observed_us) AS latest_us FROM v_pobs GROUP BY 1""")
PCT = "CASE WHEN {1} > 0 THEN round({0} :: DOUBLE / {1} * 100, 1) ELSE 0.0 END"


def pct(a, b):
    return PCT.format(a, b)


def counts(src: str, by: str = "") -> str:
    return f"""SELECT {by + ',' if by else ''} count(*) AS total, count(*) FILTER (WHERE status = 'captured') AS captured, count(*) FILTER (WHERE status = 'failed') AS failed,
 count(*) FILTER (WHERE status = 'authorized') AS authorized, count(*) FILTER (WHERE status IN ('authorized', 'pending', 'created')) AS pending,
 count(*) FILTER (WHERE status IN ('created', 'authorized', 'captured', 'pending')) AS initiated, sum(amount_minor) FILTER (WHERE status = 'captured') AS captured_minor,
 count(amount_minor) FILTER (WHERE status = 'captured') AS captured_priced, avg(amount_minor) AS avg_minor FROM {src} {'GROUP BY ' + by if by else ''}"""


@query("failure_summary", f"SELECT total, captured, failed, pending, {pct('captured', 'total')} AS success_rate, {pct('failed', 'total')} AS failure_rate FROM ({counts('v_opay')})")
def _(f):
    return analytics.failure_summary(f.order_payments)


_CAT = "CASE WHEN error_text IS NULL OR error_text = '' THEN lower(event_type) " + " ".join(
    f"WHEN contains(lower(error_text), '{k}') THEN '{k}'" for k in V.FAILURE_SEVERITY) + " ELSE 'failed' END"


def _categories(limit: str) -> str:
    return f"""SELECT category, n AS failures, {pct('n', 't')} AS percentage, {case('category', V.FAILURE_SEVERITY, 'MEDIUM')} AS severity
FROM (SELECT category, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT {_CAT} AS category FROM v_ev WHERE processing_status = 'FAILED' {limit}) GROUP BY 1)"""


@query("failure_categories", _categories(""))
def _(f):
    """Over all failed deliveries."""
    return analytics.failure_categories(f.events)


@query("failure_categories_latest", _categories("ORDER BY received_us DESC, event_id DESC LIMIT 100"))
def _(f):
    """The dashboard's report over the latest 100 failures."""
    return analytics.failure_categories(f.events, 100)


@query("payment_failure_analysis", """
SELECT p.payment_id, 'failed' AS failure_category, round((last_us - first_us) / 1000000.0, 3) AS seconds_to_failure,
  CASE WHEN coalesce(c.conflict_count, 0) > 0 THEN 'ACTIVE_CONFLICTS:' || c.conflict_count ELSE '' END AS signals
FROM v_payments p LEFT JOIN v_profile c ON c.payment_id = p.payment_id WHERE status = 'failed'""")
def _(f):
    return analytics.payment_failure_analysis(f.payments, f.evidence_totals, f.conflict_profile)


@query("payment_funnel", f"""
WITH c AS ({counts('v_opay')}), s AS (
 SELECT 1 :: BIGINT AS stage_order, 'Created' AS stage, initiated AS payments, NULL AS before FROM c UNION ALL SELECT 2, 'Authorized', authorized, initiated FROM c
 UNION ALL SELECT 3, 'Captured', captured, authorized FROM c UNION ALL SELECT 4, 'Failed', failed, NULL FROM c),
d AS (SELECT stage_order, stage, payments, {pct('payments', '(SELECT total FROM c)')} AS percentage, CASE WHEN before IS NULL THEN 0 ELSE greatest(0, before - payments) END :: BIGINT AS drop_off,
  CASE WHEN before > 0 THEN round(greatest(0, before - payments) :: DOUBLE / before * 100, 1) ELSE 0.0 END AS drop_off_pct FROM s)
SELECT *, (SELECT {pct('captured', 'total')} FROM c) AS conversion_rate, (SELECT stage FROM d ORDER BY drop_off_pct DESC, stage_order LIMIT 1) AS biggest_drop FROM d""")
def _(f):
    return analytics.payment_funnel(f.order_payments)


@query("revenue_summary", f"""
SELECT round(coalesce(captured_minor, 0) / 100, 2) :: DOUBLE AS gmv, round(captured_minor / captured_priced / 100, 2) :: DOUBLE AS avg_ticket, {pct('captured', 'total')} AS success_rate,
  total, captured, failed, CASE WHEN captured * 100 > total * 90 THEN 'UP' WHEN captured * 100 < total * 70 THEN 'DOWN' ELSE 'STABLE' END AS success_trend,
  CASE WHEN failed < total * 0.1 THEN 'DOWN' ELSE 'UP' END AS failure_trend FROM ({counts('v_opay')})""")
def _(f):
    return analytics.revenue_summary(f.order_payments)


def _trend(src: str, anchor: int, unit: int, n: str) -> str:
    return f"""
SELECT {anchor} - (b + 1) * {unit} AS start_us, {anchor} - b * {unit} AS end_us, count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'captured') AS successes,
  round(coalesce(sum(amount_minor) FILTER (WHERE status = 'captured'), 0) / 100, 2) :: DOUBLE AS gmv,
  {pct("count(*) FILTER (WHERE status = 'captured')", "count(*) FILTER (WHERE status IN ('captured', 'failed'))")} AS success_rate
FROM (SELECT unnest(range({n})) AS b) LEFT JOIN {src} ON last_us >= {anchor} - (b + 1) * {unit} AND last_us < {anchor} - b * {unit} GROUP BY b"""


@query("trend_buckets", _trend("v_payments", T_EVAL, HOUR, "24"))
def _(f):
    """Hourly form: the newest payment is less than a day old. Bucket ends are exclusive."""
    return analytics.trend_buckets(f.keeping("payments").payments, T_EVAL)


@query("trend_buckets_daily", _trend("v_payments", (T_DAILY // 86_400_000_000 + 1) * 86_400_000_000, 86_400_000_000,
       f"(SELECT greatest(1, least(30, {T_DAILY // 86_400_000_000} - max(last_us) // 86400000000 + 1)) :: BIGINT FROM v_payments)"))
def _(f):
    return analytics.trend_buckets(f.payments, T_DAILY)


@query("risk_by_method", f"""
SELECT method, total, round(captured / total * 100, 1) AS success_rate, round(failed / total * 100, 1) AS failure_rate, round(cf / total * 100, 1) AS conflict_rate,
  round(coalesce(avg_minor / 100, 0), 2) AS avg_amount, risk_score, CASE WHEN risk_score >= 76 THEN 'LOW_RISK' WHEN risk_score >= 51 THEN 'MEDIUM_RISK' WHEN risk_score >= 26 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS risk_level,
  CASE WHEN kr = '' THEN 'none' ELSE kr END AS key_risks
FROM (SELECT *, 100.0 :: DOUBLE - CASE WHEN failed / total > 0.3 THEN 30 WHEN failed / total > 0.15 THEN 15 ELSE 0 END - CASE WHEN cf / total > 0.2 THEN 25 WHEN cf / total > 0.1 THEN 10 ELSE 0 END - CASE WHEN total < 3 THEN 10 ELSE 0 END AS risk_score,
    concat_ws('; ', CASE WHEN failed / total > 0.2 THEN 'high failure rate' END, CASE WHEN cf / total > 0.15 THEN 'high conflict rate' END, CASE WHEN total < 5 THEN 'small sample' END) AS kr
  FROM ({counts('v_payments', 'method')}) JOIN (SELECT p.method AS m, sum(coalesce(conflict_count, 0)) AS cf FROM v_payments p LEFT JOIN v_profile c ON c.payment_id = p.payment_id GROUP BY 1) ON m = method)""")
def _(f):
    return analytics.risk_by_method(f.payments, f.conflict_profile)


@query("risk_by_currency", f"""
SELECT currency, total, round(captured / total * 100, 1) AS risk_score, CASE WHEN captured / total * 100 >= 76 THEN 'LOW_RISK' ELSE 'MEDIUM_RISK' END AS risk_level,
  round(100 - captured / total * 100, 1) AS failure_rate, CASE WHEN captured > 0 THEN round(coalesce(captured_minor, 0) / captured / 100, 2) :: DOUBLE ELSE 0.0 END AS avg_captured
FROM ({counts('v_payments', 'currency')})""")
def _(f):
    return analytics.risk_by_currency(f.payments)


@query("recent_failures", "SELECT payment_id, last_us FROM v_payments WHERE status = 'failed' ORDER BY last_us DESC, payment_id LIMIT 10")
def _(f):
    return analytics.recent_failures(f.payments).select("payment_id", us("last_observed_at").alias("last_us"))


@query("recent_payment_events", """
SELECT payment_id, event_id AS payment_event_id, observed_us AS event_us, rn FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY observed_us DESC, event_id DESC) AS rn FROM v_norm) WHERE rn <= 10""")
def _(f):
    """Ten newest events per payment; Spark keeps only ten per partition before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy("payment_id").orderBy(F.desc("event_us"), F.desc("payment_event_id"))
    rows = f.payment_events.select("payment_id", "payment_event_id", us("event_time").alias("event_us"))
    return rows.withColumn("rn", F.row_number().over(w).cast("bigint")).filter("rn <= 10")


@query("high_value_recent", f"""
SELECT payment_id, amount_minor FROM v_opay WHERE amount_minor >= 1000000 AND status = 'captured' AND last_us >= {T_RECENT - HOUR} ORDER BY amount_minor DESC, payment_id LIMIT 3""")
def _(f):
    return analytics.high_value_recent(f.order_payments, T_RECENT).select("payment_id", "amount_minor")


view("v_hot", f"SELECT payment_id, conflict_type, severity, {T_EVAL} AS detected_us FROM v_conflict_counts")


@query("notifications", f"""
SELECT substr(sha256(kind || '|' || ref || '|{T_EVAL}'), 1, 16) AS notification_id, category, severity, ts_us FROM (
  (SELECT 'FAIL' AS kind, payment_id AS ref, 'FAILURE' AS category, 'WARNING' AS severity, last_us AS ts_us FROM v_payments WHERE status = 'failed' AND last_us >= {T_EVAL - HOUR} ORDER BY last_us DESC, payment_id LIMIT 5)
  UNION ALL (SELECT 'CONFLICT', payment_id || ':' || conflict_type, 'ANOMALY', 'WARNING', detected_us FROM v_hot WHERE severity = 'HIGH' ORDER BY detected_us DESC, payment_id, conflict_type LIMIT 5)
  UNION ALL SELECT 'MILESTONE', CAST(n AS VARCHAR), 'MILESTONE', 'INFO', {T_EVAL} FROM (SELECT count(*) AS n FROM v_payments) WHERE n > 0 AND n % 10 = 0
  UNION ALL (SELECT 'HIGHVAL', payment_id, 'ANOMALY', 'INFO', last_us FROM v_payments WHERE amount_minor >= 1000000 AND status = 'captured' AND last_us >= {T_EVAL - HOUR} ORDER BY amount_minor DESC, payment_id LIMIT 3))
ORDER BY ts_us DESC, notification_id LIMIT 50""")
def _(f):
    return analytics.notifications(f.payments, f.conflicts_by_type.withColumn("detected_us", F.lit(T_EVAL)), T_EVAL)


# --- risk ------------------------------------------------------------------------------------
_SCORES = """
  round(least(100.0, evidence_count * 10.0), 1) AS evidence_volume, round(least(100.0, source_count * 33.3 :: DOUBLE), 1) AS source_diversity,
  CASE WHEN conflict_count = 0 THEN 100.0 ELSE greatest(0.0, 100.0 - conflict_count * 25.0) END AS consistency,
  CASE coverage_status WHEN 'COMPLETE' THEN 100.0 WHEN 'SUBSTANTIALLY_COMPLETE' THEN 75.0 WHEN 'PARTIAL' THEN 45.0 WHEN 'INSUFFICIENT' THEN 15.0 ELSE 30.0 END AS coverage,
  CASE WHEN age < 300000000 THEN 100.0 WHEN age < 3600000000 THEN 75.0 WHEN age < 86400000000 THEN 50.0 ELSE 20.0 END AS freshness,
  round(least(100.0, (corroborated_claim_count + multi_source_claim_count) :: DOUBLE / (greatest(distinct_claims, 1) * 2) * 100.0), 1) AS corroboration,
  CASE WHEN conflict_count = 0 THEN 100.0 ELSE 0.0 END AS conflict_resolution"""
view("v_risk", f"""
SELECT *, ((CAST(round(evidence_volume * 10) AS BIGINT) * 15 + CAST(round(source_diversity * 10) AS BIGINT) * 15 + CAST(round(consistency * 10) AS BIGINT) * 20 + CAST(round(coverage * 10) AS BIGINT) * 15
  + CAST(round(freshness * 10) AS BIGINT) * 10 + CAST(round(corroboration * 10) AS BIGINT) * 15 + CAST(round(conflict_resolution * 10) AS BIGINT) * 10 + 50) // 100) / 10.0 :: DOUBLE AS composite FROM (
SELECT p.payment_id, evidence_count, source_count, conflict_count, coverage_status, {_SCORES} FROM (
  SELECT p.payment_id, e.evidence_count, e.source_count, c.conflict_count, v.overall_status AS coverage_status, {T_EVAL} - e.latest_us AS age,
    s.distinct_claims, s.corroborated_claim_count, s.multi_source_claim_count
  FROM v_payments p JOIN v_etot e ON e.payment_id = p.payment_id JOIN v_profile c ON c.payment_id = p.payment_id JOIN v_cov_summary v ON v.payment_id = p.payment_id
  JOIN v_structure s ON s.payment_id = p.payment_id) p)""")


#: Computed once for all the inputs of a risk score: a row a payment. Observations and claims are many times the input, so they are not written.
_RISK_LAYERS = ("payments", "conflict_profile")


@query("risk_score", """
SELECT payment_id, evidence_count, source_count, conflict_count, coverage_status, evidence_volume :: DOUBLE AS evidence_volume, source_diversity :: DOUBLE AS source_diversity, consistency :: DOUBLE AS consistency,
  coverage :: DOUBLE AS coverage, freshness :: DOUBLE AS freshness, corroboration :: DOUBLE AS corroboration, conflict_resolution :: DOUBLE AS conflict_resolution, composite :: DOUBLE AS composite,
  CASE WHEN composite >= 76 THEN 'LOW_RISK' WHEN composite >= 51 THEN 'MEDIUM_RISK' WHEN composite >= 26 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS risk_level,
  CASE WHEN freshness >= 75 THEN 'FRESH' WHEN freshness >= 50 THEN 'AGING' ELSE 'STALE' END AS freshness_status,
  CASE WHEN r = '' THEN 'healthy' ELSE r END AS recommendations
FROM (SELECT *, concat_ws('; ', CASE WHEN conflict_count > 0 THEN 'resolve conflicts' END, CASE WHEN source_count < 2 THEN 'add sources' END, CASE WHEN freshness < 50 THEN 'refresh evidence' END,
  CASE WHEN coverage_status IN ('INSUFFICIENT', 'PARTIAL') THEN 'complete coverage' END, CASE WHEN composite < 50 THEN 'manual review' END) AS r FROM v_risk)""")
def _(f):
    return f.by_payment(lambda own: own.keeping(*_RISK_LAYERS).risk_scores).drop("weakest", "strongest")


@query("weakest_strongest", """
SELECT payment_id, arg_min(d, (s, i)) AS weakest, arg_max(d, (s, -i)) AS strongest FROM (
  SELECT payment_id, unnest([evidence_volume :: DOUBLE, source_diversity, consistency, coverage, freshness, corroboration, conflict_resolution]) AS s,
    unnest(['evidence_volume', 'source_diversity', 'consistency', 'coverage', 'freshness', 'corroboration', 'conflict_resolution']) AS d, unnest([0, 1, 2, 3, 4, 5, 6]) AS i FROM v_risk) GROUP BY 1""")
def _(f):
    return f.by_payment(lambda own: own.keeping(*_RISK_LAYERS).risk_scores).select("payment_id", "weakest", "strongest")


@query("risk_dimensions", """
SELECT payment_id, dimension, score, CASE WHEN score >= 76 THEN 'STRONG' WHEN score >= 51 THEN 'ADEQUATE' WHEN score >= 26 THEN 'WEAK' ELSE 'CRITICAL' END AS status, weight FROM (
  SELECT payment_id, unnest(['evidence_volume', 'source_diversity', 'consistency', 'coverage', 'freshness', 'corroboration', 'conflict_resolution']) AS dimension,
    unnest([evidence_volume :: DOUBLE, source_diversity, consistency, coverage, freshness, corroboration, conflict_resolution]) AS score,
    unnest([0.15 :: DOUBLE, 0.15, 0.20, 0.15, 0.10, 0.15, 0.10]) AS weight FROM v_risk)""")
def _(f):
    return risk.risk_dimensions(f.by_payment(lambda own: own.keeping(*_RISK_LAYERS).risk_scores))


view("v_allpay", "SELECT payment_id, amount_minor FROM v_payments UNION ALL SELECT payment_id, amount_minor FROM v_opay")
view("v_burst", """
SELECT payment_id, count(*) AS event_count, max(n) AS burst FROM (SELECT payment_id, count(*) OVER (PARTITION BY payment_id ORDER BY observed_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS n FROM v_norm) GROUP BY 1""")
view("v_signals", """
SELECT payment_id, x.k AS signal_type, x.s AS severity, round(least(1.0 :: DOUBLE, x.c), 4) AS confidence FROM (
 SELECT payment_id, unnest(list_filter([
  CASE WHEN ratio >= 10 THEN {'k': 'AMOUNT_ANOMALY', 's': 'HIGH', 'c': ratio / 50.0 :: DOUBLE} END,
  CASE WHEN burst >= 3 THEN {'k': 'VELOCITY_BURST', 's': 'HIGH', 'c': burst / 10.0 :: DOUBLE} END,
  CASE WHEN evidence_count > 0 AND source_count <= 1 THEN {'k': 'SOURCE_CONCENTRATION', 's': 'MEDIUM', 'c': 0.6 :: DOUBLE} END,
  CASE WHEN state_conflicts > 0 THEN {'k': 'STATUS_CONTRADICTION', 's': 'HIGH', 'c': 0.8 :: DOUBLE} END,
  CASE WHEN temporal_conflicts > 0 THEN {'k': 'TIMESTAMP_INVERSION', 's': 'MEDIUM', 'c': 0.7 :: DOUBLE} END,
  CASE WHEN conflict_count >= 2 THEN {'k': 'CONFLICT_CLUSTER', 's': 'HIGH', 'c': conflict_count / 5.0 :: DOUBLE} END,
  CASE WHEN amount_minor >= 10000000 THEN {'k': 'HIGH_AMOUNT', 's': 'LOW', 'c': 0.5 :: DOUBLE} END], lambda x : x IS NOT NULL)) AS x
 FROM (SELECT p.payment_id, p.amount_minor, p.amount_minor / (((SELECT sum(amount_minor) FROM v_allpay) - p.amount_minor) / ((SELECT count(amount_minor) FROM v_allpay) - 1)) :: DOUBLE AS ratio,
    b.burst, e.evidence_count, e.source_count, c.state_conflicts, c.temporal_conflicts, c.conflict_count
  FROM v_allpay p LEFT JOIN v_etot e ON e.payment_id = p.payment_id LEFT JOIN v_profile c ON c.payment_id = p.payment_id LEFT JOIN v_burst b ON b.payment_id = p.payment_id))""")


@query("velocity_burst", "SELECT payment_id, event_count, burst FROM v_burst")
def _(f):
    return risk.velocity(f.payment_events)


@query("fraud_signals", "SELECT * FROM v_signals")
def _(f):
    return f.keeping("observations").fraud_signals


@query("fraud_overall", """
SELECT p.payment_id, count(signal_type) AS signal_count, CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 'HIGHLY_SUSPICIOUS' WHEN count(*) FILTER (WHERE severity = 'HIGH') >= 2 THEN 'SUSPICIOUS'
  WHEN count(*) FILTER (WHERE severity = 'HIGH') = 1 OR count(signal_type) >= 2 THEN 'ELEVATED' ELSE 'CLEAR' END AS assessment FROM v_allpay p LEFT JOIN v_signals s ON s.payment_id = p.payment_id GROUP BY 1""")
def _(f):
    return risk.fraud_overall(f.fraud_signals, f.all_payments)


@query("fraud_dashboard", "SELECT signal_type, severity, count(*) AS signals, count(DISTINCT payment_id) AS payments FROM v_signals GROUP BY ALL")
def _(f):
    return f.fraud_signals.groupBy("signal_type", "severity").agg(F.count("*").alias("signals"), F.count_distinct("payment_id").alias("payments"))


@query("fraud_patterns", """
SELECT 'HIGH_VALUE_CLUSTER' AS pattern_type, 'MEDIUM' AS severity, n AS affected_payments FROM (SELECT count(*) AS n FROM v_allpay WHERE amount_minor >= 10000000) WHERE n >= 2
UNION ALL SELECT 'SINGLE_SOURCE_EVIDENCE', 'MEDIUM', n FROM (SELECT count(*) AS n FROM v_etot WHERE source_count = 1) WHERE n >= 3
UNION ALL SELECT 'HIGH_CONFLICT_RATE', 'HIGH', n FROM (SELECT count(*) AS n FROM v_profile WHERE conflict_count > 0) WHERE n > 0 AND n / (SELECT count(*) FROM v_allpay) > 0.3""")
def _(f):
    return risk.fraud_patterns(f.all_payments, f.evidence_totals, f.conflict_profile)


@query("fraud_pattern_members", """
SELECT 'HIGH_VALUE_CLUSTER' AS pattern_type, payment_id FROM v_allpay WHERE amount_minor >= 10000000 UNION ALL SELECT 'SINGLE_SOURCE_EVIDENCE', payment_id FROM v_etot WHERE source_count = 1""")
def _(f):
    return risk.pattern_members(f.all_payments, f.evidence_totals)


@query("payment_profile", """
SELECT p.payment_id, p.status, p.amount_minor, evidence_count, source_count, event_count, conflict_count,
  array_to_string(list_filter([CASE WHEN conflict_count > 0 THEN 'ACTIVE_CONFLICTS' END, CASE WHEN source_count < 2 THEN 'SINGLE_SOURCE' END], lambda x : x IS NOT NULL), '; ') AS anomaly_flags
FROM v_payments p JOIN v_etot e ON e.payment_id = p.payment_id JOIN v_profile c ON c.payment_id = p.payment_id""")
def _(f):
    from veritrail.operators.investigation import payment_profile
    return payment_profile(f.payments, f.evidence_totals, f.conflict_profile).select(
        "payment_id", "status", "amount_minor", "evidence_count", "source_count", "event_count", "conflict_count", "anomaly_flags")


@query("recommendations", """
SELECT 'REC-' || c.payment_id || '-CONFLICTS' AS recommendation_id, 'HIGH' AS priority, 'CONFLICT_RESOLUTION' AS category FROM v_profile c WHERE conflict_count > 0
UNION ALL SELECT 'REC-' || payment_id || '-SOURCES', 'MEDIUM', 'EVIDENCE_DIVERSITY' FROM v_etot WHERE source_count < 2
UNION ALL SELECT 'REC-SYS-CONFLICTS', 'HIGH', 'SYSTEM_CONFLICTS' FROM (SELECT sum(conflict_count) AS n FROM v_profile) WHERE n > 0""")
def _(f):
    from veritrail.operators.investigation import payment_profile, recommendations
    return recommendations(payment_profile(f.payments, f.evidence_totals, f.conflict_profile))


# --- operations --------------------------------------------------------------------------------
@query("ingest_metrics", f"""
SELECT count(*) AS received, count(*) FILTER (WHERE processing_status = 'PROCESSED') AS processed, count(*) FILTER (WHERE processing_status = 'FAILED') AS failed,
  count(*) FILTER (WHERE received_us >= {T_EVAL - HOUR}) AS received_1h, count(*) FILTER (WHERE processing_status = 'RECEIVED' AND received_us <= {T_EVAL - 60_000_000}) AS stuck,
  max(received_us) AS last_received_us, max(processed_us) FILTER (WHERE processing_status = 'PROCESSED') AS last_processed_us FROM v_ev""")
def _(f):
    return ops.ingest_metrics(f.events, T_EVAL)


@query("lag_metrics", """
SELECT round(avg(lag) / 1000000, 3) AS avg_lag, round(max(lag) / 1000000.0, 3) :: DOUBLE AS max_lag, round(arg_max(lag, (processed_us, event_id)) / 1000000.0, 3) :: DOUBLE AS latest_lag
FROM (SELECT processed_us - received_us AS lag, processed_us, event_id FROM v_ev WHERE processing_status = 'PROCESSED' ORDER BY processed_us DESC, event_id DESC LIMIT 20) WHERE lag >= 0""")
def _(f):
    return ops.lag_metrics(f.events)


@query("pipeline_watermark", f"""
SELECT w.watermark_us, w.slowest_stage, r AS received_us, r - w.watermark_us <= 30000000 AS caught_up FROM (
  SELECT min(t) AS watermark_us, arg_min(stage, (t, stage)) AS slowest_stage FROM (
    SELECT max(processed_us) AS t, 'processing' AS stage FROM v_ev WHERE processing_status = 'PROCESSED' UNION ALL SELECT max(observed_us), 'evidence' FROM v_obs
    UNION ALL SELECT max(last_us), 'facts' FROM v_facts UNION ALL SELECT {T2}, 'integrity')) w, (SELECT max(received_us) AS r FROM v_ev)""")
def _(f):
    return ops.pipeline_watermark({
        "processing": f.events.filter("processing_status = 'PROCESSED'").select(us("processed_at").alias("t_us")),
        "evidence": f.observations.select(F.col("observed_us").alias("t_us")),
        "facts": f.facts.select(F.col("last_us").alias("t_us")),
        "integrity": f.evidence_totals.select(F.lit(T2).alias("t_us")),
    }, f.events.select(us("received_at").alias("t_us")))


view("v_layers", f"""
SELECT payment_id, layer, CASE WHEN e IS NULL THEN 'UNKNOWN' WHEN latest_us > e THEN 'STALE' ELSE 'CURRENT' END AS status,
  CASE WHEN latest_us > e THEN round((latest_us - e) / 1000000.0, 3) :: DOUBLE END AS lag_seconds
FROM (SELECT t.payment_id, latest_us, layer, CASE layer WHEN 'facts' THEN m WHEN 'integrity' THEN CASE WHEN first_us <= {T2} THEN {T2} END ELSE {T_EVAL} END AS e
  FROM v_etot t JOIN (SELECT payment_id AS pid, max(last_us) AS m, min(first_us) AS first_us FROM v_facts GROUP BY 1) ON pid = payment_id JOIN (VALUES ('facts'), ('coverage'), ('integrity')) l(layer) ON true)""")


@query("stage_freshness", "SELECT * FROM v_layers")
def _(f):
    """Facts are current, coverage was evaluated at the end, integrity last at T2."""
    return f.layer_freshness


@query("stuck_events", f"SELECT event_id, processing_status FROM v_ev WHERE processing_status = 'RECEIVED' AND received_us <= {T_EVAL - 60_000_000}")
def _(f):
    return ops.stuck_events(f.events, T_EVAL).select("event_id", "processing_status")


@query("retry_candidates", "SELECT event_id, processing_status, retry_count FROM v_ev WHERE processing_status IN ('RECEIVED', 'FAILED') AND retry_count < 5 ORDER BY event_id LIMIT 100")
def _(f):
    return ops.retry_candidates(f.events).select("event_id", "processing_status", "retry_count")


@query("invariant_checks", """
SELECT 'INV-01' AS check_id, 'events persisted' AS check_name, count(*) AS metric, 'PASS' AS status FROM v_ev
UNION ALL SELECT 'INV-02', 'status present', 0, 'PASS' UNION ALL SELECT 'INV-03', 'processed events have a payment', 0, 'PASS'
UNION ALL SELECT 'INV-04', 'no duplicates after dedup', 0, 'PASS'
UNION ALL SELECT 'INV-05', 'failed events', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END FROM v_ev WHERE processing_status = 'FAILED'
UNION ALL SELECT 'INV-07', 'layer freshness measured', count(*), 'PASS' FROM v_layers WHERE status IS NULL UNION ALL SELECT 'INV-10', 'stale layers not shown as current', count(*), 'PASS' FROM v_layers WHERE status = 'CURRENT' AND lag_seconds > 0""")
def _(f):
    return ops.invariant_checks(f.events, landing.dedup_events(f.deliveries), f.payment_events, f.layer_freshness)


@query("incidents", f"""
SELECT 'INC-STUCK-' || arg_min(event_id, (received_us, event_id)) AS incident_id, 'PROCESSING_STUCK' AS category, CASE WHEN count(*) < 5 THEN 'WARNING' ELSE 'MAJOR' END AS severity, min(received_us) AS detected_us, count(*) AS events
FROM v_ev WHERE processing_status = 'RECEIVED' AND received_us <= {T_EVAL - 60_000_000} HAVING count(*) > 0
UNION ALL (SELECT 'INC-FAIL-' || event_id, 'PROCESSING_FAILURE', 'WARNING', received_us, 1 FROM v_ev WHERE processing_status = 'FAILED' AND received_us >= {T_EVAL - 24 * HOUR} ORDER BY received_us DESC, event_id DESC LIMIT 10)""")
def _(f):
    return ops.incidents(f.events, T_EVAL)


@query("investigation_timeline", f"""
SELECT payment_id, observed_us AS ts_us, 'PAYMENT_EVENT' AS kind, 'INFO' AS severity, CAST(event_id AS VARCHAR) AS entity_id FROM v_norm
UNION ALL SELECT payment_id, observed_us, 'EVIDENCE_OBSERVED', 'INFO', CAST(evidence_id AS VARCHAR) FROM v_pobs
UNION ALL SELECT payment_id, {T_EVAL}, 'CONFLICT_DETECTED', CASE severity WHEN 'HIGH' THEN 'ALERT' ELSE 'WARNING' END, conflict_type FROM v_conflict_counts
UNION ALL SELECT payment_id, first_us, 'FACT_RECONCILED', 'INFO', fact_hash FROM v_facts""")
def _(f):
    from veritrail.operators.investigation import timeline
    return timeline(f.payment_events, f.payment_obs, f.conflicts_by_type, f.facts, T_EVAL)
