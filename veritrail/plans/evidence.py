"""Quality, structure, conflicts, facts, coverage, reliability and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import skew
from veritrail.functions import vocab as V
from veritrail.operators import canonical, conflicts, coverage, facts, integrity, quality, relations, reliability, search, structure
from veritrail.plans.frames import EVAL_POINTS, MANY, T1, T_EVAL
from veritrail.plans.oracle_base import case, inlist
from veritrail.plans.registry import query, view

POINTS = ", ".join(f"({p})" for p in EVAL_POINTS)
POLICY = case("evidence_type", V.FRESHNESS_POLICY_OF, "DEFAULT")
CUR = case(POLICY, {p: c * 1_000_000 for p, (c, _) in V.FRESHNESS_POLICY.items()})
STALE = case(POLICY, {p: s * 1_000_000 for p, (_, s) in V.FRESHNESS_POLICY.items()})


def fresh(at: str) -> str:
    return f"""CASE WHEN observed_us > {at} THEN 'UNKNOWN' WHEN {at} - observed_us < {CUR} THEN 'CURRENT'
      WHEN {at} - observed_us < {STALE} THEN 'AGING' ELSE 'STALE' END"""


AUTH = "CASE WHEN source_type IN ('PROVIDER_WEBHOOK', 'PROVIDER_API') THEN 'PRIMARY' WHEN source_type = 'INTERNAL_SYSTEM' THEN 'SECONDARY' ELSE 'TERTIARY' END"
DIRECT = """CASE WHEN source_type = 'PROVIDER_WEBHOOK' THEN CASE WHEN evidence_type = 'PAYMENT_EVENT' THEN 'DIRECT' ELSE 'DERIVED' END
  WHEN source_type = 'PROVIDER_API' THEN 'DIRECT' WHEN source_type = 'INTERNAL_SYSTEM' THEN 'DERIVED' ELSE 'INFERRED' END"""


@query("freshness", f"""
SELECT evidence_id, {POLICY} AS freshness_policy_key, round(({T_EVAL} - observed_us) / 1000000.0, 3) AS age_seconds,
  {fresh(str(T_EVAL))} AS freshness_state FROM v_obs""")
def _(f):
    return quality.freshness(f.observations, T_EVAL).select(
        "evidence_id", "freshness_policy_key", F.round("age_seconds", 3).alias("age_seconds"), "freshness_state")


@query("source_quality", f"SELECT evidence_id, {AUTH} AS authority_level, {DIRECT} AS directness FROM v_obs")
def _(f):
    return quality.source_quality(f.observations).select("evidence_id", "authority_level", "directness")


view("v_outcomes", """
SELECT CASE WHEN quality = 1 THEN 'PAYMENT_STATUS' ELSE 'PAYMENT_AMOUNT' END AS evidence_type FROM labels
UNION ALL SELECT 'PAYMENT_METHOD' FROM labels WHERE toxic = 1 AND quality = 1""")


@query("historical_reliability", """
SELECT evidence_id, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_OUTCOME_DATA' WHEN n < 30 THEN 'INSUFFICIENT_SAMPLE' ELSE 'AVAILABLE' END AS reliability_status
FROM v_obs LEFT JOIN (SELECT evidence_type AS et, count(*) AS n FROM v_outcomes GROUP BY 1) ON et = evidence_type""")
def _(f):
    """Outcomes come from the label table: good and bad verdicts on two evidence types."""
    labels = f.table("labels")
    outcomes = labels.select(F.when(F.col("quality") == 1, "PAYMENT_STATUS").otherwise("PAYMENT_AMOUNT").alias("evidence_type")).unionByName(
        labels.filter("toxic = 1 AND quality = 1").select(F.lit("PAYMENT_METHOD").alias("evidence_type")))
    return quality.historical_reliability(f.observations, outcomes).select("evidence_id", "reliability_status")


view("v_quality", f"""
SELECT evidence_id, subject_type, subject_id, eval_us, {fresh('eval_us')} AS freshness_state, {AUTH} AS authority_level, {DIRECT} AS directness
FROM v_obs JOIN (VALUES {POINTS}) p(eval_us) ON observed_us <= eval_us""")


@query("quality_snapshot", "SELECT evidence_id, eval_us, freshness_state, authority_level, directness, 'NO_OUTCOME_DATA' AS reliability_status FROM v_quality")
def _(f):
    return quality.quality_snapshot(f.observations, EVAL_POINTS).select(
        "evidence_id", "eval_us", "freshness_state", "authority_level", "directness", "reliability_status")


@query("relationships", """
SELECT a.evidence_id AS source_id, b.evidence_id AS target_id, t AS relationship_type,
  CASE t WHEN 'SAME_SOURCE' THEN 'webhook_event_id' ELSE 'payment_event_id' END AS shared_field, CAST(a.payment_event_id AS VARCHAR) AS shared_value
FROM v_obs a JOIN v_obs b ON a.payment_event_id = b.payment_event_id AND a.evidence_id < b.evidence_id
JOIN (VALUES ('SAME_EVENT'), ('SAME_SOURCE')) k(t) ON true
UNION ALL SELECT a.evidence_id, b.evidence_id, 'DERIVED_FROM', 'payment_event_id', CAST(a.payment_event_id AS VARCHAR)
FROM v_obs a JOIN v_obs b ON a.payment_event_id = b.payment_event_id AND b.evidence_type = 'PAYMENT_EVENT'
 AND a.evidence_type IN ('PAYMENT_STATUS', 'PAYMENT_AMOUNT', 'PAYMENT_CURRENCY', 'PAYMENT_METHOD', 'PAYMENT_ORDER_RELATIONSHIP')""")
def _(f):
    return relations.event_edges(f.normalized)


@query("payment_relationships", """
SELECT a.payment_id, a.evidence_id, t AS relationship_type, count(*) AS partners
FROM v_pobs a JOIN v_pobs b ON a.payment_id = b.payment_id AND a.evidence_id <> b.evidence_id
JOIN (VALUES ('SAME_PAYMENT'), ('INDEPENDENCE_CANDIDATE')) k(t) ON t = 'SAME_PAYMENT' OR a.webhook_event_id <> b.webhook_event_id GROUP BY ALL""")
def _(f):
    """Edges between different events of a payment, as memberships with partner counts."""
    return relations.payment_memberships(f.payment_obs)


@query("evidence_pairs", """
SELECT payment_id, sum(CASE WHEN b IS NULL THEN 0 ELSE 1 END) :: BIGINT AS same_payment_pairs,
  count(*) FILTER (WHERE same) AS same_event_pairs, count(*) FILTER (WHERE NOT same) AS independence_pairs
FROM (SELECT a.payment_id, b.evidence_id AS b, a.webhook_event_id = b.webhook_event_id AS same
  FROM v_pobs a LEFT JOIN v_pobs b ON a.payment_id = b.payment_id AND a.evidence_id < b.evidence_id) GROUP BY 1""")
def _(f):
    return relations.pair_totals(f.observations)


@query("related_evidence", f"""
SELECT DISTINCT a.payment_id, least(a.evidence_id, b.evidence_id) AS source_id, greatest(a.evidence_id, b.evidence_id) AS target_id, t AS relationship_type
FROM (SELECT payment_id, min(evidence_id) AS evidence_id, arg_min(webhook_event_id, evidence_id) AS webhook_event_id FROM v_pobs GROUP BY 1) a
JOIN v_pobs b ON a.payment_id = b.payment_id AND a.evidence_id <> b.evidence_id
JOIN (VALUES ('SAME_PAYMENT'), ('INDEPENDENCE_CANDIDATE')) k(t) ON t = 'SAME_PAYMENT' OR a.webhook_event_id <> b.webhook_event_id""")
def _(f):
    """Partners of one chosen observation per payment, listed one by one."""
    chosen = f.payment_obs.groupBy("payment_id").agg(F.min("evidence_id").alias("evidence_id"))
    return relations.related_to(f.payment_obs, chosen)


@query("classify_transition", f"""
WITH s AS (SELECT payment_id, event_id, status, CASE status WHEN 'paid' THEN 'captured' ELSE status END AS st,
    row_number() OVER (PARTITION BY payment_id ORDER BY observed_us, event_id) AS i FROM v_norm)
SELECT a.status AS from_status, b.status AS to_status, CASE WHEN a.st = b.st THEN 'SAME_STATE'
  WHEN {" OR ".join(f"(a.st = '{x}' AND b.st = '{y}')" for x, y in V.VALID_TRANSITIONS)} THEN 'VALID_FORWARD'
  WHEN a.st IN {inlist(V.TERMINAL_STATES)} AND b.st IN {inlist(V.TERMINAL_STATES)} THEN 'CONTRADICTORY_TERMINAL' ELSE 'INVALID_BACKWARD' END AS transition_type,
  count(*) AS n FROM s a JOIN s b ON a.payment_id = b.payment_id AND b.i = a.i + 1 GROUP BY ALL""")
def _(f):
    """Transitions between consecutive events of each payment, counted by type."""
    from veritrail.functions.skew import previous_value, time_chunks
    steps = previous_value(
        f.normalized.select("payment_id", "event_id", "status", "observed_at", E.us("observed_at").alias("observed_us")),
        ["payment_id"], ["observed_us", "event_id"], time_chunks(F.col("observed_us")), F.col("status"), "previous",
    ).filter("previous IS NOT NULL")
    return steps.groupBy(
        F.col("previous").alias("from_status"), F.col("status").alias("to_status"),
        E.transition(F.col("previous"), F.col("status")).alias("transition_type")).agg(F.count("*").alias("n"))


@query("build_claims", """
SELECT claim_id, subject_type, subject_id, claim_type, claim_key, canonical_value, observation_count, earliest_us, latest_us FROM v_claims""")
def _(f):
    return f.claims.drop("n_sources", "n_events", "n_webhooks")


@query("evidence_groups", """
SELECT payment_id, 'SAME_PAYMENT_EVENT' AS group_type, 'payment_event_' || payment_event_id AS grouping_key, count(*) AS member_count FROM v_pobs GROUP BY ALL
UNION ALL SELECT payment_id, 'SAME_WEBHOOK_EVENT', 'webhook_event_' || webhook_event_id, count(*) FROM v_pobs GROUP BY ALL
UNION ALL SELECT payment_id, 'SAME_SOURCE', 'source_' || source_type, count(*) FROM v_pobs GROUP BY ALL""")
def _(f):
    return structure.evidence_groups(f.payment_obs)


view("v_corr", """
SELECT *, CASE corroboration_type WHEN 'SINGLE_OBSERVATION' THEN 'UNKNOWN' WHEN 'MULTI_SOURCE_CORROBORATION' THEN 'INDEPENDENT_CANDIDATE'
  WHEN 'TEMPORAL_CORROBORATION' THEN 'DEPENDENT' ELSE 'SAME_SOURCE' END AS independence_status
FROM (SELECT *, greatest(n_sources, 1) AS distinct_sources_count, CASE WHEN n_events > 0 THEN n_events WHEN n_webhooks > 0 THEN n_webhooks ELSE 1 END AS distinct_events_count,
  CASE WHEN observation_count <= 1 THEN 'SINGLE_OBSERVATION' WHEN n_sources > 1 THEN 'MULTI_SOURCE_CORROBORATION'
    WHEN n_events > 1 OR (n_times > 1 AND n_webhooks > 1) THEN 'TEMPORAL_CORROBORATION' ELSE 'SAME_SOURCE_CORROBORATION' END AS corroboration_type FROM v_claims)""")


@query("corroboration", "SELECT claim_id, observation_count, distinct_sources_count, distinct_events_count, corroboration_type, independence_status FROM v_corr")
def _(f):
    return structure.corroboration(f.claims).select(
        "claim_id", "observation_count", "distinct_sources_count", "distinct_events_count", "corroboration_type", "independence_status")


view("v_scope", "SELECT *, CASE WHEN subject_type = 'payment' THEN subject_id ELSE prov_payment_id END AS payment_id FROM v_obs WHERE subject_type = 'payment' OR prov_payment_id IS NOT NULL")
view("v_scope_claims", f"""
SELECT payment_id, subject_type, subject_id, claim_type, claim_key, canonical_value, count(*) AS n, count(DISTINCT source_type) AS s FROM (
  SELECT s.payment_id, c.* FROM v_scope s JOIN v_claim_rows c ON c.evidence_id = s.evidence_id) GROUP BY ALL""")
view("v_structure", """
SELECT t.payment_id, total_observations, distinct_claims, greatest(n_sources, 1) AS distinct_sources, greatest(n_events, 1) AS distinct_events,
  n_events + n_webhooks + n_sources AS distinct_groups, largest_group_size, group_hhi, corroborated_claim_count, multi_source_claim_count, sources_breakdown
FROM (SELECT payment_id, count(*) AS total_observations, count(DISTINCT source_type) AS n_sources, count(DISTINCT payment_event_id) AS n_events,
    count(DISTINCT webhook_event_id) AS n_webhooks FROM v_scope GROUP BY 1) t
JOIN (SELECT payment_id, max(n) AS largest_group_size, round(sum(n * n) / (sum(n) * sum(n)), 4) AS group_hhi
    FROM (SELECT payment_id, payment_event_id, count(*) :: DOUBLE AS n FROM v_scope GROUP BY ALL) GROUP BY 1) h ON h.payment_id = t.payment_id
JOIN (SELECT payment_id, count(*) AS distinct_claims, count(*) FILTER (WHERE n > 1) AS corroborated_claim_count, count(*) FILTER (WHERE s > 1) AS multi_source_claim_count
    FROM v_scope_claims GROUP BY 1) c ON c.payment_id = t.payment_id
JOIN (SELECT payment_id, string_agg(source_type || ':' || n, ',' ORDER BY source_type) AS sources_breakdown
    FROM (SELECT payment_id, source_type, count(*) AS n FROM v_scope GROUP BY ALL) GROUP BY 1) b ON b.payment_id = t.payment_id""")


@query("structure_snapshot", "SELECT * REPLACE (CAST(largest_group_size AS BIGINT) AS largest_group_size) FROM v_structure")
def _(f):
    return structure.structure_snapshot(structure.structure_scope(f.observations))


@query("structure_scope", "SELECT payment_id, evidence_id, subject_type FROM v_scope")
def _(f):
    return structure.structure_scope(f.observations).select("payment_id", "evidence_id", "subject_type")


@query("structure_view", """
SELECT c.payment_id, c.claim_id, c.claim_type, c.canonical_value, c.observation_count, c.corroboration_type, s.total_observations, s.group_hhi, s.distinct_groups
FROM (SELECT *, subject_id AS payment_id FROM v_corr WHERE subject_type = 'payment') c JOIN v_structure s ON s.payment_id = c.payment_id""")
def _(f):
    def build(own):
        snap = structure.structure_snapshot(own.scoped).select("payment_id", "total_observations", "group_hhi", "distinct_groups")
        claims = structure.payment_claims(structure.corroboration(own.claims)).select(
            "payment_id", "claim_id", "claim_type", "canonical_value", "observation_count", "corroboration_type")
        return claims.join(skew.shuffled(snap), "payment_id")
    return f.by_payment(build)


@query("claim_evidence", "SELECT claim_id, evidence_id, source_type, observed_us FROM v_claim_rows")
def _(f):
    return f.claim_rows.select("claim_id", "evidence_id", "source_type", "observed_us")


@query("claim_support", """
SELECT claim_id, count(*) AS total_support, count(DISTINCT source_type) AS independent_support,
  count(*) FILTER (WHERE rn = 1) AS first_per_source, 0 :: BIGINT AS dependency_count
FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, source_type, source_reference ORDER BY evidence_id) AS rn FROM v_claim_rows) GROUP BY 1""")
def _(f):
    def build(part, _spread):
        edges = relations.event_edges(part.withColumn("claims", structure.claim_in_slots()), "subject_type", "subject_id", "claims")
        return structure.claim_support(structure.claim_rows(canonical.subject_evidence(part)), structure.inner_edges(edges))
    return skew.by_size(canonical.by_subject(f.normalized), "subject_id", MANY, build)


@query("earliest_latest", "SELECT claim_id, earliest_us, latest_us, observation_count FROM v_claims")
def _(f):
    return f.claims.select("claim_id", "earliest_us", "latest_us", "observation_count")


@query("source_diversity", """
SELECT payment_id, fact_hash, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS sources, count(DISTINCT source_type) AS source_count,
  count(DISTINCT source_type) > 1 AS is_multi_source FROM v_fact_rows GROUP BY ALL""")
def _(f):
    """Source types are a closed vocabulary, so the set per fact stays small."""
    per = f.fact_rows.groupBy("payment_id", "fact_hash", "source_type").count()
    return per.groupBy("payment_id", "fact_hash").agg(
        F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("sources"),
        F.count("source_type").alias("source_count"), (F.count("source_type") > 1).alias("is_multi_source"))


@query("distinct_scans", """
SELECT DISTINCT 'evidence_type' AS kind, evidence_type AS value FROM v_obs UNION ALL SELECT DISTINCT 'currency', currency FROM v_payments
UNION ALL SELECT DISTINCT 'method', method FROM v_payments UNION ALL SELECT 'payment_count', CAST(count(DISTINCT payment_id) AS VARCHAR) FROM v_pobs""")
def _(f):
    pair = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("value")).distinct()
    n = f.payment_obs.agg(F.count_distinct("payment_id").cast("string").alias("value")).select(F.lit("payment_count").alias("kind"), "value")
    return pair(f.observations, "evidence_type", "evidence_type").unionByName(pair(f.payments, "currency", "currency")).unionByName(
        pair(f.payments, "method", "method")).unionByName(n)


@query("evidence_lineage_row", """
SELECT o.evidence_id, o.evidence_type, p.event_id AS payment_event_id, p.event_type, e.provider_event_id, e.processing_status
FROM v_obs o LEFT JOIN v_norm p ON p.event_id = o.payment_event_id LEFT JOIN v_ev e ON e.event_id = o.webhook_event_id""")
def _(f):
    pe = f.payment_events.select("payment_event_id", F.col("event_type"))
    we = f.events.select(F.col("event_id").alias("webhook_event_id"), "provider_event_id", "processing_status")
    o = f.observations.select("evidence_id", "evidence_type", "payment_event_id", "webhook_event_id")
    return o.join(pe, "payment_event_id", "left").join(we, "webhook_event_id", "left").drop("webhook_event_id")


@query("payment_timeline", """
SELECT p.payment_id, p.event_id AS payment_event_id, p.event_type, p.observed_us AS event_us, o.evidence_id, o.evidence_type, o.value
FROM v_norm p LEFT JOIN v_obs o ON o.payment_event_id = p.event_id""")
def _(f):
    """Flat timeline rows; order by (payment_id, event_us, evidence_id). Nesting a payment into one
    row would gather it in one place."""
    o = f.observations.select("payment_event_id", "evidence_id", "evidence_type", "value")
    return f.payment_events.select("payment_id", "payment_event_id", "event_type", E.us("event_time").alias("event_us")).join(
        o, "payment_event_id", "left")


@query("status_conflicts", "SELECT payment_id, claim_a_id, claim_b_id, from_value, to_value, delta_us, transition_type, conflict_type, severity FROM v_status_conflicts")
def _(f):
    return f.status_conflicts.drop("status", "rule_version")


_MEMBERS = """
SELECT payment_id, claim_id, claim_type, canonical_value, any_value(conflict_type) AS conflict_type, count(*) AS conflicts_with FROM (
  SELECT payment_id, claim_type, claim_a_id AS cid, conflict_type FROM v_value_pairs UNION ALL SELECT payment_id, claim_type, claim_b_id, conflict_type FROM v_value_pairs)
JOIN (SELECT claim_id, canonical_value FROM v_pclaims) ON claim_id = cid WHERE {} GROUP BY ALL"""


@query("value_conflicts", _MEMBERS.format("claim_type IN ('PAYMENT_AMOUNT', 'PAYMENT_CURRENCY')"))
def _(f):
    return conflicts.conflict_members(f.payment_claims, ("PAYMENT_AMOUNT", "PAYMENT_CURRENCY")).select(
        "payment_id", "claim_id", "claim_type", "canonical_value", "conflict_type", "conflicts_with")


@query("order_conflicts", _MEMBERS.format("claim_type = 'ORDER_ASSOCIATION'"))
def _(f):
    return conflicts.conflict_members(f.payment_claims, ("ORDER_ASSOCIATION",)).select(
        "payment_id", "claim_id", "claim_type", "canonical_value", "conflict_type", "conflicts_with")


view("v_conflict_counts", """
SELECT payment_id, conflict_type, severity, count(*) AS n FROM v_conflict_pairs GROUP BY ALL""")


@query("conflicts", "SELECT payment_id, conflict_type, severity, n AS conflict_count FROM v_conflict_counts")
def _(f):
    """All conflicts of every payment by type; the open-ended ones are counted from set sizes."""
    return f.conflicts_by_type.withColumnRenamed("n", "conflict_count")


view("v_profile", """
SELECT p.payment_id, claim_count, multi_observation_claims, multi_source_claims,
  coalesce(st, 0) AS state_conflicts, coalesce(te, 0) AS temporal_conflicts, coalesce(oa, 0) AS ordering_ambiguities,
  coalesce(vc, 0) AS value_conflicts, coalesce(rc, 0) AS relationship_conflicts, coalesce(open_n, 0) AS open_conflict_count, coalesce(tot, 0) AS conflict_count
FROM (SELECT payment_id, count(*) AS claim_count, count(*) FILTER (WHERE observation_count >= 2) AS multi_observation_claims,
    count(*) FILTER (WHERE n_sources >= 2) AS multi_source_claims FROM v_pclaims GROUP BY 1) p
LEFT JOIN (SELECT payment_id, count(*) AS tot, count(*) FILTER (WHERE severity <> 'INFO') AS open_n, count(*) FILTER (WHERE conflict_type = 'STATE_CONFLICT') AS st,
    count(*) FILTER (WHERE conflict_type = 'TEMPORAL_CONFLICT') AS te, count(*) FILTER (WHERE conflict_type = 'ORDERING_AMBIGUITY') AS oa,
    count(*) FILTER (WHERE conflict_type = 'VALUE_CONFLICT') AS vc, count(*) FILTER (WHERE conflict_type = 'RELATIONSHIP_CONFLICT') AS rc
  FROM v_conflict_pairs GROUP BY 1) c ON c.payment_id = p.payment_id""")


@query("consistency_summary", """
SELECT payment_id, conflict_count = 0 OR open_conflict_count = 0 AS is_consistent, conflict_count AS total_conflicts, open_conflict_count AS open_conflicts,
  0 :: BIGINT AS resolved_conflicts, state_conflicts, temporal_conflicts, ordering_ambiguities, value_conflicts, relationship_conflicts FROM v_profile""")
def _(f):
    p = conflicts.conflict_profile(f.payment_claims)
    return p.select(
        "payment_id", (F.col("open_conflict_count") == 0).alias("is_consistent"), F.col("conflict_count").alias("total_conflicts"),
        F.col("open_conflict_count").alias("open_conflicts"), F.lit(0).cast("bigint").alias("resolved_conflicts"),
        "state_conflicts", "temporal_conflicts", "ordering_ambiguities", "value_conflicts", "relationship_conflicts")


@query("conflict_list", """
SELECT payment_id, claim_a_id, claim_b_id, conflict_type, severity FROM v_status_conflicts
UNION ALL SELECT v.payment_id, claim_a_id, claim_b_id, conflict_type, severity FROM v_value_pairs v
JOIN (SELECT payment_id AS pid, claim_type AS ct, min(claim_id) AS m FROM v_pclaims GROUP BY ALL) ON pid = payment_id AND ct = claim_type AND claim_a_id = m""")
def _(f):
    """Status conflicts one by one, and those of the lowest claim of each contradicted attribute."""
    sets = conflicts.conflict_sets(f.payment_claims)
    chosen = sets.select("payment_id", F.col("set_anchor").alias("claim_id"))
    listed = conflicts.partners_of(f.payment_claims, chosen).select(
        "payment_id", "claim_a_id", "claim_b_id",
        F.when(F.col("claim_type") == "ORDER_ASSOCIATION", "RELATIONSHIP_CONFLICT").otherwise("VALUE_CONFLICT").alias("conflict_type"),
        F.lit("HIGH").alias("severity"))
    return f.status_conflicts.select("payment_id", "claim_a_id", "claim_b_id", "conflict_type", "severity").unionByName(listed)


@query("build_facts", "SELECT payment_id, fact_type, canonical_value, fact_hash, first_us, last_us, observation_count, distinct_source_count FROM v_facts")
def _(f):
    return f.facts.drop("first_evidence_id", "status")


@query("fact_links", "SELECT evidence_id, fact_hash FROM v_fact_rows")
def _(f):
    return f.fact_rows.select("evidence_id", "fact_hash")


@query("fact_type_of", "SELECT evidence_type, event_type, fact_type, count(*) AS n, count(DISTINCT canonical_value) AS n_values FROM v_fact_rows GROUP BY ALL")
def _(f):
    rows = f.payment_obs.select("evidence_type", "event_type", facts.fact_type().alias("fact_type"), facts.canonical_value().alias("canonical_value"))
    return rows.groupBy("evidence_type", "event_type", "fact_type").agg(
        F.count("*").alias("n"), F.count_distinct("canonical_value").alias("n_values"))


@query("canonical_value", "SELECT evidence_id, canonical_value FROM v_fact_rows")
def _(f):
    return f.payment_obs.select("evidence_id", facts.canonical_value().alias("canonical_value"))


@query("reconcile_pairs", "SELECT payment_id, result, rule_id, count(*) AS pair_count FROM v_fact_pairs GROUP BY ALL")
def _(f):
    return facts.reconcile_counts(f.fact_rows)


@query("reconcile_decisions_of", """
SELECT payment_id, observation_a_id, observation_b_id, result, rule_id, CASE WHEN result = 'SAME_FACT' THEN fact_hash END AS fact_hash FROM v_fact_pairs
JOIN (SELECT payment_id AS pid, min(evidence_id) AS m FROM v_fact_rows GROUP BY 1) ON pid = payment_id AND observation_a_id = m
JOIN (SELECT evidence_id, fact_hash FROM v_fact_rows) ON evidence_id = observation_a_id""")
def _(f):
    """Every decision of one chosen observation per payment, listed one by one."""
    chosen = f.fact_rows.groupBy("payment_id").agg(F.min("evidence_id").alias("evidence_id"))
    return facts.decisions_of(f.fact_rows, chosen)


@query("observation_decisions", """
SELECT payment_id, x.evidence_id, fact_hash, result, rule_id, count(*) AS partners FROM (
  SELECT payment_id AS pid, observation_a_id AS evidence_id, result, rule_id FROM v_fact_pairs
  UNION ALL SELECT payment_id, observation_b_id, result, rule_id FROM v_fact_pairs) x JOIN v_fact_rows r ON r.evidence_id = x.evidence_id GROUP BY ALL""")
def _(f):
    return f.by_payment(lambda own: facts.observation_decisions(own.fact_rows, own.spread))


@query("backfill_report", "SELECT result, count(*) AS decisions FROM v_fact_pairs GROUP BY 1")
def _(f):
    return facts.reconcile_counts(f.fact_rows).groupBy("result").agg(F.sum("pair_count").alias("decisions"))


@query("fact_sequence", """
SELECT a.payment_id, a.fact_hash, count(*) FILTER (WHERE b.first_us < a.first_us) AS precedes, count(*) FILTER (WHERE b.first_us > a.first_us) AS succeeds,
  count(*) FILTER (WHERE b.first_us = a.first_us) AS concurrent
FROM v_facts a JOIN v_facts b ON a.payment_id = b.payment_id WHERE a.fact_hash <> b.fact_hash GROUP BY ALL""")
def _(f):
    """How many other facts of the payment come before, after or together with each fact."""
    return facts.fact_sequence(f.facts).filter("precedes + succeeds + concurrent > 0")


@query("key_facts", """
SELECT payment_id, fact_type, canonical_value, observation_count, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY observation_count DESC, first_us, fact_hash) AS rn FROM v_facts) WHERE rn <= 10""")
def _(f):
    from pyspark.sql import Window
    w = Window.partitionBy("payment_id").orderBy(F.desc("observation_count"), "first_us", "fact_hash")
    return f.facts.withColumn("rn", F.row_number().over(w).cast("bigint")).filter("rn <= 10").select(
        "payment_id", "fact_type", "canonical_value", "observation_count", "rn")


@query("fact_detail", """
SELECT r.payment_id, r.fact_hash, r.evidence_id, r.source_type, f.observation_count, f.distinct_source_count, p.conflict_count
FROM v_fact_rows r JOIN v_facts f ON f.fact_hash = r.fact_hash JOIN v_profile p ON p.payment_id = r.payment_id""")
def _(f):
    head = f.facts.select(*facts.FACT_KEYS, "observation_count", "distinct_source_count")
    conf = conflicts.conflict_profile(f.payment_claims).select("payment_id", "conflict_count")
    return f.fact_rows.select(*facts.FACT_KEYS, "fact_hash", "evidence_id", "source_type").join(head, facts.FACT_KEYS).join(
        conf, "payment_id").drop("fact_type", "canonical_value")


# --- coverage ----------------------------------------------------------------------------
view("v_reqs", "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3][0]}')" for i, r in enumerate(V.REQUIREMENTS)) + ") t(i, requirement_id, base, evidence_type, fact_type)")
view("v_cov", """
SELECT x.payment_id, x.requirement_id, CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN base = 'CONDITIONAL' THEN 'REQUIRED' ELSE base END AS requirement_type,
  CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN f.fact_hash IS NOT NULL THEN CASE WHEN conflicted THEN 'CONFLICTED' ELSE 'PRESENT' END
    WHEN o.n > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS observed_state,
  CASE WHEN applies THEN f.fact_hash END AS matched_fact, CASE WHEN NOT applies THEN NULL ELSE coalesce(f.observation_count, o.n) END AS matched_observations
FROM (SELECT p.payment_id, r.*, coalesce(c.value_conflicts + c.temporal_conflicts > 0, false) AS conflicted,
    CASE requirement_id WHEN 'REQ_PAYMENT_CAPTURED' THEN p.status = 'captured' OR p.captured OR EXISTS (SELECT 1 FROM v_facts WHERE payment_id = p.payment_id AND fact_type = 'PAYMENT_CAPTURED')
        OR EXISTS (SELECT 1 FROM v_pobs WHERE payment_id = p.payment_id AND value = 'captured')
      WHEN 'REQ_REFUND_RECORD' THEN false
      WHEN 'REQ_FAILURE_REASON' THEN p.status = 'failed' OR EXISTS (SELECT 1 FROM v_facts WHERE payment_id = p.payment_id AND fact_type = 'PAYMENT_FAILED')
      ELSE true END AS applies
  FROM v_payments p CROSS JOIN v_reqs r LEFT JOIN v_profile c ON c.payment_id = p.payment_id) x
LEFT JOIN (SELECT payment_id, requirement_id, fact_hash, observation_count FROM (
    SELECT f.*, q.requirement_id, row_number() OVER (PARTITION BY payment_id, requirement_id ORDER BY first_us, fact_hash) AS rn FROM v_facts f
    JOIN v_reqs q ON q.fact_type = f.fact_type OR (q.requirement_id = 'REQ_PAYMENT_CREATION' AND f.fact_type IN ('PAYMENT_CAPTURED', 'PAYMENT_AUTHORIZED', 'PAYMENT_FAILED')))
  WHERE rn = 1) f ON f.payment_id = x.payment_id AND f.requirement_id = x.requirement_id
LEFT JOIN (SELECT payment_id, evidence_type, count(*) AS n FROM v_pobs GROUP BY ALL) o ON o.payment_id = x.payment_id AND o.evidence_type = x.evidence_type""")
view("v_cov_summary", """
SELECT *, CASE WHEN applicable = 0 THEN 'UNKNOWN' WHEN required_missing > 0 AND required_present = 0 THEN 'INSUFFICIENT' WHEN required_missing > 0 OR conflicted > 0 THEN 'PARTIAL'
  WHEN expected_missing > 0 THEN 'SUBSTANTIALLY_COMPLETE' ELSE 'COMPLETE' END AS overall_status FROM (
SELECT payment_id, count(*) AS total, count(*) FILTER (WHERE requirement_type <> 'NOT_APPLICABLE') AS applicable,
  count(*) FILTER (WHERE requirement_type = 'REQUIRED' AND observed_state = 'PRESENT') AS required_present,
  count(*) FILTER (WHERE requirement_type = 'REQUIRED' AND observed_state = 'MISSING') AS required_missing,
  count(*) FILTER (WHERE requirement_type = 'EXPECTED' AND observed_state = 'PRESENT') AS expected_present,
  count(*) FILTER (WHERE requirement_type = 'EXPECTED' AND observed_state = 'MISSING') AS expected_missing,
  count(*) FILTER (WHERE requirement_type = 'OPTIONAL' AND observed_state = 'PRESENT') AS optional_present,
  count(*) FILTER (WHERE observed_state = 'CONFLICTED') AS conflicted, count(*) FILTER (WHERE observed_state = 'PARTIAL') AS partial
FROM v_cov GROUP BY 1)""")


@query("coverage_results", "SELECT * FROM v_cov")
def _(f):
    return f.coverage


@query("coverage_matrix", "SELECT p.payment_id, r.requirement_id FROM v_payments p CROSS JOIN v_reqs r")
def _(f):
    """Payments x requirements, from an array on the payment row: no cross join."""
    return f.coverage.select("payment_id", "requirement_id")


@query("coverage_profile", "SELECT payment_id, 'STANDARD_PAYMENT' AS profile_id FROM v_payments")
def _(f):
    return coverage.coverage_profile(f.coverage_flags).select("payment_id", "profile_id")


@query("coverage_applicability", "SELECT payment_id, requirement_id, requirement_type FROM v_cov")
def _(f):
    return f.coverage.select("payment_id", "requirement_id", "requirement_type")


@query("coverage_summary", "SELECT * FROM v_cov_summary")
def _(f):
    return coverage.coverage_summary(f.keeping("observations", "payments").coverage)


@query("missing_evidence", "SELECT payment_id, requirement_id, requirement_type FROM v_cov WHERE observed_state = 'MISSING'")
def _(f):
    return f.coverage.filter(F.col("observed_state") == "MISSING").select("payment_id", "requirement_id", "requirement_type")


@query("requirement_catalog", f"""
SELECT requirement_id, requirement_type, count(*) AS payments, count(*) FILTER (WHERE observed_state = 'MISSING') AS missing FROM v_cov GROUP BY ALL""")
def _(f):
    """The requirement list with how it applies across payments."""
    names = coverage.requirement_catalog(f.spark).select("requirement_id")
    return f.coverage.join(F.broadcast(names), "requirement_id").groupBy("requirement_id", "requirement_type").agg(
        F.count("*").alias("payments"), F.count_if(F.col("observed_state") == "MISSING").alias("missing"))


# --- reliability ---------------------------------------------------------------------------
view("v_fact_rel", f"""
SELECT *, CASE WHEN structural_state = 'MALFORMED' THEN 'UNRELIABLE' WHEN provenance_state = 'BROKEN' THEN 'LIMITED' WHEN contradiction_state = 'CONFLICTED' THEN 'LIMITED'
  WHEN source_state = 'UNKNOWN_SOURCE' THEN 'UNKNOWN' WHEN source_state = 'UNVERIFIED_SOURCE' THEN 'LIMITED' WHEN dependency_state = 'DEPENDENT_REPLICATION' THEN 'MODERATE'
  WHEN source_state = 'VERIFIED_PROVIDER_SOURCE' THEN 'HIGH' ELSE 'MODERATE' END AS overall_state
FROM (SELECT r.payment_id, r.fact_hash, count(*) AS observation_count,
    CASE WHEN bool_and(source_type IN ('PROVIDER_WEBHOOK', 'PROVIDER_API')) THEN 'VERIFIED_PROVIDER_SOURCE' ELSE 'VERIFIED_INTERNAL_SOURCE' END AS source_state,
    'COMPLETE' AS provenance_state, CASE WHEN any_value(q.fh) IS NOT NULL THEN 'SAME_FACT_DIFFERENT_SOURCE' ELSE 'SAME_PROVIDER_EVENT' END AS identity_state,
    'TEMPORALLY_SOUND' AS temporal_state, 'CANONICAL_FACT' AS structural_state,
    CASE WHEN any_value(c.conflict_count) > 0 THEN 'CONFLICTED' ELSE 'UNCONTRADICTED' END AS contradiction_state,
    CASE WHEN count(DISTINCT source_type) > 1 AND count(DISTINCT webhook_event_id) > 1 THEN 'INDEPENDENT_CORROBORATION'
      WHEN count(*) > 1 AND count(DISTINCT webhook_event_id) = 1 THEN 'DEPENDENT_REPLICATION' WHEN count(*) = 1 THEN 'SINGLE_SOURCE' ELSE 'UNKNOWN' END AS dependency_state
  FROM v_fact_rows r LEFT JOIN v_profile c ON c.payment_id = r.payment_id
  LEFT JOIN (SELECT DISTINCT fact_hash AS fh FROM v_fact_pairs JOIN v_fact_rows ON evidence_id = observation_a_id WHERE result = 'SAME_FACT') q ON q.fh = r.fact_hash
  GROUP BY ALL)""")


@query("fact_reliability", "SELECT * FROM v_fact_rel")
def _(f):
    return f.fact_reliability.drop("fact_type", "canonical_value", "factors", "ceiling")


view("v_pay_rel", """
SELECT p.payment_id, count(r.fact_hash) AS facts_assessed, CASE WHEN count(r.fact_hash) = 0 THEN 'LIMITED' WHEN bool_or(overall_state = 'UNRELIABLE') THEN 'UNRELIABLE'
  WHEN bool_or(overall_state = 'LIMITED') THEN 'LIMITED' WHEN bool_or(overall_state = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_and(overall_state = 'HIGH') THEN 'HIGH' ELSE 'MODERATE' END AS overall_state
FROM v_payments p LEFT JOIN v_fact_rel r ON r.payment_id = p.payment_id GROUP BY 1""")


@query("payment_reliability", "SELECT * FROM v_pay_rel")
def _(f):
    f = f.keeping("observations")
    return reliability.payment_reliability(f.fact_reliability, f.payments)


@query("uncertainty", """
WITH u AS (SELECT DISTINCT payment_id, b AS boundary_type, t AS topic FROM v_fact_rel JOIN (VALUES ('ESTABLISHED', 'Source Authenticity'), ('ESTABLISHED', 'Lineage Chain'),
  ('CONTRADICTED', 'Consistency Conflict'), ('UNCERTAIN', 'Independent Corroboration'), ('SUPPORTED', 'Canonical Data Structure')) k(b, t)
  ON CASE t WHEN 'Source Authenticity' THEN source_state = 'VERIFIED_PROVIDER_SOURCE' WHEN 'Consistency Conflict' THEN contradiction_state = 'CONFLICTED'
     WHEN 'Independent Corroboration' THEN dependency_state IN ('SINGLE_SOURCE', 'DEPENDENT_REPLICATION') ELSE true END)
SELECT * FROM u UNION ALL SELECT DISTINCT payment_id, 'UNCERTAIN', 'External Settlement' FROM v_fact_rel WHERE payment_id NOT IN (SELECT payment_id FROM u WHERE boundary_type = 'UNCERTAIN')""")
def _(f):
    return reliability.uncertainty(f.fact_reliability)


# --- integrity -----------------------------------------------------------------------------
def dims_sql(profile: str, times: str) -> str:
    """`profile`: counters of claims c with times p(eval_us); `times`: what joins observations s to times e(eval_us)."""
    return f"""
SELECT payment_id, eval_us, evidence_count, source_count, conflict_count, open_conflict_count, stale_count,
  CASE WHEN evidence_count = 0 THEN 'UNKNOWN' WHEN stale_count > 0 THEN 'LIMITED' WHEN fresh_count = evidence_count THEN 'STRONG' ELSE 'LIMITED' END AS freshness,
  CASE WHEN evidence_count = 0 THEN 'UNKNOWN' WHEN tertiary > 0 THEN 'WEAK' WHEN primary_n = evidence_count AND direct_n = evidence_count THEN 'STRONG' ELSE 'LIMITED' END AS source,
  CASE WHEN total = 0 THEN 'UNKNOWN' WHEN ds >= 2 AND de >= 2 THEN 'HIGH_SOURCE_DIVERSITY' WHEN ds >= 2 OR de >= 2 THEN 'LIMITED_SOURCE_DIVERSITY' ELSE 'SINGLE_SOURCE' END AS independence,
  CASE WHEN claim_count = 0 THEN 'UNKNOWN' WHEN multi_source_claims > 0 THEN 'STRONGLY_CORROBORATED' WHEN multi_observation_claims > 0 THEN 'PARTIALLY_CORROBORATED' ELSE 'SINGLE_OBSERVATION' END AS corroboration,
  CASE WHEN conflict_count = 0 THEN 'NO_DETECTED_CONFLICT' WHEN open_conflict_count > 0 THEN 'HAS_OPEN_CONFLICTS' ELSE 'ORDERING_AMBIGUITY_ONLY' END AS consistency,
  ds AS distinct_sources, de AS distinct_events, claim_count, multi_source_claims
FROM (SELECT c.payment_id, p.eval_us, c.claim_count, c.multi_source_claims, c.multi_observation_claims, c.conflict_count, c.open_conflict_count,
    count(*) FILTER (WHERE ok) AS evidence_count, count(DISTINCT source_type) FILTER (WHERE ok) AS source_count,
    count(*) FILTER (WHERE ok AND st = 'STALE') AS stale_count, count(*) FILTER (WHERE ok AND st IN ('CURRENT', 'AGING')) AS fresh_count,
    count(*) FILTER (WHERE ok AND au = 'TERTIARY') AS tertiary, count(*) FILTER (WHERE ok AND au = 'PRIMARY') AS primary_n, count(*) FILTER (WHERE ok AND di = 'DIRECT') AS direct_n,
    count(evidence_id) AS total, count(DISTINCT source_type) AS ds, count(DISTINCT payment_event_id) AS de
  FROM {profile}
  LEFT JOIN (SELECT s.*, e.eval_us AS ev, subject_type = 'payment' AND (valid_until_us IS NULL OR valid_until_us > e.eval_us) AS ok,
      {fresh('e.eval_us')} AS st, {AUTH} AS au, {DIRECT} AS di FROM v_scope s JOIN {times} AND observed_us <= e.eval_us) o
    ON o.payment_id = c.payment_id AND o.ev = p.eval_us
  GROUP BY ALL)"""


view("v_dims", dims_sql(f"v_profile c CROSS JOIN (VALUES {POINTS}) p(eval_us)", f"(VALUES {POINTS}) e(eval_us) ON true"))
GATED = """
SELECT *, CASE WHEN evidence_count = 0 THEN 'INSUFFICIENT_DATA' WHEN open_conflict_count > 0 THEN 'UNRESOLVED' WHEN freshness = 'UNKNOWN' OR source = 'WEAK' THEN 'WEAK'
  WHEN freshness = 'STRONG' AND source = 'STRONG' AND independence = 'HIGH_SOURCE_DIVERSITY' AND corroboration = 'STRONGLY_CORROBORATED' AND consistency = 'NO_DETECTED_CONFLICT' AND evidence_count >= 2 THEN 'VERY_STRONG'
  WHEN freshness IN ('STRONG', 'LIMITED') AND source IN ('STRONG', 'LIMITED') AND consistency IN ('NO_DETECTED_CONFLICT', 'ORDERING_AMBIGUITY_ONLY') THEN 'STRONG' ELSE 'LIMITED' END AS overall_status
FROM """
view("v_integrity", GATED + "v_dims")

_NOW = f"WHERE eval_us = {T_EVAL}"
for _dim, _extra in (
    ("freshness", ["stale_count", "evidence_count"]), ("source", ["source_count", "evidence_count"]),
    ("independence", ["distinct_sources", "distinct_events"]), ("corroboration", ["claim_count", "multi_source_claims"]),
    ("consistency", ["conflict_count", "open_conflict_count"]),
):
    def _plan(f, dim=_dim, extra=tuple(_extra)):
        return f.dimensions_now.select("payment_id", F.col(dim).alias("status"), *extra)
    query(f"integrity_{_dim}", f"SELECT payment_id, {_dim} AS status, {', '.join(_extra)} FROM v_dims {_NOW}")(_plan)


@query("integrity", f"""
SELECT payment_id, overall_status, freshness, source, independence, corroboration, consistency, evidence_count, source_count, conflict_count, open_conflict_count
FROM v_integrity {_NOW}""")
def _(f):
    return f.integrity_now.select(
        "payment_id", "overall_status", "freshness", "source", "independence", "corroboration", "consistency",
        "evidence_count", "source_count", "conflict_count", "open_conflict_count")


@query("integrity_explained", f"""
SELECT payment_id, array_to_string(list_filter([
   CASE freshness WHEN 'STRONG' THEN 'recently observed' WHEN 'LIMITED' THEN CASE WHEN stale_count > 0 THEN stale_count || ' stale' END WHEN 'UNKNOWN' THEN 'freshness unknown' END,
   CASE source WHEN 'STRONG' THEN 'primary direct source' WHEN 'LIMITED' THEN 'secondary or derived source' WHEN 'WEAK' THEN 'tertiary source present' END,
   CASE corroboration WHEN 'STRONGLY_CORROBORATED' THEN multi_source_claims || ' claims from several sources' WHEN 'PARTIALLY_CORROBORATED' THEN 'repeated by one source' WHEN 'SINGLE_OBSERVATION' THEN 'each claim observed once' END,
   CASE consistency WHEN 'NO_DETECTED_CONFLICT' THEN 'no conflict detected' WHEN 'ORDERING_AMBIGUITY_ONLY' THEN 'ordering ambiguity only' WHEN 'HAS_OPEN_CONFLICTS' THEN open_conflict_count || ' open conflicts' END,
   CASE independence WHEN 'SINGLE_SOURCE' THEN 'single event' WHEN 'LIMITED_SOURCE_DIVERSITY' THEN 'limited source diversity' WHEN 'UNKNOWN' THEN 'diversity not assessed' END], lambda x : x IS NOT NULL), '; ') AS explanation,
  array_to_string(list_filter(['no outcome history',
   CASE WHEN independence IN ('SINGLE_SOURCE', 'LIMITED_SOURCE_DIVERSITY') THEN 'limited diversity: ' || distinct_sources || ' sources, ' || distinct_events || ' events' END,
   CASE corroboration WHEN 'UNKNOWN' THEN 'corroboration not assessed' WHEN 'SINGLE_OBSERVATION' THEN 'no independent corroboration' END,
   CASE independence WHEN 'UNKNOWN' THEN 'independence not assessed' END], lambda x : x IS NOT NULL), '; ') AS limitations
FROM v_dims {_NOW}""")
def _(f):
    return f.integrity_now.select(
        "payment_id", integrity.explanation().alias("explanation"), integrity.limitations().alias("limitations"))


@query("integrity_rules", f"""
SELECT payment_id, g AS execution_order, 'EIS_V1.' || ['INSUFFICIENT_DATA', 'UNRESOLVED', 'WEAK', 'VERY_STRONG', 'STRONG', 'LIMITED'][g] AS rule_id, g = stop AS fired
FROM (SELECT payment_id, list_position(['INSUFFICIENT_DATA', 'UNRESOLVED', 'WEAK', 'VERY_STRONG', 'STRONG', 'LIMITED'], overall_status) AS stop FROM v_integrity {_NOW})
JOIN (SELECT unnest(range(1, 7)) AS g) ON g <= stop""")
def _(f):
    return integrity.gate_log(f.dimensions_now).drop("eval_us")
