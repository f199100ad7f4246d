"""Graph and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import key_hash
from veritrail.functions.skew import by_size, shuffled
from veritrail.operators import canonical, conflicts, evolution, graph, reliability, relations
from veritrail.plans.frames import MANY, T2, T_EVAL
from veritrail.plans.oracle_base import case
from veritrail.plans.registry import query, view

view("v_rel", """
SELECT a.evidence_id AS source_id, b.evidence_id AS target_id, t AS relationship_type FROM v_obs a JOIN v_obs b ON a.payment_event_id = b.payment_event_id AND a.evidence_id < b.evidence_id JOIN (VALUES ('SAME_EVENT'), ('SAME_SOURCE')) k(t) ON true
UNION ALL SELECT a.evidence_id, b.evidence_id, 'DERIVED_FROM' FROM v_obs a JOIN v_obs b ON a.payment_event_id = b.payment_event_id AND b.evidence_type = 'PAYMENT_EVENT'
 AND a.evidence_type IN ('PAYMENT_STATUS', 'PAYMENT_AMOUNT', 'PAYMENT_CURRENCY', 'PAYMENT_METHOD', 'PAYMENT_ORDER_RELATIONSHIP')""")
view("v_members", """
SELECT DISTINCT payment_id, claim_type, cid AS claim_id FROM (SELECT payment_id, claim_type, claim_a_id AS cid FROM v_value_pairs UNION ALL SELECT payment_id, claim_type, claim_b_id FROM v_value_pairs)""")
view("v_gedges", f"""
SELECT payment_id, 'pay:' || payment_id AS src, 'ord:' || order_id AS dst, 'HAS_ORDER' AS edge_type FROM v_payments WHERE order_id IS NOT NULL
UNION ALL SELECT payment_id, 'pay:' || payment_id, 'cust:' || customer_id, 'HAS_CUSTOMER' FROM v_payments
UNION ALL SELECT payment_id, 'pay:' || payment_id, 'evt:' || event_id, 'HAS_EVENT' FROM v_norm UNION ALL SELECT payment_id, 'evt:' || event_id, 'hook:' || event_id, 'DERIVED_FROM_WEBHOOK' FROM v_norm
UNION ALL SELECT payment_id, 'evt:' || payment_event_id, 'ev:' || evidence_id, 'PRODUCED_EVIDENCE' FROM v_pobs UNION ALL SELECT payment_id, 'ev:' || evidence_id, 'src:' || source_type, 'FROM_SOURCE' FROM v_pobs
UNION ALL SELECT payment_id, 'ev:' || evidence_id, 'hook:' || webhook_event_id, 'DERIVED_FROM_WEBHOOK' FROM v_pobs
UNION ALL SELECT subject_id, 'ev:' || evidence_id, 'claim:' || claim_id, 'SUPPORTS_CLAIM' FROM v_claim_rows WHERE subject_type = 'payment'
UNION ALL SELECT payment_id, 'pay:' || payment_id, 'conf:' || claim_a_id || '-' || claim_b_id, 'HAS_CONFLICT' FROM v_status_conflicts
UNION ALL SELECT payment_id, 'conf:' || claim_a_id || '-' || claim_b_id, 'claim:' || unnest([claim_a_id, claim_b_id]), 'INVOLVES_CLAIM' FROM v_status_conflicts
UNION ALL SELECT DISTINCT payment_id, 'pay:' || payment_id, 'conf:' || payment_id || '-' || claim_type, 'HAS_CONFLICT' FROM v_members
UNION ALL SELECT payment_id, 'conf:' || payment_id || '-' || claim_type, 'claim:' || claim_id, 'INVOLVES_CLAIM' FROM v_members
UNION ALL SELECT payment_id, 'pay:' || payment_id, 'snap:' || {T_EVAL}, 'HAS_INTEGRITY_SNAPSHOT' FROM v_profile""")


def reach_sql(edges: str, roots: str, depth: int, key: str) -> str:
    """Breadth-first levels, one CTE per hop."""
    ctes = [f"s AS (SELECT DISTINCT {key}, src, dst FROM {edges})", f"l0 AS (SELECT {key}, root, node, 0 AS depth FROM ({roots}))"]
    for i in range(depth):
        ctes.append(f"""l{i + 1} AS (SELECT {key}, root, node, min(depth) AS depth FROM (SELECT {key}, root, node, depth FROM l{i}
  UNION ALL SELECT l.{key}, l.root, s.dst, l.depth + 1 FROM l{i} l JOIN s ON s.{key} = l.{key} AND s.src = l.node) GROUP BY ALL)""")
    return f"WITH {', '.join(ctes)} SELECT * FROM l{depth}"


def paths_sql(edges: str, roots: str, depth: int) -> str:
    ctes = [f"s AS (SELECT payment_id, src, dst FROM {edges} UNION SELECT payment_id, dst, src FROM {edges})", f"l0 AS (SELECT payment_id, node, {{'d': 0, 'p': node}} AS best FROM ({roots}))"]
    for i in range(depth):
        ctes.append(f"""l{i + 1} AS (SELECT payment_id, node, min(best) AS best FROM (SELECT payment_id, node, best FROM l{i}
  UNION ALL SELECT l.payment_id, s.dst, {{'d': l.best.d + 1, 'p': l.best.p || ' > ' || s.dst}} FROM l{i} l JOIN s ON s.payment_id = l.payment_id AND s.src = l.node) GROUP BY ALL)""")
    return f"WITH {', '.join(ctes)} SELECT payment_id, node, best.d AS depth, best.p AS path FROM l{depth}"


_ROOTS = "SELECT payment_id, 'pay:' || payment_id AS root, 'pay:' || payment_id AS node FROM v_payments"
view("v_reach", reach_sql("v_gedges", _ROOTS, 4, "payment_id"))
view("v_paths", paths_sql("v_gedges", _ROOTS, 3))


def _roots(f):
    pay = graph.node("pay", "payment_id")
    return f.payments.select("payment_id", pay.alias("root"), pay.alias("node"))


@query("edges_for_payment", """
SELECT DISTINCT payment_id, source_id, target_id, relationship_type FROM (
  SELECT p.payment_id, r.* FROM v_rel r JOIN v_pobs p ON p.evidence_id = r.source_id UNION ALL SELECT p.payment_id, r.* FROM v_rel r JOIN v_pobs p ON p.evidence_id = r.target_id)""")
def _(f):
    """Edges lie inside an event: events are moved to the task of their id, and edges made there."""
    def build(part, spread):
        if spread:
            return graph.edges_for_payment(relations.event_edges(part), canonical.extract_evidence(part))
        return graph.edges_of_owners(relations.event_edges(graph.with_owners(part), "event_id", "owners"))
    return by_size(f.normalized.where("event_id IS NOT NULL"), "event_id", MANY, build)


@query("payment_graph", """
SELECT payment_id, count(*) AS edges, count(DISTINCT edge_type) AS edge_types, (SELECT count(*) FROM v_pobs o WHERE o.payment_id = g.payment_id) AS evidence_nodes FROM v_gedges g GROUP BY payment_id""")
def _(f):
    per = f.keeping("payments").investigation_edges.groupBy("payment_id", "edge_type").agg(F.count("*").alias("n")).groupBy("payment_id").agg(
        F.sum("n").alias("edges"), F.count("*").alias("edge_types"))
    return per.join(f.evidence_totals.select("payment_id", F.col("evidence_count").alias("evidence_nodes")), "payment_id")


@query("investigation_edges", "SELECT * FROM v_gedges")
def _(f):
    return f.keeping("payments").investigation_edges


@query("investigation_graph", "SELECT payment_id, node, depth FROM v_reach")
def _(f):
    def build(own):
        search = graph.reach if own.spread else graph.reach_in_place
        return search(own.investigation_edges, _roots(own), 4, ["payment_id"], "pay", graph.INVESTIGATION).select("payment_id", "node", "depth")
    return f.by_payment(build)


@query("node_owner", "SELECT DISTINCT node, payment_id FROM v_reach WHERE node LIKE 'ev:%' OR node LIKE 'claim:%'")
def _(f):
    """Owning payment of evidence and claim nodes, carried on every edge: no traversal needed."""
    used = [k for k in graph.INVESTIGATION if any({"ev", "claim"} & set(way) for way in graph.KINDS[k])]
    return graph.ends(f.investigation_edges.filter(F.col("edge_type").isin(*used))).filter("node LIKE 'ev:%' OR node LIKE 'claim:%'").distinct()


@query("shortest_path", "SELECT payment_id, depth, path FROM v_paths WHERE node = 'src:PROVIDER_API'")
def _(f):
    """From each payment to the provider API as a source, where it is one."""
    found = graph.paths(f.investigation_edges, _roots(f), 3, "node = 'src:PROVIDER_API'", "pay", "src", graph.INVESTIGATION)
    return found.select("payment_id", "depth", "path")


view("v_asked", "SELECT payment_id, 'ord:' || order_id AS source, 'src:PROVIDER_API' AS target FROM v_payments WHERE order_id IS NOT NULL")
view("v_asked_paths", paths_sql("v_gedges", "SELECT payment_id, source AS node FROM v_asked", graph.MAX_DEPTH))
view("v_asked_out", reach_sql("(SELECT payment_id, src, dst FROM v_gedges UNION SELECT payment_id, dst, src FROM v_gedges)", "SELECT payment_id, source AS root, source AS node FROM v_asked", 3, "payment_id"))
view("v_asked_back", reach_sql("(SELECT payment_id, src, dst FROM v_gedges UNION SELECT payment_id, dst, src FROM v_gedges)", "SELECT payment_id, target AS root, target AS node FROM v_asked", 2, "payment_id"))


@query("path_between", """
SELECT a.payment_id, a.source, a.target, p.depth :: BIGINT AS depth, p.path,
  p.path IS NULL AND (a.payment_id NOT IN (SELECT payment_id FROM v_asked_out WHERE depth = 3) OR a.payment_id NOT IN (SELECT payment_id FROM v_asked_back WHERE depth = 2)) AS exhausted
FROM v_asked a LEFT JOIN v_asked_paths p ON p.payment_id = a.payment_id AND p.node = a.target""")
def _(f):
    """From the order of each payment to the provider API as a source; where it is none, the search says so."""
    f = f.keeping("payments")  # every hop makes its edges from them
    asked = f.payments.where("order_id IS NOT NULL").select(
        "payment_id", graph.node("ord", "order_id").alias("source"), F.lit("src:PROVIDER_API").alias("target"))
    return graph.path_between(f.investigation_edges, asked, types=("ord", "src"), kinds=graph.INVESTIGATION)


@query("evidence_provenance", """
SELECT evidence_id, 1 AS step, 'EVIDENCE' AS kind, evidence_type AS reference FROM v_pobs UNION ALL SELECT evidence_id, 2, 'PAYMENT_EVENT', event_type FROM v_pobs
UNION ALL SELECT evidence_id, 3, 'WEBHOOK', 'evt_' || webhook_event_id FROM v_pobs UNION ALL SELECT evidence_id, 4, 'PAYMENT', payment_id FROM v_pobs""")
def _(f):
    return graph.provenance_steps(f.payment_obs, f.payment_events, f.events)


view("v_dep_links", "SELECT DISTINCT source_id // 16 AS g, source_id AS src, target_id AS dst FROM v_rel")
view("v_dep_reach", reach_sql("v_dep_links", "SELECT DISTINCT g, src AS root, src AS node FROM v_dep_links", 6, "g"))


@query("evidence_dependencies", """
SELECT d.evidence_id, direct_edges, direct_targets, reachable - direct_targets AS indirect_targets FROM (SELECT source_id AS evidence_id, count(*) AS direct_edges, count(DISTINCT target_id) AS direct_targets FROM v_rel GROUP BY 1) d
JOIN (SELECT root, count(*) AS reachable FROM v_dep_reach WHERE node <> root GROUP BY 1) r ON root = evidence_id""")
def _(f):
    return graph.dependencies(relations.event_edges(f.normalized))


@query("conflict_path", """
SELECT s.payment_id, claim_a_id || '-' || claim_b_id AS conflict_id, side, c.claim_id, c.evidence_id FROM v_status_conflicts s JOIN (VALUES ('A'), ('B')) k(side) ON true
JOIN v_claim_rows c ON c.claim_id = CASE side WHEN 'A' THEN claim_a_id ELSE claim_b_id END""")
def _(f):
    return graph.conflict_paths(f.status_conflicts, f.claim_rows)


# --- lineage -----------------------------------------------------------------------------------
view("v_lsnap", "SELECT payment_id, eval_us, sha256(payment_id || '|' || eval_us || '|EIS_V1') AS trace_id FROM v_int_at")
view("v_lchg", "SELECT c.payment_id, c.eval_us, p_eval_us, c.dimension, direct_cause, causality FROM v_causes c JOIN v_steps s ON s.payment_id = c.payment_id AND s.eval_us = c.eval_us")
view("v_ledges", f"""
SELECT *, {case('edge_type', graph.ROLES)} AS causal_role, 'FOREIGN_KEY' AS linkage_type FROM (
SELECT payment_id, 'hook:' || event_id AS src, 'evt:' || event_id AS dst, 'TRIGGERED' AS edge_type FROM v_norm
UNION ALL SELECT payment_id, 'hook:' || webhook_event_id, 'obs:' || evidence_id, 'PRODUCED' FROM v_pobs UNION ALL SELECT payment_id, 'obs:' || evidence_id, 'fact:' || fact_hash, 'REPRESENTS' FROM v_fact_rows
UNION ALL SELECT payment_id, 'obs:' || evidence_id, 'quality:' || evidence_id, 'MEASURED_BY' FROM v_pobs
UNION ALL SELECT subject_id, 'obs:' || evidence_id, 'claim:' || claim_id, 'SUPPORTS' FROM v_claim_rows WHERE subject_type = 'payment' UNION ALL SELECT payment_id, 'claim:' || claim_id, 'corr:' || claim_id, 'CORROBORATED_BY' FROM v_pclaims
UNION ALL SELECT payment_id, 'claim:' || unnest([claim_a_id, claim_b_id]), 'conf:' || claim_a_id || '-' || claim_b_id, 'CONFLICTED_BY' FROM v_status_conflicts
UNION ALL SELECT payment_id, 'claim:' || claim_id, 'conf:' || payment_id || '-' || claim_type, 'CONFLICTED_BY' FROM v_members
UNION ALL SELECT payment_id, 'integrity:' || payment_id || '@' || eval_us, 'trace:' || trace_id, 'EVALUATED_BY' FROM v_lsnap WHERE trace_id IS NOT NULL
UNION ALL SELECT payment_id, 'state:' || payment_id || '@' || eval_us, 'integrity:' || payment_id || '@' || eval_us, 'MIRRORS' FROM v_lsnap
UNION ALL SELECT payment_id, 'state:' || payment_id || '@' || p_eval_us, 'chg:' || payment_id || '@' || eval_us || '@' || dimension, 'STATE_TRANSITION' FROM v_lchg
UNION ALL SELECT payment_id, 'chg:' || payment_id || '@' || eval_us || '@' || dimension, 'state:' || payment_id || '@' || eval_us, 'STATE_TRANSITION' FROM v_lchg
UNION ALL SELECT o.payment_id, 'obs:' || evidence_id, 'chg:' || o.payment_id || '@' || eval_us || '@' || dimension, 'CAUSED_STATE_CHANGE' FROM v_pobs o JOIN v_lchg c ON c.payment_id = o.payment_id AND dimension = 'EVIDENCE' AND direct_cause = 'NEW_EVIDENCE' AND causality = 'DIRECT'
  AND observed_us > p_eval_us AND observed_us <= eval_us
UNION ALL SELECT DISTINCT payment_id, 'rec:' || fact_hash, 'fact:' || fact_hash, 'RECONCILED_INTO' FROM v_fact_rel WHERE identity_state = 'SAME_FACT_DIFFERENT_SOURCE')""")


def _snaps(f):
    trace_id = key_hash(F.col("payment_id"), F.col("eval_us").cast("string"), F.lit(V.METHODOLOGY))
    return f.integrity_at.select("payment_id", "eval_us", trace_id.alias("trace_id"))


def _lineage(f):
    pairs = evolution.with_previous(evolution.state_snapshot(f.integrity_at))
    # the few times of a payment are one row, so that changes are joined by payment, where they lie
    before = pairs.groupBy("payment_id").agg(F.map_from_entries(F.collect_list(F.struct("eval_us", "p_eval_us"))).alias("before"))
    causes = evolution.change_causes(evolution.state_diff(pairs)).join(shuffled(before), "payment_id").withColumn(
        "p_eval_us", F.col("before")[F.col("eval_us")]).drop("before")
    decided = reliability.fact_support(f.fact_rows).filter("has_pair").select("payment_id", "fact_hash")
    return graph.lineage_edges(f.payment_events, f.fact_rows, f.claim_rows, decided, f.status_conflicts,
                               conflicts.conflict_members(f.payment_claims), _snaps(f), causes)


@query("lineage_edges", "SELECT * FROM v_ledges")
def _(f):
    return f.by_payment(lambda own: _lineage(own.keeping("integrity_at")))


@query("lineage_nodes", "SELECT payment_id, node, split_part(node, ':', 1) AS node_type FROM (SELECT payment_id, src AS node FROM v_ledges UNION SELECT payment_id, dst FROM v_ledges)")
def _(f):
    return f.by_payment(lambda own: graph.lineage_nodes(_lineage(own.keeping("integrity_at"))))


@query("lineage_completeness", """
SELECT p.payment_id, coalesce(o, 0) AS n_obs, coalesce(fa, 0) AS n_facts, coalesce(cl, 0) AS n_claims, coalesce(i, 0) AS n_integrity, coalesce(t, 0) AS n_trace,
  CASE WHEN coalesce(i, 0) = 0 THEN 1 ELSE i - t END AS gaps, CASE WHEN coalesce(o, 0) = 0 OR coalesce(i, 0) = 0 THEN 'BROKEN' WHEN coalesce(t, 0) = 0 OR i > t THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness
FROM v_payments p LEFT JOIN (SELECT payment_id, count(*) AS o FROM v_pobs GROUP BY 1) a ON a.payment_id = p.payment_id LEFT JOIN (SELECT payment_id, count(*) AS fa FROM v_facts GROUP BY 1) b ON b.payment_id = p.payment_id
LEFT JOIN (SELECT payment_id, count(*) AS cl FROM v_pclaims GROUP BY 1) c ON c.payment_id = p.payment_id LEFT JOIN (SELECT payment_id, count(*) AS i, count(trace_id) AS t FROM v_lsnap GROUP BY 1) s ON s.payment_id = p.payment_id""")
def _(f):
    return graph.lineage_completeness(f.payments, f.evidence_totals, f.facts, f.payment_claims, _snaps(f))


@query("trace_lineage", f"""
SELECT t.payment_id, t.trace_id, o.evidence_id, o.webhook_event_id, o.fact_hash FROM v_lsnap t JOIN v_fact_rows o ON o.payment_id = t.payment_id AND o.observed_us <= t.eval_us WHERE t.eval_us = {T2} AND trace_id IS NOT NULL""")
def _(f):
    """Backward from each trace taken at T2 to the observations and deliveries it rests on."""
    traces = _snaps(f).filter((F.col("eval_us") == T2) & F.col("trace_id").isNotNull()).select("payment_id", "trace_id")
    seen = f.fact_rows.filter(F.col("observed_us") <= T2).select("payment_id", "evidence_id", "webhook_event_id", "fact_hash")
    return seen.join(shuffled(traces), "payment_id")


@query("fact_lineage", """
SELECT r.payment_id, r.fact_hash, r.evidence_id, r.webhook_event_id, c.claim_id FROM v_fact_rows r LEFT JOIN v_claim_rows c ON c.evidence_id = r.evidence_id""")
def _(f):
    return f.fact_rows.select("payment_id", "fact_hash", "evidence_id", "webhook_event_id").join(
        shuffled(f.claim_rows.select("evidence_id", "claim_id")), "evidence_id", "left")


view("v_lroots", "SELECT payment_id, 'integrity:' || payment_id || '@' || max(eval_us) AS node FROM v_lsnap GROUP BY 1")
view("v_lpaths", paths_sql("v_ledges", "SELECT payment_id, node FROM v_lroots", 4))


@query("lineage_path", "SELECT payment_id, depth, path FROM v_lpaths WHERE node LIKE 'chg:%@EVIDENCE'")
def _(f):
    """From the latest integrity snapshot to the evidence changes behind it."""
    f = f.keeping("integrity_at")  # every hop makes its edges from it
    roots = _snaps(f).groupBy("payment_id").agg(F.max("eval_us").alias("eval_us")).select(
        "payment_id", graph.node("integrity", F.concat_ws("@", "payment_id", F.col("eval_us").cast("string"))).alias("node"))
    found = graph.paths(_lineage(f), roots, 4, "node LIKE 'chg:%@EVIDENCE'", "integrity", "chg", graph.LINEAGE)
    return found.select("payment_id", "depth", "path")
