"""Defense verdicts, text claims and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.operators import defense, evalmetrics
from veritrail.plans.frames import T_DEFENSE as T_DEF
from veritrail.plans.oracle_base import case, inlist
from veritrail.plans.registry import query, view
from veritrail.sources.defense_tables import EXPECTED, SOURCE_OF
from veritrail.sources.landing import absent_rows

LABELS = tuple(V.LABEL_PRECEDENCE)

view("v_cases", f"""
SELECT o_orderkey, 'case_' || o_orderkey AS case_id, 'pay_o' || o_orderkey AS payment_reference, CASE WHEN o_orderkey % 13 <> 0 THEN 'order_' || o_orderkey END AS order_reference,
  'The parcel was ' || CASE WHEN o_orderkey % 3 = 0 THEN 'delivered' ELSE 'sent' END || ' to the buyer.' || CASE WHEN o_orderkey % 5 = 0 THEN ' The customer signed for it.' ELSE '' END
   || CASE WHEN o_orderkey % 4 = 1 THEN ' Goods received in full.' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN ' Arrival on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' ELSE '' END AS description,
  {case('o_orderpriority', EXPECTED)} AS expected_label, epoch_us(o_orderdate) AS ordered_us FROM orders""")
view("v_dclaims", """
SELECT case_id || '_c' || c AS claim_id, case_id, payment_reference, order_reference, o_orderkey, c, ordered_us FROM v_cases JOIN (VALUES (1), (2)) t(c) ON o_orderkey % 17 <> 0 AND (c = 1 OR o_orderkey % 4 = 0)""")
view("v_dlinks", f"""
SELECT *, 'case_' || l_orderkey || '_c' || c AS claim_id FROM (
SELECT l_orderkey * 100 + l_linenumber AS evidence_id, l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 1 + l_linenumber % 2 ELSE 1 END AS c, 'DELIVERY_PROOF' AS evidence_type,
  CASE WHEN l_linenumber % 5 = 0 THEN 'left near door' WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'in_transit' END AS value,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'CONTRADICTING' ELSE 'SUPPORTING' END AS link_type, {case('l_suppkey % 7', SOURCE_OF)} AS source_type,
  CASE WHEN l_suppkey % 11 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS source_reference, epoch_us(l_shipdate) AS observed_us,
  CASE WHEN l_partkey % 6 = 0 THEN epoch_us(l_shipdate) + 400 * 86400000000 END AS valid_until_us FROM lineitem
UNION ALL SELECT o_orderkey * 100 + 50 + c, o_orderkey, c, 'PAYMENT_ID_MATCH', CASE WHEN o_orderkey % 9 = 0 THEN 'pay_other' ELSE payment_reference END, 'SUPPORTING', 'MERCHANT_DOCUMENT',
  CASE WHEN o_orderkey % 15 = 0 THEN 'doc_' ELSE 'pm_' END || o_orderkey, ordered_us, NULL FROM v_dclaims WHERE o_orderkey % 10 <> 3
UNION ALL SELECT o_orderkey * 100 + 60 + c, o_orderkey, c, 'ORDER_ID_MATCH', CASE WHEN o_orderkey % 12 = 5 THEN 'order_other' ELSE 'order_' || o_orderkey END, 'SUPPORTING', 'MERCHANT_DOCUMENT',
  CASE WHEN o_orderkey % 15 = 0 THEN 'doc_' ELSE 'om_' END || o_orderkey, ordered_us, NULL FROM v_dclaims WHERE o_orderkey % 14 <> 1)""")
_VALID = f"(observed_us <= {T_DEF} AND (valid_until_us IS NULL OR valid_until_us >= {T_DEF}))"
_PROV = f"(source_type IN {inlist(V.DEFENSE_SOURCES)} AND source_reference IS NOT NULL)"
_MATCH = """CASE evidence_type WHEN 'PAYMENT_ID_MATCH' THEN value = payment_reference ELSE order_reference IS NULL OR value = order_reference END"""
_DELIV = "CASE WHEN value LIKE 'delivered%' THEN 'COMPLETE' WHEN value LIKE '%in_transit%' THEN 'INCOMPLETE' ELSE 'AMBIGUOUS' END"


def verdict_views(prefix: str, links: str, claims: str) -> None:
    view(f"v_{prefix}_items", f"""
SELECT *, evidence_type LIKE '%ID_MATCH' AS is_entity, {_PROV} AS clean, {_MATCH} AS matched, {_DELIV} AS delivery FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id, source_type, source_reference ORDER BY evidence_id, evidence_type, value) AS rn FROM {links} WHERE link_type = 'SUPPORTING' AND {_VALID}) JOIN (SELECT claim_id AS cid, payment_reference, order_reference FROM {claims}) ON cid = claim_id WHERE rn = 1""")
    view(f"v_{prefix}_verdicts", f"""
SELECT claim_id, case_id, CASE WHEN n_links = 0 THEN 'UNKNOWN' WHEN n_contradicting > 0 THEN 'CONTRADICTED' WHEN missing_types = 'DELIVERY_PROOF' AND n_inconclusive > 0 THEN 'UNKNOWN'
  WHEN missing_types <> '' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED' END AS label, missing_types, n_links, n_contradicting, n_supporting, n_mismatch
FROM (SELECT c.claim_id, c.case_id, coalesce(n_links, 0) AS n_links, coalesce(n_contradicting, 0) AS n_contradicting, coalesce(n_supporting, 0) AS n_supporting, coalesce(n_mismatch, 0) AS n_mismatch,
    coalesce(n_inconclusive, 0) AS n_inconclusive, concat_ws(',', CASE WHEN coalesce(d, 0) = 0 THEN 'DELIVERY_PROOF' END, CASE WHEN coalesce(o, 0) = 0 THEN 'ORDER_ID_MATCH' END, CASE WHEN coalesce(p, 0) = 0 THEN 'PAYMENT_ID_MATCH' END) AS missing_types
  FROM {claims} c LEFT JOIN (SELECT claim_id, count(*) AS n_links, count(*) FILTER (WHERE link_type = 'CONTRADICTING' AND {_VALID}) AS n_contradicting FROM {links} GROUP BY 1) t ON t.claim_id = c.claim_id
  LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE ok) AS n_supporting, count(*) FILTER (WHERE clean AND NOT is_entity AND delivery <> 'COMPLETE') AS n_inconclusive, count(*) FILTER (WHERE clean AND is_entity AND NOT matched) AS n_mismatch,
      count(*) FILTER (WHERE ok AND evidence_type = 'DELIVERY_PROOF') AS d, count(*) FILTER (WHERE ok AND evidence_type = 'ORDER_ID_MATCH') AS o, count(*) FILTER (WHERE ok AND evidence_type = 'PAYMENT_ID_MATCH') AS p
    FROM (SELECT *, clean AND CASE WHEN is_entity THEN matched ELSE delivery = 'COMPLETE' END AS ok FROM v_{prefix}_items) GROUP BY 1) f ON f.claim_id = c.claim_id)""")


verdict_views("d", "v_dlinks", "v_dclaims")
view("v_preds", f"""
SELECT c.case_id, c.expected_label, coalesce(label, 'UNKNOWN') AS predicted, coalesce(n, 0) AS n_claims FROM v_cases c
LEFT JOIN (SELECT case_id, arg_min(label, {case('label', V.LABEL_PRECEDENCE)}) AS label, count(*) AS n FROM v_d_verdicts GROUP BY 1) v ON v.case_id = c.case_id""")


@query("evidence_validity", f"SELECT evidence_id, {_VALID} AS is_valid FROM v_dlinks")
def _(f):
    return f.defense_links.select("evidence_id", defense.evidence_valid(T_DEF).alias("is_valid"))


@query("provenance_valid", f"SELECT evidence_id, {_PROV} AS provenance_ok FROM v_dlinks")
def _(f):
    return f.defense_links.select("evidence_id", defense.provenance_valid().alias("provenance_ok"))


@query("entity_match", f"SELECT evidence_id, {_MATCH} AS matched FROM v_dlinks l JOIN v_dclaims c ON c.claim_id = l.claim_id WHERE evidence_type LIKE '%ID_MATCH'")
def _(f):
    links = f.defense_links.filter(F.col("evidence_type").isin(*V.ENTITY_MATCH_TYPES))
    refs = f.defense_claims.select("claim_id", "payment_reference", "order_reference")
    return links.join(refs, "claim_id").select("evidence_id", defense.entity_match().alias("matched"))


@query("delivery_status", f"SELECT evidence_id, {_DELIV} AS delivery_status FROM v_dlinks WHERE evidence_type = 'DELIVERY_PROOF'")
def _(f):
    return f.defense_links.filter("evidence_type = 'DELIVERY_PROOF'").select("evidence_id", defense.delivery_status().alias("delivery_status"))


@query("source_first_seen", "SELECT claim_id, evidence_id, source_type, source_reference FROM v_d_items")
def _(f):
    return defense.surviving_sources(f.defense_links.join(f.defense_claims.select("claim_id"), "claim_id", "left_semi"), T_DEF).select(
        "claim_id", "evidence_id", "source_type", "source_reference")


@query("missing_types", "SELECT claim_id, missing_types FROM v_d_verdicts")
def _(f):
    return f.claim_verdicts.select("claim_id", "missing_types")


@query("defense_claim_verdict", "SELECT * FROM v_d_verdicts")
def _(f):
    return f.claim_verdicts


@query("defense_case_verdict", "SELECT case_id, predicted, n_claims FROM v_preds")
def _(f):
    return f.predictions.drop("expected_label")


@query("case_view", """
SELECT c.case_id, d.claim_id, l.evidence_id, l.link_type, l.evidence_type FROM v_cases c JOIN v_dclaims d ON d.case_id = c.case_id LEFT JOIN v_dlinks l ON l.claim_id = d.claim_id""")
def _(f):
    return f.cases.select("case_id").join(f.defense_claims.select("claim_id", "case_id"), "case_id").join(
        f.defense_links.select("claim_id", "evidence_id", "link_type", "evidence_type"), "claim_id", "left")


@query("case_analysis", "SELECT p.case_id, p.expected_label, p.predicted, p.expected_label = p.predicted AS correct, v.claim_id, v.label FROM v_preds p LEFT JOIN v_d_verdicts v ON v.case_id = p.case_id")
def _(f):
    return f.predictions.select("case_id", "expected_label", "predicted", (F.col("expected_label") == F.col("predicted")).alias("correct")).join(
        f.claim_verdicts.select("case_id", "claim_id", "label"), "case_id", "left")


# --- text claims ---------------------------------------------------------------------------------
def _sentence(p: str) -> str:
    body = "(?:" + p + ")"
    return f"substr(regexp_replace(regexp_extract(t, '[^.]*{body}[^.]*'), '^\\s+|\\s+$', '', 'g'), 1, 200)"


_DATE = "CASE WHEN regexp_matches(t, '\\d{4}-\\d{2}-\\d{2}') THEN regexp_extract(t, '\\d{4}-\\d{2}-\\d{2}') " + " ".join(
    f"WHEN regexp_matches(t, '{m}\\w*\\s+\\d{{1,2}}') THEN coalesce(nullif(regexp_extract(t, '{m}\\w*\\s+(\\d{{1,2}})(?:st|nd|rd|th)?(?:\\s*,?\\s*(\\d{{4}}))?', 2), ''), '2026') || '-{i + 1:02d}-' || lpad(regexp_extract(t, '{m}\\w*\\s+(\\d{{1,2}})', 1), 2, '0')"
    for i, m in enumerate(V.MONTHS)) + " END"


def claims_sql(src: str, key: str, text: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{k}' AS claim_type, {_sentence(p)} AS claim_text, 0.9 :: DOUBLE AS confidence, NULL :: VARCHAR AS normalized_value FROM t WHERE regexp_matches(t, '{p}')" for k, p in V.CLAIM_PATTERNS)
    return f"""WITH t AS (SELECT {key}, lower({text}) AS t FROM {src}), c AS ({parts} UNION ALL SELECT {key}, 'DELIVERY_DATE', 'Delivery date: ' || d, 0.85, d FROM (SELECT {key}, {_DATE} AS d FROM t) WHERE d IS NOT NULL)
SELECT *, 'OK' AS semantic_status FROM c UNION ALL SELECT {key}, NULL, NULL, NULL, NULL, 'UNPARSEABLE' FROM t WHERE {key} NOT IN (SELECT {key} FROM c)"""


@query("claim_extraction", claims_sql("v_cases", "case_id", "description"))
def _(f):
    return defense.extract_claims(f.cases, "case_id", "description")


@query("claim_extraction_documents", claims_sql("documents", "doc_id", "text"))
def _(f):
    """The same over the free text of the document table, whole texts."""
    return defense.extract_claims(f.table("documents").select("doc_id", "text"), "doc_id", "text")


view("v_found", claims_sql("v_cases", "case_id", "description"))
view("v_xclaims", "SELECT c.case_id || ':' || claim_type AS claim_id, c.case_id, claim_type, payment_reference, order_reference FROM v_found x JOIN v_cases c ON c.case_id = x.case_id WHERE claim_type IS NOT NULL")
view("v_candidates", "SELECT 'pay_o' || l_orderkey AS payment_reference, evidence_id, evidence_type, value, source_type, source_reference, observed_us, valid_until_us FROM v_dlinks")
_REL = """CASE WHEN claim_type IN ('DELIVERY_COMPLETED', 'CUSTOMER_RECEIVED_GOODS') OR (claim_type = 'DELIVERY_DATE' AND evidence_type = 'DELIVERY_PROOF') THEN 'RELEVANT' ELSE 'UNCERTAIN' END"""
view("v_matched", f"SELECT x.claim_id, x.case_id, x.claim_type, e.*, {_REL} AS relationship FROM v_xclaims x JOIN v_candidates e ON e.payment_reference = x.payment_reference")


@query("evidence_matching", "SELECT claim_id, evidence_id, relationship, CASE relationship WHEN 'RELEVANT' THEN 0.85 ELSE 0.7 END :: DOUBLE AS match_confidence FROM v_matched")
def _(f):
    return defense.match_claims(f.extracted_claims, f.candidates).select("claim_id", "evidence_id", "relationship", "match_confidence")


@query("orphan_references", "SELECT claim_id, evidence_id + 7 AS evidence_id FROM v_matched WHERE evidence_id % 10 = 1 AND evidence_id + 7 NOT IN (SELECT evidence_id FROM v_candidates)")
def _(f):
    """Proposed matches, some with an invented evidence id: the invented ones are rejected."""
    proposed = defense.match_claims(f.extracted_claims, f.candidates).select("claim_id", "evidence_id", "relationship")
    invented = proposed.filter("evidence_id % 10 = 1").withColumn("evidence_id", F.col("evidence_id") + 7)
    return defense.rejected_references(proposed.unionByName(invented), f.candidates).select("claim_id", "evidence_id")


view("v_xlinks", "SELECT *, 'SUPPORTING' AS link_type FROM (SELECT * EXCLUDE (payment_reference, case_id) FROM v_matched) WHERE relationship = 'RELEVANT'")
verdict_views("x", "v_xlinks", "v_xclaims")


@query("defense_verify", f"""
SELECT c.case_id, c.expected_label, coalesce(label, 'UNKNOWN') AS predicted, coalesce(n, 0) AS n_claims FROM v_cases c
LEFT JOIN (SELECT case_id, arg_min(label, {case('label', V.LABEL_PRECEDENCE)}) AS label, count(*) AS n FROM v_x_verdicts GROUP BY 1) v ON v.case_id = c.case_id""")
def _(f):
    return defense.defense_verify(f.cases, f.candidates, T_DEF)


# --- metrics ---------------------------------------------------------------------------------------
view("v_cm", f"""
SELECT e AS expected_label, p AS predicted, count(case_id) AS n FROM (SELECT unnest({list(LABELS)}) AS e) CROSS JOIN (SELECT unnest({list(LABELS)}) AS p)
LEFT JOIN v_preds ON expected_label = e AND predicted = p GROUP BY ALL""")
_METRICS = """
SELECT {by} label, tp :: BIGINT AS tp, (assigned - tp) :: BIGINT AS fp, (support - tp) :: BIGINT AS fn, support :: BIGINT AS support, tp / nullif(assigned, 0) AS precision, tp / nullif(support, 0) AS recall,
  2 * (tp / nullif(assigned, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(assigned, 0) + tp / nullif(support, 0), 0) AS f1
FROM (SELECT {by} expected_label AS label, sum(n) AS support, sum(n) FILTER (WHERE expected_label = predicted) AS tp FROM {src} GROUP BY ALL)
JOIN (SELECT {by} predicted AS label, sum(n) AS assigned FROM {src} GROUP BY ALL) USING ({by} label)"""
view("v_metrics", _METRICS.format(by="", src="v_cm"))
_SUMMARY = """SELECT {by} sum(support) :: BIGINT AS total, sum(tp) :: BIGINT AS correct, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(avg(coalesce(f1, 0)), 6) AS macro_f1_zero_filled FROM {src} GROUP BY ALL"""


@query("confusion_matrix", "SELECT * FROM v_cm")
def _(f):
    return evalmetrics.confusion_matrix(f.keeping("predictions").predictions)


@query("class_metrics", "SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM v_metrics")
def _(f):
    m = evalmetrics.class_metrics(evalmetrics.confusion_matrix(f.keeping("predictions").predictions))
    return m.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("evaluation_summary", _SUMMARY.format(by="", src="v_metrics"))
def _(f):
    return evalmetrics.summary(evalmetrics.class_metrics(evalmetrics.confusion_matrix(f.keeping("predictions").predictions)))


_LANE = "sum(('0x' || substr({h}, {i}, 15)) :: BIGINT) :: VARCHAR"
_PH = "sha256(concat_ws('|', case_id, expected_label, predicted))"


@query("evaluation_run", f"""
SELECT total, correct, accuracy, macro_f1, sha256(concat_ws('|', (SELECT {_LANE.format(h=_PH, i=1)} FROM v_preds), (SELECT {_LANE.format(h=_PH, i=16)} FROM v_preds), correct)) AS results_fingerprint
FROM ({_SUMMARY.format(by='', src='v_metrics')})""")
def _(f):
    return evalmetrics.evaluation_run(f.keeping("predictions").predictions)


_SAFETY = """SELECT {by} count(*) AS total, count(*) FILTER (WHERE predicted = 'SUPPORTED' AND expected_label <> 'SUPPORTED') AS false_supported,
 round(count(*) FILTER (WHERE predicted = 'SUPPORTED' AND expected_label <> 'SUPPORTED') / count(*), 6) AS false_supported_rate,
 count(*) FILTER (WHERE expected_label = 'CONTRADICTED' AND predicted <> 'CONTRADICTED') AS contradiction_misses,
 round(count(*) FILTER (WHERE expected_label = 'CONTRADICTED' AND predicted <> 'CONTRADICTED') / count(*) FILTER (WHERE expected_label = 'CONTRADICTED'), 6) AS contradiction_miss_rate FROM {src} GROUP BY ALL"""


@query("safety_metrics", _SAFETY.format(by="", src="v_preds"))
def _(f):
    return evalmetrics.safety_metrics(f.keeping("predictions").predictions)


view("v_tracks", f"""
SELECT 'A_RULES' AS track, case_id, expected_label, predicted FROM v_preds UNION ALL SELECT 'B_TEXT', c.case_id, c.expected_label, coalesce(label, 'UNKNOWN') FROM v_cases c
LEFT JOIN (SELECT case_id, arg_min(label, {case('label', V.LABEL_PRECEDENCE)}) AS label FROM v_x_verdicts GROUP BY 1) v ON v.case_id = c.case_id
UNION ALL SELECT 'C_CONSTANT', case_id, expected_label, 'SUPPORTED' FROM v_cases""")
view("v_track_cm", f"""
SELECT t AS track, e AS expected_label, p AS predicted, count(case_id) AS n FROM (SELECT unnest({list(LABELS)}) AS e) CROSS JOIN (SELECT unnest({list(LABELS)}) AS p) CROSS JOIN (SELECT DISTINCT track AS t FROM v_tracks)
LEFT JOIN v_tracks ON expected_label = e AND predicted = p AND track = t GROUP BY ALL""")
view("v_track_metrics", _METRICS.format(by="track,", src="v_track_cm"))
view("v_track_sum", _SUMMARY.format(by="track,", src="v_track_metrics"))


@query("track_comparison", f"""
SELECT s.track, accuracy, macro_f1, false_supported, contradiction_misses, round(accuracy - (SELECT accuracy FROM v_track_sum WHERE track = 'A_RULES'), 6) AS accuracy_delta,
  round(macro_f1 - (SELECT macro_f1 FROM v_track_sum WHERE track = 'A_RULES'), 6) AS macro_f1_delta
FROM v_track_sum s JOIN ({_SAFETY.format(by='track,', src='v_tracks')}) y ON y.track = s.track""")
def _(f):
    """Rules on linked evidence, the text path, and a constant answer."""
    a = f.predictions.select(F.lit("A_RULES").alias("track"), "case_id", "expected_label", "predicted")
    b = defense.defense_verify(f.cases, f.candidates, T_DEF).select(F.lit("B_TEXT").alias("track"), "case_id", "expected_label", "predicted")
    c = f.cases.select(F.lit("C_CONSTANT").alias("track"), "case_id", "expected_label", F.lit("SUPPORTED").alias("predicted"))
    return evalmetrics.track_comparison(a.unionByName(b).unionByName(c), "A_RULES")


@query("cohens_kappa", """
WITH r AS (SELECT quality AS a, 1 - toxic AS b FROM labels), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) / count(*) AS po,
  (count(*) FILTER (WHERE a = 1) * count(*) FILTER (WHERE b = 1) + count(*) FILTER (WHERE a = 0) * count(*) FILTER (WHERE b = 0)) / (count(*) * count(*)) AS pe, count(*) FILTER (WHERE a <> b) AS disagreements FROM r)
SELECT n, round(po, 4) AS raw_agreement, round(pe, 4) AS expected_agreement, round((po - pe) / (1 - pe), 4) AS kappa,
  CASE WHEN (po - pe) / (1 - pe) < 0 THEN 'poor' WHEN (po - pe) / (1 - pe) < 0.2 THEN 'slight' WHEN (po - pe) / (1 - pe) < 0.4 THEN 'fair' WHEN (po - pe) / (1 - pe) < 0.6 THEN 'moderate' WHEN (po - pe) / (1 - pe) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band, disagreements FROM s""")
def _(f):
    return evalmetrics.cohens_kappa(f.table("labels").select(F.col("quality").alias("first"), (1 - F.col("toxic")).alias("second")))


@query("majority_baseline", "SELECT arg_max(expected_label, (n, expected_label)) AS majority_label, round(max(n) / sum(n), 6) AS accuracy FROM (SELECT expected_label, count(*) AS n FROM v_cases GROUP BY 1)")
def _(f):
    return evalmetrics.majority_baseline(f.cases)


_CH = "sha256(concat_ws('|', case_id, payment_reference, order_reference, description, expected_label))"


@query("dataset_fingerprint", f"""
SELECT count(*) AS cases, {', '.join(f"count(*) FILTER (WHERE expected_label = '{x}') AS n_{x.lower()}" for x in LABELS)},
  sha256(concat_ws('|', count(*), {_LANE.format(h=_CH, i=1)}, {_LANE.format(h=_CH, i=16)})) AS fingerprint FROM v_cases""")
def _(f):
    return evalmetrics.dataset_fingerprint(f.cases)


@query("dataset_list", "SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'dev' ELSE 'holdout' END AS split, expected_label, count(*) AS cases FROM v_cases GROUP BY ALL")
def _(f):
    split = F.when(F.col("o_orderkey") % 10 < 8, "dev").otherwise("holdout")
    return f.cases.groupBy(split.alias("split"), "expected_label").agg(F.count("*").alias("cases"))


@query("run_list", "SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'dev' ELSE 'holdout' END AS split, count(*) AS evaluated, count(*) FILTER (WHERE p.expected_label = predicted) AS correct, round(count(*) FILTER (WHERE p.expected_label = predicted) / count(*), 6) AS accuracy FROM v_preds p JOIN v_cases c ON c.case_id = p.case_id GROUP BY ALL")
def _(f):
    split = F.when(F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint") % 10 < 8, "dev").otherwise("holdout")
    hit = F.count_if(F.col("expected_label") == F.col("predicted"))
    return f.predictions.groupBy(split.alias("split")).agg(
        F.count("*").alias("evaluated"), hit.alias("correct"), F.round(hit / F.count("*"), 6).alias("accuracy"))


@query("freeze_guard", "SELECT case_id, expected_label FROM v_cases WHERE o_orderkey % 10 >= 8")
def _(f):
    """Re-seeding a frozen dataset adds only what it does not hold and changes nothing it holds."""
    frozen = f.cases.filter("o_orderkey % 10 < 8").select("case_id", "expected_label")
    seed = f.cases.select("case_id", "expected_label")
    return absent_rows(seed, frozen, ["case_id"])
