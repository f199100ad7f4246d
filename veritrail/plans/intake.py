"""Landing, canonicalisation, scans and look-ups."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from veritrail.functions.expr import hmac_sha256, us
from veritrail.operators import canonical, search, textindex
from veritrail.plans.frames import T1, T2, T_EVAL
from veritrail.plans.registry import query, view
from veritrail.sources import landing

SECRET, WRONG_SECRET = "whsec_fixture", "whsec_other"


def _pad(secret: str, byte: int) -> str:
    key = secret.encode().ljust(64, b"\0")
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in key) + "'::BLOB"


def _hmac_sql(secret: str, body: str) -> str:
    return f"sha256({_pad(secret, 0x5C)} || unhex(sha256({_pad(secret, 0x36)} || encode({body}))))"


def _field(name: str, expr: str, quoted: bool = True) -> str:
    value = f"'\"' || {expr} || '\"'" if quoted else f"CAST({expr} AS VARCHAR)"
    return f"""coalesce(',"{name}":' || {value}, '')"""


view("v_bodies", f"""
SELECT event_id, received_us, k, full_body AS body FROM (
 SELECT *, '{{"id":"' || provider_event_id || '","entity":"event","account_id":"acc_main","event":"' || event_type
   || '","created_at":' || CAST(floor(observed_us / 1000000.0) AS BIGINT)
   || ',"payload":{{"payment":{{"entity":{{"id":"' || payment_id || '"'
   || {_field('order_id', 'order_id')} || {_field('customer_id', 'customer_id')} || {_field('amount', 'amount_minor', False)}
   || {_field('currency', 'currency')} || {_field('method', 'method')}
   || CASE WHEN method = 'card' THEN ',"card_id":"card_' || k || '"' ELSE '' END
   || CASE WHEN method = 'upi' THEN ',"vpa":"' || customer_id || '@upi"' ELSE '' END || '}}}}'
   || CASE WHEN event_type = 'order.paid' AND order_id IS NOT NULL THEN ',"order":{{"entity":{{"id":"' || order_id || '","status":"paid"'
        || {_field('amount', 'amount_minor', False)} || ',"currency":"' || currency || '","customer_id":"' || customer_id || '"}}}}' ELSE '' END
   || '}}}}' AS full_body
 FROM v_ev)""")


@query("webhook_landing", """
SELECT event_id, NOT json_valid(body) AS rejected,
  CASE WHEN json_valid(body) THEN body ->> '$.event' END AS event_type,
  CASE WHEN json_valid(body) THEN body ->> '$.id' END AS provider_event_id,
  CASE WHEN json_valid(body) THEN body ->> '$.account_id' END AS account_id,
  CASE WHEN json_valid(body) THEN CAST(body ->> '$.created_at' AS BIGINT) END AS created_s,
  CASE WHEN json_valid(body) THEN body ->> '$.payload.payment.entity.id' END AS payment_id,
  CASE WHEN json_valid(body) THEN coalesce(body ->> '$.payload.payment.entity.order_id', body ->> '$.payload.order.entity.id') END AS order_id
FROM v_bodies""")
def _(f):
    return landing.landing(f.bodies).drop("received_at")


@query("signature_verify", f"""
SELECT event_id, sig = {_hmac_sql(SECRET, 'body')} AS verified FROM (
  SELECT *, CASE WHEN k % 31 = 0 THEN NULL WHEN k % 29 = 0 THEN {_hmac_sql(WRONG_SECRET, 'body')} ELSE {_hmac_sql(SECRET, 'body')} END AS sig FROM v_bodies)
WHERE sig IS NOT NULL UNION ALL SELECT event_id, false FROM v_bodies WHERE k % 31 = 0""")
def _(f):
    signed = f.bodies.withColumn(
        "signature",
        F.when(F.col("k") % 31 == 0, F.lit(None)).when(F.col("k") % 29 == 0, hmac_sha256(WRONG_SECRET, F.col("body")))
        .otherwise(hmac_sha256(SECRET, F.col("body"))),
    )
    return landing.verify_signatures(signed, SECRET).select("event_id", "verified")


@query("payload_hash", "SELECT event_id, sha256(body) AS payload_hash FROM v_bodies")
def _(f):
    return f.bodies.select("event_id", F.sha2("body", 256).alias("payload_hash"))


@query("event_dedup", """
SELECT webhook_event_id, provider_event_id, event_type, received_us FROM (
  SELECT *, row_number() OVER (PARTITION BY provider_event_id ORDER BY received_us, webhook_event_id) AS rn FROM v_deliveries)
WHERE rn = 1 OR provider_event_id IS NULL""")
def _(f):
    return landing.dedup_events(f.deliveries).select(
        "webhook_event_id", "provider_event_id", "event_type", us("received_at").alias("received_us"))


@query("duplicate_report", """
SELECT count(*) AS received, count(provider_event_id) - count(DISTINCT provider_event_id) AS duplicates,
  count(*) - count(provider_event_id) AS without_id,
  count(*) FILTER (WHERE processing_status = 'PROCESSED') AS processed,
  count(*) FILTER (WHERE processing_status = 'FAILED') AS failed,
  count(*) FILTER (WHERE processing_status = 'RECEIVED') AS pending FROM v_deliveries""")
def _(f):
    return landing.duplicate_report(f.deliveries)


@query("entity_scans", """
SELECT p.payment_id, p.status, p.order_id, p.customer_id, p.amount_minor, p.last_us, o.status AS order_status
FROM v_payments p LEFT JOIN v_orders o ON o.order_id = p.order_id""")
def _(f):
    p = f.payments.select("payment_id", "status", "order_id", "customer_id", "amount_minor",
                          us("last_observed_at").alias("last_us"))
    return p.join(f.orders.select("order_id", F.col("status").alias("order_status")), "order_id", "left")


_FEEDS = """
SELECT 'webhook' AS feed, event_id AS id, observed_us AS ts_us FROM v_ev
UNION ALL SELECT 'payment_event', event_id, observed_us FROM v_norm
UNION ALL SELECT 'observation', evidence_id, observed_us FROM v_obs"""
view("v_feeds", _FEEDS)


def feeds(f):
    pick = lambda df, name, id_col, ts: df.select(
        F.lit(name).alias("feed"), F.col(id_col).alias("id"), us(ts).alias("ts_us"))
    return (
        pick(f.events, "webhook", "event_id", "observed_at")
        .unionByName(pick(f.payment_events, "payment_event", "payment_event_id", "event_time"))
        .unionByName(pick(f.observations, "observation", "evidence_id", "observed_at"))
    )


@query("incremental_scan", """
SELECT feed, id, ts_us FROM (
  SELECT *, row_number() OVER (PARTITION BY feed ORDER BY id) AS rn FROM (
    SELECT v.*, c.cur FROM v_feeds v JOIN (SELECT feed, max(id) // 2 AS cur FROM v_feeds GROUP BY 1) c ON c.feed = v.feed)
  WHERE id > cur) WHERE rn <= 10""")
def _(f):
    """Next ten rows after each feed's cursor; the cursor is half-way through the feed."""
    rows = feeds(f)
    cursor = rows.groupBy("feed").agg(F.floor(F.max("id") / 2).alias("cursor"))
    from pyspark.sql import Window
    w = Window.partitionBy("feed").orderBy("id")
    later = rows.join(F.broadcast(cursor), "feed").filter("id > cursor")  # one row per feed
    return later.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("feed", "id", "ts_us")


@query("recent_events", """
SELECT feed, id, ts_us FROM (
  SELECT * FROM v_feeds
  UNION ALL SELECT 'fact', first_evidence_id, last_us FROM v_facts) ORDER BY ts_us DESC, feed, id DESC LIMIT 50""")
def _(f):
    fact = f.facts.select(F.lit("fact").alias("feed"), F.col("first_evidence_id").alias("id"), F.col("last_us").alias("ts_us"))
    return feeds(f).unionByName(fact).orderBy(F.desc("ts_us"), "feed", F.desc("id")).limit(50)


@query("append_if_absent", f"""
SELECT payment_event_id, payment_id, event_type FROM (
  SELECT event_id AS payment_event_id, payment_id, event_type FROM v_norm) WHERE payment_event_id NOT IN (
  SELECT event_id FROM v_norm WHERE observed_us <= {T1})""")
def _(f):
    """What a repeated load adds when everything up to T1 is already stored and T1.. arrives twice."""
    stored = f.payment_events.filter(us("event_time") <= T1)
    batch = f.payment_events.unionByName(f.payment_events.filter(us("event_time") > T2))
    return landing.absent_rows(batch, stored, ["payment_event_id"]).select("payment_event_id", "payment_id", "event_type")


@query("normalize_event", """
SELECT event_id, event_type, entity_type, entity_id, order_id, payment_id, customer_id, amount_minor, currency, method,
  CASE WHEN method = 'card' THEN 'card_id=card_' || k WHEN method = 'upi' THEN 'vpa=' || customer_id || '@upi' END AS details,
  CAST(floor(observed_us / 1000000.0) AS BIGINT) AS event_s
FROM (SELECT * REPLACE (CASE WHEN event_type = 'order.paid' AND order_id IS NULL THEN NULL ELSE order_id END AS order_id) FROM v_norm)""")
def _(f):
    n = landing.normalize_bodies(f.bodies)
    text = F.array_join(F.transform(F.map_entries("method_details"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return n.select(
        "event_id", "event_type", "entity_type", "entity_id", "order_id", "payment_id", "customer_id", "amount_minor",
        "currency", "method", text.alias("details"), F.unix_seconds("event_at").alias("event_s"))


@query("event_status", """
SELECT event_type, coalesce(CASE event_type WHEN 'payment.authorized' THEN 'authorized' WHEN 'payment.captured' THEN 'captured'
  WHEN 'payment.failed' THEN 'failed' WHEN 'order.paid' THEN 'paid' END, 'unknown') AS status, count(*) AS n FROM v_ev GROUP BY ALL""")
def _(f):
    return f.events.groupBy("event_type", canonical.event_status("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("derive_status", """
SELECT event_type, CASE event_type WHEN 'payment.authorized' THEN 'authorized' WHEN 'payment.captured' THEN 'captured'
  WHEN 'payment.failed' THEN 'failed' WHEN 'order.paid' THEN 'paid' END AS status, count(*) AS n FROM v_ev GROUP BY ALL""")
def _(f):
    return f.events.groupBy("event_type", canonical.derive_status("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("fold_customers", """
SELECT customer_id, min(received_us) AS first_us, max(received_us) AS last_us, count(*) AS event_count FROM v_norm GROUP BY 1""")
def _(f):
    return canonical.fold_customers(f.normalized).select(
        "customer_id", us("first_seen_at").alias("first_us"), us("last_seen_at").alias("last_us"), "event_count")


view("v_orders", """
SELECT order_id, max(amount_minor) FILTER (WHERE rn = 1) AS amount_minor, max(currency) FILTER (WHERE rn = 1) AS currency,
  coalesce(arg_max(status, rn) FILTER (WHERE entity_type = 'order'), 'unknown') AS status
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY received_us, event_id) AS rn FROM v_norm WHERE order_id IS NOT NULL)
GROUP BY 1""")


@query("fold_orders", "SELECT order_id, amount_minor, currency, status FROM v_orders")
def _(f):
    return f.orders


@query("fold_payments", """
SELECT payment_id, status, captured, order_id, customer_id, amount_minor, currency, method, first_us, last_us, event_count FROM v_payments""")
def _(f):
    return f.payments.select(
        "payment_id", "status", "captured", "order_id", "customer_id", "amount_minor", "currency", "method",
        us("first_observed_at").alias("first_us"), us("last_observed_at").alias("last_us"), "event_count")


@query("fold_payments_in_order", """
SELECT payment_id, arg_max(status, (rank, observed_us, event_id)) AS status, count(*) AS event_count FROM v_fold_rows GROUP BY 1""")
def _(f):
    return canonical.fold_payments_in_order(f.normalized)


@query("payment_events", "SELECT event_id AS payment_event_id, payment_id, event_id AS webhook_event_id, event_type, observed_us AS event_us FROM v_norm")
def _(f):
    return f.payment_events.select("payment_event_id", "payment_id", "webhook_event_id", "event_type", us("event_time").alias("event_us"))


@query("extract_evidence", """
SELECT evidence_id, evidence_type, subject_type, subject_id, value, value_type, source_type, source_reference,
  event_type, webhook_event_id, payment_event_id, observed_us, valid_until_us FROM v_obs""")
def _(f):
    return f.observations.drop("observed_at", "provenance")


@query("asof_filter", f"""
SELECT payment_id, count(*) FILTER (WHERE observed_us <= {T1}) AS n_t1, count(*) FILTER (WHERE observed_us <= {T2}) AS n_t2,
  count(*) AS n_t3 FROM v_pobs WHERE observed_us <= {T_EVAL} GROUP BY 1""")
def _(f):
    visible = search.as_of(f.payment_obs, "observed_us", T_EVAL)
    return visible.groupBy("payment_id").agg(
        F.count_if(F.col("observed_us") <= T1).alias("n_t1"), F.count_if(F.col("observed_us") <= T2).alias("n_t2"),
        F.count("*").alias("n_t3"))


@query("evidence_scope", f"""
SELECT payment_id, evidence_id, subject_type, observed_us, reason, payments,
  CASE WHEN reason IS NULL THEN 'INCLUDED' ELSE 'EXCLUDED' END AS inclusion_status FROM (
  SELECT payment_id, evidence_id, subject_type, observed_us,
    CASE WHEN observed_us > {T2} THEN 'OBSERVED_AFTER_EVALUATION_TIME' WHEN valid_until_us <= {T2} THEN 'INVALIDATED' END AS reason, 1 AS payments FROM v_pobs
  UNION ALL SELECT NULL, o.evidence_id, o.subject_type, o.observed_us, 'OUTSIDE_EVALUATION_SCOPE', p.n
  FROM v_obs o JOIN (SELECT order_id, count(*) AS n FROM v_payments WHERE order_id IS NOT NULL GROUP BY 1) p ON o.subject_type = 'order' AND o.subject_id = p.order_id)""")
def _(f):
    return search.evidence_scope(f.observations, f.payments, T2)


@query("facts_filter", f"""
SELECT payment_id, fact_type, canonical_value, first_us, last_us, observation_count, active_facts FROM (
  SELECT * FROM (SELECT * FROM v_facts WHERE fact_type IN ('PAYMENT_CAPTURED', 'PAYMENT_FAILED') AND first_us >= {T1} AND last_us <= {T2})
  JOIN (SELECT payment_id AS pid, count(*) AS active_facts FROM v_facts WHERE fact_type IN ('PAYMENT_CAPTURED', 'PAYMENT_FAILED') AND first_us >= {T1} AND last_us <= {T2} GROUP BY 1) ON pid = payment_id)""")
def _(f):
    from veritrail.operators.facts import filter_facts
    return filter_facts(f.facts, ["PAYMENT_CAPTURED", "PAYMENT_FAILED"], "ACTIVE", T1, T2).select(
        "payment_id", "fact_type", "canonical_value", "first_us", "last_us", "observation_count", "active_facts")


@query("text_search", """
SELECT * FROM (
  SELECT 'payment' AS entity_type, payment_id AS entity_id, status AS title, 0.9 :: DOUBLE AS relevance, last_us AS ts_us FROM v_payments
    WHERE payment_id ILIKE '%wallet%' OR status ILIKE '%wallet%' OR method ILIKE '%wallet%'
  UNION ALL SELECT 'evidence', CAST(evidence_id AS VARCHAR), evidence_type, 0.7, observed_us FROM v_obs WHERE value ILIKE '%wallet%' OR evidence_type ILIKE '%wallet%' OR subject_id ILIKE '%wallet%'
  UNION ALL SELECT 'fact', fact_hash, fact_type, 0.65, first_us FROM v_facts WHERE canonical_value ILIKE '%wallet%' OR fact_type ILIKE '%wallet%'
  UNION ALL SELECT 'conflict', claim_a_id, conflict_type, 0.6, 0 FROM v_status_conflicts WHERE conflict_type ILIKE '%wallet%' OR payment_id ILIKE '%wallet%')
ORDER BY relevance DESC, ts_us DESC, entity_type, entity_id LIMIT 50""")
def _(f):
    q = "wallet"
    p = f.payments.withColumn("last_us", us("last_observed_at"))
    c = f.status_conflicts.withColumn("ts_us", F.lit(0).cast("bigint"))
    return search.top_hits([
        search.hits(p, "payment", 0.9, "payment_id", "status", "last_us", q, ["payment_id", "status", "method"]),
        search.hits(f.observations, "evidence", 0.7, "evidence_id", "evidence_type", "observed_us", q, ["value", "evidence_type", "subject_id"]),
        search.hits(f.facts, "fact", 0.65, "fact_hash", "fact_type", "first_us", q, ["canonical_value", "fact_type"]),
        search.hits(c, "conflict", 0.6, "claim_a_id", "conflict_type", "ts_us", q, ["conflict_type", "payment_id"]),
    ], 50)


@query("document_search", """
SELECT 'document' AS entity_type, CAST(doc_id AS VARCHAR) AS entity_id, lang AS title, 0.7 :: DOUBLE AS relevance, doc_id AS ts_us
FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%' ORDER BY relevance DESC, ts_us DESC, entity_id LIMIT 25""")
def _(f):
    return search.top_hits([search.hits(f.table("documents"), "document", 0.7, "doc_id", "lang", "doc_id", "license", ["text", "source"])], 25)


@query("indexed_search", """
SELECT DISTINCT item_id AS term_id, doc_id FROM documents JOIN (SELECT item_id, lower(substr(text, 1, 1 + item_id % 24)) AS term FROM benchmark) ON contains(lower(text), term)""")
def _(f):
    """Documents that contain the beginning of a benchmark item, for all items at once."""
    docs = f.table("documents")
    terms = f.table("benchmark").select(F.col("item_id").alias("term_id"), F.expr("substring(text, 1, cast(1 + item_id % 24 as int))").alias("term"))
    return textindex.search(textindex.build_index(docs, "doc_id", "text"), terms, docs, "doc_id", "text")


view("v_entities", """
SELECT 1 :: BIGINT AS entity_rank, 'payment' AS entity_type, payment_id AS entity_id FROM v_payments
UNION ALL SELECT 2, 'order', order_id FROM v_orders
UNION ALL SELECT 3, 'customer', customer_id FROM (SELECT DISTINCT customer_id FROM v_norm)
UNION ALL SELECT 4, 'webhook', provider_event_id FROM v_ev
UNION ALL SELECT 5, 'evidence', CAST(evidence_id AS VARCHAR) FROM v_obs
UNION ALL SELECT 6, 'claim', claim_id FROM v_claims""")


@query("entity_search", """
SELECT entity_type, entity_id FROM v_entities WHERE entity_id ILIKE '%_12%' ORDER BY entity_rank, entity_id LIMIT 40""")
def _(f):
    def e(df, rank, kind, col):
        return df.select(F.lit(rank).alias("entity_rank"), F.lit(kind).alias("entity_type"), F.col(col).cast("string").alias("entity_id"))
    everything = (
        e(f.normalized.select("payment_id").distinct(), 1, "payment", "payment_id")
        .unionByName(e(f.orders, 2, "order", "order_id"))
        .unionByName(e(canonical.fold_customers(f.normalized), 3, "customer", "customer_id"))
        .unionByName(e(f.events, 4, "webhook", "provider_event_id"))
        .unionByName(e(f.observations, 5, "evidence", "evidence_id"))
        .unionByName(e(f.claims, 6, "claim", "claim_id"))
    )
    return everything.filter(search.matches("_12", "entity_id")).orderBy("entity_rank", "entity_id").limit(40).select(
        "entity_type", "entity_id")


@query("search_suggest", """
(SELECT 'payment' AS kind, payment_id AS suggestion FROM v_payments WHERE payment_id ILIKE '%pay%' ORDER BY 2 LIMIT 3)
UNION ALL (SELECT DISTINCT 'evidence_type', evidence_type FROM v_obs WHERE evidence_type ILIKE '%pay%' ORDER BY 2 LIMIT 3)""")
def _(f):
    start = "payments"[:3]
    ids = f.normalized.select("payment_id").distinct().filter(search.matches(start, "payment_id")).orderBy("payment_id").limit(3)
    types = f.observations.select("evidence_type").distinct().filter(search.matches(start, "evidence_type")).orderBy("evidence_type").limit(3)
    return ids.select(F.lit("payment").alias("kind"), F.col("payment_id").alias("suggestion")).unionByName(
        types.select(F.lit("evidence_type").alias("kind"), F.col("evidence_type").alias("suggestion")))


@query("sanitize_projection", """
SELECT event_id, 'method=' || method || ',order_id=' || coalesce(order_id, '-') AS metadata FROM v_norm""")
def _(f):
    n = landing.normalize_bodies(f.bodies)
    meta = F.map_concat(
        F.coalesce("method_details", F.create_map().cast("map<string,string>")),
        F.create_map(F.lit("method"), F.col("method"), F.lit("order_id"), F.coalesce("order_id", F.lit("-"))),
    )
    clean = search.sanitize(meta)
    text = F.array_join(F.array_sort(F.transform(F.map_entries(clean), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return n.select("event_id", text.alias("metadata"))
