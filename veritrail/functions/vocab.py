"""Vocabularies, thresholds and rule tables.

Everything here must keep its exact value for results to be right; nothing is computed.
"""

from __future__ import annotations

# --- supported events and the status each one asserts -----------------------------------
EVENT_STATUS = {
    "payment.authorized": "authorized",
    "payment.captured": "captured",
    "payment.failed": "failed",
    "order.paid": "paid",
}
SUPPORTED_EVENTS = tuple(EVENT_STATUS)
STATUS_RANK = {"unknown": 0, "created": 1, "authorized": 2, "captured": 3, "failed": 3, "paid": 3}
METHOD_DETAIL_KEYS = ("card_id", "card", "bank", "wallet", "vpa", "email", "contact")

# --- observations -----------------------------------------------------------------------
PROVIDER_SOURCES = ("PROVIDER_WEBHOOK", "PROVIDER_API")
DERIVED_TYPES = (
    "PAYMENT_STATUS", "PAYMENT_AMOUNT", "PAYMENT_CURRENCY", "PAYMENT_METHOD",
    "PAYMENT_ORDER_RELATIONSHIP", "ORDER_AMOUNT", "ORDER_CURRENCY", "ORDER_STATUS",
)
DERIVED_FROM_EVENT = (
    "PAYMENT_STATUS", "PAYMENT_AMOUNT", "PAYMENT_CURRENCY", "PAYMENT_METHOD",
    "PAYMENT_ORDER_RELATIONSHIP",
)

# --- freshness: policy -> (current below, stale from), seconds ----------------------------
HOUR, DAY = 3600, 86400
FRESHNESS_POLICY = {
    "DEFAULT": (24 * HOUR, 7 * DAY),
    "PAYMENT_STATUS": (4 * HOUR, 48 * HOUR),
    "PAYMENT_AMOUNT": (7 * DAY, 30 * DAY),
    "PAYMENT_EVENT": (24 * HOUR, 7 * DAY),
}
FRESHNESS_POLICY_OF = {
    "PAYMENT_STATUS": "PAYMENT_STATUS",
    "PAYMENT_AMOUNT": "PAYMENT_AMOUNT",
    "PAYMENT_CURRENCY": "PAYMENT_AMOUNT",
    "PAYMENT_EVENT": "PAYMENT_EVENT",
}
MIN_OUTCOME_SAMPLE = 30

# --- state machine ----------------------------------------------------------------------
VALID_TRANSITIONS = (
    ("created", "authorized"), ("created", "captured"), ("created", "failed"),
    ("authorized", "captured"), ("authorized", "failed"), ("captured", "refunded"),
)
TERMINAL_STATES = ("captured", "failed", "refunded")
CLOCK_TOLERANCE_US = 2_000_000
CONFLICT_RULE_VERSION = "1.0"

# --- claims: evidence type -> (claim type, claim key, normaliser) -------------------------
CLAIM_OF = {
    "PAYMENT_STATUS": ("PAYMENT_STATUS", "STATUS", "lower"),
    "PAYMENT_AMOUNT": ("PAYMENT_AMOUNT", "AMOUNT", "trim"),
    "PAYMENT_CURRENCY": ("PAYMENT_CURRENCY", "CURRENCY", "upper"),
    "PAYMENT_METHOD": ("PAYMENT_METHOD", "METHOD", "lower"),
    "PAYMENT_ORDER_RELATIONSHIP": ("ORDER_ASSOCIATION", "ORDER_ID", "trim"),
    "PAYMENT_EVENT": ("PAYMENT_EVENT_OCCURRENCE", "EVENT_TYPE", "trim"),
    "ORDER_STATUS": ("PAYMENT_STATUS", "ORDER_STATUS", "lower"),
    "ORDER_AMOUNT": ("PAYMENT_AMOUNT", "ORDER_AMOUNT", "trim"),
    "ORDER_CURRENCY": ("PAYMENT_CURRENCY", "ORDER_CURRENCY", "upper"),
}

# --- facts ------------------------------------------------------------------------------
FACT_OF_ATTRIBUTE = {
    "PAYMENT_AMOUNT": "PAYMENT_AMOUNT_OBSERVED",
    "PAYMENT_CURRENCY": "PAYMENT_CURRENCY_OBSERVED",
    "PAYMENT_METHOD": "PAYMENT_METHOD_OBSERVED",
    "PAYMENT_ORDER_RELATIONSHIP": "PAYMENT_ORDER_ASSOCIATION",
    "ORDER_AMOUNT": "PAYMENT_AMOUNT_OBSERVED",
    "ORDER_CURRENCY": "PAYMENT_CURRENCY_OBSERVED",
    "ORDER_STATUS": "PAYMENT_STATUS_OBSERVED",
}
FACT_OF_EVENT = {
    "payment.captured": "PAYMENT_CAPTURED",
    "payment.failed": "PAYMENT_FAILED",
    "payment.authorized": "PAYMENT_AUTHORIZED",
    "refund.created": "PAYMENT_REFUNDED",
    "payment.refund.created": "PAYMENT_REFUNDED",
}
LIFECYCLE_FACTS = ("PAYMENT_CAPTURED", "PAYMENT_FAILED", "PAYMENT_AUTHORIZED", "PAYMENT_REFUNDED")
RECONCILIATION_WINDOW_US = 5_000_000

# --- coverage requirements: id, base, evidence type, fact types, description ---------------
REQUIREMENTS = (
    ("REQ_PAYMENT_CREATION", "REQUIRED", "PAYMENT_STATUS",
     ("PAYMENT_STATUS_OBSERVED", "PAYMENT_CAPTURED", "PAYMENT_AUTHORIZED", "PAYMENT_FAILED")),
    ("REQ_PAYMENT_AMOUNT", "REQUIRED", "PAYMENT_AMOUNT", ("PAYMENT_AMOUNT_OBSERVED",)),
    ("REQ_PAYMENT_CURRENCY", "REQUIRED", "PAYMENT_CURRENCY", ("PAYMENT_CURRENCY_OBSERVED",)),
    ("REQ_PAYMENT_METHOD", "EXPECTED", "PAYMENT_METHOD", ("PAYMENT_METHOD_OBSERVED",)),
    ("REQ_PAYMENT_AUTHORIZED", "EXPECTED", "PAYMENT_STATUS", ("PAYMENT_AUTHORIZED",)),
    ("REQ_PAYMENT_CAPTURED", "CONDITIONAL", "PAYMENT_STATUS", ("PAYMENT_CAPTURED",)),
    ("REQ_ORDER_LINKAGE", "OPTIONAL", "PAYMENT_ORDER_RELATIONSHIP", ("PAYMENT_ORDER_ASSOCIATION",)),
    ("REQ_CUSTOMER_LINKAGE", "OPTIONAL", "PAYMENT_STATUS", ("PAYMENT_STATUS_OBSERVED",)),
    ("REQ_REFUND_RECORD", "CONDITIONAL", "PAYMENT_STATUS", ("PAYMENT_REFUNDED",)),
    ("REQ_FAILURE_REASON", "CONDITIONAL", "PAYMENT_STATUS", ("PAYMENT_FAILED",)),
)

# --- integrity --------------------------------------------------------------------------
GATES = ("INSUFFICIENT_DATA", "UNRESOLVED", "WEAK", "VERY_STRONG", "STRONG", "LIMITED")
METHODOLOGY = "EIS_V1"
INTEGRITY_TIER = {
    "INSUFFICIENT_DATA": 0, "WEAK": 1, "UNRESOLVED": 1, "LIMITED": 2, "STRONG": 3, "VERY_STRONG": 4,
}
FRESHNESS_RANK = {"STRONG": 3, "CURRENT": 3, "AGING": 2, "LIMITED": 1, "STALE": 1, "UNKNOWN": 0}

# --- risk: dimension -> weight ------------------------------------------------------------
RISK_WEIGHTS = {
    "evidence_volume": 0.15, "source_diversity": 0.15, "consistency": 0.20, "coverage": 0.15,
    "freshness": 0.10, "corroboration": 0.15, "conflict_resolution": 0.10,
}
TREND_BASE = {
    "VERY_STRONG": 85, "STRONG": 85, "LIMITED": 60, "WEAK": 25, "UNRESOLVED": 25,
}

# --- failures: match order and severity ----------------------------------------------------
FAILURE_SEVERITY = {
    "insufficient_funds": "HIGH", "expired_card": "MEDIUM", "invalid_card": "HIGH",
    "auth_declined": "HIGH", "timeout": "MEDIUM", "aborted": "LOW", "failed": "HIGH",
    "captured": "LOW", "authorized": "LOW", "pending": "LOW",
}
HIGH_VALUE_MINOR = 1_000_000
HIGH_AMOUNT_MINOR = 10_000_000

# --- defense ------------------------------------------------------------------------------
LABEL_PRECEDENCE = {"CONTRADICTED": 1, "SUPPORTED": 2, "INSUFFICIENT_EVIDENCE": 3, "UNKNOWN": 4}
REQUIRED_DEFENSE_TYPES = ("DELIVERY_PROOF", "ORDER_ID_MATCH", "PAYMENT_ID_MATCH")
ENTITY_MATCH_TYPES = ("PAYMENT_ID_MATCH", "ORDER_ID_MATCH")
DELIVERY_TYPES = ("DELIVERY_PROOF", "DELIVERY_STATUS")
DELIVERY_COMPLETE_PREFIXES = ("delivered", "delivery_confirmed", "received", "signed")
DELIVERY_INCOMPLETE_TOKENS = (
    "in_transit", "out_for_delivery", "pending", "label_created", "created", "processing", "dispatched", "shipped",
    "returned", "return_to_sender", "failed", "delivery_failed", "lost", "exception", "on_hold", "unknown",
)
DEFENSE_SOURCES = (
    "PROVIDER_WEBHOOK", "PROVIDER_API", "INTERNAL_SYSTEM", "MERCHANT_DOCUMENT", "CARRIER_API", "CUSTOMER_COMMUNICATION",
)
CLAIM_PATTERNS = (
    ("CUSTOMER_RECEIVED_GOODS", r"\breceived?\b"),
    ("DELIVERY_COMPLETED", r"\bdelivered?\b"),
    ("CUSTOMER_ACKNOWLEDGED_RECEIPT", r"\bsigned?\b"),
    ("SHIPMENT_DISPATCHED", r"\bdispatched?\b|\bsent\b|\bshipped?\b"),
    ("TRACKING_EVENT_EXISTS", r"\btracking?\b"),
    ("DELIVERY_LOCATION", r"\blocation\b|\baddress\b"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DEFAULT_CLAIM_YEAR = "2026"
CLAIM_CONFIDENCE, DATE_CONFIDENCE = 0.9, 0.85
MATCH_RELEVANT, MATCH_UNCERTAIN = 0.85, 0.7
