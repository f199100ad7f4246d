"""Column expressions shared by the operators; all of them stay inside codegen."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.sources.driver_tables import lookup


def us(col) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def key_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *cols), 256)


def hmac_sha256(secret: str, body: Column) -> Column:
    """HMAC-SHA256 from two nested digests; the two pads depend on the secret only."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def freshness_policy() -> Column:
    return lookup("evidence_type", V.FRESHNESS_POLICY_OF, "DEFAULT")


def threshold(which: int) -> Column:
    per_type = {t: V.FRESHNESS_POLICY[p][which] * 1_000_000 for t, p in V.FRESHNESS_POLICY_OF.items()}
    return lookup("evidence_type", per_type, V.FRESHNESS_POLICY["DEFAULT"][which] * 1_000_000)


def freshness_state(observed_us: Column, at_us) -> Column:
    age = at_us - observed_us
    return (
        F.when(observed_us.isNull() | (age < 0), "UNKNOWN").when(age < threshold(0), "CURRENT")
        .when(age < threshold(1), "AGING").otherwise("STALE")
    )


def authority(source_type: Column) -> Column:
    return (
        F.when(source_type.isin(*V.PROVIDER_SOURCES), "PRIMARY")
        .when(source_type == "INTERNAL_SYSTEM", "SECONDARY").otherwise("TERTIARY")
    )


def directness(source_type: Column, evidence_type: Column) -> Column:
    webhook = source_type == "PROVIDER_WEBHOOK"
    return (
        F.when(webhook & evidence_type.isin(*V.DERIVED_TYPES), "DERIVED")
        .when(webhook | (source_type == "PROVIDER_API"), "DIRECT")
        .when(source_type == "INTERNAL_SYSTEM", "DERIVED").otherwise("INFERRED")
    )


def outcome_status(sample_count: Column) -> Column:
    n = F.coalesce(sample_count, F.lit(0))
    return (
        F.when(n == 0, "NO_OUTCOME_DATA").when(n < V.MIN_OUTCOME_SAMPLE, "INSUFFICIENT_SAMPLE")
        .otherwise("AVAILABLE")
    )


def normal_state(state: Column) -> Column:
    s = F.trim(F.lower(state))
    return F.when(s == "paid", "captured").otherwise(s)


def transition_between(a: Column, b: Column) -> Column:
    """Kind of step between two normalised states."""
    forward = F.concat_ws(">", a, b).isin(*[f"{x}>{y}" for x, y in V.VALID_TRANSITIONS])
    return (
        F.when(a == b, "SAME_STATE").when(forward, "VALID_FORWARD")
        .when(a.isin(*V.TERMINAL_STATES) & b.isin(*V.TERMINAL_STATES), "CONTRADICTORY_TERMINAL")
        .otherwise("INVALID_BACKWARD")
    )


def transition(from_state: Column, to_state: Column) -> Column:
    return transition_between(normal_state(from_state), normal_state(to_state))


def failure_category(reason: Column, fallback: Column) -> Column:
    """First matching key in table order; no text falls back to the event type."""
    text = F.lower(reason)
    out = F.when(reason.isNull() | (reason == ""), F.lower(fallback))
    for key in V.FAILURE_SEVERITY:
        out = out.when(text.contains(key), key)
    return out.otherwise("failed")


def pairs_of(n: Column) -> Column:
    """Number of unordered pairs among n items: exact integers, the even factor halved first."""
    return F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))


def parts(*items: Column) -> Column:
    """Reason list in literal order, NULL entries dropped."""
    return F.array_compact(F.array(*items))


def text_list(arr: Column) -> Column:
    return F.array_join(arr, "; ")


def canonical_time(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
