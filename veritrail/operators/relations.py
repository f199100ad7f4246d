"""Typed relationships between observations.

SAME_EVENT, SAME_SOURCE and DERIVED_FROM connect the few observations of one event; they are
emitted in full while the event is still a single row, without any join. SAME_PAYMENT and
INDEPENDENCE_CANDIDATE hold between every two observations of a payment (of different events):
they are kept as memberships with partner counts, which grow with the data and not its square;
`related_to` lists the partners of chosen observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import pairs_of
from veritrail.operators.canonical import SLOTS, slots_of


def event_edges(normalized: DataFrame, *keep: str) -> DataFrame:
    """Edges inside one event, from its own row: an event yields at most nine observations. `keep`: columns of the event to keep."""
    types = F.array(*[F.lit(t) for t, _ in SLOTS])
    events = slots_of(normalized).select(
        *[F.col(c) for c in keep], F.expr("IF(payment_id <> '', event_id, NULL)").alias("payment_event_id"), F.col("event_id").alias("webhook_event_id"),
        F.transform("slots", lambda x: F.struct(
            (F.col("event_id") * 16 + x).alias("evidence_id"), F.element_at(types, x + 1).alias("evidence_type"))).alias("m"))
    m = F.col("m")

    def edge(a, b, kind, field, value):
        return F.struct(
            a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("relationship_type"),
            F.lit(field).alias("shared_field"), value.cast("string").alias("shared_value"))

    def from_each(a, i):
        later = F.slice(m, i + F.lit(2), F.size(m))
        same = F.transform(later, lambda b: edge(a["evidence_id"], b["evidence_id"], "SAME_EVENT", "payment_event_id", F.col("payment_event_id")))
        source = F.transform(later, lambda b: edge(a["evidence_id"], b["evidence_id"], "SAME_SOURCE", "webhook_event_id", F.col("webhook_event_id")))
        roots = F.filter(m, lambda b: (b["evidence_type"] == "PAYMENT_EVENT") & a["evidence_type"].isin(*V.DERIVED_FROM_EVENT))
        derived = F.transform(roots, lambda b: edge(a["evidence_id"], b["evidence_id"], "DERIVED_FROM", "payment_event_id", F.col("payment_event_id")))
        empty = F.filter(same, lambda _: F.lit(False))
        return F.concat(
            F.when(F.col("payment_event_id").isNotNull(), same).otherwise(empty),
            F.when(F.col("webhook_event_id").isNotNull(), source).otherwise(empty),
            F.when(F.col("payment_event_id").isNotNull(), derived).otherwise(empty))

    return events.select(*keep, F.explode(F.flatten(F.transform(m, from_each))).alias("e")).select(*keep, "e.*")


def payment_memberships(payment_obs: DataFrame) -> DataFrame:
    """Per observation: how many others share its payment, and how many of those come from
    another event."""
    per_event = payment_obs.groupBy("payment_id", "webhook_event_id").agg(F.count("*").alias("in_event"))
    totals = per_event.groupBy("payment_id").agg(
        F.sum("in_event").alias("n"),
        F.sum(F.when(F.col("webhook_event_id").isNotNull(), F.col("in_event")).otherwise(0)).alias("with_event"))
    sizes = per_event.join(totals, "payment_id")
    j = payment_obs.select("payment_id", "webhook_event_id", "evidence_id").join(sizes, ["payment_id", "webhook_event_id"])
    kinds = F.array(
        F.struct(F.lit("SAME_PAYMENT").alias("relationship_type"), (F.col("n") - 1).alias("partners")),
        F.struct(F.lit("INDEPENDENCE_CANDIDATE").alias("relationship_type"), (F.col("with_event") - F.col("in_event")).alias("partners")),
    )
    return j.select("payment_id", "evidence_id", F.explode(kinds).alias("k")).select(
        "payment_id", "evidence_id", "k.*").filter("partners > 0")


def pair_totals(observations: DataFrame) -> DataFrame:
    """Number of observation pairs per payment by relationship, from group sizes."""
    scoped = observations.filter(F.col("subject_type") == "payment")
    per_event = scoped.groupBy(F.col("subject_id").alias("payment_id"), "webhook_event_id").agg(F.count("*").alias("n"))
    return per_event.groupBy("payment_id").agg(
        F.sum("n").alias("n"), F.sum(pairs_of(F.col("n"))).alias("same_event_pairs")
    ).select(
        "payment_id", pairs_of(F.col("n")).alias("same_payment_pairs"), "same_event_pairs",
        (pairs_of(F.col("n")) - F.col("same_event_pairs")).alias("independence_pairs"))


def related_to(payment_obs: DataFrame, chosen: DataFrame) -> DataFrame:
    """SAME_PAYMENT and INDEPENDENCE_CANDIDATE edges of chosen observations (evidence_id)."""
    a = payment_obs.join(chosen.select("evidence_id"), "evidence_id").select(
        "payment_id", F.col("evidence_id").alias("a"), F.col("webhook_event_id").alias("wa"))
    b = payment_obs.select("payment_id", F.col("evidence_id").alias("b"), F.col("webhook_event_id").alias("wb"))
    pairs = a.join(b, "payment_id").filter("a <> b")
    kinds = F.array_compact(F.array(F.lit("SAME_PAYMENT"), F.when(F.col("wa") != F.col("wb"), "INDEPENDENCE_CANDIDATE")))
    return pairs.select(
        "payment_id", F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"),
        F.explode(kinds).alias("relationship_type")).distinct()
