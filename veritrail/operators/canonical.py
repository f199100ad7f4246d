"""Events -> canonical payments, orders, customers and payment events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import us
from veritrail.functions.skew import prefix_before, time_chunks
from veritrail.sources.driver_tables import lookup


def event_status(event_type: str):
    return lookup(event_type, V.EVENT_STATUS, "unknown")


def derive_status(event_type: str):
    return lookup(event_type, V.EVENT_STATUS)


def normalize_events(events: DataFrame) -> DataFrame:
    """Supported events only, with the entity each one is about."""
    is_order = F.col("event_type") == "order.paid"
    return events.filter(F.col("event_type").isin(*V.SUPPORTED_EVENTS)).select(
        "*",
        F.when(is_order, "order").otherwise("payment").alias("entity_type"),
        F.when(is_order, F.col("order_id")).otherwise(F.col("payment_id")).alias("entity_id"),
        event_status("event_type").alias("status"),
    )


def payment_events(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("payment_id").isNotNull()).select(
        F.col("event_id").alias("payment_event_id"), "payment_id",
        F.col("event_id").alias("webhook_event_id"), "event_type",
        F.coalesce("observed_at", "received_at").alias("event_time"),
    )


def _arrival():
    return F.struct("received_at", "event_id")


def _truthy(col: str):
    c = F.col(col)
    return c.isNotNull() & (c != (0 if col == "amount_minor" else ""))


def _fill(col: str):
    """First value, replaced by the first usable one when the first is missing or blank."""
    usable = F.min_by(F.when(_truthy(col), F.col(col)), F.when(_truthy(col), _arrival()))
    return F.coalesce(usable, F.min_by(F.col(col), _arrival())).alias(col)


def fold_customers(normalized: DataFrame) -> DataFrame:
    return normalized.filter(_truthy("customer_id")).groupBy("customer_id").agg(
        F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("last_seen_at"),
        F.count("*").alias("event_count"),
    )


def fold_orders(normalized: DataFrame) -> DataFrame:
    """Amount and currency as first received; status only ever written by order events."""
    about_order = F.col("entity_type") == "order"
    return normalized.filter(_truthy("order_id")).groupBy("order_id").agg(
        F.min_by("amount_minor", _arrival()).alias("amount_minor"),
        F.min_by("currency", _arrival()).alias("currency"),
        F.coalesce(
            F.max_by(F.when(about_order, F.col("status")), F.when(about_order, _arrival())), F.lit("unknown")
        ).alias("status"),
    )


def fold_payments(normalized: DataFrame, spread: bool = True) -> DataFrame:
    """One row per payment under the last-writer policy, exact for any arrival order.

    A status is taken when its rank is higher than the current one, or equal and the event is
    strictly later than everything received before. Only the top rank decides the result, so the
    winner is the last top-rank event, in arrival order, that was either the first of its rank or
    strictly later than all earlier arrivals. That needs a running maximum per payment, which is
    computed in time chunks; everything else is a plain partial aggregate. Without `spread` each payment is put in
    order by one task, which is for payments of few events.
    """
    ev = normalized.filter(_truthy("payment_id")).select(
        "payment_id", "order_id", "customer_id", "amount_minor", "currency", "method", "status",
        "received_at", "event_id",
        F.coalesce("observed_at", "received_at").alias("event_time"),
        lookup("status", V.STATUS_RANK, 0).alias("rank"),
    )
    ev = prefix_before(
        ev, ["payment_id"], ["received_at", "event_id"],
        time_chunks(us("received_at")) if spread else [], F.col("event_time"), "max", "seen_before",
    ).where("received_at IS NOT NULL")  # an event of unknown arrival has no place in the order, spread or not
    record = F.col("seen_before").isNull() | (F.col("event_time") > F.col("seen_before"))
    # grouping by (payment, rank) first lets the top rank be picked without a second pass
    per_rank = ev.groupBy("payment_id", "rank").agg(
        F.min_by("status", _arrival()).alias("first_status"),
        F.max_by(F.when(record, F.col("status")), F.when(record, _arrival())).alias("record_status"),
        F.max(record & (F.col("status") == "captured")).alias("record_captured"),
        F.count("*").alias("event_count"),
        F.min("event_time").alias("first_observed_at"), F.max("event_time").alias("last_observed_at"),
        F.min(_arrival()).alias("first_arrival"),
        *[F.min_by(F.when(_truthy(c), F.col(c)), F.when(_truthy(c), _arrival())).alias(c) for c in FILLED],
        *[F.min(F.when(_truthy(c), _arrival())).alias(f"{c}_at") for c in FILLED],
        F.min_by("amount_minor", _arrival()).alias("first_amount"),
    )
    # within the top rank: a strict record beats the first event only if it is a top-rank record
    status = F.coalesce("record_status", "first_status")
    captured = F.col("record_captured") | (F.col("first_status") == "captured")
    return per_rank.groupBy("payment_id").agg(
        F.max_by(status, F.col("rank")).alias("status"),
        F.max_by(captured, F.col("rank")).alias("captured"),
        *[F.min_by(F.when(F.col(f"{c}_at").isNotNull(), F.col(c)), F.col(f"{c}_at")).alias(c) for c in FILLED],
        F.min_by("first_amount", "first_arrival").alias("__first_amount"),
        F.min("first_observed_at").alias("first_observed_at"),
        F.max("last_observed_at").alias("last_observed_at"),
        F.sum("event_count").alias("event_count"),
    ).withColumn("amount_minor", F.coalesce("amount_minor", "__first_amount")).drop("__first_amount")


FILLED = ("order_id", "customer_id", "amount_minor", "currency", "method")


def payment_amounts(normalized: DataFrame) -> DataFrame:
    """Amount per payment as the fold gives it, for readers that need no status."""
    return normalized.filter(_truthy("payment_id")).groupBy("payment_id").agg(_fill("amount_minor"))


def fold_payments_in_order(normalized: DataFrame) -> DataFrame:
    """Status when events arrive in event order: a single partial aggregate, no running maximum."""
    rank = lookup("status", V.STATUS_RANK, 0)
    return normalized.filter(_truthy("payment_id")).groupBy("payment_id").agg(
        F.max_by("status", F.struct(rank, F.col("observed_at"), F.col("event_id"))).alias("status"),
        F.count("*").alias("event_count"),
    )


# slot -> evidence type, value type; slots 0-5 describe the payment, 6-8 the order
SLOTS = (
    ("PAYMENT_EVENT", "ENUM"), ("PAYMENT_STATUS", "ENUM"), ("PAYMENT_AMOUNT", "INTEGER_MINOR_UNITS"),
    ("PAYMENT_CURRENCY", "STRING"), ("PAYMENT_METHOD", "ENUM"), ("PAYMENT_ORDER_RELATIONSHIP", "STRING"),
    ("ORDER_STATUS", "ENUM"), ("ORDER_AMOUNT", "INTEGER_MINOR_UNITS"), ("ORDER_CURRENCY", "STRING"),
)
FIRST_ORDER_SLOT = 6
_ABOUT_ORDER = "entity_type = 'order' AND order_id <> ''"
_SLOT_VALUES = (
    ("payment_id <> ''", "event_type"), ("payment_id <> ''", "status"),
    ("payment_id <> ''", "CAST(amount_minor AS STRING)"), ("payment_id <> ''", "currency"),
    ("payment_id <> ''", "method"), ("payment_id <> '' AND order_id <> ''", "order_id"),
    (_ABOUT_ORDER, "'paid'"), (_ABOUT_ORDER, "CAST(amount_minor AS STRING)"), (_ABOUT_ORDER, "currency"),
)


def slot_rows(normalized: DataFrame, slots: str = "sequence(0, 8)") -> DataFrame:
    """One row per observation slot the event fills; a NULL field fills none.

    Exploding a constant slot list and picking the value by slot keeps the generated code small.
    """
    value = "CASE slot " + " ".join(
        f"WHEN {i} THEN CASE WHEN {cond} THEN {v} END" for i, (cond, v) in enumerate(_SLOT_VALUES)) + " END"
    rows = normalized.withColumn("slot", F.explode(F.expr(slots)))
    return rows.withColumn("slot_value", F.expr(value)).filter("slot_value IS NOT NULL")


def slots_of(normalized: DataFrame) -> DataFrame:
    """Adds `slots`, the filled slots of the event as a short array."""
    present = ", ".join(
        f"CASE WHEN {cond} AND {v} IS NOT NULL THEN {i} END" for i, (cond, v) in enumerate(_SLOT_VALUES))
    return normalized.withColumn("slots", F.expr(f"array_compact(array({present}))"))


_ORDER_SLOT = f"slot >= {FIRST_ORDER_SLOT}"
_IN_PAYMENT = "IF(payment_id <> '', event_id, NULL)"


def _observations(rows: DataFrame, *owner: str, payment_event_id: str = _IN_PAYMENT) -> DataFrame:
    """Filled slots as observations; `owner`: whom they are about."""
    known = "provenance" if "provenance" in rows.columns else "CAST(NULL AS STRING)"
    names = ", ".join(f"'{t}'" for t, _ in SLOTS)
    kinds = ", ".join(f"'{v}'" for _, v in SLOTS)
    return rows.selectExpr(
        "event_id * 16 + slot AS evidence_id",
        f"element_at(array({names}), slot + 1) AS evidence_type", *owner,
        "slot_value AS value", f"element_at(array({kinds}), slot + 1) AS value_type",
        "source_type", "CAST(event_id AS STRING) AS source_reference", "event_type",
        "event_id AS webhook_event_id", f"{payment_event_id} AS payment_event_id",
        "coalesce(observed_at, received_at) AS observed_at",
        "unix_micros(coalesce(observed_at, received_at)) AS observed_us",
        "unix_micros(expires_at) AS valid_until_us",
        f"IF({_ORDER_SLOT}, {known}, NULL) AS provenance",
    )


def slot_values(order: bool) -> list[tuple[int, str, str]]:
    """Slot, evidence type and value (SQL) of the slots that describe the order, or of those that describe the payment."""
    return [(i, SLOTS[i][0], f"CASE WHEN {cond} THEN {v} END") for i, (cond, v) in enumerate(_SLOT_VALUES) if (i >= FIRST_ORDER_SLOT) == order]


def extract_evidence(normalized: DataFrame) -> DataFrame:
    """Explode each event into its observations.

    Ids are event_id * 16 + slot, so they need no global numbering. Order evidence has the event's `provenance`, if
    the events come with one.
    """
    return _observations(
        slot_rows(normalized), f"IF({_ORDER_SLOT}, 'order', 'payment') AS subject_type", f"IF({_ORDER_SLOT}, order_id, payment_id) AS subject_id")


def payment_scope(observations: DataFrame) -> DataFrame:
    """Observations whose subject is a payment, keyed by payment_id."""
    return observations.filter(F.col("subject_type") == "payment").withColumnRenamed("subject_id", "payment_id")


def by_owner(normalized: DataFrame) -> DataFrame:
    """Each event once for its payment and, where its order evidence names a payment, once more for that (`named`).

    `payment_id` is then whom the row is for, so that all that belongs to a payment can be moved as events, before
    there are many observations of each.
    """
    named = F.when(F.expr(_ABOUT_ORDER), F.get_json_object("provenance", "$.payment_id"))
    own = F.col("payment_id")
    owners = F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(p.alias("id"), F.lit(kind).alias("named"))) for p, kind in ((own, False), (named, True))]))
    rest = [c for c in normalized.columns if c != "payment_id"]
    rows = normalized.select(*rest, F.expr(_IN_PAYMENT).alias("payment_event_id"), F.explode(owners).alias("o"))
    return rows.select(*rest, "payment_event_id", F.col("o.id").alias("payment_id"), F.col("o.named").alias("named"))


def by_subject(normalized: DataFrame) -> DataFrame:
    """Each event once for its payment and, if it is about an order, once for that: `subject_type`, `subject_id`."""
    of = lambda kind, col, cond: F.when(F.expr(cond), F.struct(F.lit(kind).alias("subject_type"), F.col(col).alias("subject_id")))
    subjects = F.array_compact(F.array(of("payment", "payment_id", "payment_id <> ''"), of("order", "order_id", _ABOUT_ORDER)))
    return normalized.select("*", F.explode(subjects).alias("s")).select("*", "s.*").drop("s")


def subject_evidence(rows: DataFrame) -> DataFrame:
    """The observations of rows of `by_subject`, each about its row's subject."""
    first, order = FIRST_ORDER_SLOT, "subject_type = 'order'"
    slots = slot_rows(rows, f"sequence(IF({order}, {first}, 0), IF({order}, {len(SLOTS) - 1}, {first - 1}))")
    return _observations(slots, "subject_type", "subject_id")


def owned_evidence(owned: DataFrame) -> DataFrame:
    """Observations of payments, from rows of `by_owner`."""
    rows = slot_rows(owned.where("NOT named"), f"sequence(0, {FIRST_ORDER_SLOT - 1})")
    return _observations(rows, "'payment' AS subject_type", "payment_id AS subject_id")


def owned_scope(owned: DataFrame) -> DataFrame:
    """Observations of payments and of the orders that name them, from rows of `by_owner`."""
    first = FIRST_ORDER_SLOT
    rows = slot_rows(owned, f"sequence(IF(named, {first}, 0), IF(named, {len(SLOTS) - 1}, {first - 1}))")
    return _observations(
        rows, f"IF({_ORDER_SLOT}, 'order', 'payment') AS subject_type", f"IF({_ORDER_SLOT}, order_id, payment_id) AS subject_id", "payment_id",
        payment_event_id="payment_event_id")
