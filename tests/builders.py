"""Small hand-made inputs in the shapes the operators expect."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

T0 = datetime(2026, 3, 1, 10, 0, 0, tzinfo=timezone.utc)
US = int(T0.timestamp()) * 1_000_000

OBS = (
    "evidence_id bigint, evidence_type string, subject_type string, subject_id string, value string, value_type string, "
    "source_type string, source_reference string, event_type string, webhook_event_id bigint, payment_event_id bigint, "
    "observed_us bigint, valid_until_us bigint, provenance string"
)
EVENT = (
    "event_id bigint, k bigint, provider_event_id string, event_type string, payment_id string, order_id string, customer_id string, "
    "amount_minor bigint, currency string, method string, source_type string, observed_at timestamp, received_at timestamp, "
    "processed_at timestamp, expires_at timestamp, processing_status string, retry_count bigint, error_text string"
)


def obs(i, etype="PAYMENT_STATUS", value="captured", event=1, source="PROVIDER_WEBHOOK", at_s=0.0, payment="p1", vtype="ENUM",
        event_type="order.paid", until_s=None):
    us = US + int(at_s * 1_000_000)
    return (i, etype, "payment", payment, value, vtype, source, str(event), event_type, event, event, us,
            None if until_s is None else US + int(until_s * 1_000_000), None)


def observations(spark, rows):
    return spark.createDataFrame(rows, OBS)


def event(i, kind="payment.captured", payment="p1", seen_s=0, arrive_s=None, amount=100, order="o1", customer="c1", currency="INR", method="upi"):
    seen = T0 + timedelta(seconds=seen_s)
    arrive = T0 + timedelta(seconds=seen_s if arrive_s is None else arrive_s)
    return (i, 1, f"evt_{i}", kind, payment, order, customer, amount, currency, method, "PROVIDER_WEBHOOK", seen, arrive, arrive, None,
            "PROCESSED", 0, None)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)
