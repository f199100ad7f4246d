"""Maps the driver tables onto the payment-evidence data model.

The mapping is a narrow projection: filters and column pruning reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.vocab import FAILURE_SEVERITY

EVENT_TYPE_MAP = {
    "click": "payment.authorized",
    "purchase": "payment.captured",
    "error": "payment.failed",
    "signup": "order.paid",
    "view": "refund.processed",
}
FAILURE_KEYS = tuple(FAILURE_SEVERITY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(col: str, mapping: dict, default=None) -> Column:
    """Literal lookup as one CASE, parsed in one call and compiled with the rest of the stage."""
    def lit(x):
        return str(x) if isinstance(x, (int, float)) else f"'{x}'"
    arms = " ".join(f"WHEN {lit(key)} THEN {lit(value)}" for key, value in mapping.items())
    tail = "" if default is None else f" ELSE {lit(default)}"
    return F.expr(f"CASE {col} {arms}{tail} END")


def seconds(col: Column) -> Column:
    return F.make_dt_interval(secs=col)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received events, one row per delivery, with the provider envelope flattened."""
    raw = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value",
        F.col("event_type").alias("raw_type"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return shape_events(raw)


def shape_events(raw: DataFrame) -> DataFrame:
    k = F.col("k")
    user = F.col("user_id").cast("string")
    received = F.col("observed_at") + seconds(k % 7)
    failing_text = F.concat(
        F.lit("Bank replied: "),
        F.element_at(F.array(*[F.lit(x) for x in FAILURE_KEYS]), (k % 10 + 1).cast("int")),
        F.lit(" (code "), k.cast("string"), F.lit(")"),
    )
    payment = F.concat(F.lit("pay_"), user, F.lit("_"), F.date_format("observed_at", "yyyyMMdd"))
    return raw.select(
        "event_id", "k",
        # every second event says which payment its order evidence is about
        F.when(k % 2 == 0, F.concat(F.lit('{"payment_id":"'), payment, F.lit('"}'))).alias("provenance"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("provider_event_id"),
        lookup("raw_type", EVENT_TYPE_MAP).alias("event_type"),
        payment.alias("payment_id"),
        F.when(k % 11 != 0, F.concat(F.lit("order_"), user, F.lit("_"), (k % 3).cast("string"))).alias("order_id"),
        F.concat(F.lit("cust_"), user).alias("customer_id"),
        F.when(k % 13 != 0, F.round(F.col("value") * 100).cast("bigint")).alias("amount_minor"),
        F.when(k % 10 == 0, "USD").otherwise("INR").alias("currency"),
        F.element_at(
            F.array(*[F.lit(m) for m in ("upi", "card", "netbanking", "wallet")]), (k % 4 + 1).cast("int")
        ).alias("method"),
        F.when(k % 5 == 0, "INTERNAL_SYSTEM").when(k % 5 == 1, "PROVIDER_API")
        .otherwise("PROVIDER_WEBHOOK").alias("source_type"),
        "observed_at",
        received.alias("received_at"),
        (received + seconds(k % 12)).alias("processed_at"),
        F.when(k % 17 == 0, F.col("observed_at") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"),
        F.when(k % 25 == 0, "FAILED").when(k % 25 == 1, "RECEIVED").otherwise("PROCESSED").alias("processing_status"),
        (k % 6).alias("retry_count"),
        F.when((F.col("raw_type") == "error") & (k % 16 != 5), failing_text).alias("error_text"),
    )


def bodies_of(ev: DataFrame) -> DataFrame:
    """The same events as raw webhook deliveries: JSON body and receive time."""
    payment = F.struct(F.struct(
        F.col("payment_id").alias("id"), "order_id", "customer_id",
        F.col("amount_minor").alias("amount"), "currency", "method",
        F.when(F.col("method") == "card", F.concat(F.lit("card_"), F.col("k").cast("string"))).alias("card_id"),
        F.when(F.col("method") == "upi", F.concat(F.col("customer_id"), F.lit("@upi"))).alias("vpa"),
    ).alias("entity"))
    order = F.when(
        (F.col("event_type") == "order.paid") & F.col("order_id").isNotNull(),
        F.struct(F.struct(
            F.col("order_id").alias("id"), F.lit("paid").alias("status"),
            F.col("amount_minor").alias("amount"), "currency", "customer_id",
        ).alias("entity")),
    )
    body = F.to_json(F.struct(
        F.col("provider_event_id").alias("id"), F.lit("event").alias("entity"),
        F.lit("acc_main").alias("account_id"), F.col("event_type").alias("event"),
        F.unix_seconds("observed_at").alias("created_at"),
        F.struct(payment.alias("payment"), order.alias("order")).alias("payload"),
    ))
    return ev.select(
        "event_id", "received_at",
        body.alias("body"),
        "k",
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as payments, for the dashboards."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("pay_o"), F.col("o_orderkey").cast("string")).alias("payment_id"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "captured").when(F.col("o_orderstatus") == "O", "authorized")
        .otherwise("failed").alias("status"),
        F.col("o_orderpriority").alias("method"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_minor"),
        F.col("o_orderdate").cast("timestamp").alias("last_observed_at"),
    )
