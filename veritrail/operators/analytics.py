"""Dashboards over canonical payments: failures, funnel, revenue, trends, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import failure_category, text_list, parts, us
from veritrail.operators.risk import level
from veritrail.sources.driver_tables import lookup

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
PENDING = ("authorized", "pending", "created")


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(0.0)


def status_counts(payments: DataFrame, *by: str) -> DataFrame:
    s = F.col("status")
    return payments.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(s == "captured").alias("captured"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "authorized").alias("authorized"), F.count_if(s.isin(*PENDING)).alias("pending"),
        F.count_if(s.isin("created", "authorized", "captured", "pending")).alias("initiated"),
        F.sum(F.when(s == "captured", F.col("amount_minor"))).alias("captured_minor"),
        F.count(F.when(s == "captured", F.col("amount_minor"))).alias("captured_priced"),
        F.avg("amount_minor").alias("avg_minor"),
    )


def failure_summary(payments: DataFrame) -> DataFrame:
    c = status_counts(payments)
    return c.select("total", "captured", "failed", "pending", pct(F.col("captured"), F.col("total")).alias("success_rate"),
                    pct(F.col("failed"), F.col("total")).alias("failure_rate"))


def failure_categories(events: DataFrame, latest: int | None = None) -> DataFrame:
    """Failed deliveries by category; `latest` limits the report to the newest ones."""
    failed = events.filter(F.col("processing_status") == "FAILED")
    if latest is not None:
        failed = failed.orderBy(F.desc("received_at"), F.desc("event_id")).limit(latest)
    counts = failed.groupBy(failure_category(F.col("error_text"), F.col("event_type")).alias("category")).agg(F.count("*").alias("n"))
    total = failed.agg(F.count("*").alias("t")).scalar()
    return counts.select("category", "n", total.alias("t")).select(
        "category", F.col("n").alias("failures"), pct(F.col("n"), F.col("t")).alias("percentage"),
        lookup("category", V.FAILURE_SEVERITY, "MEDIUM").alias("severity"))


def payment_failure_analysis(payments: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = payments.filter(F.col("status") == "failed").join(
        evidence.select("payment_id", "evidence_count"), "payment_id", "left").join(
        conflicts.select("payment_id", "conflict_count"), "payment_id", "left")
    signals = parts(F.when(n("evidence_count") == 0, "NO_EVIDENCE"),
                    F.when(n("conflict_count") > 0, F.concat(F.lit("ACTIVE_CONFLICTS:"), n("conflict_count").cast("string"))))
    category = failure_category(F.lit(None).cast("string"), F.col("status"))
    return j.select(
        "payment_id", category.alias("failure_category"),
        F.round((us("last_observed_at") - us("first_observed_at")) / 1_000_000, 3).alias("seconds_to_failure"),
        text_list(signals).alias("signals"))


def payment_funnel(payments: DataFrame) -> DataFrame:
    """Four stages from one aggregate; the drop of each stage is against the one before it."""
    c = status_counts(payments)
    t = F.col("total")

    def stage(order, name, n, before):
        drop = F.lit(0).cast("bigint") if before is None else F.greatest(F.lit(0).cast("bigint"), before - n)
        rate = F.lit(0.0) if before is None else pct(drop, before)
        return F.struct(F.lit(order).cast("bigint").alias("stage_order"), F.lit(name).alias("stage"), n.alias("payments"),
                        pct(n, t).alias("percentage"), drop.alias("drop_off"), rate.alias("drop_off_pct"))
    stages = F.array(
        stage(1, "Created", F.col("initiated"), None), stage(2, "Authorized", F.col("authorized"), F.col("initiated")),
        stage(3, "Captured", F.col("captured"), F.col("authorized")), stage(4, "Failed", F.col("failed"), None))
    worst = F.array_max(F.transform(stages, lambda s: F.named_struct(
        F.lit("p"), s["drop_off_pct"], F.lit("o"), -s["stage_order"], F.lit("n"), s["stage"])))
    return c.select(pct(F.col("captured"), t).alias("conversion_rate"), worst["n"].alias("biggest_drop"),
                    F.explode(stages).alias("s")).select("s.*", "conversion_rate", "biggest_drop")


def revenue_summary(payments: DataFrame) -> DataFrame:
    c = status_counts(payments)
    rate = pct(F.col("captured"), F.col("total"))
    return c.select(
        F.round(F.coalesce("captured_minor", F.lit(0)) / 100, 2).alias("gmv"),
        F.when(F.col("captured_priced") > 0, F.round(F.col("captured_minor") / F.col("captured_priced") / 100, 2)).otherwise(0.0).alias("avg_ticket"),
        rate.alias("success_rate"), "total", "captured", "failed",
        F.when(F.col("captured") * 100 > F.col("total") * 90, "UP").when(F.col("captured") * 100 < F.col("total") * 70, "DOWN").otherwise("STABLE").alias("success_trend"),
        F.when(F.col("failed") < F.col("total") * 0.1, "DOWN").otherwise("UP").alias("failure_trend"))


def trend_buckets(payments: DataFrame, now_us: int) -> DataFrame:
    """Zero-filled tumbling buckets up to now: 24 hours while data is that fresh, else days.

    The bucket kind depends on the newest payment, so it comes from a scalar subquery; payments are
    aggregated once by bucket number and meet a grid of at most 30 rows.
    """
    day_end = (now_us // DAY_US + 1) * DAY_US
    newest = payments.agg(F.max(us("last_observed_at")).alias("m"))
    hourly = F.col("m").isNull() | (F.lit(now_us) - F.col("m") <= DAY_US)
    days = F.greatest(F.lit(1), F.least(F.lit(30), F.lit(now_us // DAY_US) - F.floor(F.col("m") / DAY_US) + 1))
    plan = newest.select(
        F.when(hourly, F.lit(now_us)).otherwise(day_end).alias("anchor"),
        F.when(hourly, F.lit(HOUR_US)).otherwise(DAY_US).alias("unit"), F.when(hourly, F.lit(24)).otherwise(days).cast("bigint").alias("n"))
    grid = plan.select("anchor", "unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("b")).select(
        "b", (F.col("anchor") - (F.col("b") + 1) * F.col("unit")).alias("start_us"), (F.col("anchor") - F.col("b") * F.col("unit")).alias("end_us"))
    s = F.col("status")
    placed = payments.select(
        "status", "amount_minor", us("last_observed_at").alias("t"), plan.select(F.struct("anchor", "unit")).scalar().alias("p"))
    per = placed.withColumn("b", F.ceil((F.col("p.anchor") - F.col("t")) / F.col("p.unit")) - 1).groupBy("b").agg(
        F.count_if(s == "failed").alias("failures"), F.count_if(s == "captured").alias("successes"),
        F.sum(F.when(s == "captured", F.col("amount_minor"))).alias("gmv_minor"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return grid.join(per, "b", "left").select(
        "start_us", "end_us", z("failures").alias("failures"), z("successes").alias("successes"),
        F.round(z("gmv_minor") / 100, 2).alias("gmv"), pct(z("successes"), z("successes") + z("failures")).alias("success_rate"))


def risk_by_method(payments: DataFrame, conflicts: DataFrame) -> DataFrame:
    rows = payments.join(conflicts.select("payment_id", "conflict_count"), "payment_id", "left")
    c = status_counts(payments.filter("method <> ''"), "method")
    k = rows.filter("method <> ''").groupBy("method").agg(F.sum(F.coalesce("conflict_count", F.lit(0))).alias("conflicts"))
    fr, cr = F.col("failed") / F.col("total") * 100, F.col("conflicts") / F.col("total") * 100
    score = (
        F.lit(100.0) - F.when(fr > 30, 30.0).when(fr > 15, 15.0).otherwise(0.0)
        - F.when(cr > 20, 25.0).when(cr > 10, 10.0).otherwise(0.0) - F.when(F.col("total") < 3, 10.0).otherwise(0.0))
    reasons = parts(F.when(fr > 20, "high failure rate"), F.when(cr > 15, "high conflict rate"), F.when(F.col("total") < 5, "small sample"))
    return c.join(k, "method").select(
        "method", "total", F.round(F.col("captured") / F.col("total") * 100, 1).alias("success_rate"), F.round(fr, 1).alias("failure_rate"),
        F.round(cr, 1).alias("conflict_rate"), F.round(F.coalesce(F.col("avg_minor") / 100, F.lit(0.0)), 2).alias("avg_amount"),
        score.alias("risk_score"), level(score).alias("risk_level"),
        F.when(F.size(reasons) == 0, "none").otherwise(text_list(reasons)).alias("key_risks"))


def risk_by_currency(payments: DataFrame) -> DataFrame:
    c = status_counts(payments.filter("currency <> ''"), "currency")
    rate = F.col("captured") / F.col("total") * 100
    return c.select(
        "currency", "total", F.round(rate, 1).alias("risk_score"), F.when(rate >= 76, "LOW_RISK").otherwise("MEDIUM_RISK").alias("risk_level"),
        F.round(100 - rate, 1).alias("failure_rate"),
        F.when(F.col("captured") > 0, F.round(F.coalesce("captured_minor", F.lit(0)) / F.col("captured") / 100, 2)).otherwise(0.0).alias("avg_captured"))


def recent_failures(payments: DataFrame, k: int = 10) -> DataFrame:
    return payments.filter("status = 'failed'").orderBy(F.desc("last_observed_at"), "payment_id").limit(k)


def high_value_recent(payments: DataFrame, now_us: int, k: int = 3) -> DataFrame:
    recent = us("last_observed_at") >= now_us - HOUR_US
    return payments.filter((F.col("amount_minor") >= V.HIGH_VALUE_MINOR) & (F.col("status") == "captured") & recent).orderBy(
        F.desc("amount_minor"), "payment_id").limit(k)


def notifications(payments: DataFrame, conflicts: DataFrame, now_us: int, failures: int = 5, anomalies: int = 5, most: int = 50) -> DataFrame:
    """The latest `most` of: latest failures and strong conflicts (so many of each), milestones, high-value payments.

    `conflicts`: payment_id, conflict_type, severity, detected_us.
    """
    def item(df, kind, ref, category, severity, ts):
        ident = F.substring(F.sha2(F.concat_ws("|", F.lit(kind), ref, F.lit(str(now_us))), 256), 1, 16)
        return df.select(ident.alias("notification_id"), F.lit(category).alias("category"), severity.alias("severity"), ts.alias("ts_us"))
    failed = payments.filter((F.col("status") == "failed") & (us("last_observed_at") >= now_us - HOUR_US)).orderBy(
        F.desc("last_observed_at"), "payment_id").limit(failures)
    hot = conflicts.filter(F.col("severity").isin("HIGH", "CRITICAL")).orderBy(F.desc("detected_us"), "payment_id", "conflict_type").limit(anomalies)
    milestone = payments.agg(F.count("*").alias("n")).filter("n > 0 AND n % 10 = 0")
    return (
        item(failed, "FAIL", F.col("payment_id"), "FAILURE", F.lit("WARNING"), us("last_observed_at"))
        .unionByName(item(hot, "CONFLICT", F.concat_ws(":", "payment_id", "conflict_type"), "ANOMALY",
                          F.when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise("WARNING"), F.col("detected_us")))
        .unionByName(item(milestone, "MILESTONE", F.col("n").cast("string"), "MILESTONE", F.lit("INFO"), F.lit(now_us)))
        .unionByName(item(high_value_recent(payments, now_us), "HIGHVAL", F.col("payment_id"), "ANOMALY", F.lit("INFO"), us("last_observed_at")))
        .orderBy(F.desc("ts_us"), "notification_id").limit(most)
    )
