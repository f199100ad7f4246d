"""Payment profiles, recommendations and the combined timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.expr import parts, text_list, us


def payment_profile(payments: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = payments.join(evidence, "payment_id", "left").join(
        conflicts.select("payment_id", "conflict_count", "open_conflict_count"), "payment_id", "left")
    flags = parts(
        F.when(n("evidence_count") == 0, "ZERO_EVIDENCE"), F.when(n("conflict_count") > 0, "ACTIVE_CONFLICTS"),
        F.when(n("source_count") < 2, "SINGLE_SOURCE"),
        F.when((n("evidence_count") > 0) & (n("event_count") == 0), "ORPHANED_EVIDENCE"))
    return j.select(
        "payment_id", "status", "amount_minor", "currency", n("evidence_count").alias("evidence_count"),
        n("source_count").alias("source_count"), n("event_count").alias("event_count"), n("conflict_count").alias("conflict_count"),
        text_list(flags).alias("anomaly_flags"))


def recommendations(profile: DataFrame) -> DataFrame:
    """Per-payment rows, plus the system row when any conflict is open or there is no payment."""
    def rec(cond, suffix, priority, category):
        return F.when(cond, F.struct(F.concat(F.lit("REC-"), F.col("payment_id"), F.lit(suffix)).alias("recommendation_id"),
                                     F.lit(priority).alias("priority"), F.lit(category).alias("category")))
    items = parts(
        rec(F.col("conflict_count") > 0, "-CONFLICTS", "HIGH", "CONFLICT_RESOLUTION"),
        rec(F.col("source_count") < 2, "-SOURCES", "MEDIUM", "EVIDENCE_DIVERSITY"),
        rec(F.col("evidence_count") == 0, "-MISSING", "URGENT", "MISSING_EVIDENCE"))
    system = profile.agg(F.count("*").alias("payments"), F.sum("conflict_count").alias("conflicts")).select(
        F.when(F.col("payments") == 0, F.struct(F.lit("REC-SYS-NO-DATA").alias("recommendation_id"), F.lit("MEDIUM").alias("priority"), F.lit("DATA_INGESTION").alias("category")))
        .when(F.col("conflicts") > 0, F.struct(F.lit("REC-SYS-CONFLICTS").alias("recommendation_id"), F.lit("HIGH").alias("priority"), F.lit("SYSTEM_CONFLICTS").alias("category")))
        .otherwise(F.struct(F.lit("REC-SYS-OK").alias("recommendation_id"), F.lit("LOW").alias("priority"), F.lit("HEALTHY").alias("category"))).alias("r"))
    return profile.select(F.explode(items).alias("r")).unionByName(system).select("r.*")


def timeline(payment_events: DataFrame, payment_obs: DataFrame, conflicts: DataFrame, facts: DataFrame, detected_us: int) -> DataFrame:
    """Flat chronology of all payments; order by (payment_id, ts_us)."""
    def part(df, ts, kind, severity, ident):
        return df.select("payment_id", ts.alias("ts_us"), F.lit(kind).alias("kind"), severity.alias("severity"), ident.cast("string").alias("entity_id"))
    info = F.lit("INFO")
    return (
        part(payment_events, us("event_time"), "PAYMENT_EVENT", info, F.col("payment_event_id"))
        .unionByName(part(payment_obs, F.col("observed_us"), "EVIDENCE_OBSERVED", info, F.col("evidence_id")))
        .unionByName(part(conflicts, F.lit(detected_us), "CONFLICT_DETECTED",
                          F.when(F.col("severity").isin("HIGH", "CRITICAL"), "ALERT").otherwise("WARNING"), F.col("conflict_type")))
        .unionByName(part(facts, F.col("first_us"), "FACT_RECONCILED", info, F.col("fact_hash")))
    )
