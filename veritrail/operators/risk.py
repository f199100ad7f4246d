"""Risk scores and fraud signals: one wide row per payment, rules as expressions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import vocab as V
from veritrail.functions.skew import near_sums
from veritrail.sources.driver_tables import lookup

BURST_WINDOW_US = 30_000_000


def level(score: Column) -> Column:
    return (
        F.when(score >= 76, "LOW_RISK").when(score >= 51, "MEDIUM_RISK").when(score >= 26, "HIGH_RISK")
        .otherwise("CRITICAL_RISK")
    )


def evidence_totals(payment_obs: DataFrame) -> DataFrame:
    return payment_obs.groupBy("payment_id", "source_type").agg(
        F.count("*").alias("n"), F.max("observed_us").alias("t")
    ).groupBy("payment_id").agg(
        F.sum("n").alias("evidence_count"), F.count("source_type").alias("source_count"), F.max("t").alias("latest_us"))


def risk_score(payments: DataFrame, evidence: DataFrame, conflicts: DataFrame, coverage: DataFrame,
               structure: DataFrame, at_us: int) -> DataFrame:
    """Seven weighted dimensions per payment; every input has at most one row per payment."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = (
        payments.select("payment_id")
        .join(evidence, "payment_id", "left")
        .join(conflicts.select("payment_id", "conflict_count", "open_conflict_count", "ordering_ambiguities"), "payment_id", "left")
        .join(coverage.select("payment_id", F.col("overall_status").alias("coverage_status")), "payment_id", "left")
        .join(structure.select("payment_id", "distinct_claims", "corroborated_claim_count", "multi_source_claim_count"),
              "payment_id", "left")
    )
    # every conflict found is still open, informational ones included
    total = n("conflict_count")
    open_n = total
    age = F.lit(at_us) - F.col("latest_us")
    minute = 60_000_000
    scores = {
        "evidence_volume": F.least(F.lit(100.0), n("evidence_count") * 10.0),
        "source_diversity": F.least(F.lit(100.0), n("source_count") * 33.3),
        "consistency": F.when(total == 0, 100.0).when(open_n == 0, 70.0).otherwise(
            F.greatest(F.lit(0.0), 100.0 - open_n * 25.0)),
        "coverage": F.when(F.col("coverage_status") == "COMPLETE", 100.0)
        .when(F.col("coverage_status").isin("SUFFICIENT", "SUBSTANTIALLY_COMPLETE"), 75.0)
        .when(F.col("coverage_status") == "PARTIAL", 45.0).when(F.col("coverage_status") == "INSUFFICIENT", 15.0).otherwise(30.0),
        "freshness": F.when(F.col("latest_us").isNull(), 0.0).when(age < 5 * minute, 100.0).when(age < 60 * minute, 75.0)
        .when(age < 1440 * minute, 50.0).otherwise(20.0),
        "corroboration": F.when(F.col("distinct_claims").isNull(), 25.0).otherwise(F.least(F.lit(100.0), (
            F.col("corroborated_claim_count") + F.col("multi_source_claim_count")) / (F.greatest("distinct_claims", F.lit(1)) * 2) * 100.0)),
        "conflict_resolution": F.when(total == 0, 100.0).otherwise((total - open_n) / total * 100.0),
    }
    base = j.select("payment_id", n("evidence_count").alias("evidence_count"), n("source_count").alias("source_count"),
                    total.alias("conflict_count"), "coverage_status", *[F.round(s, 1).alias(k) for k, s in scores.items()])
    # scores have one decimal and weights two, so the weighted sum is exact in integers
    exact = F.lit(0).cast("bigint")
    for k, w in V.RISK_WEIGHTS.items():
        exact = exact + F.round(F.col(k) * 10).cast("bigint") * round(w * 100)
    composite = F.floor((exact + 50) / 100) / 10
    dims = list(V.RISK_WEIGHTS)
    low = F.array_min(F.array(*[F.struct(F.col(k).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("d")) for i, k in enumerate(dims)]))
    high = F.array_max(F.array(*[F.struct(F.col(k).alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("d")) for i, k in enumerate(dims)]))
    scored = base.withColumn("composite", F.greatest(F.lit(0.0), F.least(F.lit(100.0), composite)))
    advice = E.parts(
        F.when(F.col("conflict_count") > 0, "resolve conflicts"), F.when(F.col("source_count") < 2, "add sources"),
        F.when(F.col("freshness") < 50, "refresh evidence"),
        F.when(F.col("coverage_status").isin("INSUFFICIENT", "PARTIAL"), "complete coverage"),
        F.when(F.col("composite") < 50, "manual review"))
    return scored.select(
        "*", level(F.col("composite")).alias("risk_level"),
        F.when(F.col("freshness") >= 75, "FRESH").when(F.col("freshness") >= 50, "AGING").otherwise("STALE").alias("freshness_status"),
        low["d"].alias("weakest"), high["d"].alias("strongest"),
        F.when(F.size(advice) == 0, "healthy").otherwise(E.text_list(advice)).alias("recommendations"),
    )


def dimension_status(score: Column) -> Column:
    return F.when(score >= 76, "STRONG").when(score >= 51, "ADEQUATE").when(score >= 26, "WEAK").otherwise("CRITICAL")


def risk_dimensions(scored: DataFrame) -> DataFrame:
    """A row for each payment and dimension: score, status and weight."""
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("dimension"), F.col(k).alias("score"), F.lit(w).alias("weight")) for k, w in V.RISK_WEIGHTS.items()]))
    return scored.select("payment_id", each.alias("d")).select(
        "payment_id", "d.dimension", "d.score", dimension_status(F.col("d.score")).alias("status"), "d.weight")


def velocity(payment_events: DataFrame) -> DataFrame:
    """Largest number of events of a payment inside any trailing 30 s window."""
    slots = payment_events.groupBy("payment_id", E.us("event_time").alias("t_us")).agg(F.count("*").alias("at"))
    return near_sums(slots, ["payment_id"], "t_us", BURST_WINDOW_US, "at").groupBy("payment_id").agg(
        F.sum("at").alias("event_count"), F.max("before").alias("burst"))


def fraud_signals(payments: DataFrame, evidence: DataFrame, conflicts: DataFrame, events: DataFrame,
                  min_burst: int = 3) -> DataFrame:
    """One row per raised signal. `payments`: payment_id, amount_minor."""
    totals = payments.agg(F.struct(F.sum("amount_minor").alias("s"), F.count("amount_minor").alias("n")).alias("t")).scalar()
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = (
        payments.select("payment_id", "amount_minor", totals.alias("all"))
        .join(evidence.select("payment_id", "evidence_count", "source_count"), "payment_id", "left")
        .join(conflicts.select("payment_id", "conflict_count", "state_conflicts", "temporal_conflicts"), "payment_id", "left")
        .join(events.select("payment_id", "event_count", "burst"), "payment_id", "left")
    )
    mean_others = (F.col("all.s") - F.col("amount_minor")) / F.when(F.col("all.n") > 1, F.col("all.n") - 1)
    ratio = F.when(mean_others > 0, F.col("amount_minor") / mean_others)

    def signal(cond, kind, severity, confidence):
        c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.when(cond, F.struct(F.lit(kind).alias("signal_type"), F.lit(severity).alias("severity"),
                                     F.round(F.least(F.lit(1.0), c), 4).alias("confidence")))
    signals = E.parts(
        signal(ratio >= 10, "AMOUNT_ANOMALY", "HIGH", ratio / 50.0),
        signal(n("burst") >= min_burst, "VELOCITY_BURST", "HIGH", n("burst") / 10.0),
        signal((n("evidence_count") > 0) & (n("source_count") <= 1), "SOURCE_CONCENTRATION", "MEDIUM", 0.6),
        signal(n("state_conflicts") > 0, "STATUS_CONTRADICTION", "HIGH", 0.8),
        signal(n("temporal_conflicts") > 0, "TIMESTAMP_INVERSION", "MEDIUM", 0.7),
        signal((n("event_count") > 0) & (n("evidence_count") == 0), "MISSING_EVIDENCE_GAPS", "CRITICAL", 0.95),
        signal(n("conflict_count") >= 2, "CONFLICT_CLUSTER", "HIGH", n("conflict_count") / 5.0),
        signal(F.col("amount_minor") >= V.HIGH_AMOUNT_MINOR, "HIGH_AMOUNT", "LOW", 0.5),
    )
    return j.select("payment_id", F.explode(signals).alias("x")).select("payment_id", "x.*")


def fraud_overall(signals: DataFrame, payments: DataFrame) -> DataFrame:
    s = F.col("severity")
    agg = signals.groupBy("payment_id").agg(
        F.count("*").alias("n"), F.count_if(s == "CRITICAL").alias("critical"), F.count_if(s == "HIGH").alias("high"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return payments.select("payment_id").join(agg, "payment_id", "left").select(
        "payment_id", n("n").alias("signal_count"),
        F.when(n("critical") > 0, "HIGHLY_SUSPICIOUS").when(n("high") >= 2, "SUSPICIOUS")
        .when((n("high") == 1) | (n("n") >= 2), "ELEVATED").otherwise("CLEAR").alias("assessment"))


def fraud_patterns(payments: DataFrame, evidence: DataFrame, conflicts: DataFrame, high_minor: int = V.HIGH_AMOUNT_MINOR) -> DataFrame:
    """Patterns across all payments; members are listed by `fraud_pattern_members`."""
    high = payments.agg(F.count_if(F.col("amount_minor") >= high_minor).alias("n"), F.count("*").alias("total"))
    single = evidence.agg(F.count_if(F.col("source_count") == 1).alias("n"))
    conflicted = conflicts.agg(F.count_if(F.col("conflict_count") > 0).alias("n"))
    row = lambda df, kind, severity, keep: df.filter(keep).select(
        F.lit(kind).alias("pattern_type"), F.lit(severity).alias("severity"), F.col("n").alias("affected_payments"))
    return (
        row(high, "HIGH_VALUE_CLUSTER", "MEDIUM", F.col("n") >= 2)
        .unionByName(row(single, "SINGLE_SOURCE_EVIDENCE", "MEDIUM", F.col("n") >= 3))
        .unionByName(row(conflicted.withColumn("total", high.select("total").scalar()), "HIGH_CONFLICT_RATE", "HIGH",
                         (F.col("n") > 0) & (F.col("n") / F.col("total") > 0.3)))
    )


def pattern_members(payments: DataFrame, evidence: DataFrame, high_minor: int = V.HIGH_AMOUNT_MINOR) -> DataFrame:
    return payments.filter(F.col("amount_minor") >= high_minor).select(
        F.lit("HIGH_VALUE_CLUSTER").alias("pattern_type"), "payment_id"
    ).unionByName(evidence.filter("source_count = 1").select(F.lit("SINGLE_SOURCE_EVIDENCE").alias("pattern_type"), "payment_id"))


def risk_trend(snapshots: DataFrame, keep: int = 50) -> DataFrame:
    """Rough score of each of the latest snapshots of a payment."""
    w = Window.partitionBy("payment_id").orderBy(F.desc("eval_us"))
    rows = snapshots.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
    # freshness and independence results are always part of a snapshot: +5 each
    score = lookup("overall_status", V.TREND_BASE, 50) - F.when(F.col("open_conflict_count") > 0, 15).otherwise(0) + 10
    return rows.select("payment_id", "eval_us", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("double").alias("score"))
