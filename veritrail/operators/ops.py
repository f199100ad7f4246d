"""Pipeline operations: lag, watermark, freshness of layers, stuck events, invariants, incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.expr import us

MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000
PENDING = ("RECEIVED", "PERSISTED")


def ingest_metrics(events: DataFrame, now_us: int) -> DataFrame:
    s = F.col("processing_status")
    return events.agg(
        F.count("*").alias("received"), F.count_if(s == "PROCESSED").alias("processed"), F.count_if(s == "FAILED").alias("failed"),
        F.count_if(us("received_at") >= now_us - HOUR_US).alias("received_1h"),
        F.count_if(s.isin(*PENDING) & (us("received_at") <= now_us - MINUTE_US)).alias("stuck"),
        F.max(us("received_at")).alias("last_received_us"), F.max(F.when(s == "PROCESSED", us("processed_at"))).alias("last_processed_us"))


def lag_metrics(events: DataFrame, k: int = 20) -> DataFrame:
    lag = us("processed_at") - us("received_at")
    recent = events.filter("processing_status = 'PROCESSED' AND processed_at IS NOT NULL AND received_at IS NOT NULL").select(
        us("processed_at").alias("p"), "event_id", lag.alias("lag")).orderBy(F.desc("p"), F.desc("event_id")).limit(k).filter("lag >= 0")
    return recent.agg(
        F.round(F.avg("lag") / 1e6, 3).alias("avg_lag"), F.round(F.max("lag") / 1e6, 3).alias("max_lag"),
        F.round(F.max_by("lag", F.struct("p", "event_id")) / 1e6, 3).alias("latest_lag"))


def pipeline_watermark(stages: dict[str, DataFrame], received: DataFrame) -> DataFrame:
    """Watermark = the least advanced stage. `stages`: name -> frame with a column `t_us`."""
    tops = None
    for name, df in stages.items():
        top = df.agg(F.max("t_us").alias("t_us")).withColumn("stage", F.lit(name))
        tops = top if tops is None else tops.unionByName(top)
    mark = tops.agg(F.min("t_us").alias("watermark_us"), F.min_by("stage", F.struct("t_us", "stage")).alias("slowest_stage"))
    last = received.agg(F.max("t_us").alias("m")).scalar()
    return mark.select("watermark_us", "slowest_stage", last.alias("received_us")).withColumn(
        "caught_up", F.col("received_us") - F.col("watermark_us") <= 30_000_000)


def stage_freshness(evidence: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Per payment and layer: is the latest evaluation newer than the latest evidence?

    `evidence`: payment_id, latest_us. Each layer: payment_id, eval_us (one row per payment).
    """
    j = evidence
    for name, df in layers.items():
        j = j.join(df.select("payment_id", F.col("eval_us").alias(name)), "payment_id", "left")
    items = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("eval_us")) for n in layers])
    rows = j.select("payment_id", "latest_us", F.explode(items).alias("x")).select("payment_id", "latest_us", "x.*")
    behind = F.col("latest_us") > F.col("eval_us")
    return rows.select(
        "payment_id", "layer",
        F.when(F.col("eval_us").isNull(), "UNKNOWN").when(behind, "STALE").otherwise("CURRENT").alias("status"),
        F.when(behind, F.round((F.col("latest_us") - F.col("eval_us")) / 1e6, 3)).alias("lag_seconds"))


def stuck_events(events: DataFrame, now_us: int) -> DataFrame:
    return events.filter(F.col("processing_status").isin(*PENDING) & (us("received_at") <= now_us - MINUTE_US))


def retry_candidates(events: DataFrame, k: int = 100) -> DataFrame:
    waiting = F.col("processing_status").isin(*PENDING, "FAILED") & (F.col("retry_count") < 5)
    return events.filter(waiting).orderBy("event_id").limit(k)


def invariant_checks(events: DataFrame, deduped: DataFrame, payment_events: DataFrame, stale_layers: DataFrame) -> DataFrame:
    """One row per data invariant: the number of violations and the verdict."""
    s = F.col("processing_status")
    base = events.agg(
        F.count("*").alias("n"), F.count_if(s.isNull()).alias("no_status"), F.count_if(s == "FAILED").alias("failed"))
    linked = events.filter("processing_status = 'PROCESSED' AND event_type IN ('payment.authorized', 'payment.captured', 'payment.failed', 'order.paid')").join(
        payment_events.select(F.col("webhook_event_id").alias("event_id")), "event_id", "left_anti").agg(F.count("*").alias("orphans"))
    # one aggregate per id keeps the distinct count off a single task
    dup = deduped.filter("provider_event_id IS NOT NULL").groupBy("provider_event_id").agg((F.count("*") - 1).alias("x")).agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("dups"))
    stale = stale_layers.agg(
        F.count_if(F.col("status").isNull()).alias("unmeasured"),
        F.count_if((F.col("status") == "CURRENT") & (F.col("lag_seconds") > 0)).alias("wrong"))

    def check(df, ident, name, col, warn_only=False):
        bad = F.col(col)
        verdict = F.when(bad == 0, "PASS").otherwise("WARN" if warn_only else "FAIL")
        return df.select(F.lit(ident).alias("check_id"), F.lit(name).alias("check_name"), bad.cast("bigint").alias("metric"), verdict.alias("status"))
    return (
        base.select(F.lit("INV-01").alias("check_id"), F.lit("events persisted").alias("check_name"), F.col("n").alias("metric"),
                    F.when(F.col("n") > 0, "PASS").otherwise("WARN").alias("status"))
        .unionByName(check(base, "INV-02", "status present", "no_status"))
        .unionByName(check(linked, "INV-03", "processed events have a payment", "orphans"))
        .unionByName(check(dup, "INV-04", "no duplicates after dedup", "dups"))
        .unionByName(check(base, "INV-05", "failed events", "failed", True))
        .unionByName(check(stale, "INV-07", "layer freshness measured", "unmeasured"))
        .unionByName(check(stale, "INV-10", "stale layers not shown as current", "wrong"))
    )


def incidents(events: DataFrame, now_us: int, window_us: int = 24 * HOUR_US) -> DataFrame:
    """Stuck events as one incident, and the latest ten failures inside the window."""
    stuck = stuck_events(events, now_us).agg(
        F.count("*").alias("n"), F.min_by("event_id", F.struct("received_at", "event_id")).alias("first_id"),
        F.min(us("received_at")).alias("detected_us")).filter("n > 0")
    a = stuck.select(
        F.concat(F.lit("INC-STUCK-"), F.col("first_id").cast("string")).alias("incident_id"), F.lit("PROCESSING_STUCK").alias("category"),
        F.when(F.col("n") < 5, "WARNING").otherwise("MAJOR").alias("severity"), "detected_us", F.col("n").alias("events"))
    failed = events.filter((F.col("processing_status") == "FAILED") & (us("received_at") >= now_us - window_us)).orderBy(
        F.desc("received_at"), F.desc("event_id")).limit(10)
    b = failed.select(
        F.concat(F.lit("INC-FAIL-"), F.col("event_id").cast("string")).alias("incident_id"), F.lit("PROCESSING_FAILURE").alias("category"),
        F.lit("WARNING").alias("severity"), us("received_at").alias("detected_us"), F.lit(1).cast("bigint").alias("events"))
    return a.unionByName(b)
