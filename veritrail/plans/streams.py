"""Streaming queries run over everything available in the data directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.expr import us
from veritrail.functions.skew import prefix_before, time_chunks
from veritrail.plans.registry import query
from veritrail.sources import driver_tables
from veritrail.streaming import pipeline


@query("stateful_payment", "SELECT payment_id, status, captured, last_us, event_count FROM v_payments")
def _(f):
    return pipeline.stateful_payments(pipeline.event_stream(f.spark, f"{f.sf_dir}/events.parquet"))


@query("stream_trend", """
SELECT (observed_us // 3600000000) * 3600000000 AS start_us, count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'captured') AS captures FROM v_norm GROUP BY 1""")
def _(f):
    return pipeline.drain(pipeline.hourly_trend(pipeline.event_stream(f.spark, f"{f.sf_dir}/events.parquet")), ["start_us"])


@query("stream_dedup", """
SELECT count(*) AS kept, count(provider_event_id) AS with_id, count(DISTINCT provider_event_id) AS ids FROM (
  SELECT DISTINCT provider_event_id, CASE WHEN provider_event_id IS NULL THEN webhook_event_id END FROM v_deliveries)""")
def _(f):
    """Every ninth event arrives twice, every 23rd without an id."""
    ev = pipeline.event_stream(f.spark, f"{f.sf_dir}/events.parquet")
    twice = ev.withColumn("d", F.explode(F.expr("IF(k % 9 = 0, array(0, 1), array(0))"))).select(
        (F.col("event_id") * 2 + F.col("d")).alias("webhook_event_id"), F.expr("IF(k % 23 <> 0, provider_event_id, NULL)").alias("provider_event_id"),
        (F.col("received_at") + driver_tables.seconds(F.col("d") * 60)).alias("received_at"))
    kept = pipeline.drain(pipeline.dedup(twice), [], "append")
    return kept.groupBy("provider_event_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("kept"), F.sum(F.when(F.col("provider_event_id").isNotNull(), F.col("n"))).alias("with_id"),
        F.count("provider_event_id").alias("ids"))


@query("late_data_policy", """
SELECT payment_id, count(*) FILTER (WHERE observed_us < seen_before) AS late_events, max(rank) AS top_rank FROM v_fold_rows GROUP BY 1""")
def _(f):
    """Late events per payment; they never lower the rank that was reached."""
    rank = driver_tables.lookup("status", {"authorized": 2, "captured": 3, "failed": 3, "paid": 3}, 0).cast("bigint")
    rows = f.normalized.select("payment_id", "event_id", us("received_at").alias("received_us"), us("observed_at").alias("observed_us"), rank.alias("rank"))
    seen = prefix_before(rows, ["payment_id"], ["received_us", "event_id"], time_chunks(F.col("received_us")),
                         F.col("observed_us"), "max", "seen_before")
    return seen.groupBy("payment_id").agg(
        F.count_if(F.col("observed_us") < F.col("seen_before")).alias("late_events"), F.max("rank").alias("top_rank"))
