"""Per-observation quality: freshness, source quality, outcome history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import expr as E


def freshness(obs: DataFrame, at_us) -> DataFrame:
    at = at_us if not isinstance(at_us, int) else F.lit(at_us)
    o = F.col("observed_us")
    return obs.select(
        "*", E.freshness_policy().alias("freshness_policy_key"),
        F.when(o <= at, (at - o) / 1_000_000).alias("age_seconds"),
        E.freshness_state(o, at).alias("freshness_state"),
    )


def source_quality(obs: DataFrame) -> DataFrame:
    return obs.select(
        "*", E.authority(F.col("source_type")).alias("authority_level"),
        E.directness(F.col("source_type"), F.col("evidence_type")).alias("directness"),
    )


def historical_reliability(obs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome history per evidence type; `outcomes` (evidence_type) may be empty."""
    counts = outcomes.groupBy("evidence_type").agg(F.count("*").alias("sample_count"))
    return obs.join(counts, "evidence_type", "left").withColumn("reliability_status", E.outcome_status(F.col("sample_count")))


def at_points(df: DataFrame, points, visible_col: str = "observed_us") -> DataFrame:
    """One copy of each row per evaluation point at which it is visible (a short fixed list)."""
    return df.withColumn("eval_us", F.explode(F.array(*[F.lit(p) for p in points]))).filter(
        F.col(visible_col) <= F.col("eval_us"))


def quality_snapshot(obs: DataFrame, points) -> DataFrame:
    rows = at_points(obs, points)
    return source_quality(freshness(rows, F.col("eval_us"))).withColumn("reliability_status", F.lit("NO_OUTCOME_DATA"))
