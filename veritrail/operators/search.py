"""Look-ups over the canonical frames: scope, search, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(df: DataFrame, col: str, at_us: int) -> DataFrame:
    """Rows visible at a point in time; a missing time is never visible."""
    return df.filter(F.col(col) <= F.lit(at_us))


def evidence_scope(observations: DataFrame, payments: DataFrame, at_us: int) -> DataFrame:
    """Every candidate observation with its inclusion or the reason it is left out.

    Candidates are a payment's own observations, and those of the order that payments point to. The latter are
    out of scope for all of them alike, so each is listed once with the number of payments (`payments`, and no
    payment_id); `order_candidates` lists them for chosen payments.
    """
    reason = (
        F.when(F.col("observed_us").isNull() | (F.col("observed_us") > at_us), "OBSERVED_AFTER_EVALUATION_TIME")
        .when(F.col("valid_until_us") <= at_us, "INVALIDATED")
    )
    own = observations.filter(F.col("subject_type") == "payment").select(
        F.col("subject_id").alias("payment_id"), "evidence_id", "subject_type", "observed_us", reason.alias("reason"), F.lit(1).cast("bigint").alias("payments"))
    per_order = payments.filter(F.col("order_id").isNotNull()).groupBy(F.col("order_id").alias("subject_id")).agg(F.count("*").alias("payments"))
    linked = observations.filter(F.col("subject_type") == "order").join(per_order, "subject_id").select(
        F.lit(None).cast("string").alias("payment_id"), "evidence_id", "subject_type", "observed_us", F.lit("OUTSIDE_EVALUATION_SCOPE").alias("reason"), "payments")
    return own.unionByName(linked).withColumn("inclusion_status", F.when(F.col("reason").isNull(), "INCLUDED").otherwise("EXCLUDED"))


def order_candidates(observations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Order evidence of chosen payments (payment_id, order_id), one row for each payment and observation."""
    return observations.filter(F.col("subject_type") == "order").join(
        chosen.select("payment_id", F.col("order_id").alias("subject_id")), "subject_id").select(
        "payment_id", "evidence_id", "subject_type", "observed_us", F.lit("OUTSIDE_EVALUATION_SCOPE").alias("reason"))


def matches(term: str, *cols: str) -> Column:
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return hit


def hits(df: DataFrame, kind: str, relevance: float, id_col: str, title: str, ts: str, term: str, cols) -> DataFrame:
    return df.filter(matches(term, *cols)).select(
        F.lit(kind).alias("entity_type"), F.col(id_col).cast("string").alias("entity_id"),
        F.col(title).alias("title"), F.lit(relevance).alias("relevance"), F.col(ts).alias("ts_us"),
    )


def top_hits(parts: list[DataFrame], k: int) -> DataFrame:
    """Best k over all result kinds; each kind contributes a partial top-k, not its whole list."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out.orderBy(F.desc("relevance"), F.desc("ts_us"), "entity_type", "entity_id").limit(k)


SENSITIVE = ("email", "contact", "vpa", "card", "card_id", "secret", "signature", "token")


def sanitize(map_col: Column) -> Column:
    """Metadata without the entries whose key is sensitive."""
    return F.map_filter(map_col, lambda k, _v: ~F.lower(k).isin(*SENSITIVE))
