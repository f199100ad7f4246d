"""Evidence coverage of payments against the fixed requirement list.

All flags a requirement needs are aggregated once per payment; the ten requirements are then an
array expression on that row, so neither a cross join nor a join per requirement is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.skew import meet
from veritrail.operators.facts import keys_of

PROFILE, UNKNOWN_PROFILE = "STANDARD_PAYMENT", "UNKNOWN"
_EVIDENCE = sorted({r[2] for r in V.REQUIREMENTS})


def requirement_catalog(spark) -> DataFrame:
    rows = [(i + 1, r[0], r[1], r[2], ",".join(r[3])) for i, r in enumerate(V.REQUIREMENTS)]
    return spark.createDataFrame(
        rows, "requirement_order bigint, requirement_id string, base_type string, evidence_type string, fact_types string")


def payment_flags(payments: DataFrame, facts: DataFrame, payment_obs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row per payment known from any input, with what the requirements look at.

    `conflicts` holds value_conflicts and temporal_conflicts counts per payment. With an `eval_us`
    column in every input the result is per payment and evaluation time.
    """
    key = keys_of(facts)
    first = F.struct("first_us", "fact_hash", "observation_count", "status", "canonical_value")
    # earliest fact per type, then one small map per payment: fact types are a closed vocabulary
    per_type = facts.groupBy(*key, "fact_type").agg(F.min(first).alias("f"))
    by_fact = per_type.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("fact_type", "f"))).alias("f"))
    by_obs = payment_obs.groupBy(*key).agg(
        *[F.count_if(F.col("evidence_type") == t).alias(f"o_{t}") for t in _EVIDENCE],
        F.max(F.col("value") == "captured").alias("o_captured"), F.max(F.col("value") == "failed").alias("o_failed"),
    )
    p = payments.select(*key, F.col("status").alias("p_status"), F.col("captured").alias("p_captured"),
                        F.lit(True).alias("p_known"))
    c = conflicts.select(*key, ((F.col("value_conflicts") + F.col("temporal_conflicts")) > 0).alias("conflicted"))
    found = meet(key, p, by_fact, by_obs, c)
    return found.where(F.col("p_known").isNotNull() | F.col("f").isNotNull() | F.col(f"o_{_EVIDENCE[0]}").isNotNull())


def coverage_profile(flags: DataFrame, override: str | None = None) -> DataFrame:
    known = F.col("p_known").isNotNull()
    known = known | F.col("f").isNotNull()
    for t in _EVIDENCE:
        known = known | (F.coalesce(F.col(f"o_{t}"), F.lit(0)) > 0)
    chosen = F.lit(override) if override else F.when(known, PROFILE).otherwise(UNKNOWN_PROFILE)
    return flags.withColumn("profile_id", chosen)


def _applicable():
    """Effective requirement type of the conditional requirements."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.col("p_status")
    return {
        "REQ_PAYMENT_CAPTURED": yes(F.col("p_captured")) | yes(status == "captured")
        | F.col("f")["PAYMENT_CAPTURED"].isNotNull() | yes(F.col("o_captured")),
        "REQ_REFUND_RECORD": yes(F.lower(status).contains("refund")) | F.col("f")["PAYMENT_REFUNDED"].isNotNull(),
        "REQ_FAILURE_REASON": yes(status == "failed") | F.col("f")["PAYMENT_FAILED"].isNotNull() | yes(F.col("o_failed")),
    }


def coverage_results(flags: DataFrame) -> DataFrame:
    rows = coverage_profile(flags).filter(F.col("profile_id") == PROFILE)
    conditional = _applicable()
    conflicted = F.coalesce(F.col("conflicted"), F.lit(False))
    # the matching fact of every requirement, looked up once
    found = [F.least(*[F.col("f")[t] for t in types]) if len(types) > 1 else F.col("f")[types[0]] for _, _, _, types in V.REQUIREMENTS]
    rows = rows.withColumn("m", F.array(*found))
    out = []
    for i, (req, base, evidence, types) in enumerate(V.REQUIREMENTS):
        fact = F.col("m")[i]
        seen = F.coalesce(F.col(f"o_{evidence}"), F.lit(0).cast("bigint"))
        applies = conditional.get(req, F.lit(True))
        kind = F.when(applies, "REQUIRED" if base == "CONDITIONAL" else base).otherwise("NOT_APPLICABLE")
        inactive = fact["status"].isin("INVALIDATED", "SUPERSEDED") | (fact["canonical_value"] == "")
        state = (
            F.when(~applies, "NOT_APPLICABLE").when(fact.isNotNull() & conflicted, "CONFLICTED")
            .when(fact.isNotNull() & inactive, "PARTIAL").when(fact.isNotNull(), "PRESENT")
            .when(seen > 0, "PARTIAL").otherwise("MISSING")
        )
        out.append(F.struct(
            F.lit(req).alias("requirement_id"), kind.alias("requirement_type"), state.alias("observed_state"),
            F.when(applies, fact["fact_hash"]).alias("matched_fact"),
            F.when(~applies, F.lit(None)).when(fact.isNotNull(), fact["observation_count"])
            .when(seen > 0, seen).alias("matched_observations"),
        ))
    key = keys_of(rows)
    return rows.select(*key, F.explode(F.array(*out)).alias("r")).select(*key, "r.*")


def coverage_summary(results: DataFrame) -> DataFrame:
    kind, state = F.col("requirement_type"), F.col("observed_state")
    of = lambda k, s: F.count_if((kind == k) & (state == s))
    agg = results.groupBy(*keys_of(results)).agg(
        F.count("*").alias("total"), F.count_if(kind != "NOT_APPLICABLE").alias("applicable"),
        of("REQUIRED", "PRESENT").alias("required_present"), of("REQUIRED", "MISSING").alias("required_missing"),
        of("EXPECTED", "PRESENT").alias("expected_present"), of("EXPECTED", "MISSING").alias("expected_missing"),
        of("OPTIONAL", "PRESENT").alias("optional_present"), F.count_if(state == "CONFLICTED").alias("conflicted"),
        F.count_if(state == "PARTIAL").alias("partial"),
    )
    status = (
        F.when(F.col("applicable") == 0, "UNKNOWN")
        .when((F.col("required_missing") > 0) & (F.col("required_present") == 0), "INSUFFICIENT")
        .when((F.col("required_missing") > 0) | (F.col("conflicted") > 0), "PARTIAL")
        .when(F.col("expected_missing") > 0, "SUBSTANTIALLY_COMPLETE").otherwise("COMPLETE")
    )
    return agg.withColumn("overall_status", status)
