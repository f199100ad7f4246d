"""Gated integrity of all payments at one or several evaluation times.

Two aggregations carry everything: one over the observations (quality counts, sources, events),
one over the claims (corroboration and conflicts). They meet in a single join on payment_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import vocab as V
from veritrail.functions.skew import meet
from veritrail.operators.conflicts import conflict_profile

KEY = ["payment_id", "eval_us"]


def evidence_profile(scoped: DataFrame, points) -> DataFrame:
    """Quality and structure counters per (payment, evaluation time).

    `scoped` is structure scope (payment observations plus provenance-linked order ones). The few evaluation times are
    columns of one pass. Each observation counts once for its source, with the counters, and once for its event, with
    its time; sources and events of a payment are then rows, so distinct ones are counted without copies of the rows.
    """
    end, observed = F.col("valid_until_us"), F.col("observed_us")
    # of each time: whether the observation is visible, usable, and how fresh
    at = {f"_{i}": F.lit(p) for i, p in enumerate(points)}
    rows = scoped.where(observed.isNotNull()).select(
        "payment_id", "payment_event_id", "source_type", "observed_us", E.authority(F.col("source_type")).alias("auth"),
        E.directness(F.col("source_type"), F.col("evidence_type")).alias("direct"),
        *[(observed <= t).alias(f"seen{i}") for i, t in at.items()],
        *[((observed <= t) & (F.col("subject_type") == "payment") & (end.isNull() | (end > t))).alias(f"used{i}") for i, t in at.items()],
        *[E.freshness_state(observed, t).alias(f"fresh{i}") for i, t in at.items()],
    ).withColumn("by_source", F.explode(F.array(F.lit(True), F.lit(False))))
    of = F.col("by_source")

    def counters(i):
        count = lambda cond: F.count_if(of & F.col(f"used{i}") & cond)
        fresh, auth = F.col(f"fresh{i}"), F.col("auth")
        return {
            "total": F.count_if(of & F.col(f"seen{i}")), "evidence": count(F.lit(True)),
            "current": count(fresh == "CURRENT"), "aging": count(fresh == "AGING"), "stale": count(fresh == "STALE"),
            "primary": count(auth == "PRIMARY"), "secondary": count(auth == "SECONDARY"), "tertiary": count(auth == "TERTIARY"),
            "direct": count(F.col("direct") == "DIRECT")}

    cells = rows.groupBy("payment_id", "by_source", F.when(of, F.col("source_type")).alias("source_type"),
                         F.when(~of, F.col("payment_event_id")).alias("payment_event_id")).agg(
        F.min("observed_us").alias("first_us"), *[c.alias(n + i) for i in at for n, c in counters(i).items()])
    source, sums = F.col("source_type").isNotNull(), list(counters("_0"))
    per = cells.groupBy("payment_id").agg(*[x for i, t in at.items() for x in (
        *[F.sum(n + i).alias(n + i) for n in sums],
        F.count_if(source & (F.col(f"evidence{i}") > 0)).alias(f"sources{i}"), F.count_if(source & (F.col(f"total{i}") > 0)).alias(f"seen_sources{i}"),
        F.count_if(F.col("payment_event_id").isNotNull() & (F.col("first_us") <= t)).alias(f"events{i}"))])
    each = F.explode(F.array(*[F.struct(
        t.alias("eval_us"), *[F.col(n + i).alias(f"{n}_count") for n in sums], F.col(f"sources{i}").alias("source_count"),
        F.greatest(f"seen_sources{i}", F.lit(1)).alias("distinct_sources"), F.greatest(f"events{i}", F.lit(1)).alias("distinct_events"))
        for i, t in at.items()])).alias("x")
    return per.select("payment_id", each).select("payment_id", "x.*").where("total_count > 0")


def freshness_dimension() -> Column:
    n = F.col("evidence_count")
    return (
        F.when(n == 0, "UNKNOWN").when(F.col("stale_count") > 0, "LIMITED")
        .when(F.col("current_count") + F.col("aging_count") == n, "STRONG").otherwise("LIMITED")
    )


def source_dimension() -> Column:
    n = F.col("evidence_count")
    return (
        F.when(n == 0, "UNKNOWN").when(F.col("tertiary_count") > 0, "WEAK")
        .when((F.col("primary_count") == n) & (F.col("direct_count") == n), "STRONG").otherwise("LIMITED")
    )


def independence_dimension() -> Column:
    s, e = F.col("distinct_sources") >= 2, F.col("distinct_events") >= 2
    return (
        F.when(F.col("total_count") == 0, "UNKNOWN").when(s & e, "HIGH_SOURCE_DIVERSITY")
        .when(s | e, "LIMITED_SOURCE_DIVERSITY").otherwise("SINGLE_SOURCE")
    )


def corroboration_dimension() -> Column:
    return (
        F.when(F.col("claim_count") == 0, "UNKNOWN").when(F.col("multi_source_claims") > 0, "STRONGLY_CORROBORATED")
        .when(F.col("multi_observation_claims") > 0, "PARTIALLY_CORROBORATED").otherwise("SINGLE_OBSERVATION")
    )


def consistency_dimension() -> Column:
    """UNRESOLVED conflicts only occur when the conflicts are given as input with that status."""
    return (
        F.when(F.col("conflict_count") == 0, "NO_DETECTED_CONFLICT")
        .when(F.col("unresolved_count") > 0, "UNRESOLVABLE")
        .when(F.col("open_conflict_count") > 0, "HAS_OPEN_CONFLICTS").otherwise("ORDERING_AMBIGUITY_ONLY")
    )


def gate_conditions() -> list[Column]:
    """The six gates in order; the first that holds decides."""
    fr, so, co = F.col("freshness"), F.col("source"), F.col("consistency")
    return [
        F.col("evidence_count") == 0,
        F.col("open_conflict_count") > 0,
        fr.isin("UNKNOWN", "STALE") | (so == "WEAK"),
        (fr == "STRONG") & (so == "STRONG") & (F.col("independence") == "HIGH_SOURCE_DIVERSITY")
        & (F.col("corroboration") == "STRONGLY_CORROBORATED") & (co == "NO_DETECTED_CONFLICT")
        & (F.col("evidence_count") >= 2),
        fr.isin("STRONG", "LIMITED") & so.isin("STRONG", "LIMITED")
        & co.isin("NO_DETECTED_CONFLICT", "ORDERING_AMBIGUITY_ONLY"),
        F.lit(True),
    ]


def overall() -> Column:
    out = None
    for cond, gate in zip(gate_conditions(), V.GATES):
        out = F.when(cond, gate) if out is None else out.when(cond, gate)
    return out


def dimensions(scoped: DataFrame, payment_claims: DataFrame | None, points, profile: DataFrame | None = None) -> DataFrame:
    """Five dimension statuses with their counts per (payment, evaluation time).

    Corroboration and conflicts are those of the payment as a whole; pass claims built from
    observations before the evaluation time for a strict point-in-time result. `profile`: the conflict profile
    of the claims, where it is at hand.
    """
    quality = evidence_profile(scoped, points)
    claims = conflict_profile(payment_claims) if profile is None else profile
    every = claims if "eval_us" in claims.columns else claims.withColumn(
        "eval_us", F.explode(F.array(*[F.lit(p) for p in points])))
    counters = [c for c in [*quality.columns, *every.columns, "unresolved_count"] if c not in KEY]
    j = meet(KEY, quality, every).withColumn("unresolved_count", F.lit(0).cast("bigint"))
    return with_dimensions(j.select(*KEY, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counters]))


def with_dimensions(counters: DataFrame) -> DataFrame:
    return counters.select(
        "*", freshness_dimension().alias("freshness"), source_dimension().alias("source"),
        independence_dimension().alias("independence"), corroboration_dimension().alias("corroboration"),
        consistency_dimension().alias("consistency"),
    )


def integrity(dims: DataFrame) -> DataFrame:
    return dims.withColumn("overall_status", overall())


def explanation() -> Column:
    c = lambda name: F.col(name).cast("string")
    return E.text_list(E.parts(
        F.when(F.col("freshness") == "STRONG", "recently observed")
        .when((F.col("freshness") == "LIMITED") & (F.col("stale_count") > 0), F.concat(c("stale_count"), F.lit(" stale")))
        .when(F.col("freshness") == "UNKNOWN", "freshness unknown"),
        F.when(F.col("source") == "STRONG", "primary direct source").when(F.col("source") == "LIMITED", "secondary or derived source")
        .when(F.col("source") == "WEAK", "tertiary source present"),
        F.when(F.col("corroboration") == "STRONGLY_CORROBORATED", F.concat(c("multi_source_claims"), F.lit(" claims from several sources")))
        .when(F.col("corroboration") == "PARTIALLY_CORROBORATED", "repeated by one source")
        .when(F.col("corroboration") == "SINGLE_OBSERVATION", "each claim observed once"),
        F.when(F.col("consistency") == "NO_DETECTED_CONFLICT", "no conflict detected")
        .when(F.col("consistency") == "ORDERING_AMBIGUITY_ONLY", "ordering ambiguity only")
        .when(F.col("consistency") == "HAS_OPEN_CONFLICTS", F.concat(c("open_conflict_count"), F.lit(" open conflicts")))
        .when(F.col("consistency") == "UNRESOLVABLE", "unresolvable conflict"),
        F.when(F.col("independence") == "SINGLE_SOURCE", "single event")
        .when(F.col("independence") == "LIMITED_SOURCE_DIVERSITY", "limited source diversity")
        .when(F.col("independence") == "UNKNOWN", "diversity not assessed"),
    ))


def limitations() -> Column:
    return E.text_list(E.parts(
        F.lit("no outcome history"),
        F.when(F.col("independence").isin("SINGLE_SOURCE", "LIMITED_SOURCE_DIVERSITY"), F.concat(
            F.lit("limited diversity: "), F.col("distinct_sources").cast("string"), F.lit(" sources, "),
            F.col("distinct_events").cast("string"), F.lit(" events"))),
        F.when(F.col("corroboration") == "UNKNOWN", "corroboration not assessed")
        .when(F.col("corroboration") == "SINGLE_OBSERVATION", "no independent corroboration"),
        F.when(F.col("independence") == "UNKNOWN", "independence not assessed"),
    ))


def gate_log(dims: DataFrame) -> DataFrame:
    """The gates that were evaluated per payment, in order, up to the one that fired."""
    conds = gate_conditions()
    gates = F.array(*[
        F.struct(F.lit(i + 1).cast("bigint").alias("execution_order"), F.lit(f"{V.METHODOLOGY}.{g}").alias("rule_id"),
                 F.coalesce(c, F.lit(False)).alias("fired"))
        for i, (c, g) in enumerate(zip(conds, V.GATES))
    ])
    first = F.array_position(F.transform(F.col("gates"), lambda g: g["fired"]), True)
    return dims.withColumn("gates", gates).select(
        *KEY, F.explode(F.slice("gates", F.lit(1), first.cast("int"))).alias("g")).select(*KEY, "g.*")
