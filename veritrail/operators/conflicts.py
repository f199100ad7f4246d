"""Contradictions among the claims of one payment.

Status claims come from a closed vocabulary, so a payment has a handful of them and their pairs
are listed. Amounts, currencies and order ids are open-ended: d distinct values of one attribute
contradict each other pairwise, which is one *conflict set* of d members standing for d(d-1)/2
conflicts. Sets are kept as members plus counts; the partners of a chosen claim are listed by
`partners_of`, so the size of every result follows the data, never its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import normal_state, pairs_of, transition_between
from veritrail.functions.skew import shuffled
from veritrail.sources.driver_tables import lookup

_SET_TYPES = ("PAYMENT_AMOUNT", "PAYMENT_CURRENCY", "ORDER_ASSOCIATION")


def _status_pairs(points: Column) -> Column:
    """Classified pairs of an ordered array of (earliest, claim_id, value) status points.

    Built in steps - pair, transition, verdict - so that each lambda stays small.
    """
    N = F.named_struct
    named = F.transform(points, lambda p: N(
        F.lit("t"), p["earliest_us"], F.lit("id"), p["claim_id"], F.lit("v"), p["value"], F.lit("s"), normal_state(p["value"])))

    def pair(a, b):
        return N(F.lit("a"), a, F.lit("b"), b, F.lit("step"), transition_between(a["s"], b["s"]))

    pairs = F.flatten(F.transform(named, lambda a, i: F.transform(
        F.slice(named, i + F.lit(2), F.size(named)), lambda b: pair(a, b))))

    def verdict(p):
        near = F.abs(p["b"]["t"] - p["a"]["t"]) <= V.CLOCK_TOLERANCE_US
        kind = (
            F.when(p["step"] == "CONTRADICTORY_TERMINAL", "STATE_CONFLICT").when(near, "ORDERING_AMBIGUITY")
            .when(p["step"] == "INVALID_BACKWARD", "TEMPORAL_CONFLICT"))
        return N(
            F.lit("claim_a_id"), F.least(p["a"]["id"], p["b"]["id"]), F.lit("claim_b_id"), F.greatest(p["a"]["id"], p["b"]["id"]),
            F.lit("from_value"), p["a"]["v"], F.lit("to_value"), p["b"]["v"], F.lit("delta_us"), p["b"]["t"] - p["a"]["t"],
            F.lit("since_us"), p["b"]["t"], F.lit("transition_type"), p["step"], F.lit("conflict_type"), kind)

    return F.filter(F.transform(pairs, verdict), lambda c: c["conflict_type"].isNotNull())


SEVERITY = {"STATE_CONFLICT": "HIGH", "ORDERING_AMBIGUITY": "INFO", "TEMPORAL_CONFLICT": "MEDIUM"}


def status_points(claims: DataFrame, *more: Column) -> DataFrame:
    is_status = (F.col("claim_type") == "PAYMENT_STATUS") & (F.col("claim_key") == "STATUS")
    point = F.struct("earliest_us", "claim_id", F.col("canonical_value").alias("value"))
    keys = [k for k in ("payment_id", "eval_us") if k in claims.columns]
    return claims.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(is_status, point))).alias("points"), *more
    )


def status_conflicts(payment_claims: DataFrame) -> DataFrame:
    only = payment_claims.filter((F.col("claim_type") == "PAYMENT_STATUS") & (F.col("claim_key") == "STATUS"))
    return (
        status_points(only).filter(F.size("points") > 1)
        .select("payment_id", F.explode(_status_pairs(F.col("points"))).alias("c"))
        .select("payment_id", "c.*", F.lit("OPEN").alias("status"), F.lit(V.CONFLICT_RULE_VERSION).alias("rule_version"))
        .withColumn("severity", lookup("conflict_type", SEVERITY)).drop("since_us")
    )


def status_conflict_times(payment_claims: DataFrame) -> DataFrame:
    """payment_id, conflict_type, at_us: when each conflict between two statuses came to be, its later one's first time."""
    only = payment_claims.filter((F.col("claim_type") == "PAYMENT_STATUS") & (F.col("claim_key") == "STATUS"))
    return status_points(only).filter(F.size("points") > 1).select("payment_id", F.explode(_status_pairs(F.col("points"))).alias("c")).select(
        "payment_id", "c.conflict_type", F.col("c.since_us").alias("at_us"))


def conflict_sets(payment_claims: DataFrame, claim_types=_SET_TYPES) -> DataFrame:
    """One row per (payment, attribute) with more than one distinct value."""
    return (
        payment_claims.filter(F.col("claim_type").isin(*claim_types))
        .groupBy("payment_id", "claim_type")
        .agg(F.count("*").alias("set_size"), F.min("claim_id").alias("set_anchor"))
        .filter("set_size > 1")
        .select(
            "payment_id", "claim_type", "set_size", "set_anchor",
            pairs_of(F.col("set_size")).alias("conflict_count"),
            F.when(F.col("claim_type") == "ORDER_ASSOCIATION", "RELATIONSHIP_CONFLICT").otherwise("VALUE_CONFLICT")
            .alias("conflict_type"),
            F.lit("HIGH").alias("severity"), F.lit("OPEN").alias("status"),
        )
    )


def conflict_members(payment_claims: DataFrame, claim_types=_SET_TYPES) -> DataFrame:
    """Each contradicted value with how many other values of the payment it contradicts."""
    # a payment has a handful of sets: one row a payment, so that claims are joined by payment, where they lie
    sets = conflict_sets(payment_claims, claim_types).groupBy("payment_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "claim_type", F.struct("set_size", "set_anchor", "conflict_type", "severity", "status")))).alias("sets"))
    return payment_claims.filter(F.col("claim_type").isin(*claim_types)).join(shuffled(sets), "payment_id").withColumn(
        "s", F.col("sets")[F.col("claim_type")]).where("s IS NOT NULL").select(
        "payment_id", "claim_id", "claim_type", "canonical_value", "earliest_us", "observation_count",
        "s.conflict_type", "s.severity", "s.status", (F.col("s.set_size") - 1).alias("conflicts_with"), "s.set_anchor",
    )


def partners_of(payment_claims: DataFrame, chosen: DataFrame) -> DataFrame:
    """The individual conflicts of chosen claims (payment_id, claim_id): one row per partner."""
    mine = payment_claims.join(chosen.select("payment_id", "claim_id"), ["payment_id", "claim_id"]).filter(
        F.col("claim_type").isin(*_SET_TYPES)
    ).select("payment_id", "claim_type", F.col("claim_id").alias("mine"), F.col("canonical_value").alias("v"))
    other = payment_claims.select("payment_id", "claim_type", "claim_id", "canonical_value")
    return mine.join(other, ["payment_id", "claim_type"]).filter(F.col("v") != F.col("canonical_value")).select(
        "payment_id", F.least("mine", "claim_id").alias("claim_a_id"),
        F.greatest("mine", "claim_id").alias("claim_b_id"), "claim_type",
    ).distinct()


_COUNTERS = ("claim_count", "multi_observation_claims", "multi_source_claims", *[f"n_{t}" for t in _SET_TYPES])


def _support(n: Column, sources: Column, prefix: str = "") -> list[Column]:
    """The counters of claims with at least one observation, of n observations from so many sources."""
    found = [n > 0, n >= 2, sources >= 2, *[(n > 0) & (F.col("claim_type") == t) for t in _SET_TYPES]]
    return [F.count_if(c).alias(prefix + name) for name, c in zip(_COUNTERS, found)]


def conflict_profile(payment_claims: DataFrame) -> DataFrame:
    """Conflict and corroboration counters per payment in a single aggregation of the claims."""
    return _profile(status_points(payment_claims, *_support(F.col("observation_count"), F.col("n_sources"))))


def conflict_profile_at(claims: DataFrame, points) -> DataFrame:
    """The same at each of a few times (eval_us), from `structure.claims_through` those times.

    A claim's first time is the same whenever it is visible, so its row is moved once and not once a time.
    """
    agg = status_points(claims, *[c for i in range(len(points)) for c in _support(F.col(f"n_{i}"), F.col(f"s_{i}"), f"at{i}_")])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("eval_us"), *[F.col(f"at{i}_{c}").alias(c) for c in _COUNTERS]) for i, p in enumerate(points)]))
    rows = agg.select("payment_id", "points", each.alias("x")).select("payment_id", "points", "x.*").where("claim_count > 0")
    return _profile(rows.withColumn("points", F.filter("points", lambda p: p["earliest_us"] <= F.col("eval_us"))))


def _profile(agg: DataFrame) -> DataFrame:
    pairs = _status_pairs(F.col("points"))
    n_of = lambda name: F.size(F.filter("pairs", lambda c: c["conflict_type"] == name)).cast("bigint")
    keys = [k for k in ("payment_id", "eval_us") if k in agg.columns]
    return agg.withColumn("pairs", pairs).select(
        *keys, "claim_count", "multi_observation_claims", "multi_source_claims",
        n_of("STATE_CONFLICT").alias("state_conflicts"),
        n_of("TEMPORAL_CONFLICT").alias("temporal_conflicts"),
        n_of("ORDERING_AMBIGUITY").alias("ordering_ambiguities"),
        (pairs_of(F.col("n_PAYMENT_AMOUNT")) + pairs_of(F.col("n_PAYMENT_CURRENCY"))).alias("value_conflicts"),
        pairs_of(F.col("n_ORDER_ASSOCIATION")).alias("relationship_conflicts"),
    ).select(
        "*",
        F.expr("state_conflicts + temporal_conflicts + value_conflicts + relationship_conflicts")
        .alias("open_conflict_count"),
        F.expr("state_conflicts + temporal_conflicts + value_conflicts + relationship_conflicts"
               " + ordering_ambiguities").alias("conflict_count"),
    )
