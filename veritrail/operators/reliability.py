"""Reliability of facts in seven dimensions, and of payments as the worst of their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import vocab as V
from veritrail.functions.skew import meet, shuffled
from veritrail.operators.facts import fact_hash, fact_keys, keys_of


def fact_support(rows: DataFrame) -> DataFrame:
    """What each fact's observations say; extremes stand for 'more than one'.

    Decisions recorded on a fact are its SAME_FACT pairs: two observations within reach. Time is cut into slots as long
    as that reach, so two in one slot are a pair, and of two neighbouring slots the last and the first time decide. Each
    observation counts in its slot and shows its time to the next one; nothing is put in order.
    """
    src, at, reach = F.col("source_type"), F.col("observed_us"), F.lit(V.RECONCILIATION_WINDOW_US)
    keys = fact_keys(rows)
    said = rows.select(
        *keys, at.alias("t"), (at - F.pmod(at, reach)).alias("slot"), (src.isNull() | src.isin(*V.PROVIDER_SOURCES)).alias("provider"),
        F.coalesce(F.lower(src).contains("api") | F.lower(src).contains("internal"), F.lit(False)).alias("internal"),
        F.coalesce(src == "UNKNOWN", F.lit(False)).alias("unknown"), F.col("webhook_event_id").alias("w"),
        # extremes of a 64-bit hash keep the aggregate hash-based where strings would force a sort
        F.xxhash64("source_type").alias("s"), F.coalesce(F.col("valid_until_us") < at, F.lit(False)).alias("inverted"))
    own = F.col("own")
    of = lambda c: F.when(own, F.col(c))
    shown = said.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    slots = shown.groupBy(*keys, F.when(own, F.col("slot")).otherwise(F.col("slot") + reach).alias("slot")).agg(
        F.count_if(own).alias("n"), F.every(of("provider")).alias("all_provider"), F.some(of("internal")).alias("any_internal"),
        F.some(of("unknown")).alias("any_unknown"), F.count(of("w")).alias("n_linked"), F.min(of("w")).alias("w0"), F.max(of("w")).alias("w1"),
        F.min(of("s")).alias("s0"), F.max(of("s")).alias("s1"), F.some(of("inverted")).alias("inverted"),
        F.min(of("t")).alias("first_us"), F.max(F.when(~own, F.col("t"))).alias("before_us")).where("n > 0")
    near = F.col("slot").isNotNull() & ((F.col("n") > 1) | F.coalesce(F.col("first_us") - F.col("before_us") <= reach, F.lit(False)))
    return slots.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.every("all_provider").alias("all_provider"), F.some("any_internal").alias("any_internal"),
        F.some("any_unknown").alias("any_unknown"), F.sum("n_linked").alias("n_linked"), F.min("w0").alias("w0"), F.max("w1").alias("w1"),
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.some("inverted").alias("inverted"), F.min("first_us").alias("first_us"),
        F.some(near).alias("has_pair"),
    ).where("first_us IS NOT NULL").withColumn("fact_hash", fact_hash())


def fact_reliability(rows: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """`open_conflicts`: payment_id, n (all open conflicts, informational ones included)."""
    support = fact_support(rows)
    if "eval_us" in rows.columns:  # the few times of a payment are one row, so that facts are joined by payment, where they lie
        times = open_conflicts.groupBy("payment_id").agg(F.map_from_entries(F.collect_list(F.struct("eval_us", "n"))).alias("open_at"))
        j = support.join(shuffled(times), "payment_id", "left").withColumn("open_n", F.col("open_at")[F.col("eval_us")])
    else:
        j = support.join(open_conflicts.select("payment_id", F.col("n").alias("open_n")), "payment_id", "left")
    n = F.col("n")
    multi_src, multi_ev = F.col("s0") != F.col("s1"), F.col("w0") != F.col("w1")
    d = j.select(
        *fact_keys(rows), "fact_hash", n.alias("observation_count"),
        F.when(F.col("all_provider"), "VERIFIED_PROVIDER_SOURCE").when(F.col("any_internal"), "VERIFIED_INTERNAL_SOURCE")
        .when(F.col("any_unknown"), "UNKNOWN_SOURCE").otherwise("UNVERIFIED_SOURCE").alias("source_state"),
        F.when(F.col("n_linked") == n, "COMPLETE").when(F.col("n_linked") > 0, "PARTIAL").otherwise("BROKEN")
        .alias("provenance_state"),
        F.when(F.col("has_pair"), "SAME_FACT_DIFFERENT_SOURCE").otherwise("SAME_PROVIDER_EVENT").alias("identity_state"),
        F.when(F.col("inverted"), "TEMPORALLY_AMBIGUOUS").otherwise("TEMPORALLY_SOUND").alias("temporal_state"),
        F.when(F.trim("canonical_value") != "", "CANONICAL_FACT").otherwise("MALFORMED").alias("structural_state"),
        F.when(F.coalesce("open_n", F.lit(0)) > 0, "CONFLICTED").otherwise("UNCONTRADICTED").alias("contradiction_state"),
        F.when(F.coalesce(multi_src & multi_ev, F.lit(False)), "INDEPENDENT_CORROBORATION")
        .when((n > 1) & (F.col("n_linked") > 0) & ~F.coalesce(multi_ev, F.lit(False)), "DEPENDENT_REPLICATION")
        .when(n == 1, "SINGLE_SOURCE").otherwise("UNKNOWN").alias("dependency_state"),
    )
    return d.withColumn("overall_state", overall_state()).withColumn("factors", factors()).withColumn(
        "ceiling", ceiling())


_RULES = (
    ("UNRELIABLE", "FLOOR_UNRELIABLE", lambda: (F.col("structural_state") == "MALFORMED") | (F.col("temporal_state") == "TEMPORALLY_INVALID")),
    ("LIMITED", "CEILING_LIMITED:provenance", lambda: F.col("provenance_state") == "BROKEN"),
    ("LIMITED", "CEILING_LIMITED:contradiction", lambda: F.col("contradiction_state") == "CONFLICTED"),
    ("LIMITED", "CEILING_LIMITED:identity", lambda: F.col("identity_state").isin("TEMPORAL_AMBIGUITY", "INSUFFICIENT_INFORMATION")),
    ("UNKNOWN", "CEILING_UNKNOWN", lambda: (F.col("source_state") == "UNKNOWN_SOURCE") | (F.col("identity_state") == "UNKNOWN")),
    ("LIMITED", "CEILING_LIMITED:source", lambda: F.col("source_state") == "UNVERIFIED_SOURCE"),
    ("MODERATE", "CEILING_MODERATE", lambda: (F.col("provenance_state") == "PARTIAL")
     | (F.col("dependency_state") == "DEPENDENT_REPLICATION") | (F.col("structural_state") == "PARTIAL_OBSERVATION")),
)


def _chain(pick: int, after: Column) -> Column:
    out = None
    for rule in _RULES:
        cond = rule[2]()
        out = F.when(cond, rule[pick]) if out is None else out.when(cond, rule[pick])
    return out.otherwise(after)


def overall_state() -> Column:
    high = (
        (F.col("source_state") == "VERIFIED_PROVIDER_SOURCE") & (F.col("provenance_state") == "COMPLETE")
        & F.col("identity_state").isin("SAME_PROVIDER_EVENT", "SAME_FACT_DIFFERENT_SOURCE")
        & (F.col("temporal_state") == "TEMPORALLY_SOUND") & (F.col("contradiction_state") == "UNCONTRADICTED")
        & (F.col("structural_state") == "CANONICAL_FACT")
    )
    return _chain(0, F.when(high, "HIGH").otherwise("MODERATE"))


def ceiling() -> Column:
    return _chain(1, F.lit(None).cast("string"))


def factors() -> Column:
    """Degradations in dimension order."""
    return E.text_list(E.parts(
        F.when(F.col("source_state").isin("UNKNOWN_SOURCE", "UNVERIFIED_SOURCE"), "source"),
        F.when(F.col("provenance_state") != "COMPLETE", "provenance"),
        F.when(F.col("temporal_state") == "TEMPORALLY_AMBIGUOUS", "temporal"),
        F.when(F.col("structural_state") != "CANONICAL_FACT", "structure"),
        F.when(F.col("contradiction_state") == "CONFLICTED", "contradiction"),
        F.when(F.col("dependency_state") == "DEPENDENT_REPLICATION", "dependency"),
    ))


def payment_reliability(assessed: DataFrame, payments: DataFrame) -> DataFrame:
    s = F.col("overall_state")
    key = keys_of(assessed)
    agg = assessed.groupBy(*key).agg(
        F.count("*").alias("facts_assessed"),
        *[F.count_if(s == x).alias(x) for x in ("UNRELIABLE", "LIMITED", "UNKNOWN", "HIGH")],
    )
    j = meet(key, payments.select(*key, F.lit(True).alias("known")), agg)
    n = F.coalesce("facts_assessed", F.lit(0).cast("bigint"))
    return j.select(
        *key, n.alias("facts_assessed"),
        F.when(n == 0, F.when(F.col("known"), "LIMITED").otherwise("UNKNOWN"))
        .when(F.col("UNRELIABLE") > 0, "UNRELIABLE").when(F.col("LIMITED") > 0, "LIMITED")
        .when(F.col("UNKNOWN") > 0, "UNKNOWN").when(F.col("HIGH") == n, "HIGH").otherwise("MODERATE")
        .alias("overall_state"),
    )


def uncertainty(assessed: DataFrame) -> DataFrame:
    """Distinct uncertainty statements per payment, from flags aggregated over its facts."""
    flags = assessed.groupBy("payment_id").agg(
        F.some(F.col("source_state") == "VERIFIED_PROVIDER_SOURCE").alias("src"),
        F.some(F.col("provenance_state") == "COMPLETE").alias("prov"),
        F.some(F.col("contradiction_state") == "CONFLICTED").alias("conf"),
        F.some(F.col("dependency_state").isin("SINGLE_SOURCE", "DEPENDENT_REPLICATION")).alias("dep"),
        F.some(F.col("structural_state") == "CANONICAL_FACT").alias("struct"),
    )
    item = lambda cond, kind, topic: F.when(cond, F.struct(F.lit(kind).alias("boundary_type"), F.lit(topic).alias("topic")))
    items = E.parts(
        item(F.col("src"), "ESTABLISHED", "Source Authenticity"), item(F.col("prov"), "ESTABLISHED", "Lineage Chain"),
        item(F.col("conf"), "CONTRADICTED", "Consistency Conflict"),
        item(F.col("dep"), "UNCERTAIN", "Independent Corroboration"),
        item(F.col("struct"), "SUPPORTED", "Canonical Data Structure"),
        item(~F.col("dep"), "UNCERTAIN", "External Settlement"),
    )
    return flags.select("payment_id", F.explode(items).alias("u")).select("payment_id", "u.*")
