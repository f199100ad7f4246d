"""Claims, groups, corroboration and the per-payment structure of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import key_hash
from veritrail.functions.skew import meet
from veritrail.operators.canonical import slot_values
from veritrail.sources.driver_tables import lookup

CLAIM_KEYS = ["subject_type", "subject_id", "claim_type", "claim_key", "canonical_value"]


def supports_claim() -> Column:
    """Whether an observation supports a proposition; blank values support none."""
    return F.col("value").isNotNull() & (F.col("value") != "") & lookup("evidence_type", {t: c[2] for t, c in V.CLAIM_OF.items()}).isNotNull()


def claim_parts() -> list[Column]:
    """claim_type, claim_key and canonical_value of an observation."""
    etype, value = "evidence_type", F.trim("value")
    how = lookup(etype, {t: c[2] for t, c in V.CLAIM_OF.items()})
    return [
        lookup(etype, {t: c[0] for t, c in V.CLAIM_OF.items()}).alias("claim_type"),
        lookup(etype, {t: c[1] for t, c in V.CLAIM_OF.items()}).alias("claim_key"),
        F.when(how == "lower", F.lower(value)).when(how == "upper", F.upper(value)).otherwise(value)
        .alias("canonical_value")]


def claim_rows(observations: DataFrame) -> DataFrame:
    """Each observation with the proposition it supports."""
    owner = [c for c in ("payment_id", "eval_us") if c in observations.columns]
    return observations.filter(supports_claim()).select(
        *owner, "subject_type", "subject_id", *claim_parts(),
        "evidence_id", "source_type", "source_reference", "payment_event_id", "webhook_event_id", "observed_us",
    ).withColumn("claim_id", key_hash(*[F.col(c) for c in CLAIM_KEYS]))


def build_claims(rows: DataFrame) -> DataFrame:
    """One row per proposition with its support; extremes stand in for 'more than one' tests."""
    keys = [*(["eval_us"] if "eval_us" in rows.columns else []), *CLAIM_KEYS]
    event, webhook = F.col("payment_event_id"), F.col("webhook_event_id")
    # an observation counts once for its source, with the counters, and once for its event and for its webhook; these are then
    # rows, so that distinct ones are counted without copies of the rows for each count
    kinds = rows.withColumn("kind", F.explode(F.array(F.lit("s"), F.when(event.isNotNull(), "e"), F.when(webhook.isNotNull(), "w")))).where("kind IS NOT NULL")
    is_ = lambda k: F.col("kind") == k
    cells = kinds.groupBy(
        *keys, "kind", F.when(is_("s"), F.col("source_type")).alias("source_type"), F.when(is_("e"), event).when(is_("w"), webhook).alias("id")).agg(
        F.count("*").alias("n"), F.min("observed_us").alias("t0"), F.max("observed_us").alias("t1"))
    return cells.groupBy(*keys).agg(
        F.sum(F.when(is_("s"), F.col("n"))).alias("observation_count"), F.count("source_type").alias("n_sources"),
        F.count_if(is_("e")).alias("n_events"), F.count_if(is_("w")).alias("n_webhooks"),
        F.min("t0").alias("earliest_us"), F.max("t1").alias("latest_us"),
    ).withColumn("claim_id", key_hash(*[F.col(c) for c in CLAIM_KEYS]))


def claims_through(rows: DataFrame, points) -> DataFrame:
    """Claims of payments with their support as it was at each of a few times: n_0, s_0, n_1, ... are the observations and sources by then.

    A claim whose observations came after all the times has n of 0 in all.
    """
    by = {i: F.col("observed_us") <= F.lit(p) for i, p in enumerate(points)}
    per_source = rows.filter(F.col("subject_type") == "payment").groupBy(*CLAIM_KEYS, "source_type").agg(
        F.min("observed_us").alias("earliest_us"), *[F.count_if(c).alias(f"n_{i}") for i, c in by.items()])
    claims = per_source.groupBy(*CLAIM_KEYS).agg(
        F.min("earliest_us").alias("earliest_us"), *[F.sum(f"n_{i}").alias(f"n_{i}") for i in by],
        *[F.count_if(F.col("source_type").isNotNull() & (F.col(f"n_{i}") > 0)).alias(f"s_{i}") for i in by])
    return payment_claims(claims.withColumn("claim_id", key_hash(*[F.col(c) for c in CLAIM_KEYS])))


def payment_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("subject_type") == "payment").withColumnRenamed("subject_id", "payment_id")


def corroboration(claims: DataFrame) -> DataFrame:
    n = F.col("observation_count")
    sources = F.greatest(F.col("n_sources"), F.lit(1))
    events = (
        F.when(F.col("n_events") > 0, F.col("n_events")).when(F.col("n_webhooks") > 0, F.col("n_webhooks"))
        .otherwise(1)
    )
    spread = (F.col("earliest_us") < F.col("latest_us")) & (F.col("n_webhooks") > 1)
    kind = (
        F.when(n <= 1, "SINGLE_OBSERVATION").when(sources > 1, "MULTI_SOURCE_CORROBORATION")
        .when((events > 1) | spread, "TEMPORAL_CORROBORATION").otherwise("SAME_SOURCE_CORROBORATION")
    )
    return claims.select(
        "*", sources.alias("distinct_sources_count"), events.alias("distinct_events_count"),
        kind.alias("corroboration_type"),
    ).withColumn(
        "independence_status",
        lookup("corroboration_type", {
            "SINGLE_OBSERVATION": "UNKNOWN", "MULTI_SOURCE_CORROBORATION": "INDEPENDENT_CANDIDATE",
            "TEMPORAL_CORROBORATION": "DEPENDENT", "SAME_SOURCE_CORROBORATION": "SAME_SOURCE",
        }),
    )


def evidence_groups(payment_obs: DataFrame) -> DataFrame:
    """Member counts of the three structural groupings, in one pass over the observations."""
    def g(kind, prefix, col):
        return F.when(
            F.col(col).isNotNull(),
            F.struct(F.lit(kind).alias("group_type"),
                     F.concat(F.lit(prefix), F.col(col).cast("string")).alias("grouping_key")),
        )
    groups = F.array_compact(F.array(
        g("SAME_PAYMENT_EVENT", "payment_event_", "payment_event_id"),
        g("SAME_WEBHOOK_EVENT", "webhook_event_", "webhook_event_id"),
        g("SAME_SOURCE", "source_", "source_type"),
    ))
    return (
        payment_obs.select("payment_id", F.explode(groups).alias("g"))
        .groupBy("payment_id", "g.group_type", "g.grouping_key").agg(F.count("*").alias("member_count"))
    )


def structure_scope(observations: DataFrame) -> DataFrame:
    """Payment observations plus order observations whose provenance names a payment."""
    owner = F.when(F.col("subject_type") == "payment", F.col("subject_id")).otherwise(
        F.get_json_object("provenance", "$.payment_id")
    )
    return observations.withColumn("payment_id", owner).filter(F.col("payment_id").isNotNull())


def structure_snapshot(scoped: DataFrame) -> DataFrame:
    """Totals, concentration and corroboration per payment.

    Each observation counts once for its event, its webhook and its source, in one pass; these groups are then rows, so
    distinct ones are counted on a fraction of the rows and a hot payment is split before it is combined.
    """
    event, kind, n = F.col("payment_event_id"), F.col("kind"), F.col("n")
    is_ = lambda k: kind == k
    kinds = scoped.select("payment_id", "payment_event_id", "webhook_event_id", "source_type").withColumn(
        "kind", F.explode(F.array(*[F.lit(k) for k in "ews"])))
    cells = kinds.groupBy(
        "payment_id", "kind", F.when(is_("e"), F.coalesce(event, F.lit(0))).when(is_("w"), F.col("webhook_event_id")).alias("id"),
        F.when(is_("s"), F.col("source_type")).alias("source_type"),
    ).agg(F.count("*").alias("n"), F.max(F.when(is_("e"), event)).alias("real_event"))
    of = lambda k, c=n: F.when(is_(k), c)
    real = is_("e") & F.col("real_event").isNotNull()
    joined = cells.groupBy("payment_id").agg(
        F.sum(of("e")).alias("total_observations"), F.count_if(real).alias("n_events"), F.max(F.when(real, n)).alias("largest_event"),
        F.sum(of("e", n * n)).alias("sum_sq"), F.count(of("s", F.col("source_type"))).alias("n_sources"), F.max(of("s")).alias("largest_source"),
        # one entry per source type, a closed vocabulary
        F.array_join(F.array_sort(F.collect_list(of("s", F.concat_ws(":", "source_type", n.cast("string"))))), ",").alias("sources_breakdown"),
        F.count(of("w", F.col("id"))).alias("n_webhooks"), F.max(of("w")).alias("largest_webhook"),
    )
    per_claim = claim_rows(scoped).groupBy("payment_id", *CLAIM_KEYS).agg(
        F.count("*").alias("n"), F.count_distinct("source_type").alias("s")
    )
    claims = per_claim.groupBy("payment_id").agg(
        F.count("*").alias("distinct_claims"),
        F.count_if(F.col("n") > 1).alias("corroborated_claim_count"),
        F.count_if(F.col("s") > 1).alias("multi_source_claim_count"),
    )
    joined = joined.join(claims, "payment_id", "left")
    hhi = F.when(F.col("n_events") == 0, 1.0).otherwise(
        F.col("sum_sq") / F.pow(F.col("total_observations").cast("double"), 2)
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "payment_id", "total_observations",
        F.coalesce("distinct_claims", zero).alias("distinct_claims"),
        F.greatest("n_sources", F.lit(1)).alias("distinct_sources"),
        F.greatest("n_events", F.lit(1)).alias("distinct_events"),
        (F.col("n_events") + F.col("n_webhooks") + F.col("n_sources")).alias("distinct_groups"),
        F.coalesce("largest_event", F.greatest("largest_webhook", "largest_source")).alias("largest_group_size"),
        F.round(hhi, 4).alias("group_hhi"),
        F.coalesce("corroborated_claim_count", zero).alias("corroborated_claim_count"),
        F.coalesce("multi_source_claim_count", zero).alias("multi_source_claim_count"),
        "sources_breakdown",
    )


def claim_in_slots() -> Column:
    """Of a row of `canonical.by_subject`: evidence id -> the claim that the observation supports, as `claim_rows` has it."""
    def entry(slot, etype, value):
        claim_type, key, how = V.CLAIM_OF[etype]
        v = F.expr(value)
        text = {"lower": F.lower, "upper": F.upper}.get(how, lambda c: c)(F.trim(v))
        return F.when(v.isNotNull() & (v != ""), F.struct(
            F.expr(f"event_id * 16 + {slot}").alias("id"),
            F.struct(F.lit(claim_type).alias("claim_type"), F.lit(key).alias("claim_key"), text.alias("canonical_value")).alias("claim")))
    of = lambda order: F.array_compact(F.array(*[entry(*x) for x in slot_values(order) if x[1] in V.CLAIM_OF]))
    return F.map_from_entries(F.when(F.col("subject_type") == "order", of(True)).otherwise(of(False)))


def inner_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends in one claim of the subject. `edges`: with subject_type, subject_id and `claims` (`claim_in_slots`) of their event."""
    a, b = F.col("claims")[F.col("source_id")], F.col("claims")[F.col("target_id")]
    return edges.where(a == b).select("subject_type", "subject_id", a.alias("c")).select("subject_type", "subject_id", "c.*")


def claim_support(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Support of each claim: observations, distinct sources, first-per-source ones, and
    dependency edges with both ends in the claim (`inner_edges`).

    Edges only join observations of one event, so that those inside a claim are found on the event's row and only they
    are counted. Where the rows of a subject lie in one task, nothing is moved.
    """
    per_source = rows.groupBy(*CLAIM_KEYS, "source_type", "source_reference").agg(F.count("*").alias("n"))
    support = per_source.groupBy(*CLAIM_KEYS).agg(
        F.sum("n").alias("total_support"), F.count_distinct("source_type").alias("independent_support"),
        F.count("*").alias("first_per_source"))
    deps = edges.groupBy(*CLAIM_KEYS).agg(F.count("*").alias("dependency_count"))
    return meet(CLAIM_KEYS, support, deps).select(
        key_hash(*[F.col(c) for c in CLAIM_KEYS]).alias("claim_id"), "total_support", "independent_support", "first_per_source",
        F.coalesce("dependency_count", F.lit(0).cast("bigint")).alias("dependency_count"))
