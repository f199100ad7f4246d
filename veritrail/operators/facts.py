"""Canonical facts and reconciliation decisions.

Reconciliation compares every two observations of a payment. The decision depends only on
whether they share an event, on their fact types and values, and (same type and value) on their
distance in time, so decisions are counted per class instead of listed per pair:

* same event - an event yields a handful of observations, their pairs are taken inside the event;
* different event, different value or type - from group sizes;
* different event, same type and value - a trailing time window counts the pairs within reach.

`decisions_of` lists the individual decisions of chosen observations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.expr import pairs_of
from veritrail.functions.skew import near_sums, prefix_before, shuffled, time_chunks
from veritrail.sources.driver_tables import lookup

FACT_KEYS = ["payment_id", "fact_type", "canonical_value"]


def keys_of(df: DataFrame) -> list[str]:
    """Payment key, with the evaluation time when the frame holds several of them."""
    return ["payment_id", *(["eval_us"] if "eval_us" in df.columns else [])]


def fact_keys(df: DataFrame) -> list[str]:
    return [*keys_of(df), *FACT_KEYS[1:]]


def fact_type() -> Column:
    return F.coalesce(
        lookup("evidence_type", V.FACT_OF_ATTRIBUTE),
        lookup("event_type", V.FACT_OF_EVENT),
        F.lit("PAYMENT_STATUS_OBSERVED"),
    )


def canonical_value() -> Column:
    v = F.trim("value")
    return F.when(F.col("value").isNull(), "unknown").when(F.col("value_type") == "ENUM", F.lower(v)).otherwise(v)


def fact_hash() -> Column:
    return F.sha2(F.concat_ws("|", *FACT_KEYS), 256)


def fact_rows(payment_obs: DataFrame) -> DataFrame:
    """Observation with its fact; the hash is computed per row, no lookup needed."""
    return payment_obs.select(
        *keys_of(payment_obs), "evidence_id", "evidence_type", "source_type", "webhook_event_id", "payment_event_id",
        "observed_us", "valid_until_us", fact_type().alias("fact_type"), canonical_value().alias("canonical_value"),
        # observations of one delivery belong together; one without any event stands alone
        F.coalesce("webhook_event_id", "payment_event_id", -1 - F.col("evidence_id")).alias("event_key"),
    ).withColumn("fact_hash", fact_hash())


def build_facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*fact_keys(rows)).agg(
        F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"),
        F.count("*").alias("observation_count"),
        F.greatest(F.count_distinct("source_type"), F.lit(1)).alias("distinct_source_count"),
        F.min("evidence_id").alias("first_evidence_id"),
    ).withColumn("fact_hash", fact_hash()).withColumn("status", F.lit("ACTIVE"))


def facts_through(rows: DataFrame, points) -> DataFrame:
    """Facts as they were at each of a few times (eval_us), with what coverage looks at.

    A fact's first time is the same whenever it is visible, so an observation is moved once and not once a time.
    """
    facts = rows.groupBy(*FACT_KEYS).agg(
        F.min("observed_us").alias("first_us"), *[F.count_if(F.col("observed_us") <= F.lit(p)).alias(f"n_{i}") for i, p in enumerate(points)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("eval_us"), F.col(f"n_{i}").alias("observation_count")) for i, p in enumerate(points)]))
    return facts.select(*FACT_KEYS, "first_us", each.alias("x")).select(*FACT_KEYS, "first_us", "x.*").where("observation_count > 0").withColumn(
        "fact_hash", fact_hash()).withColumn("status", F.lit("ACTIVE"))


def decision(same_event: Column, ta: Column, tb: Column, same_value: Column, near: Column) -> Column:
    """The rule tree for two different observations of one payment."""
    def out(result, rule):
        return F.struct(F.lit(result).alias("result"), F.lit(rule).alias("rule_id"))
    same_type = ta == tb
    lifecycle = ta.isin(*V.LIFECYCLE_FACTS) & tb.isin(*V.LIFECYCLE_FACTS)
    return (
        F.when(same_event & same_type & same_value, out("SAME_FACT", "SAME_PROVIDER_EVENT_V1"))
        .when(~same_type & (same_event | lifecycle), out("RELATED_FACT", "DIFFERENT_LIFECYCLE_V1"))
        .when(same_type & ~same_value, out("CONFLICTING_FACT", "CONFLICTING_VALUE_V1"))
        .when(same_type & near, out("SAME_FACT", "SAME_FACT_DIFFERENT_SOURCE_V1"))
        .when(same_type, out("UNKNOWN", "TEMPORAL_AMBIGUITY_V1"))
        .otherwise(out("DIFFERENT_FACT", "INSUFFICIENT_INFORMATION_V1"))
    )


_TYPES = tuple(sorted(set(V.FACT_OF_ATTRIBUTE.values()) | set(V.FACT_OF_EVENT.values())))


def _per_type(col: str) -> list[Column]:
    """Counters of one payment by fact type (closed vocabulary)."""
    return [F.sum(F.when(F.col("fact_type") == t, F.col(col)).otherwise(0)).alias(f"{col}_{t}") for t in _TYPES]


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _with_near(rows: DataFrame) -> DataFrame:
    """Per (fact, time): members at that time, and those within reach before and around it."""
    keys = fact_keys(rows)
    slots = rows.groupBy(*keys, "observed_us").agg(F.count("*").alias("at"))
    return near_sums(slots, keys, "observed_us", V.RECONCILIATION_WINDOW_US, "at")


def reconcile_counts(rows: DataFrame) -> DataFrame:
    """Number of decisions per payment, result and rule, over all pairs of its observations."""
    # the pair classes are all counted from sizes; `cells` is at most one row per observation
    cells = rows.groupBy(*FACT_KEYS, "event_key").agg(F.count("*").alias("n"))
    per_event = cells.groupBy("payment_id", "event_key").agg(
        F.sum("n").alias("e"), F.sum(pairs_of(F.col("n"))).alias("same_fact"), *_per_type("n")
    )
    # inside events: same type, and same type and value
    same_type = _total([pairs_of(F.col(f"n_{t}")) for t in _TYPES])
    lifecycle = pairs_of(_total([F.col(f"n_{t}") for t in V.LIFECYCLE_FACTS])) - _total(
        [pairs_of(F.col(f"n_{t}")) for t in V.LIFECYCLE_FACTS]
    )
    inside = per_event.groupBy("payment_id").agg(
        F.sum(pairs_of(F.col("e"))).alias("ev_pairs"), F.sum("same_fact").alias("ev_same_fact"),
        F.sum(same_type).alias("ev_same_type"), F.sum(lifecycle).alias("ev_lifecycle"),
    )
    per_fact = cells.groupBy(*FACT_KEYS).agg(F.sum("n").alias("n"))
    totals = per_fact.groupBy("payment_id").agg(
        F.sum("n").alias("n"), F.sum(pairs_of(F.col("n"))).alias("fact_pairs"), *_per_type("n")
    )
    # pairs of one fact within the time window; an observation at t meets those at t once
    near = _with_near(rows).groupBy("payment_id").agg(
        F.sum(F.col("at") * (F.col("before") - F.col("at")) + pairs_of(F.col("at"))).alias("near_pairs")
    )
    j = totals.withColumn("same_type", same_type).withColumn("life", lifecycle).join(inside, "payment_id").join(
        near, "payment_id")
    same_event_fact = F.col("ev_same_fact")
    related = (F.col("ev_pairs") - F.col("ev_same_type")) + (F.col("life") - F.col("ev_lifecycle"))
    conflicting = F.col("same_type") - F.col("fact_pairs")
    same_near = F.col("near_pairs") - F.col("ev_same_fact")
    unknown = F.col("fact_pairs") - F.col("near_pairs")
    different = pairs_of(F.col("n")) - same_event_fact - related - conflicting - same_near - unknown

    def row(result, rule, n):
        return F.struct(F.lit(result).alias("result"), F.lit(rule).alias("rule_id"), n.cast("bigint").alias("pair_count"))
    return j.select("payment_id", F.explode(F.array(
        row("SAME_FACT", "SAME_PROVIDER_EVENT_V1", same_event_fact),
        row("RELATED_FACT", "DIFFERENT_LIFECYCLE_V1", related),
        row("CONFLICTING_FACT", "CONFLICTING_VALUE_V1", conflicting),
        row("SAME_FACT", "SAME_FACT_DIFFERENT_SOURCE_V1", same_near),
        row("UNKNOWN", "TEMPORAL_AMBIGUITY_V1", unknown),
        row("DIFFERENT_FACT", "INSUFFICIENT_INFORMATION_V1", different),
    )).alias("d")).select("payment_id", "d.*").filter("pair_count > 0")


def _with_sizes(rows: DataFrame) -> DataFrame:
    """Rows with the sizes of their event (e, by fact type), payment (n), fact (nf), fact in the event (ef) and what is within reach (around)."""
    per_event = rows.groupBy("payment_id", "event_key").agg(
        F.count("*").alias("e"), *[F.count_if(F.col("fact_type") == t).alias(f"e_{t}") for t in _TYPES]
    )
    in_event = rows.groupBy(*FACT_KEYS, "event_key").agg(F.count("*").alias("ef"))
    totals = rows.groupBy("payment_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("fact_type") == t).alias(f"n_{t}") for t in _TYPES]
    )
    per_fact = rows.groupBy(*FACT_KEYS).agg(F.count("*").alias("nf"))
    near = _with_near(rows).select(*FACT_KEYS, "observed_us", "around")
    return (
        rows.join(shuffled(in_event), [*FACT_KEYS, "event_key"]).join(shuffled(near), [*FACT_KEYS, "observed_us"])
        .join(shuffled(per_fact), FACT_KEYS).join(shuffled(per_event), ["payment_id", "event_key"]).join(shuffled(totals), "payment_id")
    )


def _sizes_in_place(rows: DataFrame) -> DataFrame:
    """The same by windows over parts of a payment, which move nothing where the payment lies."""
    payment, event, fact = Window.partitionBy("payment_id"), Window.partitionBy("payment_id", "event_key"), Window.partitionBy(*FACT_KEYS)
    of_type = lambda prefix, w: [F.count_if(F.col("fact_type") == t).over(w).alias(f"{prefix}_{t}") for t in _TYPES]
    n, reach = F.count(F.lit(1)), V.RECONCILIATION_WINDOW_US
    every = rows.select(
        "payment_id", "evidence_id", "fact_hash", "fact_type", "canonical_value", "event_key", "observed_us", n.over(payment).alias("n"), *of_type("n", payment), n.over(event).alias("e"), *of_type("e", event),
        n.over(fact).alias("nf"), n.over(Window.partitionBy(*FACT_KEYS, "event_key")).alias("ef"),
        n.over(fact.orderBy("observed_us").rangeBetween(-reach, reach)).alias("around"))
    return every.where("observed_us IS NOT NULL AND event_key IS NOT NULL")  # of unknown time or event nothing is near or beside


def observation_decisions(rows: DataFrame, spread: bool = True) -> DataFrame:
    """Per observation: its fact and how many decisions of each kind it takes part in.

    Without `spread` the rows of each payment lie in one task and are counted there, which is for payments of few rows.
    """
    j = _with_sizes(rows) if spread else _sizes_in_place(rows)
    own = lambda p: _total([F.when(F.col("fact_type") == t, F.col(f"{p}_{t}")).otherwise(0) for t in _TYPES])
    life = lambda p: _total([F.col(f"{p}_{t}") for t in V.LIFECYCLE_FACTS])
    nt, et = own("n"), own("e")
    others = F.when(F.col("fact_type").isin(*V.LIFECYCLE_FACTS), (life("n") - nt) - (life("e") - et)).otherwise(0)
    same = F.col("ef") - 1
    related = F.col("e") - et + others
    conflicting = nt - F.col("nf")
    same_near = F.col("around") - F.col("ef")
    unknown = F.col("nf") - F.col("around")
    different = F.col("n") - 1 - same - related - conflicting - same_near - unknown

    def row(result, rule, n):
        return F.struct(F.lit(result).alias("result"), F.lit(rule).alias("rule_id"), n.cast("bigint").alias("partners"))
    return j.select("payment_id", "evidence_id", "fact_hash", F.explode(F.array(
        row("SAME_FACT", "SAME_PROVIDER_EVENT_V1", same),
        row("RELATED_FACT", "DIFFERENT_LIFECYCLE_V1", related),
        row("CONFLICTING_FACT", "CONFLICTING_VALUE_V1", conflicting),
        row("SAME_FACT", "SAME_FACT_DIFFERENT_SOURCE_V1", same_near),
        row("UNKNOWN", "TEMPORAL_AMBIGUITY_V1", unknown),
        row("DIFFERENT_FACT", "INSUFFICIENT_INFORMATION_V1", different),
    )).alias("d")).select("payment_id", "evidence_id", "fact_hash", "d.*").filter("partners > 0")


def decisions_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The individual decisions of chosen observations (evidence_id): one row per partner."""
    cols = ["evidence_id", "fact_type", "canonical_value", "fact_hash", "event_key", "observed_us"]
    a = rows.join(chosen.select("evidence_id"), "evidence_id").select(
        "payment_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = rows.select("payment_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, "payment_id").filter("a_evidence_id <> b_evidence_id")
    d = decision(
        F.col("a_event_key") == F.col("b_event_key"), F.col("a_fact_type"), F.col("b_fact_type"),
        F.col("a_canonical_value") == F.col("b_canonical_value"),
        F.abs(F.col("a_observed_us") - F.col("b_observed_us")) <= V.RECONCILIATION_WINDOW_US,
    )
    return pairs.select(
        "payment_id", F.least("a_evidence_id", "b_evidence_id").alias("observation_a_id"),
        F.greatest("a_evidence_id", "b_evidence_id").alias("observation_b_id"), d.alias("d"),
        F.when(d["result"] == "SAME_FACT", F.col("a_fact_hash")).alias("fact_hash"),
    ).select("payment_id", "observation_a_id", "observation_b_id", "d.result", "d.rule_id", "fact_hash").distinct()


def filter_facts(facts: DataFrame, types: list[str], status: str, from_us: int, to_us: int) -> DataFrame:
    """Facts of given types and status inside a time range, with the active count per payment."""
    kept = facts.filter(
        F.col("fact_type").isin(*types) & (F.col("status") == status)
        & (F.col("first_us") >= from_us) & (F.col("last_us") <= to_us)
    )
    active = kept.groupBy("payment_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active_facts"))
    return kept.join(active, "payment_id")


def fact_sequence(facts: DataFrame) -> DataFrame:
    """Per fact: how many other facts of its payment start earlier, later, or at the same time."""
    slots = facts.groupBy("payment_id", "first_us").agg(F.count("*").alias("at"))
    ranked = prefix_before(
        slots, ["payment_id"], ["first_us"], time_chunks(F.col("first_us")), F.col("at"), "sum", "before")
    totals = facts.groupBy("payment_id").agg(F.count("*").alias("n"))
    j = facts.select("payment_id", "fact_hash", "first_us").join(ranked, ["payment_id", "first_us"]).join(totals, "payment_id")
    return j.select(
        "payment_id", "fact_hash", F.col("before").alias("precedes"),
        (F.col("n") - F.col("before") - F.col("at")).alias("succeeds"), (F.col("at") - 1).alias("concurrent"))
