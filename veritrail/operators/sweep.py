"""Integrity at any number of times per payment, from signed changes instead of copies of rows.

Everything that integrity counts changes at known moments: an observation enters when it is observed, ages at fixed
distances from that and leaves when it expires; a claim enters with its first observation and is corroborated from
its second observation or source on; a conflict exists from the later of its two sides on. The changes of a payment
are added up along time, so m evaluation times of n observations cost m + n rows and not m * n.

A payment of many observations is spread over tasks: its changes are added up by kind, then along minutes. All other
payments are moved once, and each is put in order where it lies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import vocab as V
from veritrail.functions.skew import running_sums
from veritrail.operators.conflicts import _SET_TYPES, status_conflict_times
from veritrail.operators.integrity import KEY, with_dimensions
from veritrail.operators.structure import CLAIM_KEYS, claim_parts, claim_rows, supports_claim

AT = ["payment_id", "at_us"]
_STATES = ("current", "aging", "stale")
_AUTHORITIES = ("primary", "secondary", "tertiary")
_SOURCES = (*V.PROVIDER_SOURCES, "INTERNAL_SYSTEM")
_ENTER, _AGE, _STALE, _LEAVE = range(4)
#: Moments of a payment are summed inside minutes, then its minutes.
_MINUTE_US = 60_000_000
#: A payment of more observations is spread over tasks.
MANY = 10_000
_CONFLICTS = {"STATE_CONFLICT": "state_conflicts", "TEMPORAL_CONFLICT": "temporal_conflicts", "ORDERING_AMBIGUITY": "ordering_ambiguities"}


def _changes(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """Changes of some counters, added up per payment and moment; the other counters don't change."""
    made = rows.select(*AT, *[F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n, c in counters.items()])
    return made.groupBy(*AT).agg(*[F.sum(n).alias(n) for n in counters])


def observation_moments(scoped: DataFrame) -> DataFrame:
    """Each observation once for every moment at which it changes what is counted."""
    o, end = F.col("observed_us"), F.col("valid_until_us")
    usable = (F.col("subject_type") == "payment") & (end.isNull() | (end > o))
    lasts = lambda t: usable & (end.isNull() | (end > t))
    aging, stale = o + E.threshold(0), o + E.threshold(1)
    moment = lambda cond, t, kind: F.when(cond, F.struct(t.alias("at_us"), F.lit(kind).alias("kind")))
    moments = F.array_compact(F.array(
        moment(F.lit(True), o, _ENTER), moment(lasts(aging), aging, _AGE), moment(lasts(stale), stale, _STALE),
        moment(usable & end.isNotNull(), end, _LEAVE)))
    return scoped.select(
        "payment_id", "source_type", usable.alias("u"), E.authority(F.col("source_type")).alias("auth"),
        E.directness(F.col("source_type"), F.col("evidence_type")).alias("direct"),
        F.when(end < aging, "current").when(end < stale, "aging").otherwise("stale").alias("at_end"), F.explode(moments).alias("m"),
    ).select("*", "m.at_us", "m.kind")


def observation_changes(scoped: DataFrame) -> DataFrame:
    """Evidence that enters, ages and leaves, by state, authority, directness and source."""
    rows, kind = observation_moments(scoped), F.col("kind")
    whole = F.when(F.col("u") & (kind == _ENTER), 1).when(kind == _LEAVE, -1).otherwise(0)
    leaves = lambda state: F.when((kind == _LEAVE) & (F.col("at_end") == state), -1)
    only = lambda cond: F.when(cond, whole).otherwise(0)
    return _changes(rows, {
        "total_count": F.when(kind == _ENTER, 1), "evidence_count": whole,
        "current_count": F.when(F.col("u") & (kind == _ENTER), 1).when(kind == _AGE, -1).otherwise(leaves("current")),
        "aging_count": F.when(kind == _AGE, 1).when(kind == _STALE, -1).otherwise(leaves("aging")),
        "stale_count": F.when(kind == _STALE, 1).otherwise(leaves("stale")),
        **{f"{a}_count": only(F.col("auth") == a.upper()) for a in _AUTHORITIES},
        "direct_count": only(F.col("direct") == "DIRECT"),
        **{f"of_{s}": only(F.col("source_type") == s) for s in _SOURCES},
    })


def other_sources(scoped: DataFrame) -> DataFrame:
    """Sources outside the known ones: how many of them have usable evidence, from how much each has."""
    rows = observation_moments(scoped.where(~F.col("source_type").isin(*_SOURCES)))
    whole = F.when(F.col("u") & (F.col("kind") == _ENTER), 1).when(F.col("kind") == _LEAVE, -1).otherwise(0).cast("bigint")
    per = rows.groupBy(*AT, "source_type").agg(F.sum(whole).alias("held"), F.sum(whole).alias("change"))
    held = running_sums(per, ["payment_id", "source_type"], ["at_us"], [F.floor(F.col("at_us") / _MINUTE_US)], ["held"])
    before = F.col("held") - F.col("change")
    return _changes(held, {"other_sources": F.when((before == 0) & (F.col("held") > 0), 1).when((before > 0) & (F.col("held") == 0), -1)})


def first_changes(scoped: DataFrame, col: str, counter: str) -> DataFrame:
    """A value counts from the first time it is seen on."""
    first = scoped.where(F.col(col).isNotNull()).groupBy("payment_id", col).agg(F.min("observed_us").alias("at_us"))
    return _changes(first, {counter: F.lit(1)})


def claim_changes(rows: DataFrame) -> list[DataFrame]:
    """Claims of payments from their first observation on, and what their second observation and source make of them."""
    key = ["payment_id", "claim_id"]
    rows = rows.where(F.col("subject_type") == "payment").withColumn("payment_id", F.col("subject_id"))
    by_time = Window.partitionBy(*key).orderBy("observed_us", "evidence_id")
    early = rows.select(*key, "claim_type", "claim_key", "canonical_value", "observed_us", "evidence_id").withColumn(
        "nth", F.row_number().over(by_time)).where("nth <= 2").withColumn("at_us", F.col("observed_us"))  # cut to two rows before the shuffle
    new = F.when(F.col("nth") == 1, 1)
    entered = _changes(early, {
        "claim_count": new, "multi_observation_claims": F.when(F.col("nth") == 2, 1),
        **{f"n_{t}": F.when(F.col("claim_type") == t, new) for t in _SET_TYPES}})
    per_source = rows.groupBy(*key, "source_type").agg(F.min("observed_us").alias("t"))
    # sources are a closed vocabulary, so a claim has a handful of first times
    second = per_source.where("source_type IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_list("t")).alias("times")).where(F.size("times") > 1)
    several = _changes(second.withColumn("at_us", F.col("times")[1]), {"multi_source_claims": F.lit(1)})
    claims = early.where("nth = 1").withColumn("earliest_us", F.col("observed_us"))
    kinds = status_conflict_times(claims)
    conflicts = _changes(kinds, {n: F.when(F.col("conflict_type") == k, 1) for k, n in _CONFLICTS.items()})
    return [entered, several, conflicts]


def counters_at(scoped: DataFrame, observations: DataFrame, points: DataFrame) -> DataFrame:
    """All counters of integrity at the given points (payment_id, eval_us), which may be any number a payment.

    Points at which nothing of the payment was visible yet are left out.
    """
    parts = [
        observation_changes(scoped), other_sources(scoped), first_changes(scoped, "source_type", "seen_sources"),
        first_changes(scoped, "payment_event_id", "seen_events"), *claim_changes(claim_rows(observations)),
        points.select("payment_id", F.col("eval_us").alias("at_us")).distinct().withColumn("asked", F.lit(1).cast("bigint")),
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in both.columns if c not in (*AT, "asked")]
    moments = both.groupBy(*AT).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in names], F.max("asked").alias("asked"))
    sums = running_sums(moments, ["payment_id"], ["at_us"], [F.floor(F.col("at_us") / _MINUTE_US)], names)
    used = reduce(lambda a, b: a + b, [F.when(F.col(f"of_{s}") > 0, 1).otherwise(0) for s in _SOURCES])
    found = sums.where("asked = 1 AND total_count > 0").withColumn("source_count", (used + F.col("other_sources")).cast("bigint"))
    return found.drop("asked", "other_sources", *[f"of_{s}" for s in _SOURCES]).withColumnRenamed("at_us", "eval_us")


def status_conflicts_in_time(scoped: DataFrame) -> DataFrame:
    """Conflicts between statuses of a payment with the time each came to be, from the first time of every status."""
    kinds = [t for t, c in V.CLAIM_OF.items() if c[:2] == ("PAYMENT_STATUS", "STATUS")]  # cut to them before anything is derived
    first = claim_rows(scoped.where((F.col("subject_type") == "payment") & F.col("evidence_type").isin(kinds))).groupBy(
        "payment_id", *CLAIM_KEYS).agg(F.min("observed_us").alias("earliest_us"))
    return status_conflict_times(first.withColumn("claim_id", E.key_hash(*[F.col(c) for c in CLAIM_KEYS])))


def counters_in_place(scoped: DataFrame) -> DataFrame:
    """The counters of `counters_at` at every time at which something of the payment was observed.

    The observations are moved once, to the task of their payment; windows and sums of a payment and more lie there already.
    """
    o, end, claim = F.col("observed_us"), F.col("valid_until_us"), F.col("claim_type")
    says = (F.col("subject_type") == "payment") & supports_claim()
    parts = [F.when(says, c).alias(n) for n, c in zip(("claim_type", "claim_key", "canonical_value"), claim_parts())]
    made = scoped.where(o.isNotNull()).select(
        "payment_id", "evidence_id", "observed_us", "valid_until_us", "source_type", "payment_event_id", *parts,
        ((F.col("subject_type") == "payment") & (end.isNull() | (end > o))).alias("u"),
        (E.directness(F.col("source_type"), F.col("evidence_type")) == "DIRECT").alias("direct"),
        (o + E.threshold(0)).alias("aging_us"), (o + E.threshold(1)).alias("stale_us"))
    conflicts = status_conflicts_in_time(scoped).withColumnRenamed("at_us", "observed_us")
    rows = made.unionByName(conflicts, allowMissingColumns=True).repartition("payment_id")

    seen = F.col("conflict_type").isNull()
    of_claim = Window.partitionBy("payment_id", "claim_type", "claim_key", "canonical_value").orderBy("observed_us", "evidence_id")
    here, before = (of_claim.rowsBetween(Window.unboundedPreceding, last) for last in (0, -1))
    several = lambda w: F.coalesce(F.min("source_type").over(w) < F.max("source_type").over(w), F.lit(False))
    rows = rows.select(
        "*", F.row_number().over(of_claim).alias("nth"), (several(here) & ~several(before)).alias("second_source"),
        F.max(F.when(seen, o)).over(Window.partitionBy("payment_id")).alias("last_us"))
    rows = rows.withColumn("nth_of_event", F.row_number().over(Window.partitionBy("payment_id", "payment_event_id").orderBy("observed_us")))

    # moments after the last time that is asked for change nothing
    lasts = lambda t: seen & F.col("u") & (t <= F.col("last_us")) & (end.isNull() | (end > t))
    aging, stale = F.col("aging_us"), F.col("stale_us")
    moment = lambda cond, t, kind: F.when(cond, F.struct(t.alias("at_us"), F.lit(kind).alias("kind")))
    moments = F.array_compact(F.array(
        moment(F.lit(True), o, _ENTER), moment(lasts(aging), aging, _AGE), moment(lasts(stale), stale, _STALE),
        moment(seen & F.col("u") & (end <= F.col("last_us")), end, _LEAVE)))
    state = F.when(end < aging, "current").when(end < stale, "aging").otherwise("stale")
    rows = rows.select("*", state.alias("at_end"), F.explode(moments).alias("m")).select("*", "m.at_us", "m.kind")

    kind = F.col("kind")
    enters, leaves = seen & (kind == _ENTER), kind == _LEAVE
    whole = F.when(enters & F.col("u"), 1).when(leaves, -1).otherwise(0)
    new = enters & claim.isNotNull()
    cells = rows.groupBy(*AT, "source_type").agg(
        F.count_if(enters).alias("total_count"), F.sum(whole).alias("evidence_count"),
        F.sum(F.when(enters & F.col("u"), 1).when(kind == _AGE, -1).when(leaves & (F.col("at_end") == "current"), -1)).alias("current_count"),
        F.sum(F.when(kind == _AGE, 1).when(kind == _STALE, -1).when(leaves & (F.col("at_end") == "aging"), -1)).alias("aging_count"),
        F.sum(F.when(F.col("direct"), whole)).alias("direct_count"),
        F.count_if(new & (F.col("nth") == 1)).alias("claim_count"), F.count_if(new & (F.col("nth") == 2)).alias("multi_observation_claims"),
        F.count_if(new & F.col("second_source")).alias("multi_source_claims"),
        *[F.count_if(new & (F.col("nth") == 1) & (claim == t)).alias(f"n_{t}") for t in _SET_TYPES],
        F.count_if(enters & F.col("payment_event_id").isNotNull() & (F.col("nth_of_event") == 1)).alias("seen_events"),
        *[F.count_if(F.col("conflict_type") == k).alias(n) for k, n in _CONFLICTS.items()])
    # a source counts from its first observation on, and is used while it has usable evidence
    of_source = Window.partitionBy("payment_id", "source_type").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0)
    held, source, auth = F.sum("evidence_count").over(of_source), F.col("source_type").isNotNull(), E.authority(F.col("source_type"))
    cells = cells.select(
        "*", F.when(source, (held > 0).cast("bigint") - (held - F.col("evidence_count") > 0).cast("bigint")).alias("source_count"),
        (source & (F.col("total_count") > 0) & (F.sum("total_count").over(of_source) == F.col("total_count"))).cast("bigint").alias("seen_sources"),
        *[F.when(auth == a.upper(), F.col("evidence_count")).alias(f"{a}_count") for a in _AUTHORITIES])
    names = [c for c in cells.columns if c not in (*AT, "source_type")]
    moved = cells.groupBy(*AT).agg(*[F.sum(c).alias(c) for c in names], (F.sum("total_count") > 0).alias("asked"))
    sums = running_sums(moved, ["payment_id"], ["at_us"], [], names)
    return sums.where("asked").drop("asked").withColumnRenamed("at_us", "eval_us").withColumn(
        "stale_count", F.expr("evidence_count - current_count - aging_count"))


def integrity_counters(counters: DataFrame) -> DataFrame:
    """The counters under the names that the dimensions are derived from."""
    value = E.pairs_of(F.col("n_PAYMENT_AMOUNT")) + E.pairs_of(F.col("n_PAYMENT_CURRENCY"))
    relation = E.pairs_of(F.col("n_ORDER_ASSOCIATION"))
    plain = ("total_count", "evidence_count", *[f"{s}_count" for s in (*_STATES, *_AUTHORITIES)], "direct_count", "claim_count",
             "multi_observation_claims", "multi_source_claims", *_CONFLICTS.values(), "source_count")
    found = counters.select(
        *KEY, *plain, value.alias("value_conflicts"), relation.alias("relationship_conflicts"),
        F.greatest("seen_sources", F.lit(1)).alias("distinct_sources"), F.greatest("seen_events", F.lit(1)).alias("distinct_events"),
        F.lit(0).cast("bigint").alias("unresolved_count"))
    open_ones = F.expr("state_conflicts + temporal_conflicts + value_conflicts + relationship_conflicts")
    return found.withColumns({"open_conflict_count": open_ones, "conflict_count": open_ones + F.col("ordering_ambiguities")})


def dimensions_at(scoped: DataFrame, observations: DataFrame, points: DataFrame) -> DataFrame:
    """Dimension statuses at the given points, strictly from what was visible at each."""
    return with_dimensions(integrity_counters(counters_at(scoped, observations, points)))


def dimensions_own(scoped: DataFrame, spread: bool) -> DataFrame:
    """The same at each payment's own times, whenever something was observed. `spread`: each payment is spread over tasks."""
    if not spread:
        return with_dimensions(integrity_counters(counters_in_place(scoped)))
    return dimensions_at(scoped, scoped, scoped.select("payment_id", F.col("observed_us").alias("eval_us")).distinct())


def by_size(scoped: DataFrame, build: Callable[[Callable[[DataFrame], DataFrame], bool], DataFrame]) -> DataFrame:
    """Rows of `build(part, spread)` for payments of few observations, where they lie, and for those of many, spread over tasks.

    `part` cuts a table to the payments in question. Those of many are a small fraction of the observations.
    """
    many = F.broadcast(scoped.groupBy("payment_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("payment_id"))
    part = lambda how: lambda df: df.join(many, "payment_id", how)
    return build(part("left_anti"), False).unionByName(build(part("left_semi"), True))
