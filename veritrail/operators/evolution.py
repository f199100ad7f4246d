"""Snapshots over time, their differences, causes, and point-in-time replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import vocab as V
from veritrail.functions.skew import meet
from veritrail.sources.driver_tables import lookup

KEY = ["payment_id", "eval_us"]
TRACKED = ("overall_status", "evidence_count", "source_count", "claim_count", "conflict_count", "open_conflict_count",
           "corroboration", "independence", "freshness", "consistency")


def state_snapshot(history: DataFrame) -> DataFrame:
    return history.select(*KEY, *TRACKED, F.lit(V.METHODOLOGY).alias("methodology_version"))


def latest_snapshot(snapshots: DataFrame, at_us: int | None = None) -> DataFrame:
    """Latest snapshot per payment, at or before a time when given; a partial aggregate, no sort."""
    seen = snapshots if at_us is None else snapshots.filter(F.col("eval_us") <= at_us)
    return seen.groupBy("payment_id").agg(
        F.max_by(F.struct(*[c for c in snapshots.columns if c != "payment_id"]), "eval_us").alias("s"),
        F.count("*").alias("history_count")).select("payment_id", "s.*", "history_count")


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before it (a payment has one per evaluation run)."""
    w = Window.partitionBy("payment_id").orderBy("eval_us")
    cols = [*TRACKED, "methodology_version"]
    return snapshots.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in cols], F.lag("eval_us").over(w).alias("p_eval_us")).filter(
        "p_eval_us IS NOT NULL")


_CORROBORATION_RANK = {"UNKNOWN": 0, "SINGLE_OBSERVATION": 1, "PARTIALLY_CORROBORATED": 2, "STRONGLY_CORROBORATED": 3}


def state_diff(pairs: DataFrame) -> DataFrame:
    """One row per changed dimension between a snapshot and its predecessor."""
    def change(cond, dimension, kind, col):
        return F.when(cond, F.struct(
            F.lit(dimension).alias("dimension"), kind.alias("change_type"),
            F.col(f"p_{col}").cast("string").alias("previous_value"), F.col(col).cast("string").alias("current_value")))
    up = lambda c, a, b: F.when(F.col(c) > F.col(f"p_{c}"), a).otherwise(b)
    ne = lambda c: F.col(c) != F.col(f"p_{c}")
    rank = lambda c: lookup(c, _CORROBORATION_RANK, 0)
    conflicts_moved = ne("open_conflict_count")
    changes = E.parts(
        change(ne("evidence_count"), "EVIDENCE", up("evidence_count", "NEW_EVIDENCE", "EVIDENCE_REMOVED"), "evidence_count"),
        change(ne("source_count"), "SOURCE", up("source_count", "NEW_SOURCE", "SOURCE_LOST"), "source_count"),
        change(ne("corroboration"), "CORROBORATION", F.when(rank("corroboration") > rank("p_corroboration"), "CORROBORATION_INCREASED")
               .otherwise("CORROBORATION_DECREASED"), "corroboration"),
        change(ne("independence"), "INDEPENDENCE", F.lit("INDEPENDENCE_CHANGED"), "independence"),
        change(ne("freshness"), "FRESHNESS", F.lit("FRESHNESS_CHANGED"), "freshness"),
        change(conflicts_moved, "CONSISTENCY", up("open_conflict_count", "CONFLICT_CREATED", "CONFLICT_RESOLVED"), "open_conflict_count"),
        change(~conflicts_moved & ne("consistency"), "CONSISTENCY", F.lit("FRESHNESS_CHANGED"), "consistency"),
        change(ne("overall_status"), "INTEGRITY", F.lit("INTEGRITY_CHANGED"), "overall_status"),
        change(ne("methodology_version"), "METHODOLOGY", F.lit("METHODOLOGY_CHANGED"), "methodology_version"),
    )
    return pairs.withColumn("c", F.explode(changes)).select("*", "c.*").drop("c")


def _rank_gap(table: dict) -> Column:
    return F.abs(lookup("current_value", table) - lookup("previous_value", table))


def _size(gap: Column) -> Column:
    return F.when(gap == 1, "MINOR").when(gap == 2, "MODERATE").when(gap >= 3, "MAJOR")


def change_causes(changes: DataFrame) -> DataFrame:
    kind = F.col("change_type")
    cur, prev = F.col, lambda c: F.col(f"p_{c}")
    older = lookup("freshness", V.FRESHNESS_RANK, 0) < lookup("p_freshness", V.FRESHNESS_RANK, 0)
    corroborated = kind.isin("CORROBORATION_INCREASED", "CORROBORATION_DECREASED")
    rules = [
        (cur("evidence_count") > prev("evidence_count"), "NEW_EVIDENCE", "DIRECT"),
        ((kind == "FRESHNESS_CHANGED") & older & (cur("evidence_count") == prev("evidence_count")), "TIME_PASSAGE", "DIRECT"),
        (cur("open_conflict_count") > prev("open_conflict_count"), "CONFLICT", "DIRECT"),
        (cur("open_conflict_count") < prev("open_conflict_count"), "CONFLICT_RESOLUTION", "DIRECT"),
        (cur("methodology_version") != prev("methodology_version"), "METHODOLOGY_CHANGE", "DIRECT"),
        (cur("source_count") != prev("source_count"), "SOURCE_CHANGE", "INFERRED"),
        (corroborated & (cur("evidence_count") != prev("evidence_count")), "NEW_EVIDENCE", "INFERRED"),
        (corroborated, "UNKNOWN_CAUSE", "INFERRED"),
    ]
    cause, level = F, F
    for i, (cond, c, l) in enumerate(rules):
        cause, level = cause.when(cond, c), level.when(cond, l)
    moved = F.abs(F.expr("try_cast(current_value AS BIGINT)") - F.expr("try_cast(previous_value AS BIGINT)"))
    magnitude = (
        F.when(kind == "INTEGRITY_CHANGED", _size(_rank_gap(V.INTEGRITY_TIER)))
        .when(F.col("dimension") == "FRESHNESS", _size(_rank_gap(V.FRESHNESS_RANK)))
        .when(kind.isin("NEW_EVIDENCE", "EVIDENCE_REMOVED"),
              F.when(moved == 1, "MINOR").when(moved.between(2, 4), "MODERATE").when(moved >= 5, "MAJOR")))
    text = F.concat_ws(" ", "dimension", F.lit("changed from"), "previous_value", F.lit("to"), "current_value")
    return changes.select(
        *KEY, "dimension", "change_type", "previous_value", "current_value",
        cause.otherwise("UNKNOWN_CAUSE").alias("direct_cause"), level.otherwise("UNKNOWN").alias("causality"),
        magnitude.alias("magnitude"), text.alias("explanation"))


def recompute(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest evaluation against the one before it, with the number of changed dimensions."""
    n = changes.groupBy(*KEY).agg(F.count("*").alias("changes"))
    return pairs.select(*KEY, "overall_status", F.col("p_overall_status").alias("previous_status")).join(n, KEY, "left").select(
        *KEY, "overall_status", "previous_status", F.coalesce("changes", F.lit(0).cast("bigint")).alias("changes"),
        F.col("changes").isNull().alias("no_material_change"))


# --- point-in-time replay -----------------------------------------------------------------------

def set_digest(hash_hex: Column, lanes: int = 2) -> list[Column]:
    """Order-free digest of a set: sums of 60-bit lanes of each member's hash.

    Adds up in partial aggregates, so the members of a payment never have to be gathered and sorted.
    """
    return [
        F.coalesce(F.sum(F.conv(F.substring(hash_hex, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string").alias(f"lane{i}")
        for i in range(lanes)
    ]


def input_fingerprint(payment_obs: DataFrame, keys: list[str]) -> DataFrame:
    return payment_obs.groupBy(*keys).agg(
        F.count("*").alias("observation_count"), *set_digest(F.sha2(F.col("evidence_id").cast("string"), 256)))


def decision_state(payments: DataFrame, inputs: DataFrame, facts: DataFrame, coverage: DataFrame, reliability: DataFrame,
                   integrity: DataFrame) -> DataFrame:
    """What was decided about each payment at each evaluation time, with input and result digests."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    fact_n = facts.groupBy(*KEY).agg(F.count("*").alias("fact_count"))
    j = meet(
        KEY, payments.select(*KEY, F.lit(True).alias("known")), inputs, fact_n,
        coverage.select(*KEY, F.col("overall_status").alias("coverage_status"), "required_present", "required_missing"),
        reliability.select(*KEY, F.col("overall_state").alias("reliability_state")),
        integrity.select(*KEY, F.col("overall_status").alias("integrity_status"), "freshness", "source", "independence",
                         "corroboration", "consistency", "source_count", "conflict_count")).where("known")
    r = j.select(
        *KEY, n("observation_count").alias("observation_count"), n("fact_count").alias("fact_count"), n("source_count").alias("source_count"),
        n("conflict_count").alias("conflict_count"), F.coalesce("coverage_status", F.lit("UNKNOWN")).alias("coverage_status"),
        n("required_present").alias("required_present"), n("required_missing").alias("required_missing"),
        F.coalesce("reliability_state", F.lit("LIMITED")).alias("reliability_state"),
        F.coalesce("integrity_status", F.lit("INSUFFICIENT_DATA")).alias("integrity_status"),
        *[F.coalesce(d, F.lit("UNKNOWN")).alias(d) for d in ("freshness", "source", "independence", "corroboration")],
        F.coalesce("consistency", F.lit("NO_DETECTED_CONFLICT")).alias("consistency"),
        F.coalesce("lane0", F.lit("0")).alias("lane0"), F.coalesce("lane1", F.lit("0")).alias("lane1"))
    text = lambda *cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return r.select(
        "*", F.sha2(text(*KEY, "observation_count", "lane0", "lane1", "fact_count", "conflict_count"), 256).alias("input_fingerprint"),
        F.sha2(text("coverage_status", "required_present", "required_missing", "reliability_state", "integrity_status",
                    "freshness", "source", "independence", "corroboration", "consistency", "conflict_count"), 256)
        .alias("result_fingerprint")).drop("lane0", "lane1")


REPLAYED = ("overall_status", "freshness", "source", "independence", "consistency")


def replay_verify(recorded: DataFrame, replayed: DataFrame, known_methodology: str = V.METHODOLOGY) -> DataFrame:
    """Recorded evaluations against a recomputation at the same time."""
    a = recorded.select(*KEY, "methodology_version", *[F.col(d).alias(f"a_{d}") for d in REPLAYED])
    b = replayed.select(*KEY, *[F.col(d).alias(f"b_{d}") for d in REPLAYED], F.lit(True).alias("found"))
    diff = E.parts(*[F.when(F.col(f"a_{d}") != F.col(f"b_{d}"), d) for d in REPLAYED])
    return a.join(b, KEY, "left").select(
        *KEY,
        F.when(F.col("methodology_version") != known_methodology, "METHODOLOGY_UNAVAILABLE").when(F.col("found").isNull(), "INCOMPLETE")
        .when(F.size(diff) == 0, "MATCH").otherwise("REPLAY_MISMATCH").alias("verification"), F.array_join(diff, ",").alias("differing"))


def fact_diff(fact_rows: DataFrame, t1: int, t2: int) -> DataFrame:
    """Facts at two times; both counts come from one pass, so no join of two replays is needed."""
    both = fact_rows.filter(F.col("observed_us") <= t2).groupBy("payment_id", "fact_type", "canonical_value").agg(
        F.count_if(F.col("observed_us") <= t1).alias("n1"), F.count("*").alias("n2"))
    return both.withColumn(
        "category", F.when(F.col("n1") == 0, "ADDED").when(F.col("n2") > F.col("n1"), "CHANGED").otherwise("UNCHANGED"))


def source_set_diff(payment_obs: DataFrame, t1: int, t2: int) -> DataFrame:
    """Source types gained between two times (a closed vocabulary, so the lists stay short)."""
    per = payment_obs.filter(F.col("observed_us") <= t2).groupBy("payment_id", "source_type").agg(F.min("observed_us").alias("first"))
    before = F.col("first") <= t1
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("source_type")))), ",")
    return per.groupBy("payment_id").agg(
        names(before).alias("sources_t1"), names(F.lit(True)).alias("sources_t2"), names(~before).alias("added"),
        F.count_if(~before).alias("n_added"),
    ).withColumn("diversity", F.when(F.col("n_added") > 0, "SOURCE_DIVERSITY_INCREASED").otherwise("NO_SOURCE_CHANGE")).drop("n_added")


def decision_diff(states: DataFrame, fact_changes: DataFrame, source_changes: DataFrame, t1: int, t2: int) -> DataFrame:
    """State at t1 against t2 with the categories of change, in a fixed order."""
    cols = ("integrity_status", "coverage_status", "reliability_state", "required_present", "required_missing", "conflict_count",
            "freshness", "source", "independence", "corroboration", "consistency")
    # both times of a payment meet in one aggregate instead of a self-join
    at = lambda c, t: F.max(F.when(F.col("eval_us") == t, F.col(c)))
    pair = states.filter(F.col("eval_us").isin(t1, t2)).groupBy("payment_id").agg(
        *[at(c, t1).alias(f"{c}_1") for c in cols], *[at(c, t2).alias(f"{c}_2") for c in cols])
    f = fact_changes.groupBy("payment_id").agg(
        F.count_if(F.col("category") == "ADDED").alias("facts_added"), F.count_if(F.col("category") == "CHANGED").alias("facts_changed"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = pair.join(f, "payment_id", "left").join(source_changes.select("payment_id", "diversity", "added"), "payment_id", "left")
    ne = lambda c: F.col(f"{c}_1") != F.col(f"{c}_2")
    any_dim = ne("integrity_status")
    for d in cols[6:]:
        any_dim = any_dim | ne(d)
    categories = E.parts(
        F.when(n("facts_added") > 0, "EVIDENCE_ADDED"), F.when(n("facts_changed") > 0, "EVIDENCE_CHANGED"),
        F.when(F.col("diversity") == "SOURCE_DIVERSITY_INCREASED", "SOURCE_ADDED"),
        F.when(F.col("conflict_count_2") > F.col("conflict_count_1"), "CONFLICT_ADDED"),
        F.when(F.col("conflict_count_2") < F.col("conflict_count_1"), "CONFLICT_RESOLVED"),
        F.when(ne("coverage_status") | ne("required_present") | ne("required_missing"), "COVERAGE_CHANGED"),
        F.when(ne("reliability_state"), "RELIABILITY_CHANGED"), F.when(any_dim, "INTEGRITY_CHANGED"))
    return j.select(
        "payment_id", *[c for s in cols[:3] for c in (f"{s}_1", f"{s}_2")], "conflict_count_1", "conflict_count_2",
        n("facts_added").alias("facts_added"), n("facts_changed").alias("facts_changed"), F.coalesce("added", F.lit("")).alias("sources_added"),
        F.array_join(categories, ",").alias("change_categories"))


def change_explanation(diff: DataFrame) -> DataFrame:
    moved = lambda s, label: F.when(F.col(f"{s}_1") != F.col(f"{s}_2"), F.concat(F.lit(label), F.col(f"{s}_1"), F.lit(" -> "), F.col(f"{s}_2")))
    count = lambda c, label: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(label)))
    steps = E.parts(
        count("facts_added", " new facts"), count("facts_changed", " facts gained observations"),
        F.when(F.col("sources_added") != "", F.concat(F.lit("new sources: "), F.col("sources_added"))),
        F.when(F.col("conflict_count_2") > F.col("conflict_count_1"),
               F.concat((F.col("conflict_count_2") - F.col("conflict_count_1")).cast("string"), F.lit(" new conflicts"))),
        moved("coverage_status", "coverage "), moved("reliability_state", "reliability "), moved("integrity_status", "integrity "))
    return diff.select("payment_id", F.when(F.size(steps) == 0, "no change").otherwise(E.text_list(steps)).alias("explanation"))
