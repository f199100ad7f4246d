"""Named intermediate frames over one data directory; nothing runs until a query asks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import skew
from veritrail.operators import canonical, conflicts, coverage, defense, facts, graph, integrity, ops, quality, reliability, risk, structure, sweep
from veritrail.session import cut_lineage
from veritrail.sources import defense_tables, driver_tables


def at(text: str) -> int:
    """UTC time -> microseconds."""
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


T_EVAL = at("2024-01-31T00:00:00")
T1, T2 = at("2024-01-10T00:00:00"), at("2024-01-20T00:00:00")
EVAL_POINTS = (T1, T2, T_EVAL)
T_DEFENSE = at("2001-03-01T00:00:00")
#: A payment of more events is spread over tasks.
MANY = 10_000


class Frames:
    def __init__(self, spark: SparkSession, sf_dir: str, points: tuple[int, ...] = EVAL_POINTS, owned: DataFrame | None = None, spread: bool = True):
        self.spark, self.sf_dir, self.points, self.owned, self.spread = spark, sf_dir, points, owned, spread

    def by_payment(self, build: Callable[[Frames], DataFrame]) -> DataFrame:
        """`build(frames)` for payments of few events, whose events are moved to one task before anything is made from them,
        and for those of many events, spread over tasks.

        What these frames derive payment by payment lies where the events do and is not moved again. They hold what belongs
        to payments only: observations, claims and facts of payments, and for `scoped` the order evidence that names them.
        """
        owned = canonical.by_owner(self.normalized)
        return skew.by_size(owned, "payment_id", MANY, lambda part, spread: build(Frames(self.spark, self.sf_dir, self.points, part, spread)))

    def keeping(self, *names: str) -> Frames:
        """The same frames, with some written once as shared tables that everything else is derived from.

        For queries that would otherwise compute a layer several times; the tables lie in the shared folder,
        so they survive lost executors. Where payments lie in one task each, the tables are laid there as well; each name
        is derived from those before it.
        """
        kept = Frames(self.spark, self.sf_dir, self.points, self.owned, self.spread)
        for name in names:  # cached_property reads the value from here
            table = cut_lineage(getattr(kept, name))
            kept.__dict__[name] = table if self.spread else table.repartition("payment_id")
        return kept

    def only_at(self, *points: int) -> Frames:
        """The same frames with other evaluation times."""
        return Frames(self.spark, self.sf_dir, points, self.owned, self.spread)

    def table(self, name: str) -> DataFrame:
        return driver_tables.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return driver_tables.events(self.spark, self.sf_dir)

    @cached_property
    def bodies(self) -> DataFrame:
        return driver_tables.bodies_of(self.events)

    @cached_property
    def deliveries(self) -> DataFrame:
        """Events as delivered: every ninth is sent again a minute later, every 23rd has no id."""
        again = self.events.withColumn(
            "delivery", F.explode(F.when(F.col("k") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        )
        return again.select(
            (F.col("event_id") * 2 + F.col("delivery")).alias("webhook_event_id"),
            F.when(F.col("k") % 23 != 0, F.col("provider_event_id")).alias("provider_event_id"),
            "event_type", "payment_id", "processing_status", "k",
            (F.col("received_at") + driver_tables.seconds(F.col("delivery") * 60)).alias("received_at"),
        )

    @cached_property
    def normalized(self) -> DataFrame:
        return canonical.normalize_events(self.events) if self.owned is None else self.owned.where("NOT named").drop("named", "payment_event_id")

    @cached_property
    def payment_events(self) -> DataFrame:
        return canonical.payment_events(self.normalized)

    @cached_property
    def payments(self) -> DataFrame:
        return canonical.fold_payments(self.normalized, self.spread)

    @cached_property
    def orders(self) -> DataFrame:
        return canonical.fold_orders(self.normalized)

    @cached_property
    def observations(self) -> DataFrame:
        if self.owned is not None:
            return canonical.owned_evidence(self.owned)
        return canonical.extract_evidence(self.normalized)

    @cached_property
    def payment_obs(self) -> DataFrame:
        return canonical.payment_scope(self.observations)

    @cached_property
    def claim_rows(self) -> DataFrame:
        return structure.claim_rows(self.observations)

    @cached_property
    def claims(self) -> DataFrame:
        return structure.build_claims(self.claim_rows)

    @cached_property
    def payment_claims(self) -> DataFrame:
        return structure.payment_claims(self.claims)

    @cached_property
    def status_conflicts(self) -> DataFrame:
        return conflicts.status_conflicts(self.payment_claims)

    @cached_property
    def fact_rows(self) -> DataFrame:
        return facts.fact_rows(self.payment_obs)

    @cached_property
    def facts(self) -> DataFrame:
        return facts.build_facts(self.fact_rows)

    @cached_property
    def scoped(self) -> DataFrame:
        return structure.structure_scope(self.observations) if self.owned is None else canonical.owned_scope(self.owned)

    @cached_property
    def conflict_profile(self) -> DataFrame:
        return conflicts.conflict_profile(self.payment_claims)

    @cached_property
    def coverage_flags(self) -> DataFrame:
        return coverage.payment_flags(self.payments, self.facts, self.payment_obs, self.conflict_profile)

    @cached_property
    def coverage(self) -> DataFrame:
        return coverage.coverage_results(self.coverage_flags)

    @cached_property
    def fact_reliability(self) -> DataFrame:
        found = self.conflict_profile.select("payment_id", F.col("conflict_count").alias("n"))
        return reliability.fact_reliability(self.fact_rows, found)

    @cached_property
    def dimensions_now(self) -> DataFrame:
        return integrity.dimensions(self.scoped, self.payment_claims, (T_EVAL,))

    @cached_property
    def integrity_now(self) -> DataFrame:
        return integrity.integrity(self.dimensions_now)

    @cached_property
    def integrity_history(self) -> DataFrame:
        return integrity.integrity(integrity.dimensions(self.scoped, self.payment_claims, self.points))

    @cached_property
    def order_payments(self) -> DataFrame:
        return driver_tables.order_payments(self.spark, self.sf_dir)

    @cached_property
    def all_payments(self) -> DataFrame:
        return canonical.payment_amounts(self.normalized).unionByName(
            self.order_payments.select("payment_id", "amount_minor"))

    @cached_property
    def evidence_totals(self) -> DataFrame:
        return risk.evidence_totals(self.payment_obs)

    @cached_property
    def conflicts_by_type(self) -> DataFrame:
        single = self.status_conflicts.groupBy("payment_id", "conflict_type", "severity").agg(F.count("*").alias("n"))
        sets = conflicts.conflict_sets(self.payment_claims).groupBy("payment_id", "conflict_type", "severity").agg(
            F.sum("conflict_count").alias("n"))
        return single.unionByName(sets)

    @cached_property
    def structure(self) -> DataFrame:
        return structure.structure_snapshot(self.scoped)

    @cached_property
    def coverage_summary(self) -> DataFrame:
        return coverage.coverage_summary(self.coverage)

    @cached_property
    def risk_scores(self) -> DataFrame:
        return risk.risk_score(self.payments, self.evidence_totals, self.conflict_profile, self.coverage_summary,
                               self.structure, T_EVAL)

    @cached_property
    def fraud_signals(self) -> DataFrame:
        return risk.fraud_signals(self.all_payments, self.evidence_totals, self.conflict_profile,
                                  risk.velocity(self.payment_events))

    @cached_property
    def layer_freshness(self) -> DataFrame:
        per = self.facts.groupBy("payment_id").agg(F.max("last_us").alias("m"), F.min("first_us").alias("f"))
        return ops.stage_freshness(self.evidence_totals.select("payment_id", "latest_us"), {
            "facts": per.select("payment_id", F.col("m").alias("eval_us")),
            "coverage": per.select("payment_id", F.lit(T_EVAL).alias("eval_us")),
            "integrity": per.select("payment_id", F.when(F.col("f") <= T2, F.lit(T2)).alias("eval_us")),
        })

    # --- the same operators at all evaluation points in one pass, from what was visible at each ---

    @cached_property
    def observations_at(self) -> DataFrame:
        return quality.at_points(self.observations, self.points)

    @cached_property
    def payments_at(self) -> DataFrame:
        return self.payments.withColumn("eval_us", F.explode(F.array(*[F.lit(p) for p in self.points])))

    @cached_property
    def payment_obs_at(self) -> DataFrame:
        return canonical.payment_scope(self.observations_at)

    @cached_property
    def claims_at(self) -> DataFrame:
        return structure.claims_through(self.claim_rows, self.points)

    @cached_property
    def profile_at(self) -> DataFrame:
        return conflicts.conflict_profile_at(self.claims_at, self.points)

    @cached_property
    def fact_rows_at(self) -> DataFrame:
        return facts.fact_rows(self.payment_obs_at)

    @cached_property
    def facts_at(self) -> DataFrame:
        return facts.facts_through(self.fact_rows, self.points)

    @cached_property
    def coverage_at(self) -> DataFrame:
        flags = coverage.payment_flags(self.payments_at, self.facts_at, self.payment_obs_at, self.profile_at)
        return coverage.coverage_summary(coverage.coverage_results(flags))

    @cached_property
    def reliability_at(self) -> DataFrame:
        found = self.profile_at.select("payment_id", "eval_us", F.col("conflict_count").alias("n"))
        return reliability.payment_reliability(reliability.fact_reliability(self.fact_rows_at, found), self.payments_at)

    @cached_property
    def integrity_at(self) -> DataFrame:
        """A few times common to all payments: counters for each of them in one pass are cheaper than sums along time."""
        return integrity.integrity(integrity.dimensions(self.scoped, None, self.points, self.profile_at))

    @cached_property
    def integrity_own(self) -> DataFrame:
        """Integrity at each payment's own evaluation times: whenever something was observed."""
        return sweep.by_size(self.scoped, lambda part, spread: integrity.integrity(sweep.dimensions_own(part(self.scoped), spread)))

    def integrity_as_processed(self, columns: list[str]) -> DataFrame:
        """Each processed event with columns of the latest integrity of its payment at its own times."""
        def build(part, spread):
            known = integrity.integrity(sweep.dimensions_own(part(self.scoped), spread))
            return skew.as_of_join(part(self.processed), known, ["payment_id"], "processed_us", "eval_us", columns, spread)
        return sweep.by_size(self.scoped, build)

    @cached_property
    def processed(self) -> DataFrame:
        """When each event of a payment was processed, after it was observed."""
        return self.normalized.select("payment_id", "event_id", F.unix_micros("processed_at").alias("processed_us"))

    @cached_property
    def traces(self) -> DataFrame:
        from veritrail.operators import trace
        return trace.canonical_trace(self.integrity_history)

    # --- defense ---

    @cached_property
    def cases(self) -> DataFrame:
        return defense_tables.cases(self.spark, self.sf_dir)

    @cached_property
    def defense_claims(self) -> DataFrame:
        return defense_tables.claims(self.cases)

    @cached_property
    def defense_links(self) -> DataFrame:
        return defense_tables.evidence(self.spark, self.sf_dir, self.defense_claims)

    @cached_property
    def claim_verdicts(self) -> DataFrame:
        return defense.claim_verdicts(self.defense_claims, self.defense_links, T_DEFENSE)

    @cached_property
    def predictions(self) -> DataFrame:
        return defense.case_verdicts(self.cases, self.claim_verdicts)

    @cached_property
    def candidates(self) -> DataFrame:
        """Evidence by the payment it is about."""
        return self.defense_links.select(
            F.expr("concat('pay_o', l_orderkey)").alias("payment_reference"), "evidence_id", "evidence_type", "value",
            "source_type", "source_reference", "observed_us", "valid_until_us")

    @cached_property
    def extracted_claims(self) -> DataFrame:
        found = defense.extract_claims(self.cases, "case_id", "description").filter("claim_type IS NOT NULL")
        return found.select("case_id", "claim_type", F.concat_ws(":", "case_id", "claim_type").alias("claim_id")).join(
            self.cases.select("case_id", "payment_reference"), "case_id")

    @cached_property
    def investigation_edges(self) -> DataFrame:
        snaps = self.conflict_profile.select("payment_id", F.lit(T_EVAL).alias("eval_us"))
        return graph.investigation_edges(
            self.payments, self.payment_events, self.payment_obs, self.claim_rows, self.status_conflicts,
            conflicts.conflict_members(self.payment_claims), snaps)
