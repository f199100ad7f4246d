"""Hash-chained audit traces of integrity evaluations and their verification.

A trace is one evaluation of one payment, so a payment has as many traces as there were
evaluation runs; ordering within a payment is ordering over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import expr as E
from veritrail.functions import vocab as V
from veritrail.operators.integrity import KEY, gate_log

DIMENSIONS = ("consistency", "corroboration", "freshness", "independence", "source")
# sections compared by a trace diff, most telling first
SECTIONS = ("evidence_count", "source_count", *DIMENSIONS, "conflict_count", "overall_status")


def content_json() -> Column:
    """Canonical content: keys in alphabetical order, no spaces, NULLs kept, integers as integers."""
    return F.to_json(F.struct(
        F.col("conflict_count"), F.struct(*[F.col(d) for d in DIMENSIONS]).alias("dimensions"),
        F.date_format(F.timestamp_micros("eval_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("evaluated_at"),
        F.col("evidence_count"), F.lit(V.METHODOLOGY).alias("methodology_version"), F.col("overall_status"),
        F.col("payment_id"), F.col("source_count"),
    ), {"ignoreNullFields": "false"})


def link_hash(content: Column, previous: Column) -> Column:
    quoted = F.coalesce(F.concat(F.lit('"'), previous, F.lit('"')), F.lit("null"))
    return F.sha2(F.concat(F.lit('{"content":'), content, F.lit(',"previous_trace_hash":'), quoted, F.lit("}")), 256)


def canonical_trace(history: DataFrame) -> DataFrame:
    """Content, hash and predecessor of every evaluation, chained per payment by evaluation time."""
    trace_id = E.key_hash(F.col("payment_id"), F.col("eval_us").cast("string"), F.lit(V.METHODOLOGY))
    rows = history.select(*KEY, *SECTIONS, trace_id.alias("trace_id"), content_json().alias("content"))
    item = F.struct("eval_us", "trace_id", "content", *SECTIONS)
    per = rows.groupBy("payment_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    hashes = F.aggregate(
        "t", F.array().cast("array<string>"),
        lambda acc, x: F.concat(acc, F.array(link_hash(x["content"], F.try_element_at(acc, F.lit(-1))))))
    chained = per.withColumn("h", hashes).select("payment_id", "t", "h", F.posexplode("t").alias("pos", "x"))
    later = lambda value: F.when(F.col("pos") > 0, value)
    return chained.select(
        "payment_id", "x.*", F.col("h")[F.col("pos")].alias("trace_hash"),
        later(F.element_at("t", F.greatest("pos", F.lit(1)))["trace_id"]).alias("previous_trace_id"),
        later(F.element_at("h", F.greatest("pos", F.lit(1)))).alias("previous_trace_hash"), F.lit("COMPLETED").alias("status"))


def trace_verify(traces: DataFrame) -> DataFrame:
    again = link_hash(F.col("content"), F.col("previous_trace_hash"))
    return traces.select(
        "payment_id", "trace_id",
        F.when(F.col("trace_hash").isNull() | F.col("content").isNull(), "VERIFICATION_UNAVAILABLE")
        .when(again == F.col("trace_hash"), "VALID").otherwise("INVALID").alias("verification"))


def chain_verify(traces: DataFrame) -> DataFrame:
    """Problems of each payment's chain and the verdict."""
    w = Window.partitionBy("payment_id").orderBy("eval_us", "trace_id")
    rows = traces.select(
        "*", F.row_number().over(w).alias("i"), F.lag("trace_hash").over(w).alias("ph"), F.lag("trace_id").over(w).alias("pi"))
    gone = F.col("trace_hash").isNull() | F.col("content").isNull()
    first = F.col("i") == 1
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    issues = F.when(gone, F.array(F.lit("MISSING_HASH_OR_PAYLOAD"))).otherwise(E.parts(
        F.when(link_hash(F.col("content"), F.col("previous_trace_hash")) != F.col("trace_hash"), "HASH_MISMATCH"),
        F.when(first & F.col("previous_trace_hash").isNotNull(), "DANGLING_PREVIOUS_HASH"),
        F.when(~first & ~same("previous_trace_hash", "ph"), "BROKEN_LINK_HASH"),
        F.when(~first & ~same("previous_trace_id", "pi"), "BROKEN_LINK_ID")))
    return rows.withColumn("issues", issues).groupBy("payment_id").agg(
        F.count("*").alias("verified_count"), F.sum(F.size("issues")).alias("problems"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))), ",").alias("issues"),
    ).withColumn("status", F.when(F.col("problems") > 0, "CHAIN_INVALID").when(F.col("verified_count") == 1, "CHAIN_START")
                 .otherwise("CHAIN_VALID"))


def trace_events(dims: DataFrame) -> DataFrame:
    """Ordered audit events of each evaluation: stages, one event per evaluated gate, the result."""
    gates = gate_log(dims)
    gate_rows = gates.select(*KEY, (F.col("execution_order") + 3).alias("seq"), F.lit("RULE_EXECUTED").alias("event_type"),
                             F.concat_ws(":", "rule_id", F.col("fired").cast("string")).alias("detail"))
    fired = gates.filter("fired").select(*KEY, (F.col("execution_order") + 3).alias("last"))
    head = dims.select(*KEY, F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit("TRACE_STARTED").alias("event_type"), F.lit("EVALUATION").alias("detail")),
        F.struct(F.lit(2).cast("bigint").alias("seq"), F.lit("EVIDENCE_SCOPED").alias("event_type"), F.col("evidence_count").cast("string").alias("detail")),
        F.struct(F.lit(3).cast("bigint").alias("seq"), F.lit("DIMENSIONS_COMPUTED").alias("event_type"), F.lit(",".join(DIMENSIONS)).alias("detail")),
    )).alias("e")).select(*KEY, "e.*")
    tail = fired.select(*KEY, (F.col("last") + 1).alias("seq"), F.lit("TRACE_FINALIZED").alias("event_type"), F.lit("COMPLETED").alias("detail"))
    return head.unionByName(gate_rows).unionByName(tail)


def trace_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two evaluations of each payment compared section by section, in priority order."""
    left = a.select("payment_id", *[F.col(s).alias(f"a_{s}") for s in SECTIONS])
    right = b.select("payment_id", *[F.col(s).alias(f"b_{s}") for s in SECTIONS])
    paths = E.parts(*[F.when(~F.col(f"a_{s}").eqNullSafe(F.col(f"b_{s}")), s) for s in SECTIONS])
    return left.join(right, "payment_id").select("payment_id", paths.alias("p")).select(
        "payment_id", F.when(F.size("p") == 0, "MATCH").otherwise("MISMATCH").alias("comparison"),
        F.try_element_at("p", F.lit(1)).alias("first_difference"), F.array_join("p", ",").alias("differences"))


def trace_for_snapshot(snapshots: DataFrame, traces: DataFrame, reach_us: int = 5_000_000) -> DataFrame:
    """Earliest trace within reach of each snapshot of the same payment.

    Both sides carry the time bucket of the reach, so the match stays an equi-join.
    """
    s = snapshots.select("payment_id", "eval_us", F.explode(F.array(*[F.floor(F.col("eval_us") / reach_us) + d for d in (-1, 0, 1)])).alias("b"))
    t = traces.select("payment_id", "trace_id", "traced_us", F.floor(F.col("traced_us") / reach_us).alias("b"))
    hit = s.join(t, ["payment_id", "b"]).filter(F.abs(F.col("traced_us") - F.col("eval_us")) <= reach_us)
    best = hit.groupBy("payment_id", "eval_us").agg(F.min_by("trace_id", F.struct("traced_us", "trace_id")).alias("trace_id"))
    return snapshots.select("payment_id", "eval_us").join(best, ["payment_id", "eval_us"], "left")
