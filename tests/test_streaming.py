"""Streams over files against the batch form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.operators import canonical
from veritrail.plans.frames import Frames
from veritrail.session import cut_lineage
from veritrail.sources import driver_tables
from veritrail.streaming import pipeline


def as_set(df):
    return {tuple(r) for r in df.collect()}


def one_by_one(events):
    """(payment, rank, status, event time) in arrival order, applied to small states."""
    state = {}
    for payment, rank, status, t in events:
        r, s, captured, last, n = state.get(payment, (-1, "unknown", False, -(2**62), 0))
        if rank > r or (rank == r and t > last):
            r, s, captured = rank, status, captured or status == "captured"
        state[payment] = (r, s, captured, max(last, t), n + 1)
    return {(p, s, c, last, n) for p, (_, s, c, last, n) in state.items()}


@pytest.mark.parametrize("files", [1, 4])
@pytest.mark.parametrize("reverse", [False, True])
def test_payment_state_over_batches(spark, sf, tmp_path, files, reverse):
    src = str(tmp_path / "in")
    # files are taken one per batch, so state has to carry over; some payments stand in several, in any order of arrival
    parts = spark.read.parquet(f"{sf}/events.parquet").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(files)))
    for i in range(files):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(src)
    stream = pipeline.event_stream(spark, src, files_per_trigger=1)
    got = as_set(pipeline.stateful_payments(stream).select("payment_id", "status", "captured", "last_us", "event_count"))
    order = [F.desc("received_us"), F.desc("event_id")] if reverse else ["received_us", "event_id"]
    rows = canonical.normalize_events(driver_tables.events(spark, sf)).filter("payment_id <> ''").select(
        "payment_id", driver_tables.lookup("status", V.STATUS_RANK, 0).alias("rank"), "status", F.unix_micros(F.coalesce("observed_at", "received_at")).alias("t"),
        F.unix_micros("received_at").alias("received_us"), "event_id", F.pmod(F.xxhash64("event_id"), F.lit(files)).alias("part"))
    if reverse:  # the same fold on frames, batch by batch, each handed over in reverse
        state = spark.createDataFrame([], pipeline.STATE)
        for i in range(files):
            batch = driver_tables.events(spark, sf).where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == i).orderBy(F.desc("event_id"))
            state = cut_lineage(pipeline.fold_onto(state, batch))
        got = as_set(state.select("payment_id", "status", "captured", "last_us", "event_count"))
        order = ["received_us", "event_id"]
    assert got == one_by_one([tuple(r)[:4] for r in rows.orderBy("part", *order).collect()])
    if files == 1:
        assert got == as_set(Frames(spark, sf).payments.select("payment_id", "status", "captured", F.unix_micros("last_observed_at"), "event_count"))


def test_state_goes_on_after_a_restart(spark, sf, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "stream")
    parts = spark.read.parquet(f"{sf}/events.parquet").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(5)))
    taken, written = [], []
    for i in range(5):  # each time with a session and a stream of its own, over one more file
        session = spark.newSession()
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(src)
        got = pipeline.stateful_payments(pipeline.event_stream(session, src), folder, compact_after=3)
        taken.append(got.agg(F.sum("event_count")).first()[0])
        written.append(session.read.parquet(f"{folder}/state/changes-{i}").count())
    rows = canonical.normalize_events(driver_tables.events(spark, sf)).filter("payment_id <> ''").select(
        "payment_id", driver_tables.lookup("status", V.STATUS_RANK, 0).alias("rank"), "status", F.unix_micros(F.coalesce("observed_at", "received_at")).alias("t"),
        F.unix_micros("received_at").alias("received_us"), "event_id", F.pmod(F.xxhash64("event_id"), F.lit(5)).alias("part"))
    assert as_set(got.select("payment_id", "status", "captured", "last_us", "event_count")) == one_by_one(
        [tuple(r)[:4] for r in rows.orderBy("part", "received_us", "event_id").collect()])
    per_part = [r["n"] for r in rows.groupBy("part").agg(F.count_distinct("payment_id").alias("n")).orderBy("part").collect()]
    assert written == per_part and taken == sorted(taken) and taken[-1] == rows.count()
    assert as_set(pipeline.stateful_payments(pipeline.event_stream(spark.newSession(), src), folder)) == as_set(got)


def test_one_busy_payment(spark):
    """Forty events of one payment, given in reverse order of arrival: the later capture wins."""
    ev = driver_tables.shape_events(spark.sql("""
        SELECT id AS event_id, 1L AS user_id, 10.0D AS value, IF(id % 2 = 0, 'purchase', 'error') AS raw_type,
          timestamp'2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, id * 60) AS observed_at, id AS k FROM range(40)""").orderBy(F.desc("event_id")))
    got = pipeline.fold_onto(spark.createDataFrame([], pipeline.STATE), ev).drop("rank")
    want = canonical.fold_payments(canonical.normalize_events(ev)).select("payment_id", "status", "captured", F.unix_micros("last_observed_at"), "event_count")
    assert as_set(got) == as_set(want) and got.first()["captured"]


def test_empty_stream(spark, sf, tmp_path):
    src = str(tmp_path / "none")
    spark.read.parquet(f"{sf}/events.parquet").where("false").coalesce(1).write.parquet(src)
    assert pipeline.stateful_payments(pipeline.event_stream(spark, src)).count() == 0


def test_single_file_is_a_stream_too(spark, sf):
    assert pipeline.stateful_payments(pipeline.event_stream(spark, f"{sf}/events.parquet")).count() == Frames(spark, sf).payments.count()


def test_dedup_stream_keeps_null_ids(spark, tmp_path):
    src = str(tmp_path / "d")
    rows = [(1, "e1", "2026-01-01 00:00:00"), (2, "e1", "2026-01-01 00:01:00"), (3, None, "2026-01-01 00:00:00"), (4, None, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id bigint, provider_event_id string, t string").withColumn("received_at", F.to_timestamp("t"))
    df.write.parquet(src)
    out = pipeline.drain(pipeline.dedup(spark.readStream.schema(df.schema).parquet(src)), [], "append")
    assert sorted(r.provider_event_id or "" for r in out.collect()) == ["", "", "e1"]


def test_feed_is_exactly_once(spark, sf, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    run = lambda: spark.readStream.schema(ev.schema).parquet(src).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    ev.filter("event_id < 300").write.parquet(src)
    run()
    ev.filter("event_id BETWEEN 300 AND 499").write.mode("append").parquet(src)
    run()
    run()
    ids = [r.event_id for r in spark.read.parquet(out).collect()]
    assert len(ids) == len(set(ids)) == 500


def test_upsert_sink_survives_replay(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id bigint")
    path = str(tmp_path / "s")
    pipeline.upsert_new(df, path, ["id"])
    pipeline.upsert_new(df, path, ["id"])
    assert spark.read.parquet(path).count() == 2
