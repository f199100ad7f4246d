"""Structured Streaming forms: landing, dedup, hourly trend, payment state, incremental feed."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.functions.skew import prefix_before, time_chunks
from veritrail.operators import canonical
from veritrail.session import folders, shared_folder
from veritrail.sources import driver_tables, landing

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Received events from a parquet file or a folder of them. The checkpoint is the exactly-once cursor and
    files_per_trigger bounds what one poll takes."""
    either = f"{path[:-1]}[{path[-1]}]"  # a stream's plain path has to be a folder, what a pattern matches can be both
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(either)
    # event-time watermarks need an instant, the files hold local UTC timestamps
    return driver_tables.shape_events(raw.select(
        "event_id", "user_id", "value", F.col("event_type").alias("raw_type"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k")))


def body_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw webhook bodies, one JSON document per line, parsed like the batch form."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "body")
    return landing.landing(lines.select(F.lit(None).cast("bigint").alias("event_id"), F.current_timestamp().alias("received_at"), "body"))


def dedup(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """At most one delivery per provider event id while the watermark keeps it in state.

    Deliveries without an id cannot repeat one another and bypass the state.
    """
    marked = stream.withWatermark("received_at", delay)
    keyed = marked.filter("provider_event_id IS NOT NULL").dropDuplicatesWithinWatermark(["provider_event_id"])
    return keyed.unionByName(marked.filter("provider_event_id IS NULL"))


def hourly_trend(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Failures and captures per tumbling hour."""
    norm = canonical.normalize_events(stream).withWatermark("observed_at", delay)
    return norm.groupBy(F.window("observed_at", "1 hour").alias("w")).agg(
        F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "captured").alias("captures"),
    ).select(F.unix_micros("w.start").alias("start_us"), "failures", "captures")


STATE = "payment_id string, rank int, status string, captured boolean, last_us bigint, event_count bigint"


def fold_onto(before: DataFrame, events: DataFrame) -> DataFrame:
    """State rows (STATE) after a batch of events on top of `before`, as if events were applied one by one in
    arrival order: a status is taken if its rank is higher, or equal and the event later than all before it.

    The batch is first reduced to a row per payment, with the running maximum of event times taken in time
    chunks, so that a payment with a great part of a batch is ordered nowhere as a whole.
    """
    rows = canonical.normalize_events(events).filter("payment_id <> ''").select(
        "payment_id", "event_id", "status", driver_tables.lookup("status", V.STATUS_RANK, 0).cast("int").alias("rank"),
        F.unix_micros("received_at").alias("received_us"), F.unix_micros(F.coalesce("observed_at", "received_at")).alias("event_us"))
    rows = prefix_before(rows, ["payment_id"], ["received_us", "event_id"], time_chunks(F.col("received_us")), F.col("event_us"), "max", "seen_us")
    rows = rows.join(before.select("payment_id", F.col("last_us").alias("start_us")), "payment_id", "left")
    seen, arrival = F.greatest("seen_us", "start_us"), F.struct("received_us", "event_id")
    later = seen.isNull() | (F.col("event_us") > seen)
    top = rows.groupBy("payment_id", "rank").agg(
        F.min_by("status", arrival).alias("first"), F.max_by(F.when(later, F.col("status")), F.when(later, arrival)).alias("latest"),
        F.max(later & (F.col("status") == "captured")).alias("captured"), F.count("*").alias("n"), F.max("event_us").alias("until_us"),
    ).groupBy("payment_id").agg(
        F.max("rank").alias("top_rank"), F.max_by(F.struct("first", "latest", "captured"), "rank").alias("top"),
        F.sum("n").alias("n"), F.max("until_us").alias("until_us"))
    both = before.join(top, "payment_id", "full")
    old = F.coalesce("rank", F.lit(-1))
    higher, same = F.coalesce(F.col("top_rank") > old, F.lit(False)), F.coalesce(F.col("top_rank") == old, F.lit(False))
    return both.select(
        "payment_id", F.greatest("rank", "top_rank").alias("rank"),
        F.when(higher, F.coalesce("top.latest", "top.first")).when(same, F.coalesce("top.latest", "status")).otherwise(F.col("status")).alias("status"),
        (F.coalesce("captured", F.lit(False)) | (higher & (F.col("top.captured") | (F.col("top.first") == "captured"))) | (same & F.col("top.captured"))).alias("captured"),
        F.greatest("last_us", "until_us").alias("last_us"), (F.coalesce("event_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("event_count"))


#: Batches whose changes are kept apart before the state is written as a whole again.
COMPACT_AFTER = 16


def state_of(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """State rows (STATE) as written in `folder` by the batches before `until`: the last whole and the changes since."""
    ids = {kind: [int(n[len(kind):]) for n in folders(spark, f"{folder}/state") if n.startswith(kind)] for kind in ("whole-", "changes-")}
    known = {kind: [i for i in found if until is None or i < until] for kind, found in ids.items()}
    base = max(known["whole-"], default=-1)
    parts = [f"{folder}/state/whole-{base}"] if base >= 0 else []
    tables = [(base, p) for p in parts] + [(i, f"{folder}/state/changes-{i}") for i in known["changes-"] if i > base]
    if not tables:
        return spark.createDataFrame([], STATE)
    rows = [spark.read.schema(STATE).parquet(p).withColumn("batch", F.lit(i)) for i, p in tables]
    names = [c for c in rows[0].columns if c not in ("payment_id", "batch")]
    both = reduce(DataFrame.unionByName, rows)
    return both.groupBy("payment_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("payment_id", "r.*")


def stateful_payments(stream: DataFrame, folder: str | None = None, compact_after: int = COMPACT_AFTER) -> DataFrame:
    """Payment status carried across the batches of an event stream, run over everything available.

    `folder` holds the stream's checkpoint and its state, both in the shared file system; started again with the
    same folder, in this session or another, the stream goes on where it ended. Without one a new folder is taken.
    Each batch writes the rows of the payments it touches, and now and then the whole state is written, so what a
    batch costs follows the batch. One that is run again reads what lay before it and overwrites its own, so
    nothing is applied twice. A payment's state never expires: a late event must still meet it. All work is done by
    joins and partial aggregates, none in Python workers.
    """
    spark = stream.sparkSession
    base = (folder or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}").rstrip("/")

    def advance(batch: DataFrame, batch_id: int) -> None:
        touched = canonical.normalize_events(batch).select("payment_id").distinct()
        before = state_of(spark, base, batch_id).join(touched, "payment_id", "left_semi")
        fold_onto(before, batch).write.mode("overwrite").parquet(f"{base}/state/changes-{batch_id}")
        wholes = [int(n[6:]) for n in folders(spark, f"{base}/state") if n.startswith("whole-") and int(n[6:]) < batch_id]
        if batch_id - max(wholes, default=-1) >= compact_after:
            state_of(spark, base, batch_id + 1).write.mode("overwrite").parquet(f"{base}/state/whole-{batch_id}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(advance).start().awaitTermination()
    return state_of(spark, base).drop("rank")


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over everything available, keeping each batch as a table in the shared folder,
    and return the latest row per key.

    A batch that is run again after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    kept: list[int] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        kept.append(batch_id)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    if not kept:  # nothing was there to read
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", "false").option("basePath", f"{base}/out").parquet(f"{base}/out/*")
    if not keys:
        return out.select(*stream.columns)
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def upsert_new(batch: DataFrame, path: str, key: list[str]) -> None:
    """foreachBatch sink that only adds rows not stored yet."""
    landing.append_if_absent(batch, path, key)
