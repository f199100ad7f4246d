"""Ordered computations that stay distributed when one key holds a large share of rows.

A plain window partitioned by a hot key sorts that whole key in one task. These helpers cut
each key into time chunks, and chunks into coarser ones: every level is pre-aggregated map-side
from the one below, rows are ordered only inside their finest chunk, chunks only inside the next
coarser chunk, and per key only the few coarsest chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.session import cut_lineage

SECOND_US, HOUR_US = 1_000_000, 3_600_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is never sent whole to the driver and all tasks.

    Rows exploded from events take many times the size that the planner guesses from the files, so it would
    broadcast tables that grow with the data.
    """
    return df.hint("merge")


def meet(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Frames with at most one row a key side by side, as full outer joins on the keys put them; no key is null.

    One aggregation of all rows: where they all lie by a part of the keys already, nothing is moved, which a join on all
    the keys would do. The frames' other columns have different names.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys])


def keys_of_many(rows: DataFrame, key: str, many: int) -> DataFrame | None:
    """The keys with more than so many rows, written once; None where there is none. They are at most a `many`-th of the rows."""
    found = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select(key))
    return None if found.isEmpty() else found


def by_size(rows: DataFrame, key: str, many: int, build: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """`build(part, spread)` for the rows of keys of at most `many` rows, each key in one task, and for the others where they lie."""
    hot = keys_of_many(rows, key, many)
    if hot is None:
        return build(rows.repartition(key), False)
    few, rest = (rows.join(F.broadcast(hot), key, how) for how in ("left_anti", "left_semi"))
    return build(few.repartition(key), False).unionByName(build(rest, True))


def time_chunks(us: Column) -> list[Column]:
    """Seconds inside hours: a task orders one second of a key, or 3600 seconds, or its hours."""
    return [F.floor(us / SECOND_US), F.floor(us / HOUR_US)]


def _by_levels(rows: DataFrame, keys: list[str], levels: list[str], order: list[str], inside: Callable, reduce_chunk: Callable,
               merge: Callable) -> DataFrame:
    """Adds __out to rows (with __v): `inside` over the finest chunk merged with what precedes it."""
    if not levels:
        return rows.withColumn("__out", inside(Window.partitionBy(*keys).orderBy(*order)))
    cells = rows.groupBy(*keys, *levels).agg(reduce_chunk(order).alias("__v"))
    before = _by_levels(cells, keys, levels[1:], [levels[0]], inside, reduce_chunk, merge).select(
        *keys, *levels, F.col("__out").alias("__before"))
    w = Window.partitionBy(*keys, *levels).orderBy(*order)
    return rows.withColumn("__in", inside(w)).join(before, [*keys, *levels]).withColumn(
        "__out", merge(F.col("__before"), F.col("__in"))).drop("__before", "__in")


def _with_levels(df: DataFrame, chunks: list[Column], value: Column) -> tuple[DataFrame, list[str]]:
    names = [f"__c{i}" for i in range(len(chunks))]
    return df.select("*", *[c.alias(n) for c, n in zip(chunks, names)], value.alias("__v")), names


def prefix_before(
    df: DataFrame, keys: list[str], order: list[str], chunks: list[Column], value: Column, how: str, out: str
) -> DataFrame:
    """Adds `out` = how(value) over all rows of the key strictly before this one.

    `chunks` run from fine to coarse and must not decrease in `order`. `how` is "max" or "sum".
    """
    agg = {"max": F.max, "sum": F.sum}[how]
    merge = {
        "max": lambda a, b: F.greatest(a, b),
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }[how]
    rows, levels = _with_levels(df, chunks, value)
    done = _by_levels(
        rows, keys, levels, order, lambda w: agg("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda _o: agg("__v"), merge)
    result = F.coalesce("__out", F.lit(0)) if how == "sum" else F.col("__out")
    return done.withColumn(out, result).drop("__out", "__v", *levels)


def near_sums(df: DataFrame, keys: list[str], ts_us: str, width_us: int, value: str) -> DataFrame:
    """Adds `before` and `around`: sums of `value` over rows of the key with time in
    [ts - width, ts] and [ts - width, ts + width], exact.

    Rows are bucketed by the width and also visit both neighbouring buckets, so a window never
    spans more than three buckets of one key.
    """
    bucket = F.floor(F.col(ts_us) / F.lit(width_us))
    spread = df.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumn(
        "__home", F.col("__b") == bucket
    )
    w = Window.partitionBy(*keys, "__b").orderBy(ts_us)
    return (
        spread.withColumn("before", F.sum(value).over(w.rangeBetween(-width_us, 0)))
        .withColumn("around", F.sum(value).over(w.rangeBetween(-width_us, width_us)))
        .filter("__home").drop("__b", "__home")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], chunks: list[Column], value: Column, out: str
) -> DataFrame:
    """Adds `out`, the value of the row just before this one within the key (NULL for the first)."""
    rows, levels = _with_levels(df, chunks, F.struct(value.alias("v")))
    done = _by_levels(
        rows, keys, levels, order, lambda w: F.lag("__v").over(w), lambda o: F.max_by("__v", F.struct(*o)),
        lambda before, inside: F.coalesce(inside, before))
    return done.withColumn(out, F.col("__out")["v"]).drop("__out", "__v", *levels)


def running_sums(df: DataFrame, keys: list[str], order: list[str], chunks: list[Column], values: list[str]) -> DataFrame:
    """Replaces each of `values` by its sum over all rows of the key up to and with this one.

    `chunks` run from fine to coarse and must not decrease in `order`; rows of a key have different places in it.
    """
    names = [f"__c{i}" for i in range(len(chunks))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(chunks, names)])
    return _sums_before(rows, keys, names, order, values, 0).drop(*names)


def _sums_before(rows: DataFrame, keys: list[str], levels: list[str], order: list[str], values: list[str], last: int) -> DataFrame:
    w = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    inside = rows.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    if not levels:
        return inside
    cells = rows.groupBy(*keys, *levels).agg(*[F.sum(v).alias(v) for v in values])
    before = _sums_before(cells, keys, levels[1:], [levels[0]], values, -1).withColumnsRenamed({v: f"__{v}" for v in values})
    joined = inside.join(before, [*keys, *levels])
    return joined.withColumns({v: F.col(v) + F.col(f"__{v}") for v in values}).drop(*[f"__{v}" for v in values])


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str, columns: list[str],
               spread: bool = True) -> DataFrame:
    """Rows of `left` with the `columns` of the latest row of `right` of their key at or before their time, or nulls.

    Both sides become one sequence per key in which the last row of the right side is carried forward, second by
    second inside hours, so any number of times of a key, on either side, is spread over tasks and no pair of
    rows is ever made. Of rows of the right side at one time, the one with the greatest columns counts. Rows without
    a key or time are left out. Without `spread` each key is put in order by one task, which is for keys of few rows.
    """
    value = F.struct(*columns)
    a = left.select(*keys, F.col(left_us).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    b = right.select(*keys, F.col(right_us).alias("__at"), F.lit(0).alias("__side"), value.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.dropna(subset=[*keys, "__at"])
    names = ["__c0", "__c1"] if spread else []
    rows = both.select("*", *[c.alias(n) for c, n in zip(time_chunks(F.col("__at")), names)])
    done = _by_levels(
        rows, keys, names, ["__at", "__side", "__v"], lambda w: F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda o: F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*o))), lambda before, here: F.coalesce(here, before))
    return done.where("__side = 1").select("__row.*", *[F.col("__out")[c].alias(c) for c in columns])
