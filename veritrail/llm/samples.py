"""Bounded samples of labelled rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, chars: int, per_label: int | None = None) -> pd.DataFrame:
    """text and label of at most `rows` labelled rows, of at most `chars` characters together.

    Rows are taken in the order of a hash of the id, so the sample is the same each time and spread over the
    table. `per_label` bounds each label by itself as well. Only the ids of the sample, bounded by `rows`, are
    sent to where the texts are read; texts don't move but for the sample. Labels other than 0 and 1, null ids
    and texts longer than a tenth of `chars` take no part; repeated ids count once.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    ids = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    if per_label:
        own = ids.where("label = 0").orderBy(order, "doc_id").limit(per_label)
        ids = own.unionAll(ids.where("label = 1").orderBy(order, "doc_id").limit(per_label))
    ids = ids.orderBy(order, "doc_id").limit(rows)
    found = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars // 10)
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    )
    before = F.sum(F.length("text")).over(Window.orderBy(order, "doc_id"))  # over the bounded sample
    return found.withColumn("so_far", before).where(F.col("so_far") <= chars).select("doc_id", "text", "label").toPandas()
