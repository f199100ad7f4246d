"""Small shared helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task turns into Python objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """Batches cut into short frames, so that what is made from them stays small."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i:i + rows]


def char_slices(batches: Iterator[pd.DataFrame], column: str, chars: int, rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """As `slices`, with at most so many characters in a column together; a longer text is a frame of its own."""
    for pdf in slices(batches, rows):
        total = pdf[column].str.len().cumsum().to_numpy()
        at = 0
        while at < len(pdf):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(total.searchsorted(before + chars, side="right")))
            yield pdf.iloc[at:end]
            at = end
