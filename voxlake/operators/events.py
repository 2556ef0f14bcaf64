"""Event vectors: onset, duration and weight in three columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fixed_decimal


def event_lines(df: DataFrame) -> Column:
    """A tab-separated line with two decimals; onsets are first rounded half to even."""
    return F.concat_ws("\t", fixed_decimal(F.bround("onset", 2), 2), fixed_decimal(F.col("duration"), 2), fixed_decimal(F.col("one"), 2))


def concatenate(files: Sequence[DataFrame]) -> DataFrame:
    """Lines of several files one after the other, duplicates kept: ``file`` says which file a line is from."""
    out = None
    for k, df in enumerate(files):
        part = df.withColumn("file", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
