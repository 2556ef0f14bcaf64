"""Groups of rows inside ``mapInArrow``, for rows that are dealt and sorted by the groups' columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def _changes(batch: pa.RecordBatch, keys: Sequence[int]) -> np.ndarray:
    """Whether each row but the first differs from the one before in a key; nulls are equal."""
    n = batch.num_rows
    out = np.zeros(max(0, n - 1), bool)
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The rows of each group, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(k)[0].as_py() != held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys):
            yield whole()
            held = []
        heads = [0, *(np.flatnonzero(_changes(batch, keys)) + 1).tolist()]
        for h, e in zip(heads[:-1], heads[1:], strict=True):
            held.append(batch.slice(h, e - h))
            yield whole()
            held = []
        held.append(batch.slice(heads[-1]))
    if held:
        yield whole()


def map_groups(df: DataFrame, by: Sequence[str], change: Callable[[pa.RecordBatch], list[pa.Array]], schema: StructType) -> DataFrame:
    """``change`` applied to each group's rows; it returns the columns of ``schema``.  Small groups of a task are handed on together."""
    names, keys = schema.names, [df.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for group in groups(batches, keys):
            made = pa.RecordBatch.from_arrays(change(group), names=names)
            out.append(made)
            rows += made.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def map_whole_groups(df: DataFrame, by: Sequence[str], change: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]], schema: StructType) -> DataFrame:
    """``change`` applied to the rows of many groups at once, with the number of each row's group, from 0; it returns the columns of ``schema``.  No group is cut."""
    names, keys = schema.names, [df.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(change(whole, np.r_[0, np.cumsum(_changes(whole, keys))]), names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(_changes(batch, keys)) + 1
            if held and any(batch.column(k)[0].as_py() != held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys):
                new = np.r_[0, new]
            if not len(new):  # one group still
                held.append(batch)
                continue
            last = int(new[-1])
            if last:
                held.append(batch.slice(0, last))
            yield made()
            held = [batch.slice(last)]
        if held:
            yield made()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
