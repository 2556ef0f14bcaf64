"""Places in a sorted list that is too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import MapType

#: Sampled values a range, and rows that a range is meant to have.
SAMPLES, RANGE_ROWS = 20, 100_000


def _splitters(df: DataFrame, value: str, tie: Column, range_rows: int) -> list[tuple[str, int]]:
    """Evenly spaced pairs of value and tie of a hash sample; fewer than there are ranges, which are 10,000 at most."""
    rows = df.count()
    ranges = min(10_000, -(-rows // range_rows))
    if ranges < 2:
        return []
    every = max(1, rows // (ranges * SAMPLES))
    keys = sorted((r[0], r[1]) for r in df.where(F.pmod(tie, F.lit(every)) == 0).select(value, tie.alias("__t")).limit(4 * ranges * SAMPLES).collect() if r[0] is not None)
    return list(dict.fromkeys(keys[len(keys) * k // ranges] for k in range(1, ranges))) if keys else []


def _range_of(value: Column, tie: Column, splitters: list[tuple[str, int]]) -> Column:
    """How many splitters are no greater; without any, all rows are at or above the least pair there is."""
    known = [F.struct(F.lit(v).alias("v"), F.lit(t).cast("long").alias("t")) for v, t in splitters or [("", -(2**63))]]
    return F.size(F.filter(F.array(*known), lambda s: (s["v"] < value) | ((s["v"] == value) & (s["t"] <= tie))))


def place_in_order(df: DataFrame, value: str, name: str, first: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` plus the place (long) of each row in the order of a text column, null first.

    Rows of one value lie by a hash of the whole row, so that the same rows get
    the same places each time.  Rows are dealt to ranges between sampled pairs
    of value and hash, which cut a frequent value too, counted there and
    numbered inside each; only the counts of ranges are added up in one task.
    The pairs between ranges are literals, so that they are the same wherever
    the plan is worked out again.
    """
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)])
    splitters = _splitters(df, value, tie, range_rows)
    ranged = df.withColumn("__tie", tie).withColumn("__range", F.when(F.col(value).isNull(), -1).otherwise(_range_of(F.col(value), F.col("__tie"), splitters)))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    placed = ranged.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    nth = F.row_number().over(W.partitionBy("__range").orderBy(value, "__tie"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + nth - 1 + first).alias(name))
