"""Voxel time series: percent signal change, DVARS, global signal, means.

Long form: a row a frame and voxel, with the columns ``run`` (or any ``by``),
``t``, ``voxel`` and ``v``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

#: A voxel's mean at or below this counts as low.
LOW_MEAN = 1e5 * 2.0**-52


def percent_change(df: DataFrame, by: Sequence[str] = ("run",), voxel: str = "voxel", v: str = "v", name: str = "psc") -> DataFrame:
    """``df`` plus 100 * (v / mean - 1) over each voxel's time course.

    Where the mean is low (negative means too), the largest absolute value
    takes its place and the course is shifted by it.  NaN, as of a voxel that
    is always zero, becomes 0.  One exchange, by voxel, which differences over
    time then share.
    """
    course = W.partitionBy(*by, voxel)
    mean, top = F.avg(v).over(course), F.max(F.abs(F.col(v))).over(course)
    low = mean <= F.lit(LOW_MEAN)
    base = F.when(low, top).otherwise(mean)
    shifted = F.when(low, F.col(v) + top).otherwise(F.col(v))
    change = F.coalesce(F.try_divide(F.lit(100.0) * shifted, base) - F.lit(100.0), F.lit(0.0))
    return df.withColumn(name, F.when(F.isnan(change), 0.0).otherwise(change))


def dvars(df: DataFrame, by: Sequence[str] = ("run",), t: str = "t", voxel: str = "voxel", v: str = "psc") -> DataFrame:
    """Root mean square over voxels of the change from the frame before; a row a run and frame, 0 at a voxel's first frame."""
    change = F.coalesce(F.col(v) - F.lag(v).over(W.partitionBy(*by, voxel).orderBy(t)), F.lit(0.0))
    return df.withColumn("__d", change).groupBy(*by, t).agg(F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("dvars"))


def global_change(df: DataFrame, by: Sequence[str] = ("run",), t: str = "t", v: str = "psc") -> DataFrame:
    """Absolute value of the mean over voxels; a row a run and frame."""
    return df.groupBy(*by, t).agg(F.abs(F.avg(v)).alias("global_change"))


def frame_signals(df: DataFrame, by: Sequence[str] = ("run",), t: str = "t", voxel: str = "voxel", v: str = "psc") -> DataFrame:
    """dvars and global_change of each frame, in one pass."""
    change = F.coalesce(F.col(v) - F.lag(v).over(W.partitionBy(*by, voxel).orderBy(t)), F.lit(0.0))
    return df.withColumn("__d", change).groupBy(*by, t).agg(F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("dvars"), F.abs(F.avg(v)).alias("global_change"))


def z_scores(df: DataFrame, by: Sequence[str] = ("run",), t: str = "t", v: str = "dvars", name: str = "z") -> DataFrame:
    """``df`` plus the z-score among all frames but the first, which gets 0; 0 too where there is no spread."""
    run = W.partitionBy(*by)
    first = F.col(t) == F.min(t).over(run)
    rest = F.when(~first, F.col(v))
    z = F.coalesce(F.try_divide(F.col(v) - F.avg(rest).over(run), F.stddev_samp(rest).over(run)), F.lit(0.0))
    return df.withColumn(name, F.when(first, 0.0).otherwise(z))


def temporal_mean(df: DataFrame, by: Sequence[str] = ("image_id",), place: Sequence[str] = ("x", "y", "z"), v: str = "v") -> DataFrame:
    """Mean of each voxel over time."""
    return df.groupBy(*by, *place).agg(F.avg(v).alias(v))


def mean_of_run_means(df: DataFrame, run: str = "run", place: Sequence[str] = ("x", "y", "z"), v: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """Mean over runs of the runs' temporal means: every run counts once, however long."""
    return df.groupBy(*by, run, *place).agg(F.avg(v).alias("__m")).groupBy(*by, *place).agg(F.avg("__m").alias(v))


def voxel_matrix(wide: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Volumes as a time-by-voxel table: a row a frame and voxel."""
    return wide.select(*by, "t", F.posexplode("voxels").alias("voxel", "v"))
