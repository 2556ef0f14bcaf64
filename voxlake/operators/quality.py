"""Frames lost to motion and signal change, and the table of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CHOICES = ("fwd", "dvars", "or", "and")


def clean_mean(value: str, threshold: float) -> Column:
    """Mean of the values strictly below the threshold; NaN if there is none.  A value at the threshold is not lost, yet left out here."""
    return F.coalesce(F.avg(F.when(F.col(value) < F.lit(float(threshold)), F.col(value))), F.lit(float("nan")))


def lost_count(flag: Column) -> Column:
    return F.count_if(flag)


def join_frames(fd: DataFrame, change: DataFrame, by: Sequence[str], t: str = "t") -> DataFrame:
    """Frames of both series side by side; an error if a run's frames differ."""
    both = fd.alias("__fd").join(change.alias("__change"), [*by, t], "full")
    same = F.col(f"__fd.`{t}`").isNotNull() & F.col(f"__change.`{t}`").isNotNull()
    checked = both.withColumn("__ok", F.when(same, 1).otherwise(F.raise_error(F.lit("the two series of a run differ in length")).cast("int")))
    return checked.where("__ok = 1").drop("__ok")


def choose_mask(which: str, fd_lost: Column, change_lost: Column) -> Column:
    """The mask of lost frames that ``which`` names: fwd, dvars, or, and."""
    if which not in CHOICES:
        raise ValueError(f"which must be one of {', '.join(CHOICES)}")
    return {"fwd": fd_lost, "dvars": change_lost, "or": fd_lost | change_lost, "and": fd_lost & change_lost}[which]


def quality_table(frames: DataFrame, by: Sequence[str], fd_threshold: float, change_threshold: float, fd: str = "fd", change: str = "global_change") -> DataFrame:
    """A row a run: means, clean means, and frames lost by either measure, by both together, and in all.

    ``dvars`` here is what the quality table has always held under that name:
    the mean absolute global percent change.
    """
    lost_fd, lost_change = F.col(fd) > F.lit(float(fd_threshold)), F.col(change) > F.lit(float(change_threshold))
    return frames.groupBy(*by).agg(
        F.avg(fd).alias("fwd"),
        clean_mean(fd, fd_threshold).alias("fwd_clean"),
        lost_count(lost_fd).alias("volumesLostAfter_fwd"),
        F.count("*").alias("totalVolumes"),
        F.avg(change).alias("dvars"),
        clean_mean(change, change_threshold).alias("dvars_clean"),
        lost_count(lost_change).alias("volumesLostAfter_dvars"),
        lost_count(lost_fd | lost_change).alias("lostVolumes_fw_or_dvars"),
        lost_count(lost_fd & lost_change).alias("lostVolumes_fw_and_dvars"),
    )
