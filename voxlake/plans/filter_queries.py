"""Queries of filters in time and space over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import to_long
from ..operators import courses as C, smooth as G
from .registry import query, r, rs
from .tables import SERIES_SQL, VOLUMES_SQL, series, volumes, wide_volumes

TR, CUTOFF, REACH = 2.0, 30.0, 3.0
_SIGMA = CUTOFF / (2 * TR)


def _rows(df: DataFrame) -> DataFrame:
    return df.select("run", "t", F.col("voxel").cast("long").alias("voxel"), r("v").alias("v"))


_W = f"exp(-0.5::DOUBLE * (k / {_SIGMA!r}::DOUBLE) * (k / {_SIGMA!r}::DOUBLE))"


@query(
    f"WITH {SERIES_SQL}, n AS (SELECT a.run, a.voxel, a.t, a.v, (b.t - a.t)::DOUBLE AS k, b.v AS y FROM series a JOIN series b ON a.run = b.run AND a.voxel = b.voxel AND b.t BETWEEN a.t - {math.ceil(REACH * _SIGMA)} AND a.t + {math.ceil(REACH * _SIGMA)}), "
    f"s AS (SELECT run, voxel, t, any_value(v) AS v, sum({_W}) AS s0, sum({_W} * k) AS s1, sum({_W} * k * k) AS s2, sum({_W} * y) AS b0, sum({_W} * k * y) AS b1 FROM n GROUP BY run, voxel, t) "
    f"SELECT run, t, voxel, {rs('v - (s2 * b0 - s1 * b1) / (s0 * s2 - s1 * s1) + avg(v) OVER (PARTITION BY run, voxel)')} AS v FROM s"
)
def series_high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(C.from_courses(C.high_pass(C.to_courses(series(spark, sf_dir)), TR, CUTOFF, REACH)))


#: Four slices, taken one after the other; half the window.
_SLICES, _HALF = 4, 4
_AWAY = "(d - k)"
_SINC = f"CASE WHEN {_AWAY} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {_AWAY}) / (pi() * {_AWAY}) END * 0.5 * (1 + cos(pi() * {_AWAY} / {_HALF}))"


@query(
    f"WITH {SERIES_SQL}, p AS (SELECT *, 0.5::DOUBLE - (voxel // 16) * {TR / _SLICES!r}::DOUBLE / {TR!r}::DOUBLE AS d, max(t) OVER (PARTITION BY run) AS last FROM series), "
    f"w AS (SELECT run, voxel, t, d - floor(d) AS d, last, t + floor(d)::BIGINT + k AS place, k FROM p, (SELECT unnest(range({1 - _HALF}, {_HALF + 1})) AS k)), "
    f"u AS (SELECT w.run, w.voxel, w.t, {_SINC} AS c, s.v FROM w JOIN series s ON s.run = w.run AND s.voxel = w.voxel AND s.t = least(greatest(place, 0), last)) "
    f"SELECT run, t, voxel, {rs('sum(c * v) / sum(c)')} AS v FROM u GROUP BY run, voxel, t"
)
def series_slice_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = series(spark, sf_dir).withColumn("seconds", F.floor(F.col("voxel") / 16) * F.lit(TR / _SLICES))
    return _rows(C.from_courses(C.slice_timing(C.to_courses(timed, keep=["seconds"]), TR, half=_HALF)).drop("seconds"))


_WIDTHS, _WIDE_REACH = (G.sigma_of(2.0), G.sigma_of(1.5), G.sigma_of(3.0)), 2.0
_NEAR = " AND ".join(f"abs(a.{c} - b.{c}) <= {math.ceil(_WIDE_REACH * s)}" for c, s in zip("xyz", _WIDTHS, strict=True))
_GAUSS = "exp(" + " + ".join(f"-0.5::DOUBLE * ((a.{c} - b.{c}) / {s!r}::DOUBLE) * ((a.{c} - b.{c}) / {s!r}::DOUBLE)" for c, s in zip("xyz", _WIDTHS, strict=True)) + ")"


def _smooth_sql(where: str) -> str:
    return f"WITH {VOLUMES_SQL}, m AS (SELECT * FROM volumes WHERE {where}) SELECT a.image_id, a.x, a.y, a.z, {rs(f'sum({_GAUSS} * b.v) / sum({_GAUSS})')} AS v FROM m a JOIN m b ON a.image_id = b.image_id AND {_NEAR} GROUP BY a.image_id, a.x, a.y, a.z"


def _voxels(df: DataFrame) -> DataFrame:
    return df.select("image_id", *[F.col(a).cast("int").alias(a) for a in "xyz"], r("v").alias("v"))


@query(_smooth_sql("x + y + z > 1"))
def volume_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = volumes(spark, sf_dir).withColumn("inside", F.col("x") + F.col("y") + F.col("z") > 1)
    return _voxels(G.smooth(masked, _WIDTHS, mask="inside", reach=_WIDE_REACH))


@query(_smooth_sql("true"))
def volume_smoothed_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(to_long(G.smooth_wide(wide_volumes(spark, sf_dir), _WIDTHS, _WIDE_REACH)))
