"""Filters along time: high-pass by a running line, slice-timing correction.

Both work on courses: a voxel's values in the order of its frames as one array.
Long rows become courses by one exchange by voxel; a filter is then a function
of whole batches of courses, so several filters share that exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def to_courses(df: DataFrame, by: Sequence[str] = ("run", "voxel"), t: str = "t", v: str = "v", keep: Sequence[str] = ()) -> DataFrame:
    """A row a voxel: ``frames`` and ``course``, both by frame; columns in ``keep``, the same in all rows of a voxel, stay.  Nulls count as NaN."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias("v"))))
    rows = df.groupBy(*by).agg(pairs.alias("__p"), *[F.first(c).alias(c) for c in keep])
    return rows.select(*by, *keep, F.transform("__p", lambda p: p["t"]).alias("frames"), F.transform("__p", lambda p: p["v"]).alias("course"))


def from_courses(courses: DataFrame, t: str = "t", v: str = "v") -> DataFrame:
    """A row a voxel and frame again."""
    rest = [c for c in courses.columns if c not in ("frames", "course")]
    return courses.select(*rest, F.inline(F.arrays_zip(F.col("frames").alias(t), F.col("course").alias(v)))).toDF(*rest, t, v)


def _on_courses(courses: DataFrame, change: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], numbers: Sequence[str] = ()) -> DataFrame:
    """``course`` replaced by ``change(courses, numbers)``, called with the courses of one length of a batch as a matrix, and columns of numbers."""
    names = courses.columns
    at, which = names.index("course"), [names.index(c) for c in numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float)
            out, sizes = flat.copy(), np.diff(ends)
            extra = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in which]
            for n in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == n)
                place = ends[:-1][rows, None] + np.arange(n)
                out[place] = change(flat[place], [x[rows] for x in extra])
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[at] = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(out[ends[0] : ends[-1]]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return courses.mapInArrow(run, courses.schema)


# high-pass


def running_line(y: np.ndarray, sigma: float, reach: float = 3.0) -> np.ndarray:
    """At each place of each row, the value there of the straight line fitted with Gaussian weights to the places within ``reach`` * sigma."""
    n, half = y.shape[1], max(1, math.ceil(reach * sigma))
    k = np.arange(-half, half + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    size = 1 << (n + 2 * half).bit_length()
    kernels = [np.fft.rfft(w * k**p, size) for p in range(3)]

    def summed(x: np.ndarray, p: int) -> np.ndarray:
        """Sum over k of w * k**p * x[t + k]; convolution turns the sign of odd powers."""
        return (-1) ** p * np.fft.irfft(np.fft.rfft(x, size, axis=-1) * kernels[p], size, axis=-1)[..., half : half + n]

    level = y.mean(1, keepdims=True)  # nearer to zero the transforms round less
    s0, s1, s2 = (summed(np.ones(n), p) for p in range(3))
    b0, b1 = summed(y - level, 0), summed(y - level, 1)
    whole = s0 * s2 - s1 * s1
    flat = whole <= 1e-9 * s0 * s2
    return level + np.where(flat, b0 / s0, (s2 * b0 - s1 * b1) / np.where(flat, 1.0, whole))


def high_pass(courses: DataFrame, tr: float, cutoff: float = 100.0, reach: float = 3.0) -> DataFrame:
    """Courses less their running line, plus their mean: slower changes than ``cutoff`` seconds go.

    The weights' standard deviation is half the cutoff.  A course of one frame
    stays as it is; a NaN makes its whole course NaN.
    """
    sigma = cutoff / (2 * tr)
    return _on_courses(courses, lambda y, _: y if y.shape[1] == 1 else y - running_line(y, sigma, reach) + y.mean(1, keepdims=True))


# slice timing


def shifted(y: np.ndarray, delay: np.ndarray, half: int = 8) -> np.ndarray:
    """Each row of y at places ``delay`` later, by a sinc under a Hann window of ``half`` places on either side; the ends go on as their last values."""
    base = np.floor(delay).astype(np.int64)
    part, n = delay - base, y.shape[1]
    taps = np.arange(1 - half, half + 1)
    away = part[:, None] - taps
    weight = np.sinc(away) * 0.5 * (1 + np.cos(np.pi * away / half))
    weight /= weight.sum(1, keepdims=True)
    out = np.zeros_like(y)
    for j, tap in enumerate(taps.tolist()):
        place = np.clip(np.arange(n) + (base + tap)[:, None], 0, n - 1)
        out += weight[:, j, None] * np.take_along_axis(y, place, 1)
    return out


def slice_timing(courses: DataFrame, tr: float, seconds: str = "seconds", reference: float = 0.5, half: int = 8) -> DataFrame:
    """Courses as if taken at ``reference`` of the repetition time; the column ``seconds`` has the time of each voxel's slice.

    Values between frames are windowed-sinc sums over the course alone.  A null
    time leaves its course as it is.
    """

    def change(y: np.ndarray, numbers: list[np.ndarray]) -> np.ndarray:
        delay = reference - numbers[0] / tr
        known = np.isfinite(delay)
        out = y.copy()
        if known.any():
            out[known] = shifted(y[known], delay[known], half)
        return out

    return _on_courses(courses, change, [seconds])
