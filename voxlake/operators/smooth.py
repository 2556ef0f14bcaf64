"""Gaussian smoothing inside a mask.

The kernel is separable, and where it leaves the mask what remains of it counts
as all of it.  Volumes that lie in one row each are smoothed there, without any
exchange.  Long volumes are cut into blocks: each voxel goes to its own block
and to those whose rim it lies in, by one exchange whatever the kernel's width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.batches import map_groups
from ..model import AXES


def sigma_of(fwhm: float, size: float = 1.0) -> float:
    """Standard deviation in voxels of a Gaussian with this full width at half maximum, for voxels of this size."""
    return fwhm / math.sqrt(8 * math.log(2)) / size


def _kernels(sigma: Sequence[float], reach: float) -> list[np.ndarray]:
    out = []
    for s in sigma:
        half = math.ceil(reach * s) if s > 0 else 0
        k = np.exp(-0.5 * (np.arange(-half, half + 1) / s) ** 2) if half else np.ones(1)
        out.append(k / k.sum())
    return out


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    half, n = len(kernel) // 2, a.shape[axis]
    out = np.zeros_like(a)
    for k in range(-half, half + 1):
        if abs(k) < n:
            to, of = [slice(None)] * a.ndim, [slice(None)] * a.ndim
            to[axis], of[axis] = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
            out[tuple(to)] += kernel[half + k] * a[tuple(of)]
    return out


def smoothed(v: np.ndarray, mask: np.ndarray, kernels: Sequence[np.ndarray]) -> np.ndarray:
    """The volume (its last three axes in the kernels' order) smoothed inside the mask, NaN outside."""
    top, low = np.where(mask, v, 0.0), mask.astype(float)
    for axis, kernel in zip((-3, -2, -1), kernels, strict=True):
        top, low = (_along(a, kernel, a.ndim + axis) for a in (top, low))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(mask, top / low, np.nan)


def smooth_wide(wide: DataFrame, sigma: Sequence[float], reach: float = 3.0) -> DataFrame:
    """Wide volumes smoothed, each in its row; ``sigma`` in voxels by axis.  Null and NaN voxels are outside the mask and stay NaN."""
    names, kernels = wide.columns, _kernels(sigma, reach)[::-1]  # x is fastest
    at, dims = names.index("voxels"), names.index("dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, shape in zip(batch.column(at), batch.column(dims).to_pylist(), strict=True):
                v = row.values.to_numpy(zero_copy_only=False).astype(float).reshape([shape[a] for a in reversed(AXES)])
                out.append(smoothed(v, ~np.isnan(v), kernels).reshape(-1))
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return wide.mapInArrow(run, wide.schema)


def smooth(df: DataFrame, sigma: Sequence[float], by: Sequence[str] = ("image_id", "t"), v: str = "v", mask: str | None = None, block: int = 32, reach: float = 3.0) -> DataFrame:
    """Long volumes smoothed: by, x, y, z, v for the voxels inside the mask (a boolean column; all if not given) that have a value.

    Blocks have ``block`` voxels along each axis, and a rim as wide as the
    kernel.  Null and NaN values are outside the mask.
    """
    kernels = _kernels(sigma, reach)
    rim = {a: len(k) // 2 for a, k in zip(AXES, kernels, strict=True)}
    inside = F.col(v).isNotNull() & ~F.isnan(v)
    rows = df.where(inside & F.col(mask) if mask else inside).select(*by, *[F.col(a).cast("int").alias(a) for a in AXES], F.col(v).cast("double").alias("v"))
    for a in AXES:
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.greatest(F.floor((F.col(a) - rim[a]) / block), F.lit(0)).cast("int"), F.floor((F.col(a) + rim[a]) / block).cast("int"))))
    size, group = [block + 2 * rim[a] for a in AXES], [*by, *[f"b{a}" for a in AXES]]
    names = rows.columns
    kept = [names.index(c) for c in (*by, *AXES)]

    def of_block(batch: pa.RecordBatch) -> list[pa.Array]:
        at = [batch.column(names.index(a)).to_numpy().astype(np.int64) for a in AXES]
        place = tuple(p - batch.column(names.index(f"b{a}"))[0].as_py() * block + rim[a] for p, a in zip(at, AXES, strict=True))
        values, seen = np.zeros(size), np.zeros(size, bool)
        values[place], seen[place] = batch.column(names.index("v")).to_numpy(), True
        new = smoothed(values, seen, kernels)[place]
        own = pa.array(np.all([(p >= rim[a]) & (p < rim[a] + block) for p, a in zip(place, AXES, strict=True)], axis=0))
        return [*(batch.column(k).filter(own) for k in kept), pa.array(new).filter(own)]

    return map_groups(rows, group, of_block, rows.select(*by, *AXES, "v").schema)
