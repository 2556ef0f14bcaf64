"""Affine resampling of long volumes by backward mapping.

The output grid, the voxel-to-voxel map and its twelve coefficients are worked
out on the driver from two 4x4 matrices.  Output voxels are then a generated
grid, their places in the input a projection, and the input values equi-joins
on whole coordinates; for the eight voxels that trilinear resampling reads, input
voxels meet a table of reads that all volumes share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..model import AXES
from ..session import prepare

#: How far outside the volume a place may lie and still count as on its edge.
EDGE = 5e-2
PLACE = ("px", "py", "pz")


def half_away(x):
    """Round half away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


@dataclass(frozen=True)
class Grid:
    """An output grid: its size, its matrix to millimetres, and the map from its voxels to the input's (both from 0)."""

    dims: tuple[int, int, int]
    matrix: np.ndarray
    to_old: np.ndarray


def output_grid(dims: Sequence[int], matrix, size: Sequence[float] = (1.0, 1.0, 1.0)) -> Grid:
    """The grid of voxels of ``size`` that covers the corners of a volume with an affine ``matrix``."""
    matrix = np.asarray(matrix, float)
    if matrix.shape != (4, 4):
        raise ValueError("the matrix must be 4 x 4")
    size = np.asarray(list(size) * 3 if len(size) == 1 else size, float)[:3]
    corners = np.array([[x, y, z, 1] for x in (0, dims[0] - 1) for y in (0, dims[1] - 1) for z in (0, dims[2] - 1)], float)
    places = (corners @ matrix.T)[:, :3]
    low, high = half_away(places.min(0)), half_away(places.max(0))
    out = tuple(int(n) for n in np.ceil((high - low) / size + 1))
    new = np.diag([*size, 1.0])
    new[:3, 3] = low
    return Grid(out, new, np.linalg.solve(matrix, new))


def target_grid(dims: Sequence[int], to_old) -> Grid:
    """A grid of a given size with a given map to the input's voxels, as for a matrix that was found before."""
    to_old = np.asarray(to_old, float)
    return Grid(tuple(int(d) for d in dims), np.eye(4), to_old)


def scaled_map(matrix, old_size: Sequence[float], new_size: Sequence[float]) -> np.ndarray:
    """Map from new voxels to old ones, for a matrix that takes old to new millimetres, both scaled by voxel sizes."""
    return np.diag([1 / s for s in old_size] + [1.0]) @ np.linalg.inv(np.asarray(matrix, float)) @ np.diag([*new_size, 1.0])


def background(df: DataFrame, dims: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Mean of the first and the last voxel of each volume."""
    last = (F.col("x") == dims[0] - 1) & (F.col("y") == dims[1] - 1) & (F.col("z") == dims[2] - 1)
    first = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    return df.groupBy(*by).agg(((F.max(F.when(first, F.col("v"))) + F.max(F.when(last, F.col("v")))) / 2).alias("bg"))


def _places(df: DataFrame, grid: Grid, dims: Sequence[int], by: Sequence[str], bg: float | None) -> DataFrame:
    """A row for each output voxel of each volume, with its 1-based place in the input (px, py, pz) and the background."""
    volumes = df.select(*by).distinct().withColumn("bg", F.lit(float(bg))) if bg is not None else background(df, dims, by)
    rows = volumes
    for a, n in zip(AXES, grid.dims, strict=True):
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    m = grid.to_old
    return rows.withColumns({A: F.lit(float(m[k, 0])) * F.col("x") + F.lit(float(m[k, 1])) * F.col("y") + F.lit(float(m[k, 2])) * F.col("z") + F.lit(float(m[k, 3]) + 1.0) for k, A in enumerate(PLACE)})


def _old(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(a).cast("int").alias(f"__{a}") for a in AXES], F.col("v").cast("double").alias("__v"))


def _same(by: Sequence[str], xyz: Sequence[Column]) -> Column:
    match = F.lit(True)
    for c in by:
        match = match & (F.col(c) == F.col(f"__{c}"))
    for a, c in zip(AXES, xyz, strict=True):
        match = match & (c == F.col(f"__{a}"))
    return match


def _inside(dims: Sequence[int], values: Sequence[Column], edge: float = 0.0) -> Column:
    out = F.lit(True)
    for d, c in zip(dims, values, strict=True):
        out = out & (c > 1 - edge) & (c < d + edge) if edge else out & c.between(1, d)
    return out


def nearest(df: DataFrame, grid: Grid, dims: Sequence[int], by: Sequence[str] = ("image_id", "t"), bg: float | None = None) -> DataFrame:
    """Each output voxel takes the input voxel at its rounded place (half away from zero), or the background outside."""
    rows = _places(df, grid, dims, by, bg).select(*by, *AXES, "bg", *[(F.round(A).cast("int") - 1).alias(f"n{a}") for a, A in zip(AXES, PLACE, strict=True)])
    joined = rows.join(_old(df, by), _same(by, [F.col(f"n{a}") for a in AXES]), "left")
    return joined.select(*by, *AXES, F.coalesce("__v", "bg").alias("v"))


def trilinear(df: DataFrame, grid: Grid, dims: Sequence[int], by: Sequence[str] = ("image_id", "t"), bg: float | None = None) -> DataFrame:
    """Each output voxel is the weighted sum of the eight input voxels round its place, or the background outside.

    Places up to EDGE outside count as inside; beyond the first or last voxel
    the edge's own value stands for both neighbours.
    """
    volumes = df.select(*by).distinct().withColumn("bg", F.lit(float(bg))) if bg is not None else background(df, dims, by)
    spark, n = df.sparkSession, int(np.prod(grid.dims))
    # what an output voxel reads is the same for all volumes: a table of reads that meets each input voxel by its place, so that no volume is sent to its reads
    k, m = F.col("__k"), grid.to_old
    cell = lambda i: [(i % grid.dims[0]).cast("int"), (F.floor(i / grid.dims[0]) % grid.dims[1]).cast("int"), F.floor(i / (grid.dims[0] * grid.dims[1])).cast("int")]
    rows = spark.range(8 * n).select((F.col("id") % 8).alias("__k"), F.floor(F.col("id") / 8).alias("__i"))
    rows = rows.select("__k", *[c.alias(a) for a, c in zip(AXES, cell(F.col("__i")), strict=True)])
    rows = rows.withColumns({A: F.lit(float(m[j, 0])) * F.col("x") + F.lit(float(m[j, 1])) * F.col("y") + F.lit(float(m[j, 2])) * F.col("z") + F.lit(float(m[j, 3]) + 1.0) for j, A in enumerate(PLACE)})
    weight, at = F.lit(1.0), {}
    for j, (a, A) in enumerate(zip(AXES, PLACE, strict=True)):
        up, whole = F.shiftrightunsigned(k, j).bitwiseAND(1), F.floor(A)
        part = F.col(A) - whole
        weight = weight * F.when(up == 1, part).otherwise(F.lit(1.0) - part)
        at[a] = F.when(whole < 1, 1).when(whole > dims[j] - 1, dims[j]).otherwise(whole + up)
    reads = rows.where(_inside(dims, [F.col(A) for A in PLACE], EDGE)).select(*AXES, weight.alias("w"), *[(at[a] - 1).cast("int").alias(f"c{a}") for a in AXES]).where("w <> 0")
    met = _old(df, by).join(reads, [F.col(f"__{a}") == F.col(f"c{a}") for a in AXES])
    parts = met.select(*[F.col(f"__{c}").alias(c) for c in by], *AXES, (F.col("w") * F.col("__v")).alias("v"))
    every = volumes
    for a, count in zip(AXES, grid.dims, strict=True):
        every = every.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    none = F.lit(None).cast("double")
    both = parts.withColumn("bg", none).unionByName(every.withColumn("v", none))
    return both.groupBy(*by, *AXES).agg(F.coalesce(F.sum("v"), F.max("bg")).alias("v"))


def line_place(k: Column, start: Column, end: Column, steps: Column) -> Column:
    """Coordinate at step k of a digital line from start to end in ``steps`` steps of its longest axis: rounded half towards the end."""
    return F.when(steps == 0, start).otherwise(start + F.signum(end - start) * F.floor((2 * k * F.abs(end - start) + steps) / (2 * steps)))


def digital_line(p1: Sequence[int], p2: Sequence[int]) -> list[tuple[int, int, int]]:
    """The voxels of a line between two voxels, in closed form."""
    steps = max(abs(b - a) for a, b in zip(p1, p2, strict=True))
    return [tuple(int(a + np.sign(b - a) * ((2 * k * abs(b - a) + steps) // (2 * steps) if steps else 0)) for a, b in zip(p1, p2, strict=True)) for k in range(steps + 1)]


def along_lines(df: DataFrame, grid: Grid, dims: Sequence[int], by: Sequence[str] = ("image_id", "t"), bg: float | None = None) -> DataFrame:
    """Each output row along x is read off a digital line through the input, from the rounded place before its first voxel to that of its last."""
    volumes = df.select(*by).distinct().withColumn("bg", F.lit(float(bg))) if bg is not None else background(df, dims, by)
    rows = volumes
    for a, n in zip(AXES, grid.dims, strict=True):
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    m, nx = grid.to_old, grid.dims[0]

    def place(k: int, x: float) -> Column:
        return F.round(F.lit(float(m[k, 0]) * x) + F.lit(float(m[k, 1])) * F.col("y") + F.lit(float(m[k, 2])) * F.col("z") + F.lit(float(m[k, 3]) + 1.0)).cast("long")

    rows = rows.withColumns({f"s{a}": place(k, -1.0) for k, a in enumerate(AXES)} | {f"e{a}": place(k, nx - 1.0) for k, a in enumerate(AXES)})
    rows = rows.withColumn("steps", F.greatest(*[F.abs(F.col(f"e{a}") - F.col(f"s{a}")) for a in AXES]))
    nth = F.least(F.greatest(F.round((F.col("x") + 1) * (F.col("steps") + 1) / F.lit(nx)).cast("long"), F.lit(1)), F.col("steps") + 1) - 1
    rows = rows.withColumn("k", nth).withColumns({f"n{a}": (line_place(F.col("k"), F.col(f"s{a}"), F.col(f"e{a}"), F.col("steps")) - 1).cast("int") for a in AXES})
    joined = rows.join(_old(df, by), _same(by, [F.col(f"n{a}") for a in AXES]), "left")
    return joined.select(*by, *AXES, F.coalesce("__v", "bg").alias("v"))


def _reads(grid: Grid, dims: Sequence[int], method: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, indexes, weights): what each output voxel reads from a volume's array; one place for nearest, eight for trilinear."""
    x, y, z = (g.ravel(order="F") for g in np.meshgrid(*[np.arange(n, dtype=float) for n in grid.dims], indexing="ij"))
    places = np.stack([m[0] * x + m[1] * y + m[2] * z + (m[3] + 1.0) for m in grid.to_old[:3]])
    size = np.array(dims)[:, None]
    flat = lambda at: (at[0] - 1) + dims[0] * ((at[1] - 1) + dims[1] * (at[2] - 1))
    if method == 2:
        near = half_away(places).astype(np.int64)
        inside = ((near >= 1) & (near <= size)).all(0)
        return inside, np.where(inside, flat(near), 0)[None], np.ones((1, len(x)))
    inside = ((places > 1 - EDGE) & (places < size + EDGE)).all(0)
    whole = np.floor(places)
    low = np.clip(whole, 1, size).astype(np.int64)
    high = np.where((whole < 1) | (whole > size - 1), low, low + 1)
    upper = places - whole
    indexes, weights = [], []
    for corner in range(8):
        ups = [bool(corner >> k & 1) for k in range(3)]
        indexes.append(np.where(inside, flat([high[k] if up else low[k] for k, up in enumerate(ups)]), 0))
        weights.append(np.prod([upper[k] if up else 1 - upper[k] for k, up in enumerate(ups)], axis=0))
    return inside, np.stack(indexes), np.stack(weights)


def on_arrays(wide: DataFrame, grid: Grid, dims: Sequence[int], method: int = 1, bg: float | None = None) -> DataFrame:
    """Trilinear (1) or nearest (2) resampling of wide volumes: each row's array is gathered in place, without any exchange.

    The same results as on long volumes.  What an output voxel reads is the
    same for all volumes, so it is worked out once a task, and a volume is a
    few vector steps over Arrow batches.  A volume must fit in a row, as it does
    when it comes from a file; long volumes that were cut apart are what the
    joins are for.  Null volumes stay null; one of another size is an error.
    """
    if method not in (1, 2):
        raise ValueError("arrays are read by method 1 or 2")
    names, expected = wide.columns, int(np.prod(dims))

    def resampled(values: np.ndarray, reads: tuple) -> np.ndarray:
        if len(values) != expected:
            raise ValueError(f"a volume has {len(values)} voxels, not {expected}")
        inside, indexes, weights = reads
        out = sum(values[i] * w for i, w in zip(indexes, weights, strict=True))
        return np.where(inside, out, bg if bg is not None else (values[0] + values[-1]) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads = _reads(grid, dims, method)
        for batch in batches:
            volumes = [None if v.values is None else resampled(v.values.to_numpy(zero_copy_only=False), reads) for v in batch.column(names.index("voxels"))]
            size = dict(zip(AXES, grid.dims, strict=True))
            new = {"voxels": pa.array(volumes, pa.list_(pa.float64())), "dims": pa.array([size] * batch.num_rows, pa.struct([(a, pa.int32()) for a in AXES]))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

    prepare(wide.sparkSession)
    return wide.mapInArrow(run, wide.schema)


METHODS = {1: trilinear, 2: nearest, 3: along_lines}


def reslice(df: DataFrame, dims: Sequence[int], matrix, pixdim: Sequence[float], size: Sequence[float] | None = None, method: int = 1, bg: float | None = None, by: Sequence[str] = ("image_id", "t")) -> tuple[DataFrame, Grid]:
    """All frames on a grid of equal voxels along the axes of space, of the smallest voxel size by default; values as 32-bit floats."""
    size = (abs(min(pixdim)),) * 3 if size is None else tuple(size) if len(size) == 3 else (abs(size[0]),) * 3
    grid = output_grid(dims, matrix, size)
    out = METHODS[method](df, grid, dims, by, bg)
    return out.withColumn("v", F.col("v").cast("float")), grid
