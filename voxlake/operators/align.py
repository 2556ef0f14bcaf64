"""Rigid alignment of a series' frames to its base volume.

A frame is a row with its whole volume, joined by its run to the base.  The
squared difference between the base and the turned and shifted frame is taken
down by Gauss-Newton steps over six numbers, all steps while the frame is at
hand: the data are read once, frames are independent of each other, and only
the six numbers a frame are left: the table that framewise displacement reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spatial as S
from ..model import CHANNELS

#: Numbers of frames that are dealt together with one copy of their base.
SHARE = 32


def base_numbers(frames: DataFrame, at: str = "middle", by: Sequence[str] = ("run",), t: str = "t", name: str = "base") -> DataFrame:
    """A row a run: by and the number of its ``first`` or ``middle`` frame, from the frames' numbers alone."""
    place = F.min(t) if at == "first" else F.floor((F.min(t) + F.max(t)) / 2)
    wanted = frames.groupBy(*by).agg(place.cast("long").alias("__at"))
    return frames.select(*by, F.col(t).alias("__t")).join(wanted, list(by)).groupBy(*by).agg(F.min(F.struct(F.abs(F.col("__t") - F.col("__at")).alias("d"), "__t"))["__t"].alias(name))


def base_volumes(frames: DataFrame, at: str = "middle", by: Sequence[str] = ("run",), t: str = "t") -> DataFrame:
    """A row a run: dims and voxels of its ``first`` or ``middle`` frame, by an aggregate over frame numbers and a join.

    Volumes are far larger than the sizes that Spark estimates for arrays, so
    joins with them are never broadcast.
    """
    near = base_numbers(frames, at, by, t, "__t")
    return frames.join(near.hint("merge"), list(by)).where(F.col(t) == F.col("__t")).select(*by, "dims", "voxels")


def _slopes(base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(voxels, 6): change of each voxel of the base with the three angles and the three shifts."""
    gz, gy, gx = (np.gradient(base, axis=a) if base.shape[a] > 1 else np.zeros(base.shape) for a in range(3))
    gx, gy, gz = (g.reshape(-1) / s for g, s in zip((gx, gy, gz), size, strict=True))
    x, y, z = (S.grid(base.shape) - S.centre(base.shape)[:, None]) * size[:, None]
    return np.stack([y * gz - z * gy, z * gx - x * gz, x * gy - y * gx, gx, gy, gz], axis=1)


def align(base: np.ndarray, frame: np.ndarray, size: np.ndarray, slopes: np.ndarray, steps: int = 30, least: float = 1e-5, places: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(angles and shifts that bring ``frame`` onto ``base``, mean squared difference then).

    Ends where a step is below ``least``, or leads back to numbers met before
    (to within a thousandth of it): from there the same steps would come again.
    """
    places, middle, p = S.grid(base.shape) if places is None else places, S.centre(base.shape), np.zeros(6)
    flat, wide, best, met = base.reshape(-1), S.edged(frame), (np.inf, np.zeros(6)), []
    for _ in range(steps):
        at = S.at(S.affine(p, middle, size), places)
        ok = np.flatnonzero(S.inside(base.shape, at))
        if not len(ok):
            break
        rest = S.cubic_in(wide, at.take(ok, axis=1)) - flat[ok]
        error = float(rest @ rest) / len(rest)
        if error < best[0]:
            best = (error, p)
        met.append(p)
        j = slopes.take(ok, axis=0)
        step = np.linalg.lstsq(j.T @ j, j.T @ rest, rcond=1e-9)[0]
        p = p - step
        if np.abs(step).max() < least or (np.abs(np.array(met) - p).max(1) < least / 1000).any():
            break
    return best[1], best[0]


def share(t: str = "t") -> Column:
    """The share of a run's frames that a frame is dealt with: few runs are dealt over many tasks, and one base serves a share."""
    return F.coalesce(F.floor(F.col(t) / SHARE), F.lit(0))


def beside_base(frames: DataFrame, base: DataFrame, by: Sequence[str] = ("run",), t: str = "t") -> DataFrame:
    """by, t, dims, voxels, base_dims, base_voxels: each frame with the base of its run, dealt for ``align_rows``.

    Little data, much work: as many tasks as shuffles have, and the frames of a
    long run over all of them, in shares of SHARE numbers.  The frames are
    dealt once, before the join, and a base goes to each share of its run; dealt
    after it, every frame would take its base along.
    """
    tasks, dealt = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, "__share"]
    frames = frames.select(*by, t, "dims", "voxels", share(t).alias("__share"))
    bases = base.select(*by, F.col("dims").alias("base_dims"), F.col("voxels").alias("base_voxels")).join(frames.select(*dealt).distinct().hint("merge"), list(by))
    return frames.repartition(tasks, *dealt).join(bases.repartition(tasks, *dealt).hint("merge"), dealt).select(*by, t, "dims", "voxels", "base_dims", "base_voxels")


def align_rows(rows: DataFrame, size: Sequence[float] = (1.0, 1.0, 1.0), by: Sequence[str] = ("run",), t: str = "t", steps: int = 30) -> DataFrame:
    """``align_frames`` for frames that have their base beside them: dims, voxels, base_dims, base_voxels.

    Rows are taken where they are.  Where volumes are made or read from
    something small, deal that and make them after it (``base_numbers`` tells
    which), so that no volume is exchanged.
    """
    kept, spacing = [*by, t], np.asarray(size, float)
    rows = rows.select(*kept, "dims", "voxels", "base_dims", "base_voxels")
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} double" for c in CHANNELS] + ["error double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # the base met last, its slopes and places
        for batch in batches:
            out = []
            for dims, voxels, shape, other in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1), batch.column(len(kept) + 2).to_pylist(), batch.column(len(kept) + 3), strict=True):
                if dims != shape:
                    raise ValueError(f"a frame of {dims} has a base of {shape}")
                size_zyx = [dims[a] for a in "zyx"]
                frame, first = (np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float)).reshape(size_zyx) for v in (voxels, other))
                name = first.tobytes()
                if name not in known or known[name][0].shape != first.shape:
                    known = {name: (first, _slopes(first, spacing), S.grid(first.shape))}
                first, slopes, places = known[name]
                p, error = align(first, frame, spacing, slopes, steps, places=places)
                out.append([*p, error])
            numbers = np.array(out, float).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *(pa.array(numbers[:, k]) for k in range(7))], names=[*kept, *CHANNELS, "error"])

    return rows.mapInArrow(run, schema)


def align_frames(frames: DataFrame, base: DataFrame, size: Sequence[float] = (1.0, 1.0, 1.0), by: Sequence[str] = ("run",), t: str = "t", steps: int = 30) -> DataFrame:
    """by, t, the six channels (radians round the volume's centre, millimetres) and ``error``, the mean squared difference left.

    Frames and base are wide volumes of the same size (another size is an
    error); null and NaN voxels count as 0.  A frame that doesn't overlap its
    base, or shows nothing, keeps the best numbers met, at first zeros.
    """
    return align_rows(beside_base(frames, base, by, t), size, by, t, steps)
