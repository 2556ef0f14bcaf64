"""Registration of one volume to another by the correlation ratio.

The cost of a map is the share of the moving volume's variance that is left
within the bins of the fixed volume's values: 0 if one tells the other, 1 if it
tells nothing.  ``candidate_costs`` costs many maps in one pass over the
volumes, chunks of candidates dealt over tasks, and partial minima keep the
best; ``best_in_ranges`` answers every setting of a sweep over search ranges
from the same costs, one axis after the other.  ``register`` searches for the
map: turns on a grid at the coarsest of several halved volumes, then, level by
level, Gauss-Newton steps in up to twelve numbers and steps in each of them, to
where none of the smallest helps.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import spatial as S
from ..storage import cut

BINS = 32
#: Numbers of a map, in the order of ``spatial.affine``.
PARAMETERS = ("rx", "ry", "rz", "tx", "ty", "tz", "sx", "sy", "sz", "hxy", "hxz", "hyz")


def binned(fixed: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bin of each voxel, of equal width between the least and the largest value."""
    flat = fixed.reshape(-1)
    low, high = flat.min(), flat.max()
    return np.zeros(len(flat), np.int64) if high <= low else np.minimum(((flat - low) / (high - low) * bins).astype(np.int64), bins - 1)


def correlation_ratio(bins: np.ndarray, values: np.ndarray) -> float:
    """Share of the variance of ``values`` that is left within bins; 1 if they don't vary."""
    if len(values) < 2:
        return 1.0
    values = values - values.sum() / len(values)
    n, s = np.bincount(bins), np.bincount(bins, values)
    total = float(values @ values)
    return 1.0 if total <= 1e-12 else max(0.0, 1 - float((s * s / np.maximum(n, 1)).sum()) / total)


def cost_of(matrix: np.ndarray, bins: np.ndarray, places: np.ndarray, moving: np.ndarray, nearest: bool = False, overlap: float = 0.2, corners: np.ndarray | None = None) -> float:
    """Cost of the map of the fixed volume's places into the moving volume; 1 if less than ``overlap`` of them lies inside.

    ``corners`` are the moving volume's ``spatial.cells``, for many maps of one volume.
    """
    at = S.at(matrix, places)
    ok = np.flatnonzero(S.inside(moving.shape, at))
    if len(ok) < overlap * at.shape[1]:
        return 1.0
    if nearest:
        x, y, z = np.floor(at[:, ok] + 0.5).astype(np.int64)
        values = moving[np.clip(z, 0, moving.shape[0] - 1), np.clip(y, 0, moving.shape[1] - 1), np.clip(x, 0, moving.shape[2] - 1)]
    elif corners is not None:
        values = S.in_cells(corners, moving.shape, at.take(ok, axis=1))
    else:
        values = S.linear(moving, at[:, ok])
    return correlation_ratio(bins[ok], values)


def _pairs_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fixed, moving) of each row, from (dims, fixed, moving dims, moving) at column ``at`` on."""
    for row in zip(*(batch.column(at + k) for k in range(4)), strict=True):
        shapes = [[row[k].as_py()[a] for a in "zyx"] for k in (0, 2)]
        yield tuple(np.nan_to_num(row[k + 1].values.to_numpy(zero_copy_only=False).astype(float)).reshape(shape) for k, shape in zip((0, 2), shapes, strict=True))


def volume_pairs(fixed: DataFrame, moving: DataFrame, on: Sequence[str]) -> DataFrame:
    """Wide volumes side by side: on, dims, fixed, moving_dims, moving.  Neither side is broadcast: Spark's estimate of an array's size is far below a volume's."""
    return fixed.select(*on, "dims", F.col("voxels").alias("fixed")).join(moving.select(*on, F.col("dims").alias("moving_dims"), F.col("voxels").alias("moving")).hint("merge"), list(on))


def dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have: little data, much work, so that partitions aren't to be put together by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def candidate_costs(pairs: DataFrame, candidates: Sequence[Sequence[float]], by: Sequence[str], size: Sequence[float] = (1.0, 1.0, 1.0), bins: int = BINS, nearest: bool = False, chunk: int = 256, overlap: float = 0.2) -> DataFrame:
    """A row a pair and candidate: by, candidate (its place in the list), params, cost.

    A pair's volumes go to one task for each ``chunk`` candidates; null and NaN voxels count as 0.
    """
    every, spacing, n = [np.asarray(c, float) for c in candidates], np.asarray(size, float), len(by)
    chunks = math.ceil(len(every) / chunk)
    rows = pairs.select(*by, "dims", "fixed", "moving_dims", "moving")
    if chunks > 1:
        rows = dealt(rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), [*by, "__chunk"])
    else:
        rows = rows.withColumn("__chunk", F.lit(0))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + ["candidate int, params array<double>, cost double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (fixed, moving) in enumerate(_pairs_of(batch, n)):
                first = batch.column(n + 4)[k].as_py() * chunk
                here = every[first : first + chunk]
                levels, places, middle = binned(fixed, bins), S.grid(fixed.shape), S.centre(fixed.shape)
                costs = [cost_of(S.affine(p, middle, spacing), levels, places, moving, nearest, overlap) for p in here]
                same = pa.array(np.full(len(here), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in range(n)), pa.array(np.arange(first, first + len(here)), pa.int32()), pa.array([list(p) for p in here], pa.list_(pa.float64())), pa.array(costs, pa.float64())], names=[*by, "candidate", "params", "cost"])

    return rows.mapInArrow(run, schema)


def best_candidates(costs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The candidate of least cost of each pair, the first of equal ones."""
    best = F.min(F.struct("cost", "candidate", "params"))
    return costs.groupBy(*by).agg(best.alias("b")).select(*by, "b.candidate", "b.params", "b.cost")


def best_in_ranges(costs: DataFrame, axes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """For every setting of the sweep the candidate of least cost within it: by, <axis>_min and <axis>_max of each axis, candidate, cost.

    A setting is, for each axis, a range between two of the values that the
    pair's candidates have there, the first below the second.  Minima are taken
    one axis after the other, so that ranges of one axis are shared by all
    ranges of those that follow.

    The costs are read several times for each axis, so they are kept in the
    shared folder: a candidate is costed once.
    """
    costs = cut(costs.select(*by, *axes, "cost", "candidate"))
    rows, done = costs.select(*by, *axes, F.struct("cost", "candidate").alias("b")), []
    for a in axes:
        values = costs.select(*by, a).distinct()
        ranges = values.withColumnRenamed(a, f"{a}_min").join(values.withColumnRenamed(a, f"{a}_max"), list(by)).where(F.col(f"{a}_min") < F.col(f"{a}_max"))
        left = [x for x in axes if x != a and f"{x}_min" not in done]
        met = rows.join(ranges, list(by)).where(F.col(a).between(F.col(f"{a}_min"), F.col(f"{a}_max")))
        done += [f"{a}_min", f"{a}_max"]
        rows = met.groupBy(*by, *left, *done).agg(F.min("b").alias("b"))
    return rows.select(*by, *done, "b.candidate", "b.cost")


def _descend(p: np.ndarray, steps: np.ndarray, least: np.ndarray, cost, dof: int, now: float | None = None) -> tuple[np.ndarray, float]:
    """Steps in each number, of the size that helps, until none of ``least`` does; ``now`` is the cost at ``p`` where it is known."""
    now = cost(p) if now is None else now
    while True:
        before = p.copy()
        for k in range(dof):
            for turn in (1, -1):
                if turn < 0 and p[k] != start:
                    break  # a step back leads to where the last one forth came from
                start = p[k]
                while True:
                    new = p.copy()
                    new[k] += turn * steps[k]
                    then = cost(new)
                    if then >= now - 1e-12:
                        break
                    p, now = new, then
        moved = p - before
        if np.count_nonzero(moved) > 1:  # on along the way that all steps together have gone
            while (then := cost(p + moved)) < now - 1e-12:
                p, now = p + moved, then
        if not moved.any():
            if (steps[:dof] <= least[:dof]).all():
                return p, now
            steps = np.maximum(steps / 2, least)


def _newton(p: np.ndarray, steps: np.ndarray, least: np.ndarray, slopes, dof: int, rounds: int = 30) -> np.ndarray:
    """Gauss-Newton steps, at most twice ``steps`` each, as long as they help and aren't below ``least``.

    ``slopes`` gives a map's cost with the gradient and the curvature of what is left within bins.
    """
    now, gradient, curve = slopes(p)
    for _ in range(rounds):
        if gradient is None:
            break
        step = np.zeros(len(p))
        step[:dof] = np.linalg.lstsq(curve, gradient, rcond=1e-9)[0]
        step /= max(1.0, float((np.abs(step) / steps).max()) / 2)
        for _ in range(3):
            then = slopes(p - step)
            if then[0] < now - 1e-12:
                break
            step /= 2
        else:
            break
        p, (now, gradient, curve) = p - step, then
        if (np.abs(step) < least / 4).all():
            break
    return p


def _slopes(p: np.ndarray, dof: int, size: np.ndarray, bins: np.ndarray, places: np.ndarray, shape: tuple[int, int, int], corners: np.ndarray, overlap: float = 0.2) -> tuple[float, np.ndarray | None, np.ndarray | None]:
    """(``cost_of`` the map, gradient of its numerator and denominator together, curvature); voxels come in order of their bins, whose number is ``bins``."""
    middle = S.centre(shape[0])
    at = S.at(S.affine(p, middle, size), places)
    ok = np.flatnonzero(S.inside(shape[1], at))
    if len(ok) < max(2, overlap * at.shape[1]):
        return 1.0, None, None
    values, along = S.slopes_in_cells(corners, shape[1], at.take(ok, axis=1))
    bins = bins[ok]
    heads = np.r_[0, np.flatnonzero(np.diff(bins)) + 1]
    n = np.diff(np.r_[heads, len(bins)])
    values = values - values.mean()
    total = float(values @ values)
    if total <= 1e-12:
        return 1.0, None, None
    rest = values - np.repeat(np.add.reduceat(values, heads) / n, n)
    cost = float(rest @ rest) / total
    off, change = places.take(ok, axis=1) - middle[:, None], S.affine_slopes(p, dof, size)
    # the change of a value is the volume's slope along the way its place goes
    j = change[:, :, :3].reshape(dof, 9) @ (along[:, None] * off).reshape(9, -1) + change[:, :, 3] @ along
    sums = np.add.reduceat(j, heads, axis=1)
    return cost, j @ (rest - cost * values), j @ j.T - (sums / n) @ sums.T


def _settle(p: np.ndarray, steps: np.ndarray, least: np.ndarray, cost, slopes, dof: int) -> tuple[np.ndarray, float]:
    """Down to where neither a wide step (``steps``) nor a small one (``least``) in any number helps: most of the way by Gauss-Newton steps, which take few reads of the volume."""
    while True:
        near = _newton(p, steps, least, slopes, dof)
        p, now = _descend(near, steps, steps, cost, dof)
        if (p == near).all():
            return _descend(p, least, least, cost, dof, now)


def search(fixed: np.ndarray, moving: np.ndarray, size: np.ndarray, dof: int = 12, degrees: float = 30.0, grid_step: float = 15.0, levels: int = 2, bins: int = BINS, keep: int = 3) -> tuple[np.ndarray, float]:
    """(twelve numbers, cost) of the best map found; the first ``dof`` numbers are free."""
    pyramid = [(fixed, moving, size)]
    while len(pyramid) <= levels and min(*pyramid[-1][0].shape, *pyramid[-1][1].shape) >= 8:
        f, m, s = pyramid[-1]
        pyramid.append((S.halved(f), S.halved(m), s * 2))
    starts: list[tuple[float, np.ndarray]] = []
    for level in reversed(range(len(pyramid))):
        f, m, s = pyramid[level]
        labels, places, middle, corners = binned(f, max(4, min(bins, f.size // 32))), S.grid(f.shape), S.centre(f.shape), S.cells(m)
        order = np.argsort(labels, kind="stable")
        cost = lambda p, a=(labels, places, m), b=corners, c=middle, s=s: cost_of(S.affine(p, c, s), *a, corners=b)
        slopes = lambda p, a=(labels[order], places[:, order], (f.shape, m.shape), corners), s=s: _slopes(p, dof, s, *a)
        if not starts:
            turns = np.arange(-degrees, degrees + 1e-9, grid_step) if degrees else np.zeros(1)
            every = [np.r_[np.radians(t), np.zeros(9)] for t in itertools.product(turns, repeat=3)]
            starts = sorted(((cost(p), p) for p in every), key=lambda x: x[0])[:keep]
        step = float(s.mean())
        steps = np.r_[np.full(3, np.radians(max(1.0, grid_step / 4)) if level == len(pyramid) - 1 else np.radians(1.0)), np.full(3, step / 2), np.full(6, 0.02)]
        least = np.r_[np.full(3, 0.01), np.full(3, step / 20), np.full(6, 0.01)] / (4 if level == 0 else 1)
        found = [_settle(p, steps, least, cost, slopes, dof) for _, p in starts]
        starts = sorted(((c, p) for p, c in found), key=lambda x: x[0])[: keep if level else 1]
    return starts[0][1], starts[0][0]


def register(pairs: DataFrame, by: Sequence[str], size: Sequence[float] = (1.0, 1.0, 1.0), dof: int = 12, degrees: float = 30.0, grid_step: float = 15.0, levels: int = 2, bins: int = BINS, deal: bool = True) -> DataFrame:
    """by, params (twelve numbers), matrix (16 numbers, rows of the map of the fixed volume's voxels into the moving one's), cost, and ``still``, the cost of not moving.

    ``dof`` is 3 for turns, 6 for rigid maps, 9 with scales, 12 with shears;
    ``degrees`` bounds the turns that the search starts from.  A pair is one
    row and one search; pairs are dealt over all tasks.  Where pairs are made
    from something small, that may be ``dealt`` before, and the pairs are taken
    where they are (not ``deal``), so that no volume is exchanged.
    """
    n, spacing = len(by), np.asarray(size, float)
    rows = pairs.select(*by, "dims", "fixed", "moving_dims", "moving")
    rows = dealt(rows, by) if deal else rows
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + ["params array<double>, matrix array<double>, cost double, still double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (fixed, moving) in enumerate(_pairs_of(batch, n)):
                p, cost = search(fixed, moving, spacing, dof, degrees, grid_step, levels, bins)
                matrix = S.affine(p, S.centre(fixed.shape), spacing).reshape(-1)
                still = cost_of(S.affine([], S.centre(fixed.shape), spacing), binned(fixed, max(4, min(bins, fixed.size // 32))), S.grid(fixed.shape), moving)
                one = pa.array([k])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(one) for c in range(n)), pa.array([list(p)], pa.list_(pa.float64())), pa.array([list(matrix)], pa.list_(pa.float64())), pa.array([cost]), pa.array([still])], names=[*by, "params", "matrix", "cost", "still"])

    return rows.mapInArrow(run, schema)
