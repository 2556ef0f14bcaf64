"""Voxel algebra on long volumes: cutting, padding, reorienting, masking, merging.

All of these are projections, filters or equi-joins on coordinates; none needs
a volume in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..model import AXES
from .order import place_in_order
from .resample import half_away

SIDES = {"L": ("x", 0), "R": ("x", 1), "P": ("y", 0), "A": ("y", 1), "I": ("z", 0), "S": ("z", 1)}


def slice_at(df: DataFrame, axis: str, place: int) -> DataFrame:
    """One orthogonal slice."""
    return df.where(F.col(axis) == place)


def ordered_limits(a: Column, b: Column) -> tuple[Column, Column]:
    """Two limits in order."""
    return F.least(a, b), F.greatest(a, b)


def crop(df: DataFrame, limits: Mapping[str, tuple[int, int]], dims: Mapping[str, int] | None = None) -> DataFrame:
    """Voxels between inclusive limits on each named axis, moved to begin at 0.  Limits may be in either order; with ``dims`` they end at the last voxel."""
    for axis, ends in limits.items():
        low, high = sorted(ends)
        if dims:
            high = min(high, dims[axis] - 1)
        df = df.where(F.col(axis).between(low, high)).withColumn(axis, F.col(axis) - low)
    return df


def _per_side(counts: Mapping[str, float], dims: Sequence[int], origin: Sequence[float] | None, doing: str) -> tuple[dict[str, list[int]], list[float]]:
    origin = [abs(o) for o in origin] if origin is not None else [0, 0, 0]
    if not any(origin):
        origin = [float(int((d + 1) / 2 + 0.5)) for d in dims]
    out = {a: [0, 0] for a in AXES}
    for side, count in counts.items():
        axis, end = SIDES[side]
        k, n = AXES.index(axis), int(half_away(count))
        if n < 0 or (n > dims[k] - origin[k] if end else n >= origin[k]):
            raise ValueError(f"{doing} {count} at {side} is negative or reaches beyond the origin")
        out[axis][end] = n
    return out, origin


def clip(df: DataFrame, cut: Mapping[str, float], dims: Sequence[int], origin: Sequence[float] | None = None) -> tuple[DataFrame, list[float]]:
    """Voxels off the sides L, R, P, A, I and S; the volume and its new origin (1-based; the middle where none is given)."""
    sides, origin = _per_side(cut, dims, origin, "cutting")
    for k, axis in enumerate(AXES):
        low, high = sides[axis]
        df = df.where(F.col(axis).between(low, dims[k] - 1 - high)).withColumn(axis, F.col(axis) - low)
    return df, [o - sides[a][0] for o, a in zip(origin, AXES, strict=True)]


def pad(df: DataFrame, add: Mapping[str, float], dims: Sequence[int], origin: Sequence[float] | None = None, background: float = 0.0, by: Sequence[str] = ("image_id", "t")) -> tuple[DataFrame, list[float]]:
    """Background voxels on the sides L, R, P, A, I and S; the volume and its new origin.  A count beyond the origin is refused, as it always was.

    Only the border is generated, as six slabs from one row a volume; the voxels
    that are there are moved without a join.
    """
    sides, origin = _per_side(add, dims, origin, "padding")
    moved = df.select(*by, *[(F.col(a) + sides[a][0]).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v"))
    slabs, ranges = [], {a: (0, d + sum(sides[a]) - 1) for a, d in zip(AXES, dims, strict=True)}
    for a, d in zip(AXES, dims, strict=True):
        low, high = sides[a]
        slabs += [ranges | {a: r} for r in ((0, low - 1), (low + d, low + d + high - 1)) if r[0] <= r[1]]
        ranges = ranges | {a: (low, low + d - 1)}  # the slabs of later axes lie between those of this one
    if not slabs:
        return moved, [o + sides[a][0] for o, a in zip(origin, AXES, strict=True)]
    each = F.array(*[F.struct(*[F.struct(F.lit(r[0]).alias("a"), F.lit(r[1]).alias("b")).alias(a) for a, r in slab.items()]) for slab in slabs])
    border = df.select(*by).distinct().select(*by, F.explode(each).alias("__s"))
    for a in AXES:
        border = border.withColumn(a, F.explode(F.sequence(F.col(f"__s.{a}.a"), F.col(f"__s.{a}.b"))))
    border = border.select(*by, *AXES, F.lit(float(background)).alias("v"))
    return moved.unionByName(border), [o + sides[a][0] for o, a in zip(origin, AXES, strict=True)]


def signed_axes(combination: Sequence[str]) -> list[tuple[str, bool]]:
    """(source axis, flipped) of each new axis, from names such as ``['-x', 'z', '-y']``."""
    out = [(c.lstrip("-+"), c.startswith("-")) for c in combination]
    if sorted(a for a, _ in out) != sorted(AXES):
        raise ValueError(f"not a signed permutation of the axes: {combination}")
    return out


def inverse_axes(combination: Sequence[str]) -> list[str]:
    """The combination that undoes another."""
    out = [""] * 3
    for new, (axis, flipped) in enumerate(signed_axes(combination)):
        out[AXES.index(axis)] = ("-" if flipped else "") + AXES[new]
    return out


def from_orient_codes(codes: Sequence[int]) -> list[str]:
    """The combination for a 3-digit orientation: the k-th code is the direction of stored axis k, 1-3 for right, front, top and 4-6 for their opposites."""
    if sorted((c - 1) % 3 for c in codes) != [0, 1, 2]:
        raise ValueError(f"not an orientation: {codes}")
    out = [""] * 3
    for k, code in enumerate(codes):
        out[(code - 1) % 3] = ("-" if code > 3 else "") + AXES[k]
    return out


def reorient(df: DataFrame, combination: Sequence[str], dims: Sequence[int]) -> DataFrame:
    """Axes swapped and flipped: new axis k runs along the k-th named one, backwards with a minus."""
    size = dict(zip(AXES, dims, strict=True))
    new = {a: (F.lit(size[src] - 1) - F.col(src) if flipped else F.col(src)).cast("int") for a, (src, flipped) in zip(AXES, signed_axes(combination), strict=True)}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def apply_mask(df: DataFrame, mask: DataFrame, value: str = "m", on: Sequence[str] = AXES) -> DataFrame:
    """Voxels times the mask's value at their place; 0 where the mask has none.  The mask has a row a place."""
    known = mask.select(*on, F.col(value).alias("__m"))
    return df.join(known, list(on), "left").select(*[(F.col("v") * F.coalesce("__m", F.lit(0))).alias("v") if c == "v" else F.col(c) for c in df.columns])


def threshold(df: DataFrame, least: float, binary: bool = True) -> DataFrame:
    """Values below ``least`` become 0; the others 1, or stay."""
    kept = F.lit(1.0) if binary else F.col("v")
    return df.withColumn("v", F.when(F.col("v") >= F.lit(float(least)), kept).otherwise(0.0))


def overlaps(a: DataFrame, b: DataFrame, on: Sequence[str] = AXES, label: str = "label") -> DataFrame:
    """Places where two label volumes have different labels above 0."""
    right = b.select(*on, F.col(label).alias("other"))
    return a.join(right, list(on)).where((F.col(label) > 0) & (F.col("other") > 0) & (F.col(label) != F.col("other"))).select(*on, label, "other")


def check_no_overlap(a: DataFrame, b: DataFrame, on: Sequence[str] = AXES, label: str = "label") -> None:
    """An error if two label volumes disagree anywhere."""
    found = overlaps(a, b, on, label).take(1)
    if found:
        raise ValueError(f"labels overlap at {found[0]}")


def mask_union(masks: DataFrame, on: Sequence[str] = AXES, thr: str | None = None) -> DataFrame:
    """1 where any mask is above 0; with ``thr`` only masks whose threshold is above 0 count, and the first."""
    if thr:
        masks = masks.where((F.col(thr) > 0) | (F.col("nth") == 1))
    return masks.groupBy(*on).agg((F.max("m") > 0).cast("int").alias("m"))


def first_volume(df: DataFrame, t: str = "t") -> DataFrame:
    return df.where(F.col(t) == 0)


def value_range(df: DataFrame, by: Sequence[str] = ("image_id",), whole: bool = False) -> DataFrame:
    """glmin and glmax, rounded half away from zero with ``whole``."""
    low, high = F.min("v"), F.max("v")
    return df.groupBy(*by).agg((F.round(low) if whole else low).alias("glmin"), (F.round(high) if whole else high).alias("glmax"))


def histogram(df: DataFrame, bins: int | None = 10, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Counts of values in ``bins`` equal bins between the least and the largest, or of each whole number if ``bins`` is None.

    Columns: bin (from 0, or the number itself) and n; empty bins have no row.
    """
    if bins is None:
        return df.groupBy(*by, F.col("v").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.withColumn("bin", _bin(bins, by)).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def _bin(bins: int, by: Sequence[str]) -> Column:
    """Number of a value's bin between the least and the largest of its volume, which share one exchange with what is done by volume."""
    low, high = F.min("v").over(W.partitionBy(*by)), F.max("v").over(W.partitionBy(*by))
    return F.when(high == low, 0).otherwise(F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))).cast("long")


def equalise(df: DataFrame, bins: int = 256, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Values replaced by the share of voxels in their bin or below: flattened histogram."""
    rows = df.withColumn("__bin", _bin(bins, by))
    below = F.count("*").over(W.partitionBy(*by).orderBy("__bin").rangeBetween(W.unboundedPreceding, 0))
    share = below / F.count("*").over(W.partitionBy(*by))
    return rows.select(*[share.alias("v") if c == "v" else F.col(c) for c in df.columns])


def concatenate(parts: Sequence[tuple[DataFrame, int]], axis: str = "t") -> DataFrame:
    """Volumes one after another along an axis; each part comes with its length there."""
    out, at = None, 0
    for df, length in parts:
        moved = df.withColumn(axis, (F.col(axis) + at).cast(df.schema[axis].dataType))
        out, at = moved if out is None else out.unionByName(moved), at + length
    return out


def frames_by_name(df: DataFrame, name: str = "path", t: str = "t") -> DataFrame:
    """Single volumes numbered in the order of their file names.  Only the names are sorted, in ranges."""
    return df.drop(t).join(place_in_order(df.select(name).distinct(), name, t).withColumn(t, F.col(t).cast("int")), name)


def replace_slices(df: DataFrame, patch: DataFrame, by: Sequence[str] = ("image_id",), on: Sequence[str] = ("t", "z")) -> DataFrame:
    """The volume with the slices that ``patch`` has in its place."""
    named = patch.select(*by, *on).distinct()
    return df.join(named, [*by, *on], "left_anti").unionByName(patch.select(*df.columns))
