"""Regions grown from centres: what hangs together, face to face, with a centre voxel.

Voxels above the threshold are dealt by blocks of the grid.  A block numbers its
own pieces; pieces that touch across two blocks are links, found by an
equi-join of the voxels on the blocks' faces alone.  Pieces are few, and joining
linked ones takes a few rounds of minima and look-ups over them; no region and
no volume is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.batches import map_whole_groups
from ..model import AXES
from ..storage import cut


#: Voxels of the blocks that are numbered together.
VOXELS_AT_ONCE = 65_536


def pieces(seen: np.ndarray) -> np.ndarray:
    """Number of each voxel's piece in a block, from 1; 0 where ``seen`` is false.  Pieces hang together by faces.

    The last three axes are a block's; an axis before them numbers blocks.
    """
    size = int(np.prod(seen.shape[-3:]))
    out = np.ascontiguousarray(np.where(seen, np.arange(1, size + 1).reshape(seen.shape[-3:]), 0))
    flat = out.reshape(-1, size)
    while True:
        old = out.copy()
        for axis in range(-3, 0):
            for turned in (False, True):
                v = np.flip(out, axis) if turned else out
                a, b = (np.take(v, range(*r), axis) for r in ((0, v.shape[axis] - 1), (1, v.shape[axis])))
                low = np.where((a > 0) & (b > 0), np.minimum(a, b), b)
                to = [slice(None)] * v.ndim
                to[axis] = slice(1, None)
                v[tuple(to)] = low
        while True:  # a number is a place: look up what that place has by now
            next_ = np.where(flat > 0, np.take_along_axis(flat, np.maximum(flat, 1) - 1, axis=1), 0)
            if (next_ == flat).all():
                break
            flat[:] = next_
        if (out == old).all():
            return out


def joined(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): the least node that each reaches.

    Each round hooks every root to the least root beside it, follows the hooks
    to their ends by doubling, and looks the links up again; rounds grow with
    the logarithm of a region's extent in blocks, not with it.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").withColumnRenamed("a", "at"))
        if hooks.isEmpty():
            return roots
        while True:
            further = hooks.select(F.col("at").alias("to"), F.col("to").alias("__next"))
            ahead = cut(hooks.join(further, "to", "left").select("at", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("moved")))
            moved, hooks = not ahead.where("moved").isEmpty(), ahead.select("at", "to")
            if not moved:
                break
        look = lambda c: hooks.select(F.col("at").alias(c), F.col("to").alias(f"__{c}"))
        roots = cut(roots.join(look("root"), "root", "left").select("node", F.coalesce("__root", "root").alias("root")))
        edges = edges.join(look("a"), "a", "left").join(look("b"), "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())


def label_regions(df: DataFrame, by: Sequence[str] = ("image_id",), block: int = 32) -> DataFrame:
    """``df`` (by, x, y, z: the voxels seen) plus ``region``: the same for voxels that hang together by faces, whatever blocks they lie in.

    A region is named by its least piece's block and number.  A voxel given
    twice counts once.
    """
    corner = [F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in AXES]
    rows = df.select(*by, *[F.col(a).cast("int").alias(a) for a in AXES]).distinct().select("*", *corner)
    names = [*by, *AXES, "bx", "by_", "bz"]
    rows = rows.toDF(*names)

    place_of = [names.index(a) for a in AXES]
    at_once = max(1, VOXELS_AT_ONCE // block**3)

    def number(batch: pa.RecordBatch, group: np.ndarray) -> list[pa.Array]:
        place, piece = [batch.column(k).to_numpy() % block for k in place_of], np.zeros(batch.num_rows, np.int64)
        ends = np.searchsorted(group, np.arange(0, group[-1] + 1 + at_once, at_once))
        for h, e in zip(ends[:-1], ends[1:], strict=True):
            here = (group[h:e] - group[h], *(p[h:e] for p in place))
            seen = np.zeros((group[e - 1] - group[h] + 1, *(block,) * 3), bool)
            seen[here] = True
            piece[h:e] = pieces(seen)[here]
        return [*batch.columns, pa.array(piece)]

    numbered = map_whole_groups(rows, [*by, "bx", "by_", "bz"], number, StructType([*rows.schema, StructField("piece", LongType())]))
    told = cut(numbered.select(*by, *AXES, F.struct(*by, "bx", "by_", "bz", "piece").alias("piece")))
    links = None
    for a in AXES:
        face = told.where(F.col(a) % block == block - 1).select(*by, *[(F.col(x) + int(x == a)).alias(x) for x in AXES], F.col("piece").alias("a"))
        other = told.where(F.col(a) % block == 0).select(*by, *AXES, F.col("piece").alias("b"))
        part = face.join(other, [*by, *AXES]).select("a", "b")
        links = part if links is None else links.union(part)
    roots = joined(links)
    return told.join(roots.withColumnRenamed("node", "piece"), "piece", "left").select(*by, *AXES, F.coalesce("root", "piece").alias("region"))


def grow(df: DataFrame, centres: DataFrame, by: Sequence[str] = ("image_id",), v: str = "v", block: int = 32) -> DataFrame:
    """by, nth, x, y, z: the voxels of each centre's region.

    ``centres`` has by, nth, x, y, z and ``thr``, a share between 0 and 1: seen
    are the voxels whose value is at least that share of the way from the
    image's least to its largest.  A centre that isn't seen grows nothing; a
    null value isn't seen.  ``volume.mask_union`` makes one mask of several.
    """
    range_ = df.groupBy(*by).agg(F.min(v).alias("__low"), F.max(v).alias("__high"))
    wanted = centres.select(*by, "nth", "thr").join(range_, list(by)).select(*by, "nth", (F.col("__low") + F.col("thr") * (F.col("__high") - F.col("__low"))).alias("__least"))
    seen = df.join(wanted, list(by)).where(F.col(v) >= F.col("__least")).select(*by, "nth", *AXES)
    regions = cut(label_regions(seen, [*by, "nth"], block))
    chosen = regions.join(centres.select(*by, "nth", *[F.col(a).cast("int").alias(a) for a in AXES]), [*by, "nth", *AXES]).select("region").distinct()
    return regions.join(chosen, "region", "left_semi").select(*by, "nth", *AXES)
