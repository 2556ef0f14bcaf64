"""Embedding near-dedup: cross-polytope hashing with verified pairs.

A hash rotates the vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest signed axis; two hashes, or three where the
caller asks for it, make a bucket of a table.  Every vector enters its most likely
bucket of each table and some next ones (multiprobe).  What goes to the buckets
is the identifier and a sketch of SKETCH sign bits, not the vector: only
vectors that meet one whose sketch is as near as linked vectors' sketches are go
on, and these are verified by cosine in double precision.

Equal vectors are collapsed into one class with a weight.  Buckets hand on, for
each vector, the weight it links with and one link towards its component; a
pair counts only in the first bucket that both entered, so nothing has to
emit pairs.  Buckets above a size are cut into blocks, and the pairs of blocks
are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import connected_components
from .simhash import _spread
from .storage import materialize, release

ROUNDS = 3
#: (name, hashes a bucket, tables, probes a table).  Deeper buckets are smaller, at more rows a vector; tables and probes keep the share of pairs at the limit of 0.9 that are found above 0.99 at either depth.
DEPTHS = (("plain", 2, 6, 3), ("deep", 3, 8, 8))
#: (hashes, dimension from which it holds, tables, probes): longer vectors need more to be found as often.
WIDE = ((2, 513, 10, 6), (2, 65, 8, 4), (3, 513, 10, 12))
#: Sign bits of a sketch, and standard deviations that linked vectors' sketches may lie above their mean distance.
SKETCH, SPREAD = 128, 5.5
#: Rows of a bucket that one task compares with one another: sketches, and vectors.
SKETCH_BLOCK, BLOCK = 32_768, 512
SEED = 4


def depth_for(name: str) -> tuple[int, int, int]:
    """(hashes, tables, probes) of a named depth."""
    return next(d[1:] for d in DEPTHS if d[0] == name)


def depth_at(depth: tuple[int, int, int], dim: int) -> tuple[int, int, int]:
    """``depth`` with the tables and probes that vectors of ``dim`` components need."""
    return next(((depth[0], *w[2:]) for w in WIDE if depth[0] == w[0] and dim >= w[1]), depth)


def _signs(dim: int, hashes: int, tables: int) -> np.ndarray:
    """Random signs for each table, hash and round."""
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, hashes, ROUNDS, dim))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, k = x.shape[1], 1
    while k < n:
        y = x.reshape(len(x), n // (2 * k), 2, k)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), n)
        k *= 2
    return x / np.sqrt(n)


def _best_axes(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest signed axes of each row, and how far each falls behind the first."""
    size = np.abs(x)
    at = np.argsort(-size, axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(size, at, 1)
    negative = np.take_along_axis(x, at, 1) < 0
    return 2 * at + negative, value[:, :1] - value


def bucket_codes(unit: np.ndarray, depth: tuple[int, int, int]) -> np.ndarray:
    """(rows, tables, probes): the buckets that each row enters, likeliest first; distinct within a table."""
    hashes, tables, probes = depth
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    signs, out = _signs(width, hashes, tables), []
    for t in range(tables):
        code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for k in range(hashes):
            x = padded
            for r in range(ROUNDS):
                x = _hadamard(x * signs[t, k, r])
            axes, behind = _best_axes(x, min(probes, width))
            code = (code[:, :, None] * (2 * width) + axes[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + behind[:, None, :]).reshape(n, -1)
            # what isn't among the likeliest now can't be later
            pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, pick, 1), np.take_along_axis(cost, pick, 1)
        out.append(code)
    return np.stack(out, axis=1)


def _units(values: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows by dimension: (row numbers, unit vectors) of arrays of finite components that aren't all zero."""
    lengths = values.value_lengths().to_numpy()
    flat = np.asarray(values.flatten(), dtype=np.float64)
    ends = np.cumsum(lengths)
    found = []
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can neither overflow nor vanish
        found.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return found


def sketch_limit(least: float) -> int:
    """Bits in which the sketches of two vectors at cosine ``least`` differ at most, but for one pair in about ten million."""
    p = float(np.arccos(np.clip(least, -1.0, 1.0)) / np.pi)
    return int(np.ceil(SKETCH * p + SPREAD * np.sqrt(SKETCH * p * (1 - p))))


def _coded(depth: tuple[int, int, int]):
    """(class, weight, vector) in; with the vector packed, its sketch and the buckets it enters out.

    Vectors go as 32-bit floats where these hold them exactly.  A bucket's
    number holds the table above 48 bits and the code below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = part.column(2)
                for rows, unit in _units(values):
                    dim = unit.shape[1]
                    if dim not in planes:
                        planes[dim] = np.random.default_rng(SEED + 1).standard_normal((dim, SKETCH))
                    sketch = np.packbits(unit @ planes[dim] > 0, axis=1, bitorder="little").view("<i8")
                    codes = bucket_codes(unit, depth_at(depth, dim))
                    n, tables, probes = codes.shape
                    buckets = codes | (np.arange(tables, dtype=np.int64) << 48)[None, :, None]
                    raw = np.stack([np.asarray(values[int(r)].values, np.float64) for r in rows])
                    exact = (raw.astype(np.float32).astype(np.float64) == raw).all(1)
                    vectors = [(v.astype(np.float32) if e else v).tobytes() for v, e in zip(raw, exact, strict=True)]
                    take = pa.array(rows)
                    ends = pa.array(np.arange(n + 1) * tables * probes, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(take), part.column(1).take(take), pa.array(np.full(n, dim, np.int32)), pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1])),
                            pa.array(vectors, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(buckets.reshape(-1))),
                        ],
                        names=["id", "w", "dim", "s0", "s1", "vector", "buckets"],
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch], tags: int) -> Iterator[pa.RecordBatch]:
    """Runs of two rows or more that agree in the first ``tags`` columns, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = [held[0].column(i)[0] for i in range(tags)] if held else None
        if held and all(batch.column(i)[batch.num_rows - 1] == first[i] for i in range(tags)):
            held.append(batch)  # one group still: nothing is put together before it ends
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
        tag = np.stack([np.asarray(rows.column(i)) for i in range(tags)])
        heads = np.flatnonzero(np.r_[True, (tag[:, 1:] != tag[:, :-1]).any(0)])
        for h, e in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if e - h > 1:
                yield rows.slice(h, e - h)
        held = [rows.slice(heads[-1])]
    if sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _near_sketches(limit: int):
    """Rows sorted by bucket and blocks (bucket, a, b, id, s0, s1, block) in; (bucket, id) of those near another out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in _groups(batches, 3):
            a, b = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
            block, near = rows.column(6).to_numpy(), np.zeros(rows.num_rows, bool)
            s = np.stack([rows.column(k).to_numpy() for k in (4, 5)], axis=1).view(np.uint64)
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            for at in range(0, len(left), 256):
                i = left[at : at + 256]
                bits = np.bitwise_count(s[i, None, 0] ^ s[None, right, 0]) + np.bitwise_count(s[i, None, 1] ^ s[None, right, 1])
                x, y = np.nonzero(bits <= limit)
                x, y = i[x], right[y]
                other = x != y
                near[x[other]] = True
                near[y[other]] = True
            if near.any():
                out.append((np.full(int(near.sum()), rows.column(0)[0].as_py(), np.int64), rows.column(3).to_numpy()[near]))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["bucket", "id"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["bucket", "id"])

    return run


def _compare(least: float):
    """Rows sorted by bucket and blocks (dim, bucket, a, b) in; (id, weight linked, least id reached) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 4):
            yield from _group(rows, least)

    return run


def _group(rows: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    dim, bucket, a, b = (rows.column(i)[0].as_py() for i in range(4))
    ids, w, block = rows.column(4).to_numpy(), rows.column(5).to_numpy(), rows.column(8).to_numpy()
    unit = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in rows.column(6).to_pylist()])
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    entered = rows.column(7).flatten().to_numpy().reshape(len(ids), -1)
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    order = np.argsort(ids, kind="stable")
    linked, label, pairs = np.zeros(len(ids), np.int64), np.argsort(order, kind="stable"), []
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        x, y = np.nonzero(unit[i] @ unit[right].T >= least)
        x, y = i[x], right[y]
        keep = x < y if a == b else np.ones(len(x), bool)
        x, y = x[keep], y[keep]
        for s in range(0, len(x), 20_000):
            x1, y1 = x[s : s + 20_000], y[s : s + 20_000]
            own = ~_met_before(entered, x1, y1, bucket)
            x1, y1 = x1[own], y1[own]
            np.add.at(linked, x1, w[y1])
            np.add.at(linked, y1, w[x1])
            pairs.append((label[x1], label[y1]))
    reach = np.arange(len(ids))
    _spread(reach, pairs)
    out = np.flatnonzero(linked)
    yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(linked[out]), pa.array(ids[order[reach[label[out]]]])], names=["id", "linked", "to"])


def _met_before(entered: np.ndarray, x: np.ndarray, y: np.ndarray, bucket: int) -> np.ndarray:
    """Whether two vectors share a bucket of a lower number: a pair counts where it meets first."""
    met = np.zeros(len(x), bool)
    for p in range(entered.shape[1]):
        mine = entered[x, p]
        met |= (mine < bucket) & (entered[y] == mine[:, None]).any(1)
    return met


def _in_blocks(rows: DataFrame, bucket: list[str], most: int, name: str) -> DataFrame:
    """``rows`` plus block and a, b: each row once for every pair of blocks of its bucket that its own takes part in."""
    # only the large buckets are joined back: a small table, which Spark broadcasts if its size allows
    large = materialize(rows.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*[F.col(c).alias(f"__{c}") for c in bucket], F.ceil(F.col("n") / most).cast("int").alias("blocks")), name)
    same = F.lit(True)
    for c in bucket:
        same = same & (F.col(c) == F.col(f"__{c}"))
    placed = rows.join(large, same, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*bucket, F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), *[c for c in rows.columns if c not in bucket], "block")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, depth: tuple[int, int, int] | None = None) -> DataFrame:
    """All columns of ``vectors`` plus n_links, component_id and kept.

    Linked are vectors of one dimension that share a bucket and whose cosine is
    ``least`` or more.  Vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do rows whose identifier is null.  Rows
    that repeat an identifier count as vectors of their own: equal vectors link
    with each other.  component_id is the smallest identifier reachable, the
    own one included; kept says that it is the own one.  Columns of the input
    that bear a result's name are replaced; an empty table gives an empty one.

    ``depth`` is (hashes a bucket, tables, probes a table) and by itself the
    plain one of DEPTHS, however many vectors there are: which pairs are found
    never depends on the number of vectors.  It decides in how many buckets
    vectors meet: each depth there finds 0.99 or more of the pairs at a cosine
    of 0.9, and other pairs more often the nearer they are.
    """
    names = {"n_links", "component_id", "kept"}
    kept = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in names and not c.startswith("__")]
    ident, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    number = F.transform(vector, lambda v: v.cast("double"))
    sound = ident.isNotNull() & F.coalesce(F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(number, lambda v: v != 0), F.lit(False))
    # adding zero makes -0.0 and 0.0 one
    rows = vectors.select(*kept, ident.alias("__id"), F.when(sound, F.transform(number, lambda v: v + F.lit(0.0))).alias("__v"))
    same = rows.where("__v is not null").groupBy("__v").agg(F.min("__id").alias("id"), F.count("*").alias("w"))
    depth = depth or depth_for("plain")
    coded = materialize(same.select("id", "w", "__v").mapInArrow(_coded(depth), "id long, w long, dim int, s0 long, s1 long, vector binary, buckets array<long>"), "coded")
    entered = coded.select(F.explode("buckets").alias("bucket"), "id", "s0", "s1")
    group = ["bucket", "a", "b"]
    dealt = _in_blocks(entered, ["bucket"], SKETCH_BLOCK, "large").repartition(*group).sortWithinPartitions(*group)
    # a vector of a large bucket may be near another in several pairs of blocks
    members = materialize(dealt.mapInArrow(_near_sketches(sketch_limit(least)), "bucket long, id long").distinct(), "members")
    found = members.join(coded.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).select("dim", "bucket", "id", "w", "vector", "buckets")
    group = ["dim", "bucket", "a", "b"]
    dealt = _in_blocks(found, ["dim", "bucket"], BLOCK, "large").repartition(*group).sortWithinPartitions(*group)
    links = materialize(dealt.mapInArrow(_compare(least), "id long, linked long, to long"), "links")
    release(coded)
    release(members)

    counts = links.groupBy("id").agg(F.sum("linked").alias("linked"))
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = same.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    # 128 bits stand for the vector, so that it isn't sent once more
    digest = [F.xxhash64("__v").alias("__d0"), F.xxhash64(F.lit(SEED), "__v").alias("__d1")]
    classes = classes.select(*digest, (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("__n"), F.coalesce("root", "id").alias("__c"))
    rows = rows.select("*", *[F.when(F.col("__v").isNotNull(), d).alias(f"__e{k}") for k, d in enumerate(digest)]).drop("__v")
    found = rows.join(classes, (F.col("__e0") == F.col("__d0")) & (F.col("__e1") == F.col("__d1")), "left")
    component = F.coalesce("__c", "__id")
    return found.select(*kept, F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(False)).alias("kept"))
