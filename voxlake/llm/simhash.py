"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of five segments.  If two of them
differ in at most four bits, some segment starts a chain whose cumulative
differences stay within the proportional budgets 0, 1, 2, 3 and 4.  The first
two links of the chain make the index: a key holds one segment as it is and the
next with one bit left out, so two fingerprints share a key if and only if the
first link is equal and the second differs in one bit at most.  The further
links prune what meets there, then comes the full Hamming distance.

Equal fingerprints are collapsed first, and a bucket hands on one link a
fingerprint (to the least one it reaches in the bucket), never its pairs.
Large buckets are cut into blocks, and the pairs of blocks are dealt over tasks.
Which are large is told by cells, a segment and the next with all their bits, of
which a fingerprint has five; a bucket is made of two cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .storage import materialize

WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
BITS = 4
#: Rows of a bucket that are compared with the whole bucket at once, and rows of a block.
STRIP, BLOCK = 256, 8192


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit b is 1 if over half the XXH64 hashes of the shingles have it; no words give 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = (np.cumsum([len(x) + 1 for x in parts]) - 1).tolist()
    starts = [0, *(x + 1 for x in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [digest(joined, 42)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "td", "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        segments = [(fp >> np.uint64(o)) & np.uint64((1 << w) - 1) for o, w in zip(OFFSETS, WIDTHS, strict=True)]
        keys = []
        for i in range(5):
            j = (i + 1) % 5
            for bit in range(WIDTHS[j]):
                tag = np.uint64((i << 4) | bit)
                keys.append((tag << np.uint64(26)) | (segments[i] << np.uint64(13)) | (segments[j] & ~np.uint64(1 << bit)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, len(keys)).view(np.int64))], names=["key", "fp"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        segments = [(fp >> np.uint64(o)) & np.uint64((1 << w) - 1) for o, w in zip(OFFSETS, WIDTHS, strict=True)]
        cells = [(np.uint64(i) << np.uint64(30)) | (segments[i] << np.uint64(13)) | segments[(i + 1) % 5] for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64))], names=["cell"])


def _keys_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that a cell's fingerprints have, each with the cell's size."""
    for batch in batches:
        cell, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first, rest = cell >> 30, cell & ((1 << 26) - 1)
        keys, sizes = [], []
        for i in range(5):
            here = first == i
            for bit in range(WIDTHS[(i + 1) % 5]):
                keys.append((((i << 4) | bit) << 26) | (rest[here] & ~(1 << bit)))
                sizes.append(n[here])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], names=["__key", "n"])


def _in_chain(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the differing bits x stay within the budgets along the ring from segment ``first``."""
    diff = np.stack([np.bitwise_count((x >> np.uint64(o)) & np.uint64((1 << w) - 1)) for o, w in zip(OFFSETS, WIDTHS, strict=True)]).astype(np.int64)
    total, ok, at = np.zeros(x.shape, np.int64), np.ones(x.shape, bool), first.copy()
    for link in range(1, 6):
        total += np.take_along_axis(diff, at[None, :], 0)[0]
        ok &= total * 5 <= link * BITS
        at = (at + 1) % 5
    return ok & (np.bitwise_count(x) <= BITS)


def _linked(key: np.ndarray, fp: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint it reaches in its buckets), for rows that lie together by key, or by group; only moves are returned."""
    group = key if group is None else group
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, len(key)])
    pairs = []
    end_of = np.repeat(heads + sizes, sizes)
    first = ((key >> 30) & 7).astype(np.int64)
    small = np.repeat(sizes <= STRIP, sizes)
    place = np.flatnonzero(small & (end_of - np.arange(len(key)) > 1))
    step = 1
    while len(place):
        place = place[place + step < end_of[place]]
        if not len(place):
            break
        ok = _in_chain(fp[place] ^ fp[place + step], first[place])
        pairs.append((place[ok], place[ok] + step))
        step += 1
    label = np.arange(len(key))
    _spread(label, pairs)
    for h, n in zip(heads[sizes > STRIP].tolist(), sizes[sizes > STRIP].tolist(), strict=True):
        for at in range(h, h + n, STRIP):
            to = min(at + STRIP, h + n)
            x = fp[at:to, None] ^ fp[None, h : h + n]
            a, b = np.nonzero(np.bitwise_count(x) <= BITS)
            keep = a + at < b + h
            a, b = a[keep] + at, b[keep] + h
            ok = _in_chain(fp[a] ^ fp[b], first[a])
            _spread(label, [(a[ok], b[ok])])
    moved = np.flatnonzero(fp[label] != fp)
    return fp[moved], fp[label[moved]]


def _spread(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Give both ends of each pair, and all that already share a label with them, the least label."""
    if not pairs:
        return
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    if not len(a):
        return
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and blocks (key, a, b, fp) in; links out.  A pair of blocks has 2 * BLOCK rows or so."""
    held = None
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(4)]
        if held is not None:
            rows = [np.r_[x, y] for x, y in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])]
        cut = int(np.flatnonzero(new)[-1])
        held = [x[cut:] for x in rows]
        if cut:
            yield _links(rows[0][:cut], rows[3][:cut], np.cumsum(new[:cut]))
    if held is not None and len(held[0]):
        yield _links(held[0], held[3], np.zeros(len(held[0]), np.int64))


def _links(key: np.ndarray, fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    a, b = _linked(key, fp.view(np.uint64), group)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _in_buckets(prints: DataFrame) -> DataFrame:
    """(key, a, b, fp): each fingerprint once for every key, and in large buckets for every pair of blocks that its own takes part in."""
    cells = prints.mapInArrow(_cells, "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 2)
    # of a bucket's two cells the smaller may not be counted
    large = cells.mapInArrow(_keys_of_cells, "__key long, n long").groupBy("__key").agg(F.ceil((F.sum("n") + BLOCK // 2) / BLOCK).cast("int").alias("blocks"))
    large = materialize(large, "large")
    entered = prints.mapInArrow(_keys, "key long, fp long").join(large, F.col("key") == F.col("__key"), "left")
    one, block = F.array(F.lit(0)), F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    dealt = entered.select("key", "fp", block.alias("block"), F.explode(F.when(F.col("blocks").isNull(), one).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("o"))
    return dealt.select("key", F.coalesce(F.least("block", "o"), F.lit(0)).alias("a"), F.coalesce(F.greatest("block", "o"), F.lit(0)).alias("b"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: the identifier, __td (a digest of the text), fingerprint, component_id and kept.

    Texts are lower-cased (A-Z) and split at space and U+0009-000D; shingles of
    ``shingle`` words count with repeats, a shorter text is one shingle, and a
    text without words (or null) has fingerprint zero and links like any other.
    Fingerprints link at four or fewer differing bits; component_id is the
    smallest identifier reachable and null only if no identifier is.  kept
    holds for the row of that identifier; rows that repeat it with another text
    keep the one with the least digest, and equal rows of it all stay.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(ident.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("td"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    prints = materialize(rows.mapInArrow(_fingerprints(shingle), f"id {id_type}, td long, fp long"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "td")).alias("least"))
    group = ["key", "a", "b"]
    links = _in_buckets(distinct.select("fp")).repartition(*group).sortWithinPartitions(*group).mapInArrow(_bucket_links, "a long, b long")
    roots = connected_components(links)
    groups = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # a table of its own, so that the join may split what a large component gathers
    best = materialize(groups.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("best")), "components")
    groups = groups.join(best, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "best")
    found = prints.join(groups, F.col("fp") == F.col("__fp"))
    return found.select(
        F.col("id").alias(id_col), F.col("td").alias("__td"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"), (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("td") == F.col("best.td"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns but internal ones."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])
    found = near_duplicates(docs, id_col, text_col, shingle).where("not kept").select(F.col(f"`{id_col}`").alias("__id"), "__td").distinct()
    td = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (td == F.col("__td")), "left_anti")
