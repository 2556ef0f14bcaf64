"""SimHash near-dedup at a similarity of whole shingle sets: the general form of ``simhash``.

A text is the set of its shingles, and its fingerprint has 256 bits.  Texts
whose sets have a Jaccard similarity of 0.8 differ in 38 bits on average (62 at
most among those measured), unlike texts in 128; texts that differ in BUDGET
bits or fewer are compared by their whole sets, so no pair below the similarity
asked for links.

The bits make a ring of SEGMENTS segments, in RINGS orders of the bits.  Two
fingerprints meet if a segment of some ring is equal in both.  From there the
differences along the ring must stay within the proportional budgets
(pigeonring filtering); the last link of that chain is the full Hamming
distance.  Two texts at a similarity of exactly 0.8 meet with a probability of
0.995 or so, at 0.85 with 0.999; copies of one text mostly reach each other by
more than one link.

Equal sets are collapsed first.  Within a bucket rows lie by the size of their
sets, and only those are compared whose sizes allow the similarity; a large
bucket is cut into blocks, whose pairs are dealt over tasks.  A bucket hands on
a spanning forest of the pairs that meet in it, each text's nearest partner
among them, less the pairs that meet in an earlier bucket too.  No connection is
lost by that: what an earlier bucket leaves of a pair joins its ends there, by
pairs that are handed on themselves or meet earlier still.  So a pair is handed
on once, and what a group hands on grows with its texts, whatever the number of
buckets that they share.  Each pair is verified, and tells besides which texts
hang together by partners at all.  What the verified pairs link is one
component.  Where texts that hang together are still in several components, all
pairs of these within BUDGET bits are verified in blocks of texts, each text
with its set: nothing is left out, and no pairs are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import prepare
from .components import connected_components
from .embed_dedup import _groups
from .simhash import _spread
from .storage import materialize, release

WORDS, SEGMENTS, WIDTH, BUDGET, RINGS = 4, 16, 16, 64, 7
#: Rows of a block of a large bucket; pairs of blocks are dealt over tasks.
PART = 512
#: One of so many texts is counted to find the large buckets.
SAMPLE = 16
#: Buckets of so many rows are compared together with others.
FEW = 64
#: Texts of a block whose sets are compared with those of another, and their shingles (8 bytes each).
BLOCK, GRAMS = 256, 500_000
#: A pair of blocks and a row's own block in one number.
_BLOCK_BITS, _BLOCK_MASK = 20, (1 << 20) - 1
_ORDERS = [np.random.default_rng(3 + r).permutation(64 * WORDS) for r in range(RINGS)]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FP = tuple(f"f{k}" for k in range(WORDS))


def _masks() -> np.ndarray:
    """(rings, segments, words): the bits of each segment."""
    out = np.zeros((RINGS, SEGMENTS, WORDS), np.uint64)
    for r, order in enumerate(_ORDERS):
        for k, bit in enumerate(order.tolist()):
            out[r, k // WIDTH, bit // 64] |= np.uint64(1 << (bit % 64))
    return out


_MASKS = _masks()


class _Hashes(dict):
    """Hashes of words, each worked out once as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(self) < 500_000:
            self[word] = found
        return found


_hashes = _Hashes()


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; a shorter text is one shingle, no words give none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - shingle + 1)
    # a text of fewer words is one shingle of all of them, its length taking part
    out = np.full(n, min(len(h), shingle), np.uint64)
    for k in range(min(len(h), shingle)):
        out = _scrambled(out * _MIX[1] + h[k : k + n])
    return np.unique(out)


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """Bit b of the 256 is 1 if over half the shingles' hashes have it; no shingles give 0."""
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(grams), 64 * 255):
        part = grams[at : at + 64 * 255]
        for w in range(WORDS):
            bits = np.unpackbits(_scrambled(part * _MIX[w + 1]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
            counts[w] += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(grams), axis=1, bitorder="little").view("<u8")[:, 0]


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes())


def _signed(values: list | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(2)]
            prints = np.array([fingerprint(s) for s in sets], np.uint64).reshape(len(sets), WORDS)
            columns = [batch.column(0), batch.column(1), _signed([_node(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), *(_signed(prints[:, w]) for w in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "td", "node", "n", *_FP])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column(0).slice(at, 256)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([_signed([_node(s) for s in sets]), pa.ListArray.from_arrays(ends, _signed(np.concatenate([*sets, np.zeros(0, np.uint64)])))], names=["node", "grams"])

    return run


def segment_keys(prints: np.ndarray) -> np.ndarray:
    """(rows, rings * segments) keys: the segment's bits below its number."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    rings = [np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u2") for order in _ORDERS]
    return np.hstack(rings).astype(np.int64) | (np.arange(RINGS * SEGMENTS, dtype=np.int64) << WIDTH)


def _prints_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(at + w).to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, fingerprint) in; for each segment of each ring a row (bucket, node, fingerprint) out, the bucket's number above 32 bits and the size below."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = (segment_keys(_prints_of(part, 2)) << 32) | part.column(1).to_numpy().astype(np.int64)[:, None]
            who = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.column(0).take(who), *(part.column(2 + w).take(who) for w in range(WORDS))], names=["bucket", "node", *_FP])


def _enter_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fingerprint) in; the numbers of its buckets out."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(segment_keys(_prints_of(batch, 0)).reshape(-1))], names=["key"])


def in_chain(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the differing bits x (pairs by words) stay within the budgets along the key's ring from its segment."""
    where = key >> WIDTH
    ring, at = where // SEGMENTS, where % SEGMENTS
    total, ok = np.zeros(len(x), np.int64), np.arange(len(x))
    for link in range(1, SEGMENTS + 1):
        total[ok] += np.bitwise_count(x[ok] & _MASKS[ring[ok], (at[ok] + link - 1) % SEGMENTS]).sum(1, dtype=np.int64)
        ok = ok[total[ok] * SEGMENTS <= link * BUDGET]
    out = np.zeros(len(x), bool)
    out[ok] = True
    return out


def _partners(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], key: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, bits) of the pairs of rows (size, fingerprint), sorted by size, that pass the chain."""
    found = []
    step = max(1, min(128, (1 << 18) // max(1, len(b[0]))))
    for at in range(0, len(a[0]), step):
        size = a[0][at : at + step]
        low, high = np.searchsorted(b[0], size[0] * least - 1e-6), np.searchsorted(b[0], size[-1] / least + 1e-6, side="right")
        x = a[1][at : at + step, None] ^ b[1][None, low:high]
        d = np.bitwise_count(x).sum(2, dtype=np.int64)
        one, two = a[0][at : at + step, None], b[0][None, low:high]
        i, j = np.nonzero((d <= BUDGET) & (np.minimum(one, two) >= np.maximum(one, two) * least - 1e-6))
        keep = in_chain(x[i, j], np.full(len(i), key, np.int64))
        found.append((i[keep] + at, j[keep] + low, d[i[keep], j[keep]]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _in_group(key: int, a: int, b: int, block: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that hold together what meets in a bucket's blocks a and b, or in the whole bucket where both are 0.

    A pair of different blocks has those alone that join the pieces which hang
    together within each block.
    """

    def met(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = _partners((size[left], prints[left]), (size[right], prints[right]), key, least)
        i, j = left[i], right[j]
        return (i, j, d) if left is not right else (i[i < j], j[i < j], d[i < j])

    left, right, label = np.flatnonzero(block == a), np.flatnonzero(block == b), np.arange(len(node))
    if a == b:
        return _forest(label, node, *met(left, left))
    i, j, d = met(left, right) if len(left) and len(right) else (label[:0],) * 3
    if len(i):
        _spread(label, [met(x, x)[:2] for x in (left, right)])
    return _forest(label, node, i, j, d)


def _forest(label: np.ndarray, node: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of rows that make a spanning forest of the least distances d, each row's nearest partner among them.

    label: for each row the least row that it hangs together with already; it
    is changed.  Ties go by the numbers of the nodes, so that buckets choose alike.
    """
    left, chosen = np.lexsort((np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), d)), [np.zeros(0, np.int64)]
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            break
        place, best = np.arange(len(left)), np.full((2, len(label)), len(left))
        for k, end in enumerate((i, j)):
            best[k, label[end[left]][::-1]] = place[::-1]  # of repeated places the last one stays: the nearest pair
        pick = np.unique(best.min(0))
        pick = left[pick[pick < len(left)]]
        chosen.append(pick)
        _spread(label, [(i[pick], j[pick])])
    pick = np.concatenate(chosen)
    return i[pick], j[pick]


def _first(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether pairs of differing bits x, which meet in the bucket of key, meet in no bucket before it."""
    out = np.ones(len(x), bool)
    for at in range(0, len(x), 4096):
        part, where = x[at : at + 4096], key[at : at + 4096] >> WIDTH
        same = (segment_keys(part) & ((1 << WIDTH) - 1) == 0) & (np.arange(RINGS * SEGMENTS) < where[:, None])
        ask = np.flatnonzero(same.any(1))
        while len(ask):
            before = same[ask].argmax(1)
            same[ask, before] = False
            met = in_chain(part[ask], before << WIDTH)
            out[at + ask[met]] = False
            ask = ask[~met]
            ask = ask[same[ask].any(1)]
    return out


def _together(group: np.ndarray, key: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that hold together what meets in many whole groups of a few rows each."""
    place, step, found = np.arange(len(group)), 1, []
    while True:
        place = place[place + step < len(group)]
        place = place[(group[place] == group[place + step]) & (size[place] >= size[place + step] * least - 1e-6)]
        if not len(place):
            break
        x = prints[place] ^ prints[place + step]
        d = np.bitwise_count(x).sum(1, dtype=np.int64)
        near = np.flatnonzero(d <= BUDGET)
        near = near[in_chain(x[near], key[place[near]].astype(np.int64))]
        found.append((place[near], place[near] + step, d[near]))
        step += 1
    i, j, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    return _forest(np.arange(len(group)), node, i, j, d)


_MET = "a long, b long, verify boolean"


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each pair of nodes with the lesser first and once: to verify, and as a link."""
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    ends = np.concatenate([both, both])
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1])), pa.array(np.arange(len(ends)) < len(both))], names=["a", "b", "verify"])


def _meet(least: float):
    """Rows (bucket, deal, node, fingerprint) sorted by bucket, pair of blocks and size in; pairs to verify and links between texts that hang together out."""

    def met(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, deal, node, prints = (np.concatenate(x) for x in zip(*rows, strict=True))
        key, size = bucket >> 32, bucket & 0xFFFFFFFF
        heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (deal[1:] >> _BLOCK_BITS != deal[:-1] >> _BLOCK_BITS)])
        sizes = np.diff(np.r_[heads, len(key)])
        few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
        group = np.repeat(np.arange(len(heads)), sizes)
        found = [tuple(few[x] for x in _together(group[few], key[few], node[few], size[few], prints[few], least))]
        for h, n in zip(heads[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            here = slice(h, h + n)
            a, b = int(deal[h]) >> 2 * _BLOCK_BITS, int(deal[h]) >> _BLOCK_BITS & _BLOCK_MASK
            found.append(tuple(h + x for x in _in_group(int(key[h]), a, b, deal[here] & _BLOCK_MASK, node[here], size[here], prints[here], least)))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        new = _first(prints[i] ^ prints[j], key[i])
        return _batch(node[i[new]], node[j[new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _prints_of(batch, 3))
            at = lambda k, r=rows: (r[0][k] >> 32, r[1][k] >> _BLOCK_BITS)
            new = (rows[0][1:] >> 32 != rows[0][:-1] >> 32) | (rows[1][1:] >> _BLOCK_BITS != rows[1][:-1] >> _BLOCK_BITS)
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if held and not cut and at(0) == at(0, held[0]):
                held.append(rows)  # one group still
                continue
            whole = [*held, tuple(x[:cut] for x in rows)]
            if held or cut:
                yield met(whole)
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield met(held)

    return run


def _verify_blocks(least: float):
    """Rows sorted by group and blocks (c, x, y, block, node, root, fingerprint, grams) in; verified links between different roots out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            x, y, block = rows.column(1)[0].as_py(), rows.column(2)[0].as_py(), rows.column(3).to_numpy()
            node, root = rows.column(4).to_numpy(), rows.column(5).to_numpy()
            prints = np.stack([rows.column(6 + w).to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)
            ends, flat = rows.column(6 + WORDS).offsets.to_numpy(), rows.column(6 + WORDS).values.to_numpy()
            sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            size = np.diff(ends)
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            found = []
            for at in range(0, len(left), 128):
                i = left[at : at + 128]
                d = np.bitwise_count(prints[i, None] ^ prints[None, right]).sum(2, dtype=np.int64)
                like = np.minimum(size[i, None], size[None, right]) >= least * np.maximum(size[i, None], size[None, right]) - 1e-6
                p, q = np.nonzero((d <= BUDGET) & like & (root[i, None] != root[None, right]))
                for p, q in zip(i[p].tolist(), right[q].tolist(), strict=True):  # noqa: B020
                    shared = np.intersect1d(sets[p], sets[q], assume_unique=True).size
                    if shared / (len(sets[p]) + len(sets[q]) - shared) >= least:
                        found.append((node[p], node[q]))
            links = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k])) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    similar = shared / (F.size("x") + F.size("y") - shared) >= F.lit(least)
    alike = F.least(F.size("x"), F.size("y")) / F.greatest(F.size("x"), F.size("y")) >= F.lit(least)
    return materialize(pairs.join(one, "a").join(two, "b").where(alike & similar).select("a", "b"), "links")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): components of the old roots, so that only new links are looked at."""
    old = lambda name: roots.select(F.col("node").alias(f"_{name}"), F.col("root").alias(f"_root_{name}"))
    ends = links.join(old("a"), F.col("a") == F.col("_a"), "left").join(old("b"), F.col("b") == F.col("_b"), "left")
    merged = materialize(connected_components(ends.select(F.coalesce("_root_a", "a").alias("a"), F.coalesce("_root_b", "b").alias("b"))), "merged")
    new = merged.select(F.col("node").alias("_node"), F.col("root").alias("_new"))
    known = roots.join(new, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return materialize(known.union(merged.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _roots(met: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, root) of the components that all verified pairs make; met: (a, b, verify), nodes: (node, fingerprint)."""
    links = _verified(met.where("verify").select("a", "b").distinct(), sets, least)
    roots = materialize(connected_components(links), "roots")
    # components that hang together by partners, and their texts
    old = lambda name: roots.select(F.col("node").alias(f"_{name}"), F.col("root").alias(f"_root_{name}"))
    hang = met.where("not verify").select("a", "b").distinct().join(old("a"), F.col("a") == F.col("_a"), "left").join(old("b"), F.col("b") == F.col("_b"), "left")
    groups = connected_components(hang.select(F.coalesce("_root_a", "a").alias("a"), F.coalesce("_root_b", "b").alias("b")))
    groups = groups.select(F.col("node").alias("_r"), F.col("root").alias("c"))
    placed = groups.join(roots, F.col("_r") == F.col("root"), "left").select(F.coalesce("node", "_r").alias("node"), "c", F.col("_r").alias("root"))
    placed = materialize(placed.join(nodes.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).drop("_n"), "placed")
    return _joined(roots, materialize(_dealt(placed, nodes, sets).mapInArrow(_verify_blocks(least), "a long, b long"), "links"))


def _dealt(placed: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Texts (node, c, root, n) of each group c with their sets, once for each pair of blocks that they take part in.

    The texts of a group's largest root make blocks of their own, numbered
    after the others: pairs of these blocks are left out, as their texts are
    joined already.
    """
    each = placed.groupBy("c", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("grams") / GRAMS)).cast("int")
    main = each.groupBy("c").agg(F.max_by(F.struct("root", blocks.alias("blocks")), F.struct("rows", "root")).alias("m"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.max_by(F.struct("rows", "grams"), F.struct("rows", "root")).alias("of"))
    minor = F.ceil(F.greatest((F.col("rows") - F.col("of.rows")) / BLOCK, (F.col("grams") - F.col("of.grams")) / GRAMS)).cast("int")
    main = materialize(main.select(F.col("c").alias("_c"), F.col("m.root").alias("_main"), F.col("m.blocks").alias("_big"), minor.alias("_few")), "groups")
    own = F.col("root") == F.col("_main")
    rows = placed.join(main.where("_few > 0"), F.col("c") == F.col("_c"))
    rows = rows.withColumn("block", F.when(own, F.col("_few") + F.pmod(F.xxhash64("node"), "_big")).otherwise(F.pmod(F.xxhash64("node"), "_few")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(own, F.col("_few")).otherwise(F.col("_few") + F.col("_big")) - 1)))
    rows = rows.select("c", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "node", "root")
    group = ["c", "x", "y"]
    return rows.join(nodes.select("node", *_FP), "node").join(sets, "node").select(*group, "block", "node", "root", *_FP, "grams").repartition(*group).sortWithinPartitions(*group)


def _in_blocks(entered: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of buckets with ``deal``: a pair of blocks and the row's own, 0 in buckets that aren't large.

    Rows of a large bucket go to every pair of blocks that their own takes part
    in.  Large buckets are told by a count over one of SAMPLE texts; it only
    decides how the work is dealt, never what is compared.
    """
    seen = nodes.where("n > 0").where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select(*_FP).mapInArrow(_enter_keys, "key long")
    blocks = F.least(F.ceil(F.col("k") * SAMPLE / PART), F.lit(_BLOCK_MASK)).cast("int")
    large = materialize(seen.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") * SAMPLE > 2 * PART).select("key", blocks.alias("blocks")), "large")
    rows = entered.join(large, F.shiftright("bucket", 32) == F.col("key"), "left")
    own = F.pmod(F.xxhash64("node"), "blocks")
    pair = lambda o: F.shiftleft(F.least(own, o), 2 * _BLOCK_BITS).bitwiseOR(F.shiftleft(F.greatest(own, o), _BLOCK_BITS)).bitwiseOR(own)
    deals = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), pair))
    return rows.select("bucket", F.explode(deals).alias("deal"), "node", *_FP)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: the identifier, __td (a digest of the text), component_id and kept.

    Texts are lower-cased (A-Z) and split at space and U+0009-000D; a text is
    the set of its shingles of ``shingle`` words, a shorter text is one shingle,
    and texts without words (or null) are equal.  Texts link if they meet (see
    above) and their sets have a Jaccard similarity of ``least`` or more;
    component_id is the smallest identifier reachable and null only if no
    identifier is.  kept holds for the row of that identifier; rows that repeat
    it with another text keep the one with the least digest, and equal rows of
    it all stay.  An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(ident.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("td"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    prints = materialize(rows.mapInArrow(_signatures(shingle), f"id {id_type}, td long, node long, n int, {', '.join(f'{f} long' for f in _FP)}"), "signatures")
    nodes = materialize(prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "td")).alias("least"), F.max("n").alias("n"), *[F.max(f).alias(f) for f in _FP]), "nodes")
    entered = nodes.where("n > 0").select("node", "n", *_FP).mapInArrow(_enter, f"bucket long, node long, {', '.join(f'{f} long' for f in _FP)}")
    group = [F.shiftright("bucket", 32), F.shiftright("deal", _BLOCK_BITS)]
    met = materialize(_in_blocks(entered, nodes).repartition(*group).sortWithinPartitions(*group, "bucket").mapInArrow(_meet(least), _MET), "met")
    # the sets of those alone that meet another, worked out anew from the text
    those = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    asked = nodes.join(those, "node", "left_semi").select(F.col("least.id").alias("__id"), F.col("least.td").alias("__td"))
    texts = rows.join(asked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("td") == F.col("__td")), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_sets(shingle), "node long, grams array<long>").dropDuplicates(["node"]), "sets")

    roots = _roots(met, nodes, sets, least)
    groups = nodes.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    # a table of its own, so that the join may split what a large component gathers
    best = materialize(groups.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("best")), "components")
    groups = groups.join(best, F.col("root") == F.col("__root")).select(F.col("node").alias("__node"), "best")
    found = prints.join(groups, F.col("node") == F.col("__node"))
    release(sets)
    release(met)
    return found.select(
        F.col("id").alias(id_col), F.col("td").alias("__td"), F.col("best.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("td") == F.col("best.td"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that near_copies keeps, with all their columns but internal ones."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])
    found = near_copies(docs, id_col, text_col, shingle, least).where("not kept").select(F.col(f"`{id_col}`").alias("__id"), "__td").distinct()
    td = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (td == F.col("__td")), "left_anti")
