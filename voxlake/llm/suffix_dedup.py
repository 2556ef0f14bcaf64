"""Removal of long repeated byte strings with sharded suffix arrays.

A string of ``length`` bytes is a window.  Each window belongs to its least
hashed 32-byte gram, its anchor: equal windows have equal anchors at the same
offset, so an anchor's hash says in which shard a window can meet its equals.
Neighbouring windows share an anchor and form one context.

1. Anchors are found by sliding minima over the whole text.  A hash that
   occurs once in the corpus ends there.
2. Equal contexts become one with a multiplicity.
3. The contexts of each hash go into shards of bounded size.  There a suffix
   array is built by induced sorting; neighbouring windows whose permuted common
   prefix has ``length`` bytes form a class, and a class is repeated if its
   contexts' multiplicities add up to two or more.
4. A hash with very many contexts is dealt over several shards; each then hands
   on one digest for every distinct window, and digests of two shards that agree
   are repeated too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .storage import materialize, release
from .suffix_array import permuted_lcp, suffix_array

GRAM = 32
#: Bytes of text sorted at once, and contexts of one hash in a shard.
SHARD_BYTES, SHARD_CONTEXTS = 1_500_000, 1024
#: Parts that the distinct windows of a split hash are dealt to; more for more than 64 shards.
PARTS = np.uint64(1024)
#: Positions in a block of the anchor search.
BLOCK = 1 << 17

_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.random.default_rng(21).integers(1, 2**63, 6, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 18) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes."""
    h, k, step = _MIX[data], 1, 0
    while k < GRAM:
        h = h[:-k] * _ODD[step] + h[k:]
        k, step = 2 * k, step + 1
    h ^= h >> np.uint64(31)
    h *= _ODD[5]
    h ^= h >> np.uint64(29)
    return h


def _block_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the block: its anchor's place, and the hashes of all places."""
    h = _grams(data)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, k = length - GRAM + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: k - width], least[width - k :])
    return (least & _LOW).astype(np.int64), h


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, number of windows) of the anchors of texts laid end to end; none crosses an end."""
    total = len(data)
    for at in range(0, max(0, total - length + 1), BLOCK):
        block = data[at : at + BLOCK + length - 1]
        places, hashes = _block_anchors(block, length)
        starts = at + np.arange(len(places))
        text = np.searchsorted(ends, starts, side="right")
        inside = starts + length <= ends[np.minimum(text, len(ends) - 1)]
        places, starts, text = places[inside], starts[inside], text[inside]
        if not len(starts):
            continue
        new = np.r_[True, (places[1:] != places[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)]
        heads = np.flatnonzero(new)
        yield hashes[places[heads]].view(np.int64), starts[heads], np.diff(np.r_[heads, len(starts)])


def _find_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch):
                yield from _contexts_of(part, length)

    return run


def _by_bytes(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text; the text is column 2."""
    sizes = np.cumsum(np.array(batch.column(2).value_lengths().fill_null(0) if hasattr(batch.column(2), "value_lengths") else [len(x.as_py() or b"") for x in batch.column(2)], dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most)))
        yield batch.slice(at, to - at)
        at = to


def _contexts_of(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    texts = [x or b"" for x in batch.column(2).to_pylist()]
    joined = b"".join(texts)
    ends = np.cumsum([len(x) for x in texts])
    begins = ends - [len(x) for x in texts]
    view = memoryview(joined)
    for h, first, n in contexts(np.frombuffer(joined, np.uint8), ends, length):
        owner = np.searchsorted(ends, first, side="right")
        digest = np.array([xxhash.xxh3_64_intdigest(view[a : a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)], np.uint64).view(np.int64)
        # in periodic text one context follows itself; such a run is one row
        same = (h[1:] == h[:-1]) & (digest[1:] == digest[:-1]) & (owner[1:] == owner[:-1]) & (first[1:] == first[:-1] + n[:-1]) & (n[1:] == n[:-1])
        heads = np.flatnonzero(np.r_[True, ~same])
        rows = pa.array(owner[heads])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[heads]), pa.array(digest[heads]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first - begins[owner])[heads].astype(np.int64)), pa.array(n[heads].astype(np.int32)), pa.array(np.diff(np.r_[heads, len(h)]).astype(np.int64))],
            names=["h", "g", "id", "td", "s", "n", "r"],
        )


def _cut(length: int):
    """Cuts the contexts that are asked for out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch):
                texts, asked = part.column(2).to_pylist(), part.column(3)
                flat, rows = asked.flatten(), np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
                fields = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
                out = [texts[r][s : s + n + length - 1] for r, s, n in zip(rows.tolist(), fields["s"].to_pylist(), fields["n"].to_pylist(), strict=True)]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [fields["h"], fields["shard"], fields["shards"], fields["w"], part.column(0).take(take), part.column(1).take(take), fields["s"], fields["n"], fields["g"], pa.array(out, pa.binary())],
                    names=["h", "shard", "shards", "w", "id", "td", "s", "n", "g", "c"],
                )

    return run


def _sort_shards(length: int):
    """Runs of rows sorted by (h, shard) in; repeated windows and, of split hashes, distinct windows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            h, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.cumsum(batch.column(7).to_numpy().astype(np.int64) + length)
            begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])])
            at = 0
            for b in begins.tolist():
                # a shard may end where a group begins; the first group may go on from the last batch
                if b == 0 and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (h[0], shard[0]):
                    continue
                if size + (sizes[b - 1] if b else 0) - (sizes[at - 1] if at else 0) >= SHARD_BYTES:
                    yield _sorted(held + [batch.slice(at, b - at)] * (b > at), length)
                    held, size, at = [], 0, b
            held.append(batch.slice(at))
            size += int(sizes[-1] - (sizes[at - 1] if at else 0)) if batch.num_rows else 0
        if held:
            yield _sorted(held, length)

    return run


def _sorted(batches: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    column = {name: rows.column(name).combine_chunks() if isinstance(rows.column(name), pa.ChunkedArray) else rows.column(name) for name in rows.column_names}
    cut = column["c"].to_pylist()
    n = column["n"].to_numpy().astype(np.int64)
    lengths = n + length - 1
    begins = np.cumsum(lengths + 1) - lengths - 1
    # symbols: 0 ends the shard, 1 ends a context, bytes follow
    text = np.ones(int(lengths.sum()) + len(cut) + 1, np.uint16)
    body = np.frombuffer(b"\x00".join(cut), np.uint8).astype(np.uint16) + 2
    text[: len(body)] = body
    text[begins + lengths] = 1
    text[-1] = 0
    window = np.zeros(len(text), bool)
    owner = np.repeat(np.arange(len(cut)), n)
    place = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    window[place] = True

    sa = suffix_array(text)
    phi, plcp = permuted_lcp(text, sa, length)
    again = (plcp >= length) & window & window[phi]
    # windows in the array's order: those that go on from their predecessor belong to its class
    ordered = sa[window[sa]]
    classes = np.cumsum(~again[ordered]) - 1
    weight = column["w"].to_numpy()
    owner_of = np.zeros(len(text), np.int64)
    owner_of[place] = owner
    total = np.bincount(classes, weight[owner_of[ordered]])
    repeated = np.zeros(len(text), bool)
    repeated[ordered] = total[classes] >= 2

    hit, offset, once = repeated[place], place - begins[owner], (weight == 1)[owner]
    start = column["s"].to_numpy()[owner] + offset
    # runs of repeated windows of contexts that occur once; of the others, the contexts, for all their occurrences
    take = np.flatnonzero(hit & once)
    new = np.r_[True, (owner[take][1:] != owner[take][:-1]) | (start[take][1:] != start[take][:-1] + 1)] if len(take) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(take)] - 1
    many = np.unique(owner[hit & ~once])
    none = np.full(len(many), -1, np.int64)
    found = (np.r_[owner[take[heads]], many], np.r_[start[take[heads]], none], np.r_[start[take[tails]], none]) if len(take) else (many, none, none)
    h64, g64 = column["h"].to_numpy(), column["g"].to_numpy()
    named = tuple(np.r_[np.zeros(len(found[0]) - len(many), np.int64), v[many]] for v in (h64, g64))

    # a row of runs, or the distinct windows of a split hash that fall to one part
    shards = column["shards"].to_numpy()
    split = np.flatnonzero((shards > 1)[owner] & ~again[place])
    body8 = memoryview(b"\x00".join(cut))
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body8[p : p + length]) for p in place[split].tolist()), np.uint64).reshape(-1, 2)
    parts = PARTS * np.maximum(1, shards[owner[split]].astype(np.uint64) // np.uint64(64))
    part = ((digests[:, 0] % parts) ^ column["h"].to_numpy().view(np.uint64)[owner[split]]).view(np.int64)
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    who = pa.array(np.r_[found[0], owner[split][order]].astype(np.int64))
    ends = pa.array(np.r_[[0] * min(1, len(found[0])), len(found[0]) + heads, len(who)].astype(np.int32))
    fields = {
        "id": column["id"].take(who),
        "td": column["td"].take(who),
        "a": pa.array(np.r_[found[1], start[split][order]].astype(np.int64)),
        "b": pa.array(np.r_[found[2], start[split][order]].astype(np.int64)),
        "x": pa.array(np.r_[named[0], digests[order, 0].view(np.int64)]),
        "y": pa.array(np.r_[named[1], digests[order, 1].view(np.int64)]),
        "settled": pa.array(np.r_[np.ones(len(found[0]), bool), (hit | ~once)[split][order]]),
    }
    names = pa.array([None] * min(1, len(found[0])) + part[order][heads].tolist(), pa.int64())
    lists = {k: pa.ListArray.from_arrays(ends, v) for k, v in fields.items()}
    return pa.RecordBatch.from_arrays([names, *lists.values()], names=["part", *lists])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part in; windows whose digest two shards have and that their own left open, out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            if held and held[-1].column(0)[0].as_py() != row.column(0)[0].as_py():
                yield _agreed(held)
                held = []
            held.append(row)
    if held:
        yield _agreed(held)


def _agreed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    column = {k: pa.concat_arrays([r.column(k).flatten() for r in rows]) for k in rows[0].schema.names[1:]}
    x, y = column["x"].to_numpy(), column["y"].to_numpy()
    order = np.lexsort((y, x))
    same = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
    found = np.zeros(len(x), bool)
    found[order] = np.r_[same, False] | np.r_[False, same]
    take = pa.array(np.flatnonzero(found & ~np.asarray(column["settled"])))
    return pa.RecordBatch.from_arrays([column[k].take(take) for k in ("id", "td", "a", "b")], names=["id", "td", "a", "b"])


def _remove(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch):
                out = [_kept(text or b"", spans or [], length) for text, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                columns = [part.column(i) for i in range(4, part.num_columns)]
                columns += [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                names = [*part.schema.names[4:], "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([x[4] for x in out], pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _kept(text: bytes, spans: list[dict], length: int) -> tuple[int, int, int, str, bytes]:
    parts, at, count = [], 0, 0
    for a, b in sorted((x["a"], x["b"] + length) for x in spans):
        if a > at or not count:
            parts.append(text[at:a])
            count += 1
        at = max(at, b)
    parts.append(text[at:])
    kept = b"".join(parts)
    return len(text), len(text) - len(kept), count, hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, plus n_bytes, n_removed, n_spans and kept_sha256; ``with_text`` adds kept_bytes.

    A byte goes if any string of ``length`` bytes that covers it also starts
    elsewhere in the corpus, in the same text or another; overlaps count, and
    no string crosses texts.  n_spans counts maximal removed runs.  What is left
    of a text need not be valid UTF-8, hence bytes.  Null counts as empty.
    Rows that repeat an identifier are told apart by their text; equal rows get
    equal results, and each is the other's repetition.  Columns of the input
    that bear a result's name are replaced; an empty table gives an empty one.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    results = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"}
    kept = [c for c in docs.columns if c.lower() not in results and c != text_col and not c.startswith("__")]
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    base = docs.select(ident.alias("id"), F.xxhash64(text).alias("td"), text.alias("text"), *[F.col(f"`{c}`").alias(f"__k_{c}") for c in kept])
    id_type = base.schema["id"].dataType.simpleString()

    every = materialize(base.where(F.length("text") >= length).select("id", "td", "text").mapInArrow(_find_contexts(length), f"h long, g long, id {id_type}, td long, s long, n int, r long"), "anchors")
    # these tables stand alone, so that a join may split what a frequent hash gathers
    hashes = materialize(every.groupBy(F.col("h").alias("__h")).agg(F.sum("r").alias("c")).where("c > 1").select("__h"), "hashes")
    shared = materialize(every.join(hashes, F.col("h") == F.col("__h")).drop("__h"), "shared")
    release(every)
    release(hashes)

    counted = materialize(shared.groupBy("h", "g").agg(F.sum("r").alias("w"), F.min(F.struct("id", "td", "s", "n")).alias("at")), "contexts")
    groups = materialize(counted.groupBy(F.col("h").alias("__h")).agg(F.count("*").alias("k")), "groups")
    asked = counted.join(groups, F.col("h") == F.col("__h")).withColumn("shards", F.ceil(F.col("k") / SHARD_CONTEXTS).cast("int"))
    asked = asked.select("at.id", "at.td", F.struct("h", F.pmod("g", "shards").cast("int").alias("shard"), "shards", "w", "at.s", "at.n", "g").alias("x"))
    asked = asked.groupBy(F.col("id").alias("__id"), F.col("td").alias("__td")).agg(F.collect_list("x").alias("asked"))
    cut = base.select("id", "td", "text").join(asked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("td") == F.col("__td"))).select("id", "td", "text", "asked")
    cut = cut.mapInArrow(_cut(length), f"h long, shard int, shards int, w long, id {id_type}, td long, s long, n int, g long, c binary")
    windows = f"part long, id array<{id_type}>, td array<long>, a array<long>, b array<long>, x array<long>, y array<long>, settled array<boolean>"
    found = materialize(cut.repartition("h", "shard").sortWithinPartitions("h", "shard").mapInArrow(_sort_shards(length), windows), "windows")
    release(groups)
    inside = found.where("part is null").select(F.inline(F.arrays_zip("id", "td", "a", "b", "x", "y")))
    many = inside.where("a < 0").select(F.col("x").alias("__h"), F.col("y").alias("__g"))
    settled = shared.join(many, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).select("id", "td", F.col("s").alias("a"), (F.col("s") + F.col("n") * F.col("r") - 1).alias("b"))
    across = found.where("part is not null").repartition("part").sortWithinPartitions("part").mapInArrow(_agree, f"id {id_type}, td long, a long, b long")
    spans = settled.union(inside.where("a >= 0").select("id", "td", "a", "b")).union(across)

    spans = spans.groupBy(F.col("id").alias("__id"), F.col("td").alias("__td")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = base.join(spans, F.col("id").eqNullSafe(F.col("__id")) & (F.col("td") == F.col("__td")), "left")
    rows = rows.select(*[F.col(c).alias(f"__{c}__") for c in ("id", "td", "text", "spans")], *[F.col(f"`__k_{c}`").alias(c) for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept_bytes binary"] * with_text)
    return rows.mapInArrow(_remove(length, with_text), schema)
