"""Periodic runs of words: stretches that repeat one period four times or more.

Block matching.  A run of period q, 2**k <= q < 2**(k+1), holds an aligned block
of B = 2**k words together with the same block q words further on: its first
aligned block begins less than B words after its start, and B - 1 + q + B is
below 4q.  So for each scale the aligned blocks of a text are the keys of an
Aho-Corasick automaton over word numbers (pyahocorasick, keys are sequences of
integers), the text is searched for them, and an occurrence that lies B to
2B - 1 words behind an aligned block of the same key is a seed.  Seeds are
extended in both directions as far as words q apart are identical.

A block is left out where it can't be part of a run of its scale: if one of
its words doesn't come again within 2B - 1 words, or if a run of a smaller
period holds the block and all places where its copy could be, as a copy is
then a whole number of those periods away.

Each text is worked on by one task and by itself; seeds of a scale are at most
as many as words, and each stretch is extended once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Least length of a run in words, and in periods.
LEAST, TIMES = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_numbers(words: list) -> np.ndarray:
    """Equal words get equal numbers, from 0 in the order of their first places."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _again(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to the next that is identical; the number of words where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _equal_after(ids: np.ndarray, i: int, j: int) -> int:
    """Number of identical words from places i < j on."""
    got, step, most = 0, 32, len(ids) - j
    while got < most:
        k = min(step, most - got)
        differ = ids[i + got : i + got + k] != ids[j + got : j + got + k]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, step = got + k, min(2 * step, 1 << 16)
    return most


def _equal_before(ids: np.ndarray, i: int, j: int) -> int:
    """Number of identical words before places i < j."""
    got, step = 0, 32
    while got < i:
        k = min(step, i - got)
        differ = (ids[i - got - k : i - got] != ids[j - got - k : j - got])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, step = got + k, min(2 * step, 1 << 16)
    return i


def _has_smaller_period(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether a stretch of period q, 2q words or longer, repeats a proper part of q."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(ids[start : start + q], ids[start + d : start + d + q]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def _seeds(ids: np.ndarray, size: int, blocks: np.ndarray) -> list[tuple[int, int]]:
    """(distance, place of the aligned block) of the copies of aligned blocks at distances of this scale, sorted."""
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple, int] = {}
    key_at: dict[int, int] = {}
    for b in blocks.tolist():
        word = tuple(ids[b : b + size].tolist())
        if word not in number:
            number[word] = len(number)
            keys.add_word(word, number[word])
        key_at[b] = number[word]
    keys.make_automaton()
    found = []
    # parts of the text in which no copy could lie aren't searched
    cuts = np.flatnonzero(np.diff(blocks) > 3 * size) + 1
    for near in np.split(blocks, cuts):
        low, high = int(near[0]), min(len(ids), int(near[-1]) + 3 * size)
        for end, key in keys.iter(tuple(ids[low:high].tolist())):
            at = low + end - size + 1
            b = (at - size) // size * size  # the one aligned place that lies size to 2 * size - 1 words before
            if key_at.get(b) == key:
                found.append((at - b, b))
    return sorted(set(found))


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and then period."""
    n, size, runs = len(ids), 1, []
    again, reach = _again(ids), None
    while TIMES * size <= n and n >= LEAST:
        whole = n // size
        ok = (again[: whole * size] < 2 * size).reshape(whole, size).all(axis=1)
        blocks = np.flatnonzero(ok) * size
        if reach is not None and len(blocks):
            blocks = blocks[reach[blocks] < blocks + 3 * size - 1]
        new = []
        if len(blocks):
            period, until = 0, 0
            for q, b in _seeds(ids, size, blocks):
                if q == period and b < until:
                    continue
                start, until, period = b - _equal_before(ids, b, b + q), b + _equal_after(ids, b, b + q), q
                length = until + q - start
                if length >= max(LEAST, TIMES * q) and not _has_smaller_period(ids, start, q):
                    new.append((start, length, q))
        for start, length, _ in new:
            reach = np.zeros(n, np.int64) if reach is None else reach
            part = reach[start : start + length]
            np.maximum(part, start + length, out=part)
        runs += new
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus runs and collapsed.

    Words are what lies between space and U+0009-000D.  ``runs`` holds
    (start, length, period) of every stretch whose words, ``period`` apart, are
    identical, whose smallest period that is, which has six words and four
    periods or more and which no neighbouring word extends; by start, then
    period.  ``collapsed`` is the text, its words joined by one space, without
    the words that a run holds after its first period.

    Null, empty and blank texts have no runs and collapse to ''.  Each row is
    worked on by itself, repeated rows too; a text of any length in one task.
    Columns that bear a result's name are replaced; an empty table gives an
    empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed") and c != text_col and not c.startswith("__")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema] + [f"runs array<{RUN}>", "collapsed string"])
    fields = pa.struct([pa.field(k, pa.int64()) for k in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, left = [], []
                for text in part.column(len(kept)).cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    runs = find_runs(word_numbers(words))
                    found.append(runs)
                    left.append(b" ".join(collapse(words, runs)))
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(fields)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), lists, pa.array(left, pa.binary()).view(pa.string())], names=[*kept, "runs", "collapsed"])

    return docs.select(*[f"`{c}`" for c in kept], f"`{text_col}`").mapInArrow(run, schema)
