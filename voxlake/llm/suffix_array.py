"""Suffix arrays by induced sorting, and permuted longest common prefixes, in NumPy.

``suffix_array`` classifies suffixes as S or L, sorts and names the leftmost-S
(LMS) substrings by several symbols at a time, orders the string of names by
calling itself, and induces the full array from that order.  Inducing is
linear.  Where buckets are large, as those of bytes, each bucket's entries go in
as a few vector steps, in the order of the scan; where they hold few entries, as
those of names, entries go in one by one.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type.  The text ends with a unique least symbol."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    smaller[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    # in a run of equal symbols the type is that of the run's last position
    last = np.where(differs, np.arange(n), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    return smaller[last]


def _append(into: np.ndarray, free: np.ndarray, symbols: np.ndarray, entries: np.ndarray, step: int) -> None:
    """Put entries into their symbols' buckets in order; ``free`` moves by ``step`` for each."""
    order = np.argsort(symbols, kind="stable")
    symbols, entries = symbols[order], entries[order]
    heads = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    counts = np.diff(np.r_[heads, len(symbols)])
    rank = np.arange(len(symbols)) - np.repeat(heads, counts)
    into[free[symbols] + step * rank] = entries
    free[symbols[heads]] += step * counts


#: Mean size of a bucket from which its entries are induced in vector steps.
VECTOR = 64


def _induce(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The array that LMS positions, in the order given, induce."""
    by_bucket = len(text) >= VECTOR * np.count_nonzero(sizes)
    return (_induce_buckets if by_bucket else _induce_entries)(text, s_type, seeds, sizes)


def _induce_entries(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One entry at a time: the seeds at their buckets' ends, the L entries upwards, then the S entries downwards over the seeds."""
    n, ends = len(text), np.cumsum(sizes)
    counts = np.bincount(text[seeds], minlength=len(sizes))
    sa = np.full(n, -1, np.int64)
    sa[np.arange(len(seeds)) + np.repeat(ends - np.cumsum(counts), counts)] = seeds[np.argsort(text[seeds], kind="stable")]
    sa = sa.tolist()
    # the bucket that an entry's left neighbour goes into, -1 if it is of the other type; the last place is that of no entry (-1)
    left = np.full((2, n + 1), -1, np.int64)
    symbols = text[:-1].astype(np.int64)
    left[0, 1:n] = np.where(s_type[:-1], -1, symbols)
    left[1, 1:n] = np.where(s_type[:-1], symbols, -1)
    into, free = left[0].tolist(), (ends - sizes).tolist()
    for entry in sa:
        c = into[entry]
        if c >= 0:
            at = free[c]
            sa[at] = entry - 1
            free[c] = at + 1
    into, free = left[1].tolist(), (ends - 1).tolist()
    for entry in reversed(sa):
        c = into[entry]
        if c >= 0:
            at = free[c]
            sa[at] = entry - 1
            free[c] = at - 1
    return np.array(sa, np.int32)


def _induce_buckets(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bucket at a time: first the L entries upwards, then the S entries downwards."""
    n, symbols = len(text), np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    l_sizes = np.bincount(text[~s_type], minlength=len(sizes))
    sa = np.full(n, -1, np.int32)
    seed_symbols = text[seeds]
    seed_ends = np.cumsum(np.bincount(seed_symbols, minlength=len(sizes)))
    grouped = seeds[np.argsort(seed_symbols, kind="stable")]

    free = starts.copy()
    for c in symbols:
        at = starts[c]
        while at < free[c]:  # entries that the bucket induces into itself are read in a further step
            at, batch = free[c], sa[at : free[c]]
            _induce_from(sa, free, text, s_type, batch, False, 1)
        seeded = grouped[(seed_ends[c - 1] if c else 0) : seed_ends[c]]
        if len(seeded):
            _induce_from(sa, free, text, s_type, seeded, False, 1)

    free = ends - 1
    for c in symbols[::-1]:
        at = ends[c] - 1
        while at > free[c]:
            at, batch = free[c], sa[free[c] + 1 : at + 1][::-1]
            _induce_from(sa, free, text, s_type, batch, True, -1)
        if l_sizes[c]:
            _induce_from(sa, free, text, s_type, sa[starts[c] : starts[c] + l_sizes[c]][::-1], True, -1)
    sa[0] = n - 1
    return sa


def _induce_from(sa, free, text, s_type, batch, want: bool, step: int) -> None:
    before = batch[batch > 0] - 1
    before = before[s_type[before] == want]
    if len(before):
        _append(sa, free, text[before], before, step)


def _names(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, which sort as the substrings do; equal substrings share one.

    Symbols are compared with their types, so no substring is another's
    beginning.  Each round compares as many symbols as fit a number, and goes on
    with those substrings alone that still tie.
    """
    length = np.diff(np.r_[lms, len(text) - 1]) + 1
    bits = (2 * int(text.max()) + 1).bit_length()
    per = max(1, 63 // bits)
    code = np.r_[2 * text.astype(np.int64) + s_type, np.zeros(per, np.int64)]
    rank, live, at = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(at, at + per):
            key = (key << bits) | np.where(length[live] > k, code[np.minimum(lms[live] + k, len(code) - 1)], 0)
        order = np.lexsort((key, rank[live])) if at else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        held = rank[live]
        group = np.r_[True, held[1:] != held[:-1]]
        same = np.r_[True, group[1:] | (key[1:] != key[:-1])]
        head = lambda starts: np.maximum.accumulate(np.where(starts, np.arange(len(live)), 0))  # noqa: E731, B023
        # a rank is the number of substrings below
        rank[live] = held + head(same) - head(group)
        tied = ~(same & np.r_[same[1:], True])
        at += per
        live = live[tied & (length[live] > at)]
    found, names = np.unique(rank, return_inverse=True)
    return names, len(found)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an array of small integers whose last symbol is its only least one."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    s_type = suffix_types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    sizes = np.bincount(text)
    names, count = _names(text, s_type, lms)
    ordered = lms[suffix_array(names) if count < len(lms) else np.argsort(names)]
    return _induce(text, s_type, ordered, sizes)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): each suffix's predecessor in the array and their common prefix, up to ``most`` symbols.

    Only prefixes that do not follow from the suffix before (the irreducible
    ones, where the symbols to the left differ) are compared; the others are
    one less than their left neighbour's.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    left = np.where((place > 0) & (phi > 0), text[place - 1] == text[phi - 1], False)
    heads = np.flatnonzero(~left)
    known = np.zeros(n, np.int32)
    live = heads[phi[heads] >= 0]
    # symbols are compared eight bytes at a time; the last comparison is settled byte by byte
    padded = np.r_[text, np.zeros(8, text.dtype)]
    words = np.ndarray((n,), np.uint64, padded.astype(np.uint8).tobytes(), 0, (1,))
    k = 0
    # an irreducible prefix must be known beyond ``most``, as its followers lose one a step
    while len(live):
        a, b = live + k, phi[live] + k
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        same = x == 0
        low = x[~same] & (~x[~same] + np.uint64(1))
        known[live[~same]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[same]
        k += 8
    head_of = np.maximum.accumulate(np.where(left, 0, place))
    return phi, np.minimum(known[head_of] - (place - head_of), most).astype(np.int32)
