"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def odd_texts() -> list[str | None]:
    """Null, empty, blank, long, repeated, periodic, and characters of all widths."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéßΩ\U0001f600") for _ in range(rng.randint(1, 8)))
    prose = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(12)]
    passage = " ".join(word() for _ in range(120))
    return [
        None, "", " \t\n", "One", "one", "ONE", "É", "é", *prose, prose[0], prose[0].upper(), prose[1] + " tail", prose[0] + passage + prose[2], passage, prose[3] + passage,
        "ab" * 2000, "a" * 5000, "x " * 900, "\x00" * 900, prose[4] * 3, "word word end",
    ]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text: str | None, shingle: int = 4) -> int:
    w = words((text or "").translate(ASCII_LOWER))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes: list, linked) -> dict:
    """Smallest node reachable, by trying all pairs."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                if label[a] != label[b] and linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def without_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, digest of what is left) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii_spans(text: str | None) -> str:
    found = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), order, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def targets(sizes: dict, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> dict:
    """Shares by weight with the excess of full sources dealt again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        if not open_:
            return {s: most * sizes[s] for s in order}
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: most * sizes[s] for s in full}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def groups(keys: list) -> dict:
    out = defaultdict(list)
    for i, k in enumerate(keys):
        out[k].append(i)
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words((text or "").translate(ASCII_LOWER))
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else []))


def similar(x: frozenset, y: frozenset) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more; empty ones are equal."""
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def near_groups(ids: list, texts: list) -> dict:
    """Smallest identifier reachable of each, over all pairs."""
    sets = dict(zip(ids, map(shingles, texts)))
    return components(list(ids), lambda a, b: similar(sets[a], sets[b]))
