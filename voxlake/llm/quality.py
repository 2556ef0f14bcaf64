"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: each round visits the features in turn and fits a shallow tree
on one feature's bins to the gradient of the logistic loss; the trees of a
feature add up to one lookup table.  Then pairs of features with the largest
gain on what is left get tables of two dimensions in the same way.  A score is
a sum of looked-up bins, computed for whole columns at once.

The model is fitted on the driver from a bounded sample of labelled rows
(``max_rows``); every document is scored on its whole text.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "stop_mark", "exclaim", "bar", "space",
    "distinct", "doubled", "top_word", "long_word", "line_length", "same_line", "word_end_symbol",
)

_CLASS = np.zeros(256, np.int64)
for _code in range(128):
    _c = chr(_code)
    _CLASS[_code] = 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in "#$%&*+/<=>@\\^_`{}~[]" else 4 if _c in ".,;:?" else 5 if _c == "!" else 6 if _c == "|" else 7 if _c.isspace() else 0


def features(text: str | None) -> list[float]:
    """Numbers about a whole text; null counts as empty, and shares of nothing are 0."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=8) if len(data) else np.zeros(8)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size, rows = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    counts = Counter(words)
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), (size - kinds[7]) / n, *(kinds[k] / size for k in (1, 2, 3, 4)), kinds[5] / n, kinds[6] / n, kinds[7] / size,
        len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values(), default=0) / n, sum(len(w) > 20 for w in counts) / n, float(np.log1p(size / rows)), 1 - len(set(lines)) / rows if lines else 0.0,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / n,
    ]


@dataclass
class Model:
    """Cut points and lookup tables; ``tables`` by feature, ``pairs`` by two features with coarser cuts."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        if self.pairs:
            bins = [np.searchsorted(cuts, x[:, k], side="right") for k, cuts in enumerate(self.coarse)]
            for (a, b), table in self.pairs.items():
                total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; 0 if none gains."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, penalty: float, leaves: int = 3) -> np.ndarray:
    """Value of each bin under a tree of at most ``leaves`` leaves, grown where the gain is largest."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        gain, at, span = max((*_best_cut(g[a:b], h[a:b], penalty), (a, b)) for a, b in spans)
        if not at:
            break
        spans.remove(span)
        spans += [(span[0], span[0] + at), (span[0] + at, span[1])]
    value = np.zeros(len(g))
    for a, b in spans:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return value


def _cross_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and values of the better tree that cuts one axis and then each side on the other."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for at in range(1, gg.shape[0]):
            value, gain = np.zeros(gg.shape), 0.0
            for a, b in ((0, at), (at, gg.shape[0])):
                side_g, side_h = gg[a:b].sum(0), hh[a:b].sum(0)
                leaf = _shallow_tree(side_g, side_h, penalty, 2)
                value[a:b] = leaf
                gain += float((leaf * side_g).sum())
            if gain > best[0]:
                best = (gain, value.T if turned else value)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 6, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 30, penalty: float = 2.0) -> Model:
    """A model of the share of y = 1.  Without both labels, a constant one."""
    model = Model()
    if len(y) == 0 or y.min() == y.max():
        model.intercept = float(np.clip(8 * (2 * y.mean() - 1), -8, 8)) if len(y) else 0.0
        return model
    n, width = x.shape
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    model.cuts = [_cut_points(x[:, k], bins) for k in range(width)]
    model.coarse = [_cut_points(x[:, k], coarse) for k in range(width)]
    fine = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            step = rate * _shallow_tree(np.bincount(fine[k], g, size), np.bincount(fine[k], h, size), penalty)
            model.tables[k] += step
            total += step[fine[k]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        rows, columns = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        at = rough[a] * columns + rough[b]
        return tuple(np.bincount(at, v, rows * columns).reshape(rows, columns) for v in (g, h))

    gains = sorted(((_cross_tree(*grid(a, b), penalty)[0], (a, b)) for a, b in itertools.combinations(range(width), 2)), reverse=True)
    chosen = [pair for gain, pair in gains[:pairs] if gain > 0]
    model.pairs = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            step = rate * _cross_tree(*grid(a, b), penalty)[1]
            model.pairs[a, b] += step
            total += step[rough[a], rough[b]]
    return model


def held_out(ident: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """Fit on at most about ``max_rows`` labelled rows that aren't held out, sampled by a hash of the identifier.

    Rows without identifier or label are left out, and labels that repeat an
    identifier count once, as their mean; of documents that repeat one the
    least text counts.  The sampled labels, bounded by ``max_rows``, are what is
    broadcast, and as many rows of features come to the driver at most.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("__id is not null and y is not null").where(~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.avg("y").alias("y"))
    every = -(-known.count() // max_rows) or 1
    sample = known.where(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0).limit(2 * max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    texts = texts.groupBy("__id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    rows = texts.select("text", "y").mapInArrow(_feature_rows, "x array<double>, y double").collect()
    # the rows come in any order; sorted, they give the same model each time
    rows = sorted((tuple(r.x), r.y) for r in rows)
    return fit(np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text only with ``keep_text``) plus held_out, score and predicted.

    score is between 0 and 1, higher where label 1 is likelier; predicted is 1
    from 0.5 on.  Null and empty texts are scored like any other.  Columns of
    the input that bear a result's name are replaced; an empty table gives an
    empty result.
    """
    added = {"held_out": "boolean", "score": "double", "predicted": "int"}
    kept = [c for c in docs.columns if c.lower() not in added and (keep_text or c != text_col) and not c.startswith("__")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema] + [f"{k} {v}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            p = model.scores(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), batch.column(len(kept)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, *added])

    rows = docs.select(*[f"`{c}`" for c in kept], held_out(F.col(f"`{id_col}`")).alias("__out"), *([] if keep_text else [F.col(f"`{text_col}`").alias("__text")]))
    at = kept.index(text_col) if keep_text else len(kept) + 1
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their columns."""
    return score(docs, model, id_col, text_col, keep_text=True).where("predicted = 1").select(*[f"`{c}`" for c in docs.columns if not c.startswith("__")])
