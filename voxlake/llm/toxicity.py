"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, intent, target, negation, reported
speech, border, other.  Five transducers rewrite the symbols of a clause from
left to right and add weights; their composition is one machine:

* insult: insults that follow each other closely weigh more;
* threat: a threat after words of intent weighs more;
* target: an insult or a threat beside a word for the person spoken to or of;
* negation: what stands within three words behind a negation weighs less;
* reported speech: what stands behind a verb of saying or a quotation mark, up
  to the next border, weighs less.

A clause that holds an insult or a threat is a match; its score is the sum of
its words' own weights and of the arcs taken, 0 at least.  A document's
score comes from its matches by logistic regression.

The closed word classes are lists below; insulting words and stems, with their
weights, are learned from labelled texts: whole words and word beginnings that
toxic texts hold far more often than others.  The learning reads a bounded
sample of labelled rows (``max_rows``); every document is scored on its whole
text, which an Aho-Corasick automaton searches for the learned words, so that
only clauses with a hit go through the machine.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import materialize, release

#: Symbols of words: what the grammar reads.
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORTED, BORDER = "o", "i", "h", "m", "t", "n", "r", ","
SYMBOLS = (OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORTED, BORDER)

# Closed word classes of English, German, French and Spanish.  "du" is left out: it is an article in French.
TARGETS = "you your yours yourself he him his she her they them their u dich dir dein deine deinen euch euer eure sie ihn ihm tu te toi ton ta vous votre vos lui leur tú ti tus usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not no never neither nor without hardly isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ni sin tampoco".split()
SAYING = "said says say saying told tells called calls wrote writes claimed claims quoted asked according sagte sagt gesagt nannte schrieb behauptete dit dits disait appelé écrit affirme dijo dice dicho llamó escribió afirma".split()
INTENTS = "will shall would gonna going want should must werde werden wird soll muss vais va allons veux dois voy vamos quiero debo deberías".split()
THREATS = "kill kills hurt destroy beat stab shoot murder strangle töten umbringen schlagen erschießen verprügeln tuer frapper détruire égorger poignarder matar golpear destruir apuñalar degollar".split()
QUOTES = '"“”„«»'

#: Own weight of a listed threat, and weights of arcs.
THREAT_WEIGHT, STACKED, INTENDED, TARGETED, NEGATED, QUOTED = 2.0, 0.5, 1.5, 1.0, -1.5, -1.0


@dataclass(frozen=True)
class Transducer:
    """Letter to letter: ``arcs`` maps (state, symbol) to (state, symbol, weight); what isn't named passes unchanged by ``rest``."""

    arcs: dict
    rest: dict

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol[0])) and self._marked(state, symbol) or (self.rest.get(state, state), symbol, 0.0)

    def _marked(self, state: int, symbol: str) -> tuple[int, str, float]:
        to, mark, weight = self.arcs[state, symbol[0]]
        return to, symbol + mark, weight


def _window(opens: str, length: int, mark: str, weight: float, closes: str = "", marked: str = INSULT + THREAT) -> Transducer:
    """Marks insults and threats for ``length`` words after one of the symbols ``opens``, or up to one of ``closes``."""
    arcs = {(s, x): (length, "", 0.0) for s in range(length + 1) for x in opens} | {(s, x): (0, "", 0.0) for s in range(length + 1) for x in closes}
    arcs |= {(s, x): (s - 1 if not closes else s, mark, weight) for s in range(1, length + 1) for x in marked}
    return Transducer(arcs, {s: max(0, s - 1) if not closes else s for s in range(length + 1)})


def _target() -> Transducer:
    """Target words count for four words on either side: states 1 to 4 are left of a target, -1 to -4 of an insult or threat without one."""
    near = 4
    rest = {s: s - (s > 0) + (s < 0) for s in range(-near, near + 1)}
    arcs = {(s, TARGET): (near, "T" if s < 0 else "", TARGETED if s < 0 else 0.0) for s in range(-near, near + 1)}
    for x in INSULT + THREAT:
        arcs |= {(s, x): (s - 1, "T", TARGETED) if s > 0 else (-near, "", 0.0) for s in range(-near, near + 1)}
    return Transducer(arcs, rest)


#: In the order of their composition.  A mark is a capital that a symbol gathers on its way.
GRAMMAR = (
    _window(INSULT, 2, "S", STACKED, marked=INSULT),
    _window(INTENT, 4, "M", INTENDED, marked=THREAT),
    _target(),
    _window(NEGATION, 3, "N", NEGATED),
    _window(REPORTED, 1, "R", QUOTED, closes=BORDER),
)


@lru_cache(maxsize=1)
def machine() -> tuple[dict, tuple]:
    """The composition of the grammar's transducers, its reachable states numbered: (state, symbol) to (state, marks, weight); and the first state."""
    number: dict[tuple, int] = {(0,) * len(GRAMMAR): 0}
    arcs, open_ = {}, [(0,) * len(GRAMMAR)]
    while open_:
        states = open_.pop()
        for symbol in SYMBOLS:
            at, out, weight = [], symbol, 0.0
            for part, state in zip(GRAMMAR, states, strict=True):
                to, out, w = part.step(state, out)
                at.append(to)
                weight += w
            if tuple(at) not in number:
                number[tuple(at)] = len(number)
                open_.append(tuple(at))
            arcs[number[states], symbol] = (number[tuple(at)], out[1:], weight)
    return arcs, (0,)


def parse(symbols: list[str], weights: list[float]) -> tuple[float, Counter]:
    """Score of a clause's words and how often each mark was given; "I" and "H" count insults and threats."""
    arcs, (state,) = machine()
    total, marks = 0.0, Counter()
    for symbol, own in zip(symbols, weights, strict=True):
        state, out, weight = arcs[state, symbol]
        total += own + weight
        if symbol in (INSULT, THREAT):
            marks[symbol.upper()] += 1
        marks.update(out)
    return max(0.0, total), marks


FEATURES = ("total", "best", "clauses", "lexemes", "targeted", "negated", "reported", "threats", "stacked", "density", "size")


@dataclass
class Model:
    """Learned words and stems (``word$`` is a whole word) with their weights, and the regression over ``FEATURES``."""

    lexicon: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    intercept: float = -4.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = self.intercept + ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


_END = re.compile(r"[.!?;:\n]")
_WORD = re.compile(rf"[^\W\d_]+|[,{QUOTES}]")
_CLOSED = {w: s for words, s in ((INTENTS, INTENT), (SAYING, REPORTED), (NEGATIONS, NEGATION), (TARGETS, TARGET), (QUOTES, REPORTED), (",", BORDER)) for w in words}


class Matcher:
    """Finds and parses the clauses of a text that hold a learned word or a listed threat."""

    def __init__(self, lexicon: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        keys = {k: (INSULT, w) for k, w in lexicon.items()} | {f"{w}$": (THREAT, max(THREAT_WEIGHT, lexicon.get(f"{w}$", 0.0))) for w in THREATS}
        by_word: dict[str, list] = {}
        for key, (symbol, weight) in sorted(keys.items()):
            by_word.setdefault(key.rstrip("$"), []).append((key, key.endswith("$"), symbol, weight))
        for word, found in by_word.items():
            self.automaton.add_word(word, (len(word), found))
        self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[str, str, float]]:
        """Place of a word: (key, symbol, weight) of the weightiest key that it is or begins with."""
        out: dict[int, tuple[str, str, float]] = {}
        for end, (size, found) in self.automaton.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalpha()):
                continue
            ends = end + 1 == len(text) or not text[end + 1].isalpha()
            for key, whole, symbol, weight in found:
                if (ends or not whole) and (start not in out or weight > out[start][2]):
                    out[start] = (key, symbol, weight)
        return out

    def features(self, text: str | None) -> list[float]:
        """Numbers about a whole text; null counts as empty."""
        text = (text or "").lower()
        hits = self.hits(text)
        scores, marks, until = [], Counter(), -1
        for at in sorted(hits):
            if at < until:
                continue
            start = max((m.end() for m in _END.finditer(text, max(0, at - 2000), at)), default=max(0, at - 2000))
            end = _END.search(text, at)
            until = end.start() if end else len(text)
            symbols, weights = [], []
            for m in _WORD.finditer(text, start, until):
                key, symbol, weight = hits.get(m.start()) or ("", _CLOSED.get(m[0], OTHER), 0.0)
                symbols.append(symbol)
                weights.append(weight)
            score, found = parse(symbols, weights)
            scores.append(score)
            marks.update(found)
        total, lexemes = sum(scores), {key for key, _, _ in hits.values()}
        log = lambda x: float(np.log1p(x))
        return [log(total), max(scores, default=0.0), log(len(scores)), log(len(lexemes)), log(marks["T"]), log(marks["N"]), log(marks["R"]), log(marks["H"]), log(marks["S"]), total / (1 + len(text) / 1000), log(len(text))]


# learning


def held_out(ident: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the identifier as text is a multiple of 5."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Lengths of word beginnings that may become stems.
STEMS = range(3, 9)


def keys_of(text: str | None) -> set[str]:
    """Whole words (marked by $) and word beginnings of a text, each once."""
    words = {m[0] for m in _WORD.finditer((text or "").lower()) if len(m[0]) > 2}
    return {f"{w}$" for w in words} | {w[:n] for w in words for n in STEMS if len(w) > n}


def _count_keys(wanted: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                keys = keys_of(text.as_py())
                counts.update(keys if wanted is None else keys & wanted)
                if len(counts) > 500_000:
                    yield rows()
        yield rows()

    return run


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: float = 15.0, ratio: float = 3.0, most: int = 1000) -> dict[str, float]:
    """The keys that tell toxic texts from others, with their log odds; of keys that begin alike the most telling.

    ``toxic`` and ``clean`` count the texts that hold each key; ``least`` bounds
    the likelihood-ratio statistic of a key from below, ``ratio`` how much more
    often toxic texts hold it.  Of equally telling keys the longest is taken; a
    beginning of a chosen key is taken too if a quarter more toxic texts hold it.
    """
    names = sorted(toxic)
    a, b = np.array([toxic[k] for k in names], float), np.array([clean.get(k, 0) for k in names], float)
    if not len(a) or not n_toxic or not n_clean:
        return {}
    both = n_toxic + n_clean

    def part(x: np.ndarray, total: float, share: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / (total * share)), 0.0)

    has, lacks = (a + b) / both, np.maximum(1 - (a + b) / both, 1e-12)
    g = 2 * (part(a, n_toxic, has) + part(b, n_clean, has) + part(n_toxic - a, n_toxic, lacks) + part(n_clean - b, n_clean, lacks))
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    fit = np.flatnonzero((g >= least) & (odds >= np.log(ratio)))
    chosen: dict[str, float] = {}
    under: dict[str, float] = {}  # of every beginning of chosen keys: the most toxic texts that one of these holds
    for k in sorted(fit.tolist(), key=lambda k: (-round(g[k], 6), -len(names[k]), names[k])):
        word = names[k].rstrip("$")
        if a[k] < 1.25 * under.get(word, 0) or any(word[:n] in chosen or f"{word[:n]}$" in chosen and n == len(word) for n in range(1, len(word) + 1)):
            continue
        chosen[names[k]] = float(min(odds[k], 6.0))
        for n in range(1, len(word) + 1):
            under[word[:n]] = max(a[k], under.get(word[:n], 0))
        if len(chosen) == most:
            break
    return chosen


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, intercept) of a ridge logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[1:], float(w[0])


def _feature_rows(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matcher.features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000) -> Model:
    """Learn from about ``max_rows`` labelled rows at most that aren't held out, sampled by a hash of the identifier.

    Rows without identifier or label are left out, and labels that repeat an
    identifier count once, by the larger.  Of documents that repeat one the
    least text counts.  Without both labels the model is a constant.  The
    sample is written once; what comes to the driver is bounded by it: keys in
    three toxic texts of it or more, and one row of features a text.
    """
    ident = F.col(f"`{id_col}`")
    known = labels.select(ident.alias("__id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("__id is not null and y is not null").where(~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    every = -(-known.count() // max_rows) or 1
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0).limit(2 * max_rows)
    texts = docs.select(ident.alias("__doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    sample = materialize(texts.groupBy("__id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y")).select("text", "y"), "labelled")
    sizes = {bool(r.t): r.n for r in sample.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        release(sample)
        return Model(intercept=4.0 if n_toxic else -4.0)
    least = max(3, n_toxic // 200)
    counted = lambda where, wanted: sample.where(where).select("text").mapInArrow(_count_keys(wanted), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    toxic = {r.key: r.n for r in counted("y > 0", None).where(F.col("n") >= least).collect()}
    clean = {r.key: r.n for r in counted("y <= 0", set(toxic)).collect()}
    lexicon = choose(toxic, clean, n_toxic, n_clean)
    rows = sample.mapInArrow(_feature_rows(lexicon), "x array<double>, y double").collect()
    rows = sorted((tuple(r.x), r.y) for r in rows)  # they come in any order; sorted, they give the same model each time
    release(sample)
    return Model(lexicon, *regress(np.array([r[0] for r in rows]), np.array([float(r[1] > 0) for r in rows])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus held_out, score, predicted and n_clauses.

    score is between 0 and 1, higher where label 1 is likelier; predicted is 1
    from 0.5 on; n_clauses counts the clauses that match.  Null and empty texts
    match nothing and are scored like any text without matches.  Each row is
    scored by itself, repeated rows too.  Columns that bear a result's name are
    replaced; an empty table gives an empty result.
    """
    added = {"held_out": "boolean", "score": "double", "predicted": "int", "n_clauses": "long"}
    kept = [c for c in docs.columns if c.lower() not in added and c != text_col and not c.startswith("__")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema] + [f"{k} {v}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in batches:
            x = np.array([matcher.features(t.as_py()) for t in batch.column(len(kept) + 1)]).reshape(batch.num_rows, len(FEATURES))
            p = model.scores(x)
            clauses = np.rint(np.expm1(x[:, FEATURES.index("clauses")])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept) + 1)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(clauses)], names=[*kept, *added])

    return docs.select(*[f"`{c}`" for c in kept], held_out(F.col(f"`{id_col}`")).alias("__out"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
