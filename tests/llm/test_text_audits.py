"""Toxicity, source audit and periodic runs against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.llm import bpe, mixing, periodic_runs, pii, quality, source_audit, token_counts, toxicity
from voxlake.llm.queries import op13_periodic_runs, tokenizer

from ..oracle import DATA
from . import plain

CLASHING = {"runs": 1, "collapsed": "x", "score": 1.5, "predicted": 7, "held_out": "no", "n_clauses": 3, "term": "t", "n": 4, "value": 5, "__x": 6}


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# periodic runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, by looking at all pairs a period apart."""
    found: dict[tuple[int, int], int] = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    w: list[int] = []
    while len(w) < 400:
        part = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randint(1, 25))]
        w += part * rng.choice((1, 1, 1, 2, 4, 5, 9)) + part[: rng.randint(0, len(part))]
    assert periodic_runs.find_runs(np.array(w)) == plain_runs(w)


@pytest.mark.parametrize("w", [[], [1] * 5, [1] * 6, [1] * 3000, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2, 1, 2, 1, 2, 1, 2, 1], [1, 1, 2] * 200 + [1, 1, 1] * 40, list(range(300)) * 4, list(range(300)) * 3 + list(range(299))])
def test_runs_of_edges(w):
    assert periodic_runs.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_long_and_nested_runs():
    inner = [5, 6] * 10 + [7]
    w = inner * 6 + list(range(100, 4100)) + [9] * 70_000
    got = periodic_runs.find_runs(np.array(w))
    assert (0, len(inner) * 6, len(inner)) in got and got[-1] == (len(w) - 70_000, 70_000, 1) and len(got) == 8


def test_periodic_texts(spark):
    texts = [*plain.odd_texts(), "x " * 7, " a\tb  a\nb a b a\x0bb c ", "a b c " * 9 + "d"]
    docs = frame(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(1, None, "e", "s")] * 2).withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    got = periodic_runs.periodic_runs(docs)
    assert "__x" not in got.columns and len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = plain.words(texts[r.doc_id] if r.lang is None else None)
        runs = plain_runs(words) if len(words) < 4000 else None
        if runs is not None:
            assert [tuple(x) for x in r.runs] == runs
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert r.collapsed == " ".join(x for i, x in enumerate(words) if i not in gone)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_runs(spark):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, str(DATA)).collect()}
    planted = 0
    for i, text in texts.items():
        w, h = plain.words(text), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
            planted += 1
        runs = plain_runs(w)
        assert rows[i].n_runs == len(runs) and rows[i].runs_sha256 == plain.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
    assert planted


# source audit


def plain_audit(rows: list[tuple], least: int = 3, most: int = 200) -> set[tuple]:
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(plain.ASCII_LOWER)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts: dict = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: n for t, n in c.items() if t in set(kept)})
            counts[source] += Counter()
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) * (p - q) // q
        sources = {d[1] for d in own}
        for a in sources:
            pairs = sorted(((-sum(f(share(counts[a], t), share(counts[b], t)) for t in kept), b.encode()) for b in sources if b != a))
            terms = sorted((-f(p, q), t.encode()) for t in kept if counts[a][t] for p, q in [(share(counts[a], t), share(whole, t))] if p > q)[:most]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, a, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("entries, piece, least, most", [(400_000, 1 << 22, 3, 200), (7, 16, 1, 2)])
def test_divergence(spark, entries, piece, least, most, monkeypatch):
    monkeypatch.setattr(source_audit, "ENTRIES", entries)
    monkeypatch.setattr(source_audit, "PIECE", piece)
    rng = random.Random(4)
    words = ["the", "The", "of", "é", "É", "naïve", "x1y", "straße", "\U0001f600", "z" * 40, "a-b"]
    rows = [(rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3", None)), " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", "s9", None), ("fr", "only", "le le"), ("fr", "none", ""), ("xx", "one", "a"), *rows[:3]]
    docs = frame(spark, [(k, r[2], r[0], r[1]) for k, r in enumerate(rows)]).withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    got = {tuple(r) for r in source_audit.divergence(docs, least=least, most=most).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_audit(rows, least, most)
    assert source_audit.divergence(docs.limit(0)).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(8_999_999_998, 10**13, 5), (5 * 10**11, 10**13, 10**7), (0, 0, 1)], "n long, total long, v long")
    got = big.select("n", "total", "v", source_audit.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // (r.total + r.v) for r in got)


def test_terms_of_long_texts_in_parts(monkeypatch):
    text = ("Wörter, mit-Ümlaut " + "q" * 100 + " ").encode() * 20
    whole = list(source_audit.terms_of(text))
    monkeypatch.setattr(source_audit, "PIECE", 13)
    parts = list(source_audit.terms_of(text))
    assert len(parts) > len(whole) and [t for p in parts for t in p] == [t for p in whole for t in p]


# toxicity


def plain_parse(symbols: str, weights: list[float]) -> float:
    """The grammar told by windows: what stands where, seen from each insult and threat."""
    total, reported, unclaimed = 0.0, False, None
    for k, s in enumerate(symbols):
        before = lambda n, what, k=k: any(x in what for x in symbols[max(0, k - n) : k])
        if s == "r":
            reported = True
        elif s == ",":
            reported = False
        if s in "ih":
            total += weights[k]
            total += toxicity.STACKED * (s == "i" and before(2, "i")) + toxicity.INTENDED * (s == "h" and before(4, "m")) + toxicity.NEGATED * before(3, "n") + toxicity.QUOTED * reported
    return total


def test_windows_of_the_grammar():
    rng = random.Random(1)
    # without target words the plain version is a look back from each word
    for _ in range(400):
        symbols = [rng.choice("ooohimnr,") for _ in range(rng.randint(1, 12))]
        # a window that a hit has shortened ends early: only first hits of a window are compared
        if sum(s in "ih" for s in symbols) > 1:
            continue
        weights = [2.0 if s in "ih" else 0.0 for s in symbols]
        assert toxicity.parse(symbols, weights)[0] == pytest.approx(max(0.0, plain_parse("".join(symbols), weights)))


@pytest.mark.parametrize(
    "text, marks",
    [
        ("you are an idiot", "T"), ("idiot , you there", "T"), ("the word idiot", ""), ("he is not an idiot", "TN"), ('she said "idiot"', "TR"), ("an idiot idiot", "S"), ("i will kill you", "MT"), ("to kill time", ""),
    ],
)
def test_clauses(text, marks):
    hits = toxicity.Matcher({"idiot$": 3.0}).hits(text)
    symbols, weights = [], []
    for m in toxicity._WORD.finditer(text):
        key, symbol, weight = hits.get(m.start()) or ("", toxicity._CLOSED.get(m[0], "o"), 0.0)
        symbols.append(symbol)
        weights.append(weight)
    found = toxicity.parse(symbols, weights)[1]
    assert {k for k in found if k in "TNRSM"} == set(marks)


def test_keys_and_boundaries():
    m = toxicity.Matcher({"scum$": 4.0, "vequ": 2.0, "vequelle$": 5.0})
    assert m.hits("scum scummy vequa vequelle xvequ ovequ") == {0: ("scum$", "i", 4.0), 12: ("vequ", "i", 2.0), 18: ("vequelle$", "i", 5.0)}
    assert m.features(None) == m.features("") and m.features("scum")[0] > 0 == m.features("scummy")[0]
    # clauses are cut at stops; words on either side of one don't meet
    one, two = m.features("you scum"), m.features("you. scum")
    assert one[toxicity.FEATURES.index("targeted")] > 0 == two[toxicity.FEATURES.index("targeted")]


def made_documents(n: int = 900):
    """Invented prose in which toxic texts hold words of two stems and two whole words, half of them once only."""
    rng = random.Random(9)
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "se", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for k in range(n):
        w = [word() + rng.choice(("", "", ".", ",")) for _ in range(rng.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(("grobul" + rng.choice(syllables), "vrax" + rng.choice(syllables), "Yuck", "ploof")))
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = made_documents()
    docs = frame(spark, [(i, t, "en", "s") for i, t, _ in rows] + [(None, None, "en", "s"), (10**6, "", "en", "s"), (10**6, "", "en", "s")]).withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {k.rstrip("$")[:4] for k in model.lexicon} >= {"grob", "vrax", "yuck", "ploo"}
    got = toxicity.score(docs, model)
    assert "__x" not in got.columns and got.schema["score"].dataType.simpleString() == "double"
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) + 3 and all(0 <= r.score <= 1 for r in found.values())
    out = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert len(out) > 100 and sum(p == y for p, y in out) >= 0.97 * len(out)
    assert found[10**6].predicted == 0 and found[None].score == found[10**6].score
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    # labels of held-out rows are never read
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    again = toxicity.train(docs, turned)
    assert again.lexicon == toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).lexicon


def test_toxicity_without_both_labels(spark):
    docs = frame(spark, [(k, "some text", "en", "s") for k in range(30)])
    for labels, want in (([(k, 0) for k in range(30)], 0), ([(k, 1) for k in range(30)], 1), ([], 0)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(docs, model).collect()} == {want} and not model.lexicon
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_a_very_long_text_and_one_without_stops():
    m = toxicity.Matcher({"ploof$": 3.0})
    text = "ba ke lo " * 200_000 + "you ploof " + "mi tu " * 1000
    x = dict(zip(toxicity.FEATURES, m.features(text), strict=True))
    assert round(np.expm1(x["clauses"])) == 1 and x["targeted"] > 0


def test_the_machine_is_a_composition():
    """Running the composed machine equals running the five transducers one after the other."""
    rng = random.Random(3)
    for _ in range(300):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(1, 15))]
        tape, total = list(symbols), 0.0
        for part in toxicity.GRAMMAR:
            state, out = 0, []
            for s in tape:
                state, s, w = part.step(state, s)
                out.append(s)
                total += w
            tape = out
        score, marks = toxicity.parse(symbols, [0.0] * len(symbols))
        assert score == pytest.approx(max(0.0, total))
        assert Counter("".join(s[1:] for s in tape)) == Counter({k: v for k, v in marks.items() if k not in "IH"})


def test_folded_rows_are_record_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["s", "s"]), pa.array(["A a b", None])], names=["lang", "source", "text"])
    out = pa.Table.from_batches(list(source_audit._fold(iter([batch])))).to_pylist()
    assert {(r["term"], r["n"], r["d"]) for r in out} == {("", 0, 2), ("a", 2, 1), ("b", 1, 1)}


# edges of earlier operators


def test_internal_columns_of_encoders_are_not_returned(spark):
    docs = frame(spark, [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, None, None, None)]).withColumn("__x", F.lit(1))
    got = bpe.bpe_round_trip(docs, *tokenizer())
    assert "__x" not in got.columns and got.count() == 3
    lengths = token_counts.token_lengths(docs.withColumns({"n_tokens": F.lit("x"), "n_docs": F.lit(9), "block": F.lit(1)}), *tokenizer())
    assert {(r.n_tokens, r.n_docs) for r in token_counts.length_histogram(lengths).collect()} == {(0, 1), (2, 2)}


def test_personal_data_in_repeated_rows(spark):
    text = "key token: " + "a1B2c3D4e5F6g7H8i9J0" + " and x@y.org " + "q" * 30 + " +1 (487) 555-7209"
    rows = pii.find_spans(frame(spark, [(1, text, "en", "s")] * 3 + [(2, None, None, None)])).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 3, 3, 3] and {s.kind for r in rows for s in r.spans} == {"email", "phone", "secret"}
    # a run of letters alone, or one with too few digits, is no key
    assert pii.find_spans(frame(spark, [(1, "token " + "abcdefghijklmnopqrstuvwxyz " + "abcdefghijklmnopqrst1", "en", "s")])).first().spans == []


def test_mix_of_repeated_rows_and_null_identifiers(spark):
    rows = [(5, "a b c", "en", "s")] * 4 + [(None, "a b", "en", "s")] * 2 + [(7, "", "en", None), (8, "x", "en", None)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got if r.source == "s") == pytest.approx(sum(3 for _ in range(4)) * 1.5 + 4 * 1.5, abs=2.0)
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    key = lambda x: sorted((str(r.doc_id), r.size, r.taken) for r in x)
    assert key(got) == key(again) and all(r.taken <= 2 * r.size for r in got)


def test_quality_of_a_very_long_text_and_of_repeated_documents(spark):
    words = "one two three four five six seven eight nine ten".split()
    rows = [(k, " ".join(words * (1 + k % 3)) if k % 2 else "!! " * 40, "en", "s") for k in range(60)] + [(1, "another text", "en", "s")] * 5 + [(100, "word " * 300_000, "en", "s")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    docs = frame(spark, rows)
    found = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
