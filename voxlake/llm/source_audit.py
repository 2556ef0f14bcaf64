"""Source divergence audit: how far the term shares of a language's sources lie apart.

A baseline-corrected inverted index.  With V kept terms, every ordered pair of
sources starts at V * f(p0, q0), where p0 and q0 are the shares of a term that
a source doesn't have.  Postings (term, source, count) then emit what differs
from that: a posting by itself against the zero share of each other source, and
two postings of one term against each other.  The first kind depends on the
count alone, so postings are folded to a histogram of counts for each source
before they meet the other sources; the second is folded where it is made.

Counting folds each task's texts before anything is shuffled, and one exchange
by (language, term) then gives counts, the language's total and the number of
documents of each term.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import materialize

#: Parts of a share of one.
UNIT = 1_000_000_000
#: Distinct (group, term) entries that a task folds before it hands them on.
ENTRIES = 400_000
#: Bytes of a long text that are split into terms at a time.
PIECE = 1 << 22
#: Bytes of terms as they are, A-Z lower-cased, all others a space.
_TABLE = bytes(i if 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text: runs of letters A-Z, a-z and characters from U+0080 on; long texts in parts."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end >= len(text):
            end = len(text)
        else:
            cut = text[at:end].translate(_TABLE).rfind(b" ")
            while cut < 0 and end < len(text):  # a term longer than a part
                end = min(len(text), end + PIECE)
                cut = text[at:end].translate(_TABLE).rfind(b" ")
            end = at + cut + 1 if cut >= 0 else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) in; (lang, source, term, occurrences, documents) out, the empty term standing for the documents themselves."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    new = 0

    def rows() -> pa.RecordBatch:
        sizes = [len(d) for d in docs.values()]
        names = pa.array(np.repeat(np.arange(len(docs)), sizes))
        terms = pa.array([t for d in docs.values() for t in d], pa.binary()).view(pa.string())
        n = pa.array([x for g, d in docs.items() for x in map(counts[g].__getitem__, d)], pa.int64())
        out = [*(pa.array([g[k] for g in docs], pa.string()).take(names) for k in (0, 1)), terms, n, pa.array([x for d in docs.values() for x in d.values()], pa.int64())]
        counts.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "d"])

    for batch in batches:
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for group, text in zip(groups, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            c, d = counts[group], docs[group]
            before = len(d)
            d[b""] += 1
            seen: set[bytes] = set()
            for part in terms_of(text or b""):
                c.update(part)
                seen.update(part)
            d.update(seen)
            new += len(d) - before
            if new > ENTRIES:
                yield rows()
                new = 0
    if docs:
        yield rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact for any counts."""
    one, whole = count + F.lit(1), total + terms
    wide = F.lit(UNIT).cast("decimal(10,0)") * one.cast("decimal(20,0)")
    return F.lit(1) + F.when(one < F.lit(9_000_000_000), _div(F.lit(UNIT) * one, whole)).otherwise(_div(wide, whole.cast("decimal(20,0)")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); shares are at most UNIT + 1, so the square fits."""
    return _div((p - q) * (p - q), q)


def index(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The postings (lang, source, term, n, lang_n, first) of kept terms, and the groups (lang, source, total, lang_total, terms).

    Kept are the terms that ``least`` documents of their language or more have;
    ``lang_n`` is the term's count in the language, ``first`` holds for one
    posting of each term.  Groups without kept terms are there with total 0.
    Null counts as '' in all three columns.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    folded = rows.mapInArrow(_fold, "lang string, source string, term string, n long, d long").repartition("lang", "term")
    counts = folded.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = W.partitionBy("lang", "term")
    found = materialize(
        counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("d").over(term).alias("in_docs"), (F.min("source").over(term) == F.col("source")).alias("first")).where(f"term = '' or in_docs >= {int(least)}"),
        "postings",
    )
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("first") & (F.col("term") != ""), 1).otherwise(0)).alias("t"))
    lang = W.partitionBy("lang")
    groups = materialize(own.select("lang", "source", "total", F.sum("total").over(lang).alias("lang_total"), F.sum("t").over(lang).alias("terms")), "groups")
    return found.where("term <> ''").drop("in_docs"), groups


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: the sources and terms from which each source differs.

    Part ``pair``: for each other source of the language, the sum over all kept
    terms of ``distance`` between the two sources' shares, however small; 0 if
    no term is kept.  Part ``term``: the ``most`` terms whose share in the
    source lies furthest above the language's, by ``distance``.  Ranks count
    from 1 within each group and part, larger values first, ties by the item's
    bytes.  Null language, source and text count as ''; a group whose texts are
    empty is compared like any other; repeated rows count each; an empty table
    gives an empty result.
    """
    postings, groups = index(docs, lang_col, source_col, text_col, least)
    return _pairs(postings, groups).unionByName(_terms(postings, groups, most))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(postings: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    g = groups.select("lang", "source", "total", "lang_total", "terms")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = postings.where("n > 0").join(g, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    # the limit on the rank reaches each task's rows before they are shuffled
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= most)


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(1)
    sides = groups.select("lang", "source", "total", "terms", none.alias("p0"))
    a = sides.select("lang", F.col("source").alias("a"), F.col("total").alias("a_total"), F.col("terms"), F.col("p0").alias("pa"))
    b = sides.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang").where("a <> b")
    start = F.col("terms") * distance(F.col("pa"), F.col("pb"))
    # postings by themselves, folded by count
    counted = postings.where("n > 0").groupBy("lang", "source", "n").agg(F.count("*").alias("k"))
    k, f0 = F.col("k"), distance(F.col("pa"), F.col("pb"))
    of_a = counted.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).select("lang", "a", "b", (k * (distance(share(F.col("n"), F.col("a_total"), F.col("terms")), F.col("pb")) - f0)).alias("v"))
    of_b = counted.withColumnRenamed("source", "b").join(pairs, ["lang", "b"]).select("lang", "a", "b", (k * (distance(F.col("pa"), share(F.col("n"), F.col("b_total"), F.col("terms"))) - f0)).alias("v"))
    # terms that both have: what is left when each is taken against the other's zero share; the shares are worked out once a posting
    shares = postings.where("n > 0").join(sides, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0")
    one, two = (shares.select("lang", "term", F.col("source").alias(k), F.col("p").alias(f"p{k}"), F.col("p0").alias(f"z{k}")) for k in "ab")
    pa, za, pb, zb = (F.col(k) for k in ("pa", "za", "pb", "zb"))
    forth = distance(pa, pb) - distance(pa, zb) - distance(za, pb) + distance(za, zb)
    back = distance(pb, pa) - distance(pb, za) - distance(zb, pa) + distance(zb, za)
    both = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(forth).alias("v"), F.sum(back).alias("u"))
    of_both = both.select("lang", F.inline(F.array(F.struct(F.col("a"), F.col("b"), F.col("v")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("u").alias("v")))))
    summed = pairs.select("lang", "a", "b", start.alias("v")).unionByName(of_a).unionByName(of_b).unionByName(of_both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    return _ranked(summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value"))
