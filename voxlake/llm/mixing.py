"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the keys are cut
into ranges, distributed prefix sums give each document the words before it,
and the cut falls at the source's exact budget; a source whose budget exceeds
its size is repeated for whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import materialize

#: Rows that a source of a third of all rows has in a range; the ranges, whatever their number, don't change the result.
RANGE_ROWS = 100_000
WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009-000D; null has none."""
    # a run starts at each non-space that follows a space or the beginning
    spaced = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def budgets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight.  That is the level at
    which min(cap, level * weight) adds up to the total, found by one pass over
    the sources in order of cap / weight.  ``sizes`` has a row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = rows.select("*", level.alias("level"), F.row_number().over(by_ratio).alias("nth"))
    # the level is that of the first source whose cap it does not reach
    held = levels.withColumn("at", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("nth"))).over(W.partitionBy()))
    final = held.withColumn("final", F.max(F.when(F.col("nth") == F.col("at"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("at").isNull() | (F.col("nth") < F.col("at")), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return final.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", size_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target and taken.

    ``taken`` is the number of words of the document that the mix takes,
    repeats counted: whole epochs of its source, and then once more if the
    words before it in key order are below what is left of the budget, the
    document at the cut only up to it.  A source of no words gets none.
    Null sources form one source, the last; null texts have size 0.  Rows that
    repeat an identifier are ordered by their size and counted each.  Columns
    of the input that bear a result's name are replaced; an empty table gives
    an empty result.  ``size_col`` names a column that holds the sizes, if there
    is one; the text is not needed then.  Sizes are worked out once and written
    with the rows.
    """
    taken = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken") and not c.startswith("__")]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    rows = docs.select(*taken, F.col(f"`{source_col}`").alias("__source"), (F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0).cast("long")) if size_col else words(F.col(f"`{text_col}`"))).alias("size"), key.alias("__key"))
    rows = materialize(rows, "sized")
    digits = max(3, math.ceil(math.log(max(1, rows.count() / 3 / RANGE_ROWS), 16)))
    rows = rows.withColumn("__range", F.substring("__key", 1, digits))

    ranges = rows.groupBy("__source", "__range").agg(F.sum("size").alias("__words"))
    totals = budgets(ranges.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size")), weights, share, most)
    before = W.partitionBy("__source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__start"))
    starts = starts.join(totals, F.col("__s").eqNullSafe(F.col("source"))).drop("source")

    placed = rows.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    inside = W.partitionBy("__source", "__range").orderBy("__key", F.col(f"`{id_col}`").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    left = whole - epochs * F.col("source_size")
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), left - first))
    return placed.select(*taken, "size", "source_size", "target", (epochs * F.col("size") + once_more).cast("long").alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        words = acc["words"] + (piece != "").cast("long")
        at = acc["at"] + F.length(piece)
        return F.struct(words.alias("words"), (at + 1).alias("at"), F.when((piece != "") & (words <= n), at).otherwise(acc["end"]).alias("end"))

    return F.substring(text, F.lit(1), F.aggregate(pieces, start, step, lambda acc: acc["end"]))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as ``mix`` takes them, with their columns.

    A document that a budget cuts comes last with its first words only; a
    column n_chars is set to what is left of such a text.  Documents without
    words are never taken.
    """
    found = mix(docs, id_col, text_col, source_col, **how).where("taken > 0").withColumn("__times", F.ceil(F.col("taken") / F.col("size")))
    rows = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    rest = F.col("taken") - (F.col("__copy") - 1) * F.col("size")
    part = rest < F.col("size")
    text = F.when(part, _first_words(F.col(f"`{text_col}`"), rest)).otherwise(F.col(f"`{text_col}`"))
    out = []
    for c in docs.columns:
        if c.startswith("__"):
            continue
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(part, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)
