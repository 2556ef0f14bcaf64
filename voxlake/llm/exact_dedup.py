"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts, each range is sorted
externally, and every row is compared in full with its neighbour.  Splitters
end with the identifier, so a large group of equal texts is cut over several
ranges; the parts of a cut group are compared in full and joined up from a row
a range.

Texts sort by their beginning and, where that agrees, by digest: equal texts
are neighbours as they are when sorted by all their bytes, and splitters stay
short.  Splitters of whole texts would make the driver's sample as large as
MOST_SAMPLES texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that take part in a splitter; the digest and the identifier follow.
HEAD = 24
#: Ranges per shuffle partition, and sampled keys per range.
RANGES, SAMPLES = 6, 40
#: Keys that the driver gets at most, about 100 bytes each.
MOST_SAMPLES = 250_000
RESULTS = {"keep_id", "group_size", "kept", "text_sha256"}


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _head(text: Column) -> Column:
    """The bytes of the normalised text's first HEAD characters in hexadecimal digits, which sort as they do."""
    return F.hex(normalised(F.substring(text, 1, HEAD)))


def _key(head: Column, digest: Column, ident: Column) -> Column:
    """A string without spaces that sorts by content first and then by identifier."""
    return F.concat_ws(".", head, digest, F.hex(F.coalesce(ident.cast("string"), F.lit(""))))


def _splitters(rows: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 evenly spaced keys out of a hash sample of about ranges * SAMPLES keys, MOST_SAMPLES at most."""
    wanted = min(ranges * SAMPLES, MOST_SAMPLES)
    every = max(1, rows.count() // wanted)
    sample = rows.where(F.pmod(F.xxhash64("__id", F.octet_length("__text")), F.lit(every)) == 0) if every > 1 else rows
    keys = sample.limit(4 * wanted).select(_key(_head(F.col("__text")), F.sha2(normalised(F.col("__text")), 256), F.col("__id")).alias("k"))
    keys = sorted(r.k for r in keys.collect())
    return list(dict.fromkeys(keys[len(keys) * i // ranges] for i in range(1, ranges))) if keys else []


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Index of the key's range, found in two steps of about sqrt(ranges) comparisons each."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    constant = lambda keys: F.split(F.lit(" ".join(keys)), " ")  # noqa: E731  one literal, folded once
    below = lambda keys: F.size(F.filter(keys, lambda s: s <= key))
    block = below(constant(splitters[::step]))
    inner = F.slice(constant(splitters), (F.greatest(block, F.lit(1)) - 1) * step + 1, F.lit(step))
    return F.when(block == 0, 0).otherwise((block - 1) * step + below(inner))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """All columns of ``docs`` plus keep_id, group_size, kept and text_sha256.

    Texts are equal when their normalised bytes are.  ``keep`` says which
    identifier of a group stays: ``min`` or ``max``.  Null texts count as
    empty, and empty texts form a group like any other.  A null identifier
    stays only where its group has no other; of rows that repeat the kept
    identifier one stays.  Columns of the input that bear a result's name are
    replaced.  An empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    taken = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS and not c.startswith("__")]
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    splitters = _splitters(docs.select(ident.alias("__id"), text.alias("__text")), ranges)
    rows = docs.select(*taken, ident.alias("__id"), _head(text).alias("__head"), F.sha2(normalised(text), 256).alias("text_sha256"))
    # the key is a column of its own, so that it isn't worked out anew for each splitter
    ranged = rows.withColumn("__key", _key(F.col("__head"), F.col("text_sha256"), ident)).withColumn("__range", _range_of(F.col("__key"), splitters)).drop("__key")

    order = F.col("__id").asc_nulls_last() if keep == "min" else F.col("__id").desc_nulls_last()
    sorted_range = W.partitionBy("__range").orderBy("__head", "text_sha256", order)
    # texts are compared in full wherever the digests of neighbours agree
    equal = F.when(F.lag("text_sha256").over(sorted_range) == F.col("text_sha256"), normalised(F.lag(text).over(sorted_range)) == normalised(text))
    own = W.partitionBy("__range", "__run")
    runs = (
        ranged.repartition("__range")
        .withColumn("__run", ~F.coalesce(equal, F.lit(False)))
        .withColumn("__run", F.sum(F.col("__run").cast("int")).over(sorted_range.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__best", best("__id").over(own))
        .withColumn("__n", F.count("*").over(own))
        .withColumn("__nth", F.row_number().over(own.orderBy(order)))
    )
    whole = runs.join(F.broadcast(_cut_groups(ranged, text, splitters, best)), "text_sha256", "left")
    keep_id = F.when(F.col("__all").isNull(), F.col("__best")).otherwise(F.col("__top"))
    stays = F.col("__id").eqNullSafe(keep_id) & (F.col("__nth") == 1) & (F.col("__at").isNull() | (F.col("__at") == F.col("__range")))
    return whole.select(*taken, keep_id.alias("keep_id"), F.coalesce("__all", "__n").cast("long").alias("group_size"), stays.alias("kept"), "text_sha256")


def _cut_groups(rows: DataFrame, text: Column, splitters: list[str], best) -> DataFrame:
    """For each group that a splitter cuts: its size, the identifier that stays and that one's range.

    Only a text whose digest stands in a splitter lies on both sides of it, so
    there are fewer groups here than ranges: a broadcast of bounded size.  Each
    range's part gives one text, and these are compared in full: two texts of
    one digest are an error.
    """
    cut = [s.split(".")[:2] for s in splitters]
    here = F.col("__head").isin([c[0] for c in cut]) & F.col("text_sha256").isin([c[1] for c in cut]) if cut else F.lit(False)
    parts = rows.where(here).select("text_sha256", "__range", "__id", normalised(text).alias("__t"))
    found = parts.groupBy("text_sha256", "__range").agg(best("__id").alias("__id"), F.count("*").alias("__n"), F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    pick = F.min_by if best is F.min else F.max_by
    known = F.col("__id").isNull() if best is F.min else F.col("__id").isNotNull()
    size = F.when(F.min("__lo") == F.max("__hi"), F.sum("__n")).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("long"))
    return found.groupBy("text_sha256").agg(size.alias("__all"), best("__id").alias("__top"), pick("__range", F.struct(known, "__id")).alias("__at"))
