"""Token counts by an exact length histogram.

Documents are counted by encoded length.  Suffix sums over the histogram then
answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import encode, encoder, send_ranks
from .storage import materialize

#: Lengths per block of the two-level prefix sums.
BLOCK = 256


def token_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens long.  Null counts as empty."""
    ranks, pattern = send_ranks(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(enc, x.as_py() or "")) for x in batch.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(f"`{text_col}`").mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, from a frame with the column n_tokens.

    n_tokens; n_docs of that length; docs_up_to and tokens_up_to: of documents
    no longer; docs_beyond and tokens_beyond: of longer ones; truncated_total:
    tokens left if n_tokens is the context limit; quantile: share of documents
    no longer.  Null lengths are left out; no documents give no rows.

    Sums run over blocks of lengths and then inside each block, so no task
    reads the whole histogram row by row but for one row a block.  The counts
    are written once, as both levels read them: texts are encoded once.
    """
    counts = materialize(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}")), "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = blocks.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"])
    inside = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    rows = counts.join(starts, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.col("d0") + F.sum("n_docs").over(inside)).alias("docs_up_to"),
        (F.col("t0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_up_to"),
    )
    beyond = F.col("d_all") - F.col("docs_up_to")
    return rows.select("n_tokens", "n_docs", "docs_up_to", "tokens_up_to", beyond.alias("docs_beyond"), (F.col("t_all") - F.col("tokens_up_to")).alias("tokens_beyond"), (F.col("tokens_up_to") + F.col("n_tokens") * beyond).alias("truncated_total"), (F.col("docs_up_to") / F.col("d_all")).alias("quantile"))


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit (limit_tokens): docs_within and truncated_total, from the histogram.

    One pass over the histogram, whatever the limits; below the shortest length
    all documents are truncated to the limit.  An empty histogram gives 0 and 0
    for each limit, repeated limits a row each, no limits no rows.
    """
    at = [F.max(F.when(F.col("n_tokens") <= int(x), F.struct("n_tokens", "docs_up_to", "tokens_up_to"))).alias(f"h{k}") for k, x in enumerate(limits)]
    found = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), *at)

    def row(k: int, limit: int):
        docs, tokens = (F.coalesce(F.col(f"h{k}.{c}"), F.lit(0)) for c in ("docs_up_to", "tokens_up_to"))
        return F.struct(F.lit(limit).cast("long").alias("limit_tokens"), docs.alias("docs_within"), (tokens + F.lit(limit) * (F.col("n") - docs)).alias("truncated_total"))

    rows = F.array(*[row(k, int(x)) for k, x in enumerate(limits)]) if limits else F.array().cast("array<struct<limit_tokens:bigint,docs_within:bigint,truncated_total:bigint>>")
    return found.select(F.inline(rows))
