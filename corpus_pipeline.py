"""A corpus from documents: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of documents, and further ones that came in.  A stage works
on all that its predecessor kept, and gives an empty frame for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.llm import bpe, exact_dedup, mixing, near_copies, quality
from voxlake.llm.queries import tokenizer
from voxlake.llm.storage import materialize, point, release, release_since
from voxlake.session import prepare, spread


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of those that come in, doesn't reject.

    Null and empty texts are scored like any other.  Rows that repeat an
    identifier are judged each by its text; a null identifier has no label.
    An empty table gives an empty one.
    """
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased): the one with the smallest identifier.

    Null texts are equal to empty ones.  A null identifier stays only where its
    group has no other; of equal rows one stays.
    """
    return exact_dedup.exact_dedup(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Their 256-bit fingerprints find them, their whole sets decide.  Texts
    without words, null among them, are one group; texts of fewer than five
    words are one shingle.  The smallest identifier stays, a null one where its
    group has no other.
    """
    return near_copies.drop_near_copies(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of their sources' weights, repeated where a source is short.

    Null sources are one source.  Documents without words aren't taken; the
    document at a source's cut comes with its first words.
    """
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded bytes.

    A null text counts as empty and has no ids; each row is encoded, repeated
    ones too.
    """
    return bpe.bpe_round_trip(docs, *tokenizer())


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("tokens", to_tokens)]

#: The classifier can't be put in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; a stage's own tables go when it is written."""
    docs = spread(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        start = point()
        kept = materialize(stage(spark, docs, sf_dir), name)
        release_since(start, kept)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
