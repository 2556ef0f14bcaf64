"""Byte-level BPE encoding and decoding with a local rank file.

The rank file is read on the driver and sent to the executors as one broadcast
of fixed size (under 2 MB); each Python worker builds its encoder once.  Long
texts are split before a blank, tab or line end that follows other characters:
no match of the pattern crosses such a place, so the pieces encode as the whole would.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Characters a piece has before it is cut at the next safe place.
PIECE = 50_000
#: Where the pattern ends a match whatever follows: its own white space is wider than these four, Python's takes in U+001C-001F, which the pattern's doesn't.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")

_encoders: dict[str, object] = {}


def send_ranks(spark: SparkSession, path: str, pattern: str) -> tuple[Broadcast, str]:
    """The rank file's bytes and the pattern, for ``encoder``."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern


def encoder(ranks: bytes, pattern: str):
    """A tiktoken encoding of the ranks, without special tokens, built once a process."""
    import tiktoken

    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _encoders:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts of at least ``most`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(enc, text: str) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [t for part in pieces(text) for t in enc.encode_ordinary(part)]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_tokens, ids_sha256 and decoded_sha256; with ``ids`` also token_ids.

    The ids are those that the tiktoken library gives for each whole text
    without special tokens; ids_sha256 is over the decimal ids joined by
    commas, decoded_sha256 over the bytes that the ids decode to.  Null counts
    as empty; an empty text has no ids.  Columns of the input that bear a
    result's name are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranks, pattern = send_ranks(spark, path, pattern)
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>"} if ids else {})
    kept = [c for c in docs.columns if c.lower() not in added and c != text_col and not c.startswith("__")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema] + [f"{k} {v}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            for part in _slices(batch):
                yield _encoded(enc, part, kept, text_col, ids)

    return docs.select(*[f"`{c}`" for c in kept], f"`{text_col}`").mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _encoded(enc, batch: pa.RecordBatch, kept: list[str], text_col: str, ids: bool) -> pa.RecordBatch:
    counts, id_sums, text_sums, lists = [], [], [], []
    for text in batch.column(len(kept)).to_pylist():
        found = encode(enc, text or "")
        counts.append(len(found))
        id_sums.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
        text_sums.append(hashlib.sha256(enc.decode_bytes(found)).hexdigest())
        if ids:
            lists.append(pa.array(found, pa.int32()))
    columns = [*(batch.column(i) for i in range(len(kept))), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
    names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
    if ids:
        ends = [0]
        for x in lists:
            ends.append(ends[-1] + len(x))
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
        names.append("token_ids")
    return pa.RecordBatch.from_arrays(columns, names=names)
