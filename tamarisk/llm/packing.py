"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two: as many
of the largest length as fit, then the binary digits of the rest, largest first.
A piece is a sequence of its own, so no sequence crosses documents and none needs
padding; sequences of one length form a bucket from which training draws batches
(`write_buckets` writes a folder for each).

Numbering needs no second pass: a sequence's number is made of its bucket, the
partition and a count within both, so it is unique, sorts by bucket and is the
same when a lost task runs again. No shuffle takes place, but for a small table's (`common.spread`).

Null and empty texts have the end id alone: one piece of length 1. Repeated rows
and repeated doc_ids are packed each for itself. A very long text is cut like any
other; its worker holds it whole. Of other columns none is kept, whatever their
names. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common, tokens

#: Longest sequence, in tokens.
MAX_LENGTH = 1024
END_ID = 0
#: Texts encoded at once.
DOCS = 1024


def pieces(sizes: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of every piece, in order. sizes: each document's
    ids."""
    whole, rest = np.divmod(sizes, longest)
    full = np.repeat(np.arange(len(sizes)), whole)
    nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    bits = longest.bit_length() - 2 - np.arange(longest.bit_length() - 1)
    part, k = np.nonzero(rest[:, None] >> bits & 1)
    length = 1 << bits[k]
    doc = np.concatenate([full, part])
    start = np.concatenate([nth * longest, sizes[part] - rest[part] % (2 * length)])
    order = np.lexsort((start, doc))
    return doc[order], start[order], np.concatenate([np.full(len(full), longest), length])[order]


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (binary: little-endian unsigned
    32-bit integers), doc_tokens, sequence_id, offset."""
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    path = vocabulary or tokens.vocabulary_path()
    kind = docs.schema[id_col].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.loaded(path)
        part = TaskContext.get().partitionId()
        counts = np.zeros(longest.bit_length() + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                some = batch.slice(at, DOCS)
                ids, sizes = bpe.ended(some.column(1), end_id)
                doc, start, length = pieces(sizes, longest)
                bucket = np.log2(length).astype(np.int64) + 1
                own = np.zeros(len(length), np.int64)
                for b in np.unique(bucket):
                    inside = np.flatnonzero(bucket == b)
                    own[inside] = counts[b] + np.arange(len(inside))
                    counts[b] += len(inside)
                ends = np.append(0, 4 * np.cumsum(length))  # pieces lie one after the other
                data = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(sizes[doc]), pa.array((bucket << 26 | part) << 32 | own), pa.array(np.zeros(len(own), np.int64))],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
        common.release()

    return (
        common.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        .mapInArrow(packed, f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
        .withColumnRenamed("id", id_col)
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length; training draws its batches from one at a time."""
    packed.write.partitionBy("length").parquet(path)
