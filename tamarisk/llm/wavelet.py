"""Token ids in wavelet matrices: one compressed file per shard.

A shard's ids are stored as bit-planes from the highest bit down; each plane
keeps the order of the one above it, zeros first. With the running count of ones
at every 512th bit, the file answers without decoding it whole:

* `access(i)`: the id at a position,
* `rank(token, i)` and `count(token)`: occurrences before a position, and in all,
* `select(token, k)` and `locate(token)`: where they are.

Planes are cut into chunks of 64 KiB, each a Zstandard frame of its own, so a
query decompresses only the chunks it touches. Documents (their ids and starts)
are an Arrow table in the same file.

`write` sorts documents by id, and each range of ids becomes one or more shards.
Null and empty texts hold the end id alone. A null id sorts first. Equal ids keep
together, ordered by a hash of the text, and repeated rows stay. A text longer than
a shard makes one of its own, which its task holds whole. Other columns, whatever
their names, are not read. An empty table makes no shard.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import common, tokens
from tamarisk.sources import storage

MAGIC = b"WVMTRX01"
#: Ids in a shard, about; bounds a task's memory.
SHARD_TOKENS = 4_000_000
#: Texts encoded at once.
DOCS = 512
BLOCK = 512
CHUNK = 1 << 19  # bits


def encode(ids: np.ndarray, docs: pa.Table) -> list[bytes]:
    """The file's parts. docs: columns id and start, in order."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    level_ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    below = np.empty_like(level_ids)
    press = zstandard.ZstdCompressor(level=1)
    parts: list[bytes] = []
    planes = []
    for level in range(levels):
        ones = (level_ids & level_ids.dtype.type(1 << (levels - 1 - level))) != 0
        packed = np.packbits(ones, bitorder="little")
        chunks = [press.compress(packed[k : k + CHUNK // 8].tobytes()) for k in range(0, len(packed), CHUNK // 8)]
        per_block = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(per_block)]).astype("<i8")
        directory = press.compress(before.tobytes())
        planes.append({"zeros": n - int(before[-1]), "chunks": [len(c) for c in chunks], "directory": len(directory)})
        parts += [*chunks, directory]
        zeros = n - int(before[-1])
        np.compress(~ones, level_ids, out=below[:zeros])
        np.compress(ones, level_ids, out=below[zeros:])
        level_ids, below = below, level_ids
    table = io.BytesIO()
    with pa.ipc.new_file(table, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    head = json.dumps({"n": n, "levels": levels, "planes": planes, "docs": len(table.getvalue())}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *parts, table.getvalue()]


class WaveletMatrix:
    """Reads one shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16 : 16 + size])
        self.data, self.n, self.levels = memoryview(data), head["n"], head["levels"]
        self.zeros = [p["zeros"] for p in head["planes"]]
        at, self.chunks, self.before = 16 + size, [], []
        expand = zstandard.ZstdDecompressor()
        for p in head["planes"]:
            own = []
            for length in p["chunks"]:
                own.append((at, at + length))
                at += length
            self.chunks.append(own)
            self.before.append(np.frombuffer(expand.decompress(self.data[at : at + p["directory"]]), "<i8"))
            at += p["directory"]
        self.docs = pa.ipc.open_file(pa.py_buffer(self.data[at : at + head["docs"]])).read_all()
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _chunk(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            if len(self._open) >= 64:
                self._open.clear()
            a, b = self.chunks[level][k]
            self._open[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[a:b]), np.uint8)
        return self._open[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, rest = divmod(i, CHUNK)
        return int(self._chunk(level, k)[rest >> 3] >> (rest & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        found = int(self.before[level][block])
        if rest:
            k, first = divmod(block * BLOCK, CHUNK)
            own = self._chunk(level, k)[first >> 3 : (first + rest + 7) >> 3].copy()
            if rest & 7:
                own[-1] &= (1 << (rest & 7)) - 1
            found += int(np.bitwise_count(own).sum())
        return found

    def _nth(self, level: int, k: int, one: int) -> int:
        """Where the k-th (from 0) one or zero of a plane is."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """The token's rows in the lowest order, as far as the first i positions go."""
        begin, end = 0, i
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            ones_b, ones_e = self._ones(level, begin), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                begin, end = self.zeros[level] + ones_b, self.zeros[level] + ones_e
            else:
                begin, end = begin - ones_b, end - ones_e
        return begin, end

    def rank(self, token: int, i: int) -> int:
        begin, end = self._range(token, i)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        begin, end = self._range(token, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            i = self._nth(level, i - self.zeros[level] if one else i, one)
        return i

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        expand = zstandard.ZstdDecompressor()
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            packed = b"".join(expand.decompress(self.data[a:b]) for a, b in self.chunks[level])
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty_like(ids), self.zeros[level]
            above[~ones] = ids[:zeros]
            above[ones] = ids[zeros:] | ids.dtype.type(1 << (self.levels - 1 - level))
            ids = above
        return ids.astype("<u4")


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, end_id: int = 0) -> DataFrame:
    """Writes shards below `path` and returns their list: path, first (ids in all
    shards before it), n_tokens, n_docs.

    A shard's file is named anew by each attempt of its task and counts only once
    the list names it."""
    spark = docs.sparkSession
    path = storage.qualified(spark, path) if path else common.new_path(spark, "wavelet")
    vocabulary = vocabulary or tokens.vocabulary_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = tokens.loaded(vocabulary), TaskContext.get().partitionId()
        keys, starts, data, n, k = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{path}/{part:06d}-{k:04d}-{uuid.uuid4().hex}.wvm"
            table = pa.table({"id": pa.concat_arrays(keys), "start": np.concatenate(starts)})
            common.write_bytes(name, encode(np.concatenate(data), table))
            return pa.RecordBatch.from_pydict({"part": [part], "k": [k], "path": [name], "n_tokens": [n], "n_docs": [len(table)]})

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                some = batch.slice(at, DOCS)
                ids, sizes = bpe.ended(some.column(1), end_id)
                ends, begin = np.cumsum(sizes), 0
                while begin < len(sizes):  # a shard ends with the document that fills it
                    done = int(ends[begin - 1]) if begin else 0
                    stop = min(len(sizes), begin + 1 + int(np.searchsorted(ends[begin:] - done + n, shard_tokens)))
                    keys.append(some.column(0).slice(begin, stop - begin))
                    data.append(ids[done : ends[stop - 1]])
                    starts.append(n + ends[begin:stop] - sizes[begin:stop] - done)
                    n += int(ends[stop - 1]) - done
                    begin = stop
                    if n >= shard_tokens:
                        yield close()
                        keys, starts, data, n, k = [], [], [], 0, k + 1
        if starts:
            yield close()

    listed = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id", F.xxhash64("text"))
        .sortWithinPartitions("id", F.xxhash64("text"))
        .mapInArrow(shards, "part long, k long, path string, n_tokens long, n_docs long")
    )
    order = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    # The list has one short row for each file, so one task orders it.
    return common.cut(listed, "wavelet-list").select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("first"), "n_tokens", "n_docs")


def read(listed: DataFrame, id_type: str = "long") -> DataFrame:
    """The documents of the listed shards, from their files: id, start (ids of all
    documents before it), ids (binary: little-endian unsigned 32-bit integers)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletMatrix(common.read_bytes(name))
                ids = shard.decode()
                starts = shard.docs.column("start").to_numpy()
                ends = np.append(starts[1:], shard.n)
                keys = shard.docs.column("id").combine_chunks()
                for at in range(0, len(starts), 1024):
                    own = slice(at, at + 1024)
                    yield pa.RecordBatch.from_arrays([keys.slice(at, 1024), pa.array(starts[own] + first, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts[own], ends[own], strict=True)], pa.binary())], names=["id", "start", "ids"])

    return common.dealt(listed.select("path", "first")).mapInArrow(documents, f"id {id_type}, start long, ids binary")
