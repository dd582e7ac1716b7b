"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distance.

A text is lower-cased (A-Z), cut into words and 3-word shingles with repeats, and
a fingerprint bit is set if over half of the shingles' XXH64 values (seed 42) have
it. Fingerprints link at 3 or fewer differing bits.

Candidates: 64 bits make six blocks. Two fingerprints that differ in at most
three bits agree in at least three whole blocks, so they meet in one of the 20
tables keyed by three blocks (32 or 33 bits); no link is lost. Only distinct
fingerprints enter, so copies cost one row. Within a key, links are searched
breadth first and given as a star around the smallest fingerprint, never as all
pairs. A key with more than `CELL` fingerprints is dealt to cells, one for each
pair of its parts, so no task holds more than two parts.

Fewer than three words: the whole sequence is the one shingle. No word, null or
empty text: fingerprint zero, linked like any other. Null ids get a fingerprint
and the component of their link, and never name one unless no other id can.
Repeated rows stay. A very long text is hashed as a whole; its worker holds its
words once. Other columns, whatever their names, are not read. An empty table gives
no row. Rows meet their fingerprint's component by a join on the fingerprint, of
16 bytes a row: where a third of all rows share one, adaptive execution splits its
partition, the other side being a single row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common
from tamarisk.llm.components import components

SEED = 42
WORDS = 3
DISTANCE = 3
#: Fingerprints of one key that a task compares at once.
CELL = 8192
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = len(words) - WORDS + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)))) if n > 0 else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", max(1, n))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):  # a long text needs no more memory
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """id, fp: the fingerprint as a signed 64-bit integer; and key, if named."""
    more = [] if key_col is None else ["key"]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                found = np.array([fingerprint(t) for t in some.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found.view(np.int64)), *some.columns[2:]], names=["id", "fp", *more])
        common.release()

    kind = docs.schema[id_col].dataType.simpleString()
    keys = [F.col(key_col).alias(k) for k in more]
    return common.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keys)).mapInArrow(marked, f"id {kind}, fp long" + "".join(f", {k} {docs.schema[key_col].dataType.simpleString()}" for k in more))


def _keys(fp):
    """One exact key for each table: its number and three blocks' bits."""
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = []
    for t, chosen in enumerate(combinations(range(len(BLOCKS)), 3)):
        key = F.lit(t).cast("long")
        for k in chosen:
            key = F.shiftleft(key, BLOCKS[k][1]).bitwiseOR(part[k])
        keys.append(key)
    return F.array(*keys)


def _stars(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The linked groups among sorted distinct values: the least and the others."""
    left = values
    while len(left) > 1:
        seed, left = left[0], left[1:]
        group, edge = [], np.array([seed])
        while len(edge) and len(left):
            near = np.zeros(len(left), bool)
            for x in edge:  # each value looks once at what is not yet reached
                near |= np.bitwise_count(left ^ x) <= DISTANCE
            edge, left = left[near], left[~near]
            group.append(edge)
        if group and sum(map(len, group)):
            yield int(seed.view(np.int64)), np.concatenate(group)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cell; a group may go on in the next batch."""
    held: list[np.ndarray] = []

    def stars(rows: np.ndarray) -> pa.RecordBatch | None:
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], np.any(rows[1:, :3] != rows[:-1, :3], axis=1)]))
        sizes = np.diff(np.append(starts, len(rows)))
        for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            for seed, others in _stars(np.unique(rows[s : s + n, 3].view(np.uint64))):
                a.append(others.view(np.int64))
                b.append(np.full(len(others), seed))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]) if a else None

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([*held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
        earlier = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
        first = int(earlier[-1]) + 1 if len(earlier) else 0
        if first and (out := stars(rows[:first])) is not None:
            yield out
        held = [rows[first:]]
    if held and (out := stars(held[0])) is not None:
        yield out


def links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """a, b: links that join every group of fingerprints within DISTANCE. prints:
    distinct values in column fp."""
    entries = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    hot = common.cut(entries.groupBy("key").count().filter(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).alias("parts")), "hot-keys")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return (
        entries.join(hot, "key", "left")
        .select("key", "fp", F.explode(cells).alias("cell"))
        .select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "fp")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_linked, "a long, b long")
    )


def _groups(marked: DataFrame) -> DataFrame:
    """fp, least (id), group: one row for each fingerprint of `marked`."""
    prints = common.cut(marked.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    groups = components(links(prints))
    return prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component (the smallest id reachable by links), one row per row."""
    marked = common.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    least = _groups(marked)
    best = least.filter("group != fp").union(least.filter("group = fp")).groupBy("group").agg(F.min("least").alias("component"))
    named = least.join(best, "group").select("fp", "component")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def representatives(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key of one row of each linked group: of the smallest id, nulls last, the
    smallest key. Keys tell rows apart that are equal otherwise; they must be
    written, so that each reading gives the same."""
    marked = common.cut(fingerprints(docs, id_col, text_col, key_col), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first")
    return marked.join(_groups(marked).select("fp", "group"), "fp").groupBy("group").agg(first).select(F.col("first.key").alias(key_col))


def hexadecimal(fp):
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
