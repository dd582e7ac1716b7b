"""Ranked lexical search with exact integer scores: a hybrid of term-at-a-time and
document-at-a-time over an index in segments.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with
A-Z lower-cased. A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a
document's length factor m is 10 + (90 n N) div L, and a term adds
w * ((10^9 tf) div (1000 tf + 8 m)); N, L, df count the whole table. N and L leave out
documents without a term; equal scores go by ascending id, null ids last.

Index: each task gathers documents of its own, in their order, until they hold
`SEGMENT` bytes of text, and writes one row for each such segment: its documents, its
terms, and the postings of each as arrays of document numbers and counts. Rows cross
no exchange, whatever terms they share, so a word that every document holds is a list
in each segment and never one list. The index is a table and serves any queries.

Search, by item and segment: postings of short lists (at most 1 in `SHORT` of the
segment's documents) are added up term at a time into accumulators. These are then
one more list, with their highest sum in each block of documents as its bound, beside
the long lists and theirs. Blocks come in document order; one whose bounds together
stay below the item's tenth best score is skipped in all lists. In the others lists
are added from the highest bound down, until no document can reach the tenth score.
The ten best go on to the task's next segment, so later segments skip more. Each task
gives ten rows for each item at most, and a window takes the ten of all tasks.

Items are searched in blocks of `PAIRS` item and term pairs or so, one pass over the
index each; a block's pairs are broadcast (some 10 MB). Memory of a task: a segment
(its postings, and the scores of the block's terms that it holds) and the block.

Null, empty and other texts without a term match nothing, as documents and as items.
Repeated rows are ranked one by one. A text longer than `SEGMENT` is a segment of its
own, cut to terms in pieces. Other columns, whatever their names, are not read. An
empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import common

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Bytes of text in a segment, and those of a text that are cut to terms at once.
SEGMENT, PIECE = 16 << 20, 1 << 20
#: A list is short if it holds at most one in so many of the segment's documents.
SHORT = 16
#: Documents of a block.
BLOCK = 256
PAIRS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _cut(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, piece by piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Segment:
    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.numbers, self.words, self.bytes = _Numbers(), [], 0

    def add(self, doc: object, text: str) -> None:
        data, size = text.encode().translate(_TABLE), 0
        for words in _cut(data):
            got = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            size += len(got)
            self.words.append((got << 32) | len(self.ids))
        self.bytes += len(data)
        if size:
            self.ids.append(doc)
            self.sizes.append(size)

    def row(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        kinds = {"ids": pa.list_(id_type), "sizes": pa.list_(pa.int32()), "terms": pa.list_(pa.string()), "dfs": pa.list_(pa.int32()), "places": pa.binary(), "counts": pa.binary(), "n_terms": pa.int64()}
        keys, counts = np.unique(np.concatenate(self.words), return_counts=True)
        df = np.bincount(keys >> 32, minlength=len(self.numbers))
        packed = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in (keys & 0xFFFFFFFF, counts)]
        one = [self.ids, self.sizes, [w.decode() for w in self.numbers], df.astype(np.int32), packed[0], packed[1], sum(self.sizes)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds.values(), strict=True)], names=list(kinds))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Segments, written: ids, sizes (terms of each document), terms, dfs (documents of
    each term), places and counts (packed; by term, then document), n_terms."""
    kind = docs.schema[id_col].dataType

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, now = None, _Segment()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for k in range(batch.num_rows):
                if (text := batch.column(1)[k].as_py()) is not None:
                    now.add(batch.column(0)[k].as_py(), text)
                if now.bytes >= segment:
                    yield from now.row(id_type)
                    now = _Segment()
        yield from now.row(id_type)
        common.release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(built, f"ids array<{kind.simpleString()}>, sizes array<int>, terms array<string>, dfs array<int>, places binary, counts binary, n_terms long")
    return common.cut(made, "segments")


class _Best:
    """An item's best documents so far."""

    def __init__(self, k: int) -> None:
        self.k, self.found, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.found = sorted([*self.found, *((-int(s), d is None, d) for s, d in zip(scores, ids, strict=True))], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[: self.k]
        if len(self.found) == self.k:
            self.least = max(1, -self.found[-1][0])


class _Lists:
    """A segment's postings, with the impact of each on a score before its weight and
    the highest of every block of documents."""

    def __init__(self, row: dict, n: int, total: int, wanted: dict[str, int]) -> None:
        self.ids, sizes = row["ids"].as_py(), row["sizes"].values.to_numpy().astype(np.int64)
        if 90 * int(sizes.max()) * n < 1 << 63:
            self.m = 10 + (90 * sizes * n) // total
        else:  # beyond 64 bits
            self.m = np.array([10 + (90 * int(s) * n) // total for s in sizes], np.int64)
        ends = np.cumsum(row["dfs"].values.to_numpy().astype(np.int64))
        places, counts = (np.frombuffer(zlib.decompress(row[c].as_py()), "<u4") for c in ("places", "counts"))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.at: dict[int, tuple] = {}
        terms = row["terms"].values
        for k in np.flatnonzero(pa.compute.is_in(terms, pa.array(list(wanted), pa.string())).to_numpy(zero_copy_only=False)):
            a, b = (ends[k - 1] if k else 0), ends[k]
            docs, tf = places[a:b].astype(np.int64), counts[a:b].astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[docs])
            bounds = np.zeros(self.blocks, np.int64)
            np.maximum.at(bounds, docs // BLOCK, impact)
            starts = np.searchsorted(docs, np.arange(self.blocks + 1) * BLOCK)
            self.at[wanted[terms[k].as_py()]] = (docs, impact, bounds, starts)

    def rank(self, item: list[tuple[int, int]], best: _Best) -> None:
        """item: term numbers and weights."""
        held = [(*self.at[t], w) for t, w in item if t in self.at and w > 0]
        if not held:
            return
        many = len(self.ids)
        short = [x for x in held if len(x[0]) * SHORT <= many]
        long = [x for x in held if len(x[0]) * SHORT > many]
        sums = np.zeros(many, np.int64)
        for docs, impact, _, _, w in short:  # term at a time
            sums[docs] += w * impact
        bounds = np.maximum.reduceat(sums, np.arange(0, many, BLOCK)) + sum(w * b for _, _, b, _, w in long)
        if len(short) and many > best.k:
            # Sums alone tell how high the tenth best is at least.
            best_sum = int(np.partition(sums, many - best.k)[many - best.k])
            least = max(best.least, best_sum)
        else:
            least = best.least
        for b in np.flatnonzero(bounds >= least):  # document at a time
            if bounds[b] < least:
                continue
            low = b * BLOCK
            scores = sums[low : low + BLOCK].copy()
            rest = int(bounds[b]) - int(scores.max())
            for docs, impact, own, starts, w in sorted(long, key=lambda x: -x[4] * int(x[2][b])):
                if int(scores.max()) + rest < least:
                    break  # no document here can reach the tenth
                s, e = starts[b], starts[b + 1]
                scores[docs[s:e] - low] += w * impact[s:e]
                rest -= w * int(own[b])
            else:
                good = np.flatnonzero(scores >= least)
                if len(good):
                    best.add(scores[good], [self.ids[low + g] for g in good])
                    least = max(least, best.least)


def statistics(segments: DataFrame) -> tuple[int, int]:
    """N and L."""
    n, total = segments.agg(F.sum(F.size("ids")), F.sum("n_terms")).first()
    return n or 0, total or 0


def weighted(segments: DataFrame, items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """key, item, term, weight of every item's terms that a document holds. key tells
    items apart."""
    lower = F.translate(F.col(text_col), _UPPER, _LOWER)
    terms = common.keyed(items, "__key").select(F.col("__key").alias("key"), F.col(id_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term"))
    terms = common.cut(terms, "items")
    held = segments.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df")))).join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    return common.cut(terms.join(df, "term").select("key", "item", "term", weight.alias("weight")), "weights")


def search(segments: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = K, pairs: int = PAIRS) -> DataFrame:
    """item id, rank (from 1), doc_id, score: each item's k highest scores above 0."""
    spark = segments.sparkSession
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    n, total = statistics(segments)
    terms = weighted(segments, items, id_col, text_col, n)
    parts = -(-terms.count() // pairs)
    found = None
    for part in range(parts):
        block = terms.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key", "term", "weight").toArrow()
        held: dict[str, list] = {}
        numbers: dict[str, int] = {}
        for key, term, weight in zip(*(block.column(c).to_pylist() for c in range(3)), strict=True):
            held.setdefault(key, []).append((numbers.setdefault(term, len(numbers)), weight))
        sent = spark.sparkContext.broadcast((held, numbers))
        some = segments.select("ids", "sizes", "terms", "dfs", "places", "counts").mapInArrow(_searcher(sent, n, total, k), f"key string, doc_id {kind}, score long")
        some = common.cut(some, "found")
        sent.destroy()
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], f"{id_col} {items.schema[id_col].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(terms.select("key", "item").distinct(), "key").select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _searcher(sent, n: int, total: int, k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = sent.value
        best: dict[str, _Best] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type
            for r in range(batch.num_rows):
                lists = _Lists({c: batch.column(c)[r] for c in batch.schema.names}, n, total, numbers)
                for key, item in held.items():
                    lists.rank(item, best.setdefault(key, _Best(k)))
                del lists
        rows = [(key, d, -s) for key, b in best.items() for s, _, d in b.found]
        if rows:
            keys, docs, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(docs, id_type), pa.array(scores, pa.int64())], names=["key", "doc_id", "score"])
        common.release()

    return searched
