"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector is stored with every filter whose direction it
exceeds by its threshold. Directions are `CODES` structured random product codes:
after a random rotation the dimensions are halved, each half has some Gaussian
codewords, and a direction is any pair of codewords. A pair's score is the sum of
two short products, so a vector's filters are list-decoded from two short lists
instead of all pairs of words. The threshold is the vector's own: the score that a
set number of directions of each code reach (`listed`). A fixed one leaves some
vectors with a single filter, and one pair in ten at a cosine of 0.9 unmet.

Codewords grow with the square root of the number of vectors (`words_for`), so a
filter holds about one of unrelated vectors, and comparisons grow with the vectors
and not with their square, up to `MOST_WORDS`: some ten million vectors; beyond, a
filter's share grows with the table. Smaller caps are shared less often by near
vectors, so lists grow with the words by the share that is lost. Vectors that share
a filter are compared in double precision, and only a cosine of at least `COSINE`
links.

Equal vectors enter once, with their number. Vectors of a filter are compared in
blocks of a matrix product; a filter with more than `CELL` vectors is dealt to
cells, one for each pair of its parts, so no task holds more than two parts and no
pair is ever a row. A pair counts where its smallest common filter is, so its
vectors' link counts need no distinct pairs; components get a star for each
linked group of a cell.

A filter's entries carry the vector in the width it was given in.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing. Vectors of different lengths never link. Rows repeat as given: equal
rows are other vectors to one another. Null ids are kept; a component's name is
its smallest id that is not null, and of rows that share it all are kept. Other
columns, whatever their names, are not read. A very long vector takes as much of a
worker as a rotation of its length. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common
from tamarisk.llm.components import components

COSINE = 0.9
CODES = 4
LEAST_WORDS, MOST_WORDS = 256, 8192
#: Filters of each code at `LIST_WORDS` codewords.
LIST, LIST_WORDS = 10, 400
SEED = 20240601
#: Vectors of one filter in a part.
CELL = 1024


def words_for(vectors: int) -> int:
    """Codewords of a half: about as many directions as entries."""
    return min(MOST_WORDS, max(LEAST_WORDS, math.isqrt(vectors * LIST)))


def listed(words: int) -> int:
    """Filters of each code. A vector at `COSINE` to another reaches the height of
    that one's best direction with a chance that falls as the directions grow."""
    chance = lambda w: math.erfc((1 - COSINE) * math.sqrt(2 * math.log(w * w)) / math.sqrt(2 * (1 - COSINE**2)))
    return math.ceil(LIST * max(1.0, chance(LIST_WORDS) / chance(words)))


class Filters:
    """The filters of vectors of one length."""

    def __init__(self, dims: int, words: int):
        random = np.random.default_rng(SEED + dims)
        self.words, self.list, self.half = words, listed(words), (dims + 1) // 2
        draw = lambda rows: random.standard_normal((rows, words)).astype(np.float32)
        self.codes = [(np.linalg.qr(random.standard_normal((dims, dims)))[0].astype(np.float32), draw(self.half), draw(dims - self.half)) for _ in range(CODES)]

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Each unit vector's filters, ascending. A pair among the best sums has both
        its parts among as many best."""
        out, unit, n = [], unit.astype(np.float32), self.list
        for code, (turn, left, right) in enumerate(self.codes):
            turned = unit @ turn
            a, b = turned[:, : self.half] @ left, turned[:, self.half :] @ right
            i, j = (np.argpartition(-x, n - 1, axis=1)[:, :n] for x in (a, b))
            sums = np.take_along_axis(a, i, 1)[:, :, None] + np.take_along_axis(b, j, 1)[:, None, :]
            best = np.argpartition(-sums.reshape(len(unit), -1), n - 1, axis=1)[:, :n]
            out.append((code * self.words + np.take_along_axis(i, best // n, 1)) * self.words + np.take_along_axis(j, best % n, 1))
        return np.sort(np.concatenate(out, axis=1), axis=1)


_LOADED: dict[tuple, Filters] = {}


def _filters(dims: int, words: int) -> Filters:
    if (dims, words) not in _LOADED:
        _LOADED[dims, words] = Filters(dims, words)
    return _LOADED[dims, words]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _decoding(words: int, width: str):
    """Batches of cid, n, embedding to cid, n, dims, data, filters (32-bit)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, ns, lists = batch.columns
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype(width), lists.offsets.to_numpy()
            sizes = np.diff(ends)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    own = values[ends[some][:, None] + np.arange(dims)]
                    found = _filters(int(dims), words).decode(_unit(own)).astype("<i4")
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [cids.take(take), ns.take(take), pa.array(np.full(len(some), dims, np.int32)), pa.array([x.tobytes() for x in own], pa.binary()), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))],
                        names=["cid", "n", "dims", "data", "filters"],
                    )

    return decoded


def _groups(near: np.ndarray) -> Iterator[np.ndarray]:
    """The linked groups of a symmetric matrix, each with its first row first."""
    left = np.ones(len(near), bool)
    for seed in range(len(near)):
        if not left[seed]:
            continue
        left[seed] = False
        group, edge = [np.array([seed])], near[seed] & left
        while edge.any():
            left &= ~edge
            rows = np.flatnonzero(edge)
            group.append(rows)
            edge = near[rows].any(axis=0) & left
        if len(group) > 1:
            yield np.concatenate(group)


def _common_before(filters: list[np.ndarray], number: int) -> np.ndarray:
    """Pairs that share a filter with a smaller number."""
    own = [f[: np.searchsorted(f, number)] for f in filters]
    known, at, many = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    some = many[at] > 1  # a filter of one vector joins nothing
    known, at, row = known[many > 1], (np.cumsum(many > 1) - 1)[at[some]], row[some]
    shared = np.zeros((len(own), len(own)), np.float32)
    for k in range(0, len(known), 4096):
        inside = (at >= k) & (at < k + 4096)
        marks = np.zeros((len(own), min(4096, len(known) - k)), np.float32)
        marks[row[inside], at[inside] - k] = 1
        shared += marks @ marks.T
    return shared > 0


def _compared(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by filter and cell (dims, number, i, j, part, cid, n, data,
    filters) to link counts (cid, null, links) and links of groups (cid, other,
    null)."""

    def cell(key: list[int], rows: list[tuple]) -> list[tuple]:
        ids, ns, parts, data, filters = zip(*rows, strict=True)
        near = (x := _unit(np.stack([np.frombuffer(v, width) for v in data]))) @ x.T >= COSINE
        np.fill_diagonal(near, False)
        if not near.any():
            return []
        out = []
        for group in _groups(near):
            out += [(ids[k], ids[group[0]], None) for k in group[1:]]
        if key[2] != key[3]:  # pairs within a part belong to its own cell
            near &= np.not_equal.outer(np.array(parts), np.array(parts))
        linked = np.flatnonzero(near.any(axis=1))
        if len(linked):
            own = near[np.ix_(linked, linked)] & ~_common_before([filters[k] for k in linked], key[1])
            counts = own @ np.array(ns, np.int64)[linked]
            out += [(ids[k], None, int(c)) for k, c in zip(linked, counts, strict=True) if c]
        return out

    def result(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["cid", "other", "links"])

    held: list[tuple] = []
    key: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("dims", "number", "i", "j")])
        lists = batch.column("filters")
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        rows = list(zip(*(batch.column(n).to_pylist() for n in ("cid", "n", "part", "data")), [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
        edges = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
        found: list[tuple] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (now := keys[a].tolist()) != key:
                if len(held) > 1:
                    found += cell(key, held)
                held, key = [], now
            held = held + rows[a:b]
        if found:
            yield result(found)
    if len(held) > 1 and (found := cell(key, held)):
        yield result(found)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """id, n_links, component (smallest id reachable by links), kept."""
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    narrow = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, width = ("float", "<f4") if narrow else ("double", "<f8")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, F.transform(v, lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(kind))).alias("v"))
    classes = common.cut(
        rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()),
        "vectors",
    )
    words = words_for(classes.count())
    decoded = common.cut(classes.select("cid", "n", "v").mapInArrow(_decoding(words, width), "cid long, n long, dims int, data binary, filters array<int>"), "filters")
    entries = decoded.select("cid", "n", "dims", "data", "filters", F.explode("filters").alias("number"))
    hot = common.cut(decoded.select("dims", F.explode("filters").alias("number")).groupBy("dims", "number").count().filter("count > 1").select("dims", "number", F.ceil(F.col("count") / cell).alias("parts")), "full-filters")
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")))
    # Filters with a single vector end here.
    dealt = entries.join(hot, ["dims", "number"]).select("dims", "number", part.alias("part"), "cid", "n", "data", "filters", F.explode(cells).alias("c")).select("dims", "number", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "part", "cid", "n", "data", "filters")
    found = common.cut(dealt.repartition("dims", "number", "i", "j").sortWithinPartitions("dims", "number", "i", "j").mapInArrow(lambda batches: _compared(batches, width), "cid long, other long, links long"), "links")
    common.forget(decoded, hot)
    links = found.filter("links is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
    named = classes.join(groups, "cid", "left").withColumn("group", F.coalesce("component", "cid")).drop("component")
    best = named.groupBy("group").agg(F.min("least").alias("component"))
    named = named.join(best, "group").join(links, "cid", "left").select("v", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.join(named, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))
