"""Language identification by the nearest centroid.

A text's letters, lower-cased, give byte 2- and 3-grams hashed to `DIMENSIONS`
counts; logarithmic counts weighted by inverse document frequency and divided by
their norm make its vector. Each language has up to `CENTROIDS` centroids, found
by spherical k-means, so a language whose texts fall into groups has one for each.
The nearest centroid by cosine names the language. A text whose best cosine lies
below its centroid's own limit is far from all that was learned and is rejected.

The classifier is fitted on every labelled row, repeats included. Rows become sparse
counts once, written; each round of the clustering reads them, names each row's
nearest centroid and adds rows up in its tasks. Tasks' sums are added `FAN` at a time,
so no task holds a language's rows. The rows that clusters start from and the limits
come from places in an order over the whole table (`ordering`). Vectors are added and
compared as whole numbers, so any order of rows gives the same model. The driver gets
the model: `DIMENSIONS` document counts, and `CENTROIDS` centroids a language.
Prediction reads whole texts, shuffles nothing, and takes nothing but the text.

Null texts and texts without a letter: `und`, score 0, rejected. With no labelled
text at all every text is `und`, and those with a letter are not rejected: they
are far from nothing learned. Equal cosines go to the language that sorts
first. Rows repeat as given and a very long text is one like any. All other columns
stay; one with the name of an added column is renamed (`common.apart`). An empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm import common
from tamarisk.llm.ordering import quantile, ranked_in_groups

DIMENSIONS = 1 << 14
CENTROIDS, ROUNDS = 3, 8
#: A vector's numbers are whole multiples of one over this.
SCALE = 1 << 24
#: Tasks' sums that are added in one place, and languages whose sums a task holds.
FAN, HELD = 64, 32
#: Languages that one classifier may tell apart.
LANGUAGES = 500
#: A text is rejected below this part of the cosine that all but one in a hundred
#: of its centroid's texts reach.
FAR = 0.25
UNKNOWN = "und"
#: Texts whose vectors a worker holds at once: dense, sparse.
LOT, SPARSE_LOT = 32, 128

_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str | None) -> np.ndarray | None:
    """Counts by hashed n-gram; None without a letter."""
    if not text:
        return None
    data = text.lower().encode().translate(_SPACED)
    if text.isascii():
        if not data.strip():
            return None
    elif not any(map(str.isalpha, set(text))):
        return None
    codes = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint32)
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + codes[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    hashed = np.concatenate([two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)]) >> shift
    return np.bincount(hashed, minlength=DIMENSIONS)


@dataclass
class Model:
    names: list[str]  # sorted
    owner: np.ndarray  # of each centroid: index in names
    idf: np.ndarray
    centroids: np.ndarray  # dimensions x centroids, unit length
    least: np.ndarray  # lowest accepted cosine of each centroid

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        found: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        rows = [(k, c) for k, t in enumerate(texts) if (c := counts(t)) is not None]
        if not self.names:
            for k, _ in rows:
                found[k] = (UNKNOWN, 0.0, False)
            return found
        if rows:
            cosines = _vectors(np.stack([c for _, c in rows]), self.idf) @ self.centroids
            for (k, _), own in zip(rows, cosines, strict=True):
                best = int(own.argmax())  # centroids are in the order of names
                found[k] = (self.names[self.owner[best]], float(min(1.0, max(0.0, own[best]))), bool(own[best] < self.least[best]))
        return found


def _vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(found.astype(np.float32)) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _clusters(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the middle rows of k equal parts in the order of their
    nearness to the mean, so no outlier starts a cluster; the same rows give the same
    centroids. What `fit` does with a table, for rows of one array."""
    mean = rows.mean(0)
    start = rows[np.argsort(rows @ mean, kind="stable")[(2 * np.arange(k) + 1) * len(rows) // (2 * k)]]
    for _ in range(rounds):
        own = (rows @ start.T).argmax(1)
        start = np.stack([rows[own == c].mean(0) if (own == c).any() else start[c] for c in range(k)])
        start /= np.maximum(np.linalg.norm(start, axis=1, keepdims=True), 1e-12)
    return start


#: Positions (two bytes each), counts (four) and a key of both.
_COUNTS = "lang string, at binary, n binary"
_SUMS = "lang string, c int, lot long, n long, sums binary"
_NEAR = "lang string, c int, near long, of long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (c := counts(t)) is not None for at in [np.flatnonzero(c)]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["lang", "at", "n"])
    common.release()


def _runs(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple]:
    """Rows of one language that lie together: it, each row's length, positions and
    vectors of all of them, keys."""
    for batch in batches:
        for first in range(0, batch.num_rows, SPARSE_LOT):
            some = batch.slice(first, SPARSE_LOT)
            ats, langs, keys = some.column(1).to_pylist(), some.column(0).to_pylist(), some.column(3).to_numpy(zero_copy_only=False)
            at = np.frombuffer(b"".join(ats), "<u2").astype(np.int64)
            sizes = np.array([len(x) // 2 for x in ats])
            ends = np.append(0, np.cumsum(sizes))
            values = np.log1p(np.frombuffer(b"".join(some.column(2).to_pylist()), "<u4").astype(float)) * idf[at]
            norms = np.sqrt(np.add.reduceat(values * values, ends[:-1]))
            vectors = np.rint(values * np.repeat(SCALE / norms, sizes)).astype(np.int64)
            edges = [0, *(k for k in range(1, len(langs)) if langs[k] != langs[k - 1]), len(langs)]
            for low, high in zip(edges, edges[1:], strict=False):
                own = slice(ends[low], ends[high])
                yield langs[low], sizes[low:high], at[own], vectors[own], keys[low:high]


def _cosines(sizes: np.ndarray, at: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each row with each centroid, in whole numbers: exact in any order."""
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.add.reduceat(vectors * c[at], starts) for c in centroids], 1)


def _sums(part: int, held: dict) -> pa.RecordBatch:
    rows = [(lang, c, part, int(n[c]), sums[c].tobytes()) for lang, (n, sums) in held.items() for c in range(len(n)) if n[c]]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["lang", "c", "lot", "n", "sums"])


def _added(partial: DataFrame, tasks: int) -> dict:
    """n and sums by language and cluster, of what tasks gave."""

    def add(own: pa.Table) -> pa.Table:
        total = np.zeros(DIMENSIONS, np.int64)
        for x in own["sums"]:
            total += np.frombuffer(x.as_py(), np.int64)
        return own.slice(0, 1).set_column(3, "n", pa.array([sum(own["n"].to_pylist())], pa.int64())).set_column(4, "sums", pa.array([total.tobytes()], pa.binary()))

    while True:
        tasks = -(-tasks // FAN)
        partial = partial.withColumn("lot", F.expr(f"lot div {FAN}")).groupBy("lang", "c", "lot").applyInArrow(add, _SUMS)
        if tasks <= 1:
            return {(r.lang, r.c): (r.n, np.frombuffer(r.sums, np.int64)) for r in partial.collect()}


def _unit(sums: np.ndarray) -> np.ndarray:
    found = sums.astype(float)
    return found / max(float(np.linalg.norm(found)), 1e-12)


def _whole(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit * SCALE).astype(np.int32)


def _bounded(known: DataFrame, id_col: str, sample: int) -> DataFrame:
    """The `sample` rows of each language that come first by a hash of id and text,
    equal rows once."""
    spot = F.xxhash64(F.col(id_col).cast("string"), F.col("text"), F.lit("fit"))
    few = known.withColumn("spot", spot).groupBy("lang", "spot").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("spot", F.lit(1 << 30)), "spot"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= sample)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = None) -> Model:
    """labelled: rows to learn from; those without a language or letter are left
    out. Its size doesn't matter to the driver. sample: so many rows of each language
    at most, for a quick look; none: all."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *([] if sample is None else [F.col(id_col).alias("id")]))
    known = (common.spread(known) if sample is None else _bounded(known, "id", sample)).select("lang", "text")
    with common.passing(labelled.sparkSession):
        return _fit(known)


def _fit(known: DataFrame) -> Model:
    spark = known.sparkSession
    # The languages of a file lie together, so a task sums few at a time.
    rows = common.cut(known.mapInArrow(_counted, _COUNTS).withColumn("of", F.xxhash64("at", "n")).sortWithinPartitions("lang", "of"), "language-counts", "zstd")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if len(sizes) > HELD:
        before, rows = rows, common.cut(rows.repartitionByRange("lang", "of").sortWithinPartitions("lang", "of"), "language-counts", "zstd")
        common.forget(before)
    if not sizes:
        return Model([], np.zeros(0, int), np.ones(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    tasks = rows.rdd.getNumPartitions()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for at in batch.column(1).to_pylist():
                found[np.frombuffer(at, "<u2")] += 1
            n += batch.num_rows
        yield _sums(TaskContext.get().partitionId(), {"": (np.array([n]), found[None])})

    n, found = _added(rows.mapInArrow(seen, _SUMS), tasks)["", 0]
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)

    def gathered(centroids: dict[str, np.ndarray]) -> dict:
        """n and sums of the rows that are nearest to each of a language's centroids."""
        shared = spark.sparkContext.broadcast(centroids)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, tuple] = {}
            part = TaskContext.get().partitionId()
            for lang, sizes, at, vectors, _ in _runs(batches, idf):
                own = shared.value[lang]
                k = len(own)
                best = _cosines(sizes, at, vectors, own).argmax(1) if k > 1 else np.zeros(len(sizes), int)
                if lang not in held:
                    if len(held) >= HELD:
                        yield _sums(part, held)
                        held = {}
                    held[lang] = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
                many, sums = held[lang]
                many += np.bincount(best, minlength=k)
                # Whole numbers below 2**53, so exact as doubles.
                sums += np.bincount(np.repeat(best, sizes) * DIMENSIONS + at, vectors, k * DIMENSIONS).astype(np.int64).reshape(k, -1)
            yield _sums(part, held)
            common.release()

        try:
            return _added(rows.mapInArrow(nearest, _SUMS), tasks)
        finally:
            shared.unpersist()

    def measured(centroids: dict[str, np.ndarray], shared: list) -> DataFrame:
        """Each row's nearest centroid and how near it is; a number spreads equal rows."""
        shared.append(spark.sparkContext.broadcast(centroids))
        known = shared[-1]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, sizes, at, vectors, keys in _runs(batches, idf):
                found = _cosines(sizes, at, vectors, known.value[lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sizes), pa.string()), pa.array(found.argmax(1), pa.int32()), pa.array(found.max(1)), pa.array(keys)], names=["lang", "c", "near", "of"])
            common.release()

        return common.cut(rows.mapInArrow(near, _NEAR).withColumn("nth", F.monotonically_increasing_id()), "language-near")

    shared: list = []
    none = np.zeros((1, DIMENSIONS), np.int32)
    means = {lang: _whole(_unit(sums))[None] for (lang, _), (_, sums) in gathered(dict.fromkeys(sizes, none)).items()}
    placed = ranked_in_groups(measured(means, shared).select("lang", "near", "of", "nth"), "lang", [F.col("near"), F.col("of"), F.col("nth")], "language-ranked")
    k = F.least(F.lit(CENTROIDS), F.col("group_rows"))
    middle = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda c: F.struct(c.alias("c"), F.floor((2 * c + 1) * F.col("group_rows") / (2 * k)).alias("rank"))))
    starts = placed.withColumn("start", middle).filter("rank = start.rank").select("lang", F.col("start.c").alias("c"), "of")
    starts = common.cut(starts, "language-starts")  # `CENTROIDS` rows a language
    vectors = rows.join(F.broadcast(starts.select("lang", "of").distinct()), ["lang", "of"], "left_semi").groupBy("lang", "of").agg(F.first("at").alias("at"), F.first("n").alias("n"))
    units: dict[str, np.ndarray] = {lang: np.zeros((min(CENTROIDS, many), DIMENSIONS)) for lang, many in sizes.items()}
    for r in starts.join(vectors, ["lang", "of"]).collect():
        at = np.frombuffer(r["at"], "<u2")
        units[r["lang"]][r["c"], at] = _unit(np.log1p(np.frombuffer(r["n"], "<u4").astype(float)) * idf[at])
    for _ in range(ROUNDS):
        before = {lang: _whole(own) for lang, own in units.items()}
        for (lang, c), (_, sums) in gathered(before).items():
            units[lang][c] = _unit(sums)
        if all((before[lang] == _whole(own)).all() for lang, own in units.items()):
            break  # another round would change nothing
    key = F.concat(F.col("c").cast("string"), F.lit(" "), "lang").alias("key")
    near = measured({lang: _whole(own) for lang, own in units.items()}, shared).select(key, (F.col("near") / float(SCALE * SCALE)).alias("value"), "of", "nth")
    limits = {r.key: r.value for r in quantile(ranked_in_groups(near, "key", [F.col("value"), F.col("of"), F.col("nth")], "language-ranked"), 0.01).collect()}
    for x in shared:
        x.unpersist()
    names = sorted(units)
    owner = np.repeat(np.arange(len(names)), [len(units[name]) for name in names])
    least = np.array([FAR * limits.get(f"{c} {name}", 0.0) for name in names for c in range(len(units[name]))])
    return Model(names, owner, idf, np.concatenate([units[name] for name in names]).T.astype(np.float32), least)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, score, rejected. Only the text goes to Python."""
    added = T._parse_datatype_string("lang_pred string, score double, rejected boolean")
    text_col, docs = common.apart(docs.columns, added.names)[text_col], common.renamed(docs, added.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(added)
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found: list[tuple] = []
            for at in range(0, len(texts), LOT):
                found += shared.value.predict(texts.slice(at, LOT).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=added.names)
        common.release()

    name, docs = common.fresh(docs, "predicted"), common.spread(docs)
    predicted = predicted.asNondeterministic()  # else a filter on the prediction makes it a second time
    return docs.withColumn(name, predicted(F.col(text_col))).select(*docs.columns, name + ".*")


def held_out(id_column: Column) -> Column:
    """One row in four, never learned from."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2
