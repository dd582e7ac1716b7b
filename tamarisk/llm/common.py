"""Helpers shared by the operators: tables, shared storage and Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.sources import storage
from tamarisk.sources.storage import new_path

#: Words are runs of anything but space, tab, line feed, VT, FF and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Tasks that a list of files is dealt to, at most.
MOST_TASKS = 20_000
#: pyarrow's names for what Spark calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Also lets Python workers on this machine find the package; a cluster gets
    it by --py-files or an installed wheel."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: later steps neither
    compute it anew nor depend on the executors that made it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_at = path
    for made in _PASSING.get():
        made.append(path)
    return out


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """`cut` of what `make` gives; the tables made on its way are deleted."""
    path = new_path(spark, label)
    with passing(spark):
        df = make()
        df.write.parquet(path)
    return _written(df, path)


#: Lists of the work that is going on in this thread.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes what `cut` wrote inside, for work whose result is written inside too."""
    made: list[str] = []
    token = _PASSING.set((*_PASSING.get(), made))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in made:
            storage.delete(spark, path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, once all that is made of them is written."""
    for df in tables:
        storage.delete(df.sparkSession, df.cut_at)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """`df` with a key for each row that every reading gives again: the file and
    the place in it. Rows that come from no Parquet file are written first."""
    place = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit("-"), F.col("_metadata.row_index")).alias(name)
    try:
        return df.select(*df.columns, place)
    except AnalysisException:
        return cut(df, "rows").select(*df.columns, place)


def release() -> None:
    """Gives what a worker has freed back to the system, where it can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a path with its scheme (`storage.qualified`), any store that pyarrow
    reaches (file, hdfs, s3, gs, abfs); used inside tasks."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def write_bytes(path: str, data: bytes | list[bytes]) -> None:
    """One file in one go. Names are unique for each attempt of a task, so a
    second attempt never meets what a lost one left."""
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)


def read_bytes(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer partitions than the session has cores is dealt to
    as many, so that no core is idle; a larger one stays as it lies."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if plan.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df  # it shuffles anyway
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def dealt(listed: DataFrame) -> DataFrame:
    """A list of files over tasks: one each while they are few, else several, so
    their number stays one that a driver can keep up with."""
    files = listed.count()
    return listed.repartition(max(1, min(files, MOST_TASKS)))


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def text_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def crc_of_id(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def apart(given: list[str], added: tuple[str, ...] | list[str]) -> dict[str, str]:
    """New names for the given columns: those that an added column bears, whatever
    the case, get `_given` behind, as often as needed."""
    names: dict[str, str] = {}
    taken = {c.lower() for c in [*given, *added]}
    for c in given:
        new = c
        while new.lower() in ({a.lower() for a in added} if new == c else taken):
            new += "_given"
        taken.add(new.lower())
        names[c] = new
    return names


def renamed(df: DataFrame, added: tuple[str, ...] | list[str]) -> DataFrame:
    """`df` with such columns renamed."""
    return df.select(*[F.col(c).alias(new) for c, new in apart(df.columns, added).items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
