"""The memory across micro-batches of a stream of blocks.

Each micro-batch writes what it adds alone, as a Parquet table named by the batch:
each block once, with how often it came. So a batch costs what it holds, however
large the store is, and one that runs again after a failure writes the same. Every
`MERGED` batches the tables since the last merge and that merge are merged into one;
what the merge before took in is deleted. The store is the last merge and the tables
since, grouped by block: the first batch's text stays and accesses add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import memory
from tamarisk.sources import storage

MERGED = 16


def _merge_before(batch: int) -> int:
    """The last batch before this one after which tables were merged; -1 for none."""
    return batch // MERGED * MERGED - 1


def _store(spark: SparkSession, path: str, batch: int, merge: int) -> DataFrame:
    tables = [(merge, f"{path}/merge={merge}")] if merge >= 0 else []
    tables += [(b, f"{path}/batch={b}") for b in range(merge + 1, batch + 1)]
    rows = None
    for b, name in tables:  # MERGED + 1 at most
        own = spark.read.parquet(name).withColumn("b", F.lit(b))
        rows = own if rows is None else rows.unionByName(own)
    first = lambda c: F.min_by(c, "b").alias(c)
    return rows.groupBy("block_id").agg(first("text"), first("token_count"), (F.sum(F.col("access_count") + 1) - 1).alias("access_count"))


def merge_batch(path: str, order: list[str], text: str = "text"):
    """A function for foreachBatch."""

    def merge(blocks: DataFrame, batch: int) -> None:
        spark = blocks.sparkSession
        memory.store(blocks, order, text).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if (batch + 1) % MERGED == 0:
            before = _merge_before(batch)
            _store(spark, path, batch, before).write.mode("overwrite").parquet(f"{path}/merge={batch}")
            # What the merge before took in; a reader may still be at what this one did.
            for b in range(before - MERGED + 1, before + 1):
                storage.delete(spark, f"{path}/batch={b}")
            storage.delete(spark, f"{path}/merge={before - MERGED}")

    return merge


def last(spark: SparkSession, path: str) -> int:
    """The last batch in the store; -1 if it has none."""
    return max((int(name.removeprefix("batch=")) for name in storage.folders(spark, path) if name.startswith("batch=") and "_SUCCESS" in storage.folders(spark, f"{path}/{name}")), default=-1)


def run(blocks: DataFrame, path: str, checkpoint: str, order: list[str], text: str = "text") -> int:
    """Takes all that the stream has now; returns the last batch in the store."""
    query = blocks.writeStream.foreachBatch(merge_batch(path, order, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return last(blocks.sparkSession, path)


def read(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The store as the batch (the last one) left it: one of the last `MERGED`."""
    batch = last(spark, path) if batch is None else batch
    if batch < 0:
        return spark.createDataFrame([], "block_id string, text string, token_count int, access_count long")
    merged = "_SUCCESS" in storage.folders(spark, f"{path}/merge={batch}")
    return _store(spark, path, batch, batch if merged else _merge_before(batch))


def place(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return storage.new_path(spark, "memory")
