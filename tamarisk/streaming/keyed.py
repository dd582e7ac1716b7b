"""The memory as keyed state: stores and look-ups of a stream, in the order they arrive.

Each block is one state, in RocksDB, under its content's id: text, words, when it was
first stored, and how often it was met since. A store of a known block and a look-up
that finds it both count as an access; a look-up of an unknown block leaves no trace.
Every event gives one row, so callers see what each of them found.

Events of one block meet in one task, as narrow rows: places, kinds and times. Texts
go along with stores alone, and a task keeps one of them. Results of a batch are a
table of their own that a batch run again overwrites, and the state comes back with
the checkpoint, so a restart neither loses nor counts anything twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamarisk.functions.text import word_count
from tamarisk.operators.memory import block_id

#: Times are microseconds since 1970, which no session's time zone changes.
STATE = "text string, token_count int, created_at long, access_count long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _memory(order: list[str]) -> StatefulProcessor:
    """Made here, so that it goes to the workers whole and they need no package."""
    found = Row(*order, "block_id", "is_store", "found", "access_count", "created_at")

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.block = handle.getValueState("block", STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
            events, first = [], None
            for r in rows:
                place = tuple(r[c] for c in order)
                if r["is_store"] and (first is None or place < first[0]):
                    first = place, (r["text"], r["token_count"], r["at"])
                events.append((place, r["is_store"]))
            events.sort()
            held = self.block.get()
            if held is not None:
                (*block, met), known = held, True
            else:
                block, met, known = first and first[1], -1, False  # the first store is no access
            for place, is_store in events:
                known = known or is_store
                met += known
                yield found(*place, key[0], is_store, met > 0, met if known else None, block[2] if known else None)
            if known:
                self.block.update((*block, met))

        def close(self) -> None:
            pass

    return Memory()


def events(df: DataFrame, order: list[str], is_store: str = "is_store", text: str = "text", at: str | None = None) -> DataFrame:
    """order, block_id, is_store, text (of stores), token_count, at. at: when the event
    came; by default the time its batch runs at."""
    stores = F.coalesce(F.col(is_store), F.lit(False))
    when = F.col(at).cast("timestamp") if at else F.current_timestamp()
    return df.select(*order, block_id(F.col(text)).alias("block_id"), stores.alias("is_store"), F.when(stores, F.col(text)).alias("text"), F.when(stores, word_count(F.col(text))).otherwise(0).alias("token_count"), F.unix_micros(when).alias("at"))


def remember(stream: DataFrame, order: list[str]) -> DataFrame:
    """order, block_id, is_store, found, access_count (after the event; null for a
    block not in memory), created_at. stream: `events`; order tells its rows apart and is
    never null."""
    places = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in order)
    found = stream.groupBy("block_id").transformWithState(_memory(order), f"{places}, block_id string, is_store boolean, found boolean, access_count long, created_at long", "Append", "None")
    return found.withColumn("created_at", F.timestamp_micros("created_at"))


def run(stream: DataFrame, order: list[str], path: str, checkpoint: str) -> None:
    """Takes all that the stream of events has now; results go to a table of each batch
    below `path`, the memory to the checkpoint."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = remember(stream, order).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def results(spark: SparkSession, path: str) -> DataFrame:
    """What every event found, of all batches."""
    return spark.read.parquet(path).drop("batch")


def stored(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The memory that a checkpoint holds: block_id, text, token_count, created_at,
    access_count; a store for `operators.memory`."""
    state = spark.read.format("statestore").option("stateVarName", "block").load(checkpoint)
    return state.select(F.col("key.block_id").alias("block_id"), "value.*").withColumn("created_at", F.timestamp_micros("created_at"))
