"""Compression of requests with a memory of spans that outlives a batch.

Each micro-batch holds whole requests. Its long spans are looked up in the store that
the batches before left, and among each other; then they go to the store as one table
named by the batch (`streaming.memory`). A batch reads the store as the batch before
it left it, whatever came after, and overwrites its own tables: one that runs again
gives the same spans and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarisk.config import QuenchConfig
from tamarisk.operators import chat
from tamarisk.streaming import memory

ORDER = ["msg", "block"]


def compress_batch(path: str, keys: list[str], plan: Callable[[DataFrame], DataFrame], config: QuenchConfig | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. plan: from a batch's requests to their spans
    (`operators.chat.plan_spans`). Spans come in the order of keys, msg and block."""
    add = memory.merge_batch(f"{path}/store", [*keys, *ORDER])

    def compress(requests: DataFrame, batch: int) -> None:
        spans = plan(requests)
        before = memory.read(requests.sparkSession, f"{path}/store", batch - 1)
        chat.compress_spans(spans, keys, config, memory=True, matching_ids=True, store=before).write.mode("overwrite").parquet(f"{path}/spans/batch={batch}")
        add(chat.long_spans(spans, config), batch)

    return compress


def run(requests: DataFrame, path: str, checkpoint: str, keys: list[str], plan: Callable[[DataFrame], DataFrame], config: QuenchConfig | None = None) -> None:
    """Takes all that the stream has now."""
    query = requests.writeStream.foreachBatch(compress_batch(path, keys, plan, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, path: str) -> DataFrame:
    """The compressed spans of all batches."""
    return spark.read.parquet(f"{path}/spans").drop("batch")
