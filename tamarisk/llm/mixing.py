"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a shuffled order of their own, are cut to blocks of
`BLOCK_BYTES`, or larger ones where the corpus would have over `MOST_BLOCKS`. A
document belongs to the block in which it begins, so one longer than a block adds its
length to what a source may be off by. The k-th block of a source with weight w (of all weights' sum)
is released at slot floor(k / w) and due by slot ceil((k + 1) / w); each slot
takes, of the blocks released, the one due first. Such a schedule meets every
deadline, so after any number of slots each source is within one block of its
target, however long the mix. Weights enter as whole parts of `SHARES`, so what
rounding adds is below one block in a million millions of slots.

Each slot depends on those before it. One task walks through them and writes a
short row for each block used, a batch of `PERIOD` at a time; it holds a number for
each source. All that is done with documents is spread.

The mix ends when every source has been used whole. A source that is used up
earlier starts again (`epoch` counts), so no document is lost and the shares hold
to the end; `stop="first"` ends the mix where the first source is used up. Weights
under which the mix would be over `most_times` the corpus are an error.

A block's number needs the bytes before a document within its source. Documents
are dealt to `(source, part)` by a hash of id, text and place in the table, parts'
totals are summed, and each part sums its own documents, so a source, an id or a
repeated row with a third of all rows is spread like any. The uses of a block are
gathered `USES` at a time: where weights make a small source come round more often,
its documents are dealt to a task for each such lot.

Null sources are a source of their own. Null and empty texts count as one byte; rows
come by a hash of id and text within a part. A source without a weight, or with
weight 0, is left out if weights are given. Repeated rows are each a document. A
given column with the name of an added one is renamed (`common.apart`). An empty
table gives no row.
"""

from __future__ import annotations

import heapq
import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import common

BLOCK_BYTES, MOST_BLOCKS = 64 << 10, 4_000_000
#: The mix's length over the corpus's, at most.
MOST_TIMES = 1000
#: Slots of the schedule written at once.
PERIOD = 4096
SHARES = 1 << 40
#: Default weights: a source's bytes to this power.
TEMPERATURE = 0.7
#: Documents in a part, about.
PART_ROWS = 5_000
#: Uses of a block that are gathered in one row.
USES = 1_000
MOST_SOURCES = 100_000
ADDED = ("mix_slot", "mix_epoch", "mix_block", "mix_release", "mix_deadline", "mix_place")


def slots_of(weights: dict, period: int = PERIOD) -> dict:
    """Whole slots for each source: at least one, period in all."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return {}
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(slots, key=lambda s: (slots[s] - exact[s], s is not None, str(s)))
    k = 0
    while (over := sum(slots.values()) - period) != 0:
        s = order[k % len(order)] if over < 0 else max(slots, key=lambda s: (slots[s] - exact[s] if slots[s] > 1 else -period, str(s)))
        slots[s] += 1 if over < 0 else -1
        k += 1
    return slots


def schedule(slots: dict, length: int | None = None) -> Iterator[tuple]:
    """(source, k, slot, release, deadline) of the first `length` slots (one
    period). slots: each source's share, in whole numbers of any size."""
    period = sum(slots.values())
    names = sorted(slots, key=lambda s: (s is not None, str(s)))
    shares = [slots[s] for s in names]
    waiting, ready = [(0, n, 0) for n in range(len(names))], []
    for slot in range(period if length is None else length):
        while waiting and waiting[0][0] <= slot:
            release, n, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[n]), n, k, release))
        deadline, n, k, release = heapq.heappop(ready)
        yield names[n], k, slot, release, deadline
        heapq.heappush(waiting, ((k + 1) * period // shares[n], n, k + 1))


def plan(slots: dict, blocks: dict, stop: str = "all") -> Iterator[tuple]:
    """The schedule up to where every source (the first) would start again."""
    left = dict(blocks)
    for one in schedule(slots, sys.maxsize) if slots else ():
        if left.get(one[0]) == one[1]:
            del left[one[0]]
            if not left or stop != "all":
                return
        yield one


def natural_weights(totals: dict, temperature: float = TEMPERATURE) -> dict:
    return {s: float(max(1, b)) ** temperature for s, b in totals.items()}


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, period: int = PERIOD, stop: str = "all", most_times: float = MOST_TIMES, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all) of each use of a document, with mix_slot,
    mix_epoch, mix_block, mix_release, mix_deadline. Rows in the order of
    (mix_slot, mix_place) are the mix."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    size = F.greatest(common.text_bytes(F.col(text_col)), F.lit(1))
    # Never null, so windows and the join below deal by the same key.
    named = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    place = common.fresh(docs, "row_place")
    docs = common.keyed(docs, place)
    spot = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("mix"))
    rows = docs.select(F.struct(*carry).alias("row"), F.col(source_col).alias("source"), named.alias("name"), size.alias("size"), spot.alias("spot"), F.xxhash64(spot, F.col(place)).alias("own_spot"))
    found = rows.groupBy("source", "name").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = natural_weights({r.source: r.bytes for r in found}) if weights is None else weights
    # By name, in which null is a text too.
    slots = slots_of({r.name: weights[r.source] for r in found if r.source in weights}, SHARES)
    block_bytes = block_bytes or max(BLOCK_BYTES, -(-sum(r.bytes for r in found) // MOST_BLOCKS))
    blocks = {r.name: -(-r.bytes // block_bytes) for r in found if r.name in slots}
    ends = sorted(n * SHARES / slots[s] for s, n in blocks.items() if slots[s])
    if ends and (ends[-1] if stop == "all" else ends[0]) > most_times * sum(blocks.values()) + len(blocks):
        raise ValueError(f"by these weights the mix is over {most_times} times the corpus")

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot = plan(slots, blocks, stop)
                while some := list(itertools.islice(slot, period)):
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), *(pa.array([x[k] for x in some], pa.int64()) for k in range(1, 5))], names=["name", "turn", "mix_slot", "mix_release", "mix_deadline"])

    table = common.cut(spark.range(0, 1, 1, 1).mapInArrow(planned, "name string, turn long, mix_slot long, mix_release long, mix_deadline long"), "schedule")

    parts = max(1, -(-sum(r.n for r in found) // PART_ROWS))
    rows = rows.withColumn("part", F.pmod("own_spot", F.lit(parts)))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One short row for each source and part.
    firsts = rows.groupBy("name", "part").agg(F.sum("size").alias("bytes")).select("name", "part", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first"))
    # A row for each source.
    length = (ends[-1] if stop == "all" else ends[0]) if ends else 0
    lots = {s: int(length * slots[s] / SHARES / n / USES) + 2 for s, n in blocks.items() if n}  # one more than enough, for rounding
    many = max(lots.values(), default=0) > 2
    sources = spark.createDataFrame([(s, n, lots.get(s, 1)) for s, n in blocks.items()], "name string, t_blocks long, t_lots long")
    lot = F.floor(F.col("use.mix_epoch") / USES) if many else F.lit(0).cast("long")
    uses = table.join(F.broadcast(sources), "name").select("name", (F.col("turn") % F.col("t_blocks")).alias("block"), F.struct(F.floor(F.col("turn") / F.col("t_blocks")).alias("mix_epoch"), "mix_slot", "mix_release", "mix_deadline").alias("use"))
    # The uses of each part's blocks: documents need not move to meet the schedule.
    firsts = (
        firsts.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_bytes), F.floor((F.col("first") + F.col("bytes") - 1) / block_bytes))))
        .join(uses.withColumn("lot", lot), ["name", "block"])
        .groupBy("name", "part", "lot", "first", "block").agg(F.collect_list("use").alias("uses"))
        .groupBy("name", "part", "lot", "first").agg(F.map_from_entries(F.collect_list(F.struct("block", "uses"))).alias("by_block"))
    )
    within = Window.partitionBy("name", "part").orderBy("spot", "own_spot").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    if many:  # else a document needs no lot, and stays where its part is
        placed = placed.join(F.broadcast(sources), "name").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_lots") - 1)))
    placed = placed.join(firsts, ["name", "part", "lot"] if many else ["name", "part"])
    at = F.col("first") + F.col("own")
    number = F.floor(at / block_bytes)
    used = placed.select("row", at.alias("mix_place"), number.alias("mix_block"), F.explode(F.try_element_at("by_block", number)).alias("use"))
    names = common.apart(carry, ADDED)
    return used.select(*[F.col("row")[c].alias(names[c]) for c in carry], "use.mix_slot", "use.mix_epoch", "mix_block", "use.mix_release", "use.mix_deadline", "mix_place")
