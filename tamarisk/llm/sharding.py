"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, id, their place in the table). A
size-weighted sample of those keys gives quantile boundaries, which cut the order
to `PER_SHARD` ranges a shard, more where a range would pass `RANGE_ROWS`. A range
that turns out to hold over `OVERFULL` times its due is subdivided at boundaries
from a sample of its own, all such ranges in one job, again until none is left but
single records; where records are few, all of them are the sample.

A text whose records have several boundaries gets ranges of its own. Such texts, and
single records of a range's size, are dealt to shards first: the largest first, each
to the shard that holds least. A text stays in one shard unless it doesn't fit there:
then its ranges, cut by id and by place where even the ids are equal, fill up shards
like all others. So a text, or a repeated row, that a third of all rows share lies in
as many shards as it needs, and one below a shard's due in one, as long as there is a
shard to take it. What the large texts leave of each shard is filled with runs of the
other ranges: a range goes where its middle lies. The law is `bytes`: a shard is off
by about a range, or by a record that is longer.

Everything is DataFrame functions, and nothing but totals comes to the driver.
Boundaries are a table. A record meets them through the first bits of its hash: that
table of `CELLS` rows, with all boundaries in it, is what is broadcast: three numbers
for each range, of which there are `MOST_RANGES` at most (2 * 10^12 records; more are
an error). Samples of the first round are sorted in one task: `SAMPLES` keys for each
range, or all records where they are fewer than `FEW`. Large texts are fewer than
shards times `PER_SHARD`; they are dealt in one row.

A null text has no bytes and comes before all others; null ids come first among
equal texts. Very long texts are records like any: no record is split. An empty
table gives no row. A carried column with the name of an added one is renamed
(`common.apart`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import common

SHARDS = 24
PER_SHARD = 64
#: Records in a range, at most about, and samples for each range.
RANGE_ROWS = 2_000_000
SAMPLES = 32
#: Where there are fewer records for each range to be made, all are the sample.
FEW = 128
MOST_RANGES = 1_000_000
OVERFULL = 2.0
OVERHEAD = 8
HASH_BITS, CELL_BITS = 60, 12
CELLS = 1 << CELL_BITS
LOWEST = -(1 << 63)
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _group(text: Column) -> Column:
    """The first bits of the text's MD5."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"), F.lit(-1).cast("long"))


def _records(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """row (the carried columns), size, crc, key (group, id, nth)."""
    text = F.col(text_col)
    number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    place = F.col(id_col).cast("long") if number else F.xxhash64(id_col)
    key = F.struct(_group(text).alias("group"), F.coalesce(F.when(F.col(id_col).isNotNull(), place), F.lit(LOWEST)).alias("id"), F.monotonically_increasing_id().alias("nth"))
    rows = docs.select(F.struct(*carry).alias("row"), (common.text_bytes(text) + OVERHEAD).alias("size"), F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("crc"), key.alias("key"))
    return common.cut(rows, "records")  # written, so a place is the same at each reading


def _cell(group: Column) -> Column:
    return F.shiftright(group, HASH_BITS - CELL_BITS)


def ranged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds range: how many boundaries are at or below the key. bounds: at (a key)."""
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows
    own = bounds.groupBy(_cell(F.col("at.group")).alias("cell")).agg(F.array_sort(F.collect_list("at")).alias("own"))
    cells = rows.sparkSession.range(-1, CELLS).select(F.col("id").alias("cell")).join(own, "cell", "left")
    cells = cells.select("cell", "own", F.coalesce(F.size("own"), F.lit(0)).alias("many")).select("cell", "own", "many", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))

    def step(found: Column, k: Column) -> Column:
        more = found + F.call_function("shiftleft", F.lit(1), k)
        return F.when((more <= F.col("many")) & (F.get("own", more - 1) <= F.col("key")), more).otherwise(found)

    halves = F.sequence(F.floor(F.log2(F.greatest("many", F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
    inside = F.when(F.col("many") == 0, 0).otherwise(F.aggregate(halves, F.lit(0), step))
    met = rows.withColumn("cell", _cell(F.col("key.group"))).join(F.broadcast(cells), "cell")
    return met.select(*rows.columns, (F.col("first") + inside).alias("range"))


def _sampled(rows: DataFrame, density: float) -> DataFrame:
    """Size-weighted draws of rows (key, size, n, parts, ...) with their weight: the
    bytes that each stands for. Of few rows all are drawn."""
    draw = F.xxhash64("key", F.lit("draw")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    few = F.col("n") <= FEW * F.col("parts")
    weight = F.when(few, F.col("size").cast("double")).otherwise(F.greatest(F.col("size"), F.lit(1 / density)))
    return rows.filter(few | (draw < F.col("size") * density)).select("key", "range", "parts", "low", "high", weight.alias("weight"))


def _picked(sample: DataFrame) -> DataFrame:
    """at: boundaries that cut each range's sample (key, range, parts, low, high,
    weight) to its parts. One within a text's records moves to their beginning or, at
    the range's first text, behind them, unless the text has several boundaries or
    fills the range: then it gets ranges of its own."""
    own = Window.partitionBy("range")
    rows = sample.withColumns({"k": F.row_number().over(own.orderBy("key")), "all": F.sum("weight").over(own)})
    before = F.sum("weight").over(own.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("part", F.floor(F.coalesce(before, F.lit(0.0)) * F.col("parts") / F.col("all")))
    rows = rows.withColumn("last", F.lag("part").over(own.orderBy("key")))
    rows = rows.filter((F.col("k") > 1) & ((F.col("part") > F.col("last")) | (F.col("weight") * F.col("parts") >= F.col("all"))))
    group, lowest = F.col("key.group"), F.lit(LOWEST)
    rows = rows.withColumn("within", F.count("*").over(Window.partitionBy("range", "key.group")))
    edge = lambda g: F.struct(g.alias("group"), lowest.alias("id"), lowest.alias("nth"))
    inside = F.array(F.col("key"), edge(group), edge(group + 1))
    outside = F.array(edge(F.when(group == F.col("low"), group + 1).otherwise(group)))
    return rows.select(F.explode(F.when((F.col("within") > 1) | (F.col("low") == F.col("high")), inside).otherwise(outside)).alias("at")).distinct()


def _settled(records: DataFrame, shards: int, range_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The boundaries, the ranges between them (range, bytes, n, low, high), both
    written, and all bytes. records: size, key; written."""
    group = F.col("key.group")
    n, total, low, high = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.min(group), F.max(group)).first()
    ranges = max(PER_SHARD * shards, -(-n // range_rows))
    if ranges > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges")
    due = max(1.0, total / ranges)
    density = SAMPLES / due
    whole = {"range": F.lit(0), "n": F.lit(n), "parts": F.lit(ranges), "low": F.lit(low).cast("long"), "high": F.lit(high).cast("long")}
    bounds = common.cut(_picked(_sampled(records.withColumns(whole), density)), "bounds")
    while True:
        met = ranged(records, bounds)
        sums = common.cut(met.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(group).alias("low"), F.max(group).alias("high")), "ranges")
        over = sums.filter((F.col("bytes") > OVERFULL * due) & (F.col("n") > 1)).select("range", "n", F.ceil(F.col("bytes") / due).alias("parts"), "low", "high")
        if over.isEmpty():
            return bounds, sums, total
        # Denser each time; in the end all records of a range are its sample.
        density *= 4
        inside = _sampled(met.join(F.broadcast(over), "range"), density)
        before, bounds = bounds, common.cut(bounds.union(_picked(inside)).distinct(), "bounds")
        common.forget(before, sums)


def splitters(records: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """at: the boundaries' keys, in no order. records: size, key; written."""
    bounds, sums, _ = _settled(records, shards, range_rows)
    common.forget(sums)
    return bounds


def homes(sums: DataFrame, total: int, shards: int) -> DataFrame:
    """range, shard, first (the slot of its first record). sums: see `_settled`."""
    due = max(1.0, total / shards)
    alone = F.when(F.col("low") == F.col("high"), F.col("low"))
    texts = sums.groupBy(alone.alias("text")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).filter((F.col("text").isNotNull()) & (F.col("bytes") > due / PER_SHARD))

    def deal(state: Column, one: Column) -> Column:
        loads = state["loads"]
        least = F.array_position(loads, F.array_min(loads)).cast("int")
        fits = (F.array_min(loads) - one["less"] <= due) | (one["n"] == 1)
        added = F.transform(loads, lambda x, k: F.when(k + 1 == least, x - one["less"]).otherwise(x))
        home = F.struct(one["text"].alias("text"), (least - 1).alias("home"))
        return F.struct(F.when(fits, added).otherwise(loads).alias("loads"), F.when(fits, F.concat(state["homes"], F.array(home))).otherwise(state["homes"]).alias("homes"))

    largest = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "text", "n")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<text:long,home:int>>").alias("homes"))
    # Written: one row, read twice below.
    dealt = common.cut(texts.agg(F.aggregate(largest, start, deal).alias("d")).select("d.*"), "homes")
    # One short row for each range.
    before = Window.partitionBy("loose").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    loose = Window.partitionBy("loose")
    rows = sums.withColumn("text", alone).join(F.broadcast(dealt.select(F.inline("homes"))), "text", "left").withColumn("loose", F.col("home").isNull())
    rows = rows.withColumns({"done": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "all": F.sum("bytes").over(loose)})
    # What is left of the shards, added up, and stretched to what is to be dealt.
    left = F.transform("loads", lambda x: F.greatest(F.lit(0.0), F.lit(due) - x))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("left", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    ends = dealt.select(left.alias("left")).select(ends.alias("ends")).scalar()
    middle = (F.col("done") + F.col("bytes") / 2) / F.col("all")
    rows = rows.withColumn("ends", ends)
    run = F.size(F.filter("ends", lambda e: e <= middle * F.element_at("ends", -1)))
    rows = rows.withColumn("shard", F.coalesce("home", F.least(F.lit(shards - 1), run)).cast("int"))
    within = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("range", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("first"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The columns `carry` (only the id) with size, text_crc32, law, shard, slot,
    grown_shard."""
    carry = [id_col] if carry is None else carry
    records = _records(docs, id_col, text_col, carry)
    bounds, sums, total = _settled(records.select("size", "key"), shards, range_rows)
    met, firsts = ranged(records, bounds), homes(sums, total, shards)
    nth = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    placed = met.withColumn("nth", nth).join(F.broadcast(firsts), "range")
    names = common.apart(carry, ADDED)
    return placed.select(
        *[F.col("row")[c].alias(names[c]) for c in carry], "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
