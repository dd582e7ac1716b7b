"""Repeated blocks of a text: found by the hash of their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions.arrays import scan
from tamarisk.functions.text import WS, bound, content_hash, normalize, word_count

MIN_BLOCK_CHARS = 80


def blocks(text: Column, min_chars: int = MIN_BLOCK_CHARS) -> Column:
    """Paragraphs; short ones are joined until they are long enough, or until a
    long one or the end follows."""
    none = F.lit(None).cast("string")

    def step(held: Column, block: Column) -> tuple[Column, Column]:
        merged = F.when(held.isNull(), block).otherwise(F.concat_ws("\n\n", held, block))
        short = F.length(block) < min_chars
        full = short & (F.length(merged) >= min_chars)
        done = F.when(full, F.array(merged)).when(short, F.array().cast("array<string>")).when(held.isNull(), F.array(block)).otherwise(F.array(held, block))
        return F.when(short & ~full, merged), done

    found = scan(F.split(text, rf"\n[{WS}]*\n", -1), none, step, "array<string>")
    return bound(found, lambda s: F.when(s["carry"].isNull(), s["outs"]).otherwise(F.concat(s["outs"], F.array(s["carry"]))))


def block_rows(df: DataFrame, keys: list[str], text: str = "text", min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """keys, n_blocks, pos, block, normal, hash, first, nth (1 for the first of its
    kind)."""
    cut = df.select(*keys, blocks(F.col(text), min_chars).alias("__b"))
    sized = cut.select(*keys, "__b", F.size("__b").alias("n_blocks"))
    rows = sized.select(*keys, "n_blocks", F.posexplode_outer("__b").alias("pos", "block")).filter("pos is not null")
    rows = rows.withColumn("normal", normalize(F.col("block"))).withColumn("hash", content_hash(F.col("block"), 16))
    kind = Window.partitionBy(*keys, "hash")
    return rows.withColumn("first", F.min("pos").over(kind)).withColumn("nth", F.row_number().over(kind.orderBy("pos")))


def reference(first: Column) -> Column:
    return F.concat(F.lit("[↳ see block "), first.cast("string"), F.lit("]"))


def first_places(items: Column) -> Column:
    """For each item the place, from 0, of the first that equals it."""
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def step(carry: Column, item: Column) -> tuple[Column, Column]:
        first = F.when(carry["x"] == item["x"], carry["i"]).otherwise(item["i"])
        return F.struct(item["x"].alias("x"), first.alias("i")), F.array(F.struct(item["i"].alias("i"), first.alias("first")))

    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(None).cast("int").alias("i"))
    return F.transform(F.array_sort(scan(placed, start, step, "array<struct<i:int,first:int>>")["outs"]), lambda o: o["first"])


def dedup_text(text: Column, min_chars: int = MIN_BLOCK_CHARS) -> Column:
    """The text with repeats referred to, as one expression: for short texts, such
    as a message's; `dedup` explodes blocks instead."""

    def shown(own: Column) -> Column:
        one = lambda first: lambda b, i: F.when(F.get(first, i) == i, b).otherwise(reference(F.get(first, i)))
        joined = bound(first_places(own), lambda first: F.array_join(F.transform(own, one(first)), "\n\n"))
        return F.when(F.size(own) < 2, text).otherwise(joined)

    return bound(F.transform(blocks(text, min_chars), lambda b: normalize(b)), shown)


def dedup(df: DataFrame, keys: list[str], text: str = "text", min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """keys, deduplicated_text, blocks_removed, tokens_saved, n_blocks. A text of
    fewer than two blocks stays as it is."""
    rows = block_rows(df, keys, text, min_chars)
    again = F.col("nth") > 1
    shown = F.when(again, reference(F.col("first"))).otherwise(F.col("normal"))
    saved = F.when(again, word_count(F.col("normal")) - 4).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct("pos", shown.alias("s"), F.col("block").alias("b"))))
    return (
        rows.groupBy(*keys)
        .agg(listed.alias("__l"), F.sum(again.cast("long")).alias("r"), F.sum(saved).alias("s"), F.max("n_blocks").alias("n_blocks"))
        .select(
            *keys,
            F.when(F.col("n_blocks") < 2, F.col("__l")[0]["b"]).otherwise(F.array_join(F.transform("__l", lambda x: x["s"]), "\n\n")).alias("deduplicated_text"),
            F.when(F.col("n_blocks") < 2, 0).otherwise(F.col("r")).alias("blocks_removed"),
            F.when(F.col("n_blocks") < 2, 0).otherwise(F.col("s")).alias("tokens_saved"),
            "n_blocks",
        )
    )


def block_stats(df: DataFrame, keys: list[str], text: str = "text", min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """keys, hash, block (normal form), occurrences, indices; of texts with at
    least two blocks."""
    rows = block_rows(df, keys, text, min_chars).filter("n_blocks >= 2")
    return rows.groupBy(*keys, "hash").agg(F.min("normal").alias("block"), F.count("*").alias("occurrences"), F.array_sort(F.collect_list("pos")).alias("indices"))
