"""A content-addressed memory: blocks seen before are counted, not kept again.

A store is a table block_id, text, token_count, access_count. Batches merge into it
by one grouped aggregate; the first text of an id, in arrival order, stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.config import QuenchConfig
from tamarisk.functions.text import content_hash, has_token, strip, word_count
from tamarisk.operators.energy import energies
from tamarisk.operators.lots import quench
from tamarisk.operators.quench import finish

ID_DIGITS = 20
REFERENCE_COST = 0.01
#: Words that novel content must exceed to be quenched.
LEAST_NOVEL = 10


def block_id(text: Column) -> Column:
    return content_hash(text, ID_DIGITS)


def store(blocks: DataFrame, order: list[str], text: str = "text", memory: DataFrame | None = None) -> DataFrame:
    """The store after the blocks have arrived in `order`: a new one enters with
    no access, each later one of its id counts as an access."""
    place = F.struct(*order)
    new = blocks.select(block_id(F.col(text)).alias("block_id"), F.col(text).alias("text"), place.alias("place")).groupBy("block_id").agg(F.min_by("text", "place").alias("text"), F.count("*").alias("n"))
    if memory is None:
        return new.select("block_id", "text", word_count(F.col("text")).alias("token_count"), (F.col("n") - 1).alias("access_count"))
    old = memory.select("block_id", F.col("text").alias("old"), F.col("token_count").alias("old_count"), F.col("access_count").alias("old_access"))
    both = old.join(new, "block_id", "full_outer")
    known = F.col("old_access").isNotNull()
    return both.select(
        "block_id", F.coalesce("old", "text").alias("text"), F.coalesce("old_count", word_count(F.col("text"))).alias("token_count"),
        F.when(known, F.col("old_access") + F.coalesce("n", F.lit(0))).otherwise(F.col("n") - 1).alias("access_count"),
    )


def lookup(blocks: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    """The blocks with found_id: the store's id, or null."""
    ids = memory.select(F.col("block_id").alias("found_id"))
    return blocks.join(ids, block_id(F.col(text)) == F.col("found_id"), "left")


def known(blocks: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    return blocks.join(memory.select("block_id"), block_id(F.col(text)) == F.col("block_id"), "left_semi")


def unknown(blocks: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    return blocks.join(memory.select("block_id"), block_id(F.col(text)) == F.col("block_id"), "left_anti")


def get(ids: DataFrame, memory: DataFrame) -> DataFrame:
    """ids: block_id. The blocks, without counting an access."""
    return ids.join(memory, "block_id")


def stats(memory: DataFrame) -> DataFrame:
    """blocks_stored, tokens_stored, total_accesses, hit_rate; zeros if empty."""
    blocks, accesses = F.count("*"), F.coalesce(F.sum("access_count"), F.lit(0))
    return memory.agg(
        blocks.alias("blocks_stored"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens_stored"), accesses.alias("total_accesses"),
        F.when(accesses + blocks > 0, accesses / (accesses + blocks)).otherwise(0.0).alias("hit_rate"),
    )


def request_blocks(messages: DataFrame, request: list[str], order: str, text: str = "text") -> DataFrame:
    """request, pos, block: a request's messages joined by a blank line, cut there
    again, blank blocks left out; if none is left, the whole text is one."""
    joined = messages.filter(F.col(text).isNotNull()).groupBy(*request).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: x["t"]), "\n\n").alias("__j"))
    parts = F.filter(F.split("__j", "\n\n", -1), lambda b: strip(b) != "")
    cut = joined.select(*request, "__j", parts.alias("__p")).select(*request, F.when(F.size("__p") > 0, F.col("__p")).otherwise(F.array("__j")).alias("__p"))
    return cut.select(*request, F.posexplode_outer("__p").alias("pos", "block"))


#: From texts (keys, text) to token rows, as `energy.energies` makes them: keys, idx,
#: token, n, frozen, energy.
EnergyFn = Callable[[DataFrame, list[str], str, QuenchConfig], DataFrame]
#: From token rows to one row for each of their keys, with tokens_kept.
QuenchFn = Callable[[DataFrame, list[str], QuenchConfig], DataFrame]


def estimated(texts: DataFrame, keys: list[str], text: str, config: QuenchConfig) -> DataFrame:
    return energies(texts, keys, text, config)


def _has(made: DataFrame, columns: list[str], what: str) -> None:
    if missing := [c for c in columns if c not in made.columns]:
        raise ValueError(f"{what} gave no column {', '.join(missing)}")


def checked_energies(made: DataFrame, keys: list[str]) -> DataFrame:
    """Token rows of an energy function. Each text must have n of them, with places 0
    to n - 1, a number as energy and frozen set: else reading them is an error."""
    _has(made, [*keys, "idx", "token", "n", "frozen", "energy"], "the energy function")
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.lag("idx").over(whole.orderBy("idx")), F.lit(-1))
    rows = made.withColumns({"__rows": F.count("*").over(whole), "__step": F.col("idx") - before})
    good = (F.col("__rows") == F.col("n")) & (F.col("__step") == 1) & F.col("energy").isNotNull() & ~F.isnan("energy") & F.col("frozen").isNotNull()
    fault = F.raise_error(F.lit("the energy function must keep each token of a text, once, with an energy")).cast("double")
    return rows.withColumn("energy", F.when(F.coalesce(good, F.lit(False)), F.col("energy").cast("double")).otherwise(fault)).drop("__rows", "__step")


def checked_quench(made: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens_kept of a quenching function. Each text must have one row, with a
    number, and no other key may: else reading them is an error."""
    _has(made, [*keys, "tokens_kept"], "the quenching function")
    own = made.groupBy(*keys).agg(F.count("*").alias("__rows"), F.max("tokens_kept").cast("long").alias("__kept"))
    given = texts.select(*keys).withColumn("__given", F.lit(True))
    good = (F.col("__rows") == 1) & F.col("__given") & (F.col("__kept") >= 0)
    fault = F.raise_error(F.lit("the quenching function must give each text one row with tokens_kept")).cast("long")
    joined = given.join(own, keys, "full_outer")
    return joined.select(*keys, F.when(F.coalesce(good, F.lit(False)), F.col("__kept")).otherwise(fault).alias("tokens_kept"))


def _kept(novel: DataFrame, request: list[str], config: QuenchConfig, quench_fn: QuenchFn | None, energy_fn: EnergyFn | None) -> DataFrame:
    """request, __kept of novel texts. A text without tokens keeps none and reaches no
    function."""
    if quench_fn is None and energy_fn is None:
        done = quench(novel, request, "__novel", config)
        return done.select(*request, F.col("tokens_kept").alias("__kept"))
    some = novel.filter(has_token(F.col("__novel")))
    rows = (energy_fn or estimated)(some, request, "__novel", config)
    if energy_fn is not None:
        rows = checked_energies(rows, request)
    if quench_fn is None:
        return finish(rows, novel, request, "__novel", config).select(*request, F.col("tokens_kept").alias("__kept"))
    done = checked_quench(quench_fn(rows, request, config), some, request).withColumnRenamed("tokens_kept", "__kept")
    return done.unionByName(novel.filter(~has_token(F.col("__novel"))).select(*request, F.lit(0).cast("long").alias("__kept")))


def compress(
    messages: DataFrame, request: list[str], order: str, text: str = "text", config: QuenchConfig | None = None, memory: DataFrame | None = None, shared: bool = False,
    quench_fn: QuenchFn | None = None, energy_fn: EnergyFn | None = None,
) -> DataFrame:
    """One row per request: what memory and quenching save.

    A block is repeated if the store has it or an earlier block has its content:
    earlier in the same request, or with `shared` in any request before (by the
    request's columns). Novel blocks over LEAST_NOVEL words are quenched together.
    Novel words are counted as words, what quenching keeps as tokens. quench_fn and
    energy_fn take the place of the library's own; what they give is checked."""
    config = config or QuenchConfig()
    rows = request_blocks(messages, request, order, text).withColumn("block_id", block_id(F.col("block"))).withColumn("words", word_count(F.col("block")))
    if shared:  # a block that many requests hold is summed up first and met by a join
        place = F.struct(*request, "pos")
        first = rows.groupBy("block_id").agg(F.min(place).alias("__first"))
        rows = rows.join(first, "block_id").withColumn("__seen", place != F.col("__first")).drop("__first")
    else:
        rows = rows.withColumn("__seen", F.row_number().over(Window.partitionBy(*request, "block_id").orderBy("pos")) > 1)
    if memory is not None:
        rows = rows.join(memory.select("block_id", F.lit(True).alias("__old")), "block_id", "left").withColumn("__seen", F.col("__seen") | F.coalesce("__old", F.lit(False)))
    novel = F.when(~F.col("__seen"), F.struct("pos", F.col("block").alias("b")))
    sums = rows.groupBy(*request).agg(F.sum("words").alias("total"), F.sum(F.when(F.col("__seen"), F.col("words")).otherwise(0)).alias("repeated"), F.array_join(F.transform(F.array_sort(F.collect_list(novel)), lambda x: x["b"]), "\n\n").alias("__novel"))
    sums = sums.withColumn("novel", F.col("total") - F.col("repeated"))
    quenched = _kept(sums.filter(F.col("novel") > LEAST_NOVEL), request, config, quench_fn, energy_fn)
    return bounds(sums.drop("__novel").join(quenched, request, "left").withColumn("after", F.coalesce("__kept", "novel")).withColumn("r_quench", F.when(F.col("__kept").isNull(), 0.0).otherwise(1.0 - F.col("__kept") / F.col("novel"))), request)


def remembered(messages: DataFrame, request: list[str], order: str, text: str = "text", memory: DataFrame | None = None) -> DataFrame:
    """The store after `compress` has seen the requests one after the other: novel
    blocks enter it, and each block found counts as an access."""
    return store(request_blocks(messages, request, order, text).filter(F.col("block").isNotNull()), [*request, "pos"], "block", memory)


def bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the reductions, from total, repeated, novel, after and r_quench."""
    cost = F.col("repeated") * REFERENCE_COST
    final = F.floor(cost + F.col("after")).cast("long")
    some = F.col("total") > 0
    r_mem = F.when(some, (F.col("repeated") - cost) / F.col("total")).otherwise(0.0)
    return rows.select(
        *keys, F.col("total").alias("tokens_original"), F.col("repeated").alias("tokens_repeated"), F.col("novel").alias("tokens_novel"), r_mem.alias("memory_reduction"),
        F.col("after").cast("long").alias("tokens_after_quench"), F.col("r_quench").alias("quench_reduction"), final.alias("tokens_final"),
        F.when(some, 1.0 - final / F.col("total")).otherwise(0.0).alias("total_reduction"), (1.0 - (1.0 - r_mem) * (1.0 - F.col("r_quench"))).alias("theoretical_bound"),
    )


def combined_reduction(p: Column, ratio: Column, cost: Column | float = REFERENCE_COST) -> Column:
    """The share saved if p of the content repeats and the rest shrinks by ratio."""
    return p * (1.0 - (cost if isinstance(cost, Column) else F.lit(cost))) + (1.0 - p) * ratio


def summary() -> Column:
    """A report in words, from the columns of `compress`."""
    share = lambda c: F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))
    # The report's wording.
    return F.concat_ws(
        "\n", F.lit("Memory-aware compression:"),
        F.format_string("  Original: %d tokens", "tokens_original"),
        F.concat(F.format_string("  Memory saved: %d tokens (R_mem = ", "tokens_repeated"), share("memory_reduction"), F.lit(")")),
        F.format_string("  Novel content: %d tokens", "tokens_novel"),
        F.concat(F.format_string("  After quenching: %d tokens (R_quench = ", "tokens_after_quench"), share("quench_reduction"), F.lit(")")),
        F.concat(F.format_string("  Final: %d tokens (R_total = ", "tokens_final"), share("total_reduction"), F.lit(")")),
        F.concat(F.lit("  Theorem 9 bound: R_total = 1 - (1-R_mem)(1-R_quench) = "), share("theoretical_bound")),
    )
