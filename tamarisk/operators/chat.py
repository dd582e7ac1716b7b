"""Compression of conversations: which texts may change, and how.

The last user message, system and tool messages, and short texts are never
touched. The plan is a table of spans; compressing it is the token pipeline with
the span as key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.config import QuenchConfig
from tamarisk.functions.text import normalize, word_count
from tamarisk.operators.dedup import dedup_text
from tamarisk.operators.lots import quench
from tamarisk.operators.memory import ID_DIGITS
from tamarisk.operators.quench import quench_output, turn_temperature
from tamarisk.sources.requests import response_texts, write_back_replies

ROLES = ("user", "assistant")


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of a table of plain turns (conv, turn, role, text)."""
    own = Window.partitionBy(conv)
    return turns.select(
        conv, F.lit("openai").alias("api"), F.count("*").over(own).alias("total_turns"), (F.row_number().over(own.orderBy(turn)) - 1).alias("msg"), "role",
        F.when(F.col("text").isNotNull(), "string").otherwise("void").alias("kind"), "text", F.lit(None).cast("array<struct<type:string,text:string>>").alias("blocks"),
        F.coalesce(F.col("role").isin("tool", "function"), F.lit(False)).alias("tool_payload"),
    )


def _eligible(messages: DataFrame, keys: list[str]) -> DataFrame:
    last = F.max(F.when(F.col("role") == "user", F.col("msg"))).over(Window.partitionBy(*keys))
    may = F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) & ~F.col("tool_payload") & ~F.coalesce(F.col("msg") == last, F.lit(False))
    return messages.withColumn("__may", may)


def plan_spans(messages: DataFrame, keys: list[str], min_chars: int = 80) -> DataFrame:
    """keys, api, total_turns, msg, block (null for string content), role, text."""
    whole = F.when(F.col("kind") == "string", F.array(F.struct(F.lit(None).cast("int").alias("block"), F.col("text").alias("text"))))
    parts = F.filter(F.transform("blocks", lambda b, i: F.struct(i.alias("block"), F.when(b["type"] == "text", b["text"]).alias("text"))), lambda s: s["text"].isNotNull())
    rows = _eligible(messages, keys).filter("__may").select(*keys, "api", "total_turns", "msg", "role", F.inline(F.coalesce(whole, parts)))
    return rows.filter(F.length("text") >= min_chars).select(*keys, "api", "total_turns", "msg", "block", "role", "text")


def frozen_messages(messages: DataFrame, keys: list[str], min_chars: int = 80) -> DataFrame:
    """keys, frozen: the messages without a span, in order."""
    long_block = F.exists("blocks", lambda b: (b["type"] == "text") & (F.length(b["text"]) >= min_chars))
    open_ = F.col("__may") & F.coalesce(F.when(F.col("kind") == "string", F.length("text") >= min_chars).otherwise(long_block), F.lit(False))
    return _eligible(messages, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(~open_, F.col("msg")))).alias("frozen"))


def long_spans(spans: DataFrame, config: QuenchConfig | None = None) -> DataFrame:
    """The spans that a memory keeps."""
    return spans.filter(F.length("text") >= (config or QuenchConfig()).cross_turn_freeze_chars)


def _marked(rows: DataFrame, keys: list[str], config: QuenchConfig, store: DataFrame | None) -> DataFrame:
    """Adds __d (a long span's digest) and __seen: the store has it, or an earlier span.

    Digests that occur once and that no store has leave before the join, which meets
    the others' first places. Short spans have no digest; in the join each bears a key
    of its own, so they stay spread, and a digest of many spans meets one row, which
    lets adaptive execution split it."""
    place = F.struct(*keys, "msg", "__b")
    rows = rows.withColumn("__d", F.when(F.length("text") >= config.cross_turn_freeze_chars, F.sha2(normalize(F.col("text")), 256)))
    digests = rows.filter(F.col("__d").isNotNull()).groupBy("__d").agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
    known = F.lit(False)
    if store is not None:
        ids = store.select(F.col("block_id").alias("__id")).distinct()
        digests = digests.join(ids, F.substring("__d", 1, ID_DIGITS) == F.col("__id"), "left")
        known = F.col("__id").isNotNull()
    again = digests.select(F.col("__d").alias("__k"), "__first", known.alias("__known")).filter(F.col("__known") | (F.col("__n") > 1))
    own = F.concat(F.lit("-"), F.hex(F.xxhash64(*keys, "msg", "__b")))
    joined = rows.withColumn("__j", F.coalesce("__d", own)).join(again, F.col("__j") == F.col("__k"), "left")
    seen = F.col("__k").isNotNull() & (F.col("__known") | (place != F.col("__first")))
    return joined.withColumn("__seen", F.coalesce(seen, F.lit(False))).drop("__j", "__k", "__first", "__known")


def compress_spans(spans: DataFrame, keys: list[str], config: QuenchConfig | None = None, memory: bool = False, matching_ids: bool = False, store: DataFrame | None = None) -> DataFrame:
    """keys, msg, block, words, new_words, new_text (null: the span stays), outcome
    (compressed, memory, kept).

    memory: long spans are looked up among those that came before them (by keys,
    msg, block) and in the store, a table as `operators.memory` keeps it, of what came
    before this table. The look-up uses the long form of an id and the store keeps the
    short one, so nothing is ever found; `matching_ids` makes the two agree."""
    config = config or QuenchConfig()
    rows = spans.withColumn("__b", F.coalesce("block", F.lit(-1))).withColumn("words", word_count(F.col("text")))
    rows = _marked(rows, keys, config, store) if memory and matching_ids else rows.withColumn("__seen", F.lit(False))
    frozen = rows.filter("__seen")
    working = dedup_text(F.col("text")) if config.dedup_enabled else F.col("text")
    rows = rows.filter(~F.col("__seen")).withColumn("__w", working).withColumn("working_words", word_count(F.col("__w"))).withColumn("t0", turn_temperature(F.col("msg"), F.col("total_turns"), config))
    # What depends on the span alone goes along as part of its key: no join back.
    own = [*keys, "msg", "__b", "words", "working_words"]
    made = quench(rows, own, "__w", config, t0="t0")
    short = F.col("compressed_text") == ""
    new_words = F.when(short, F.col("working_words")).otherwise(word_count(F.col("compressed_text")))
    made = made.withColumn("new_words", new_words).withColumn("shorter", F.col("new_words") < F.col("words"))
    out = made.select(
        *keys, "msg", F.when(F.col("__b") >= 0, F.col("__b")).alias("block"), "words", F.when(F.col("shorter"), F.col("new_words")).otherwise(F.col("words")).alias("new_words"),
        F.when(F.col("shorter") & ~short, F.col("compressed_text")).alias("new_text"), F.when(F.col("shorter"), "compressed").otherwise("kept").alias("outcome"),
    )
    if memory and matching_ids:
        mark = F.concat(F.lit("[memory:"), F.substring("__d", 1, 8), F.lit("]"))
        out = out.unionByName(frozen.select(*keys, "msg", "block", "words", F.lit(1).cast(dict(out.dtypes)["new_words"]).alias("new_words"), mark.alias("new_text"), F.lit("memory").alias("outcome")))
    return out


def audit(compressed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per conversation with spans: words before and after, and outcomes."""
    before, after = F.sum("words"), F.sum("new_words")
    many = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    return compressed.groupBy(*keys).agg(
        before.alias("tokens_original"), after.alias("tokens_kept"), F.when(before > 0, 1.0 - after / before).otherwise(0.0).alias("compression_ratio"),
        many("compressed").alias("spans_compressed"), many("memory").alias("spans_frozen_memory"),
    )


def apply_to_turns(messages: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """Messages of string content with their new texts. replacements: keys, msg,
    block, new_text."""
    new = replacements.filter(F.col("new_text").isNotNull()).select(*[F.col(k).alias("__" + k) for k in keys], F.col("msg").alias("__msg"), F.col("block").alias("__block"), "new_text")
    on = F.col("msg") == F.col("__msg")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("__" + k))
    on = on & F.lit(None).cast("int").eqNullSafe(F.col("__block"))
    joined = messages.join(new, on, "left")
    return joined.select(*messages.columns, F.when(F.col("kind") == "string", F.coalesce("new_text", "text")).otherwise(F.col("text")).alias("new_text"))


def quench_responses(texts: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None, least_words: int = 30) -> DataFrame:
    """keys, quenched_text of responses over `least_words` words; the others stay."""
    config = config or QuenchConfig()
    many = word_count(F.col(text)) > least_words
    return quench_output(texts.filter(many), keys, text, config).union(texts.filter(~many | F.col(text).isNull()).select(*keys, F.col(text).alias("quenched_text")))


def quench_replies(replies: DataFrame, keys: list[str], config: QuenchConfig | None = None, least_words: int = 30, api: str = "api", raw: str = "raw") -> DataFrame:
    """Adds new_raw: the reply with its texts over `least_words` words quenched. A reply
    without any, or that is no JSON, stays byte for byte."""
    texts = response_texts(replies, keys, api, raw).filter(word_count(F.col("text")) > least_words)
    done = quench_output(texts, [*keys, "part"], config=config or QuenchConfig())
    return write_back_replies(replies, done.withColumnRenamed("quenched_text", "text"), keys, api, raw)
