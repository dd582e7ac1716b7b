"""Energies of a model's own tokens, met with the tokens of a text.

A model cuts a text at other places. Both cuts become intervals of the text's
characters, and one sweep over the ends of both, in order, gives every token the sum
of the entries that overlap it: what started before the token's end, less what ended
by its start. Both are running sums, so a text costs one sort, however many entries
a token meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.config import QuenchConfig
from tamarisk.functions.text import MATH, TOKEN, WS, math_spans, protect_math
from tamarisk.operators.energy import dealt, energies
from tamarisk.operators.quench import finish

#: Kinds of events in their order at one place: a token ends before an entry starts
#: there, and an entry ends before a token starts.
_TOKEN_END, _ENTRY_END, _TOKEN_START, _ENTRY_START = range(4)


def token_spans(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, idx, start, stop: where each token of `tokenize` lies in its text, in
    characters from 0. A blank beside a math span may be of no width."""
    texts = dealt(df.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__x")), keys).withColumn("__p", protect_math(F.col("__x")))
    found = texts.select(*keys, "__x", F.regexp_extract_all("__p", F.lit(TOKEN), F.lit(0)).alias("__m"), F.split("__p", TOKEN, -1).alias("__g"))
    pairs = F.arrays_zip(F.col("__m").alias("m"), F.slice("__g", F.lit(1), F.size("__m")).alias("g"))
    raw = found.select(*keys, F.posexplode(pairs).alias("__r", "__c")).select(*keys, "__r", F.col("__c.m").rlike(f"^[{WS}]").alias("__blank"), F.length("__c.g").alias("__gap"), F.length("__c.m").alias("__len"))
    order = Window.partitionBy(*keys).orderBy("__r")
    raw = raw.withColumns({"__stop": F.sum(F.col("__gap") + F.col("__len")).over(order), "__kept": ~F.col("__blank") | ~F.coalesce(F.lag("__blank").over(order), F.lit(True))})
    raw = raw.withColumn("idx", (F.sum(F.col("__kept").cast("int")).over(order) - 1).cast("int")).filter("__kept")
    tokens = raw.select(*keys, "idx", (F.col("__stop") - F.col("__len")).alias("start"), F.col("__stop").alias("stop"))
    # Placeholders stand for math spans: back to the characters of the text itself.
    shifts = _shifts(df.filter(F.col(text).contains("$")), keys, text)
    ends = tokens.select(*keys, "idx", F.inline(F.array(F.struct(F.lit(0).alias("__e"), F.col("start").alias("__at")), F.struct(F.lit(1).alias("__e"), F.col("stop").alias("__at")))), F.lit(0).cast("long").alias("__shift"))
    both = ends.unionByName(shifts.select(*keys, F.lit(None).cast("int").alias("idx"), F.lit(-1).alias("__e"), "__at", "__shift"))
    moved = both.withColumn("__at", F.col("__at") + F.sum("__shift").over(Window.partitionBy(*keys).orderBy("__at", "__e").rangeBetween(Window.unboundedPreceding, 0))).filter("idx is not null")
    return moved.groupBy(*keys, "idx").agg(F.min("__at").alias("start"), F.max("__at").alias("stop"))


def _shifts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, __at (a place in the text with placeholders), __shift: what to add to all
    places from there on."""
    cut = df.select(*keys, F.split(F.col(text), MATH, -1).alias("__g"), math_spans(F.col(text)).alias("__m"))
    pairs = F.arrays_zip(F.slice("__g", F.lit(1), F.size("__m")).alias("g"), F.col("__m").alias("m"))
    rows = cut.select(*keys, F.posexplode(pairs).alias("__k", "__c")).select(*keys, "__k", F.length("__c.g").alias("__gap"), F.length("__c.m").alias("__len"))
    rows = rows.withColumn("__body", F.length(F.concat(F.lit("__MATH_"), F.col("__k").cast("string"), F.lit("__"))))
    stop = F.sum(F.col("__gap") + F.col("__body") + 2).over(Window.partitionBy(*keys).orderBy("__k"))
    rows = rows.withColumn("__stop", stop)
    step = lambda at, by: F.struct(at.cast("long").alias("__at"), by.cast("long").alias("__shift"))
    return rows.select(*keys, F.inline(F.array(step(F.col("__stop") - F.col("__body") - 1, F.lit(-1)), step(F.col("__stop") - 1, F.col("__len") - F.col("__body")), step(F.col("__stop"), F.lit(-1)))))


def overlaps(tokens: DataFrame, entries: DataFrame, keys: list[str], value: str = "energy") -> DataFrame:
    """keys, idx, and the sum of the values of all entries that overlap the token: that
    start before its stop and stop after its start. tokens: keys, idx, start, stop.
    entries: keys, start, stop, value; they don't overlap each other."""
    zero = F.lit(0.0)
    event = lambda kind, at, more, sign: F.struct(F.lit(kind).alias("__kind"), F.col(at).cast("long").alias("__at"), more.alias("__more"), F.lit(sign).alias("__sign"))
    own = tokens.select(*keys, "idx", F.inline(F.array(event(_TOKEN_START, "start", zero, -1), event(_TOKEN_END, "stop", zero, 1))))
    met = entries.select(*keys, F.lit(None).cast("int").alias("idx"), F.inline(F.array(event(_ENTRY_START, "start", F.col(value), 1), event(_ENTRY_END, "stop", F.col(value), -1))))
    order = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda kind: F.sum(F.when(F.col("__kind") == kind, F.col("__more")).otherwise(0.0)).over(order)
    swept = own.unionByName(met).withColumns({"__started": sums(_ENTRY_START), "__stopped": sums(_ENTRY_END)}).filter("idx is not null")
    part = F.when(F.col("__kind") == _TOKEN_END, F.col("__started")).otherwise(-F.col("__stopped"))
    return swept.groupBy(*keys, "idx").agg(F.greatest(F.sum(part), zero).alias(value))


def model_energies(df: DataFrame, entries: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None) -> DataFrame:
    """Token rows as `energies` gives them, with the model's energy in place of the
    estimated one, and by_model. A token that no entry overlaps has none. A text
    without entries keeps its estimates. Entries beyond the text's end meet no token;
    where they end early, the tokens after have no energy. entries: keys, start, stop,
    energy."""
    rows = energies(df, keys, text, config)
    answered = entries.select(*keys).distinct().withColumn("__answered", F.lit(True))
    some = df.join(answered, keys, "left_semi")
    met = overlaps(token_spans(some, keys, text), entries, keys).withColumnRenamed("energy", "__model")
    joined = rows.join(met, [*keys, "idx"], "left")
    return joined.withColumn("by_model", F.col("__model").isNotNull()).withColumn("energy", F.coalesce("__model", "energy")).drop("__model")


def model_quench(df: DataFrame, entries: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None) -> DataFrame:
    """As `quench`, by the model's energies."""
    config = config or QuenchConfig()
    return finish(model_energies(df, entries, keys, text, config), df, keys, text, config)
