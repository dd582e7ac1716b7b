"""Quenching: drop the tokens of least energy on a cooling schedule, as far as
the text's fidelity allows.

Survivors of every step are a prefix of one fixed ranking, so a step's fidelity is
a prefix sum over it. The schedule's end is then a row-wise search over 100 steps
for the last one that keeps at least as many tokens as the threshold needs. No
step is iterated, and all windows share the exchange on the text's key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.config import QuenchConfig, output_config
from tamarisk.functions.text import bound, has_token, strip, tokenize
from tamarisk.operators.boltzmann import STEPS, stepped
from tamarisk.operators.energy import by_profile, energies, is_blank, profiled

#: A response of fewer tokens stays as it is.
LEAST_OUTPUT = 20
NO_SPACE_BEFORE = ",.:;)]}?!'\""


def kept_at(m: Column, fraction: Column) -> Column:
    """How many of m tokens survive: the fraction rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(m * F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)))).cast("int")


def fraction_at(step: Column, t0: Column | float, rate: Column | float) -> Column:
    t0, rate = (x if isinstance(x, Column) else F.lit(float(x)) for x in (t0, rate))
    return (t0 / (1.0 + rate * step)) / t0


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds m (tokens that aren't frozen), rank among them by energy, then place,
    e_last (the energy of the token's last occurrence), mass (its sum down to the
    rank) and total (its sum)."""
    whole = Window.partitionBy(*keys)
    rank = Window.partitionBy(*keys, "frozen").orderBy(F.desc("__e"), "idx")
    free = ~F.col("frozen")
    rows = (
        rows.withColumn("e_last", F.max_by("energy", "idx").over(Window.partitionBy(*keys, "token")))
        .withColumns({"m": F.sum(F.when(free, 1).otherwise(0)).over(whole), "total": F.coalesce(F.sum(F.when(free, F.col("e_last"))).over(whole), F.lit(0.0))})
        .withColumn("__e", F.round("energy", 12))
    )
    rows = rows.withColumns({"rank": F.row_number().over(rank), "mass": F.sum("e_last").over(rank.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.withColumns({"rank": F.when(free, F.col("rank")), "mass": F.when(free, F.col("mass"))}).drop("__e")


@dataclass(frozen=True)
class Schedule:
    """What the schedule reads of a configuration, of the profile that a row names."""

    similarity_threshold: Column
    cooling_rate: Column
    min_tokens: Column
    temperature_initial: Column

    @classmethod
    def of(cls, profiles: dict[str, QuenchConfig]) -> Schedule:
        if any(c.survival_mode == "boltzmann" for c in profiles.values()):
            raise ValueError("profiles are swept in deterministic mode")
        own = lambda name: by_profile(profiles, lambda c: F.lit(getattr(c, name)))
        return cls(own("similarity_threshold"), own("cooling_rate"), own("min_tokens"), own("temperature_initial").cast("double"))


def _start(config: QuenchConfig | Schedule, t0: str | None) -> Column:
    given = config.temperature_initial
    return F.col(t0) if t0 else given if isinstance(given, Column) else F.lit(float(given))


def cutoff(rows: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """Survivors at one temperature, given as a fraction of the first."""
    return ranked(rows, keys).filter(F.col("frozen") | (F.col("rank") <= kept_at(F.col("m"), F.lit(float(fraction)))))


def _part() -> Column:
    """The fidelity of the tokens down to a rank; a text without mass is measured by
    token counts."""
    return F.when(F.col("total") == 0, F.col("rank") / F.col("m")).otherwise(F.least(F.lit(1.0), F.col("mass") / F.col("total")))


def _enough(part: Column, config: QuenchConfig | Schedule) -> Column:
    return F.when(F.round(part, 12) >= config.similarity_threshold, F.col("rank"))


def _steps(need: Column, t0: Column, config: QuenchConfig | Schedule) -> Column:
    """The last step that keeps as many tokens as are needed. A frozen token makes
    every fidelity 1, so the schedule runs to its end; texts shorter than min_tokens
    stay as they are."""
    step = F.sequence(F.lit(1), F.lit(STEPS))
    last = F.coalesce(F.array_max(F.filter(step, lambda s: kept_at(F.col("m"), fraction_at(s, t0, config.cooling_rate)) >= need)), F.lit(0))
    return F.when(F.col("n") < config.min_tokens, 0).when(F.col("m") < F.col("n"), STEPS).otherwise(last)


def _keep(t0: Column, config: QuenchConfig | Schedule) -> Column:
    return F.when(F.col("steps") == 0, F.col("m")).otherwise(kept_at(F.col("m"), fraction_at(F.col("steps"), t0, config.cooling_rate)))


def scheduled(rows: DataFrame, keys: list[str], config: QuenchConfig | Schedule, t0: str | None = None) -> DataFrame:
    """Adds steps, similarity and kept to token rows (from `energies`). t0: a
    column with the first temperature, if it isn't the configuration's."""
    rows = ranked(rows, keys)
    whole = Window.partitionBy(*keys)
    start = _start(config, t0)
    rows = rows.withColumn("__t0", start).withColumn("__part", _part())
    rows = rows.withColumn("__need", F.min(_enough(F.col("__part"), config)).over(whole))
    # The search runs once for each text, at its first token.
    rows = rows.withColumn("__first", F.when(F.col("idx") == 0, _steps(F.col("__need"), F.col("__t0"), config))).withColumn("steps", F.max("__first").over(whole))
    rows = rows.withColumn("__keep", _keep(F.col("__t0"), config)).withColumn("kept", F.col("frozen") | (F.col("rank") <= F.col("__keep")))
    exact = F.max(F.when(F.col("rank") == F.col("__keep"), F.col("__part"))).over(whole)
    similarity = F.when((F.col("m") < F.col("n")) | (F.col("steps") == 0), F.lit(1.0)).otherwise(exact)
    return rows.withColumn("similarity", similarity).drop("__t0", "__part", "__need", "__keep", "__first", "e_last", "mass", "total")


def _quenched(rows: DataFrame, keys: list[str], config: QuenchConfig | Schedule, t0: str | None) -> DataFrame:
    """The same decisions, one row for each text, without a row's way back to its
    tokens: keys, compressed_text, tokens_kept, tokens_total, similarity_score,
    schedule_steps."""
    start = _start(config, t0)
    rows = ranked(rows, keys).withColumn("__part", _part())
    piece = F.when(~is_blank(F.col("token")), F.struct("idx", F.coalesce("rank", F.lit(0)).alias("rank"), strip(F.col("token")).alias("p")))
    texts = rows.groupBy(*keys).agg(
        F.collect_list(piece).alias("pieces"),
        F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", F.col("__part").alias("part")))).alias("parts"),
        F.min(_enough(F.col("__part"), config)).alias("need"),
        F.max("m").alias("m"),
        F.max("n").alias("n"),
    )
    texts = texts.withColumn("steps", _steps(F.col("need"), start, config)).withColumn("keep", F.least(F.col("m"), _keep(start, config)))
    kept = F.transform(F.array_sort(F.filter("pieces", lambda x: x["rank"] <= F.col("keep"))), lambda x: x["p"])
    exact = F.get(F.filter("parts", lambda x: x["rank"] == F.col("keep")), F.lit(0))["part"]
    return texts.select(
        *keys, _joined(kept).alias("compressed_text"), (F.col("n") - F.col("m") + F.col("keep")).cast("long").alias("tokens_kept"), F.col("n").cast("long").alias("tokens_total"),
        F.when((F.col("m") < F.col("n")) | (F.col("steps") == 0), F.lit(1.0)).otherwise(exact).alias("similarity_score"), F.col("steps").alias("schedule_steps"),
    )


def _joined(pieces: Column) -> Column:
    """The text of an array of pieces: runs of one written once, no space before
    closing punctuation."""

    def shown(all_: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            closing = F.substring(p, 1, 1).isin(*NO_SPACE_BEFORE)
            return F.when(i == 0, p).when(p == F.get(all_, i - 1), "").when(closing, p).otherwise(F.concat(F.lit(" "), p))

        return F.array_join(F.transform(all_, one), "")

    return bound(pieces, shown)


def reconstruct(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the rows' tokens in their order, blanks left out, runs of one
    token written once, no space before closing punctuation."""
    pieces = rows.select(*keys, "idx", strip(F.col("token")).alias("p")).filter(F.col("p") != "")
    listed = F.array_sort(F.collect_list(F.struct("idx", "p")))
    return pieces.groupBy(*keys).agg(_joined(F.transform(listed, lambda x: x["p"])).alias("text"))


def quench(df: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None, t0: str | None = None, tokenized: bool = False) -> DataFrame:
    """One row per text: keys, compressed_text, tokens_kept, tokens_total,
    compression_ratio, similarity_score, schedule_steps. A text without tokens
    stays as it is. keys must tell rows apart; t0: see `scheduled`. tokenized: the
    texts are arrays of tokens. config.survival_mode chooses how tokens survive."""
    config = config or QuenchConfig()
    # All windows share one set of keys, so one exchange of texts serves them.
    own = [*keys, t0] if t0 else keys
    return finish(energies(df.select(*own, text), own, text, config, tokenized), df, keys, text, config, t0, tokenized)


def finish(rows: DataFrame, df: DataFrame, keys: list[str], text: str, config: QuenchConfig | Schedule, t0: str | None = None, tokenized: bool = False) -> DataFrame:
    """The texts of `df` from their token rows, which come from `energies` or are like
    them, with energies of any other kind."""
    own = [*keys, t0] if t0 else keys
    if isinstance(config, QuenchConfig) and config.survival_mode == "boltzmann":
        result = stepped(rows, own, config, t0).withColumn("compressed_text", _joined(F.col("pieces")))
    else:
        result = _quenched(rows, own, config, t0)
    result = result.select(
        *keys, "compressed_text", "tokens_kept", "tokens_total",
        (1.0 - F.col("tokens_kept") / F.col("tokens_total")).alias("compression_ratio"), "similarity_score", "schedule_steps",
    )
    # Texts without a token need no exchange: they are told by their characters.
    empty = F.coalesce(F.size(text) == 0, F.lit(True)) if tokenized else ~has_token(F.col(text))
    rest = df.filter(empty).select(
        *keys, (F.lit("") if tokenized else F.col(text)).alias("compressed_text"), F.lit(0).cast("long").alias("tokens_kept"), F.lit(0).cast("long").alias("tokens_total"),
        F.lit(0.0).alias("compression_ratio"), F.lit(1.0).alias("similarity_score"), F.lit(0).alias("schedule_steps"),
    )
    return result.unionByName(rest)


def quench_profiles(df: DataFrame, keys: list[str], profiles: dict[str, QuenchConfig], text: str = "text", profile: str | None = None) -> DataFrame:
    """As `quench`, with column profile: one row for each text and profile; or, if
    `profile` is a column, one for each text, by the profile that it names."""
    rows = profiled(df, keys, profiles, text, profile)
    named = df.select(*keys, text, F.explode(F.array(*[F.lit(p) for p in profiles])).alias("profile")) if profile is None else df.select(*keys, text, F.col(profile).alias("profile"))
    return finish(rows, named, [*keys, "profile"], text, Schedule.of(profiles))


def quench_output(df: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None) -> DataFrame:
    """keys, quenched_text: a response cooled faster; under 20 tokens unchanged."""
    many = F.coalesce(token_total(F.col(text)) >= LEAST_OUTPUT, F.lit(False))
    done = quench(df.filter(many), keys, text, output_config(config)).select(*keys, F.col("compressed_text").alias("quenched_text"))
    return done.union(df.filter(~many).select(*keys, F.col(text).alias("quenched_text")))


def schedule_curve(df: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None, steps: int = STEPS) -> DataFrame:
    """keys, step, kept, similarity at every step, whether accepted or not."""
    config = config or QuenchConfig()
    rows = ranked(energies(df, keys, text, config), keys)
    texts = rows.groupBy(*keys).agg(F.max("m").alias("m"), F.max("n").alias("n"), F.max("total").alias("total"))
    texts = texts.select(*keys, "m", "n", "total", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumn("rank", F.when(F.col("m") > 0, kept_at(F.col("m"), fraction_at(F.col("step"), config.temperature_initial, config.cooling_rate))).otherwise(0))
    masses = rows.filter(~F.col("frozen")).select(*keys, "rank", "mass")
    part = F.when(F.col("m") < F.col("n"), F.lit(1.0)).when(F.col("total") == 0, F.col("rank") / F.col("m")).otherwise(F.least(F.lit(1.0), F.col("mass") / F.col("total")))
    return texts.join(masses, [*keys, "rank"], "left").select(*keys, "step", (F.col("rank") + F.col("n") - F.col("m")).alias("kept"), part.alias("similarity"))


def turn_temperature(turn: Column, total: Column, config: QuenchConfig | None = None, protected: Column | int | None = None, decay: Column | float | None = None, t0: Column | float | None = None) -> Column:
    """Older turns start cooler, not below 0.15 of the first temperature."""
    config = config or QuenchConfig()
    pick = lambda x, d: x if isinstance(x, Column) else F.lit(d if x is None else x)
    protected, decay, t0 = pick(protected, config.protected_recent_turns), pick(decay, config.turn_decay), pick(t0, config.temperature_initial)
    beyond = F.greatest(F.lit(0), total - 1 - turn - (protected - 1))
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(decay, beyond)))
    return F.when((decay >= 1.0) | (total <= protected) | (beyond == 0), t0).otherwise(F.greatest(t0 * factor, t0 * 0.15)).cast("double")


def dropped(rows: DataFrame, keys: list[str], config: QuenchConfig) -> DataFrame:
    """Token rows that the schedule drops."""
    return scheduled(rows, keys, config).filter(~F.col("kept"))


def token_total(text: Column) -> Column:
    return F.size(tokenize(text))
