"""Stochastic survival, reproducible by a hash instead of a generator's state.

A token survives one trial if exp(-E / (k T)) reaches its uniform number. For a
single trial (`survivors`) that number is made of the first 32 bits of SHA-256 over
seed, key, step, trial and place, as a column; for the schedule (`stepped`) of a
mixed 64-bit counter, for all tokens and trials of a step at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.config import QuenchConfig

STEPS = 100
TRIALS = 5


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the parts' text."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def survives(energy: Column, frozen: Column, temperature: float, number: Column, k: float = 1.0) -> Column:
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-energy / F.lit(k * temperature)))) if temperature > 0 else F.lit(0.0)
    return frozen | (chance >= number)


def survivors(rows: DataFrame, keys: list[str], temperature: float, k: float = 1.0, seed: int = 0, step: int = 1, trial: int = 0) -> DataFrame:
    """Token rows (from `energies`) that one trial keeps."""
    number = uniform(F.lit(seed), *[F.col(c) for c in keys], F.lit(step), F.lit(trial), F.col("idx"))
    return rows.filter(survives(F.col("energy"), F.col("frozen"), temperature, number, k))


def spot(keys: list[str]) -> Column:
    """The first 32 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def numbers(spot: int, seed: int, step: int, trials: int, n: int) -> np.ndarray:
    """In [0, 1), by trial and place: 32 mixed bits."""
    first = np.array([(spot + 0x9E3779B9 * (1 + (seed * STEPS + step) * trials + t)) & 0xFFFFFFFF for t in range(trials)], np.uint32)
    x = first[:, None] ^ (np.arange(n, dtype=np.uint32) * np.uint32(0x85EBCA6B))
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ x >> np.uint32(shift)) * np.uint32(factor)
    return (x ^ x >> np.uint32(16)).astype(np.float64) / float(1 << 32)


def schedule(tokens: list[str], energy: np.ndarray, frozen: np.ndarray, config: QuenchConfig, t0: float, spot: int, seed: int = 0) -> tuple[np.ndarray, float, int]:
    """Of one text: which tokens are kept, their fidelity and the last step. A step
    takes the best of TRIALS trials that keep more tokens than the best so far, else
    the plain cutoff; the first step below the threshold ends it."""
    n = len(tokens)
    best, similarity, tau = np.ones(n, bool), 1.0, 0
    if n < config.min_tokens:
        return best, similarity, tau
    last = dict(zip(tokens, energy.tolist(), strict=True))
    weight = np.array([last[t] for t in tokens])
    total, some_frozen = float(weight.sum()), bool(frozen.any())
    free = np.flatnonzero(~frozen)
    order = free[np.lexsort((free, -np.round(energy[free], 12)))]

    def fidelity(kept: np.ndarray) -> float:
        if some_frozen:
            return 1.0
        return min(1.0, float(weight[kept].sum()) / total) if total else float(kept.sum()) / n

    enough = lambda s: round(s, 12) >= config.similarity_threshold
    for step in range(1, STEPS + 1):
        heat = t0 / (1.0 + config.cooling_rate * step)
        chosen, top, least = None, 0.0, int(best.sum())
        if least < n:  # none can keep more than all
            kept = frozen | (np.exp(-energy / (config.boltzmann_k * heat)) >= numbers(spot, seed, step, TRIALS, n))
            for own in kept[kept.sum(1) > least]:
                if enough(s := fidelity(own)) and s > top:
                    chosen, top = own, s
        if chosen is None:
            count = max(1, int(np.ceil(len(order) * max(0.0, min(1.0, heat / t0))))) if len(order) else 0
            chosen = frozen.copy()
            chosen[order[:count]] = True
        if not enough(s := fidelity(chosen)):
            break
        best, similarity, tau = chosen, s, step
    return best, similarity, tau


def stepped(rows: DataFrame, keys: list[str], config: QuenchConfig, t0: str | None = None, seed: int = 0) -> DataFrame:
    """keys, pieces (the kept tokens that aren't blank, in order), tokens_kept,
    tokens_total, similarity_score, schedule_steps of token rows (from `energies`).

    Each step depends on what earlier steps kept, so a text's steps run in one
    group: the one operator that needs a grouped function. It takes the exchange of
    the texts as it is, and its memory follows the longest text."""
    start = F.col(t0) if t0 else F.lit(float(config.temperature_initial))
    given = rows.select(*keys, spot(keys).alias("__spot"), start.alias("__t0"), "idx", "token", "frozen", "energy")
    kinds = [given.schema[k] for k in keys]
    schema = T.StructType([*kinds, *T._parse_datatype_string("pieces array<string>, tokens_kept long, tokens_total long, similarity_score double, schedule_steps int").fields])

    def steps_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        tokens = part["token"].tolist()
        kept, similarity, tau = schedule(tokens, part["energy"].to_numpy(), part["frozen"].to_numpy(bool), config, float(part["__t0"].iloc[0]), int(part["__spot"].iloc[0]), seed)
        pieces = [p for t, k in zip(tokens, kept, strict=True) if k and (p := t.strip())]
        return pd.DataFrame([[*key, pieces, int(kept.sum()), len(tokens), similarity, tau]], columns=schema.names)

    return given.groupBy(*keys).applyInPandas(steps_of, schema)
