"""Passes over arrays that carry a state along, in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk.functions.text import bound

#: Elements whose output is gathered at once: growing one array by every element would
#: copy it each time.
CHUNK = 256


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """A struct of carry, after the last item, and outs. step: from carry and item to the
    next carry and an array of what this item gives. out: the type of such an array."""
    none = F.array().cast(out)

    def inner(state: Column, item: Column) -> Column:
        carry, outs = step(state["carry"], item)
        return F.struct(carry.alias("carry"), F.concat(state["outs"], outs).alias("outs"))

    def outer(state: Column, chunk: Column) -> Column:
        made = F.aggregate(chunk, F.struct(state["carry"].alias("carry"), none.alias("outs")), inner)
        return bound(made, lambda m: F.struct(m["carry"].alias("carry"), F.concat(state["all"], F.array(m["outs"])).alias("all")))

    def run(held: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int")))
        chunks = F.transform(first, lambda k: F.slice(held, k * CHUNK + 1, F.lit(CHUNK)))
        begin = F.struct(start.alias("carry"), F.array().cast(f"array<{out}>").alias("all"))
        return F.aggregate(chunks, begin, outer, lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["all"]).alias("outs")))

    return bound(items, run)
