"""How much of a text's tokens or meaning another keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.text import WS
from tamarisk.operators.energy import dealt


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS}]+"), F.lit(0))


def _counts(df: DataFrame, keys: list[str], original: str, kept: str) -> DataFrame:
    """keys, token, o, k: how often each token is in either list. Lists are dealt by
    key, so no row of a token crosses an exchange; two empty lists leave one row
    without a token."""
    lists = dealt(df.select(*keys, F.col(original).alias("__o"), F.col(kept).alias("__k")), keys)
    side = lambda c, o: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(o).alias("o"), F.lit(1 - o).alias("k")))
    rows = lists.select(*keys, F.explode_outer(F.concat(side("__o", 1), side("__k", 0))).alias("__t"))
    return rows.groupBy(*keys, "__t.token").agg(F.coalesce(F.sum("__t.o"), F.lit(0)).alias("o"), F.coalesce(F.sum("__t.k"), F.lit(0)).alias("k"))


def count_overlap(df: DataFrame, keys: list[str], original: str, kept: str) -> DataFrame:
    """keys, overlap: sum of the smaller counts over the original's count. Two
    empty lists overlap by 1, one empty list by 0; null lists are empty."""
    same, all_ = F.sum(F.least("o", "k")), F.sum("o")
    value = F.when((all_ == 0) & (F.sum("k") == 0), 1.0).when(all_ == 0, 0.0).otherwise(same / all_)
    return _counts(df, keys, original, kept).groupBy(*keys).agg(value.alias("overlap"))


def weighted_similarity(df: DataFrame, keys: list[str], original: str, kept: str, energies: DataFrame) -> DataFrame:
    """keys, similarity: like count_overlap, each token weighted by its energy.
    energies: keys, token, energy (frozen: true makes the result 1). Tokens
    without one weigh 0; no weight at all leaves the plain overlap. An empty
    original gives 1, an empty rest 0."""
    frozen = F.col("frozen") if "frozen" in energies.columns else F.lit(False)
    weights = energies.select(*keys, "token", "energy", frozen.alias("frozen"))
    both = _counts(df, keys, original, kept).join(weights, [*keys, "token"], "left")
    weight, same = F.coalesce("energy", F.lit(0.0)), F.least("o", "k")
    sums = both.groupBy(*keys).agg(F.sum("o").alias("n"), F.sum("k").alias("m"), F.sum(weight * F.col("o")).alias("all"), F.sum(weight * same).alias("same"), F.sum(same).alias("plain"), F.max(F.coalesce("frozen", F.lit(False))).alias("fixed"))
    value = F.when(F.col("fixed"), 1.0).when(F.col("all") == 0, F.col("plain") / F.col("n")).otherwise(F.least(F.lit(1.0), F.col("same") / F.col("all")))
    return sums.select(*keys, F.when(F.col("n") == 0, 1.0).when(F.col("m") == 0, 0.0).otherwise(value).alias("similarity"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Null where it can't be measured: a missing, empty or zero vector, or two of
    different lengths."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms)


def cosine_or_one(a: Column, b: Column) -> Column:
    """1 for a missing or empty vector, 0 for a zero vector; of two lengths the
    longer's further components count for its norm only."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    missing = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(missing, 1.0).when(norms == 0, 0.0).otherwise(_dot(a, b) / norms)


def embedding_similarity(df: DataFrame, keys: list[str], a: str, b: str, original: str, kept: str) -> DataFrame:
    """keys, similarity: the vectors' cosine, or the word overlap of the texts
    where there is none. Only those rows are cut to words."""
    measured = df.withColumn("similarity", cosine(F.col(a), F.col(b)))
    rest = measured.filter(F.col("similarity").isNull()).select(*keys, words(F.col(original)).alias("o"), words(F.col(kept)).alias("k"))
    return measured.filter(F.col("similarity").isNotNull()).select(*keys, "similarity").union(count_overlap(rest, keys, "o", "k").select(*keys, F.col("overlap").alias("similarity")))
