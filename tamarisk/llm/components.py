"""Connected components of an edge table, by alternating large and small stars.

Every round is two grouped minima and joins back; nothing is collected. Rounds
grow with the logarithm of the longest chain. Each round is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    turned = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: every node of an edge, with the smallest node that its
    links reach. Self-links and nulls are ignored; edges may repeat and have
    either direction. No edge gives no row."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = common.cut(edges, "edges")
    while True:
        # Stars already: nodes have one parent, and no parent has a parent.
        many = edges.groupBy("a").count().filter("count > 1").limit(1)
        deep = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1)
        if not many.select("a").union(deep.select("a")).isEmpty():
            before, edges = edges, common.cut(_small(_large(edges)), "edges")
            common.forget(before)
            continue
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
