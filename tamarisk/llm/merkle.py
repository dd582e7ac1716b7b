"""A Merkle manifest of a table: a tree for each source, and one over the sources.

H is the lower-case hex SHA-256 of its inputs one after the other, digests as hex
text. A leaf is H of the row's fields, each `-` if null, else its UTF-8 bytes'
number, `:` and the value. Leaves of a source ascend by id; every `ARITY` nodes in
order become their H until one is left, the subroot. Subroots, by source (null
first, by bytes), make the root in the same way.

Levels are tables (tree, idx, h). Each level joins itself: a row in slot zero of a
run computes its siblings' indices (of two, by XOR; else by the slots' offsets),
meets them by equality and emits the parent. Paths go down again: a run meets that of
its parent node, so a row gets the runs above it by one join, and folds them in its
own row. No level, tree or run comes to the driver; only the number of levels does.
Each level is written, so a lost executor costs one level.

A source of any size is spread: indices come from `ordering`, and keys of joins are
runs, 16 rows each. Null ids come first within their source; rows equal in source and
id are ordered by their leaves, so equal rows may change places without any effect.
Texts are read whole, once, and cross no exchange. Null and empty values differ in
their leaf. Other columns, whatever their names, are not read. An empty table gives
no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common
from tamarisk.llm.ordering import ranked_in_groups

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[c]) for c in FIELDS])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def runs(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """tree, n, parent, run: the hashes of every run in order, at its slot-zero row.
    nodes: tree, n (nodes of the tree at this level), idx, h."""
    zero = nodes.filter(F.col("idx") % arity == 0)
    other = nodes.select(F.col("tree").alias("__t"), F.col("idx").alias("__i"), F.col("h").alias("__h"))
    if arity == 2:
        joined = zero.join(other, (F.col("tree") == F.col("__t")) & (F.col("idx").bitwiseXOR(F.lit(1)) == F.col("__i")), "left")
        run = F.when(F.col("__h").isNull(), F.array("h")).otherwise(F.array("h", "__h"))
        return joined.select("tree", "n", F.shiftright("idx", 1).alias("parent"), run.alias("run"))
    offsets = F.sequence(F.lit(0).cast("long"), F.least(F.lit(arity - 1).cast("long"), F.col("n") - 1 - F.col("idx")))
    wanted = zero.select("tree", "n", F.col("idx").alias("base"), F.explode(offsets).alias("slot"))
    joined = wanted.join(other, (F.col("tree") == F.col("__t")) & (F.col("base") + F.col("slot") == F.col("__i")))
    listed = F.array_sort(F.collect_list(F.struct("slot", F.col("__h").alias("h"))))  # one run
    return joined.groupBy("tree", "n", "base").agg(listed.alias("run")).select("tree", "n", _div(F.col("base"), arity).alias("parent"), F.transform("run", lambda x: x["h"]).alias("run"))


def grow(nodes: DataFrame, most: int, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level of all trees, lowest first, and tree, h: the roots.
    most: nodes of the largest tree."""
    levels, roots = [], nodes.filter("n = 1").select("tree", "h")
    while most > 1:
        level = common.cut(runs(nodes.filter("n > 1"), arity), "level")
        levels.append(level)
        nodes = level.select("tree", F.ceil(F.col("n") / arity).cast("long").alias("n"), F.col("parent").alias("idx"), digest(F.array_join("run", "")).alias("h"))
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "h"))
        most = -(-most // arity)
    return levels, roots


def stacks(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """tree, parent, stack and what tops has: for each lowest run, the runs from it up
    to its tree's root. tops: one row for each tree."""
    above = None
    for level in reversed(levels):
        lone = F.col("n") <= arity
        own = level.filter(lone).join(tops, "tree").withColumn("stack", F.array("run"))
        if above is not None:
            upper = above.withColumnsRenamed({"parent": "__p", "tree": "__t"})
            met = level.filter(~lone).join(upper, (F.col("tree") == F.col("__t")) & (_div(F.col("parent"), arity) == F.col("__p")))
            own = own.unionByName(met.withColumn("stack", F.concat(F.array("run"), F.col("stack"))).drop("__p", "__t"))
        above = common.cut(own.drop("run", "n"), "stacks")
    return above


def _slots(idx: Column, stack: Column, arity: int) -> Column:
    """A node's path: each run above it with the slot in it."""
    powers = F.array(*[F.lit(arity**k).cast("long") for k in range(63) if arity**k < 1 << 63])  # an index has 63 bits
    slot = lambda k: _div(idx, F.get(powers, k)) % arity
    return F.transform(stack, lambda r, k: F.struct(r.alias("run"), slot(k).cast("int").alias("slot")))


def siblings(path: Column) -> Column:
    """The others' hashes of every run, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.array_join(F.filter(s["run"], lambda h, k: k != s["slot"]), "")), "")


def fold(own: Column, path: Column) -> Column:
    """The hash at the path's end, of a node of any hash and its original siblings."""
    before = lambda s: F.array_join(F.slice(s["run"], F.lit(1), s["slot"]), "")
    after = lambda s: F.array_join(F.slice(s["run"], s["slot"] + 2, F.size(s["run"])), "")
    return F.aggregate(path, own, lambda h, s: digest(before(s), h, after(s)))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per
    row. tampered: columns as they are met again later; a row's path is folded with the
    leaf that they make."""
    docs = docs.select(*FIELDS)
    given = {c: F.col(c) for c in FIELDS}
    rows = docs.select("doc_id", "source", leaf(given).alias("leaf"), leaf(given | (tampered or {})).alias("met"))
    rows = ranked_in_groups(rows, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("met")], "leaves")
    rows = common.cut(rows.select("doc_id", "leaf", "met", F.col("group_rank").alias("tree"), F.col("group_rows").alias("n"), F.col("rank").alias("idx")), "leaves")
    most, trees = rows.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    levels, roots = grow(rows.select("tree", "n", "idx", F.col("leaf").alias("h")), most, arity)
    roots = common.cut(roots, "subroots")
    top_nodes = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("idx"), "h")
    top_levels, root = grow(top_nodes, trees, arity)
    root = root.withColumnRenamed("h", "root")
    subs = roots.select("tree", F.col("h").alias("subroot"))
    none = F.array().cast("array<struct<run:array<string>,slot:int>>")
    if top_levels:
        above = stacks(top_levels, root, arity).drop("tree")
        tops = subs.join(above, _div(F.col("tree"), arity) == F.col("parent")).select("tree", "subroot", "root", _slots(F.col("tree"), F.col("stack"), arity).alias("top"))
    else:  # one source or none: its subroot is the root
        tops = subs.select("tree", "subroot", F.col("subroot").alias("root"), none.alias("top"))
    tops = common.cut(tops, "tops")
    single = rows.filter("n = 1").join(tops, "tree").withColumn("path", F.col("top"))
    if levels:
        low = stacks(levels, tops, arity).withColumnsRenamed({"tree": "__t", "parent": "__p"})
        met = rows.filter("n > 1").join(low, (F.col("tree") == F.col("__t")) & (_div(F.col("idx"), arity) == F.col("__p")))
        met = met.withColumn("path", F.concat(_slots(F.col("idx"), F.col("stack"), arity), F.col("top")))
        single = single.unionByName(met.drop("__t", "__p", "stack"))
    done = single.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("met"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
