"""Document fingerprints: SimHash by built-in functions, and all fingerprints within
a Hamming radius by permuted block tables.

A text is lower-cased and cut into words of letters and digits (all beyond ASCII
count as such). Its terms are pairs of words that follow each other, repeats
included, the last word alone. A term's XXH64 (seed 42) votes on 64 signed bits with
the term's code points as weight; a bit is 1 where the votes for it outweigh those
against. Votes are sums of 32 numbers, each with the votes on two bits, so they are
added up by one code-generated aggregate that hashes each term once.

Look-ups: 64 bits make six blocks. Two fingerprints within three bits agree in three
blocks at least, so each of 20 tables permutes the blocks, three of them in front,
and those within the radius share the leading bits in one table or more. Only
distinct fingerprints enter, with their number of documents. A pair counts in the
first table that shows it. Leading bits that more than `CELL` fingerprints share are
dealt to cells, one for each pair of their parts, so no task or array holds more than
two parts. No pair becomes a row: a cell gives one row for each of its fingerprints.

No word, null or empty text: fingerprint zero. Ids may be null or repeat: rows are
told apart by file and place. In `edited`, the row after is that of the next lower
id, nulls last, equal ids by the text's hash; after the last comes the first, and a
single row follows itself. A very long text is one row with its words; its votes are
added up in one task. Other columns, whatever their names, are not read. An empty
table gives no row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common
from tamarisk.llm.ordering import ranked

BITS = 64
RADIUS = 3
#: Fingerprints of one key that a part of a cell holds, about.
CELL = 512
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Two lanes of 32 bits: a text's weight stays below 2^32, being twice its code points at most.
_LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, fp (a signed 64-bit integer). keys tell the rows apart."""
    words = texts.select(*keys, F.array_remove(F.split(F.lower(F.col(text_col)), NO_WORD, -1), "").alias("__w"))
    pairs = words.select(*keys, F.explode_outer(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(1))).alias("b"))).alias("__p"))
    a, b = F.col("__p")["a"], F.col("__p")["b"]
    terms = pairs.select(*keys, F.xxhash64(a, b).alias("__h"), F.coalesce(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(0)).cast("long").alias("__n"))
    votes = [F.sum(F.col("__n") * F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(_LANES))).alias(f"__v{j}") for j in range(BITS // 2)]
    sums = terms.groupBy(*keys).agg(F.sum("__n").alias("__all"), *votes)
    fp = F.lit(0).cast("long")
    for j in range(BITS // 2):
        for at, lane in ((j, F.col(f"__v{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(f"__v{j}", 32))):
            fp = fp.bitwiseOR(F.when(2 * lane > F.col("__all"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _blocks(radius: int) -> tuple[tuple[int, int], ...]:
    """First bit and width of each block: as many as the radius and three more."""
    many = radius + 3
    starts = [BITS * k // many for k in range(many + 1)]
    return tuple((a, b - a) for a, b in zip(starts, starts[1:], strict=False))


def _mask(block: tuple[int, int]) -> int:
    bits = ((1 << block[1]) - 1) << block[0]
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _tables(radius: int) -> list[tuple[int, ...]]:
    return list(combinations(range(radius + 3), 3))


def _leading(fp: Column, radius: int) -> Column:
    """One key for each table: its number and the leading bits of the permuted
    fingerprint."""
    blocks, keys = _blocks(radius), []
    for t, front in enumerate(_tables(radius)):
        key = F.lit(t).cast("long")
        for k in front:
            at, width = blocks[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*keys)


def _earlier(radius: int) -> Column:
    """For each table the masks of the blocks before its last that it doesn't have in
    front: two fingerprints that agree in one of them meet in a table before."""
    blocks = _blocks(radius)
    masks = [F.array(*[F.lit(_mask(blocks[k])).cast("long") for k in range(front[-1]) if k not in front]).cast("array<long>") for front in _tables(radius)]
    return F.array(*masks)


def neighbours(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """fp, n_near: how many documents have another fingerprint within the radius.
    prints: fp (distinct), n (its documents). Fingerprints without any are left out."""
    entries = prints.select("fp", "n", F.inline(_leading(F.col("fp"), radius)))
    hot = common.cut(entries.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > cell).select("key", F.ceil(F.col("c") / cell).alias("parts")), "hot-keys")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    dealt = entries.join(hot, "key", "left").select("t", "key", "fp", "n", own.alias("own"), F.explode(cells).alias("cell"))
    groups = dealt.groupBy("t", "key", "cell").agg(F.collect_list(F.struct("fp", "n", "own")).alias("all")).filter(F.size("all") > 1)
    groups = groups.withColumn("earlier", F.get(_earlier(radius), F.col("t")))
    alone = F.col("cell.i") == F.col("cell.j")

    def near(x: Column) -> Column:
        def linked(y: Column) -> Column:
            d = x["fp"].bitwiseXOR(y["fp"])
            first = F.forall("earlier", lambda m: d.bitwiseAND(m) != 0)
            return (F.bit_count(d) <= radius) & (d != 0) & (alone | (x["own"] != y["own"])) & first

        return F.aggregate(F.filter("all", linked), F.lit(0).cast("long"), lambda s, y: s + y["n"])

    found = groups.select(F.inline(F.transform("all", lambda x: F.struct(x["fp"].alias("fp"), near(x).alias("n_near"))))).filter("n_near > 0")
    return found.groupBy("fp").agg(F.sum("n_near").alias("n_near"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fp, edited_fp, next_fp, n_near (other documents
    within RADIUS of its fingerprint, equal ones included); one row per row. The
    edited text has the first half of its characters and then as many as the half it
    lost from the start of the next row's text, or all that it has."""
    docs = common.keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "key")
    order = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("key")]
    rows = ranked(docs.select("key", "id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("hash")), order)
    after = F.pmod(F.col("rank") + 1, F.lit(max(1, rows.count())))
    ring = common.cut(rows.select("key", "id", "n_chars", "rank", after.alias("after")), "ring")
    lost = F.floor(F.col("n_chars") / 2).cast("int")
    tail = ring.select(F.col("key").alias("before"), F.col("after").alias("rank"), lost.alias("need")).join(ring.select("key", "rank"), "rank")
    texts = docs.select("key", "text")
    tails = texts.join(tail.select("key", "before", "need"), "key").select(F.col("before").alias("key"), F.substr(F.col("text"), F.lit(1), F.col("need")).alias("tail"))
    own = texts.join(ring.select("key", lost.alias("lost"), F.col("n_chars").cast("int").alias("n")), "key")
    both = own.join(tails, "key").select("key", "text", F.concat(F.substr(F.col("text"), F.lit(1), F.col("n") - F.col("lost")), F.col("tail")).alias("other"))
    none = F.lit(None).cast("string")
    versions = both.select("key", F.inline(F.array(F.struct(none.alias("sha"), F.col("text").alias("text")), F.struct(F.sha2("other", 256).alias("sha"), F.col("other").alias("text")))))
    marked = fingerprints(versions, ["key", "sha"])
    first = lambda c, when: F.max(F.when(when, F.col(c)))
    was = F.col("sha").isNull()
    pairs = common.cut(marked.groupBy("key").agg(first("fp", was).alias("fp"), first("fp", ~was).alias("edited_fp"), F.max("sha").alias("edited_sha256")).join(ring, "key"), "fingerprints")
    prints = common.cut(pairs.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    # Written, so that a fingerprint of a third of all rows meets one row in a join that Spark can split.
    near = common.cut(prints.join(neighbours(prints), "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near")), "near")
    following = pairs.select(F.col("rank").alias("after"), F.col("fp").alias("next_fp"))
    return pairs.join(following, "after").join(near, "fp").select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp", "n_near")
