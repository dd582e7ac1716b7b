"""URL filters: host rules, and a Bloom filter cascade for listed hosts.

The cascade knows its key universe: every distinct host of the corpus. Level 0 is
a Bloom filter of the listed hosts; level 1 holds the unlisted hosts that pass it
by chance, level 2 the listed ones that pass level 1 by chance, and so on until
none is left. A host is listed if the first level it fails is odd (or it passes
all of an odd number of levels), so membership is exact for every key of the
universe, at a fraction of the list's size and without a join. Everything is
DataFrame functions: hashing, grouping, bit operations on arrays of longs.

A level is a bitmap of 64-bit words, or-ed by a grouped aggregate and written as a
table of one row, with the words in blocks. Keys meet it as a scalar subquery: its value
goes to the tasks with the stage and never into the plan or its text. Keys are dealt
to as many parts, by their hash, as keep the levels of a part under about
`MOST_BYTES`; each part has a cascade of its own, and the pages are read once for each
part. So the driver and a task hold no more than a part's levels however long the list
is, and some 10 million listed hosts are still one part.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
from there up to `?`, `#` or the end. A null url, or one without `://`, has an
empty host and path; such rows match no rule and are allowed unless the empty
host is listed. Very long urls are cut like any other. A rule fits its host and all subdomains if the path starts with
its path; the longest rule wins, and of equal ones that given first. Rows repeat
as given and all other columns stay; one with the name of an added column is renamed
(`common.apart`). An empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common

BITS_PER_KEY = 12
HASHES = 4
MOST_BYTES = 16 << 20
MOST_LEVELS = 64
#: Words of a bitmap in a block of it.
BLOCK = 1 << 10
ADDED = ("host", "path", "rule", "verdict", "listed")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str  # starts with "/"
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))
#: Words whose hosts are listed for blocking.
LISTED_WORDS = ("pills", "casino", "poker", "porn", "viagra", "lottery", "loan")


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def matched(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    order = sorted(rules, key=lambda r: -len(r.text))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        text, verdict = F.when(fits(r, host, path), r.text).otherwise(text), F.when(fits(r, host, path), r.verdict).otherwise(verdict)
    return text, verdict


def _spots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(bits)) for k in range(HASHES)]


@dataclass
class Level:
    """bits: a table of one row with the blocks; words: how many it has."""

    bits: DataFrame
    words: int


@dataclass
class Cascade:
    levels: list[Level]

    def _bits(self, df: DataFrame, levels: list[int]) -> DataFrame:
        """With a column of each level's blocks, which is there once in a task and in no
        row that is written or dealt."""
        return df.withColumns({f"__bits{k}": self.levels[k].bits.scalar() for k in levels})

    def _passes(self, key: Column, level: int) -> Column:
        bits, test = F.col(f"__bits{level}"), F.lit(True)
        for spot in _spots(key, level, 64 * self.levels[level].words):
            block, word = F.shiftright(spot, 16).cast("int"), F.shiftright(spot, 6).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
            test = test & (F.call_function("shiftrightunsigned", F.get(F.get(bits, block), word), spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return test

    def passed(self, keys: DataFrame, level: int) -> DataFrame:
        """The rows of `keys` (key, and others) that pass a level; written."""
        tested = self._bits(keys, [level]).select(*keys.columns, self._passes(F.col("key"), level).alias("__passes"))
        return common.cut(tested, "passed").filter("__passes").drop("__passes")

    def marked(self, df: DataFrame, key: Column) -> DataFrame:
        """`df` with listed, exact for keys of the universe."""
        every = range(len(self.levels))
        known = F.lit(len(every) % 2 == 1)
        for level in reversed(every):
            known = F.when(self._passes(key, level), known).otherwise(F.lit(level % 2 == 1))
        return self._bits(df, list(every)).select(*df.columns, known.alias("listed"))

    @property
    def bytes(self) -> int:
        return sum(8 * x.words for x in self.levels)


def _level(keys: DataFrame, level: int, n: int) -> Level:
    """A Bloom filter of the n keys. Tasks or their own words first; blocks meet in one
    task, a level's bytes in all."""
    words = -(-n * BITS_PER_KEY // 64)
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, 64 * words))).alias("spot"))
    set_ = spots.select(F.shiftright("spot", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    met = set_.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = lambda at, what: F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what])
    blocks = met.groupBy(F.shiftright("word", 10).alias("block")).agg(listed("word", "bits").alias("words"))
    return Level(common.cut(blocks.agg(listed("block", "words").alias("bits")), "level"), words)


def build(universe: DataFrame) -> Cascade:
    """universe: key (distinct), listed (boolean)."""
    held, levels = universe, []
    while len(levels) < MOST_LEVELS:
        own = held.filter("listed" if len(levels) % 2 == 0 else "not listed")
        n = own.count()
        if not n:
            return Cascade(levels)
        levels.append(_level(own, len(levels), n))
        # The other side's keys that pass are the next level's; this side's pass always.
        held = Cascade(levels).passed(held, len(levels) - 1)
    raise RuntimeError("the cascade doesn't end")


def parts_of(listed: int, others: int, most_bytes: int = MOST_BYTES) -> int:
    """Parts for so many keys: of the others about one in a hundred passes level 0."""
    return max(1, -(-(listed + others // 100) * BITS_PER_KEY // 8 // most_bytes))


def judge(pages: DataFrame, listed_hosts: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of `pages` with host, path, rule, verdict, listed. listed_hosts: a
    column `key`; keys outside the corpus and repeated ones do no harm."""
    names = common.apart(pages.columns, ADDED)
    given = common.renamed(pages, ADDED)
    url = F.col(names[url_col])
    hosts = given.select(host(url).alias("key")).distinct()
    marks = listed_hosts.select("key").distinct().withColumn("listed", F.lit(True))
    universe = common.cut(hosts.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "hosts")
    many = {r.listed: r["count"] for r in universe.groupBy("listed").count().collect()}
    parts = parts_of(many.get(True, 0), many.get(False, 0), most_bytes)
    part = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    rows = given.withColumn("host", host(url)).withColumn("path", path(url))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    out = None
    for k in range(parts):
        cascade = build(universe if parts == 1 else universe.filter(part(F.col("key")) == k))
        own = rows if parts == 1 else rows.filter(part(F.col("host")) == k)
        own = cascade.marked(own, F.col("host"))
        own = own.select(*given.columns, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
        if parts > 1:
            own = common.cut(own, "judged")  # so that one part's levels are held at a time
        out = own if out is None else out.unionByName(own)
    common.forget(universe)  # all of it is in the levels
    return out


def hosts_with(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, url_col: str = "url") -> DataFrame:
    """A list for want of a given one: the corpus's hosts that hold a word."""
    key = host(F.col(url_col))
    return pages.select(key.alias("key")).filter(F.col("key").rlike("|".join(words))).distinct()
