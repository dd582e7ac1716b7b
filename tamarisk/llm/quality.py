"""Quality rules: tokeniser fertility within bands, after plain text rules.

Two public vocabularies encode each word: one of pieces with byte fallback, and a
byte-level one of many languages. Of a text are measured

* chars_per_token, chars_per_token_2: how many characters a token of either stands
  for; low for text unlike any language the vocabulary knows, high for long runs of
  one character,
* byte_share: the share of the words' bytes that no piece covers,
* token_entropy: bits per piece of the text's own counts of pieces; low for text that
  says the same thing again, judged from `ENTROPY_TOKENS` pieces on.

A text is kept if the base rules pass and all four lie within the wide band of its
script and within the bands learned for its group: its language as labelled, or its
script where the label is null or rare. Bands are learned from every row that passes
the base rules; equal texts count once and no verdict is read. Each band is the exact
median and `WIDTH` robust deviations around it, so it holds while junk is well below
half of a group. The entropy's least follows the text's length: a text must not say
less than others of its size. A group with fewer than `LEAST` such texts takes its
script's bands; where these too have few, the wide ones alone hold, without entropy
below `ENTROPY_TOKENS`.

Words are runs of anything but the six ASCII white-space characters, and the whole
text counts. Texts are measured once and written with their measures. Medians come
from the place of each measure in an order over the whole table (`ordering`), a few
numbers a row, so no task sees a group; a group's bands are one short row, broadcast.
A worker keeps `KEEP` words' tokens before it starts anew: it holds those, and of one
lot of texts or one very long text all words.

Null and empty texts have no words, so they fail the base rules. Rows repeat as
given, and a very long text is one like any. All other columns stay; one with the
name of a measure is renamed (`common.apart`). An empty table gives no row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm import common
from tamarisk.llm.ordering import quantile, ranked_in_groups

VOCABULARY, SECOND = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
KEEP = 200_000
WINDOW = 8
ENTROPY_TOKENS = 100
SYMBOLS = "#*$%&|<>"
#: Script: least and most characters a token (of either vocabulary), most byte share,
#: least entropy.
BANDS = {"latin": (1.35, 8.0, 0.2, 4.0), "other": (0.25, 8.0, 0.9, 4.0)}
#: Distinct texts from which a group has bands of its own.
LEAST = 100
#: Robust deviations from the median: characters a token and byte share; entropy.
WIDTH, ENTROPY_WIDTH = 5.0, 3.0
#: Texts of one size class, about, and no fewer classes than one.
CLASS, CLASSES = 50, 8
#: The least deviations: characters a token (of the median), byte share, entropy.
SPREADS = (0.02, 0.02, 0.05)
#: The letters below this code point, and the Latin additions, count as Latin.
_LATIN_END, _LATIN_MORE = 0x250, (0x1E00, 0x1F00)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_token_2 double"


def repeated(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice. words: a number for each;
    window: a power of two. Exact: windows are numbered by doubling."""
    codes, width = words, 1
    while width < window:
        if len(codes) <= width:
            return 0
        _, codes = np.unique(codes[:-width].astype(np.int64) * (int(codes.max()) + 1) + codes[width:], return_inverse=True)
        width *= 2
        if codes.max() == len(codes) - 1:
            return 0  # all differ already
    again = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def script(text: str) -> str:
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    latin = (points < _LATIN_END) | (points >= _LATIN_MORE[0]) & (points < _LATIN_MORE[1])
    return "latin" if 2 * np.count_nonzero(latin) >= len(points) else "other"


def second(path: str):
    """The byte-level vocabulary of many languages."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Fertility:
    def __init__(self, path: str, path_2: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.pieces.vocab_size())])
        self.second = second(path_2)
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.first = np.zeros(1, np.int64)
        self.tokens = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)  # bytes of each word
        self.size_2 = np.zeros(0, np.int32)  # tokens of the second vocabulary

    def learn(self, words: set[bytes]) -> None:
        new = list(words)
        texts = [w.decode() for w in new]
        found = self.pieces.encode(texts, num_threads=1)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in found])])
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(found), np.int32)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int32, len(new))])
        encode = self.second.encode_ordinary
        self.size_2 = np.concatenate([self.size_2, np.fromiter((len(encode(" " + t)) for t in texts), np.int32, len(new))])

    def measure(self, texts: list[str | None]) -> Iterator[tuple]:
        split = [(t or "").encode().split() for t in texts]
        if missing := {w for words in split for w in words if w not in self.at}:
            if len(self.at) + len(missing) > KEEP:
                self.clear()
                missing = {w for words in split for w in words}
            self.learn(missing)
        at = self.at.__getitem__
        for text, words in zip(texts, split, strict=True):
            text, n = text or "", len(words)
            ids = np.fromiter(map(at, words), np.int64, n)
            chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            again = repeated(ids) if n > WINDOW else 0
            failed = n < 20 or 100 * again > 30 * n
            sizes = self.first[ids + 1] - self.first[ids]
            total = int(sizes.sum())
            own = self.tokens[np.repeat(self.first[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]
            counts = np.unique(own, return_counts=True)[1] if total else np.zeros(0)
            entropy = float(np.log2(total) - (counts * np.log2(counts)).sum() / total) if total else 0.0
            # A piece for a byte stands for that byte alone.
            share = float(np.count_nonzero(self.is_byte[own]) / self.size[ids].sum()) if total else 0.0
            total_2 = int(self.size_2[ids].sum())
            per_second = chars / total_2 if total_2 else 0.0
            per_token = chars / total if total else 0.0
            kind = script(text)
            low, high, bytes_most, entropy_least = BANDS[kind]
            kept = not failed and low <= per_token <= high and low <= per_second <= high and share <= bytes_most and (entropy >= entropy_least or total < ENTROPY_TOKENS)
            yield n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, kept, kind, total, per_token, share, max(0.0, entropy), per_second


_LOADED: dict[tuple[str, str], _Fertility] = {}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def _measured(docs: DataFrame, vocabulary: tuple[str, str], text_col: str, carry: list[Column]) -> DataFrame:
    """The columns `carry` and the measures; kept by the wide bands."""
    kinds = T._parse_datatype_string(MEASURES)

    @F.arrow_udf(kinds)
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _LOADED.setdefault(vocabulary, None) or _Fertility(*vocabulary)
        _LOADED[vocabulary] = known
        for texts in batches:
            rows: list[tuple] = []
            for at in range(0, len(texts), 128):
                rows += known.measure(texts.slice(at, 128).to_pylist())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(list(c), _ARROW[f.dataType.typeName()]) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)
        known.clear()  # an idle worker holds no words
        common.release()

    name = common.fresh(docs, "measures")
    measures = measures.asNondeterministic()  # else a filter on a measure takes them all a second time
    return docs.withColumn(name, measures(F.col(text_col))).select(*carry, name + ".*")


def learn(measured: DataFrame, lang_col: str, text_key: str) -> DataFrame:
    """name (`l` and a language, or `s` and a script), band. measured: written."""
    name = F.explode(F.array(F.concat(F.lit("l"), lang_col), F.concat(F.lit("s"), "script")))
    facts = measured.filter("not base_failed").select(name.alias("name"), F.col(text_key).alias("of"), "n_tokens", "chars_per_token", "chars_per_token_2", "byte_share", "token_entropy")
    facts = facts.filter("name is not null").distinct()
    # A key's digits: 0 tokens, 1 and 2 characters a token, 3 byte share, 4 entropy; and the size class.
    each = F.posexplode(F.array(F.col("n_tokens").cast("double"), "chars_per_token", "chars_per_token_2", "byte_share"))
    rows = facts.select("name", "of", "token_entropy", each.alias("what", "value"))
    rows = rows.select(F.concat("what", F.lit("0"), "name").alias("key"), "value", "of", F.when(F.col("what") == 0, F.col("token_entropy")).alias("token_entropy"))
    order = [F.col("value"), F.col("of")]
    first = ranked_in_groups(rows, "key", order, "measures-ranked").filter(F.col("group_rows") >= LEAST)
    sizes, others = first.filter("key like '0%'"), first.filter("key not like '0%'")
    # Classes as equal as whole numbers can be, larger ones first.
    sizes = sizes.withColumn("classes", F.greatest(F.lit(1), F.least(F.lit(CLASSES), F.expr(f"group_rows div {CLASS}"))))
    sizes = sizes.withColumns({"most": F.expr("group_rows % classes"), "size": F.expr("group_rows div classes")})
    sizes = sizes.withColumn("nth", F.expr("if(rank < most * (size + 1), rank div (size + 1), most + (rank - most * (size + 1)) div size)"))
    sizes = sizes.select(
        F.concat(F.lit("4"), "nth", F.expr("substring(key, 3)")).alias("key"), F.log2("value").alias("value"), "of", "token_entropy",
        F.expr("rank - nth * size - least(nth, most)").alias("rank"), F.expr("size + if(nth < most, 1, 0)").alias("group_rows"),
    )
    middle = common.cut(quantile(others, 0.5), "middles")
    away = others.join(middle.withColumnRenamed("value", "middle"), "key").select("key", F.abs(F.col("value") - F.col("middle")).alias("value"), "of")
    second = ranked_in_groups(away.union(sizes.select("key", F.col("token_entropy").alias("value"), "of")), "key", order, "spreads-ranked")
    spread = common.cut(quantile(second, 0.5), "spreads")
    usual = spread.filter("key like '4%'").withColumnRenamed("value", "middle")
    away = second.join(usual, "key").select("key", F.abs(F.col("value") - F.col("middle")).alias("value"), "of")
    around = quantile(ranked_in_groups(away, "key", order, "entropies-ranked"), 0.5)

    parts = {"size": quantile(sizes, 0.5), "middle": middle.union(usual), "spread": spread.filter("key not like '4%'").union(around)}
    found = None
    for part, own in parts.items():
        own = own.select("key", F.lit(part).alias("part"), "value")
        found = own if found is None else found.union(own)
    found = found.groupBy("key").agg(*[F.max(F.when(F.col("part") == part, F.col("value"))).alias(part) for part in parts])
    what, spread, middle = F.substring("key", 1, 1), 1.4826 * F.col("spread"), F.col("middle")
    wide = {k: WIDTH * F.greatest(spread, SPREADS[0] * middle) for k in "12"}
    ends = {f"low_{k}": middle - wide[k] for k in "12"} | {f"high_{k}": middle + wide[k] for k in "12"} | {"most_3": middle + WIDTH * F.greatest(spread, F.lit(SPREADS[1]))}
    level = F.struct(F.substring("key", 2, 1).alias("nth"), "size", (middle - ENTROPY_WIDTH * F.greatest(spread, F.lit(SPREADS[2]))).alias("least"))
    found = found.groupBy(F.expr("substring(key, 3)").alias("name")).agg(
        *[F.max(F.when(what == end[-1], c)).alias(end) for end, c in ends.items()],
        F.array_sort(F.collect_list(F.when(what == "4", level))).alias("levels"),  # `CLASSES` at most
    )
    return found.select("name", F.struct(*ends, F.col("levels.size").alias("sizes"), F.col("levels.least").alias("leasts")).alias("band"))


def _within(band: str) -> Column:
    """Least entropy between the classes' sizes: on the line from one to the next."""
    of = {k: F.col(f"{band}.{k}") for k in ("low_1", "high_1", "low_2", "high_2", "most_3", "sizes", "leasts")}
    size, sizes, leasts = F.log2("n_tokens"), of["sizes"], of["leasts"]
    k = F.size(F.filter(sizes, lambda x: x <= size))  # classes no larger
    before, after = F.get(sizes, k - 1), F.get(sizes, k)
    line = F.get(leasts, k - 1) + (F.get(leasts, k) - F.get(leasts, k - 1)) * (size - before) / (after - before)
    # Entropy grows by a bit at most where the tokens double, so below the smallest
    # class this asks for no more than the class does.
    least = F.when(k == 0, F.get(leasts, F.lit(0)) - F.get(sizes, F.lit(0)) + size).when(k == F.size(sizes), F.get(leasts, k - 1)).otherwise(line)
    chars = F.col("chars_per_token").between(of["low_1"], of["high_1"]) & F.col("chars_per_token_2").between(of["low_2"], of["high_2"])
    return chars & (F.col("byte_share") <= of["most_3"]) & (F.col("token_entropy") >= least)


def judge(docs: DataFrame, vocabularies: tuple[str, str] | None = None, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all) of the rows of `docs` with the measures and `kept`.
    Only the text goes to Python and only the measures come back. The language's
    column may be absent."""
    if vocabularies is None:
        import public_tokenizers

        vocabularies = public_tokenizers.path(VOCABULARY), public_tokenizers.path(SECOND)
    added = T._parse_datatype_string(MEASURES).names
    names, docs = common.apart(docs.columns, added), common.renamed(docs, added)
    carried = [names[c] for c in (names if carry is None else carry)]
    lang = F.col(names[lang_col]).cast("string") if lang_col in names else F.lit(None).cast("string")
    own_lang, own_text = common.fresh(docs, "group_lang"), common.fresh(docs, "text_key")
    carry_all = [*map(F.col, carried), lang.alias(own_lang), F.xxhash64(names[text_col]).alias(own_text)]
    measured = common.cut(_measured(common.spread(docs), vocabularies, names[text_col], carry_all), "measures")
    bands = common.settled(docs.sparkSession, "bands", lambda: learn(measured, own_lang, own_text))
    found, own = measured, {k: (common.fresh(measured, f"name_{k}"), common.fresh(measured, f"band_{k}")) for k in "ls"}
    for k, group in (("l", own_lang), ("s", "script")):
        name, band = own[k]
        few = bands.filter(F.startswith("name", F.lit(k))).select(F.expr("substring(name, 2)").alias(name), F.col("band").alias(band))
        found = found.join(F.broadcast(few), F.col(group) == F.col(name), "left")  # a short row for each group
    band = common.fresh(found, "band")
    found = found.withColumn(band, F.coalesce(own["l"][1], own["s"][1]))
    kept = F.col("kept") & (F.col(band).isNull() | _within(band))
    return found.select(*carried, *[kept.alias(c) if c == "kept" else c for c in added])
