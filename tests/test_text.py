from pyspark.sql import functions as F

from checker import rebuild, tokens
from tamarisk.functions import text as T
from tamarisk.operators import energy, quench

EDGES = [
    "", " ", "a", "don't stop, it's 2024. 3abc 0x1F", "$5 and $6", "$$x$$ y $z$", "lone $ here", "'quoted $m$ span' after", "literal __MATH_0__ $a$ __MATH_1__",
    " lead and trail ", "Étion naïve ñ", "é é é", "a b\u0085c\x1cd", "line\n\n\ttabs", "😀 ok 😀", "a, b; (c) [d] {e}!", '"two\nlines" x', "١٢٣ ٤.٥",
]


def test_tokens(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(EDGES)] + [(99, None)], "id int, text string")
    got = {r.id: r.t for r in df.select("id", T.tokenize(F.col("text")).alias("t")).collect()}
    assert got.pop(99) is None
    assert got == {k: tokens(t) for k, t in enumerate(EDGES)}


def test_has_token_agrees(spark):
    df = spark.createDataFrame([(t,) for t in EDGES], "text string")
    for r in df.select("text", T.has_token(F.col("text")).alias("some"), F.size(T.tokenize(F.col("text"))).alias("n")).collect():
        assert r.some == (r.n > 0), r.text


def test_words_and_normal_form(spark):
    df = spark.createDataFrame([(t,) for t in EDGES], "text string")
    for r in df.select("text", T.word_count(F.col("text")).alias("n"), T.normalize(F.col("text")).alias("s")).collect():
        assert (r.n, r.s) == (len(r.text.split()), " ".join(r.text.split()))


def test_reconstruct(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(EDGES)], "id int, text string")
    got = {r.id: r.text for r in quench.reconstruct(energy.tokens(df, ["id"]), ["id"]).collect()}
    assert got == {k: x for k, t in enumerate(EDGES) if (x := rebuild(tokens(t)))}


def test_chunks_cover_like_slices(spark):
    for n in (1, 29, 30, 31, 44, 45, 46, 90, 133):
        df = spark.createDataFrame([(n, [str(i) for i in range(n)])], "id int, tokens array<string>")
        rows = energy.given_tokens(df, ["id"])
        low, high = energy.chunk_range(F.col("idx"), F.col("n"))
        got = {r.idx: set(range(r.low, r.high + 1)) for r in rows.select("idx", low.alias("low"), high.alias("high")).collect()}
        slices = [range(n)] if n <= 30 else [range(s, s + 30) for s in range(0, n - 29, 15)]
        assert got == {i: {c for c, s in enumerate(slices) if i in s} for i in range(n)}
