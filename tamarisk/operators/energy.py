"""Token energies: one row per token, all factors by windows.

Texts are dealt by their key before they are cut to tokens. Every window is
partitioned by columns that contain the key, so texts cross one exchange and token
rows none; texts, not corpora, bound a window. Factors come in two orders only: by
place (the nearest verb), then by token and place (all else).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.config import QuenchConfig
from tamarisk.functions.text import tokenize

CHUNK, STRIDE = 30, 15
DOMAIN_WEIGHT, DOMAIN_WINDOW = 0.10, 12

# Words and weights that results depend on.
KEYWORDS = (
    "def", "class", "async", "await", "return", "yield", "if", "else", "elif", "for", "while", "try", "except",
    "finally", "with", "import", "from", "as", "raise", "assert", "break", "continue", "pass", "lambda",
    "nonlocal", "global", "del", "match", "case",
)
CONSTANTS = ("True", "False", "None", "self", "cls")
TASK_VERBS = (
    "review", "audit", "analyze", "write", "fix", "find", "identify",
    "implement", "debug", "test", "deploy", "build", "refactor", "optimize",
    "migrate", "configure", "design", "document", "explain", "summarize",
    "translate", "generate", "compare", "evaluate", "assess", "validate",
    "verify", "monitor", "investigate", "resolve", "upgrade", "integrate",
    "extract", "transform", "compute", "simulate", "predict", "classify",
)
#: Class, pattern (null: a word list), weight; the first that fits counts.
CLASSES = (
    ("keyword", None, 0.85),
    ("constant", None, 0.55),
    ("capitalized", r"^[A-Z][a-zA-Z0-9_]*$", 0.78),
    ("identifier", r"^[a-zA-Z_][a-zA-Z0-9_]*$", 0.65),
    ("number", r"^\b(\p{Nd}+\.?\p{Nd}*|0x[0-9a-fA-F]+|0b[01]+)\b$", 0.45),
    ("string", r"""(?d)^['"].*['"]$""", 0.40),
    ("operator", r"^[+\-*/%=<>!&|^~@]+$", 0.30),
    ("punctuation", r"^[()\[\]{},.:;#]$", 0.15),
    ("blank", None, 0.0),
    ("comment", r"^#[^\n]*$", 0.20),
    ("symbol", r"""^[\[\]{}<>():;_*=+\-/%$,.!?&|^~@#'"\\]+$""", 0.15),
)
DEFAULT_WEIGHT = 0.1


def is_blank(token: Column) -> Column:
    """After tokenizing, a single blank is the only token of white space."""
    return F.trim(token) == ""


def _fits(name: str, pattern: str | None, token: Column) -> Column:
    if name == "keyword":
        return token.isin(*KEYWORDS)
    if name == "constant":
        return token.isin(*CONSTANTS)
    return is_blank(token) if name == "blank" else token.rlike(pattern)


def token_class(token: Column) -> Column:
    found = F.lit("other")
    for name, pattern, _ in reversed(CLASSES):
        found = F.when(_fits(name, pattern, token), name).otherwise(found)
    return found


def structural_weight(token: Column) -> Column:
    found = F.lit(DEFAULT_WEIGHT)
    for name, pattern, weight in reversed(CLASSES):
        found = F.when(_fits(name, pattern, token), F.lit(weight)).otherwise(found)
    return found


def is_frozen(token: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Math spans, a lone dollar sign, and what a pattern finds anywhere."""
    found = token.startswith("$") & token.endswith("$")
    for p in patterns:
        found = found | token.rlike(p)
    return found


def chunk_count(n: Column) -> Column:
    return F.when(n <= CHUNK, 1).otherwise(F.floor((n - CHUNK) / STRIDE) + 1).cast("int")


def chunk_range(idx: Column, n: Column) -> tuple[Column, Column]:
    """First and last chunk that hold the token; none if the first is larger."""
    own = F.floor(idx / STRIDE).cast("int")
    return F.greatest(F.lit(0), own - 1), F.least(chunk_count(n) - 1, own)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Texts dealt by key to as many partitions as the session shuffles to. Their
    number is set, since few bytes of text make many token rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, idx, token, n, n_distinct; a text without tokens has no rows."""
    texts = dealt(df.select(*keys, F.col(text).alias("__x")), keys)
    return _token_rows(texts.select(*keys, tokenize(F.col("__x")).alias("__t")), keys)


def given_tokens(df: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    """The same for arrays of tokens made elsewhere."""
    return _token_rows(dealt(df.select(*keys, F.col(column).alias("__t")), keys), keys)


def _token_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    # Sizes are taken below the generator, once for each text, and the outer form
    # infers no filter that would make the tokens a second time.
    sized = texts.select(*keys, "__t", F.size("__t").alias("n"), F.size(F.array_distinct("__t")).alias("n_distinct"))
    return sized.select(*keys, "n", "n_distinct", F.posexplode_outer("__t").alias("idx", "token")).filter("idx is not null")


def chunk_frequency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds tf_count, chunks, df (chunks that hold the token) and idf."""
    own = Window.partitionBy(*keys, "token")
    low, high = chunk_range(F.col("idx"), F.col("n"))
    rows = rows.withColumn("__low", low).withColumn("__high", high)
    rows = rows.withColumn("__prev", F.coalesce(F.lag("__high").over(own.orderBy("idx")), F.lit(-1)))
    new = F.greatest(F.lit(0), F.col("__high") - F.greatest(F.col("__low"), F.col("__prev") + 1) + 1)
    rows = rows.withColumn("df", F.when(is_blank(F.col("token")), 0).otherwise(F.sum(new).over(own))).withColumn("tf_count", F.count("*").over(own)).withColumn("chunks", chunk_count(F.col("n")))
    idf = F.when(F.col("df") > 0, F.log((F.col("chunks") + 1) / (F.col("df") + 1)) + 1.0).otherwise(F.lit(1.0))
    return rows.withColumn("idf", idf).drop("__low", "__high", "__prev")


def _scaled(raw: str, keys: list[str]) -> Column:
    """To [0, 1] within the text; 0.5 where all are equal."""
    whole = Window.partitionBy(*keys)
    low, high = F.min(raw).over(whole), F.max(raw).over(whole)
    return F.when(low == high, F.lit(0.5)).otherwise((F.col(raw) - low) / (high - low))


def positional(idx: Column, n: Column) -> Column:
    half = F.greatest(n * 0.15, F.lit(1.0))
    least = F.exp(-(n - 1) / half)
    return F.when(n == 1, F.lit(1.0)).otherwise(0.1 + 0.8 * (F.exp(-idx / half) - least) / (1.0 - least))


def factors(df: DataFrame, keys: list[str], text: str = "text", tokenized: bool = False) -> DataFrame:
    """Token rows with all that no configuration changes: keys, idx, token, n, tf_count,
    df, chunks, idf, e_stat, e_struct, e_pos, e_domain."""
    rows = given_tokens(df, keys, text) if tokenized else tokens(df, keys, text)
    verb = F.when(F.lower("token").isin(*TASK_VERBS), F.col("idx"))
    order = Window.partitionBy(*keys).orderBy("idx")
    rows = (
        rows.withColumn("__verb", verb)
        .withColumn("__before", F.max("__verb").over(order.rowsBetween(-DOMAIN_WINDOW, 0)))
        .withColumn("__after", F.min("__verb").over(order.rowsBetween(0, DOMAIN_WINDOW)))
    )
    distance = F.least(F.col("idx") - F.col("__before"), F.col("__after") - F.col("idx"))  # nulls are passed over
    rows = rows.withColumn("e_domain", F.coalesce(F.exp(-distance / F.lit(float(DOMAIN_WINDOW))), F.lit(0.0))).drop("__verb", "__before", "__after")
    rows = chunk_frequency(rows, keys)
    tf = (F.col("tf_count") + 1) / (F.col("n") + F.col("n_distinct"))
    rows = rows.withColumn("__stat", F.when(is_blank(F.col("token")), F.lit(0.0)).otherwise(tf * F.col("idf"))).withColumn("__struct", structural_weight(F.col("token")))
    rows = rows.withColumns({"e_stat": _scaled("__stat", keys), "e_struct": _scaled("__struct", keys), "e_pos": positional(F.col("idx"), F.col("n"))})
    return rows.select(*keys, "idx", "token", "n", "tf_count", "df", "chunks", "idf", "e_stat", "e_struct", "e_pos", "e_domain")


def _total(config: QuenchConfig) -> Column:
    w = config.energy_weights
    total = w.w_statistical * F.col("e_stat") + w.w_structural * F.col("e_struct") + DOMAIN_WEIGHT * F.col("e_domain") + w.w_positional * F.col("e_pos")
    return total * total


_COLUMNS = ("idx", "token", "n", "tf_count", "df", "chunks", "idf", "frozen", "e_stat", "e_struct", "e_pos", "e_domain", "energy")


def energies(df: DataFrame, keys: list[str], text: str = "text", config: QuenchConfig | None = None, tokenized: bool = False) -> DataFrame:
    """keys, idx, token, n, frozen, e_stat, e_struct, e_pos, e_domain, energy (of
    frozen tokens too; it counts for none of them)."""
    config = config or QuenchConfig()
    rows = factors(df, keys, text, tokenized)
    return rows.withColumns({"frozen": is_frozen(F.col("token"), config.frozen_patterns), "energy": _total(config)}).select(*keys, *_COLUMNS)


def by_profile(profiles: dict[str, QuenchConfig], value: Callable[[QuenchConfig], Column | float | int], profile: str = "profile") -> Column:
    """A value of the profile that the row names; any other name is an error."""
    out = F.when(F.col(profile).isNull(), F.raise_error(F.lit("a row names no profile")))
    for name, config in profiles.items():
        made = value(config)
        out = out.when(F.col(profile) == name, made if isinstance(made, Column) else F.lit(made))
    return out.otherwise(F.raise_error(F.concat(F.lit("no such profile: "), F.col(profile))))


def profiled(df: DataFrame, keys: list[str], profiles: dict[str, QuenchConfig], text: str = "text", profile: str | None = None) -> DataFrame:
    """Token rows as `energies` gives them, for each of the profiles, with its name in
    column profile; or, if `profile` is a column, for the one that the row names. Texts
    are cut and their factors found once, however many profiles there are."""
    if profile is None:
        rows = factors(df, keys, text).withColumn("profile", F.explode(F.array(*[F.lit(name) for name in profiles])))
    else:
        rows = factors(df.select(*keys, F.col(profile).alias("profile"), text), [*keys, "profile"], text)
    frozen = by_profile(profiles, lambda c: is_frozen(F.col("token"), c.frozen_patterns))
    return rows.withColumns({"frozen": frozen, "energy": by_profile(profiles, _total)}).select(*keys, "profile", *_COLUMNS)
