"""Text as columns: math spans, tokens, words, normal forms, hashes.

Everything is built-in expressions, so it runs in the JVM without an exchange.
Patterns follow Python's notion of white space and digits, which Java's `\\s` and
`\\d` don't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and re see it.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
# The token classes in their order.
TOKEN = rf"""(?d)'[^']*'|"[^"]*"|[a-zA-Z_][a-zA-Z0-9_]*|\p{{Nd}}+\.?\p{{Nd}}*|[^\p{{L}}\p{{N}}_{WS}]|[{WS}]+"""
MATH = r"(?s)\$\$.*?\$\$|\$.*?\$"
PLACEHOLDER = r"^__MATH_(0|[1-9][0-9]*)__$"


def math_spans(text: Column) -> Column:
    """The spans between single or double dollar signs, in order."""
    return F.regexp_extract_all(text, F.lit(MATH), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: a lambda's variable is, while an
    expression inside a lambda would be for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def protect_math(text: Column) -> Column:
    """Each span replaced by a placeholder with its number."""

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda s, i: F.when(i < F.size(pieces) - 1, F.concat(s, F.lit(" __MATH_"), i.cast("string"), F.lit("__ "))).otherwise(s)), "")

    return F.when(~text.contains("$"), text).otherwise(bound(F.split(text, MATH, -1), joined))


def tokenize(text: Column) -> Column:
    """Quoted strings, words, numbers and symbols; white space is one blank token
    between others and never comes first; a math span is one token. Characters of
    no class are left out."""
    raw = F.regexp_extract_all(protect_math(text), F.lit(TOKEN), F.lit(0))
    flat = F.transform(raw, lambda t: F.when(t.rlike(f"^[{WS}]"), F.lit(" ")).otherwise(t))
    # A blank stays if the last token kept isn't blank. Blanks never touch in `flat`
    # unless characters of no class stood between, so the token before decides.
    kept = bound(flat, lambda f: F.filter(f, lambda t, i: (t != " ") | ((i > 0) & (F.get(f, i - 1) != " "))))

    def restored(spans: Column) -> Column:
        number = lambda t: F.regexp_extract(t, PLACEHOLDER, 1)
        own = lambda t: F.coalesce(F.get(spans, F.when(F.length(number(t)) < 10, number(t).cast("int"))), t)
        return F.transform(kept, lambda t: F.when(t.startswith("__MATH_") & t.rlike(PLACEHOLDER), own(t)).otherwise(t))

    return F.when(~text.contains("$"), kept).otherwise(bound(math_spans(text), restored))


def has_token(text: Column) -> Column:
    """Whether `tokenize` finds any; false for null."""
    return F.coalesce(text.rlike(rf"""[a-zA-Z_]|\p{{Nd}}|[^\p{{L}}\p{{N}}_{WS}]"""), F.lit(False))


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(f"[^{WS}]+"))


def normalize(text: Column) -> Column:
    """White space collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, F.lit(f"[{WS}]+"), F.lit(" ")))


def content_hash(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the normal form's SHA-256."""
    return F.substring(F.sha2(normalize(text), 256), 1, digits)


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, F.lit(f"^[{WS}]+|[{WS}]+$"), F.lit(""))
