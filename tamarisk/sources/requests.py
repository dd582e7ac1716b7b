"""Chat request bodies as JSON text: parsed, told apart, routed.

Bodies stay as given beside what is parsed from them, so those that must pass
through unchanged do. Everything is expressions over one VARIANT column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions.text import bound
from tamarisk.operators.dedup import MIN_BLOCK_CHARS

TOOL_BLOCKS = ("tool_use", "tool_result")
SIGNED_BLOCKS = ("thinking", "redacted_thinking")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ...; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def _string(v: Column, path: str) -> Column:
    """The field if it is a string, else null."""
    own = _field(v, path)
    return F.when(_kind(own) == "STRING", F.try_variant_get(own, "$", "string"))


def _truthy(v: Column) -> Column:
    text = F.to_json(v)
    return F.coalesce(v.isNotNull() & ~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _list(v: Column) -> Column:
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def messages(body: Column) -> Column:
    """Array of (msg, role, kind, text, blocks (type, text), tool_role, tool_call)."""
    listed = F.coalesce(_list(_field(body, "messages")), F.array().cast("array<variant>"))

    def one(m: Column, i: Column) -> Column:
        content = _field(m, "content")
        blocks = F.transform(_list(content), lambda b: F.struct(F.when(_kind(b) == "OBJECT", _string(b, "type")).alias("type"), F.when(_kind(b) == "OBJECT", _string(b, "text")).alias("text")))
        return F.struct(
            i.alias("msg"), _string(m, "role").alias("role"), F.lower(F.coalesce(_kind(content), F.lit("VOID"))).alias("kind"),
            F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")).alias("text"), blocks.alias("blocks"),
            F.coalesce(_string(m, "role").isin("tool", "function"), F.lit(False)).alias("tool_role"),
            (_truthy(_field(m, "tool_calls")) | _truthy(_field(m, "function_call"))).alias("tool_call"),
        )

    return F.transform(listed, one)


def has_blocks(listed: Column, types: tuple[str, ...]) -> Column:
    return F.exists(listed, lambda m: F.coalesce(F.exists(m["blocks"], lambda b: F.coalesce(b["type"].isin(*types), F.lit(False))), F.lit(False)))


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds valid (a JSON object, or nothing), streaming, signed, api, messages. A
    body that isn't an object has none of them set."""
    body = F.try_parse_json(F.when(F.length(raw) > 0, F.col(raw)).otherwise("{}"))
    df = df.withColumn("__body", body).withColumn("valid", F.coalesce(_kind(F.col("__body")) == "OBJECT", F.lit(False)))
    own = F.when(F.col("valid"), F.col("__body"))
    df = df.withColumn("messages", messages(own)).withColumn("streaming", F.coalesce(F.col("valid") & _truthy(_field(own, "stream")), F.lit(False)))
    claude = _string(own, "system").isNotNull() | has_blocks(F.col("messages"), TOOL_BLOCKS)
    return df.withColumn("signed", has_blocks(F.col("messages"), SIGNED_BLOCKS)).withColumn("api", F.when(claude, "anthropic").otherwise("openai")).drop("__body")


def message_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, api, total_turns, msg, role, kind, text, blocks, tool_payload."""
    rows = parsed.select(*keys, "api", F.size("messages").alias("total_turns"), F.inline("messages"))
    tool_block = F.coalesce(F.exists("blocks", lambda b: F.coalesce(b["type"].isin(*TOOL_BLOCKS), F.lit(False))), F.lit(False))
    return rows.withColumn("tool_payload", F.when(F.col("api") == "openai", F.col("tool_role") | F.col("tool_call")).otherwise(tool_block)).drop("tool_role", "tool_call")


def route(parsed: DataFrame, planned: DataFrame, keys: list[str], multi_turn: bool = True) -> DataFrame:
    """Adds route: streaming and signed bodies pass as they are, as do those with
    nothing to compress; the others are compressed. planned: spans."""
    some = planned.select(*keys).distinct().withColumn("__some", F.lit(True))
    joined = parsed.join(some, keys, "left")
    way = F.when(~F.col("valid"), "passthrough").when(F.col("streaming"), "streaming").when(F.col("signed"), "passthrough")
    return joined.withColumn("route", way.when(F.coalesce("__some", F.lit(False)) & F.lit(multi_turn), "compress").otherwise("passthrough")).drop("__some")


def json_string(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


#: JSON's lexemes; together they are the whole text.
LEXEME = r'''(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^"{}\[\],:]+'''
_FRAME = "struct<k:string,o:boolean,want:boolean>"


def _path(*steps: Column | str) -> Column:
    """Of a value: keys as JSON strings, and indices."""
    return F.concat_ws("/", *[F.lit(f'"{x}"') if isinstance(x, str) else x.cast("string") for x in steps])


def splice(raw: Column, new: Column) -> Column:
    """The JSON text with some of its strings replaced and every other character as it
    was. new: array of (path, text). A path without a string is passed over.

    The text is cut to lexemes, and one pass over them keeps the path of each: for
    every open object its last key, for every open array its index."""
    lexemes = F.regexp_extract_all(raw, F.lit(LEXEME), F.lit(0))
    frame = lambda k, o, want: F.struct(k.alias("k"), o.alias("o"), want.alias("want")).cast(_FRAME)
    yes, no = F.lit(True), F.lit(False)

    def step(state: Column, t: Column) -> Column:
        path = state["path"]
        below, top = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.get(path, F.size(path) - 1)
        inner = F.coalesce(top["o"], no)
        key = inner & top["want"] & t.startswith('"')
        moved = (
            F.when(t == "{", F.concat(path, F.array(frame(F.lit(None).cast("string"), yes, yes))))
            .when(t == "[", F.concat(path, F.array(frame(F.lit("0"), no, no))))
            .when(t.isin("}", "]"), below)
            .when((t == ",") & inner, F.concat(below, F.array(frame(top["k"], yes, yes))))
            .when(t == ",", F.concat(below, F.array(frame((top["k"].cast("int") + 1).cast("string"), no, no))))
            .when(key, F.concat(below, F.array(frame(t, yes, no))))
            .otherwise(path)
        )
        here = F.array_join(F.transform(path, lambda f: f["k"]), "/")
        found = F.get(F.filter(new, lambda r: r["path"] == here), F.lit(0))["text"]
        hit = F.when(t.startswith('"') & ~key & found.isNotNull(), json_string(found))
        hits = F.when(hit.isNotNull(), F.concat(state["hits"], F.array(F.struct(state["i"].alias("i"), hit.alias("text"))))).otherwise(state["hits"])
        return F.struct((state["i"] + 1).alias("i"), moved.alias("path"), hits.alias("hits"))

    start = F.struct(F.lit(0).alias("i"), F.array().cast(f"array<{_FRAME}>").alias("path"), F.array().cast("array<struct<i:int,text:string>>").alias("hits"))

    def spliced(all_: Column) -> Column:
        def joined(hits: Column) -> Column:
            mine = lambda i: F.get(F.filter(hits, lambda h: h["i"] == i), F.lit(0))["text"]
            return F.when(F.size(hits) == 0, raw).otherwise(F.array_join(F.transform(all_, lambda t, i: F.coalesce(mine(i), t)), ""))

        return bound(F.aggregate(all_, start, step, lambda s: s["hits"]), joined)

    return bound(lexemes, spliced)


def _spliced(df: DataFrame, replacements: DataFrame, keys: list[str], path: Column, raw: str) -> DataFrame:
    listed = replacements.filter(F.col("text").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(path.alias("path"), "text")).alias("__r"))
    joined = df.join(listed, keys, "left")
    valid = F.col("__r").isNotNull() & F.try_parse_json(F.col(raw)).isNotNull()
    return joined.withColumn("new_raw", F.when(valid, splice(F.col(raw), F.col("__r"))).otherwise(F.col(raw))).drop("__r")


def write_back(df: DataFrame, replacements: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Adds new_raw: the body with texts replaced, all else as it was given.
    replacements: keys, msg, block (null for string content), text. A replacement that
    doesn't fit the content's kind is passed over; a body without one stays byte for
    byte."""
    whole = _path("messages", F.col("msg"), "content")
    path = F.when(F.col("block").isNull(), whole).otherwise(F.concat_ws("/", whole, _path(F.col("block"), "text")))
    return _spliced(df, replacements, keys, path, raw)


def write_back_replies(df: DataFrame, replacements: DataFrame, keys: list[str], api: str = "api", raw: str = "raw") -> DataFrame:
    """Adds new_raw: the reply with texts replaced where its API keeps them, all else as
    it was given. replacements: keys, part (as in `response_texts`), text. A part that
    has no text in the reply is passed over; a reply without a replacement stays byte
    for byte."""
    own = replacements.select(*keys, "part", "text").join(df.select(*keys, F.col(api).alias("__api")), keys)
    path = F.when(F.col("__api") == "openai", _path("choices", F.col("part"), "message", "content")).otherwise(_path("content", F.col("part"), "text"))
    return _spliced(df, own, keys, path, raw)


def response_texts(df: DataFrame, keys: list[str], api: str = "api", raw: str = "raw") -> DataFrame:
    """keys, part, text: a response's texts, by the shape of its API."""
    body = F.try_parse_json(F.col(raw))
    choices = F.transform(_list(_field(body, "choices")), lambda c: _string(c, "message.content"))
    blocks = F.transform(_list(_field(body, "content")), lambda b: F.when(_string(b, "type") == "text", _string(b, "text")))
    rows = df.select(*keys, F.posexplode(F.when(F.col(api) == "openai", choices).otherwise(blocks)).alias("part", "text"))
    return rows.filter(F.col("text").isNotNull())


def logprob_energies(raw: Column) -> Column:
    """Energies from a reply with token log-probabilities, in either shape."""
    probs = F.get(F.try_variant_get(F.try_parse_json(raw), "$.choices", "array<variant>"), F.lit(0))
    by_entry = F.transform(F.try_variant_get(probs, "$.logprobs.content", "array<variant>"), lambda e: F.coalesce(F.try_variant_get(e, "$.logprob", "double"), F.lit(0.0)))
    flat = F.try_variant_get(probs, "$.logprobs.token_logprobs", "array<double>")
    energy = lambda a: F.transform(a, lambda x: F.when(x < 0, -x).otherwise(1e-6))
    return F.coalesce(F.when(F.size(by_entry) > 0, energy(by_entry)), F.when(F.size(flat) > 0, energy(flat)), F.array().cast("array<double>"))


def _entry_list(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """keys, __b: a reply's entries as an array of (token, prob, at)."""
    df = df.select(*keys, F.get(F.try_variant_get(F.try_parse_json(F.col(raw)), "$.choices", "array<variant>"), F.lit(0)).alias("__f"))
    first = F.col("__f")
    entry = lambda token, prob, at: F.struct(token.alias("token"), prob.alias("prob"), at.alias("at"))
    none = F.lit(None).cast("long")
    listed = F.transform(_list(_field(first, "logprobs.content")), lambda e: entry(F.coalesce(_string(e, "token"), F.lit("")), F.coalesce(F.try_variant_get(e, "$.logprob", "double"), F.lit(0.0)), none))
    flat = lambda name, kind: F.try_variant_get(first, f"$.logprobs.{name}", f"array<{kind}>")
    rows = df.select(*keys, listed.alias("__l"), flat("tokens", "string").alias("__t"), flat("token_logprobs", "double").alias("__p"), flat("text_offset", "long").alias("__o"))
    zipped = F.transform("__t", lambda t, k: entry(t, F.coalesce(F.get("__p", k), F.lit(0.0)), F.get("__o", k)))
    return rows.select(*keys, F.when(F.size("__l") > 0, F.col("__l")).otherwise(F.slice(zipped, F.lit(1), F.least(F.size("__t"), F.size("__p")))).alias("__b"))


def _entry_energy(prob: Column) -> Column:
    return F.when(prob < 0, -prob).otherwise(1e-6)


def logprob_entries(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, pos, start, stop, energy: a reply's entries with their places in the text,
    in characters. A reply lists entries (token, logprob), or tokens, token_logprobs
    and, maybe, text_offset. Without offsets, entries follow each other from the
    text's start. Where lists differ in length the shorter counts; numbers without
    tokens have no place and give no row, as do empty and invalid replies."""
    out = _entry_list(df, keys, raw).select(*keys, F.posexplode("__b").alias("pos", "__e")).select(*keys, "pos", F.col("__e.at").alias("__at"), F.length("__e.token").cast("long").alias("__n"), _entry_energy(F.col("__e.prob")).alias("energy"))
    after = F.sum("__n").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce("__at", F.col("__after") - F.col("__n"))
    return out.withColumn("__after", after).select(*keys, "pos", start.alias("start"), (start + F.col("__n")).alias("stop"), "energy")


def logprob_lists(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """The same entries as three arrays for each reply: sizes (of tokens, in characters),
    places (null where all follow each other) and energies."""
    return _entry_list(df, keys, raw).select(
        *keys, F.transform("__b", lambda e: F.length(e["token"])).alias("sizes"), F.when(F.exists("__b", lambda e: e["at"].isNotNull()), F.transform("__b", lambda e: e["at"])).alias("places"),
        F.transform("__b", lambda e: _entry_energy(e["prob"])).alias("energies"),
    )


__all__ = ["MIN_BLOCK_CHARS", "has_blocks", "json_string", "logprob_energies", "logprob_entries", "logprob_lists", "message_rows", "messages", "parse", "response_texts", "route", "splice", "write_back", "write_back_replies"]
