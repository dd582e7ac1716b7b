"""JSON strings replaced in place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import chat
from tamarisk.sources import requests

KINDS = "k long, raw string, r array<struct<path:string,text:string>>"


def spliced(spark, rows):
    df = spark.createDataFrame([(k, raw, list(r)) for k, (raw, r) in enumerate(rows)], KINDS)
    return [x.new for x in df.select("k", requests.splice(F.col("raw"), F.col("r")).alias("new")).orderBy("k").collect()]


def made(r, depth=0):
    kind = r.randint(0, 7 if depth < 4 else 4)
    if kind >= 6:
        return {r.choice(["a", "b", 'q"q', "s/l", "\\", "é", ""]) + str(k): made(r, depth + 1) for k in range(r.randint(0, 4))}
    if kind >= 4 and depth < 4:
        return [made(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, 1, -2.5, "", "x", 'he "said" {[,:]}', "tab\tand\\", "😀 é\n", "]"])


def strings(x, at=""):
    """Paths of the strings, with a way to set each."""
    items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
    for k, v in items:
        path = f"{at}/{json.dumps(k, ensure_ascii=False) if isinstance(x, dict) else k}".lstrip("/")
        if isinstance(v, str):
            yield path, (x, k)
        yield from strings(v, path)


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_random_texts(spark, style):
    r, rows, want = random.Random(3), [], []
    for _ in range(120):
        x = made(r)
        raw = json.dumps(x, ensure_ascii=False, **style)
        found = list(strings(x))
        chosen = r.sample(found, min(len(found), r.randint(0, 3)))
        new = []
        for path, (holder, k) in chosen:
            holder[k] = r.choice(["new", 'with "quotes" \\ and\nlines', "日本"])
            new.append((path, holder[k]))
        rows.append((raw, [*new, ("nowhere/0", "x")]))
        want.append(json.dumps(x, ensure_ascii=False, **style))
    assert spliced(spark, rows) == want


def test_characters_stay(spark):
    raw = '{ "n" : 1.50e+03,\t"a": [ {"x":"\\u0041\\/", "text" : "old", "big":12345678901234567890.10} , "z" ] }\n'
    assert spliced(spark, [(raw, [('"a"/0/"text"', "n w"), ('"a"/1', "é"), ('"n"', "no string")])]) == [raw.replace('"old"', '"n w"').replace('"z"', '"é"')]
    long = json.dumps({"a": "x\\\"" * 100_000, "b": "old"})
    assert spliced(spark, [(long, [('"b"', "new")])]) == [long.replace('"old"', '"new"')]


def test_replies(spark):
    long = "This is a long answer of the model, " * 9
    raws = [
        ("openai", json.dumps({"z": 1.0, "choices": [{"message": {"content": long}}, {"message": {"content": "short"}}, {"message": None}, {"message": {"content": None}}]})),
        ("anthropic", json.dumps({"content": [{"type": "thinking", "text": long}, {"type": "text", "text": long}, "odd", {"type": "text"}]})),
        ("openai", json.dumps({"choices": [{"message": {"content": "short"}}]}, indent=1)), ("anthropic", '{"content": "plain"}'), ("openai", "no json"), ("openai", ""), ("openai", None), ("anthropic", "[1, 2]"),
    ]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(raws)], "k long, api string, raw string")
    got = {r.k: r for r in chat.quench_replies(df, ["k"]).collect()}
    assert len(got) == len(raws)
    assert all(got[k].new_raw == got[k].raw for k in range(2, len(raws)))
    first, second = json.loads(got[0].new_raw), json.loads(got[1].new_raw)
    text = first["choices"][0]["message"]["content"]
    assert len(text) < len(long) and text == second["content"][1]["text"]
    assert got[0].new_raw == raws[0][1].replace(json.dumps(long), json.dumps(text))
    assert second["content"][0]["text"] == long
