"""Places of tokens in their texts, and energies of a model that cuts texts elsewhere."""

import json
import random

import pytest

from tamarisk.operators import align, energy, quench
from tamarisk.sources import requests

TEXTS = [
    "", " ", "plain words here", "costs $5 and $6, or $$x + y$$ then $a$$b$ end", "'quoted $x$ inside' and \"more\"  \n\t text",
    "Étion naïve 日本語 \U0001f600 x", "__MATH_0__ alone", "__MATH_0__ with $z$", "$", "$$", "a $", "$x$", " $x$ ", "\x1c\u0085 b  日  c", "3abc 2024. 0x1F", "éé  éé",
    "word " * 300 + "$m$ " * 40,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k long, text string")


def test_spans_show_their_tokens(spark, texts):
    tokens = {(r.k, r.idx): r.token for r in energy.tokens(texts, ["k"]).collect()}
    spans = {(r.k, r.idx): (r.start, r.stop) for r in align.token_spans(texts, ["k"]).collect()}
    assert spans.keys() == tokens.keys()
    last = {}
    for (k, idx), token in sorted(tokens.items()):
        a, b = spans[k, idx]
        shown = TEXTS[k][a:b]
        if token == " ":
            assert shown.strip() == ""
        elif "__MATH_" not in token and (k, idx) != (7, 0):  # quoted and literal placeholders
            assert shown == token
        assert a >= last.get(k, 0)
        last[k] = b


def test_overlaps_equal_brute_force(spark):
    r, tokens, entries, want = random.Random(4), [], [], {}
    for k in range(30):
        at, own, cuts = 0, [], sorted(r.sample(range(60), r.randint(0, 20)))
        for idx in range(r.randint(0, 25)):
            at += r.randint(0, 2)
            stop = at + r.randint(0, 4)
            own.append((idx, at, stop))
            at = stop
        pieces = [(a, b, r.randint(0, 64) / 16) for a, b in zip(cuts, cuts[1:], strict=False) if r.random() < 0.9]
        tokens += [(k, *x) for x in own]
        entries += [(k, *x) for x in pieces]
        for idx, a, b in own:
            want[k, idx] = sum(e for x, y, e in pieces if x < b and y > a)
    got = align.overlaps(spark.createDataFrame(tokens, "k long, idx int, start long, stop long"), spark.createDataFrame(entries, "k long, start long, stop long, energy double"), ["k"])
    assert {(x.k, x.idx): x.energy for x in got.collect()} == want


def test_replies_of_every_shape(spark):
    given = [
        (0, {"choices": [{"logprobs": {"content": [{"token": "ab", "logprob": -1}, {"token": " c", "logprob": 0.5}, {"logprob": -2.5}, {"token": "d"}]}}]}),
        (1, {"choices": [{"logprobs": {"tokens": ["ab", "cd", "e"], "token_logprobs": [-1.0, None], "text_offset": [0, 4, 9]}}]}),
        (2, {"choices": [{"logprobs": {"tokens": ["ab", "c"], "token_logprobs": [-1.0, -2.0, -3.0]}}]}),
        (3, {"choices": [{"logprobs": {"token_logprobs": [-1.0]}}]}), (4, {"choices": []}), (5, {}), (6, {"choices": [{"logprobs": None}]}),
    ]
    rows = [(k, json.dumps(x)) for k, x in given] + [(7, "not json"), (8, None), (9, "[1]")]
    got = requests.logprob_entries(spark.createDataFrame(rows, "k long, raw string"), ["k"]).orderBy("k", "pos").collect()
    assert [tuple(r) for r in got] == [
        (0, 0, 0, 2, 1.0), (0, 1, 2, 4, 1e-6), (0, 2, 4, 4, 2.5), (0, 3, 4, 5, 1e-6),
        (1, 0, 0, 2, 1.0), (1, 1, 4, 6, 1e-6), (2, 0, 0, 2, 1.0), (2, 1, 2, 3, 2.0),
    ]


def test_texts_with_short_long_and_no_answers(spark, texts):
    text = "one two three four five six seven " * 12
    docs = spark.createDataFrame([(0, text), (1, text), (2, text), (3, "été")], "k long, text string")
    entries = spark.createDataFrame([(0, 0, 40, 3.0), (1, 0, 100_000, 2.0), (3, 0, 3, 1.0)], "k long, start long, stop long, energy double")
    rows = align.model_energies(docs, entries, ["k"]).collect()
    plain = {(r.k, r.idx): r.energy for r in energy.energies(docs, ["k"]).collect()}
    spans = {(r.k, r.idx): r.start for r in align.token_spans(docs, ["k"]).collect()}
    for r in rows:
        assert r.by_model == (r.k != 2)
        assert r.energy == (plain[r.k, r.idx] if r.k == 2 else 2.0 if r.k == 1 else (3.0 if spans[r.k, r.idx] < 40 else 0.0) if r.k == 0 else 1.0)
    made = {r.k: r for r in align.model_quench(docs, entries, ["k"]).collect()}
    assert made.keys() == {0, 1, 2, 3}
    assert made[2].compressed_text == {r.k: r for r in quench.quench(docs, ["k"]).collect()}[2].compressed_text
    assert made[0].compressed_text.startswith("one two three four five six seven one")
