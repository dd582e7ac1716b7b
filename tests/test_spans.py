"""The memory of spans: first places by a join, batches, replays."""

import pytest

from tamarisk.config import QuenchConfig
from tamarisk.operators import chat
from tamarisk.sources import storage
from tamarisk.streaming import memory, spans

KEYS = ["conv_id"]
CONFIG = QuenchConfig(cross_turn_freeze_chars=120)
SCHEMA = "conv_id long, turn long, role string, text string"


def turns():
    """90 % short texts; of all, a third are one long text."""
    out = []
    for conv in range(40):
        for turn in range(6):
            text = f"conversation {conv} says something short of its own at turn {turn}, and a little more than eighty characters"
            if turn % 3 == 0:
                text = "the same long text again and again, which comes in every conversation, at its start and in the middle, with a few more words"
            elif conv % 10 == turn:
                text = f"a long text of its own, number {conv // 20}, that is there twice at least, once in each half of the conversations, with more words"
            out.append((conv, turn, "user" if turn % 2 else "assistant", text))
    return out


def plan(rows):
    return chat.plan_spans(chat.from_turns(rows), KEYS)


def outcomes(df):
    return sorted((r.conv_id, r.msg, r.words, r.new_words, r.new_text, r.outcome) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark):
    return spark.createDataFrame(turns(), SCHEMA)


def test_first_places(spark, whole):
    done = chat.compress_spans(plan(whole), KEYS, CONFIG, memory=True, matching_ids=True)
    plan_text = done._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan_text.split("\n") if "Window" in line and "__d" in line.split("windowspecdefinition(")[1].split("ASC")[0]]
    seen, want = set(), []
    last = {c: 5 for c in range(40)}
    for conv, turn, _, text in turns():
        if turn == last[conv] or len(text) < 80:
            continue
        hit = len(text) >= 120 and text in seen
        seen |= {text} if len(text) >= 120 else set()
        want.append((conv, turn, hit))
    assert [(r[0], r[1], r[5] == "memory") for r in outcomes(done)] == want
    assert sum(x[2] for x in want) >= len(want) // 3


def test_batches_equal_one_and_a_replay_changes_nothing(spark, whole):
    want = outcomes(chat.compress_spans(plan(whole), KEYS, CONFIG, memory=True, matching_ids=True))
    at = storage.new_path(spark, "spans-test")
    for part in range(4):  # the stream ends and goes on with the checkpoint
        some = [r for r in turns() if r[0] // 10 == part]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        spans.run(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), at, f"{at}/progress", KEYS, plan, CONFIG)
    assert outcomes(spans.results(spark, at)) == want
    store = sorted(map(tuple, memory.read(spark, f"{at}/store").collect()))
    batch = spans.compress_batch(at, KEYS, plan, CONFIG)
    for again in (2, 3):  # batches that run again after a failure
        batch(whole.filter(f"conv_id div 10 = {again}"), again)
    assert outcomes(spans.results(spark, at)) == want
    assert sorted(map(tuple, memory.read(spark, f"{at}/store").collect())) == store


def test_an_empty_batch(spark, whole):
    at = storage.new_path(spark, "spans-test")
    batch = spans.compress_batch(at, KEYS, plan, CONFIG)
    batch(whole.filter("false"), 0)
    batch(whole, 1)
    assert outcomes(spans.results(spark, at)) == outcomes(chat.compress_spans(plan(whole), KEYS, CONFIG, memory=True, matching_ids=True))
