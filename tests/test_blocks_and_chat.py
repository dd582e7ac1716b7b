import json

from pyspark.sql import functions as F

from tamarisk import config as C
from tamarisk.operators import chat, dedup, memory
from tamarisk.sources import requests

LONG = "This block is long enough to count as one of its own, since it has over eighty characters."


def test_dedup(spark):
    df = spark.createDataFrame([(0, "\n\n".join([LONG] * 3)), (1, "hi\n\nhi\n\nhi"), (2, LONG + "\n\nx\n\n" + LONG + "\n \ny")], "id int, text string")
    got = {r.id: r for r in dedup.dedup(df, ["id"]).collect()}
    assert got[0].blocks_removed == 2 and got[0].deduplicated_text.endswith("[↳ see block 0]")
    assert got[1].blocks_removed == 0 and got[1].deduplicated_text == "hi\n\nhi\n\nhi"
    assert got[2].deduplicated_text == LONG + "\n\nx\n\n[↳ see block 0]\n\ny"
    assert {r[0] for r in df.select(F.col("id"), dedup.dedup_text(F.col("text")).alias("t")).select((F.col("t")).alias("t")).collect()} == {r.deduplicated_text for r in got.values()}


def body(**more):
    return json.dumps({"messages": [{"role": "user", "content": LONG}, {"role": "assistant", "content": LONG}, {"role": "user", "content": "now?"}], **more})


BODIES = [
    ("plain", body()), ("system", body(system="s")), ("stream", body(stream=True)), ("bad", "{no"), ("list", "[1]"), ("none", ""),
    ("tool", json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": LONG}]}, {"role": "assistant", "content": [{"type": "text", "text": LONG}, {"type": "tool_use", "id": "1"}]}, {"role": "user", "content": [{"type": "tool_result"}]}]})),
    ("signed", json.dumps({"messages": [{"role": "assistant", "content": [{"type": "thinking", "thinking": "x", "signature": "y"}]}]})),
    ("calls", json.dumps({"messages": [{"role": "user", "content": LONG}, {"role": "assistant", "content": None, "tool_calls": [{"id": 1}]}, {"role": "tool", "content": LONG}, {"role": "user", "content": "?"}]})),
]


def test_bodies(spark):
    parsed = requests.parse(spark.createDataFrame(BODIES, "id string, raw string"))
    spans = chat.plan_spans(requests.message_rows(parsed, ["id"]), ["id"])
    routes = {r.id: (r.api, r.route) for r in requests.route(parsed, spans, ["id"]).collect()}
    assert routes == {
        "plain": ("openai", "compress"), "system": ("anthropic", "compress"), "stream": ("openai", "streaming"), "bad": ("openai", "passthrough"), "list": ("openai", "passthrough"),
        "none": ("openai", "passthrough"), "tool": ("anthropic", "compress"), "signed": ("openai", "passthrough"), "calls": ("openai", "compress"),
    }
    assert {(r.id, r.msg, r.block) for r in spans.filter("id in ('tool', 'calls')").collect()} == {("tool", 0, 0), ("calls", 0, None)}
    frozen = {r.id: r.frozen for r in chat.frozen_messages(requests.message_rows(parsed, ["id"]), ["id"]).collect()}
    assert frozen["plain"] == [2] and frozen["tool"] == [1, 2] and frozen["calls"] == [1, 2, 3]


def test_write_back(spark):
    df = spark.createDataFrame(BODIES, "id string, raw string")
    new = spark.createDataFrame([("plain", 0, None, 'a "new" text'), ("tool", 0, 0, "short"), ("bad", 0, None, "x")], "id string, msg int, block int, text string")
    got = {r.id: r.new_raw for r in requests.write_back(df, new, ["id"]).collect()}
    assert json.loads(got["plain"])["messages"][0] == {"role": "user", "content": 'a "new" text'}
    assert json.loads(got["plain"])["messages"][1:] == json.loads(dict(BODIES)["plain"])["messages"][1:]
    assert json.loads(got["tool"])["messages"][0]["content"] == [{"type": "text", "text": "short"}]
    assert got["signed"] == dict(BODIES)["signed"] and got["bad"] == "{no"


def test_write_back_keeps_every_field_in_its_place(spark):
    raw = '{"z":1,"model":"m","messages":[{"role":"user","name":"n","content":[{"type":"text","cache":{"b":1,"a":2},"text":"old"},7,{"type":"image"}],"id":"x"},"odd",{"content":"plain","role":"user"}],"a":[2.5,null],"stream":false}'
    df = spark.createDataFrame([("1", raw), (None, raw)], "id string, raw string")
    new = spark.createDataFrame([("1", 0, 0, 'n"e\nw'), ("1", 2, None, "other"), ("1", 1, None, "x"), ("1", 0, 1, "x"), ("1", 9, 0, "x")], "id string, msg int, block int, text string")
    got = {r.id: r.new_raw for r in requests.write_back(df, new, ["id"]).collect()}
    assert got["1"] == raw.replace('"old"', '"n\\"e\\nw"').replace('"plain"', '"other"') and got[None] == raw


def test_compress_and_audit(spark):
    text = "Please review this module carefully and explain what each of the functions does in detail. " * 5
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", "go on")], "conv_id int, turn int, role string, text string")
    spans = chat.plan_spans(chat.from_turns(turns), ["conv_id"])
    done = chat.compress_spans(spans, ["conv_id"])
    row = chat.audit(done, ["conv_id"]).first()
    assert row.spans_compressed == 2 and 0 < row.compression_ratio < 1
    seen = chat.audit(chat.compress_spans(spans, ["conv_id"], memory=True, matching_ids=True), ["conv_id"]).first()
    assert (row.spans_frozen_memory, seen.spans_frozen_memory) == (0, 1)
    after = {r.msg: r.new_text for r in chat.apply_to_turns(chat.from_turns(turns), done, ["conv_id"]).collect()}
    assert after[2] == "go on" and len(after[0]) < len(text)


def test_memory(spark):
    rows = spark.createDataFrame([(0, "a  b"), (1, "c"), (2, "a b")], "n int, text string")
    store = memory.store(rows, ["n"])
    assert sorted((r.text, r.access_count) for r in store.collect()) == [("a  b", 1), ("c", 0)]
    again = memory.store(spark.createDataFrame([(3, "c"), (4, "d")], "n int, text string"), ["n"], memory=store)
    assert sorted((r.text, r.access_count) for r in again.collect()) == [("a  b", 1), ("c", 1), ("d", 0)]
    s = memory.stats(again).first()
    assert (s.blocks_stored, s.tokens_stored, s.total_accesses, round(s.hit_rate, 6)) == (3, 4, 2, 0.4)
    asked = spark.createDataFrame([("a b",), ("z",)], "text string")
    assert (memory.known(asked, store).count(), memory.unknown(asked, store).count(), memory.lookup(asked, store).count()) == (1, 1, 2)


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    from tamarisk.streaming import memory as stream

    monkeypatch.setattr(stream, "MERGED", 3)
    at = lambda name: str(tmp_path / name)
    assert stream.last(spark, at("store")) == -1 and stream.read(spark, at("store")).count() == 0
    told = []
    for round_, many in enumerate((5, 3)):  # the second run goes on where the first ended
        for k in range(many):
            spark.createDataFrame([(100 * round_ + 10 * k + i, f"block {(7 * round_ + k + i) % 6}" + "  x" * (k % 2)) for i in range(5)], "n int, text string").coalesce(1).write.mode("append").parquet(at("in"))
        source = spark.readStream.schema("n int, text string").option("maxFilesPerTrigger", 1).parquet(at("in"))
        told.append(stream.run(source, at("store"), at("progress"), ["n"]))
        got = {(r.block_id, r.token_count, r.access_count) for r in stream.read(spark, at("store")).collect()}
        assert got == {(r.block_id, r.token_count, r.access_count) for r in memory.store(spark.read.parquet(at("in")), ["n"]).collect()}
    assert told[0] < told[1] == stream.run(source, at("store"), at("progress"), ["n"])  # nothing new
    names = {p.name for p in (tmp_path / "store").iterdir()}
    assert "merge=5" in names and "batch=0" not in names and "batch=7" in names
    # A batch that runs again leaves the same.
    before = sorted(map(str, stream.read(spark, at("store")).collect()))
    again = spark.read.parquet(at("store") + "/batch=7").select(F.lit(0).alias("n"), "text", F.explode(F.sequence(F.lit(0), "access_count")))
    stream.merge_batch(at("store"), ["n"])(spark.createDataFrame(again.select("n", "text").collect(), "n int, text string"), 7)
    assert sorted(map(str, stream.read(spark, at("store")).collect())) == before


def test_logprobs(spark):
    raw = ['{"choices":[{"logprobs":{"content":[{"logprob":-1.5},{"logprob":0.2},{}]}}]}', '{"choices":[{"logprobs":{"token_logprobs":[-2,0]}}]}', '{"choices":[]}', "nonsense"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r[0] for r in df.select(requests.logprob_energies(F.col("raw"))).collect()] == [[1.5, 1e-6, 1e-6], [2.0, 1e-6], [], []]


def test_config_layers(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("quenching:\n  cooling_rate: 0.4\n  min_tokens: 5\nenergy_weights:\n  w_structural: 0.9\nserver:\n  port: 9\n")
    env = {"TAMARISK_SIMILARITY_THRESHOLD": "0.5", "TAMARISK_COOLING_RATE": "what"}
    c = C.load_config(path, {"turn_decay": 0.3}, env)
    assert (c.cooling_rate, c.similarity_threshold, c.turn_decay, c.min_tokens, c.energy_weights.w_structural) == (0.4, 0.5, 0.3, 30, 0.9)
    assert C.load_server_config(path, env={}).port == 9
    mcp = C.with_profile(c, "mcp", {"cooling_rate": 0.4})
    assert (mcp.cooling_rate, mcp.similarity_threshold, mcp.min_tokens) == (0.4, 0.88, 30)
    assert C.output_config(C.QuenchConfig(min_tokens=99)).min_tokens == 30 and C.output_config().cooling_rate == 0.8
