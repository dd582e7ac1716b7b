from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from checker import boltzmann_quenched, quenched, rebuild
from tamarisk.config import PROFILES, QuenchConfig
from tamarisk.operators import boltzmann, energy, fidelity, quench

TEXTS = [
    "Please review the following code and fix any bugs you find in it, then write tests. " * 4,
    "def hello(x, y): return x + y  # adds numbers 1 and 2.5 " * 5,
    "the price is $5 and then $x^2$ again " * 8,
    "short text", "é é", "", "same same same same " * 20,
    "the quick brown fox jumps over the lazy dog " * 3,
]


def frame(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string")


def test_schedule_equals_the_loop(spark):
    for config in (QuenchConfig(), PROFILES["maximum"], replace(QuenchConfig(), min_tokens=1, similarity_threshold=0.5, cooling_rate=0.05)):
        rows = energy.energies(frame(spark), ["id"], config=config)
        by = {}
        for r in rows.orderBy("id", "idx").collect():
            by.setdefault(r.id, []).append((r.token, r.energy, r.frozen))
        for r in quench.quench(frame(spark), ["id"], config=config).collect():
            if r.id not in by:
                assert (r.compressed_text, r.tokens_total, r.schedule_steps) == (TEXTS[r.id], 0, 0)
                continue
            kept, sim, tau = quenched(by[r.id], config.cooling_rate, config.similarity_threshold, config.min_tokens)
            assert (r.tokens_kept, r.schedule_steps) == (len(kept), tau)
            assert abs(r.similarity_score - sim) < 1e-9
            assert r.compressed_text == rebuild([by[r.id][i][0] for i in kept])


def test_frozen_runs_to_the_end(spark):
    got = {r.id: r for r in quench.quench(frame(spark), ["id"], config=QuenchConfig()).collect()}
    assert got[2].schedule_steps == 100 and got[2].similarity_score == 1.0 and "$x^2$" in got[2].compressed_text
    assert got[3].compression_ratio == 0.0


def test_half_survive(spark):
    df = spark.createDataFrame([(0, "def hello ( x , y ) : return x + y".split())], "id int, tokens array<string>")
    rows = energy.energies(df, ["id"], "tokens", tokenized=True)
    assert quench.cutoff(rows, ["id"], 0.5).count() == 6


def test_fidelity_values(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"], ["a", "b", "b"]), (1, [], []), (2, ["a"], [])], "id int, o array<string>, k array<string>")
    assert {r.id: round(r.overlap, 6) for r in fidelity.count_overlap(df, ["id"], "o", "k").collect()} == {0: 0.666667, 1: 1.0, 2: 0.0}
    df = spark.createDataFrame([(0, ["a", "b", "c"], ["b"])], "id int, o array<string>, k array<string>")
    e = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 0.5)], "id int, token string, energy double")
    assert abs(fidelity.weighted_similarity(df, ["id"], "o", "k", e).first().similarity - 2 / 3.5) < 1e-12


def test_cosines(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(F.round(fidelity.cosine(F.col("a"), F.col("b")), 6), F.round(fidelity.cosine_or_one(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [(0.707107, 0.707107), (None, 0.0), (None, 1.0)]


def test_turn_temperature(spark):
    df = spark.createDataFrame([(4,), (3,), (2,), (0,)], "i int")
    config = QuenchConfig(turn_decay=0.5)
    assert [r[0] for r in df.select(quench.turn_temperature(F.col("i"), F.lit(5), config)).collect()] == [1.0, 1.0, 0.5, 0.15]


def test_boltzmann_equals_the_loop(spark):
    df = frame(spark).withColumn("heat", F.lit(1.0) / (F.col("id") + 1))
    for config, t0 in ((QuenchConfig(survival_mode="boltzmann"), None), (QuenchConfig(survival_mode="boltzmann", boltzmann_k=4.0, similarity_threshold=0.6, cooling_rate=0.1, min_tokens=1), "heat")):
        own = ["id", t0] if t0 else ["id"]
        by, spots, heats = {}, {}, {}
        for r in energy.energies(df.select(*own, "text"), own, config=config).withColumn("spot", boltzmann.spot(own)).orderBy("id", "idx").collect():
            by.setdefault(r.id, []).append((r.token, r.energy, r.frozen))
            spots[r.id], heats[r.id] = r.spot, (r[t0] if t0 else 1.0)
        got = quench.quench(df, ["id"], config=config, t0=t0).collect()
        assert sorted(r.id for r in got) == list(range(len(TEXTS)))
        for r in got:
            if r.id not in by:  # no token: as it is
                assert (r.compressed_text, r.tokens_total, r.similarity_score, r.schedule_steps) == (TEXTS[r.id], 0, 1.0, 0)
                continue
            number = lambda step, trial: boltzmann.numbers(spots[r.id], 0, step, 5, len(by[r.id]))[trial]  # noqa: B023, E731
            kept, sim, tau = boltzmann_quenched(by[r.id], config.cooling_rate, config.similarity_threshold, config.min_tokens, heats[r.id], config.boltzmann_k, number)
            assert (r.tokens_kept, r.schedule_steps, r.tokens_total) == (len(kept), tau, len(by[r.id])) and abs(r.similarity_score - sim) < 1e-9
            assert r.compressed_text == rebuild([by[r.id][i][0] for i in kept])


def test_boltzmann_takes_tokens_nulls_and_one_trial(spark):
    df = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog".split() * 5), (1, []), (2, None)], "id int, tokens array<string>")
    got = {r.id: r for r in quench.quench(df, ["id"], "tokens", QuenchConfig(survival_mode="boltzmann"), tokenized=True).collect()}
    assert got.keys() == {0, 1, 2} and got[0].tokens_total == 45 and got[1].tokens_total == got[2].tokens_total == 0
    u = boltzmann.numbers(-5, 3, 7, 5, 4000)
    assert u.shape == (5, 4000) and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == 20000
    rows = energy.energies(frame(spark), ["id"])
    assert boltzmann.survivors(rows, ["id"], 0.0).filter("not frozen").isEmpty()


def test_output_keeps_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "short"), (1, "tiny"), (1, "tiny"), (None, TEXTS[0])], "id int, text string")
    got = [(r.id, r.quenched_text) for r in quench.quench_output(df, ["id"]).collect()]
    assert len(got) == 4 and got.count((1, "tiny")) == 2 and (None, "short") in got


def test_output_is_cooled_faster(spark):
    got = {r.id: r.quenched_text for r in quench.quench_output(frame(spark), ["id"]).collect()}
    assert got[3] == "short text" and got[5] == "" and len(got[0]) < len(TEXTS[0])


def test_no_token_row_crosses_an_exchange(spark):
    """Texts are dealt once, below the generator; rows of tokens never are."""
    for df in (quench.quench(frame(spark), ["id"]), energy.energies(frame(spark), ["id"]), quench.reconstruct(energy.tokens(frame(spark), ["id"]), ["id"])):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        exchanges = [k for k, x in enumerate(lines) if "Exchange" in x]
        generator = next(k for k, x in enumerate(lines) if "Generate posexplode" in x)
        assert len(exchanges) == 1 and exchanges[0] > generator  # children are below
    assert sum("Sort [" in x for x in quench.quench(frame(spark), ["id"])._jdf.queryExecution().executedPlan().toString().splitlines()) == 3


def test_fixed_values(spark):
    """What results and SQL share, written out once more."""
    want = {
        "def": ("keyword", 0.85), "lambda": ("keyword", 0.85), "case": ("keyword", 0.85), "True": ("constant", 0.55), "cls": ("constant", 0.55),
        "Foo_1": ("capitalized", 0.78), "foo": ("identifier", 0.65), "_x9": ("identifier", 0.65), "12.5": ("number", 0.45), "7": ("number", 0.45), "0x1F": ("number", 0.45),
        "'a b'": ("string", 0.40), '"x"': ("string", 0.40), "+": ("operator", 0.30), "&": ("operator", 0.30), "(": ("punctuation", 0.15), ";": ("punctuation", 0.15),
        "#": ("punctuation", 0.15), " ": ("blank", 0.0), "?": ("symbol", 0.15), "\\": ("symbol", 0.15), "$": ("symbol", 0.15), "é": ("other", 0.1), "€": ("other", 0.1),
    }
    df = spark.createDataFrame([(t,) for t in want], "token string")
    got = {r.token: (r["class"], r.weight) for r in df.select("token", energy.token_class(F.col("token")).alias("class"), energy.structural_weight(F.col("token")).alias("weight")).collect()}
    assert got == want
    assert len(energy.KEYWORDS) == 29 and len(energy.CONSTANTS) == 5 and len(energy.TASK_VERBS) == 38 and {"review", "audit", "classify", "migrate", "upgrade"} <= set(energy.TASK_VERBS)
    assert (energy.CHUNK, energy.STRIDE, energy.DOMAIN_WEIGHT, energy.DOMAIN_WINDOW) == (30, 15, 0.10, 12)
    table = {n: (c.cooling_rate, c.similarity_threshold, c.min_tokens, c.energy_weights.w_statistical, c.energy_weights.w_structural, c.energy_weights.w_positional, c.dedup_enabled) for n, c in PROFILES.items()}
    assert table == {
        "maximum": (0.5, 0.72, 30, 0.6, 0.25, 0.15, True), "best": (0.25, 0.85, 50, 0.5, 0.3, 0.2, True), "mild": (0.15, 0.90, 100, 0.4, 0.35, 0.25, True), "code": (0.2, 0.85, 30, 0.4, 0.45, 0.15, True),
        "system": (0.6, 0.72, 30, 0.7, 0.15, 0.15, True), "output": (0.8, 0.68, 30, 0.7, 0.15, 0.15, False), "mcp": (0.15, 0.88, 80, 0.35, 0.45, 0.20, True),
    }
