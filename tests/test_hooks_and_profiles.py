"""Functions of the caller's, profiles that rows name, passes over arrays, the store after a call."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tamarisk.config import PROFILES, QuenchConfig
from tamarisk.functions import arrays
from tamarisk.operators import dedup, energy, memory, quench

LONG = "some words that are many enough to be quenched here and there, with a few more of them"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG + " one"), (2, LONG + " two"), (3, "short"), (4, "日本 語の 文 だけ が ここ に あり ます よ ね か"), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def compressed(docs, **hooks):
    return {r.doc_id: r for r in memory.compress(docs, ["doc_id"], "doc_id", **hooks).collect()}


def test_hooks_take_the_place_of_the_librarys_own(docs):
    plain = compressed(docs)
    same = compressed(docs, energy_fn=memory.estimated, quench_fn=lambda rows, keys, config: quench.scheduled(rows, keys, config).groupBy(*keys).agg(F.sum(F.col("kept").cast("int")).alias("tokens_kept")))
    assert same == plain
    none = compressed(docs, quench_fn=lambda rows, keys, config: rows.groupBy(*keys).agg(F.lit(1).alias("tokens_kept")))
    assert [none[k].tokens_after_quench for k in (1, 2, 3, 4)] == [1, 1, 1, 0]  # one word; no token at all


@pytest.mark.parametrize("fault", [
    lambda rows, keys, config: rows.groupBy(*keys).agg(F.lit(1).alias("tokens_kept")).filter("doc_id = 1"),
    lambda rows, keys, config: rows.select(*keys, F.lit(1).alias("tokens_kept")),
    lambda rows, keys, config: rows.groupBy(*keys).agg(F.lit(None).cast("int").alias("tokens_kept")),
    lambda rows, keys, config: rows.select((F.col("doc_id") + 7).alias("doc_id")).distinct().withColumn("tokens_kept", F.lit(1)),
    lambda rows, keys, config: rows.groupBy(*keys).agg(F.lit(-1).alias("tokens_kept")),
])
def test_a_quenching_function_that_breaks_the_contract(docs, fault):
    with pytest.raises(PySparkException, match="each text one row"):
        compressed(docs, quench_fn=fault)


@pytest.mark.parametrize("fault", [
    lambda rows: rows.filter("idx > 0"), lambda rows: rows.filter("idx < n - 1"), lambda rows: rows.union(rows.filter("idx = 1")),
    lambda rows: rows.withColumn("energy", F.when(F.col("idx") != 3, F.col("energy"))), lambda rows: rows.withColumn("energy", F.lit(float("nan"))),
])
def test_an_energy_function_that_breaks_the_contract(docs, fault):
    with pytest.raises(PySparkException, match="keep each token"):
        compressed(docs, energy_fn=lambda *given: fault(memory.estimated(*given)))


def test_missing_columns(docs):
    with pytest.raises(ValueError, match="tokens_kept"):
        compressed(docs, quench_fn=lambda rows, keys, config: rows)
    with pytest.raises(ValueError, match="energy"):
        compressed(docs, energy_fn=lambda *given: memory.estimated(*given).drop("energy"))


def test_the_store_after_a_call(spark, docs):
    again = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10))
    before = memory.store(docs.filter("doc_id = 1"), ["doc_id"])
    got = {r.text: r.access_count for r in memory.remembered(again, ["doc_id"], "doc_id", memory=before).collect()}
    assert got == {r.text: 2 if r.doc_id == 1 else 1 for r in docs.collect()}


def test_profiles(docs):
    every = {(r.doc_id, r.profile): r for r in quench.quench_profiles(docs, ["doc_id"], PROFILES).collect()}
    assert len(every) == 5 * len(PROFILES)
    for name, config in PROFILES.items():
        for r in quench.quench(docs, ["doc_id"], config=config).collect():
            own = every[r.doc_id, name]
            assert (own.compressed_text, own.tokens_kept, own.similarity_score, own.schedule_steps) == (r.compressed_text, r.tokens_kept, r.similarity_score, r.schedule_steps)
    names = F.when(F.col("doc_id") < 3, "maximum").otherwise("mcp")
    own = quench.quench_profiles(docs.withColumn("mine", names), ["doc_id"], PROFILES, profile="mine").collect()
    assert {(r.doc_id, r.profile) for r in own} == {(k, "maximum" if k < 3 else "mcp") for k in range(1, 6)}
    assert all(every[r.doc_id, r.profile].compressed_text == r.compressed_text for r in own)


def test_a_sweep_reads_once(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    read = docs.sparkSession.read.parquet(str(tmp_path / "docs"))
    rows = quench.scheduled(energy.profiled(read, ["doc_id"], PROFILES), ["doc_id", "profile"], quench.Schedule.of(PROFILES))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_unknown_profiles(docs):
    for name in (F.lit("nosuch"), F.lit(None).cast("string")):
        with pytest.raises(PySparkException, match="profile"):
            quench.quench_profiles(docs.withColumn("mine", name), ["doc_id"], PROFILES, profile="mine").collect()
    with pytest.raises(ValueError):
        quench.Schedule.of({"x": QuenchConfig(survival_mode="boltzmann")})


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_scan(spark, n):
    items = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i) if n else F.array().cast("array<int>")
    step = lambda carry, x: (carry + x, F.when((carry + x) % 2 == 0, F.array(carry + x)).otherwise(F.array().cast("array<long>")))
    got = spark.range(1).select(arrays.scan(items, F.lit(0).cast("long"), step, "array<long>").alias("s")).first().s
    sums = [k * (k + 1) // 2 for k in range(1, n + 1)]
    assert got.carry == (sums[-1] if sums else 0) and got.outs == [s for s in sums if s % 2 == 0]


def test_blocks_and_references_of_many_paragraphs(spark):
    paragraphs = [f"paragraph {k % 700}" + " and longer than eighty characters, so that it is a block of its own here" * (k % 3 == 0) for k in range(4000)]
    row = spark.createDataFrame([(1, "\n\n".join(paragraphs))], "k long, text string")
    want, held = [], None
    for p in paragraphs:
        merged = p if held is None else held + "\n\n" + p
        if len(p) >= 80:
            want += [p] if held is None else [held, p]
            held = None
        elif len(merged) >= 80:
            want.append(merged)
            held = None
        else:
            held = merged
    want += [held] if held is not None else []
    assert row.select(dedup.blocks(F.col("text"))).first()[0] == want
    normal = [" ".join(b.split()) for b in want]
    shown = "\n\n".join(b if normal.index(b) == k else f"[↳ see block {normal.index(b)}]" for k, b in enumerate(normal))
    assert row.select(dedup.dedup_text(F.col("text"))).first()[0] == shown
