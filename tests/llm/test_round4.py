"""Thresholds and models from every row: held against numpy over the whole table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import words

from tamarisk.llm import lang_id, ordering, quality


def robust(x):
    middle = float(np.median(x))
    return middle, 1.4826 * float(np.median(np.abs(x - middle)))


def bands_by_hand(rows):
    """rows: n_tokens, chars_per_token, byte_share, token_entropy, chars_per_token_2
    of distinct texts, in the order of their keys."""
    x = np.array(rows)
    ends = []
    for k in (1, 4):
        middle, spread = robust(x[:, k])
        spread = quality.WIDTH * max(spread, quality.SPREADS[0] * middle)
        ends += [middle - spread, middle + spread]
    share, more = robust(x[:, 2])
    x = x[np.argsort(x[:, 0], kind="stable")]
    sizes, least = [], []
    for own in np.array_split(x, max(1, min(quality.CLASSES, len(x) // quality.CLASS))):
        usual, around = robust(own[:, 3])
        sizes.append(float(np.median(np.log2(own[:, 0]))))
        least.append(usual - quality.ENTROPY_WIDTH * max(around, quality.SPREADS[2]))
    return ends, share + quality.WIDTH * max(more, quality.SPREADS[1]), sizes, least


def test_quality_bands_from_every_row(spark):
    """More texts of a language than a sample held, copies and labels in plenty. What
    is kept is what bands over all texts keep."""
    r = random.Random(2)
    plain = "the people of this country went to school with other children and found water there under some trees near house while many letters from another mother would come after that small town had been given three large white horses without any right answer".split()

    def text(k):
        odd = k % 500 / 500 if k % 5 == 0 else 0.0  # one in five between plain words and odd ones
        return " ".join(r.choice(["%04d", "q%dz", "é%dß"]) % r.randint(0, 999) if r.random() < odd else w for w in r.choices(plain, k=r.randint(22, 60)))

    rows = [(k, text(k), "aa" if k < 2600 else f"l{k % 120:03d}") for k in range(3400)] + [(k, None, "aa") for k in range(5)]
    rows += [(9000 + k, rows[7][1], ["aa", None][k % 2]) for k in range(300)]  # copies count once
    rows += [(9900 + k, text(k), None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = quality.judge(docs).withColumn("of", F.xxhash64("text")).collect()
    assert sorted((x.doc_id, x.text or "", x.lang or "") for x in got) == sorted((a, b or "", c or "") for a, b, c in rows)
    groups = {}
    for x in got:
        if not x.base_failed:
            for key in [("s", x.script)] + ([("l", x.lang)] if x.lang else []):
                groups.setdefault(key, {})[x.of] = (x.n_tokens, x.chars_per_token, x.byte_share, x.token_entropy, x.chars_per_token_2)
    assert len(groups["l", "aa"]) > 2000
    bands = {key: bands_by_hand([own[of] for of in sorted(own)]) for key, own in groups.items() if len(own) >= quality.LEAST}
    assert set(bands) == {("l", "aa"), ("s", "latin")}
    odd = 0
    for x in got:
        low, high, most, least = quality.BANDS[x.script]
        want = not x.base_failed and low <= x.chars_per_token <= high and low <= x.chars_per_token_2 <= high and x.byte_share <= most and (x.token_entropy >= least or x.n_tokens < quality.ENTROPY_TOKENS)
        band = bands.get(("l", x.lang)) or bands.get(("s", x.script))
        edges = []
        if want:
            ends, share, sizes, leasts = band
            size = np.log2(x.n_tokens)
            lowest = float(np.interp(size, sizes, leasts)) - max(0.0, sizes[0] - size)
            edges = [x.chars_per_token - ends[0], ends[1] - x.chars_per_token, x.chars_per_token_2 - ends[2], ends[3] - x.chars_per_token_2, share - x.byte_share, x.token_entropy - lowest]
            want = min(edges) >= 0
            odd += not want
        if not edges or min(map(abs, edges)) > 1e-9:
            assert x.kept == want, x.doc_id
    assert odd > 20


def test_quality_carries_what_is_asked(spark):
    docs = spark.createDataFrame([(1, words(40, 1), "aa", "x"), (2, None, None, "y")], "doc_id long, text string, script string, band_l string")
    got = quality.judge(docs, lang_col="script", carry=["doc_id", "script", "band_l"])
    assert got.columns[:4] == ["doc_id", "script_given", "band_l", "n_words"] and "text" not in got.columns
    assert {(r.doc_id, r.script_given, r.band_l, r.kept) for r in got.collect()} == {(1, "aa", "x", True), (2, None, "y", False)}


@pytest.mark.parametrize("part", [0.0, 0.01, 0.5, 1.0])
def test_quantiles_are_exact(spark, part):
    r = random.Random(5)
    own = {g: [r.choice([0.0, r.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 400), ("c", 77), ("d", 2))}
    rows = spark.createDataFrame([(g, v, k) for g, x in own.items() for k, v in enumerate(x)], "key string, value double, of long").repartition(6)
    got = {x.key: x.value for x in ordering.quantile(ordering.ranked_in_groups(rows, "key", [F.col("value"), F.col("of")]), part).collect()}
    assert set(got) == set(own) and all(abs(got[g] - float(np.quantile(x, part))) < 1e-12 for g, x in own.items())


def test_language_model_from_every_row(spark, monkeypatch):
    """More rows of a language than a sample held, against numpy over all of them;
    any order of rows gives the same model, however few sums a task holds."""
    r = random.Random(4)
    alphabets = {"aa": ("abcdef", "ghijkl", "mnopqr"), "bb": ("stuvwx", "äöüßéè", "жизнью"), "cc": ("日本語学校生",)}
    rows = []
    for lang, groups in alphabets.items():
        for k in range({"aa": 700, "bb": 450, "cc": 1}[lang]):
            letters = groups[k % len(groups)]
            rows.append((len(rows), " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(r.randint(20, 60))), lang))
    rows += [(9000 + k, rows[5][1], "aa") for k in range(50)] + [(9100, "12 34", "aa"), (9101, None, "bb"), (9102, rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs.repartition(3))
    own = {lang: np.stack([c for _, t, x in rows if x == lang and (c := lang_id.counts(t)) is not None]) for lang in alphabets}
    every = np.concatenate(list(own.values()))
    assert len(every) == 1201
    idf = (np.log((1 + len(every)) / (1 + (every > 0).sum(0))) + 1).astype(np.float32)
    assert (model.idf == idf).all() and model.names == list(alphabets) and model.owner.tolist() == [0, 0, 0, 1, 1, 1, 2]
    at = 0
    for found in own.values():
        vectors = lang_id._vectors(found, idf)
        want = lang_id._clusters(vectors, min(lang_id.CENTROIDS, len(vectors)))
        cosines = vectors @ want.T
        nearest = cosines.argmax(1)
        k = len(want)
        match = (want @ model.centroids[:, at : at + k]).argmax(1)
        assert sorted(match) == list(range(k))
        for c, m in enumerate(match):
            assert want[c] @ model.centroids[:, at + m] > 0.9999
            assert abs(model.least[at + m] - lang_id.FAR * np.quantile(cosines[nearest == c, c], 0.01)) < 1e-3
        at += k
    monkeypatch.setattr(lang_id, "HELD", 1)
    monkeypatch.setattr(lang_id, "FAN", 2)
    again = lang_id.fit(docs.repartition(7))
    assert (model.centroids == again.centroids).all() and (model.idf == again.idf).all() and (model.least == again.least).all()


def test_pipeline_learns_from_every_row(spark, monkeypatch):
    """No stage asks for a bounded part of its rows."""
    import corpus_pipeline as P

    seen = []
    learned = lang_id._fit
    monkeypatch.setattr(lang_id, "_fit", lambda known: seen.append(known.count()) or learned(known))
    docs = spark.createDataFrame([(k, words(30, k), "aa", "s", 0) for k in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.language_id(spark, docs, "").count() <= 2000
    assert seen == [docs.filter(~lang_id.held_out(F.col("doc_id"))).count()] and seen[0] > 1400
