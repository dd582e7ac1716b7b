"""Fingerprints, lexical search and the manifest, against brute force; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamarisk.llm import common, fingerprints, lexical, merkle, ordering
from tamarisk.llm import queries as Q

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "One", "one two", "Ünïcode wörds — naïve\tand 日本語 \U0001f600", "a b c d e f g h " * 40, "x\0y z", "!!!", "İ ß ǅ"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [words(80, k) for k in range(40)]
    near = [" ".join(w for k, w in enumerate(base[0].split()) if k != drop) for drop in range(60)]
    texts = ODD + base + near + [base[1].title()] * 30 + [words(20_000, 99)]
    rows = [(k * 3 % 211, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{min(k % 40, 19)}" if k % 3 else "hot", k) for k, t in enumerate(texts)]
    rows += [rows[14], rows[14], (None, "no id", "en", "s1", 0), (None, "no id either", None, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Columns with names that the operators use themselves.
    made = made.select("*", *[F.lit(1).alias(c) for c in ("rank", "fp", "key", "tree", "idx", "part")])
    path = f"{common.storage.shared_dir(spark)}/round3-docs"
    made.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_ranks(spark, docs):
    got = sorted((r["r"], r["doc_id"]) for r in ordering.ranked(docs.select("doc_id"), [F.col("doc_id").asc_nulls_last()]).withColumnRenamed("rank", "r").collect())
    assert [x for x, _ in got] == list(range(docs.count()))
    ids = [i for _, i in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None, None]
    rows = ordering.ranked_in_groups(docs.select("source", "doc_id"), "source", [F.col("doc_id")]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s, own in by.items():
        assert sorted(r["rank"] for r in own) == list(range(len(own))) and {r.group_rows for r in own} == {len(own)}
        assert {r.group_rank for r in own} == {order.index(s)}


def fingerprint(text):
    terms = [w for w in re.split(fingerprints.NO_WORD, (text or "").lower()) if w]
    up, every = np.zeros(64, np.int64), 0
    for a, b in zip(terms, [*terms[1:], None], strict=False):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)  # the hash so far is the next seed
        n = len(a) + len(b or "")
        up += n * np.array([h >> j & 1 for j in range(64)])
        every += n
    return sum(1 << j for j in range(64) if 2 * up[j] > every)


def test_fingerprints(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = fingerprints.edited(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    texts = [r.text or "" for r in order]
    prints = {t: fingerprint(t) for t in texts}
    every = np.array([prints[t] for t in texts], np.uint64)
    near = lambda t: int((np.bitwise_count(every ^ np.uint64(prints[t])) <= 3).sum()) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = []
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        if order[k].doc_id is None:
            continue  # two rows, in the order of their hashes
        if k + 1 < len(texts) and order[k + 1].doc_id is None:
            continue
        lost = len(t) // 2
        new = t[: len(t) - lost] + after[:lost]
        want.append((order[k].doc_id, len(t), hashlib.sha256(new.encode()).hexdigest(), signed(prints[t]), signed(fingerprint(new)), signed(prints[after]), near(t)))
    mine = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fp, r.edited_fp, r.next_fp, r.n_near) for r in got)
    # Repeated ids: equal texts, so their order changes nothing.
    assert not Counter(want) - mine
    assert max(r.n_near for r in got) >= 30
    assert sum(r.fp == 0 for r in got) == sum(not prints[t] for t in texts)


@pytest.mark.parametrize("radius,cell", [(3, 8), (3, 512), (1, 8), (5, 16)])
def test_neighbours_equal_brute_force(spark, radius, cell):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (4, 600), dtype=np.uint64), axis=0) * (r.random(600) < 0.9)
    values = np.unique(np.concatenate([base, base[r.integers(0, 3, 600)] ^ flips.astype(np.uint64)]))
    n = r.integers(1, 4, len(values))
    df = spark.createDataFrame([(int(v), int(k)) for v, k in zip(values.view(np.int64), n, strict=True)], "fp long, n long")
    got = {x.fp: x.n_near for x in fingerprints.neighbours(df, radius, cell).collect()}
    want = {int(v.view(np.int64)): int(n[(np.bitwise_count(values ^ v) <= radius)].sum() - n[k]) for k, v in enumerate(values)}
    assert got == {k: v for k, v in want.items() if v}


def test_fingerprint_query(spark):
    got = Q.op11_simhash_votes(spark, SF)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = got.collect()
    assert len(rows) == 200 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 16 for r in rows)
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.1
    assert "Python" not in got._jdf.queryExecution().toString()


def test_fingerprints_of_few_rows(spark, docs):
    assert fingerprints.edited(docs.filter("false")).count() == 0
    one = fingerprints.edited(spark.createDataFrame([(5, "abcd efg")], "doc_id long, text string")).first()
    assert (one.n_chars, one.edited_sha256, one.fp, one.n_near) == (8, hashlib.sha256(b"abcdabcd").hexdigest(), one.next_fp, 0)


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def searched(rows, items, k=10):
    held = [(r.doc_id, Counter(terms(r.text))) for r in rows]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for key, text in items:
        scored = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(key, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment,block,pairs", [(1 << 24, 256, 200_000), (3_000, 4, 200_000), (20_000, 16, 50)])
def test_search(spark, docs, monkeypatch, segment, block, pairs):
    monkeypatch.setattr(lexical, "BLOCK", block)
    items = [(1, words(12, 3)), (2, "ONE two"), (3, None), (4, ""), (5, "nowhere-to be found"), (6, words(300, 8)), (7, "日本語 — naïve"), (7, "b c")]
    given = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit(2))
    got = lexical.search(lexical.index(docs, segment=segment), given, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == searched(docs.collect(), items)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(lexical.index(docs.filter("false")), items).count() == 0
    assert lexical.search(lexical.index(docs), items.filter("false")).count() == 0
    assert lexical.search(lexical.index(docs.filter("text = '!!!'")), items).count() == 0


def test_a_long_text_is_cut_whole(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = words(500, 1) + " end"
    data = text.encode().translate(lexical._TABLE)
    assert [w for piece in lexical._cut(data) for w in piece] == data.split()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(level, arity):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, k, arity):
    out = []
    for level in levels[:-1]:
        base = k - k % arity
        out.append((level[base : base + arity], k % arity))
        k //= arity
    return out


def manifest(rows, met, arity):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in by[s]], arity))
    top = tree([t[-1][0] for t in trees], arity)
    out = []
    for j, s in enumerate(order):
        for k, r in enumerate(by[s]):
            steps = path(trees[j], k, arity) + path(top, j, arity)
            proof = H(*[h for run, slot in steps for i, h in enumerate(run) if i != slot])
            h = leaf(met(r))
            for run, slot in steps:
                h = H(*run[:slot], h, *run[slot + 1 :])
            out.append((r[0], leaf(r), trees[j][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=repr)


def tampered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return [*r[:4], r[4].translate(LOWER) if hit and r[4] is not None else r[4]]


@pytest.mark.parametrize("arity", [16, 2, 3])
def test_manifest(spark, docs, arity):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    again = F.when(common.crc_of_id(F.col("doc_id")) % 5 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    got = merkle.manifest(docs, {"text": again}, arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == manifest(rows, tampered, arity)


def test_manifest_of_few_rows(spark, docs):
    assert merkle.manifest(docs.filter("false")).count() == 0
    for where in ("doc_id = 3", "source = 'hot'", "source is null", "doc_id is null"):
        some = docs.filter(where)
        rows = [tuple(r) for r in some.select(*merkle.FIELDS).collect()]
        assert sorted((tuple(r) for r in merkle.manifest(some).collect()), key=repr) == manifest(rows, lambda r: r, 16)


def test_manifest_query(spark):
    got = Q.op13_merkle_manifest(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS).collect()]
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=repr) == manifest(rows, tampered, 16)
    assert len({x[3] for x in found}) == 1 and any(not x[6] for x in found)


def test_search_query(spark):
    got = [tuple(r) for r in Q.op12_hybrid_search(spark, SF).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(got, key=repr) == searched(spark.read.parquet(f"{SF}/documents.parquet").collect(), items)


def test_tables_of_other_threads_stay(spark):
    """What another thread writes meanwhile isn't deleted with this one's."""
    import threading

    kept = []
    with common.passing(spark):
        own = common.cut(spark.range(3), "mine")
        other = threading.Thread(target=lambda: kept.append(common.cut(spark.range(4), "theirs")))
        other.start()
        other.join()
        with common.passing(spark):
            inner = common.cut(spark.range(5), "inner")
    assert kept[0].count() == 4
    left = common.storage.folders(spark, own.cut_at.rsplit("/", 1)[0])
    assert kept[0].cut_at.rsplit("/", 1)[1] in left and not {x.cut_at.rsplit("/", 1)[1] for x in (own, inner)} & set(left)
