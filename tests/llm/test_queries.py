"""The registered queries on a small scale, their columns against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tamarisk.llm import queries as Q
from tamarisk.llm import tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def told(table):
    return duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").fetchall(), duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").columns


@pytest.fixture(scope="module")
def documents():
    rows, names = told("documents")
    return {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in rows}


@pytest.fixture(scope="module")
def ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return {k: t.encode(d["text"] or "", add_special_tokens=False).ids + [0] for k, d in documents.items()}


def crc(numbers):
    return zlib.crc32(struct.pack(f"<{len(numbers)}I", *numbers))


def grouped(names, linked):
    """The smallest name that each reaches; linked: pairs."""
    up = {n: n for n in names}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in names}


def test_op1(spark, documents):
    got = Q.op1_centroid_language(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(documents.keys())
    langs = {d["lang"] for k, d in documents.items() if d["lang"] is not None and zlib.crc32(str(k).encode()) % 4 != 2}
    right = total = 0
    for r in got:
        d = documents[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, d["text"] or ""))
        assert r.lang_pred in langs if letters else r.lang_pred == "und"
        if r.held_out and letters and d["lang"] is not None and not r.rejected:
            total, right = total + 1, right + (r.lang_pred == d["lang"])
    assert right >= 0.95 * total > 0


def test_op3(spark, documents):
    got = Q.op3_sampled_splitters(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(documents.keys())
    slots = defaultdict(list)
    for r in got:
        text = (documents[r.doc_id]["text"] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_op4(spark, documents):
    got = Q.op4_fertility(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(documents.keys())
    for r in got:
        text = documents[r.doc_id]["text"] or ""
        own = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for k in range(len(own) - 7):
            at[tuple(own[k : k + 8])].append(k)
        again = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(8)}
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(own) < 20 or 100 * len(again) > 30 * len(own)) and not (r.base_failed and r.kept)


def test_op5(spark, tmp_path):
    """Half of the pages come twice, one payload three times, some are null."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE pages AS SELECT * FROM '{SF}/pages.parquet'")
    con.sql("INSERT INTO pages SELECT page_id + 1000, url || '  x', html FROM pages WHERE page_id % 2 = 0")
    con.sql("INSERT INTO pages SELECT 5000, NULL, html FROM pages WHERE page_id = 2 UNION ALL SELECT page_id + 6000, url, NULL FROM pages WHERE page_id < 3")
    con.sql(f"COPY pages TO '{tmp_path}/pages.parquet'")
    want = con.sql(Q.OP5_SQL)
    got = Counter(map(tuple, Q.op5_warc_dictionary(spark, str(tmp_path)).select(*want.columns).collect()))
    assert got == Counter(want.fetchall()) and sum(r[3] == "revisit" for r in got) > 20


def test_op6(spark, tmp_path):
    """The table, in which few vectors are near, with noisy copies at several angles."""
    rows, names = told("embeddings")
    vectors = {r[names.index("vec_id")]: r[names.index("embedding")] for r in rows}
    random = np.random.default_rng(5)
    for k, v in list(vectors.items())[:200]:
        if v is not None and None not in v and np.isfinite(v).all() and any(v):
            noise = random.standard_normal(len(v))
            away = np.linalg.norm(v) / np.linalg.norm(noise) * random.choice([0.0, 0.2, 0.4, 0.6])
            vectors[10_000 + k] = (np.array(v) + away * noise).astype("f4").tolist()
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [k for k, v in vectors.items() if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[k] for k in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    links = Counter(good[k] for k in near.ravel())
    group = grouped(vectors, [(good[a], good[b]) for a, b in near])
    got = Q.op6_cap_filters(spark, str(tmp_path)).collect()
    assert Counter(r.vec_id for r in got) == Counter(vectors.keys()) and len(near) > 50
    wrong = sum((r.n_links, r.component_id, r.kept) != (links[r.vec_id], group[r.vec_id], r.vec_id == group[r.vec_id]) for r in got)
    assert wrong <= 0.01 * len(got)


def test_op7(spark, documents):
    got = Q.op7_pfair_mix(spark, SF).collect()
    assert {r.doc_id for r in got} == set(documents) and all(r.source == documents[r.doc_id]["source"] and r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert Counter(r.doc_id for r in got if r.mix_epoch == 0) == Counter(documents.keys())


def test_op8(spark, documents, ids):
    start, want = 0, []
    for k in sorted(documents):
        want.append((k, start, len(ids[k]), crc(ids[k])))
        start += len(ids[k])
    assert sorted(map(tuple, Q.op8_wavelet_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_op9(spark, documents, ids):
    got = Q.op9_binary_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    assert set(pieces) == set(documents)
    for own, ends in [(sorted(p), len(ids[k])) for k, p in pieces.items()] + [(sorted(s), None) for s in sequences.values()]:
        at = 0
        for start, length in own:
            assert start == at
            at += length
        assert at == ends if ends is not None else at <= 1024
    used = sum(n for s in sequences.values() for _, n in s)
    padded = sum(n if (n := sum(x for _, x in s)) & (n - 1) == 0 else 1024 for s in sequences.values())
    assert used == sum(map(len, ids.values())) and padded <= 1.05 * used


def test_op10(spark, documents):
    prints = {}
    for k, d in documents.items():
        own = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), d["text"] or ""))
        grams = [" ".join(own[j : j + 3]) for j in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    names = sorted(prints)
    group = grouped(names, [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = Q.op10_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == [(k, f"{prints[k]:016x}", group[k]) for k in names]


def test_op2_op12_op13_equal_their_sql(spark):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name in ("op2_url_cascade", "op12_hybrid_search", "op13_merkle_manifest"):
        want = con.sql(Q.oracle_sql()[name])
        got = Counter(map(tuple, Q.queries()[name](spark, SF).select(*want.columns).collect()))
        assert got == Counter(want.fetchall()) and sum(got.values()) > 0, name


def test_op11(spark, documents):
    got = {r.doc_id: r for r in Q.op11_simhash_votes(spark, SF).collect()}
    order = sorted(documents, reverse=True)
    by_text = defaultdict(set)
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        text, other, r = documents[k]["text"] or "", documents[after]["text"] or "", got[k]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert math.isclose(r.near_edited, like(r.fingerprint, r.edited_fingerprint)) and math.isclose(r.near_next, like(r.fingerprint, got[after].fingerprint))
        by_text[text].add(r.fingerprint)
    assert set(got) == set(documents) and all(len(f) == 1 for f in by_text.values())
