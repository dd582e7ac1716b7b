"""The operators on small tables, against brute force or a round trip."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tamarisk.llm import capsim, components, lang_id, mixing, packing, quality, sharding, simhash, tokens, url_filter, warc, wavelet
from tamarisk.llm import queries as Q

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "one two", "Ünïcode wörds — naïve\tand 日本語 \U0001f600", "a b c d e f g h " * 40, "x\0y z", "  two  spaces\n \n end "]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [words(60, k) for k in range(30)]
    near = [base[0].replace(base[0].split()[k], "changed", 1) for k in range(12)]
    texts = ODD + base + near + [base[1]] * 40 + [words(6000, 99)]
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{min(k % 5, 2)}", 0) for k, t in enumerate(texts)]
    rows += [rows[12], (None, "no id", "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def empty(docs):
    return docs.filter("false")


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def own_ids(texts, bpe=None):
    ids, sizes = (bpe or tokens.ByteBpe(tokens.vocabulary_path())).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    assert ends[-1] == len(ids)
    return [ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_tokens_equal_the_library(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["don't we'll", "'tis 's 'll''s x'st's", "ÿ ÿa b", "<|endoftext|> x", "a<|endoftext|><|endoftext|> \n<|endoftext|>b", "a\r\n b", "1234 ab12,.;", "a\u3000\u00a0 \n b\u0085", "x" * 3000 + "  \t" * 900]
    r = random.Random(6)
    letters = [*"ab1,' \n\t\x0b\x1c\u0085\u00a0\u2003\u3000éٌ日²😀", "<|endoftext|>", "  ", "'s", "'re"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    assert own_ids(texts) == encoded(texts)


def test_tokens_stay_the_same_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 40)
    monkeypatch.setattr(tokens, "SOME", 16)
    bpe = tokens.ByteBpe(tokens.vocabulary_path())
    for k in range(4):
        texts = [words(30, s) + " the same end." for s in (k, k + 1, 2)]
        assert own_ids(texts, bpe) == encoded(texts)
        assert len(bpe.at) <= 40 + 16


def test_packing(docs):
    rows = docs.collect()
    got = {}
    for p in packing.pack(docs).collect():
        assert p.length & (p.length - 1) == 0 and p.length <= 1024 and p.offset == 0 and len(p.ids) == 4 * p.length
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids), p.sequence_id))
    numbers = [n for ps in got.values() for _, _, n in ps]
    assert len(numbers) == len(set(numbers))
    for r, ids in zip(rows, encoded([r.text for r in rows]), strict=True):
        pieces = sorted(got[r.doc_id, len(ids) + 1])
        if rows.count(r) == 1:
            assert b"".join(x for _, x, _ in pieces) == packed([*ids, 0])
    assert packing.pack(empty(docs)).count() == 0


def test_pieces_are_the_binary_digits():
    sizes = np.array([1, 1023, 1024, 2500, *np.random.default_rng(0).integers(1, 6000, 200)])
    doc, start, length = packing.pieces(sizes)
    for k, n in enumerate(sizes):
        want = [1024] * (n // 1024) + [1 << b for b in range(9, -1, -1) if n % 1024 >> b & 1]
        assert length[doc == k].tolist() == want and start[doc == k].tolist() == (np.cumsum(want) - want).tolist()


def test_packing_buckets_and_columns(spark, docs, tmp_path):
    found = packing.pack(docs.withColumn("length", F.lit("clash")).withColumn("ids", F.lit(1)).drop("lang"))
    packing.write_buckets(found, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b")).select(*found.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, found.collect()))
    assert {p.name for p in (tmp_path / "b").iterdir() if p.is_dir()} == {f"length={r.length}" for r in found.select("length").distinct().collect()}


def test_wavelet_file():
    r = np.random.default_rng(1)
    ids = np.concatenate([r.zipf(1.4, 5000) % 50000, [0, 7, 7]]).astype("<u4")
    w = wavelet.WaveletMatrix(b"".join(wavelet.encode(ids, pa.table({"id": [5], "start": pa.array([0], pa.int64())}))))
    assert (w.decode() == ids).all() and [w.access(k) for k in (0, 17, 600, 5002)] == [int(ids[k]) for k in (0, 17, 600, 5002)]
    for token in (1, 2, 7, 49999, 1 << 20):
        at = np.flatnonzero(ids == token)
        assert w.count(token) == len(at) and w.rank(token, 700) == (at < 700).sum() and w.locate(token) == at.tolist()


def test_wavelet_shards(docs, tmp_path):
    docs = docs.union(docs).union(docs).union(docs)
    listed = wavelet.write(docs, str(tmp_path), shard_tokens=500)
    assert listed.count() > 1
    got = sorted(wavelet.read(listed).collect(), key=lambda r: r.start)
    order = [r.id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x)) and len(got) == docs.count()
    rows = docs.collect()
    want = sorted((str(r.doc_id), packed([*ids, 0])) for r, ids in zip(rows, encoded([r.text for r in rows]), strict=True))
    assert sorted((str(r.id), bytes(r.ids)) for r in got) == want
    starts = np.cumsum([0] + [len(r.ids) // 4 for r in got])[:-1]
    assert [r.start for r in got] == starts.tolist()
    assert wavelet.read(wavelet.write(empty(docs))).count() == 0


def fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(low[k : k + 3]) for k in range(len(low) - 2)] or ([b" ".join(low)] if low else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(n, near):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                parent[root(a)] = root(b)
    return [root(x) for x in range(n)]


def test_simhash(docs):
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    groups = linked(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {g: min((r.doc_id for r, h in zip(rows, groups, strict=True) if h == g and r.doc_id is not None), default=None) for g in groups}
    want = sorted((str(r.doc_id), f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups, strict=True))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("p"), "component").collect()
    assert sorted((str(r.doc_id), r.p, r.component) for r in got) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_simhash_takes_long_texts_and_other_columns(spark):
    long = words(60_000, 4)
    rows = [(1, long, "c"), (2, long, "c"), (3, long + " more words here", "c"), (4, "x" * 400_000, "c"), (None, "x" * 400_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component", F.lit(1)).withColumn("key", F.lit(2))
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, fingerprint(long), 1), (2, fingerprint(long), 1), (3, fingerprint(rows[2][1]), 1), (4, fingerprint("x" * 400_000), 4), (None, fingerprint("x" * 400_000), 4)}


def test_warc_takes_long_payloads_and_other_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    long = words(500_000, 9)
    pages = spark.createDataFrame([(1, "http://x/ 1\t a", long), (2, "u", long), (3, "u", "\n\r\n\r\nHTTP/1.1 \0")], "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("sha", F.lit(1))
    got = {r.page_id: r for r in warc.read(warc.write(pages, str(tmp_path)), payloads=True).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes, got[1].url) == ("revisit", 2, len(long), "http://x/ 1 a")
    assert bytes(got[2].payload) == long.encode() and bytes(got[3].payload) == b"\n\r\n\r\nHTTP/1.1 \0"


def test_near_duplicates_keep_one_row_a_group(spark, tmp_path):
    import corpus_pipeline as P

    text = [words(60, 200 + k) for k in range(9)]
    pairs = [(1, text[0]), (1, text[0]), (1, text[0]), (2, text[1]), (3, text[1]), (3, text[2]), (None, text[3]), (None, text[3]), (None, text[0]), (None, text[4]), (5, text[4]), (6, text[5]), (6, text[6]), (7, text[7]), (7, text[7].replace(text[7].split()[30], "changed")), (None, None), (8, "")]
    rows = [(i, t, "en", "s", 0) for i, t in pairs]
    prints = [fingerprint(t) for _, t in pairs]
    groups = linked(len(pairs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    best = {}
    for (i, _), g in zip(pairs, groups, strict=True):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    group = {(i, t): g for (i, t), g in zip(pairs, groups, strict=True)}
    docs.write.parquet(f"{tmp_path}/docs")
    for given in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        got = P.near_duplicates(spark, given, SF).collect()
        assert sorted(group[r.doc_id, r.text] for r in got) == sorted(set(groups))
        assert all((r.doc_id is None, r.doc_id or 0) == best[group[r.doc_id, r.text]] for r in got)
    assert P.near_duplicates(spark, empty(docs), SF).count() == 0


def test_simhash_cells_lose_no_link(spark):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            v ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    values = [v & (1 << 64) - 1 for v in signed]
    groups = linked(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)
    want = {}
    for v, g in zip(signed, groups, strict=True):
        want.setdefault(g, set()).add(v)
    for cell in (3, 8192):
        found = {}
        for row in components.components(simhash.links(prints, cell)).collect():
            found.setdefault(row.component, set()).add(row.node)
        assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def pairs_at(cosine, n, dims, seed=5):
    r = np.random.default_rng(seed)
    a, b = r.standard_normal((2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize(("dims", "words", "n"), [(16, 256, 2000), (64, 400, 2000), (64, 4000, 1000), (768, 400, 1000), (768, 2000, 500)])
def test_cap_filters_meet(dims, words, n):
    """Pairs at a cosine of 0.9 share a filter; unrelated ones rarely do."""
    f = capsim.Filters(dims, words)
    a, b = (f.decode(x) for x in pairs_at(0.9, n, dims))
    assert a.shape[1] == capsim.CODES * capsim.listed(words) and (np.diff(a) > 0).all()
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b, strict=True)]
    unrelated = [len(np.intersect1d(x, y)) > 0 for x, y in zip(a, np.roll(b, 1, axis=0), strict=True)]
    assert np.mean(met) >= 0.99 and np.mean(unrelated) < (0.08 if dims < 64 else 0.02)


def test_cap_filters_grow_with_the_table():
    assert [capsim.words_for(n) for n in (0, 100, 50_000, 10**6, 10**9)] == [256, 256, 707, 3162, 8192]
    assert capsim.listed(256) == capsim.listed(400) == 10 < capsim.listed(4000) < capsim.listed(8192) < 20


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cap_filters(spark, kind):
    r = np.random.default_rng(5)
    base = r.standard_normal((60, 64))
    rows = [x for x in base] + [base[k % 6] + 0.3 * r.standard_normal(64) for k in range(120)] + [base[0]] * 3 + [2 * base[1]]
    rows += [x for p in zip(*pairs_at(0.905, 60, 64), strict=True) for x in p] + [x for p in zip(*pairs_at(0.895, 60, 64), strict=True) for x in p]
    vectors = [(k, x.astype("f4" if kind == "float" else "f8").astype(float).tolist()) for k, x in enumerate(rows)]
    vectors += [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (905, [1.0, 2.0]), (None, vectors[2][1]), (7, vectors[8][1]), (906, [float("inf")] + [1.0] * 63), (907, [1.0, -0.0]), (908, [1.0, 0.0])]
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("n_links", F.lit("clash"))
    good = [(i, np.array(v, float)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)]
    near = lambda a, b: len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.9
    groups = linked(len(good), near)
    want = Counter((str(i), 0, str(i), True) for i, v in vectors if i is not None and i >= 900 and not any(i == g for g, _ in good))
    for k, (i, _) in enumerate(good):
        component = min(good[j][0] for j in range(len(good)) if groups[j] == groups[k] and good[j][0] is not None)
        want[str(i), sum(near(k, j) for j in range(len(good)) if j != k), str(component), i == component if i is not None else False] += 1
    for cell in (20, 1024):
        got = Counter((str(x.vec_id), x.n_links, str(x.component), x.kept) for x in capsim.near_duplicates(df, cell=cell).collect())
        assert sum(got.values()) == len(vectors) and sum((got - want).values()) <= 0.01 * len(vectors), (got - want, want - got)
    assert capsim.near_duplicates(df.filter("false")).count() == 0


def shard_key(text, doc_id):
    group = -1 if text is None else int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    return group, sharding.LOWEST if doc_id is None else doc_id


def check_shards(docs, shards, range_rows=sharding.RANGE_ROWS):
    """By brute force: slots follow the order within a shard, shards follow it but for
    texts of over a range's size, each text that fits is in one shard, and sizes are off
    by an overfull range on either side, or a record, at most."""
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode())): r.text for r in docs.collect()}
    got = sharding.shard(docs, shards=shards, range_rows=range_rows).collect()
    assert len(got) == docs.count() and {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    assert all(r.size == len((texts[r.doc_id, r.text_crc32] or "").encode()) + 8 for r in got)
    got.sort(key=lambda r: (r.shard, r.slot))
    keys = [shard_key(texts[r.doc_id, r.text_crc32], r.doc_id) for r in got]
    sizes, of_text = Counter(), Counter()
    for r, (group, _) in zip(got, keys, strict=True):
        sizes[r.shard] += r.size
        of_text[group] += r.size
    due = sum(sizes.values()) / max(sharding.PER_SHARD * shards, -(-len(got) // range_rows))
    assert all(a <= b for a, b, r, q in zip(keys, keys[1:], got, got[1:], strict=False) if r.shard == q.shard)
    small = [k for k in keys if of_text[k[0]] <= due]
    assert small == sorted(small)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in sizes)
    total = sum(sizes.values())
    due = total / max(sharding.PER_SHARD * shards, -(-len(got) // range_rows))
    slack = max([sharding.OVERFULL * due, *(r.size for r in got)])
    assert all(abs(sizes[s] - total / shards) <= slack for s in range(shards))
    return got, texts


def test_sharding(docs):
    check_shards(docs, 4, 10)
    assert sharding.shard(empty(docs)).count() == 0
    got = sharding.shard(docs.withColumn("Size", F.lit("mine")).withColumn("slot", F.lit(7)), carry=["doc_id", "Size", "slot"])
    assert got.columns == ["doc_id", "Size_given", "slot_given", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and {r.Size_given for r in got.collect()} == {"mine"}


def test_sharding_splits_hot_groups_and_keeps_small_ones(spark):
    rows = [(k, words(20, k)) for k in range(400)] + [(1000 + k, "the same text") for k in range(900)] + [(7777, "one repeated row")] * 900 + [(5000 + k, f"small group {k % 20}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, texts = check_shards(docs, 6)
    of = {}
    for r in got:
        of.setdefault(texts[r.doc_id, r.text_crc32], set()).add(r.shard)
    assert len(of["the same text"]) > 1 and len(of["one repeated row"]) > 1
    assert all(len(of[f"small group {k}"]) == 1 for k in range(20))


def test_sharding_keeps_a_text_whole_below_a_shard(spark):
    """Texts of .4, .6 and .97 of a shard lie in one shard each, one of 2.5 in as few
    as it needs, and sizes stay equal."""
    rows, due = [(k, words(12, k)) for k in range(3000)], 40_000
    for n, share in enumerate((0.4, 0.6, 0.97, 2.5)):
        text = f"group {n} " + words(30, 9000 + n)
        rows += [(10_000 * (n + 1) + k, text) for k in range(int(share * due / (len(text) + 8)))]
    shards = round(sum(len(t) + 8 for _, t in rows) / due)
    got, texts = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards)
    of = {}
    for r in got:
        of.setdefault(texts[r.doc_id, r.text_crc32], set()).add(r.shard)
    assert all(len(found) == 1 for text, found in of.items() if not text.startswith("group 3"))
    assert [len(found) for text, found in of.items() if text.startswith("group 3")][0] in (3, 4, 5)


def test_sharding_follows_its_splitters(docs):
    """Each record's range is the number of boundaries at or below its key, no range
    stays overfull, and other splitters give other shards."""
    records = sharding._records(docs, "doc_id", "text", ["doc_id"])
    bounds = sharding.splitters(records, 2, 10)
    at = sorted(tuple(r["at"]) for r in bounds.collect())
    met = sharding.ranged(records, bounds).collect()
    assert len(met) == docs.count() and all(r.range == sum(tuple(b) <= tuple(r.key) for b in at) for r in met)
    sums, many = Counter(), Counter()
    for r in met:
        sums[r.range] += r.size
        many[r.range] += 1
    due = sum(sums.values()) / (2 * sharding.PER_SHARD)
    assert all(n <= sharding.OVERFULL * due or many[k] == 1 for k, n in sums.items())
    few = sharding.ranged(records, bounds.limit(3)).select("range").distinct().count()
    assert few == 4 < len(sums)


def quality_by_hand(text):
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality.VOCABULARY))
    two = quality.second(public_tokenizers.path(quality.SECOND))
    w = (text or "").encode().split()
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    many = Counter(windows)
    again = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    base = len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)
    tokens_ = [t for x in w for t in pieces.encode(x.decode())]
    counts, n = Counter(tokens_), len(tokens_)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values()) if n else 0.0
    share = sum(map(pieces.is_byte, tokens_)) / sum(map(len, w)) if n else 0.0
    n_2 = sum(len(two.encode_ordinary(" " + x.decode())) for x in w)
    return base, (n, base[1] / n if n else 0.0, share, entropy, base[1] / n_2 if n_2 else 0.0)


def test_quality(docs):
    docs = docs.union(docs.sparkSession.createDataFrame([(700, "日本語のテキスト 漢字かな " * 30, "ja", None, 0), (701, words(50, 5) + " \U0001f600\U0001f4a9" * 12, "en", "s", 0)], docs.schema))
    by = {t: quality_by_hand(t) for t in {r.text for r in docs.collect()}}
    got = quality.judge(docs).collect()
    assert len(got) == docs.count() and max(len(t or "") for t in by) > 20_000
    for r in got:
        base, measures = by[r.text]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base and not (r.kept and r.base_failed)
        assert r.n_tokens == measures[0] and np.allclose((r.chars_per_token, r.byte_share, r.token_entropy, r.chars_per_token_2), measures[1:], atol=1e-9)
    assert any(r.byte_share > 0.1 for r in got) and quality.judge(empty(docs)).count() == 0
    clash = quality.judge(docs.withColumn("Kept", F.lit("mine")).withColumn("script", F.lit(3)))
    assert {"Kept_given", "script_given", "kept", "script"} <= set(clash.columns) and {r.Kept_given for r in clash.collect()} == {"mine"}


def test_quality_rejects_junk_and_keeps_clean(spark):
    """Junk that passes the base rules, among prose of two languages."""
    clean = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1 and toxic = 0"), "doc_id").filter("lang in ('en', 'de')").orderBy("doc_id").limit(1200).collect()]
    r = random.Random(8)
    base64_like = " ".join(base64.b64encode(r.randbytes(30)).decode() for _ in range(120))
    shuffled = " ".join("".join(r.sample(w, len(w))).upper() for w in clean[3][1].split()[:400])
    junk = [(-1, base64_like, "en"), (-2, " ".join("q" * r.randint(40, 90) for _ in range(200)), "en"), (-3, " ".join(r.choice(["buy", "now", "cheap"]) + str(r.randint(0, 3)) for _ in range(700)), "en"), (-4, shuffled, "de"), (-5, "".join(chr(r.randint(0x4E00, 0x9000)) + " " * (k % 3 == 0) for k in range(600)), "en")]
    got = quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).filter("not base_failed").collect()
    assert {r.doc_id for r in got if r.doc_id < 0} == {-1, -2, -3, -4, -5} and not any(r.kept for r in got if r.doc_id < 0)
    assert np.mean([r.kept for r in got if r.doc_id >= 0]) > 0.98


def test_quality_bands(spark):
    found = Q.op4_fertility(spark, "/root/testdata/sf0.1").filter("not base_failed").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    kept = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[0] < 0.15 and kept[1] > 0.985


def test_language(spark, docs):
    got = Q.op1_centroid_language(spark, "/root/testdata/sf0.01").filter("held_out").select("doc_id", "lang_pred").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.95
    model = lang_id.fit(docs)
    assert {r.lang_pred for r in lang_id.predict(docs.filter("text is null or text rlike '^[ \\n]*$'"), model).collect()} == {"und"}
    assert {r.lang_pred for r in lang_id.predict(docs, lang_id.fit(empty(docs))).collect()} == {"und"} and lang_id.predict(empty(docs), model).count() == 0


def test_language_is_the_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(9001, "Съешь же ещё этих мягких французских булок " * 9, None), (9002, "他们在学校里学习语言" * 20, None), (9003, "zxqj kwvx qzzk xjjq vkkw " * 30, None), (9004, "12 34 !?", "en"), (9005, "", "en"), (9006, None, "en"), (9007, words(8000, 3), None)], docs.schema))
    model = lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    assert model.centroids.shape[1] == lang_id.CENTROIDS * len(model.names)
    got = {r.doc_id: r for r in lang_id.predict(docs.drop("lang"), model).collect()}
    for r in docs.collect():
        own = got[r.doc_id]
        counts = lang_id.counts(r.text)
        if counts is None:
            assert (own.lang_pred, own.score, own.rejected) == ("und", 0.0, True) and not any(map(str.isalpha, r.text or ""))
            continue
        v = np.log1p(counts) * model.idf
        cosines = [float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for c in model.centroids.T.astype(float)]
        best = int(np.argmax(cosines))
        if sorted(cosines)[-1] - sorted(cosines)[-2] > 1e-5:
            assert own.lang_pred == model.names[model.owner[best]] and own.rejected == (cosines[best] < model.least[best])
        assert abs(own.score - min(1.0, max(0.0, cosines[best]))) < 1e-4
    # Far from all that was learned: other scripts, random letters. Learned texts aren't.
    assert all(got[k].rejected for k in (9001, 9002, 9003)) and np.mean([r.rejected for r in got.values() if r.doc_id < 9000]) < 0.02


def test_language_sample_is_bounded(spark):
    """However often an id or a text repeats; ties and clashing names do no harm."""
    rows = [(1, words(30, k), "aa") for k in range(300)] + [(2, words(30, 1), "aa")] * 300 + [(k, words(30, 1000 + k), "bb") for k in range(300)] + [(None, words(30, 7), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, again = lang_id.fit(docs, sample=20), lang_id.fit(docs.repartition(7), sample=20)
    assert model.names == ["aa", "bb"] and (model.centroids == again.centroids).all() and (model.idf == again.idf).all()
    got = lang_id.predict(docs.withColumn("Score", F.lit(5)), model)
    assert got.columns == ["doc_id", "text", "lang", "Score_given", "lang_pred", "score", "rejected"] and got.count() == len(rows)
    tie = lang_id.Model(["aa", "bb"], np.array([0, 1]), np.ones(lang_id.DIMENSIONS, np.float32), np.ones((lang_id.DIMENSIONS, 2), np.float32), np.zeros(2))
    assert tie.predict(["some text"])[0][0] == "aa"


def test_language_centroids_are_no_outliers():
    r = np.random.default_rng(4)
    rows = np.abs(r.standard_normal((90, 40))) * 0.1 + np.repeat(np.eye(40)[:3], 30, 0)
    rows = np.vstack([rows, np.eye(40)[39:]])  # one text unlike all others
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    own = (rows @ lang_id._clusters(rows, 3).T).argmax(1)
    assert np.bincount(own, minlength=3).min() > 5


def test_language_without_labels_keeps_texts(spark, docs):
    import corpus_pipeline as P

    lettered = sorted(str(r.doc_id) for r in docs.collect() if any(map(str.isalpha, r.text or "")))
    for lang in (F.lit(None), F.when(lang_id.held_out(F.col("doc_id")), "en")):
        got = P.language_id(spark, docs.withColumn("lang", lang.cast("string")), SF).collect()
        assert sorted(str(r.doc_id) for r in got) == lettered


def test_url_cascade(spark):
    hosts = [f"h{k}.example.org" for k in range(3000)]
    pages = spark.createDataFrame([(k, f"https://{h.upper() if k % 2 else h}/en/{k}?q#f") for k, h in enumerate(hosts)] + [(9000, None), (9001, "no scheme"), (9002, "ftp://WWW.Example.COM/en/x"), (9003, "http://a.net"), (9004, "x://com/?://y")], "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in hosts[::3]] + [(hosts[0],), ("elsewhere",)], "key string")
    for most in (url_filter.MOST_BYTES, 600):
        got = {r.page_id: r for r in url_filter.judge(pages, listed, most_bytes=most).collect()}
        assert all(got[k].listed == (k % 3 == 0) and got[k].host == h for k, h in enumerate(hosts))
        assert (got[9000].host, got[9000].path, got[9000].verdict) == ("", "", "allow") and got[9001].host == ""
        assert (got[9002].host, got[9002].path, got[9002].rule, got[9002].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
        assert (got[9003].path, got[9003].rule) == ("", None) and (got[9004].host, got[9004].path, got[9004].rule) == ("com", "/", "com/")
    universe = pages.select(url_filter.host(F.col("url")).alias("key")).distinct().join(listed.distinct().withColumn("listed", F.lit(True)), "key", "left").fillna(False)
    cascade = url_filter.build(universe)
    assert 1 < len(cascade.levels) and cascade.bytes < 3000 * url_filter.BITS_PER_KEY and url_filter.judge(pages.filter("false"), listed).count() == 0
    assert url_filter.parts_of(1000, 2000, 600) == 3 and url_filter.parts_of(10_000_000, 10**8) == 1 and url_filter.parts_of(10**9, 10**9) == 91
    assert not any("Join" in x for x in url_filter.judge(pages, listed)._jdf.queryExecution().executedPlan().toString().splitlines())
    more = url_filter.judge(pages.withColumn("HOST", F.lit(1)).withColumn("verdict", F.lit(2)), listed)
    assert more.columns == ["page_id", "url", "HOST_given", "verdict_given", "host", "path", "rule", "verdict", "listed"] and {r.HOST_given for r in more.collect()} == {1}


def test_a_full_part_of_the_cascade(spark):
    """A level of all that a part may have: exact, and not in the plan's text."""
    n = 8 * url_filter.MOST_BYTES // url_filter.BITS_PER_KEY - 1000
    universe = spark.range(n + 100_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") < n).alias("listed"))
    cascade = url_filter.build(universe)
    assert 0.9 * url_filter.MOST_BYTES < cascade.bytes
    judged = cascade.marked(universe.withColumnRenamed("listed", "wanted"), F.col("key"))
    assert len(judged._jdf.queryExecution().toString()) < 1 << 20
    assert judged.filter("wanted != listed").count() == 0


def test_long_and_repeated_urls(spark):
    long = "https://" + "a." * 50_000 + "Net/fr/" + "x" * 200_000 + "?" + "y" * 1000
    pages = spark.createDataFrame([(1, long), (1, long), (None, "https://net/fr/")], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame([], "key string")).collect()
    assert [(r.rule, r.verdict) for r in got] == [("net/fr/", "block")] * 3 and {len(r.path) for r in got} == {200_004, 4}


def test_warc(spark, tmp_path):
    html = [None, "", "same" * 50, "same" * 50, "same" * 50, "é" * 10] + [f"<html>{words(50, k)}</html>" for k in range(40)]
    rows = [(k, None if k == 3 else f"http://x/{k}", h) for k, h in enumerate(html)] + [(None, "u", "lonely"), (5, "http://x/5", "é" * 10), (-7, "neg", "n" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.read(warc.write(pages, str(tmp_path)), payloads=True).collect()), key=str)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -(1 << 70)), -(1 << 69) if i is None else i)
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        first = i is None or best[h or ""] == i
        want.append((i, u or "", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""], data if first else None))
    assert got == sorted(want, key=str)
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


def test_dictionary_sees_the_whole_archive(monkeypatch):
    """Records late in an archive, and the ends of long ones, are trained on too."""
    monkeypatch.setattr(warc, "TRAINING_BYTES", 200_000)
    first, last = [words(120, k).encode() for k in range(1500)], [words(60, 7).encode() + words(60, 5000 + k).encode() for k in range(1500)]
    parts = warc.archive(first + last)
    known, rest = warc.dictionary(first[:300]), sum(map(len, parts[1501:]))
    plain = zstandard.ZstdCompressor(level=3, dict_data=known)
    assert list(warc.records(b"".join(parts))) == first + last
    assert rest < 0.9 * sum(len(plain.compress(r)) for r in last)


def test_pfair_schedule():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.61, "b": 0.3, "c": 0.09}, {k: 1 + k for k in range(20)}):
        slots = mixing.slots_of(weights, 997)
        period, used = sum(slots.values()), dict.fromkeys(slots, 0)
        for source, k, slot, release, deadline in mixing.schedule(slots):
            assert release <= slot < deadline and k == used[source]
            used[source] += 1
            assert all(abs(used[s] - (slot + 1) * slots[s] / period) < 1 for s in slots)
        assert used == slots


def test_mix(docs):
    got = mixing.mix(docs, block_bytes=400, period=64).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert mixing.mix(empty(docs)).count() == 0 and mixing.mix(docs, {"s1": 1.0}).select("source").distinct().collect()[0][0] == "s1"


def test_mix_splits_repeated_rows_and_bounds_its_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rows = [(1, "one repeated row", "a")] * 400 + [(None, None, "a")] * 100 + [(k, words(8, k), "b") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Mix_slot", F.lit("mine"))
    got = mixing.mix(docs, {"a": 0.5, "b": 0.5}, block_bytes=200)
    assert got.columns[:4] == ["doc_id", "text", "source", "Mix_slot_given"]
    rows = got.collect()
    assert len({r.mix_block for r in rows if r.text == "one repeated row"}) > 20  # no block of its own
    size = lambda r: max(1, len((r.text or "").encode()))
    blocks = {"a": -(-(400 * 16 + 100) // 200), "b": -(-sum(size(r) for r in docs.filter("source = 'b'").collect()) // 200)}
    for r in rows:  # at each use the source is within a block of its half
        assert abs(r.mix_epoch * blocks[r.source] + r.mix_block + 1 - (r.mix_slot + 1) / 2) <= 1
    first = Counter((r.doc_id, r.text, r.source) for r in rows if r.mix_epoch == 0)
    assert first == Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    with pytest.raises(ValueError, match="times the corpus"):
        mixing.mix(docs, {"a": 1.0, "b": 1e-6}, block_bytes=200, most_times=50)
    assert mixing.mix(docs, {"a": 1.0, "b": 1e-6}, block_bytes=200, stop="first").count() > 0


def test_mix_gathers_uses_in_lots(spark, monkeypatch):
    """A source of one block that comes round hundreds of times: the same mix in
    lots of 16 uses as in one, and no row of the plan's lists is longer."""
    rows = [(1, "a small source", "a")] + [(k, words(8, k), "b") for k in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = lambda stop: Counter(map(tuple, mixing.mix(docs, {"a": 0.9, "b": 0.1}, block_bytes=300, stop=stop).collect()))
    for stop in ("all", "first"):
        monkeypatch.setattr(mixing, "USES", 10**9)
        whole = mixed(stop)
        monkeypatch.setattr(mixing, "USES", 16)
        assert mixed(stop) == whole and set(whole.values()) == {1}
        if stop == "all":
            assert sum(r[0] == 1 for r in whole) > 200


def test_mix_keeps_to_the_weights(docs):
    weights = {"s0": 0.61371, "s1": 0.385777, "s2": 0.0005, None: 0.000013}
    slots, total, used = mixing.slots_of(weights, mixing.SHARES), sum(weights.values()), dict.fromkeys(weights, 0)
    for source, k, slot, release, deadline in mixing.schedule(slots, 200_000):
        assert release <= slot < deadline and k == used[source]
        used[source] += 1
        assert all(abs(used[s] - (slot + 1) * w / total) < 1 for s, w in weights.items())
    assert used[None] in (2, 3)

    # The mix against brute force: each document at every turn of its block.
    weights = {"s0": 0.6137, "s1": 0.3813, "s2": 0.004, None: 0.001}
    rows, size = docs.collect(), 400
    bytes_of = lambda r: max(1, len((r.text or "").encode()))
    blocks = {s: -(-sum(bytes_of(r) for r in rows if r.source == s) // size) for s in weights}
    for stop in ("all", "first"):
        plan, ends = {}, []
        for source, k, slot, _, _ in mixing.schedule(mixing.slots_of(weights, mixing.SHARES), 300_000):
            plan[source, k] = slot
            ends += [slot] * (k == blocks[source])
            if len(ends) == (len(blocks) if stop == "all" else 1):
                break
        at = {}
        got = mixing.mix(docs, weights, block_bytes=size, stop=stop).collect()
        for r in got:
            assert plan[r.source, r.mix_epoch * blocks[r.source] + r.mix_block] == r.mix_slot < ends[-1] and r.mix_block == r.mix_place // size
            at.setdefault(r.source, {}).setdefault(r.mix_place, set()).add(bytes_of(r))
        want = [(s, k % blocks[s], slot) for (s, k), slot in plan.items() if slot < ends[-1]]
        turns = Counter((s, b) for s, b, _ in want)
        uses = Counter((r.source, r.mix_block, r.mix_place) for r in got)
        assert all(n == turns[s, b] for (s, b, _), n in uses.items())
        if stop == "all":
            for s in weights:  # places tile the source: no document is lost or twice at one
                places = sorted((p, min(n)) for p, n in at[s].items())
                assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and len(places) == sum(r.source == s for r in rows)


def test_paths_and_passing_tables(spark, tmp_path):
    from tamarisk.llm import common
    from tamarisk.sources import storage

    assert storage.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and common.filesystem(f"file:{tmp_path}/x")[1] == common.filesystem(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"
    kept = common.cut(spark.range(3), "kept")
    with common.passing(spark):
        inside = common.cut(spark.range(4), "inside")
        common.forget(common.cut(spark.range(5), "gone"))
    names = storage.folders(spark, f"{storage.shared_dir(spark)}/tamarisk")
    assert kept.count() == 3 and kept.cut_at.rsplit("/", 1)[1] in names and inside.cut_at.rsplit("/", 1)[1] not in names and not any(n.startswith("gone") for n in names)


def as_counter(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)


def test_pipeline(spark, docs, tmp_path):
    """Each stage on what the one before it kept, against brute force."""
    import corpus_pipeline as P

    extra = [(800, "Съешь же ещё этих мягких французских булок и выпей чаю " * 5, None, "s1", 0), (801, words(80, 801) + " " + words(80, 801), "en", "s2", 0)]
    start = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("kept", F.lit("x")).withColumn("rejected", F.lit(1)).withColumn("mix_slot", F.lit(2)).withColumn("length", F.lit(3))
    kept = start
    for name, stage in P.STAGES:
        before = kept.collect()
        stage(spark, kept, SF).write.parquet(str(tmp_path / name.replace(" ", "-")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        none = stage(spark, kept.filter("false"), SF)
        assert none.count() == 0 and none.columns == out.columns
        rows = out.collect()
        if name != "packing":
            assert out.columns == P.COLUMNS
        if name == "quality rules":  # too few rows for learned bands: the wide ones
            def good(r):
                base, (n, chars, share, entropy, second) = quality_by_hand(r.text)
                low, high, most, least = quality.BANDS[quality.script(r.text or "")]
                return not base[-1] and low <= chars <= high and low <= second <= high and share <= most and (entropy >= least or n < quality.ENTROPY_TOKENS)

            assert as_counter(rows) == as_counter(r for r in before if good(r)) and 801 not in {r.doc_id for r in rows}
        if name == "language ID":
            model = lang_id.fit(kept.filter(~lang_id.held_out(F.col("doc_id"))))
            far = [reject for _, _, reject in model.predict([r.text for r in before])]
            assert as_counter(rows) == as_counter(r for r, reject in zip(before, far, strict=True) if not reject)
        if name == "SimHash near-dedup":
            prints = [fingerprint(r.text) for r in before]
            groups = linked(len(before), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)  # noqa: B023
            best = {}
            for r, g in zip(before, groups, strict=True):
                best[g] = min(best.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(best.values()) and len(rows) < len(before)
        if name == "mixing sources to target weights":
            mixed = as_counter(mixing.mix(kept).collect())
            assert as_counter(rows) == mixed and set(mixed) == set(as_counter(before))
        if name == "packing":
            want = Counter()
            for r, ids in zip(before, encoded([r.text for r in before]), strict=True):
                own = [*ids, 0]
                at = 0
                for size in [1024] * (len(own) // 1024) + [1 << b for b in range(9, -1, -1) if len(own) % 1024 >> b & 1]:
                    want[r.doc_id, at, size, packed(own[at : at + size]), len(own)] += 1
                    at += size
            assert Counter((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in rows) == want
        kept = out
