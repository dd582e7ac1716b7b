"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import capsim, fingerprints, lang_id, lexical, merkle, mixing, packing, quality, sharding, simhash, url_filter, warc, wavelet
from tamarisk.llm.common import crc_of_id, table


def op1_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.filter(~held_out))
    return lang_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.hosts_with(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


OP2_SQL = """
WITH h AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/'
  END AS rule,
  regexp_matches(host, 'pills|casino|poker|porn|viagra|lottery|loan') AS listed
  FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM r
"""


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base 32 takes five hexadecimal digits to four of its own.
OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, url FROM pages),
d AS (SELECT *, strlen(payload)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS best,
        array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
          lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || sha1(payload)[5 * g + 1 : 5 * g + 5])::BIGINT >> s) % 32 + 1]), '')), '') AS payload_digest
      FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to, regexp_replace(trim(coalesce(url, '')), '\s+', ' ', 'g') AS url
FROM d
"""


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capsim.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = wavelet.read(wavelet.write(table(spark, sf_dir, "documents")))
    return read.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_simhash_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", simhash.hexadecimal(own).alias("fingerprint"), simhash.hexadecimal(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"), fingerprints.likeness(own, after).alias("near_next"), "n_near",
    )


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, rowid AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
), u AS (SELECT r, doc_id, len(w) AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM u),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY ALL),
b AS (SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
      FROM (SELECT *, row_number() OVER () AS item FROM benchmark)),
d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM b) GROUP BY term),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM d, c),
s AS (
  SELECT item, item_id, u.r, u.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * u.n * c.big_n) // c.big_l))))::BIGINT AS score
  FROM b JOIN f USING (term) JOIN p USING (term) JOIN u USING (r), c GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row (by the id's CRC) is met again with its text's A-Z lower-cased."""
    again = F.when(crc_of_id(F.col("doc_id")) % 5 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), {"text": again})


def _merkle_sql(depth: int = 7) -> str:
    """Sixteen to the depth: the rows of the largest source, and sources, at most."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([field(c) for c in ("doc_id", "source", "lang", "n_chars")] + [field(text)]) + ")"
    bits = "list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda h: ascii(h)::BIGINT), lambda c, b: {bits}), 4294967295)"

    def levels(name: str, start: str, keys: str) -> list[str]:
        """CTEs name0, name1, ...: each level, those of finished trees as they are."""
        out = [f"{name}0 AS ({start})"]
        for k in range(depth):
            out.append(f"{name}{k + 1} AS (SELECT {keys}, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h, (any_value(n) + 15) // 16 AS n, any_value(n) > 1 AS joined, list(h ORDER BY idx) AS run FROM {name}{k} GROUP BY {keys}, idx // 16)")
        return out

    def climb(source: str, name: str, keys: list[str], idx: str, out: str) -> list[str]:
        """CTEs that take rows with acc (siblings so far) and f (the folded hash) up."""
        steps, last = [], source
        on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
        for k in range(depth):
            slot = f"(a.{idx} // {16**k}) % 16"
            steps.append(f"""{out}{k} AS (SELECT a.* REPLACE (CASE WHEN b.joined THEN a.acc || array_to_string(list_filter(b.run, lambda h, i: i - 1 <> {slot}), '') ELSE a.acc END AS acc,
  CASE WHEN b.joined THEN sha256(array_to_string(b.run[:{slot}], '') || a.f || array_to_string(b.run[{slot} + 2:], '')) ELSE a.f END AS f)
  FROM {last} a JOIN {name}{k + 1} b ON {on} AND b.idx = a.{idx} // {16 ** (k + 1)})""")
            last = f"{out}{k}"
        return steps

    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf('text')} END AS met FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, met) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d)",
        *levels("s", "SELECT source, idx, leaf AS h, n FROM l", "source"),
        f"u AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n FROM s{depth})",
        *levels("r", "SELECT 0 AS one, tree AS idx, subroot AS h, n FROM u", "one"),
        "a AS (SELECT l.*, u.subroot, u.tree, 0 AS one, '' AS acc, met AS f FROM l JOIN u ON l.source IS NOT DISTINCT FROM u.source)",
        *climb("a", "s", ["source"], "idx", "p"),
        *climb(f"p{depth - 1}", "r", ["one"], "tree", "q"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(acc) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{depth - 1} JOIN r{depth} ON true"


ALL = (op1_centroid_language, op2_url_cascade, op3_sampled_splitters, op4_fertility, op5_warc_dictionary, op6_cap_filters, op7_pfair_mix, op8_wavelet_tokens, op9_binary_packing, op10_simhash, op11_simhash_votes, op12_hybrid_search, op13_merkle_manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_cascade": OP2_SQL, "op5_warc_dictionary": OP5_SQL, "op12_hybrid_search": OP12_SQL, "op13_merkle_manifest": _merkle_sql()}
