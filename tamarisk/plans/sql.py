"""DuckDB SQL that the queries are checked against, written apart from them."""

from __future__ import annotations

from tamarisk.config import PROFILES, QuenchConfig, output_config
from tamarisk.operators.energy import CLASSES, CONSTANTS, KEYWORDS, TASK_VERBS

WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
TOKEN = rf"""''[^'']*''|"[^"]*"|[a-zA-Z_][a-zA-Z0-9_]*|\p{{Nd}}+\.?\p{{Nd}}*|[^\p{{L}}\p{{N}}_{WS}]|[{WS}]+"""
MATH = r"(?s)\$\$.*?\$\$|\$.*?\$"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def toks(source: str, keys: str, text: str = "text") -> str:
    """CTE tl: keys, tokens."""
    return f"""
m0 AS (SELECT {keys}, regexp_extract_all({text}, '{MATH}') AS spans, regexp_split_to_array({text}, '{MATH}') AS pieces FROM {source} WHERE {text} IS NOT NULL),
m1 AS (SELECT {keys}, spans, array_to_string(list_transform(pieces, lambda s, i: CASE WHEN i < len(pieces) THEN s || ' __MATH_' || (i - 1) || '__ ' ELSE s END), '') AS x FROM m0),
m2 AS (SELECT {keys}, spans, list_transform(regexp_extract_all(x, '{TOKEN}'), lambda t: CASE WHEN regexp_matches(t, '^[{WS}]') THEN ' ' ELSE t END) AS flat FROM m1),
m3 AS (SELECT {keys}, spans, list_filter(flat, lambda t, i: t <> ' ' OR (i > 1 AND flat[i - 1] <> ' ')) AS flat FROM m2),
tl AS (SELECT {keys}, list_transform(flat, lambda t: CASE WHEN regexp_matches(t, '^__MATH_(0|[1-9][0-9]{{0,8}})__$') THEN coalesce(spans[CAST(regexp_extract(t, '[0-9]+') AS BIGINT) + 1], t) ELSE t END) AS tokens FROM m3)"""


def rows(keys: str) -> str:
    """CTE tk: keys, idx, token, n, nd; and in terms of it ck with df and idf."""
    return f"""
ts AS MATERIALIZED (SELECT {keys}, tokens, len(tokens) AS n, len(list_distinct(tokens)) AS nd FROM tl),
tk AS MATERIALIZED (SELECT {keys}, n, nd, unnest(tokens) AS token, unnest(range(len(tokens))) AS idx FROM ts),
c0 AS (SELECT *, CASE WHEN n <= 30 THEN 1 ELSE (n - 30) // 15 + 1 END AS chunks FROM tk),
c1 AS (SELECT *, greatest(0, idx // 15 - 1) AS lo, least(chunks - 1, idx // 15) AS hi FROM c0),
c2 AS (SELECT {keys}, token, count(DISTINCT c) AS df FROM (SELECT {keys}, token, unnest(range(lo, hi + 1)) AS c FROM c1 WHERE lo <= hi AND token <> ' ') GROUP BY ALL),
c3 AS (SELECT {keys}, token, count(*) AS cnt FROM tk GROUP BY ALL),
ck AS (SELECT c1.*, c3.cnt, coalesce(c2.df, 0) AS df, CASE WHEN coalesce(c2.df, 0) > 0 THEN ln((chunks + 1) / (c2.df + 1)) + 1 ELSE 1.0 END AS idf
       FROM c1 JOIN c3 USING ({keys}, token) LEFT JOIN c2 USING ({keys}, token))"""


def _class_case(values: bool) -> str:
    when = []
    for name, pattern, weight in CLASSES:
        test = {"keyword": f"token IN {_in(KEYWORDS)}", "constant": f"token IN {_in(CONSTANTS)}", "blank": "trim(token) = ''"}.get(name)
        if test is None:
            test = "regexp_matches(token, '" + pattern.replace("(?d)", "").replace("'", "''") + "')"
        when.append(f"WHEN {test} THEN " + (str(weight) if values else f"'{name}'"))
    return "CASE " + " ".join(when) + (" ELSE 0.1 END" if values else " ELSE 'other' END")


def energy(keys: str, config: QuenchConfig | None = None) -> str:
    """CTE en: token rows with the factors and the energy."""
    config = config or QuenchConfig()
    w = config.energy_weights
    frozen = " OR ".join(["(starts_with(token, '$') AND ends_with(token, '$'))", *["regexp_matches(token, '" + p.replace("'", "''") + "')" for p in config.frozen_patterns]])
    return f"""
e0 AS (SELECT *, CASE WHEN token = ' ' THEN 0.0 ELSE (cnt + 1) / (n + nd) * idf END AS raw_stat, {_class_case(True)}::DOUBLE AS raw_struct,
         greatest(n * 0.15::DOUBLE, 1.0::DOUBLE) AS half, CASE WHEN lower(token) IN {_in(TASK_VERBS)} THEN idx END AS verb, ({frozen}) AS frozen FROM ck),
e1 AS (SELECT *, min(raw_stat) OVER w AS s0, max(raw_stat) OVER w AS s1, min(raw_struct) OVER w AS t0_, max(raw_struct) OVER w AS t1_, exp(-(n - 1) / half) AS p0,
         least(idx - last_value(verb IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               first_value(verb IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx) AS dist
       FROM e0 WINDOW w AS (PARTITION BY {keys})),
e2 AS (SELECT *, CASE WHEN s0 = s1 THEN 0.5 ELSE (raw_stat - s0) / (s1 - s0) END AS e_stat, CASE WHEN t0_ = t1_ THEN 0.5 ELSE (raw_struct - t0_) / (t1_ - t0_) END AS e_struct,
         CASE WHEN n = 1 THEN 1.0 ELSE 0.1::DOUBLE + 0.8::DOUBLE * (exp(-idx / half) - p0) / (1.0 - p0) END AS e_pos, CASE WHEN dist <= 12 THEN exp(-dist / 12.0::DOUBLE) ELSE 0.0 END AS e_domain FROM e1),
en AS (SELECT *, pow({w.w_statistical}::DOUBLE * e_stat + {w.w_structural}::DOUBLE * e_struct + 0.1::DOUBLE * e_domain + {w.w_positional}::DOUBLE * e_pos, 2) AS energy FROM e2)"""


def ranking(keys: str) -> str:
    """CTE rk: with m, rank, e_last, mass."""
    return f"""
r0 AS (SELECT *, CASE WHEN NOT frozen THEN row_number() OVER (PARTITION BY {keys}, frozen ORDER BY round(energy, 12) DESC, idx) END AS rank,
         sum(CASE WHEN frozen THEN 0 ELSE 1 END) OVER (PARTITION BY {keys}) AS m, last_value(energy) OVER (PARTITION BY {keys}, token ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e_last FROM en),
rk AS (SELECT *, CASE WHEN NOT frozen THEN sum(e_last) OVER (PARTITION BY {keys}, frozen ORDER BY rank ROWS UNBOUNDED PRECEDING) END AS mass FROM r0)"""


def quenching(keys: str, config: QuenchConfig | None = None, t0: str | None = None) -> str:
    """CTEs qd (one row per text: steps, keep, similarity) and qr (token rows with kept)."""
    config = config or QuenchConfig()
    t = t0 or f"{config.temperature_initial}::DOUBLE"
    return f"""
q0 AS (SELECT {keys}, any_value(n) AS n, any_value(m) AS m, max(mass) AS total, {'any_value(' + t0 + ')' if t0 else t} AS temp FROM rk GROUP BY {keys}),
q1 AS (SELECT {keys}, n, m, total, temp, unnest(range(1, 101)) AS tau FROM q0),
q2 AS (SELECT *, greatest(1, ceil(m * least(1.0, (temp / (1.0 + {config.cooling_rate}::DOUBLE * tau)) / temp)))::BIGINT AS keep FROM q1),
q3 AS (SELECT {keys}, q2.n, q2.m, tau, keep, CASE WHEN q2.m < q2.n THEN 1.0 WHEN total = 0 THEN keep / q2.m ELSE least(1.0, rk.mass / total) END AS sim
       FROM q2 LEFT JOIN rk USING ({keys}) WHERE (rk.rank = q2.keep AND NOT rk.frozen) OR (q2.m = 0 AND rk.idx = 0)),
q4 AS (SELECT {keys}, max(tau) AS tau FROM q3 WHERE n >= {config.min_tokens} AND round(sim, 12) >= {config.similarity_threshold} GROUP BY {keys}),
qd AS (SELECT q0.*, coalesce(q4.tau, 0) AS steps, coalesce(q3.keep, q0.m) AS keep, coalesce(q3.sim, 1.0) AS sim
       FROM q0 LEFT JOIN q4 USING ({keys}) LEFT JOIN q3 ON {' AND '.join(f'q3.{k.strip()} = q0.{k.strip()}' for k in keys.split(','))} AND q3.tau = q4.tau),
qr AS (SELECT rk.*, qd.steps, (rk.frozen OR rk.rank <= qd.keep) AS kept FROM rk JOIN qd USING ({keys}))"""


def rebuilt(keys: str, source: str = "qr", where: str = "kept") -> str:
    """CTE rb: keys, text of the rows."""
    ends = "',', '.', ':', ';', ')', ']', '}', '?', '!', '''', '\"'"
    return f"""
b0 AS (SELECT {keys}, idx, regexp_replace(regexp_replace(token, '^[{WS}]+', ''), '[{WS}]+$', '') AS p FROM {source} WHERE {where}),
b1 AS (SELECT *, lag(p) OVER (PARTITION BY {keys} ORDER BY idx) AS prev FROM b0 WHERE p <> ''),
rb AS (SELECT {keys}, string_agg(CASE WHEN prev IS NULL OR p[1] IN ({ends}) THEN p ELSE ' ' || p END, '' ORDER BY idx) AS text FROM b1 WHERE prev IS NULL OR prev <> p GROUP BY {keys})"""


def wc(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{WS}]+'))"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'), ' ')"


#: Documents tied to texts of some blocks: equal documents share one.
BUNDLES = """bundles AS (SELECT substr(md5(text), 1, 2) || '-' || (doc_id // 100000) AS bundle, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1)"""

BLOCKS = rf"""
k0 AS (SELECT bundle, text, regexp_split_to_array(text, '\n[{WS}]*\n') AS raw FROM bundles),
k1 AS (SELECT bundle, unnest(raw) AS block, unnest(range(len(raw))) AS i FROM k0),
fold AS (
  SELECT bundle, i, CASE WHEN length(block) < 80 THEN block END AS held, CASE WHEN length(block) >= 80 THEN [block] ELSE [] END AS done FROM k1 WHERE i = 0
  UNION ALL
  SELECT f.bundle, b.i,
    CASE WHEN length(b.block) >= 80 THEN NULL WHEN length(concat_ws(chr(10) || chr(10), f.held, b.block)) >= 80 THEN NULL ELSE concat_ws(chr(10) || chr(10), f.held, b.block) END,
    CASE WHEN length(b.block) >= 80 THEN f.done || CASE WHEN f.held IS NULL THEN [b.block] ELSE [f.held, b.block] END
         WHEN length(concat_ws(chr(10) || chr(10), f.held, b.block)) >= 80 THEN f.done || [concat_ws(chr(10) || chr(10), f.held, b.block)] ELSE f.done END
  FROM fold f JOIN k1 b ON b.bundle = f.bundle AND b.i = f.i + 1
),
k2 AS (SELECT fold.bundle, CASE WHEN held IS NULL THEN done ELSE done || [held] END AS blocks FROM fold JOIN k0 ON k0.bundle = fold.bundle AND fold.i = len(k0.raw) - 1),
k3 AS (SELECT bundle, len(blocks) AS n_blocks, unnest(blocks) AS block, unnest(range(len(blocks))) AS pos FROM k2),
k4 AS (SELECT *, {norm('block')} AS normal, substr(sha256({norm('block')}), 1, 16) AS hash FROM k3),
bl AS (SELECT *, min(pos) OVER (PARTITION BY bundle, hash) AS first, row_number() OVER (PARTITION BY bundle, hash ORDER BY pos) AS nth FROM k4)"""

#: Bodies' messages as the made-up shapes define them: see from_conversations.
MESSAGES = """
mg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg, role, text, conv_id % 5 AS shape, count(*) OVER (PARTITION BY conv_id) AS total,
         max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS answered FROM conversations),
mb AS (SELECT *, CASE WHEN shape = 1 OR (shape = 2 AND answered = 1) THEN 'anthropic' ELSE 'openai' END AS api, (shape = 3 AND answered = 1) AS signed, shape = 4 AS streaming,
         role = 'assistant' AND shape IN (2, 4) AS tool, max(CASE WHEN role = 'user' THEN msg END) OVER (PARTITION BY conv_id) AS last_user FROM mg),
sp AS (SELECT conv_id, msg, CASE WHEN shape IN (1, 2, 3) THEN 0 END AS block, role, text, api, total FROM mb
       WHERE role IN ('user', 'assistant') AND NOT tool AND msg IS DISTINCT FROM last_user AND length(text) >= 80)"""

TURN_TEMPERATURE = "CASE WHEN total <= 2 OR greatest(0, total - 1 - msg - 1) = 0 THEN 1.0::DOUBLE ELSE greatest(least(1.0, pow(0.7::DOUBLE, greatest(0, total - 1 - msg - 1))), 0.15::DOUBLE) END"

DOCS = "documents"
FULL = f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')}, {energy('doc_id')}"
BEST = PROFILES["best"]
Q = QuenchConfig()
FROZEN = QuenchConfig(frozen_patterns=(r"^[A-Z]{2,}$", r"^[0-9]{4}$"))


def _quenched(config: QuenchConfig, source: str = DOCS) -> str:
    return f"WITH {toks(source, 'doc_id')}, {rows('doc_id')}, {energy('doc_id', config)}, {ranking('doc_id')}, {quenching('doc_id', config)}"


def _turns(config: QuenchConfig, where: str) -> str:
    return f"WITH src AS (SELECT conv_id, turn, text FROM conversations WHERE {where}), {toks('src', 'conv_id, turn')}, {rows('conv_id, turn')}, {energy('conv_id, turn', config)}, {ranking('conv_id, turn')}, {quenching('conv_id, turn', config)}, {rebuilt('conv_id, turn')}"


def _boltzmann(config: QuenchConfig) -> str:
    """The stochastic schedule, a step at a time: a step needs to know how many tokens
    the one before kept."""
    word = f"{1 << 32}::UBIGINT"
    numbers = f"list_transform(range(1, n + 1), lambda i: xor((spot + {0x9E3779B9}::UBIGINT * (1 + step * 5 + t)::UBIGINT) % {word}, ((i - 1)::UBIGINT * {0x85EBCA6B}::UBIGINT) % {word}))"
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        numbers = f"list_transform({numbers}, lambda x: (xor(x, x >> {shift}) * {factor}::UBIGINT) % {word})"
    numbers = f"list_transform({numbers}, lambda x: xor(x, x >> 16)::DOUBLE / {1 << 32})"
    share = lambda ids: f"CASE WHEN any_frozen THEN 1.0 WHEN total = 0 THEN len({ids}) / n ELSE least(1.0, list_sum(list_transform({ids}, lambda j: wt[j])) / total) END"
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, text FROM conversations), {toks('src', 'conv_id, turn')}, {rows('conv_id, turn')}, {energy('conv_id, turn', config)}, {ranking('conv_id, turn')},
    bz AS MATERIALIZED (SELECT conv_id, turn, any_value(n) AS n, any_value(m) AS m, sum(e_last) AS total, bool_or(frozen) AS any_frozen, list(frozen ORDER BY idx) AS fr, list(energy ORDER BY idx) AS en, list(e_last ORDER BY idx) AS wt, list(coalesce(rank, 0) ORDER BY idx) AS rn,
      ('0x' || substr(md5(conv_id || '|' || turn), 1, 8))::UBIGINT AS spot FROM rk GROUP BY conv_id, turn),
    st AS (
      SELECT conv_id, turn, 0 AS step, 0 AS tau, n AS kept, 1.0::DOUBLE AS sim, n >= {config.min_tokens} AS go FROM bz
      UNION ALL
      SELECT conv_id, turn, step, CASE WHEN ok THEN step ELSE tau END, CASE WHEN ok THEN cnt ELSE least END, CASE WHEN ok THEN s ELSE before END, ok AND step < 100 FROM (
        SELECT conv_id, turn, step, tau, least, before, coalesce(hit.cnt, len(plain)) AS cnt, coalesce(hit.s, {share('plain')}) AS s, round(coalesce(hit.s, {share('plain')}), 12) >= {config.similarity_threshold} AS ok FROM (
          SELECT *, list_filter(tried, lambda h: h.s = list_max(list_transform(tried, lambda g: g.s)))[1] AS hit,
            list_filter(range(1, n + 1), lambda i: rn[i] <= CASE WHEN m = 0 THEN 0 ELSE greatest(1, ceil(m * least(1.0, heat / {config.temperature_initial}::DOUBLE))) END) AS plain FROM (
            SELECT *, list_filter(list_transform(CASE WHEN least < n THEN range(5) ELSE [] END, lambda t: list_transform([list_transform([{numbers}], lambda u: list_filter(range(1, n + 1), lambda i: fr[i] OR exp(-en[i] / ({config.boltzmann_k}::DOUBLE * heat)) >= u[i]))[1]], lambda k: {{'cnt': len(k), 's': {share('k')}}})[1]),
              lambda h: h.cnt > least AND h.s > 0 AND round(h.s, 12) >= {config.similarity_threshold}) AS tried
            FROM (SELECT bz.*, st.step + 1 AS step, st.tau, st.kept AS least, st.sim AS before, {config.temperature_initial}::DOUBLE / (1.0 + {config.cooling_rate}::DOUBLE * (st.step + 1)) AS heat FROM st JOIN bz USING (conv_id, turn) WHERE go))))
    ),
    fi AS (SELECT conv_id, turn, arg_max(kept, step) AS kept, arg_max(sim, step) AS sim, max(tau) AS steps FROM st GROUP BY conv_id, turn)
    SELECT s.conv_id, s.turn, coalesce(fi.kept, 0)::BIGINT AS tokens_kept, coalesce(bz.n, 0)::BIGINT AS tokens_total, round(coalesce(1.0 - fi.kept / bz.n, 0.0), 6) AS compression_ratio, round(coalesce(fi.sim, 1.0), 6) AS similarity_score, coalesce(steps, 0)::INTEGER AS schedule_steps
    FROM src s LEFT JOIN bz USING (conv_id, turn) LEFT JOIN fi USING (conv_id, turn)"""


def _spans(bodies: bool = False) -> str:
    """CTE so: the spans of the turns, or of the made-up bodies, compressed."""
    src = f"src AS (SELECT conv_id, msg, text, total, {TURN_TEMPERATURE} AS t0 FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg, role, text, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) x QUALIFY role IN ('user', 'assistant') AND msg IS DISTINCT FROM max(CASE WHEN role = 'user' THEN msg END) OVER (PARTITION BY conv_id) AND length(text) >= 80)"
    if bodies:
        src = f"{MESSAGES}, src AS (SELECT conv_id, msg, text, total, {TURN_TEMPERATURE} AS t0 FROM sp)"
    # Conversations have no paragraph breaks, so no block repeats within a span.
    return f"""WITH {src}, {toks('src', 'conv_id, msg')}, {rows('conv_id, msg')}, {energy('conv_id, msg')},
    en2 AS (SELECT en.*, src.t0 FROM en JOIN src USING (conv_id, msg)), {ranking('conv_id, msg').replace('FROM en)', 'FROM en2)')}, {quenching('conv_id, msg', Q, 't0')}, {rebuilt('conv_id, msg')},
    sw AS (SELECT conv_id, msg, src.text, {wc('src.text')} AS words, rb.text AS new_text, {wc('rb.text')} AS new_words FROM src LEFT JOIN rb USING (conv_id, msg)),
    so AS (SELECT *, new_text IS NOT NULL AND new_words < words AS shorter FROM sw)"""


def memory(key: str, seen: str, kept: str | None = None, by_length: bool = False) -> str:
    """CTE mx: what memory and quenching save for each value of the key. seen: of a
    block with columns bundle, pos and id. kept: which rows of en (by_length: with
    other energies) are kept, where not by the schedule."""
    tokens = f"{toks('src', 'bundle')}, {rows('bundle')}, {energy('bundle')}"
    if by_length:
        tokens = tokens.replace("\nen AS (", "\neo AS (") + ", en AS (SELECT * REPLACE (pow(length(token) / 10.0::DOUBLE, 2) AS energy, false AS frozen) FROM eo)"
    counted = f"mk AS (SELECT bundle, count(*) FILTER (WHERE {kept}) AS kept FROM en GROUP BY bundle)" if kept else f"{ranking('bundle')}, {quenching('bundle')}, mk AS (SELECT bundle, count(*) FILTER (WHERE kept) AS kept FROM qr GROUP BY bundle)"
    return f"""
mm AS (SELECT {key} AS bundle, doc_id, text FROM documents WHERE text IS NOT NULL),
mj AS (SELECT bundle, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS j FROM mm GROUP BY bundle),
ms AS (SELECT bundle, CASE WHEN len(p) > 0 THEN p ELSE [j] END AS p FROM (SELECT bundle, j, list_filter(string_split(j, chr(10) || chr(10)), lambda b: regexp_matches(b, '[^{WS}]')) AS p FROM mj)),
mr AS (SELECT bundle, unnest(p) AS block, unnest(range(len(p))) AS pos FROM ms),
mi AS (SELECT *, {wc('block')} AS words, substr(sha256({norm('block')}), 1, 20) AS id FROM mr),
mh AS (SELECT *, {seen} AS seen FROM mi),
mt AS (SELECT bundle, sum(words) AS total, sum(CASE WHEN seen THEN words ELSE 0 END) AS repeated, string_agg(CASE WHEN NOT seen THEN block END, chr(10) || chr(10) ORDER BY pos) AS novel_text FROM mh GROUP BY bundle),
src AS (SELECT bundle, novel_text AS text FROM mt WHERE total - repeated > 10), {tokens}, {counted},
mo AS (SELECT bundle, total AS tokens_original, repeated AS tokens_repeated, total - repeated AS tokens_novel, (repeated - repeated * 0.01::DOUBLE) / total AS memory_reduction,
         coalesce(kept, total - repeated) AS tokens_after_quench, CASE WHEN kept IS NULL THEN 0.0 ELSE 1.0 - kept / (total - repeated) END AS quench_reduction,
         floor(repeated * 0.01::DOUBLE + coalesce(kept, total - repeated)) AS tokens_final FROM mt LEFT JOIN mk USING (bundle)),
mx AS (SELECT *, 1.0 - tokens_final / tokens_original AS total_reduction, 1.0 - (1.0 - memory_reduction) * (1.0 - quench_reduction) AS theoretical_bound FROM mo)"""


BUNDLE, AGAIN = "substr(md5(text), 1, 2) || '-' || (doc_id // 100000)", "row_number() OVER (PARTITION BY bundle, id ORDER BY pos) > 1"
MEMORY = memory(BUNDLE, AGAIN)
HOOKED = "SELECT bundle, tokens_original::BIGINT AS tokens_original, tokens_novel::BIGINT AS tokens_novel, tokens_after_quench::BIGINT AS tokens_after_quench, round(quench_reduction, 6) AS quench_reduction, tokens_final::BIGINT AS tokens_final, round(total_reduction, 6) AS total_reduction"
SHARED = memory("doc_id", f"(row_number() OVER (PARTITION BY id ORDER BY bundle, pos) > 1 OR id IN (SELECT substr(sha256({norm('text')}), 1, 20) FROM documents WHERE doc_id % 10 = 3 AND text IS NOT NULL))")


#: Events of a memory: every third document is looked up, the others are stored.
EVENTS = f"""
ev AS (SELECT doc_id, text, substr(sha256({norm('text')}), 1, 20) AS id, doc_id % 3 <> 0 AS is_store FROM documents WHERE text IS NOT NULL),
ef AS (SELECT *, min(CASE WHEN is_store THEN doc_id END) OVER (PARTITION BY id) AS stored FROM ev),
em AS (SELECT *, CASE WHEN stored <= doc_id THEN count(*) FILTER (WHERE doc_id > stored) OVER (PARTITION BY id ORDER BY doc_id) END AS met FROM ef)"""


#: CTE zt: where each token of a document lies in it; CTE zm: its energy by a model
#: that cuts texts into pieces of 3, 5 or 8 characters.
PLACES = f"""
z0 AS (SELECT doc_id, x, regexp_extract_all(x, '{TOKEN}') AS m, regexp_split_to_array(x, '{TOKEN}') AS g FROM m1),
z1 AS (SELECT doc_id, unnest(m) AS m, unnest(g[:len(m)]) AS g, unnest(range(len(m))) AS r FROM z0),
z2 AS (SELECT *, regexp_matches(m, '^[{WS}]') AS blank, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY r) AS stop FROM z1),
z3 AS (SELECT *, NOT blank OR NOT coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY r), true) AS kept FROM z2),
y0 AS (SELECT doc_id, unnest(spans) AS span, unnest(pieces[:len(spans)]) AS piece, unnest(range(len(spans))) AS k FROM m0 WHERE len(spans) > 0),
y1 AS (SELECT *, length('__MATH_' || k || '__') AS body, sum(length(piece) + length('__MATH_' || k || '__') + 2) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM y0),
y2 AS (SELECT doc_id, flatten(list([[stop - body - 1, -1], [stop - 1, length(span) - body], [stop, -1]])) AS shifts FROM y1 GROUP BY doc_id),
z4 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS idx, stop - length(m) AS a, stop AS b, coalesce(shifts, []) AS shifts FROM z3 LEFT JOIN y2 USING (doc_id) WHERE kept),
zt AS MATERIALIZED (SELECT doc_id, idx, (a + coalesce(list_sum(list_transform(list_filter(shifts, lambda s: s[1] <= a), lambda s: s[2])), 0))::BIGINT AS start, (b + coalesce(list_sum(list_transform(list_filter(shifts, lambda s: s[1] <= b), lambda s: s[2])), 0))::BIGINT AS stop FROM z4)"""
MODEL = f"""{PLACES},
x0 AS (SELECT doc_id, [3, 5, 8][doc_id % 3 + 1] AS w, length(text) AS chars FROM documents WHERE text IS NOT NULL),
x1 AS (SELECT doc_id, w, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN (chars + w - 1) // w // 2 ELSE (chars + w - 1) // w END AS n FROM x0),
zm AS (SELECT doc_id, idx, coalesce(list_sum(list_transform(range(start // w, least(n, CASE WHEN stop > start THEN (stop - 1) // w + 1 WHEN start % w = 0 THEN start // w ELSE start // w + 1 END)),
  lambda i: CASE WHEN ((i * 37 + doc_id) % 101) / 16.0 - 6.0 < 0 THEN 6.0 - ((i * 37 + doc_id) % 101) / 16.0 ELSE 1e-6 END)), 0.0)::DOUBLE AS model FROM zt JOIN x1 USING (doc_id) WHERE n > 0)"""


def _modelled(config: QuenchConfig) -> str:
    return f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')}, {energy('doc_id', config)}, {MODEL}, en2 AS (SELECT en.* REPLACE (coalesce(model, energy) AS energy), model FROM en LEFT JOIN zm USING (doc_id, idx))"


def _twice(stored: bool = False) -> str:
    """Spans of turns that say everything twice; half of the conversations come again.
    stored: the memory of them instead."""
    twice = "text || chr(10) || chr(10) || text"
    turns = f"tt AS (SELECT conv_id, turn, role, {twice} AS text, text AS one FROM conversations UNION ALL SELECT conv_id + 1000000, turn, role, {twice}, text FROM conversations WHERE conv_id % 2 = 0)"
    spans = "ss AS (SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg, role, text, one, count(*) OVER (PARTITION BY conv_id) AS total FROM tt) QUALIFY role IN ('user', 'assistant') AND msg IS DISTINCT FROM max(CASE WHEN role = 'user' THEN msg END) OVER (PARTITION BY conv_id) AND length(text) >= 80)"
    seen = f"sd AS (SELECT *, sha256({norm('text')}) AS digest, length(text) >= 400 AND row_number() OVER (PARTITION BY length(text) >= 400, sha256({norm('text')}) ORDER BY conv_id, msg) > 1 AS seen FROM ss)"
    # Two blocks where each is long enough; else they are one.
    src = f"src AS (SELECT conv_id, msg, text AS whole, CASE WHEN length(one) >= 80 THEN {norm('one')} || chr(10) || chr(10) || '[↳ see block 0]' ELSE text END AS text, {TURN_TEMPERATURE} AS t0 FROM sd WHERE NOT seen)"
    if stored:
        return f"WITH {turns}, {spans} SELECT substr(sha256({norm('text')}), 1, 20) AS block_id, md5(arg_min(text, [conv_id, msg])) AS text_md5, arg_min({wc('text')}, [conv_id, msg]) AS token_count, count(*) - 1 AS access_count FROM ss WHERE length(text) >= 400 GROUP BY 1"
    return f"""WITH {turns}, {spans}, {seen}, {src}, {toks('src', 'conv_id, msg')}, {rows('conv_id, msg')}, {energy('conv_id, msg')},
    en2 AS (SELECT en.*, src.t0 FROM en JOIN src USING (conv_id, msg)), {ranking('conv_id, msg').replace('FROM en)', 'FROM en2)')}, {quenching('conv_id, msg', Q, 't0')}, {rebuilt('conv_id, msg')},
    sw AS (SELECT conv_id, msg, {wc('src.whole')} AS words, coalesce(rb.text, CASE WHEN q.n IS NULL THEN src.text ELSE '' END) AS new_text, {wc('src.text')} AS working FROM src LEFT JOIN rb USING (conv_id, msg) LEFT JOIN qd q USING (conv_id, msg)),
    so AS (SELECT *, CASE WHEN new_text = '' THEN working ELSE {wc('new_text')} END AS new_words FROM sw)
    SELECT conv_id, msg, words, CASE WHEN new_words < words THEN new_words ELSE words END::BIGINT AS new_words, CASE WHEN new_words < words AND new_text <> '' THEN md5(new_text) END AS text_md5, CASE WHEN new_words < words THEN 'compressed' ELSE 'kept' END AS outcome FROM so
    UNION ALL SELECT conv_id, msg, {wc('text')}, 1, md5('[memory:' || substr(digest, 1, 8) || ']'), 'memory' FROM sd WHERE seen"""


def oracle_sql() -> dict[str, str]:
    per = "SELECT doc_id, {} FROM {} GROUP BY doc_id"
    out = {
        "token_counts": f"WITH {toks(DOCS, 'doc_id')} SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct FROM tl",
        "math_spans": f"WITH {toks(DOCS, 'doc_id')} SELECT doc_id, len(spans) AS n_spans, length(array_to_string(spans, '')) AS span_chars FROM m0",
        "tokens_by_class": f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')} SELECT {_class_case(False)} AS class, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM tk GROUP BY 1",
        "word_counts": f"SELECT doc_id, {wc('text')} AS n_words, length(text) AS n_chars FROM documents",
        "block_hashes": f"SELECT doc_id, substr(sha256({norm('text')}), 1, 16) AS hash16, substr(sha256({norm('text')}), 1, 20) AS hash20, sha256({norm('text')}) AS hash64 FROM documents",
        "chunk_df": f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')} " + per.format("max(chunks) AS chunks, sum(df)::BIGINT AS df_sum, max(df) AS df_max", "ck"),
        "idf": f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')} " + per.format("round(sum(idf), 6) AS idf_sum, round(min(idf), 6) AS idf_min, round(max(idf), 6) AS idf_max", "ck"),
        "frozen_tokens": FULL + per.format("sum(frozen::INT)::BIGINT AS n_frozen, count(*) AS n_tokens", "en"),
        "token_energy": FULL + per.format("round(sum(energy), 6) AS energy_sum, round(max(energy), 6) AS energy_max, round(min(energy), 6) AS energy_min", "en"),
        "cutoff_half": FULL + f", {ranking('doc_id')} " + per.format("count(*) AS n_kept, sum(idx)::BIGINT AS idx_sum", "rk") .replace(" GROUP BY", " WHERE frozen OR rank <= greatest(1, ceil(m * 0.5)) GROUP BY"),
        "reconstruct": f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')}, {rebuilt('doc_id', 'tk', 'true')} SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM rb",
        "survivors": _quenched(BEST) + per.format("count(*) AS n_kept, sum(idx)::BIGINT AS idx_sum", "qr").replace(" GROUP BY", " WHERE kept GROUP BY"),
        "dropped_tokens": _quenched(BEST) + f" SELECT {_class_case(False)} AS class, count(*) AS n_dropped, count(DISTINCT token) AS n_distinct FROM qr WHERE NOT kept GROUP BY 1",
        "quench_summary": _quenched(BEST) + f", {rebuilt('doc_id')}, qc AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE kept) AS kept FROM qr GROUP BY doc_id) SELECT d.doc_id, md5(CASE WHEN qc.total IS NULL THEN d.text ELSE coalesce(rb.text, '') END) AS text_md5, coalesce(qc.kept, 0) AS tokens_kept, coalesce(qc.total, 0) AS tokens_total, round(coalesce(1.0 - qc.kept / qc.total, 0.0), 6) AS compression_ratio, round(coalesce(sim, 1.0), 6) AS similarity_score, coalesce(steps, 0) AS schedule_steps FROM documents d LEFT JOIN qd USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN qc USING (doc_id)",
        "schedule_curve": f"{FULL}, {ranking('doc_id')}, {quenching('doc_id')} SELECT tau AS step, count(*) AS n_texts, sum(keep * (m > 0)::INT + n - m)::BIGINT AS kept, round(avg(sim), 6) AS similarity FROM q3 GROUP BY tau",
        "profile_sweep": " UNION ALL ".join(f"SELECT * FROM ({_quenched(c)} SELECT '{name}' AS profile, count(DISTINCT doc_id) AS n_texts, count(*) AS tokens_total, count(*) FILTER (WHERE kept) AS tokens_kept, round(1.0 - count(*) FILTER (WHERE kept) / count(*), 6) AS ratio FROM qr)" for name, c in PROFILES.items()),
        "quench_profiles": " UNION ALL ".join(f"SELECT * FROM ({_quenched(c, f'(SELECT * FROM documents WHERE doc_id % {len(PROFILES)} = {k})')}, {rebuilt('doc_id')}, qc AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE kept) AS kept FROM qr GROUP BY doc_id) SELECT d.doc_id, '{name}' AS profile, md5(CASE WHEN qc.total IS NULL THEN d.text ELSE coalesce(rb.text, '') END) AS text_md5, coalesce(qc.kept, 0) AS tokens_kept, coalesce(qc.total, 0) AS tokens_total, round(coalesce(sim, 1.0), 6) AS similarity_score, coalesce(steps, 0) AS schedule_steps FROM documents d LEFT JOIN qd USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN qc USING (doc_id) WHERE d.doc_id % {len(PROFILES)} = {k})" for k, (name, c) in enumerate(PROFILES.items())),
        "turn_temperature": f"SELECT conv_id, turn, round({TURN_TEMPERATURE}, 6) AS temperature FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)",
        "quench_output": _turns(output_config(), "role = 'assistant'") + f", oc AS (SELECT conv_id, turn, len(tokens) AS n FROM tl) SELECT s.conv_id, s.turn, md5(CASE WHEN coalesce(oc.n, 0) < 20 THEN s.text ELSE coalesce(rb.text, '') END) AS text_md5 FROM src s LEFT JOIN oc USING (conv_id, turn) LEFT JOIN rb USING (conv_id, turn)",
        "response_quench": _turns(output_config(Q), f"role = 'assistant' AND {wc('text')} > 30") + f", oc AS (SELECT conv_id, turn, len(tokens) AS n FROM tl) SELECT s.conv_id, s.turn, md5(CASE WHEN {wc('s.text')} <= 30 OR coalesce(oc.n, 0) < 20 THEN s.text ELSE coalesce(rb.text, '') END) AS text_md5 FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') s LEFT JOIN oc USING (conv_id, turn) LEFT JOIN rb USING (conv_id, turn)",
        "count_overlap": f"WITH {toks(DOCS, 'doc_id')}, {rows('doc_id')}, a AS (SELECT doc_id, token, count(*) AS o, count(*) FILTER (WHERE idx % 3 <> 0) AS k FROM tk GROUP BY ALL) SELECT doc_id, round(sum(least(o, k)) / sum(o), 6) AS overlap FROM a GROUP BY doc_id UNION ALL SELECT doc_id, 1.0 FROM tl WHERE len(tokens) = 0",
        "weighted_similarity": f"{FULL}, {ranking('doc_id')}, a AS (SELECT doc_id, token, count(*) AS o, count(*) FILTER (WHERE idx % 3 <> 0) AS k, any_value(e_last) AS e, bool_or(frozen) AS f FROM rk GROUP BY ALL), b AS (SELECT doc_id, sum(e * o) AS al, sum(e * least(o, k)) AS sm, sum(least(o, k)) / sum(o) AS pl, bool_or(f) AS f, sum(k) AS nk FROM a GROUP BY doc_id) SELECT doc_id, round(CASE WHEN f THEN 1.0 WHEN nk = 0 THEN 0.0 WHEN al = 0 THEN pl ELSE least(1.0, sm / al) END, 6) AS similarity FROM b",
        "embedding_cosine": "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, y, list_sum(list_transform(x, lambda v, i: v * y[i])) AS dot, sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v))) AS nn FROM p) SELECT vec_id, round(CASE WHEN nn > 0 THEN dot / nn END, 6) AS cosine, round(CASE WHEN y IS NULL THEN 1.0 WHEN nn = 0 THEN 0.0 ELSE dot / nn END, 6) AS cosine_or_one FROM s",
        "dedup_blocks": f"WITH RECURSIVE {BUNDLES}, {BLOCKS} SELECT bundle, pos, hash, first, nth FROM bl",
        "dedup_summary": f"WITH RECURSIVE {BUNDLES}, {BLOCKS} SELECT bundle, any_value(n_blocks) AS n_blocks, CASE WHEN any_value(n_blocks) < 2 THEN 0 ELSE sum((nth > 1)::INT) END::BIGINT AS blocks_removed, CASE WHEN any_value(n_blocks) < 2 THEN 0 ELSE sum(CASE WHEN nth > 1 THEN {wc('normal')} - 4 ELSE 0 END) END::BIGINT AS tokens_saved, md5(CASE WHEN any_value(n_blocks) < 2 THEN any_value(block) ELSE string_agg(CASE WHEN nth > 1 THEN '[↳ see block ' || first || ']' ELSE normal END, chr(10) || chr(10) ORDER BY pos) END) AS text_md5 FROM bl GROUP BY bundle",
        "block_stats": f"WITH RECURSIVE {BUNDLES}, {BLOCKS} SELECT bundle, hash, count(*) AS occurrences, array_to_string(list(pos ORDER BY pos), ',') AS indices FROM bl WHERE n_blocks >= 2 GROUP BY bundle, hash",
        "memory_lookup": f"WITH h AS (SELECT doc_id, lang, substr(sha256({norm('text')}), 1, 20) AS id FROM documents), s AS (SELECT DISTINCT id FROM h WHERE lang = 'en') SELECT lang, h.id IN (SELECT id FROM s) AS found, count(*) AS n FROM h GROUP BY ALL",
        "memory_stats": f"WITH s AS (SELECT substr(sha256({norm('text')}), 1, 20) AS id, arg_min({wc('text')}, doc_id) AS w, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) AS blocks_stored, sum(w)::BIGINT AS tokens_stored, sum(n - 1)::BIGINT AS total_accesses, round(sum(n - 1) / (sum(n - 1) + count(*)), 6) AS hit_rate FROM s",
        "memory_stream": f"SELECT substr(sha256({norm('text')}), 1, 20) AS block_id, arg_min({wc('text')}, doc_id) AS token_count, count(*) - 1 AS access_count FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "memory_events": f"WITH {EVENTS} SELECT doc_id, id AS block_id, is_store, coalesce(stored < doc_id, false) AS found, met AS access_count, CASE WHEN stored <= doc_id THEN stored END AS created FROM em",
        "memory_state": f"WITH {EVENTS} SELECT id AS block_id, md5(arg_min(text, doc_id)) AS text_md5, arg_min({wc('text')}, doc_id) AS token_count, max(met) AS access_count, any_value(stored) AS created FROM em WHERE stored <= doc_id GROUP BY id",
        "memory_compress": f"WITH {MEMORY} SELECT bundle, tokens_original::BIGINT AS tokens_original, tokens_repeated::BIGINT AS tokens_repeated, tokens_novel::BIGINT AS tokens_novel, round(memory_reduction, 6) AS memory_reduction, tokens_after_quench::BIGINT AS tokens_after_quench, round(quench_reduction, 6) AS quench_reduction, tokens_final::BIGINT AS tokens_final, round(total_reduction, 6) AS total_reduction, round(theoretical_bound, 6) AS theoretical_bound FROM mx",
        "memory_energy_hook": f"WITH {memory(BUNDLE, AGAIN, by_length=True)} {HOOKED} FROM mx",
        "memory_quench_hook": " UNION ALL ".join(f"SELECT * FROM (WITH {memory(BUNDLE, AGAIN, 'frozen OR round(energy, 9) >= 0.25', k == 2)} {HOOKED}, {k} AS hooks FROM mx)" for k in (1, 2)),
        "memory_remembered": f"WITH h AS (SELECT doc_id, text, substr(sha256({norm('text')}), 1, 20) AS id FROM documents WHERE text IS NOT NULL), o AS (SELECT id, arg_min(text, doc_id) AS text, count(*) AS n FROM h WHERE doc_id % 10 = 3 GROUP BY id), a AS (SELECT id, arg_min(text, doc_id) AS text, count(*) AS n FROM h GROUP BY id) SELECT id AS block_id, md5(coalesce(o.text, a.text)) AS text_md5, {wc('coalesce(o.text, a.text)')} AS token_count, a.n + coalesce(o.n, 0) - 1 AS access_count FROM a LEFT JOIN o USING (id)",
        "memory_bounds": f"WITH {MEMORY} SELECT bundle, round(tokens_repeated / tokens_original, 6) AS p, round(tokens_repeated / tokens_original * (1 - 0.01::DOUBLE) + (1 - tokens_repeated / tokens_original) * quench_reduction, 6) AS combined FROM mx",
        "memory_summary": f"WITH {MEMORY} SELECT bundle, concat_ws(chr(10), 'Memory-aware compression:', format('  Original: {{}} tokens', tokens_original::BIGINT), format('  Memory saved: {{}} tokens (R_mem = {{:.1f}}%)', tokens_repeated::BIGINT, round(memory_reduction * 100, 1)), format('  Novel content: {{}} tokens', tokens_novel::BIGINT), format('  After quenching: {{}} tokens (R_quench = {{:.1f}}%)', tokens_after_quench::BIGINT, round(quench_reduction * 100, 1)), format('  Final: {{}} tokens (R_total = {{:.1f}}%)', tokens_final::BIGINT, round(total_reduction * 100, 1)), format('  Theorem 9 bound: R_total = 1 - (1-R_mem)(1-R_quench) = {{:.1f}}%', round(theoretical_bound * 100, 1))) AS report FROM mx",
        "memory_found": f"WITH h AS (SELECT doc_id, substr(sha256({norm('text')}), 1, 20) AS id FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT id FROM h WHERE doc_id % 2 = 0) SELECT doc_id, s.id AS found_id FROM h LEFT JOIN s USING (id) WHERE doc_id % 2 = 1",
        "memory_get": f"WITH h AS (SELECT doc_id, text, source, substr(sha256({norm('text')}), 1, 20) AS id FROM documents WHERE text IS NOT NULL), s AS (SELECT id, arg_min(text, doc_id) AS text, count(*) - 1 AS access_count FROM h WHERE source LIKE '%1%' GROUP BY id) SELECT h.doc_id, id AS block_id, md5(s.text) AS text_md5, {wc('s.text')} AS token_count, s.access_count FROM h JOIN s USING (id)",
        "memory_shared": f"WITH {SHARED} SELECT bundle AS doc_id, tokens_original::BIGINT AS tokens_original, tokens_repeated::BIGINT AS tokens_repeated, tokens_novel::BIGINT AS tokens_novel, round(CASE WHEN tokens_original > 0 THEN memory_reduction ELSE 0.0 END, 6) AS memory_reduction, tokens_after_quench::BIGINT AS tokens_after_quench, tokens_final::BIGINT AS tokens_final, round(CASE WHEN tokens_original > 0 THEN total_reduction ELSE 0.0 END, 6) AS total_reduction FROM mx",
        "token_places": f"WITH {toks(DOCS, 'doc_id')}, {PLACES} SELECT doc_id, count(*) AS n_tokens, sum(start)::BIGINT AS starts, sum(stop - start)::BIGINT AS widths, max(stop) AS last FROM zt GROUP BY doc_id",
        "model_energy": _modelled(Q) + " SELECT doc_id, count(model) AS n_model, round(sum(energy), 6) AS energy_sum, round(max(energy), 6) AS energy_max FROM en2 GROUP BY doc_id",
        "model_quench": _modelled(BEST) + f", {ranking('doc_id').replace('FROM en)', 'FROM en2)')}, {quenching('doc_id', BEST)}, {rebuilt('doc_id')}, qc AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE kept) AS kept FROM qr GROUP BY doc_id) SELECT d.doc_id, md5(CASE WHEN qc.total IS NULL THEN d.text ELSE coalesce(rb.text, '') END) AS text_md5, coalesce(qc.kept, 0) AS tokens_kept, coalesce(qc.total, 0) AS tokens_total, round(coalesce(sim, 1.0), 6) AS similarity_score, coalesce(steps, 0) AS schedule_steps FROM documents d LEFT JOIN qd USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN qc USING (doc_id) WHERE d.text IS NOT NULL",
        "quench_frozen": _quenched(FROZEN) + f", {rebuilt('doc_id')}, qc AS (SELECT doc_id, count(*) FILTER (WHERE kept) AS kept FROM qr GROUP BY doc_id) SELECT d.doc_id, md5(CASE WHEN qc.kept IS NULL THEN d.text ELSE coalesce(rb.text, '') END) AS text_md5, coalesce(qc.kept, 0) AS tokens_kept, round(coalesce(sim, 1.0), 6) AS similarity_score, coalesce(steps, 0) AS schedule_steps FROM documents d LEFT JOIN qd USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN qc USING (doc_id)",
        "kept_similarity": _quenched(BEST) + ", a AS (SELECT doc_id, token, count(*) AS o, count(*) FILTER (WHERE kept) AS k, any_value(e_last) AS e, bool_or(frozen) AS f FROM qr GROUP BY ALL), b AS (SELECT doc_id, sum(e * o) AS al, sum(e * least(o, k)) AS sm, sum(least(o, k)) / sum(o) AS pl, bool_or(f) AS f, sum(k) AS nk FROM a GROUP BY doc_id) SELECT doc_id, round(CASE WHEN f THEN 1.0 WHEN nk = 0 THEN 0.0 WHEN al = 0 THEN pl ELSE least(1.0, sm / al) END, 6) AS similarity, round(pl, 6) AS overlap FROM b",
        "embedding_fallback": f"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^{WS}]+') AS ws FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS i FROM w), c AS (SELECT doc_id, t, count(*) AS o, count(*) FILTER (WHERE i % 3 <> 0) AS k FROM u GROUP BY ALL), f AS (SELECT doc_id, sum(least(o, k)) / sum(o) AS overlap FROM c GROUP BY doc_id), p AS (SELECT w.doc_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM w LEFT JOIN embeddings a ON a.vec_id = w.doc_id LEFT JOIN embeddings b ON b.vec_id = w.doc_id + 1), s AS (SELECT doc_id, list_sum(list_transform(x, lambda v, i: v * y[i])) AS dot, sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v))) AS nn FROM p) SELECT doc_id, round(CASE WHEN nn > 0 THEN dot / nn ELSE coalesce(overlap, 1.0) END, 6) AS similarity FROM s LEFT JOIN f USING (doc_id)",
        "write_back": _spans(bodies=True) + " SELECT mb.conv_id, mb.msg, mb.role, mb.api, md5(CASE WHEN so.shorter THEN so.new_text ELSE mb.text END) AS text_md5, CASE WHEN shape IN (0, 4) THEN 0 WHEN shape IN (2, 3) AND mb.role = 'assistant' THEN 2 ELSE 1 END AS n_blocks FROM mb LEFT JOIN so USING (conv_id, msg)",
        "reply_quench": _turns(output_config(Q), f"role = 'assistant' AND {wc('text')} > 30") + f", oc AS (SELECT conv_id, turn, len(tokens) AS n FROM tl) SELECT s.conv_id, s.turn, CASE WHEN s.turn % 2 = 0 THEN 0 ELSE 1 END AS part, md5(CASE WHEN {wc('s.text')} <= 30 OR coalesce(oc.n, 0) < 20 THEN s.text ELSE coalesce(rb.text, '') END) AS text_md5 FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') s LEFT JOIN oc USING (conv_id, turn) LEFT JOIN rb USING (conv_id, turn)",
        "reply_write_back": _turns(output_config(Q), f"role = 'assistant' AND {wc('text')} > 30") + f""", oc AS (SELECT conv_id, turn, len(tokens) AS n FROM tl),
    nw AS (SELECT s.conv_id, s.turn, s.text AS old, CASE WHEN {wc('s.text')} <= 30 OR coalesce(oc.n, 0) < 20 THEN s.text ELSE coalesce(rb.text, '') END AS new FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') s LEFT JOIN oc USING (conv_id, turn) LEFT JOIN rb USING (conv_id, turn)),
    us AS (SELECT *, '"usage":{{"total":12.50,"rate":1e3,"parts":[1.0,{{"z":-0.10,"a":null}}]}}' AS usage FROM nw)
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS api, md5(CASE WHEN turn % 2 = 0
      THEN '{{"id":"r-' || conv_id || '","created":1700000000.250,"choices":[{{"index":0,"finish_reason":"stop","message":{{"role":"assistant","content":' || to_json(new) || ',"refusal":null}},"logprobs":null}},{{"index":1,"message":{{"role":"assistant","content":null,"tool_calls":[{{"id":"c1","n":2.0}}]}}}}],' || usage || '}}'
      ELSE '{{"type":"message","content":[{{"type":"tool_use","id":"t1","input":{{"b":1.10,"a":[]}}}},{{"citations":[],"type":"text","text":' || to_json(new) || '}}],' || usage || ',"id":"r-' || conv_id || '"}}' END) AS reply_md5, old = new AS untouched FROM us""",
        "compress_spans_memory": _twice(),
        "compress_spans_batches": _twice(),
        "spans_store": _twice(stored=True),
        "detect_api": f"WITH {MESSAGES} SELECT conv_id, any_value(api) AS api, any_value(total) AS n_messages FROM mb GROUP BY conv_id",
        "signed_bodies": f"WITH {MESSAGES} SELECT conv_id, any_value(signed) AS signed, any_value(streaming) AS streaming FROM mb GROUP BY conv_id",
        "route": f"WITH {MESSAGES}, s AS (SELECT conv_id, count(*) AS k FROM sp GROUP BY conv_id) SELECT conv_id, CASE WHEN bool_or(streaming) THEN 'streaming' WHEN bool_or(signed) THEN 'passthrough' WHEN max(k) > 0 THEN 'compress' ELSE 'passthrough' END AS route FROM mb LEFT JOIN s USING (conv_id) GROUP BY conv_id",
        "plan_spans": f"WITH {MESSAGES} SELECT conv_id, msg, coalesce(block, -1) AS block, role, length(text) AS n_chars, api, total AS total_turns FROM sp",
        "frozen_messages": f"WITH {MESSAGES} SELECT conv_id, coalesce(array_to_string(list(mb.msg ORDER BY mb.msg) FILTER (WHERE sp.msg IS NULL), ','), '') AS frozen FROM mb LEFT JOIN sp USING (conv_id, msg) GROUP BY conv_id",
        "compress_spans_audit": _spans() + " SELECT conv_id, sum(words)::BIGINT AS tokens_original, sum(CASE WHEN shorter THEN new_words ELSE words END)::BIGINT AS tokens_kept, round(1.0 - sum(CASE WHEN shorter THEN new_words ELSE words END) / sum(words), 6) AS compression_ratio, sum(shorter::INT)::BIGINT AS spans_compressed, 0 AS spans_frozen_memory FROM so GROUP BY conv_id",
        "apply_compression": _spans() + ", am AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg, text FROM conversations) SELECT am.conv_id, am.msg, md5(CASE WHEN so.shorter THEN so.new_text ELSE am.text END) AS text_md5 FROM am LEFT JOIN so USING (conv_id, msg)",
        "logprob_energy": "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x < 0 THEN -x ELSE 1e-6 END)), 6) AS energy_sum, len(embedding) AS n FROM embeddings",
        "boltzmann_quench": _boltzmann(QuenchConfig(survival_mode="boltzmann")),
        "boltzmann_seeded": FULL + per.format("count(*) AS n_kept, sum(idx)::BIGINT AS idx_sum", "en").replace(" GROUP BY", " WHERE frozen OR exp(-energy / 0.8::DOUBLE) >= ('0x' || substr(sha256('0|' || doc_id || '|1|0|' || idx), 1, 8))::BIGINT / 4294967296 GROUP BY"),
    }
    for name in ("stat", "struct", "pos", "domain"):
        out[f"{name}_energy"] = FULL + per.format(f"round(sum(e_{name}), 6) AS e_sum, round(max(e_{name}), 6) AS e_max", "en")
    return out
