"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the pre-registered views (``conversations``,
``documents``, ``embeddings``, ``events``, ``labels`` ...). The fixtures are
re-derived here independently of the Spark code, with the same definitions.
Integer and double outputs are cast and rounded like the Spark side.
"""

from __future__ import annotations

# --- expression templates ------------------------------------------------------------


def clean(x: str) -> str:
    return (f"regexp_replace(replace(replace(replace({x}, '<unk>', ''), '<pad>', ''), '</s>', ''), "
            r"'^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')")


def letters(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"


def chars(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END)"


def prompt(x: str) -> str:
    return (f"('Task: Translate description to SELFIES representation.' || chr(10) || 'Input: ' || "
            f"coalesce({x}, '') || chr(10) || 'Output:')")


def flat(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[\\t\\r\\n]', ' ', 'g')"


F64_MIN = "2.2250738585072014e-308"

# --- fixtures -----------------------------------------------------------------------------

PAIRS = f"""
pairs_base AS (
  SELECT u.conv_id * 1000 + u.turn AS pair_id, CAST((u.conv_id + u.turn) % 6 AS INTEGER) AS variant,
         u.text AS caption, regexp_replace(a.text, '[^ -~]', '?', 'g') AS gt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
pairs AS (
  SELECT pair_id, variant, caption,
         CASE WHEN variant = 5 AND pair_id % 2 = 0 THEN '' ELSE gt END AS gt_raw,
         CASE variant WHEN 0 THEN gt WHEN 1 THEN '<pad>' || gt || '</s><pad>'
              WHEN 2 THEN regexp_replace(gt, '[aeiou]', '', 'g') WHEN 3 THEN translate(gt, 'aeo', 'eoa')
              WHEN 4 THEN '<p<unk>ad></s>' ELSE replace(gt, ' ', '') END AS pred_raw
  FROM pairs_base)"""

PREPARED = PAIRS + f""",
prep0 AS (SELECT pair_id, variant, caption, coalesce(gt_raw, '') AS gt_self, {clean('pred_raw')} AS pred_self
          FROM pairs),
prep1 AS (SELECT *, {letters('gt_self')} AS g, {letters('pred_self')} AS p FROM prep0),
prepared AS (
  SELECT pair_id, variant, caption, gt_self, pred_self,
         CASE WHEN length(g) > 0 THEN g END AS gt_can, CASE WHEN length(p) > 0 THEN p END AS pred_can,
         CASE WHEN NOT coalesce(length(p) > 0, false) THEN 'bad'
              WHEN NOT coalesce(length(g) > 0, false) THEN 'gt_dropped' ELSE 'kept' END AS status
  FROM prep1)"""

BOOK = PAIRS + f""",
book_strings AS (SELECT gt_raw AS raw FROM pairs UNION SELECT {clean('pred_raw')} FROM pairs WHERE variant <> 3),
codebook AS (SELECT raw AS encoded, upper(raw) AS decoded FROM book_strings),
canonical_keys AS (SELECT raw, CASE WHEN length({letters('raw')}) > 0 THEN {letters('raw')} END AS canonical_key
                   FROM book_strings)"""

SAMPLES = """
samples_a AS (
  SELECT doc_id,
         CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE text END AS selfies,
         source AS caption, CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END AS smiles
  FROM documents),
samples_b AS (
  SELECT doc_id,
         CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE text END AS "SELFIES",
         source AS description
  FROM documents),
normalised AS (
  SELECT doc_id AS id, 'A' AS family, split, selfies AS target, caption, smiles AS source
  FROM samples_a WHERE selfies IS DISTINCT FROM ''
  UNION ALL
  SELECT doc_id AS id, 'B' AS family, split, "SELFIES" AS target, description AS caption, '' AS source
  FROM samples_b),
train_a AS (SELECT doc_id AS id, selfies AS target, caption, smiles AS source FROM samples_a WHERE split = 'train')"""

METRIC_LOG = """
ml AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
              event_type AS metric, value, ts, event_id FROM events)"""

VOCAB = f"""
toks AS (SELECT unnest({chars('text')}) AS token FROM documents
         UNION ALL SELECT unnest({chars(prompt('source'))}) AS token FROM documents),
tcounts AS (SELECT token, count(*) AS n FROM toks GROUP BY token),
vocab AS (
  SELECT '<pad>' AS token, 0::BIGINT AS n, 0::BIGINT AS id UNION ALL
  SELECT '</s>', 0::BIGINT, 1::BIGINT UNION ALL SELECT '<unk>', 0::BIGINT, 2::BIGINT UNION ALL
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token ASC) + 2 AS id FROM tcounts)"""


def _ids_cte(name: str, text_expr: str) -> str:
    """Per document, the list of token ids of ``text_expr`` in order."""
    return f"""
{name}_src AS (SELECT doc_id, {chars(text_expr)} AS t FROM documents),
{name}_pos AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM {name}_src),
{name}_agg AS (SELECT p.doc_id, list(coalesce(v.id, 2) ORDER BY p.pos) AS ids
               FROM {name}_pos p LEFT JOIN vocab v ON v.token = p.token GROUP BY p.doc_id),
{name} AS (SELECT s.doc_id, coalesce(a.ids, []::BIGINT[]) AS ids FROM {name}_src s
           LEFT JOIN {name}_agg a ON a.doc_id = s.doc_id)"""


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


# Words of the documents with an even id; the others hold unknown words.
WORD_VOCAB = f"""
tcounts AS (SELECT token, count(*) AS n FROM (SELECT unnest({words('text')}) AS token FROM documents WHERE doc_id % 2 = 0)
            GROUP BY token),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token ASC) + 2 AS id FROM tcounts)"""


def _word_ids(name: str, text_expr: str) -> str:
    return f"""
{name}_pos AS (SELECT doc_id, unnest({words(text_expr)}) AS token, generate_subscripts({words(text_expr)}, 1) AS pos
               FROM documents),
{name} AS (SELECT d.doc_id, coalesce(list(coalesce(v.id, 2) ORDER BY p.pos) FILTER (WHERE p.pos IS NOT NULL), []::BIGINT[]) AS ids
           FROM documents d LEFT JOIN {name}_pos p ON p.doc_id = d.doc_id LEFT JOIN vocab v ON v.token = p.token
           GROUP BY d.doc_id)"""


def _padded(ids: str) -> str:
    full = f"list_concat({ids}[1:511], [1::BIGINT])"
    return f"list_concat({full}, list_transform(range(512 - len({full})), lambda x: 0::BIGINT))"


# Per-pair additive statistics, as in the Spark ``pair_stats`` (over ``prepared``).
PAIR_STATS = f""",
kept AS (SELECT * FROM prepared WHERE status = 'kept'),
forms AS (SELECT pair_id, 'c' AS form, pred_can AS h, gt_can AS r FROM kept
          UNION ALL SELECT pair_id, 's' AS form, pred_self AS h, gt_self AS r FROM kept),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
hpos AS (SELECT pair_id, form, n, h AS s, unnest(range(1, length(h) - n + 2)) AS i FROM forms, ns),
rpos AS (SELECT pair_id, form, n, r AS s, unnest(range(1, length(r) - n + 2)) AS i FROM forms, ns),
hg AS (SELECT pair_id, form, n, substring(s, i, n) AS g, count(*) AS c FROM hpos GROUP BY ALL),
rg AS (SELECT pair_id, form, n, substring(s, i, n) AS g, count(*) AS c FROM rpos GROUP BY ALL),
clip AS (SELECT pair_id, form, n, sum(least(hg.c, rg.c)) AS m
         FROM hg JOIN rg USING (pair_id, form, n, g) GROUP BY ALL),
pstat AS (
  SELECT f.pair_id, f.form, length(f.h) AS hyp, length(f.r) AS ref,
         coalesce(sum(c.m) FILTER (WHERE c.n = 1), 0) AS m1, coalesce(sum(c.m) FILTER (WHERE c.n = 2), 0) AS m2,
         coalesce(sum(c.m) FILTER (WHERE c.n = 3), 0) AS m3, coalesce(sum(c.m) FILTER (WHERE c.n = 4), 0) AS m4
  FROM forms f LEFT JOIN clip c ON c.pair_id = f.pair_id AND c.form = f.form
  GROUP BY f.pair_id, f.form, f.h, f.r),
fps AS (SELECT * FROM (VALUES (167, 1), (167, 2), (2048, 1), (2048, 2), (2048, 3), (2048, 4), (2048, 5),
                               (2048, 6), (2048, 7)) t(w, n)),
sides AS (SELECT pair_id, 'g' AS side, gt_can AS s FROM kept UNION ALL SELECT pair_id, 'p' AS side, pred_can FROM kept),
bitpos AS (SELECT pair_id, side, w, n, s, unnest(range(1, length(s) - n + 2)) AS i FROM sides, fps),
bits AS (SELECT DISTINCT pair_id, side, w, ('0x' || substr(md5(substring(s, i, n)), 1, 7))::BIGINT % w AS bit
         FROM bitpos),
bitcnt AS (SELECT pair_id, w, count(*) FILTER (WHERE side = 'g') AS a, count(*) FILTER (WHERE side = 'p') AS b
           FROM bits GROUP BY ALL),
bitint AS (SELECT g.pair_id, g.w, count(*) AS i FROM bits g JOIN bits p
             ON g.pair_id = p.pair_id AND g.w = p.w AND g.bit = p.bit AND g.side = 'g' AND p.side = 'p'
           GROUP BY ALL),
bittan AS (
  SELECT k.pair_id, ws.w,
         CASE WHEN coalesce(bc.a, 0) + coalesce(bc.b, 0) - coalesce(bi.i, 0) = 0 THEN 0.0
              ELSE coalesce(bi.i, 0)::DOUBLE / (coalesce(bc.a, 0) + coalesce(bc.b, 0) - coalesce(bi.i, 0)) END AS t
  FROM kept k CROSS JOIN (SELECT 167 AS w UNION ALL SELECT 2048) ws
  LEFT JOIN bitcnt bc ON bc.pair_id = k.pair_id AND bc.w = ws.w
  LEFT JOIN bitint bi ON bi.pair_id = k.pair_id AND bi.w = ws.w),
ps AS (
  SELECT p.pair_id, p.variant, p.status,
         CASE WHEN p.status = 'kept' THEN (p.gt_can = p.pred_can)::BIGINT ELSE 0 END AS exact,
         CASE WHEN p.status = 'kept' THEN levenshtein(p.pred_can, p.gt_can) ELSE 0 END AS lev,
         coalesce(b1.t, 0.0) AS bits_small, coalesce(b2.t, 0.0) AS bits_large,
         coalesce(c.hyp, 0) AS c_hyp, coalesce(c.ref, 0) AS c_ref,
         coalesce(c.m1, 0) AS c_m1, coalesce(c.m2, 0) AS c_m2, coalesce(c.m3, 0) AS c_m3, coalesce(c.m4, 0) AS c_m4,
         CASE WHEN p.status = 'kept' THEN greatest(1, c.hyp) ELSE 0 END AS c_d1,
         CASE WHEN p.status = 'kept' THEN greatest(1, c.hyp - 1) ELSE 0 END AS c_d2,
         CASE WHEN p.status = 'kept' THEN greatest(1, c.hyp - 2) ELSE 0 END AS c_d3,
         CASE WHEN p.status = 'kept' THEN greatest(1, c.hyp - 3) ELSE 0 END AS c_d4,
         coalesce(s.hyp, 0) AS s_hyp, coalesce(s.ref, 0) AS s_ref,
         coalesce(s.m1, 0) AS s_m1, coalesce(s.m2, 0) AS s_m2, coalesce(s.m3, 0) AS s_m3, coalesce(s.m4, 0) AS s_m4,
         CASE WHEN p.status = 'kept' THEN greatest(1, s.hyp) ELSE 0 END AS s_d1,
         CASE WHEN p.status = 'kept' THEN greatest(1, s.hyp - 1) ELSE 0 END AS s_d2,
         CASE WHEN p.status = 'kept' THEN greatest(1, s.hyp - 2) ELSE 0 END AS s_d3,
         CASE WHEN p.status = 'kept' THEN greatest(1, s.hyp - 3) ELSE 0 END AS s_d4,
         CASE WHEN p.status <> 'kept' THEN 0.0
              WHEN (greatest(0, c.ref) + greatest(0, c.ref - 1) + greatest(0, c.ref - 2)
                    + greatest(0, c.hyp) + greatest(0, c.hyp - 1) + greatest(0, c.hyp - 2)
                    - (c.m1 + c.m2 + c.m3)) = 0 THEN 0.0
              ELSE (c.m1 + c.m2 + c.m3)::DOUBLE / (greatest(0, c.ref) + greatest(0, c.ref - 1) + greatest(0, c.ref - 2)
                    + greatest(0, c.hyp) + greatest(0, c.hyp - 1) + greatest(0, c.hyp - 2)
                    - (c.m1 + c.m2 + c.m3)) END AS counts_tan
  FROM prepared p
  LEFT JOIN pstat c ON c.pair_id = p.pair_id AND c.form = 'c'
  LEFT JOIN pstat s ON s.pair_id = p.pair_id AND s.form = 's'
  LEFT JOIN bittan b1 ON b1.pair_id = p.pair_id AND b1.w = 167
  LEFT JOIN bittan b2 ON b2.pair_id = p.pair_id AND b2.w = 2048)"""

SUM_COLS = """count(*) AS n_total, count(*) FILTER (WHERE status = 'bad') AS n_bad,
  count(*) FILTER (WHERE status = 'kept') AS n_kept, sum(exact)::DOUBLE AS sum_exact, sum(lev)::DOUBLE AS sum_lev,
  sum(bits_small) AS sum_bits_small, sum(bits_large) AS sum_bits_large, sum(counts_tan) AS sum_counts_tan,
  sum(c_hyp)::DOUBLE AS c_hyp, sum(c_ref)::DOUBLE AS c_ref, sum(s_hyp)::DOUBLE AS s_hyp, sum(s_ref)::DOUBLE AS s_ref,
  sum(c_m1)::DOUBLE AS c_m1, sum(c_m2)::DOUBLE AS c_m2, sum(c_m3)::DOUBLE AS c_m3, sum(c_m4)::DOUBLE AS c_m4,
  sum(c_d1)::DOUBLE AS c_d1, sum(c_d2)::DOUBLE AS c_d2, sum(c_d3)::DOUBLE AS c_d3, sum(c_d4)::DOUBLE AS c_d4,
  sum(s_m1)::DOUBLE AS s_m1, sum(s_m2)::DOUBLE AS s_m2, sum(s_m3)::DOUBLE AS s_m3, sum(s_m4)::DOUBLE AS s_m4,
  sum(s_d1)::DOUBLE AS s_d1, sum(s_d2)::DOUBLE AS s_d2, sum(s_d3)::DOUBLE AS s_d3, sum(s_d4)::DOUBLE AS s_d4"""


def bleu(p: str) -> str:
    logs = " + ".join(f"ln(CASE WHEN {p}_m{n} > 0 THEN {p}_m{n} / {p}_d{n} ELSE {F64_MIN} END)" for n in range(1, 5))
    bp = f"(CASE WHEN {p}_hyp > {p}_ref THEN 1.0 WHEN {p}_hyp = 0 THEN 0.0 ELSE exp(1 - {p}_ref / {p}_hyp) END)"
    return f"(CASE WHEN {p}_m1 = 0 THEN 0.0 ELSE {bp} * exp(({logs}) / 4) END)"


def _g(expr: str) -> str:
    return f"round(CASE WHEN n_kept > 0 THEN {expr} ELSE 0.0 END, 6)"


REPORT_COLS = f"""n_total, n_bad, n_kept,
  {_g(bleu('c'))} AS bleu_smi, {_g(bleu('s'))} AS bleu_self, {_g('sum_exact / n_kept')} AS exact_match,
  {_g('sum_lev / n_kept')} AS levenshtein_smi,
  round(CASE WHEN n_total > 0 THEN 1 - n_bad / n_total ELSE 0.0 END, 6) AS validity,
  {_g('sum_bits_small / n_kept')} AS maccs_sims, {_g('sum_bits_large / n_kept')} AS rdk_sims,
  {_g('sum_counts_tan / n_kept')} AS morgan_sims"""

EVAL_REPORT = f"WITH {PREPARED}{PAIR_STATS}, sums AS (SELECT {SUM_COLS} FROM ps) SELECT {REPORT_COLS} FROM sums"


def _on_sums(select: str) -> str:
    return f"WITH {PREPARED}{PAIR_STATS}, sums AS (SELECT {SUM_COLS} FROM ps) SELECT {select} FROM sums"


# Pairs with identity keys: one without a key on either side raises.
KEYED = f"""WITH {PREPARED}{PAIR_STATS}, {BOOK.removeprefix(PAIRS + ",").lstrip()},
keyed AS (SELECT ps.* EXCLUDE (exact, bits_small, bits_large, counts_tan),
       ps.status = 'kept' AND (k1.canonical_key IS NULL OR k2.canonical_key IS NULL) AS raised,
       (ps.status = 'kept' AND coalesce(k1.canonical_key = k2.canonical_key, false))::BIGINT AS exact,
       ps.bits_small * (NOT raised)::INTEGER AS bits_small, ps.bits_large * (NOT raised)::INTEGER AS bits_large,
       ps.counts_tan * (NOT raised)::INTEGER AS counts_tan
  FROM ps JOIN prepared p USING (pair_id) LEFT JOIN canonical_keys k1 ON k1.raw = p.gt_self
  LEFT JOIN canonical_keys k2 ON k2.raw = p.pred_self)"""


def _similarity(total: str) -> str:
    return f"round(CASE WHEN n_kept > n_raised THEN {total} / (n_kept - n_raised) ELSE 0.0 END, 6)"


KEYED_COLS = f"""n_total, n_bad, n_kept, n_raised,
  {_g(bleu('c'))} AS bleu_smi, {_g(bleu('s'))} AS bleu_self, {_g('sum_exact / n_kept')} AS exact_match,
  {_g('sum_lev / n_kept')} AS levenshtein_smi,
  round(CASE WHEN n_total > 0 THEN 1 - (n_bad + n_raised) / n_total ELSE 0.0 END, 6) AS validity,
  {_similarity('sum_bits_small')} AS maccs_sims, {_similarity('sum_bits_large')} AS rdk_sims,
  {_similarity('sum_counts_tan')} AS morgan_sims"""


# gelu(z) = z / 2 (1 + erf(z / sqrt 2)), with erf(x) = exp(-x^2) sum over n of x^(2n+1) / gamma(n + 3/2).
GELU = """z / 2 * (1 + CASE WHEN abs(z) < 1e-300 THEN 0.0 WHEN abs(z) > 8.5 THEN sign(z) ELSE sign(z) * exp(-z * z / 2) *
  list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(abs(z) / sqrt(2.0)) - lgamma(n + 1.5)))) END)"""


def _project(activation: str) -> str:
    return f"""WITH
        x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
        h1 AS (SELECT x.vec_id, j.j, sum(x.v * ((((x.i * 7 + j.j * 3) % 11) - 5) / 10.0)) + ((j.j % 3) - 1) / 10.0 AS h
               FROM x CROSS JOIN range(0, 8) j(j) GROUP BY x.vec_id, j.j),
        n1 AS (SELECT vec_id, j AS i, (h - j / 100.0) / sqrt(1.0 + j / 10.0 + 1e-5) AS z FROM h1),
        a1 AS (SELECT vec_id, i, {activation} AS a FROM n1)
        SELECT a1.vec_id, k.k::INTEGER AS out_dim,
               round(sum(a1.a * ((((a1.i * 7 + k.k * 3) % 11) - 5) / 10.0)) + ((k.k % 3) - 1) / 10.0, 6) AS value
        FROM a1 CROSS JOIN range(0, 4) k(k) GROUP BY a1.vec_id, k.k"""


VEC_PAIRS = """
vp AS (SELECT x.vec_id // 2 AS id, (x.vec_id // 2) % 4 AS shard, (x.vec_id // 2) // 8 AS batch_id,
              list_transform(x.embedding, lambda v: v::DOUBLE) AS xe,
              list_transform(y.embedding, lambda v: v::DOUBLE) AS ye
       FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0)"""


def _r(x: str, digits: int | None) -> str:
    return f"round({x}, {digits})" if digits is not None else f"({x})"


def _vicreg(grouped: bool, digits: int | None = 6) -> str:
    """VICReg per group key ``grp`` (-1 = all rows)."""
    rows = ("SELECT id, -1 AS grp, xe, ye FROM vp UNION ALL SELECT id, shard AS grp, xe, ye FROM vp"
            if grouped else "SELECT id, -1 AS grp, xe, ye FROM vp")
    return f"""WITH {VEC_PAIRS},
g AS ({rows}),
lx AS (SELECT grp, id, unnest(xe) AS v, unnest(range(0, len(xe))) AS d FROM g),
ly AS (SELECT grp, id, unnest(ye) AS v, unnest(range(0, len(ye))) AS d FROM g),
nb AS (SELECT grp, count(*) AS n, max(len(xe)) AS dim FROM g GROUP BY grp),
sim AS (SELECT a.grp, avg((a.v - b.v) * (a.v - b.v)) AS sim FROM lx a JOIN ly b USING (grp, id, d) GROUP BY a.grp),
stdx AS (SELECT grp, avg(t) AS s FROM (SELECT grp, d, greatest(0, 1 - sqrt(var_samp(v) + 1e-4)) AS t
                                        FROM lx GROUP BY grp, d) GROUP BY grp),
stdy AS (SELECT grp, avg(t) AS s FROM (SELECT grp, d, greatest(0, 1 - sqrt(var_samp(v) + 1e-4)) AS t
                                        FROM ly GROUP BY grp, d) GROUP BY grp),
cx AS (SELECT grp, id, d, v - avg(v) OVER (PARTITION BY grp, d) AS c FROM lx),
cy AS (SELECT grp, id, d, v - avg(v) OVER (PARTITION BY grp, d) AS c FROM ly),
covx AS (SELECT a.grp, a.d AS i, b.d AS j, sum(a.c * b.c) AS s FROM cx a JOIN cx b USING (grp, id) GROUP BY ALL),
covy AS (SELECT a.grp, a.d AS i, b.d AS j, sum(a.c * b.c) AS s FROM cy a JOIN cy b USING (grp, id) GROUP BY ALL),
offx AS (SELECT c.grp, sum((c.s / (nb.n - 1)) * (c.s / (nb.n - 1))) FILTER (WHERE c.i <> c.j) AS o
         FROM covx c JOIN nb USING (grp) GROUP BY c.grp),
offy AS (SELECT c.grp, sum((c.s / (nb.n - 1)) * (c.s / (nb.n - 1))) FILTER (WHERE c.i <> c.j) AS o
         FROM covy c JOIN nb USING (grp) GROUP BY c.grp),
parts AS (SELECT nb.grp, nb.n, sim.sim, stdx.s + stdy.s AS std, (offx.o + offy.o) / nb.dim AS cov
          FROM nb JOIN sim USING (grp) JOIN stdx USING (grp) JOIN stdy USING (grp)
          JOIN offx USING (grp) JOIN offy USING (grp))
SELECT CASE WHEN grp = -1 THEN NULL ELSE grp END::BIGINT AS shard, n AS n_rows, {_r('sim', digits)} AS sim,
       {_r('std', digits)} AS std, {_r('cov', digits)} AS cov, {_r('25 * sim + 25 * std + cov', digits)} AS vicreg
FROM parts"""


TOKEN_CE = """
lg AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS l,
              CASE WHEN label = 0 THEN -100 ELSE label END AS label FROM embeddings),
ce_rows AS (SELECT ln(list_sum(list_transform(l, lambda v: exp(v)))) - l[label + 1] AS ce FROM lg WHERE label <> -100),
ce AS (SELECT count(*) AS n_rows, round(coalesce(avg(ce), 'nan'::DOUBLE), 6) AS cross_entropy,
              coalesce(avg(ce), 'nan'::DOUBLE) AS ce_raw FROM ce_rows)"""

EARLY_STOP = f"""WITH {METRIC_LOG},
checks AS (SELECT run, metric, step, min(coalesce(value, 'NaN'::DOUBLE)) AS value FROM ml GROUP BY ALL),
pos AS (SELECT *, CASE WHEN isfinite(value) THEN value END AS fin,
               row_number() OVER (PARTITION BY run, metric ORDER BY step) - 1 AS p FROM checks),
prev AS (SELECT *, min(fin) OVER (PARTITION BY run, metric ORDER BY p
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM pos),
imp AS (SELECT *, CASE WHEN fin IS NOT NULL AND (pm IS NULL OR fin < pm) THEN p END AS ip FROM prev),
li AS (SELECT *, max(ip) OVER (PARTITION BY run, metric ORDER BY p
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM imp),
st AS (SELECT run, metric, min(CASE WHEN fin IS NULL OR p - last_imp >= 5 THEN p END) AS stop_pos, count(*) AS n_checks
       FROM li GROUP BY ALL),
best AS (SELECT li.run, li.metric, arg_max(li.value, li.p) AS best_value, arg_max(li.step, li.p) AS best_step
         FROM li JOIN st USING (run, metric)
         WHERE li.ip IS NOT NULL AND (st.stop_pos IS NULL OR li.p <= st.stop_pos) GROUP BY ALL)
SELECT st.run, st.metric, s.step AS stop_step, best.best_value, best.best_step, st.n_checks{{extra}}
FROM st LEFT JOIN best USING (run, metric)
LEFT JOIN li s ON s.run = st.run AND s.metric = st.metric AND s.p = st.stop_pos"""

RUN_PATHS = """
rp AS (SELECT 'runs/' || printf('lpm24_%s_seed%d_202401%02d_1200%02d',
                                CASE WHEN quality = 1 THEN 'aligner' ELSE 'base' END, doc_id % 5, doc_id % 5 + 1, toxic)
              || '/' || CASE WHEN toxic = 1 THEN 'checkpoints/' ELSE '' END
              || printf('ckpt_epoch=%d_val_seq2seq_loss=%.4f.ckpt', doc_id // 5, ((doc_id * 37) % 1000) / 1000.0)
              AS path FROM labels)"""

RUN_FOLDER = r"^(.*/)?([^/]+)_([A-Za-z0-9-]+)_seed([0-9]+)_([0-9]{8}_[0-9]{6})$"
CKPT_FILE = r"epoch=([0-9]+)[-_]val_seq2seq_loss=([0-9.]+?)(-v[0-9]+)?\.ckpt$"

_SEED_FILTER = " OR ".join(f"folder LIKE 'lpm24_{m}_seed{s}%'" for m in ("aligner", "base") for s in range(5))

RUN_CATALOG = f"""WITH {RUN_PATHS},
p0 AS (SELECT path, string_split(substr(path, 6), '/') AS parts FROM rp
       WHERE starts_with(path, 'runs/') AND ends_with(path, '.ckpt')),
p1 AS (SELECT path, parts[1] AS folder, len(parts) = 2 AS top_level FROM p0),
p2 AS (SELECT * FROM p1 WHERE {_SEED_FILTER}),
has_top AS (SELECT DISTINCT folder FROM p2 WHERE top_level),
files AS (SELECT * FROM p2 WHERE top_level
          UNION ALL SELECT * FROM p2 WHERE NOT top_level AND folder NOT IN (SELECT folder FROM has_top)),
parsed AS (SELECT folder, path, top_level,
                  regexp_extract(folder, '{RUN_FOLDER}', 2) AS project,
                  regexp_extract(folder, '{RUN_FOLDER}', 3) AS method,
                  regexp_extract(folder, '{RUN_FOLDER}', 4)::INTEGER AS seed,
                  regexp_extract(folder, '{RUN_FOLDER}', 5) AS ts,
                  regexp_extract(path, '{CKPT_FILE}', 1)::INTEGER AS epoch,
                  regexp_extract(path, '{CKPT_FILE}', 2)::DOUBLE AS val_loss FROM files)
SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS file_rank,
       dense_rank() OVER (ORDER BY folder) AS folder_rank FROM parsed"""


def _train_order() -> str:
    return f"""WITH {SAMPLES},
t AS (SELECT id, md5('0:0:' || id::VARCHAR) AS order_key FROM train_a),
b AS (SELECT id, row_number() OVER (ORDER BY order_key, id) - 1 AS pos FROM t)"""


def _encode(select: str, ctes: str) -> str:
    return f"WITH {VOCAB},{ctes} SELECT {select}"


ORACLES: dict[str, str] = {
    # S
    "load_split": f"WITH {SAMPLES} SELECT doc_id, split, selfies, caption, smiles FROM samples_a WHERE split = 'train'",
    "run_catalog": RUN_CATALOG,
    "sink_eval_tsv": f"""WITH {PREPARED} SELECT {flat('caption')} AS description, {flat('gt_can')} AS "ground truth",
        {flat('pred_can')} AS output, {flat('gt_self')} AS gt_selfies, {flat('pred_self')} AS output_selfies
        FROM prepared WHERE status = 'kept'""",
    "sink_predictions_csv": f"""WITH {BOOK},
        p AS (SELECT caption, gt_raw AS gt_selfie, {clean('pred_raw')} AS pred_selfie FROM pairs)
        SELECT coalesce(p.caption, '') AS caption, p.gt_selfie, coalesce(b1.decoded, '') AS gt_smiles,
               p.pred_selfie, coalesce(b2.decoded, '') AS pred_smiles
        FROM p LEFT JOIN codebook b1 ON b1.encoded = p.gt_selfie LEFT JOIN codebook b2 ON b2.encoded = p.pred_selfie""",
    "sink_metrics_json": f"""WITH r AS ({EVAL_REPORT}) SELECT bleu_smi, bleu_self, exact_match, levenshtein_smi,
        validity, maccs_sims, rdk_sims, morgan_sims FROM r""",
    # P
    "filter_nonempty_target": f"WITH {SAMPLES} SELECT * FROM samples_a WHERE selfies IS DISTINCT FROM ''",
    "normalise_columns": f"WITH {SAMPLES} SELECT * FROM normalised",
    "render_prompt": f"WITH {SAMPLES} SELECT id, family, {prompt('caption')} AS prompt FROM normalised",
    "clean_generated": f"WITH {PAIRS} SELECT pair_id, {clean('pred_raw')} AS pred_self FROM pairs",
    "pair_status": f"WITH {PREPARED} SELECT status, count(*) AS n_pairs FROM prepared GROUP BY status",
    # J
    "pair_predictions": """WITH
        preds AS (SELECT conv_id * 1000 + turn AS pair_id, '<pad>' || replace(text, ' ', '') || '</s>' AS pred_raw
                  FROM conversations WHERE role = 'user'),
        refs AS (SELECT conv_id * 1000 + turn - 1 AS pair_id, regexp_replace(text, '[^ -~]', '?', 'g') AS gt_raw
                 FROM conversations WHERE role = 'assistant')
        SELECT coalesce(p.pair_id, r.pair_id) AS pair_id, p.pred_raw, r.gt_raw,
               CASE WHEN p.pair_id IS NULL THEN 'missing_prediction' WHEN r.pair_id IS NULL THEN 'missing_reference'
                    ELSE 'matched' END AS match
        FROM preds p FULL OUTER JOIN refs r ON p.pair_id = r.pair_id""",
    "decode_by_codebook": f"""WITH {BOOK},
        p AS (SELECT pair_id, gt_raw, {clean('pred_raw')} AS pred_self FROM pairs)
        SELECT p.pair_id, coalesce(b1.decoded, '') AS gt_dec, coalesce(b2.decoded, '') AS pred_dec
        FROM p LEFT JOIN codebook b1 ON b1.encoded = p.gt_raw LEFT JOIN codebook b2 ON b2.encoded = p.pred_self""",
    "canonical_match": f"""WITH {BOOK},
        p AS (SELECT pair_id, gt_raw, {clean('pred_raw')} AS pred_self FROM pairs)
        SELECT p.pair_id, k1.canonical_key AS gt_key, k2.canonical_key AS pred_key,
               coalesce(k1.canonical_key = k2.canonical_key, false) AS is_match
        FROM p LEFT JOIN canonical_keys k1 ON k1.raw = p.gt_raw LEFT JOIN canonical_keys k2 ON k2.raw = p.pred_self""",
    "augment_variants": f"""WITH {SAMPLES},
        variants AS (
          SELECT doc_id, 0 AS variant_no, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS text
          FROM documents
          UNION ALL SELECT doc_id, 1, replace(text, ' ', '_') FROM documents
          UNION ALL SELECT doc_id, 2, regexp_replace(text, '[ \\n]+', ' ', 'g') FROM documents),
        pick AS (SELECT doc_id, arg_min(text, md5('0:0:' || doc_id::VARCHAR || ':' || variant_no::VARCHAR)) AS v
                 FROM variants GROUP BY doc_id)
        SELECT a.id, CASE WHEN coalesce(length(a.source) > 0, false) AND p.v IS NOT NULL THEN p.v ELSE a.target END
                     AS target,
               coalesce(length(a.source) > 0, false) AND p.v IS NOT NULL AS augmented
        FROM train_a a LEFT JOIN pick p ON p.doc_id = a.id""",
    # T
    "char_tokens": f"""SELECT doc_id, len({chars('text')})::INTEGER AS n_tokens,
        len(list_distinct({chars('text')}))::INTEGER AS n_distinct FROM documents""",
    "build_vocab": f"WITH {VOCAB} SELECT token, n, id FROM vocab",
    "encode_padded": _encode(
        f"""i.doc_id, array_to_string({_padded('i.ids')}, ' ') AS input_ids, least(len(i.ids) + 1, 512)::INTEGER AS n_input,
            array_to_string({_padded('l.ids')}, ' ') AS labels, least(len(l.ids) + 1, 512)::INTEGER AS n_labels
            FROM inp i JOIN lab l ON l.doc_id = i.doc_id""",
        _ids_cte("inp", prompt("source")) + "," + _ids_cte("lab", "text")),
    "encode_unpadded": _encode(
        """l.doc_id, array_to_string(list_concat(l.ids, [1::BIGINT]), ' ') AS labels,
           (len(l.ids) + 1)::INTEGER AS n_labels FROM lab l""",
        _ids_cte("lab", "text")),
    "mask_labels": _encode(
        f"""l.doc_id, array_to_string(list_transform({_padded('l.ids')},
                lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS masked_labels,
            least(len(l.ids) + 1, 512)::INTEGER AS n_decoder_mask FROM lab l""",
        _ids_cte("lab", "text")),
    "shift_right": _encode(
        f"""l.doc_id, array_to_string(list_concat([0::BIGINT], {_padded('l.ids')}[1:511]), ' ') AS decoder_input_ids
            FROM lab l""",
        _ids_cte("lab", "text")),
    "decode_ids": "SELECT doc_id, text || '</s>' AS decoded FROM documents",
    "encode_words": f"""WITH {WORD_VOCAB}, {_word_ids('lab', 'text')}, {_word_ids('src', 'source')}
        SELECT l.doc_id, array_to_string({_padded('l.ids')}, ' ') AS labels, array_to_string({_padded('s.ids')}, ' ') AS source_ids,
               least(len(l.ids) + 1, 512)::INTEGER AS n_labels FROM lab l JOIN src s USING (doc_id)""",
    "decode_words": f"""WITH {WORD_VOCAB},
        w AS (SELECT doc_id, unnest({words('text')}) AS token, generate_subscripts({words('text')}, 1) AS pos FROM documents),
        d AS (SELECT doc_id, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY pos) AS s
              FROM w LEFT JOIN vocab v ON v.token = w.token GROUP BY doc_id)
        SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(d.s || ' ', '') || '</s>' END AS decoded
        FROM documents LEFT JOIN d USING (doc_id)""",
    # B
    "epoch_shuffle": f"""WITH {SAMPLES} SELECT doc_id AS id, split,
        CASE WHEN split = 'train' THEN md5('0:0:' || doc_id::VARCHAR) ELSE lpad(doc_id::VARCHAR, 20, '0') END
        AS order_key FROM samples_a""",
    "make_batches": _train_order() + " SELECT id, pos, pos // 8 AS batch_id, (pos // 8) // 4 AS opt_step FROM b",
    "shard_rows": _train_order() + """,
        tot AS (SELECT count(*) AS n FROM b),
        allrows AS (SELECT id, pos FROM b
                    UNION ALL SELECT id, pos + (SELECT n FROM tot) FROM b
                    WHERE pos < ((4 - (SELECT n FROM tot) % 4) % 4))
        SELECT id, pos, (pos % 4)::INTEGER AS rank, pos // 4 AS rank_index FROM allrows""",
    "seed_replicas": f"""WITH {SAMPLES},
        r AS (SELECT s.seed, a.id FROM train_a a CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS seed) s),
        b AS (SELECT seed::INTEGER AS seed, id,
                     row_number() OVER (PARTITION BY seed ORDER BY md5(seed::VARCHAR || ':0:' || id::VARCHAR), id) - 1
                     AS pos FROM r)
        SELECT seed, id, pos, pos // 8 AS batch_id FROM b""",
    # E
    "validity": f"""WITH {PREPARED} SELECT count(*) AS n_total, count(*) FILTER (WHERE status = 'bad') AS n_bad,
        round(CASE WHEN count(*) > 0 THEN 1 - count(*) FILTER (WHERE status = 'bad') / count(*) ELSE 0.0 END, 6)
        AS validity FROM prepared""",
    "bleu_canonical": _on_sums(f"n_kept, {_g(bleu('c'))} AS bleu_smi"),
    "bleu_raw": _on_sums(f"n_kept, {_g(bleu('s'))} AS bleu_self"),
    "exact_match": _on_sums(f"n_kept, {_g('sum_exact / n_kept')} AS exact_match"),
    "levenshtein_mean": _on_sums(f"n_kept, {_g('sum_lev / n_kept')} AS levenshtein_smi"),
    "tanimoto_bits": _on_sums(f"n_kept, {_g('sum_bits_small / n_kept')} AS bits_167, "
                              f"{_g('sum_bits_large / n_kept')} AS bits_2048"),
    "tanimoto_counts": _on_sums(f"n_kept, {_g('sum_counts_tan / n_kept')} AS counts_tanimoto"),
    "eval_report": EVAL_REPORT,
    "eval_report_by_group": f"""WITH {PREPARED}{PAIR_STATS},
        sums AS (SELECT variant, grouping(variant)::INTEGER AS is_total, {SUM_COLS} FROM ps GROUP BY ROLLUP (variant))
        SELECT variant, is_total, {REPORT_COLS} FROM sums""",
    "exact_match_by_key": f"""{KEYED} SELECT count(*) AS n_kept, count(*) FILTER (WHERE raised) AS n_raised,
        round(coalesce(avg(exact), 0.0), 6) AS exact_match FROM keyed WHERE status = 'kept'""",
    "eval_report_by_key": f"""{KEYED},
        sums AS (SELECT variant, grouping(variant)::INTEGER AS is_total, {SUM_COLS},
                        count(*) FILTER (WHERE raised) AS n_raised FROM keyed GROUP BY ROLLUP (variant))
        SELECT variant, is_total, {KEYED_COLS} FROM sums""",
    # A
    "masked_mean_pool": """WITH
        ex AS (SELECT label::BIGINT AS seq_id, CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS w,
                      unnest(embedding)::DOUBLE AS h, unnest(range(0, len(embedding)))::INTEGER AS dim FROM embeddings)
        SELECT seq_id, dim, round(sum(h * w) / greatest(sum(w), 1e-9), 6) AS value FROM ex GROUP BY seq_id, dim""",
    "mean_pool": """WITH
        ex AS (SELECT label::BIGINT AS seq_id, unnest(embedding)::DOUBLE AS h,
                      unnest(range(0, len(embedding)))::INTEGER AS dim FROM embeddings)
        SELECT seq_id, dim, round(avg(h), 6) AS value FROM ex GROUP BY seq_id, dim""",
    "project_embeddings": _project("greatest(z, 0.0)"),
    "project_embeddings_gelu": _project(GELU),
    "batch_standardise": """WITH
        x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding)))::INTEGER AS dim
              FROM embeddings),
        st AS (SELECT dim, avg(v) AS mu, var_pop(v) AS var FROM x GROUP BY dim)
        SELECT vec_id, dim, round((v - mu) / sqrt(var + 1e-5), 6) AS value FROM x JOIN st USING (dim)""",
    "vicreg": _vicreg(False),
    "clip_loss": f"""WITH {VEC_PAIRS},
        lx AS (SELECT batch_id, id, unnest(xe) AS v, unnest(range(0, len(xe))) AS d FROM vp),
        ly AS (SELECT batch_id, id, unnest(ye) AS v, unnest(range(0, len(ye))) AS d FROM vp),
        dots AS (SELECT a.batch_id, a.id AS i, b.id AS j, sum(a.v * b.v) AS l
                 FROM lx a JOIN ly b ON a.batch_id = b.batch_id AND a.d = b.d GROUP BY ALL),
        ce AS (SELECT batch_id, i, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) AS ce FROM dots GROUP BY ALL)
        SELECT batch_id, count(*) AS n_rows, round(avg(ce), 6) AS clip_loss FROM ce GROUP BY batch_id""",
    "neg_cosine": f"""WITH {VEC_PAIRS},
        c AS (SELECT list_sum(list_transform(list_zip(xe, ye), lambda t: t[1] * t[2]))
                     / greatest(sqrt(list_sum(list_transform(xe, lambda v: v * v)))
                                * sqrt(list_sum(list_transform(ye, lambda v: v * v))), 1e-8) AS cos FROM vp)
        SELECT count(*) AS n_rows, round(-avg(cos), 6) AS neg_cosine FROM c""",
    "token_cross_entropy": f"WITH {TOKEN_CE} SELECT n_rows, cross_entropy FROM ce",
    "total_loss": f"""WITH {TOKEN_CE}, v AS ({_vicreg(False, None)})
        SELECT round(ce.ce_raw, 6) AS cross_entropy, round(v.vicreg, 6) AS vicreg,
               round(1.0 * ce.ce_raw + 0.5 * v.vicreg, 6) AS total_loss
        FROM ce, v""",
    "vicreg_by_shard": _vicreg(True),
    # O
    "topk_checkpoints": f"""WITH {METRIC_LOG},
        r AS (SELECT run, metric, step, value,
                     row_number() OVER (PARTITION BY run, metric ORDER BY value, step)::INTEGER AS rank FROM ml)
        SELECT * FROM r WHERE rank <= 3""",
    "early_stop": EARLY_STOP.replace("{extra}", ""),
    "lr_one_cycle": f"""WITH {METRIC_LOG},
        tot AS (SELECT run, max(step) AS total FROM ml GROUP BY run),
        g AS (SELECT * FROM (VALUES ('backbone', 1e-4), ('language_proj', 5e-4), ('molecule_proj', 5e-4))
              t(param_group, max_lr)),
        s AS (SELECT DISTINCT run, step FROM ml),
        x AS (SELECT s.run, s.step, g.param_group, g.max_lr, (s.step - 1)::DOUBLE AS cur, 0.1 * t.total - 1 AS up_end,
                     t.total - 1 AS down_end FROM s JOIN tot t USING (run) CROSS JOIN g)
        SELECT run, step, param_group, round(CASE WHEN cur <= up_end
              THEN max_lr + (max_lr / 25.0 - max_lr) / 2.0 * (cos(pi() * coalesce(cur / nullif(up_end, 0), 1)) + 1)
              ELSE max_lr / 25.0 / 1e4 + (max_lr - max_lr / 25.0 / 1e4) / 2.0
                   * (cos(pi() * coalesce((cur - up_end) / nullif(down_end - up_end, 0), 1)) + 1) END, 15) AS lr FROM x""",
    "lr_warmup": f"""WITH {METRIC_LOG},
        tot AS (SELECT run, max(step) AS total FROM ml GROUP BY run),
        s AS (SELECT DISTINCT run, step FROM ml),
        x AS (SELECT s.run, s.step, t.total, floor(t.total * 0.1)::BIGINT AS warm, s.step - 1 AS cur
              FROM s JOIN tot t USING (run))
        SELECT run, step, warm AS warmup_steps,
               round(CASE WHEN cur < warm THEN cur / greatest(1, warm)
                          ELSE greatest(0.0, 0.5 * (1.0 + cos(pi() * ((cur - warm) / greatest(1, total - warm))))) END,
                     9) AS cosine_mult,
               round(CASE WHEN cur < warm THEN cur / greatest(1, warm) ELSE 1.0 END, 9) AS constant_mult FROM x""",
    "grad_norm": """WITH g AS (SELECT label::BIGINT AS step,
                               list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) AS sq FROM embeddings),
        n AS (SELECT step, count(*) AS n_params, sqrt(sum(sq)) AS nrm FROM g GROUP BY step)
        SELECT step, n_params, round(nrm, 6) AS grad_norm, round(least(1.0, 1.0 / (nrm + 1e-6)), 6) AS clip_coef FROM n""",
    "validation_plan": f"""WITH {METRIC_LOG},
        tot AS (SELECT run, max(step) AS total FROM ml GROUP BY run),
        checks AS (SELECT run, total, unnest(range(1, total // 5 + 1)) AS k FROM tot),
        a AS (SELECT c.run, c.k * 5 AS val_step, c.total, max(m.step) AS asof_step,
                     arg_max(m.metric, m.step) AS metric, arg_max(m.value, m.step) AS value
              FROM checks c JOIN ml m ON m.run = c.run AND m.step <= c.k * 5 GROUP BY c.run, c.k, c.total)
        SELECT run, val_step, asof_step, metric, value, val_step <= floor(total * 0.1) AS in_warmup FROM a""",
    "metric_log_summary": f"""WITH {METRIC_LOG}
        SELECT run, metric, arg_max(value, step) AS latest, round(avg(value), 6) AS mean, min(value) AS best,
               count(*) AS n, max(step) AS last_step FROM ml GROUP BY run, metric""",
    # U
    "batch_generate": f"""WITH {PAIRS},
        g AS (SELECT pair_id, '<pad>' || replace(coalesce(caption, ''), ' ', '') || '</s>' AS generated FROM pairs)
        SELECT pair_id, generated, {clean('generated')} AS generated_clean FROM g""",
    "generate_from_model": f"""WITH RECURSIVE {PAIRS},
        gw AS (SELECT pair_id, {words('gt_raw')} AS w FROM pairs),
        bi AS (SELECT unnest(w[1:len(w) - 1]) AS word, unnest(w[2:]) AS next FROM gw WHERE len(w) > 1),
        model AS (SELECT word, next FROM (SELECT word, next, row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, next) AS r
                  FROM bi GROUP BY word, next) WHERE r = 1),
        walk(pair_id, k, word, made) AS (
          SELECT pair_id, 0, string_split(rtrim(caption, ' '), ' ')[-1], '' FROM pairs
          UNION ALL SELECT pair_id, k + 1, m.next, made || CASE WHEN k > 0 THEN ' ' ELSE '' END || m.next
          FROM walk JOIN model m ON m.word = walk.word WHERE k < 8),
        g AS (SELECT pair_id, '<pad>' || arg_max(made, k) || '</s>' AS generated FROM walk GROUP BY pair_id)
        SELECT pair_id, generated, {clean('generated')} AS generated_clean FROM g""",
    "safe_apply": f"""WITH {PAIRS},
        a AS (SELECT pair_id, caption, regexp_matches(caption, '^[\\x00-\\x7F]*$') AS ok FROM pairs)
        SELECT pair_id, CASE WHEN ok THEN caption END AS value,
               CASE WHEN NOT ok THEN 'UnicodeEncodeError' END AS value_error FROM a""",
    "streaming_eval": EVAL_REPORT,
    "streaming_early_stop": EARLY_STOP.replace("{extra}", ", 0::BIGINT AS late_rows"),
    "streaming_metric_windows": """WITH mx AS (SELECT max(ts) AS m FROM events),
        w AS (SELECT date_trunc('day', ts) AS ws, event_type AS metric, value FROM events)
        SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
               strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, metric, count(*) AS n,
               round(avg(value), 6) AS mean, min(value) AS min_value, max(value) AS max_value
        FROM w, mx WHERE ws + INTERVAL 1 DAY <= mx.m - INTERVAL 1 DAY GROUP BY ws, metric""",
}
