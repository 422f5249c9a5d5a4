"""The registered queries of this subpackage: each applies its operator to its whole table.

Vocabulary files are found through the ``public_tokenizers`` package; their paths are parameters of
the operators. ``ORACLE_SQL`` holds DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import shared_dir, ship_package
from tandem.sources.tables import read_table

from . import bpe, conversation_repair, hnsw, jaccard_join, lexical_search, packing, pii, quality, secrets_scan, simhash, suffix_dedup, toxicity, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    ship_package(spark)
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def may_learn(id_col: str = "doc_id"):
    """Rows whose labels may be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").where(may_learn())
    return toxicity.fit_model(docs, labels)


def op1_suffix_array_dedup(spark, sf_dir):
    """Passages of 50 words or more that stand at several places, one row per span."""
    return suffix_dedup.repeated_spans(_documents(spark, sf_dir))


def op2_quality_rules(spark, sf_dir):
    return quality.repetition(_documents(spark, sf_dir))


def op3_secret_scan(spark, sf_dir):
    return secrets_scan.secret_report(_documents(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_hnsw_search(spark, sf_dir):
    shared_dir(spark)
    ship_package(spark)
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_personal_data(spark, sf_dir):
    return pii.personal_report(_documents(spark, sf_dir))


def op10_warc(spark, sf_dir):
    shared_dir(spark)
    ship_package(spark)
    return warc.archive_and_read(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_jaccard_join(spark, sf_dir):
    return jaccard_join.similar(_documents(spark, sf_dir))


def op12_conversation_repair(spark, sf_dir):
    shared_dir(spark)
    ship_package(spark)
    return conversation_repair.damage_and_repair(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_ranked_search(spark, sf_dir):
    return lexical_search.search(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_quality_rules, op3_secret_scan, op4_toxicity, op5_simhash_dedup, op6_best_fit_packing,
    op7_hnsw_search, op8_bpe_round_trip, op9_personal_data, op10_warc, op11_jaccard_join,
    op12_conversation_repair, op13_ranked_search)}

ORACLE_SQL = {"op10_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
         m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d),
         t AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept AS again FROM m)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN kept END AS refers_to
    FROM t""",
    "op11_jaccard_join": """
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
         s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
               FROM d),
         one AS (SELECT any_value(sh) AS sh, min(rid) AS cls, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
         member AS (SELECT s.rid, one.cls FROM s JOIN one ON list_sort(s.sh) = list_sort(one.sh)),
         e AS (SELECT cls, n, unnest(sh) AS x FROM one),
         link AS (SELECT a.cls AS a, b.cls AS b FROM e a JOIN e b ON a.x = b.x AND a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n
                  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
         reach(cls, low) AS (SELECT cls, cls FROM one UNION SELECT link.b, reach.low FROM reach JOIN link ON reach.cls = link.a),
         root AS (SELECT cls, min(low) AS root FROM reach GROUP BY cls),
         named AS (SELECT root.root, min(s.doc_id) AS component_id FROM member JOIN root USING (cls) JOIN s USING (rid) GROUP BY root.root)
    SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE named.component_id END AS component_id
    FROM s LEFT JOIN member USING (rid) LEFT JOIN root USING (cls) LEFT JOIN named USING (root)""",
    "op13_ranked_search": r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
         i AS (SELECT row_number() OVER () AS iid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
         dt AS (SELECT rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
         it AS (SELECT iid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
         tf AS (SELECT rid, term, count(*) AS tf FROM dt GROUP BY rid, term),
         len AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
         tot AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM len),
         w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term),
         q AS (SELECT iid, term, count(*) AS k FROM it GROUP BY iid, term),
         c AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS c
               FROM tf JOIN len USING (rid) JOIN w USING (term), tot WHERE term IN (SELECT term FROM q)),
         s AS (SELECT iid, rid, sum(k * c)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY iid, rid),
         r AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
               FROM s JOIN d USING (rid) WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN i USING (iid) WHERE rank <= 10""",
    # CRC-32 by its table; a row-by-row search over the states 0: start, 1: after s, 2: after u, 3: after a
    "op12_conversation_repair": r"""
    WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
         k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
               list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
               lambda x: ascii(x)))::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k
               FROM conversations, crc),
         d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN
               regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
               FROM k WHERE k <> 0),
         o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(length(role) || ':' || role || ':' || text), copy) AS pos FROM d),
         e AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
               min(pos) OVER (PARTITION BY conv_id, role, text) AS first FROM o),
         f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN pos > first THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END
               AS fault, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM e),
         ins(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'),
               (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
         step(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
         move AS (SELECT p, c, q, 'K' AS edit, 0 AS cost FROM step UNION ALL SELECT p, c, q, 'R', 1 FROM step WHERE c <> 's'
                  UNION ALL SELECT p, NULL, p, 'D', 2 FROM range(4) r(p)),
         v(conv_id, pos, st, best) AS (
           SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': ''} FROM f
           UNION ALL
           SELECT v.conv_id, v.pos + 1, m.q, min({'cost': (v.best.cost + i.cost + m.cost + CASE WHEN f.fault = 3 AND m.edit <> 'D' THEN 5 ELSE 0 END)::BIGINT,
                  'audit': v.best.audit || i.audit || m.edit})
           FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos + 1 JOIN ins i ON i.p = v.st
           JOIN move m ON m.p = i.q AND (m.edit = 'D' OR f.fault IN (0, 3)) AND (m.edit <> 'K' OR m.c = f.c)
           GROUP BY v.conv_id, v.pos, m.q),
         s AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
               count(*) FILTER (WHERE fault = 3) AS truncated,
               count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
         a AS (SELECT s.conv_id, min({'cost': v.best.cost + i.cost, 'audit': v.best.audit || i.audit}) AS best
               FROM s JOIN v ON v.conv_id IS NOT DISTINCT FROM s.conv_id AND v.pos = s.n JOIN ins i ON i.p = v.st AND i.q IN (0, 3)
               GROUP BY s.conv_id),
         x AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS i,
               length(replace(best.audit, 'D', '')) % 2 AS lead FROM a),
         y AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS pos, count(*) FILTER (WHERE edit <> 'D') OVER w - 1 AS place FROM x
               WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
         z AS (SELECT y.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (place - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END
               || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY place)) AS h
               FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.pos = y.pos AND edit <> 'I'
               WHERE edit <> 'D' GROUP BY y.conv_id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
           coalesce(best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""}
