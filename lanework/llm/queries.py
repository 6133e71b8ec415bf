"""The registered queries of this package: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.llm import ann, bpe, conversations, html_text, neardup, packing, runs, secrets, simhash, substring, tiff, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_pack_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.text_media(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.read_pages(media, carry=("n_bytes", "media_bytes", "media_sha256"), samples=False)
    return pages.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_descent_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("key")


def op9_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, index=secrets.build_index(docs))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind_order"] == k)).cast("long")
    rows = found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), secrets.spans_text(F.col("secret_spans")).alias("spans"), secrets.spans_text(F.filter("secret_spans", lambda s: s["kind_order"] < secrets.BASE_RULES)).alias("base"))
    return rows.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).drop("base")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_minimizer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(table(spark, sf_dir, "documents"), places=runs.repeated_tail))


def op12_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("kept")


def op13_repair_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_digests(rows, conversations.damaged(rows))


QUERIES = {
    "op1_html_blocks": op1_html_blocks,
    "op2_pack_least_squares": op2_pack_least_squares,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_repeated_windows": op4_repeated_windows,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_descent_graph": op6_descent_graph,
    "op7_toxic_spans": op7_toxic_spans,
    "op8_minhash_bayes": op8_minhash_bayes,
    "op9_secret_trigrams": op9_secret_trigrams,
    "op10_bpe_tree": op10_bpe_tree,
    "op11_minimizer_runs": op11_minimizer_runs,
    "op12_simhash_pivots": op12_simhash_pivots,
    "op13_repair_blocks": op13_repair_blocks,
}


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind by DuckDB: gaps and matches alternate, so running lengths give the offsets."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, before + length(gap) AS s, before + length(gap) + length(whole) AS e
        FROM (SELECT doc_id, gap, whole, value,
                     coalesce(sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM (SELECT doc_id, generate_subscripts(whole, 1) AS i, unnest(gaps[1:len(whole)]) AS gap, unnest(whole) AS whole, unnest(value) AS value
                    FROM (SELECT doc_id, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p, 0) AS whole, regexp_extract_all(text, p, {group}) AS value
                          FROM (SELECT doc_id, coalesce(text, '') AS text, {pattern} AS p FROM documents))))
        WHERE length(value) >= {least}
    """


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text by DuckDB, bit by bit."""
    step = lambda c: f"list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {c})"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda crc, x: {step('xor(crc, x)')}, 4294967295::BIGINT), 4294967295)"


def _repair_step_sql(q: int) -> str:
    """Cheapest (cost, audit, lines) behind a row in state q, of what stood before it: a state kept by a deletion, or reached by the row kept or made user or assistant."""
    late, able = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"
    put = lambda p, cost, letter, role: f"{{'c': p.s{p}.c + CASE WHEN {able} THEN {cost} + {late} ELSE 1000000 END, 'a': p.s{p}.a || '{letter}', 't': list_append(p.s{p}.t, {role} || ':' || text)}}"
    keep = lambda p, x: put(p, f"CASE WHEN x = '{x}' THEN 0 ELSE 1000000 END", "K", "role")
    options = [f"{{'c': p.s{q}.c + 2, 'a': p.s{q}.a || 'D', 't': p.s{q}.t}}"]
    options += [keep(0, "s")] if q == 1 else []
    options += [o for p in (0, 1, 3) for o in (keep(p, "u"), put(p, "1", "R", "'user'"))] if q == 2 else []
    options += [keep(2, "a"), put(2, "1", "R", "'assistant'")] if q == 3 else []
    return f"least({', '.join(options)})" if len(options) > 1 else options[0]


def _inserted_sql(state: str, role: str) -> str:
    return f"{{'c': {state}.c + 5, 'a': {state}.a || 'I', 't': list_append({state}.t, '{role}:')}}"


ORACLES = {
    "op13_repair_blocks": rf"""
        WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations),
             dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                            unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE h <> 0),
             o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, left(role, 1) AS x FROM dam),
             f AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                          WHEN regexp_matches(text, '[^.!? 	-
][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
             p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, {{'c': 1000000, 'a': '', 't': []::VARCHAR[]}} AS s1, {{'c': 5, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM f
                   UNION ALL
                   SELECT conv_id, i, n0, n1, m2, least(n3, {_inserted_sql("m2", "assistant")}) FROM
                   (SELECT *, least(n2, {_inserted_sql("n0", "user")}, {_inserted_sql("n1", "user")}, {_inserted_sql("n3", "user")}) AS m2 FROM
                   (SELECT f.conv_id, f.i, {", ".join(f"{_repair_step_sql(q)} AS n{q}" for q in range(4))} FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))),
             c AS (SELECT conv_id, least(s0, s3) AS best FROM p JOIN (SELECT conv_id AS id, max(i) AS n FROM f GROUP BY conv_id) ON id IS NOT DISTINCT FROM conv_id AND p.i = n),
             g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                          count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
             ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
        FROM ids LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
    """,
    "op11_minimizer_runs": rf"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {_crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
             p AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, (h // 10) % 8 AS g FROM d),
             w AS (SELECT doc_id, i, ws[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END] AS word, n FROM (SELECT *, unnest(range(n)) AS i FROM p)),
             e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
             k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
             s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
             r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
             m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
             b AS (SELECT doc_id, start, length, q AS period FROM r WHERE NOT EXISTS (SELECT 1 FROM r t WHERE t.doc_id = r.doc_id AND (t.length * r.q > r.length * t.q OR (t.length * r.q = r.length * t.q AND (t.start < r.start OR (t.start = r.start AND t.q < r.q)))))),
             g AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
             c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op8_minhash_bayes": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
             x AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS sh FROM w),
             s AS (SELECT DISTINCT doc_id, sh FROM x WHERE i + 3 <= n OR (n < 4 AND i = 1)),
             c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
             e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * p.k >= 80 * (ca.k + cb.k - p.k)),
             r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
             m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(k, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN c USING (doc_id)
    """,
    "op4_repeated_windows": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
             x AS (SELECT *, CASE WHEN i + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM w),
             y AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM x),
             z AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM y),
             g AS (SELECT doc_id, sum(gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM z GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
    """,
    "op9_secret_trigrams": f"""
        WITH spans AS ({_spans_sql("assign", 0, """'((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", 2, 6)}
                       UNION ALL {_spans_sql("access", 1, "'AKIA[A-Z0-9]+'", 0, 20)}
                       UNION ALL {_spans_sql("hex", 2, "'[0-9a-f]+'", 0, 24)}
                       UNION ALL {_spans_sql("key_block", 3, "'-----BEGIN [A-Z ]*PRIVATE KEY-----'", 0, 1)}
                       UNION ALL {_spans_sql("chat_token", 4, "'xox[abprs]-[A-Za-z0-9-]{10,}'", 0, 1)}),
             per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
                            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) FILTER (kind_order < 3) AS base FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(spans, '') AS spans, sha256(coalesce(base, '')) AS base_sha256
        FROM documents LEFT JOIN per USING (doc_id)
    """,
    "op5_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
             k AS (SELECT html, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY html)
        SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
        FROM p LEFT JOIN k ON p.html = k.html AND p.n >= 1000
    """,
}
