"""The operators as queries over whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversations, exact_dedup, fingerprints, language_id, licenses, ngram_join, packing, resampling, token_counts, token_files, topk, toxicity
from .storage import new_path

WORD_BPE, BYTE_BPE, MULTI_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.token_file_digest(spark, path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID, 1024)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    held = language_id.fold() == 2
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = toxicity.fold() == 0
    return toxicity.tagged(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(_table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_files, op2_license_scan, op3_ngram_jaccard_join, op4_exact_dedup, op5_best_fit_packing]
    own += [op6_byte_bpe, op7_token_counts, op8_language_id, op9_toxicity, op10_exact_top_k]
    own += [op11_fingerprints, op12_conversation_repair, op13_resampling]
    return {f.__name__: f for f in own}


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (SELECT x AS doc_id, x AS r FROM links UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM documents d
LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: bit by bit over its bytes, as SQL has no function for it."""
    number = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {number}), lambda c, b: {bits}), 4294967295)"


_letters = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_words = f"regexp_extract_all({_letters}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_least = lambda *states: f"list_sort([{', '.join(states)}])[1]"
_then = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 't': {x}.t || '{letter}'}}"

OP12_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations
), dam AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src
), pos AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM dam
), f AS (
  SELECT *, shown = '' AS blank, shown <> '' AND again AS dup, shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut, shown <> '' AND NOT again AS whole, left(role, 1) AS x FROM pos
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 't': ''}} AS n, {{'c': 1000000::BIGINT, 't': ''}} AS s, {{'c': 5::BIGINT, 't': 'I'}} AS u, {{'c': 10::BIGINT, 't': 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, n, s, u, {_least('a', _then('u', 5, 'I'))} FROM (
    SELECT conv_id, i, n, s, {_least('u', *(_then(z, 5, 'I') for z in 'nsa'))} AS u, a FROM (
      SELECT w.conv_id, f.i, {_then('w.n', 2, 'D')} AS n,
        {_least(_then('w.s', 2, 'D'), _then('w.n', "(CASE WHEN whole AND x = 's' THEN 5 * cut::BIGINT ELSE 1000000 END)", 'K'))} AS s,
        {_least(_then('w.u', 2, 'D'), *(_then(f'w.{z}', "(CASE WHEN whole AND x = 'u' THEN 5 * cut::BIGINT ELSE 1000000 END)", 'K') for z in 'nsa'), *(_then(f'w.{z}', '(CASE WHEN whole THEN 1 + 5 * cut::BIGINT ELSE 1000000 END)', 'R') for z in 'nsa'))} AS u,
        {_least(_then('w.a', 2, 'D'), _then('w.u', "(CASE WHEN whole AND x = 'a' THEN 5 * cut::BIGINT ELSE 1000000 END)", 'K'), _then('w.u', '(CASE WHEN whole THEN 1 + 5 * cut::BIGINT ELSE 1000000 END)', 'R'))} AS a
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))
), best AS (
  SELECT w.conv_id, {_least('n', 'a')} AS b FROM walk w JOIN (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i
), edits AS (
  SELECT conv_id, 0 AS i, unnest(range(length(regexp_extract(b.t, '^I*')))) AS k, NULL::VARCHAR AS role, '' AS text FROM best
  UNION ALL
  SELECT conv_id, i, k, CASE WHEN k = 0 AND letters[1] = 'K' THEN role END, CASE WHEN k = 0 THEN text ELSE '' END FROM (
    SELECT f.conv_id, f.i, f.role, f.text, letters, unnest(range(length(letters))) AS k FROM (
      SELECT conv_id, unnest(regexp_extract_all(b.t, '[DKR]I*')) AS letters, generate_subscripts(regexp_extract_all(b.t, '[DKR]I*'), 1) AS i FROM best) e
    JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i) WHERE NOT (k = 0 AND letters[1] = 'D')
), placed AS (SELECT *, row_number() OVER w - 1 - (coalesce(left(first_value(role) OVER w, 1), '') = 's')::BIGINT AS e FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY i, k)
), text AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN e % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i, k) AS t FROM placed GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated, count_if(bad) AS illegal
  FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS bad FROM f) GROUP BY conv_id
)
SELECT c.conv_id, {', '.join(f'coalesce({k}, 0)::BIGINT AS {k}' for k in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(text.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_words} AS w FROM documents), b AS (SELECT {_words} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
known AS (SELECT x, {_crc32_sql('x')} % 10000 AS k FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
s AS (SELECT k, count(*) AS s FROM dw JOIN known USING (x) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bw JOIN known USING (x) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM dw) AS sn, (SELECT count(*) FROM bw) AS tn),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000) / ((s + 1)::DOUBLE * (tn + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k) CROSS JOIN n),
own AS (SELECT doc_id, sum(g)::BIGINT AS total FROM dw JOIN known USING (x) JOIN gain USING (k) GROUP BY doc_id),
w AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / nullif(len(d.w), 0)), 0)::BIGINT AS weight FROM d LEFT JOIN own USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard_join": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op10_exact_top_k": OP10_SQL,
        "op12_conversation_repair": OP12_SQL, "op13_resampling": OP13_SQL,
    }
