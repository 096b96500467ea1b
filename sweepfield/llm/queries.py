"""The operators' queries on the driver tables, with their SQL where there is any; ``tests/llm`` holds brute-force versions."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chroma, forest, language, licenses, mixing, near, pii, prints, quality, secrets, variants
from .common import few_rows_a_batch, held_out, stored


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    few_rows_a_batch(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf, "documents"))


def op3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.nearest(_table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf, "documents"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_pass", "mix_block", "mix_place", "mix_weight")


def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf, "documents"))


def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return pii.find_pii(docs, pii.train(docs))


def op8_chroma(spark: SparkSession, sf: str) -> DataFrame:
    """No table has a media column: every embedding is rendered as a recording, a note for each component. One row a query."""
    media = chroma.melodies(_table(spark, sf, "embeddings"), "vec_id", "embedding")
    prints = stored(chroma.fingerprints(media, "vec_id", "audio"))
    return chroma.links(prints.select(F.col("vec_id").alias("id"), "prints"), F.col("id") % 100 == 0)


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf, "labels")))


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return language.predict(docs, language.train(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return prints.exact_duplicates(_table(spark, sf, "documents"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_secret_scan, op3_nearest, op4_near_duplicates, op5_mixing, op6_licenses, op7_personal_data, op8_chroma, op9_quality, op10_language,
                                op11_exact_dedup, op12_filter_audit, op13_spelling_variants)}

_OP11 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)"""

_OP12 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT w.doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * (w.doc_id > min(w.doc_id) OVER (PARTITION BY t))::INT AS m, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic
      FROM w LEFT JOIN labels ON labels.doc_id = w.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
b AS (SELECT i, substr('ABCDE', i + 1, 1) AS name, 1 << i AS bit FROM (SELECT unnest(range(5)) AS i)),
o AS (SELECT b1.name || b2.name || b3.name || b4.name || b5.name AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
      FROM b AS b1, b AS b2, b AS b3, b AS b4, b AS b5 WHERE b1.bit | b2.bit | b3.bit | b4.bit | b5.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN m & bit <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

# DuckDB has no crc32: it is folded over the bytes with its table. Letters outside a-z become single bytes for levenshtein, which counts bytes.
_OP13 = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6),
d AS (SELECT doc_id, r, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || r) AS bytes FROM r GROUP BY ALL),
h AS (SELECT r, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h FROM d, tab),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, translate(word, (SELECT string_agg(chr((192 + i)::INT), '' ORDER BY i) FROM range(64) AS q(i)), (SELECT string_agg(chr((33 + i)::INT), '' ORDER BY i) FROM range(64) AS q(i))) AS one
      FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v AS a JOIN v AS b ON abs(length(a.one) - length(b.one)) <= 1 AND levenshtein(a.one, b.one) = 1),
g AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, CASE WHEN best_n >= 5 * v.n THEN best END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN g ON g.word = v.word),
c AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN l ON l.word = f.word"""

SQL: dict[str, str] = {"op13_spelling_variants": _OP13, "op11_exact_dedup": _OP11, "op12_filter_audit": _OP12}
