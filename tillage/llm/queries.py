"""Queries of the training-data operators over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillage.llm import flac, langid, licenses, maintext, mixing, periodic, quality, rangejoin, rans, simhash, spiece, toxicity, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digest(_table(spark, sf_dir, "documents"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(_table(spark, sf_dir, "documents"))


def op8_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op9_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode_and_check(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_scan(_table(spark, sf_dir, "documents"))


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.yinyang_clusters(_table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id,
        op2_quality_cnn,
        op3_rans_token_files,
        op4_flac_media,
        op5_toxicity_chain,
        op6_embedding_range_join,
        op7_license_index,
        op8_simhash_byte_index,
        op9_sentencepiece_trie,
        op10_source_mix,
        op11_periodic_runs,
        op12_yinyang_clusters,
        op13_main_text,
    )}


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.ok AND b.ok
   AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a
)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links,
       m.component_id, m.component_id = v.vec_id AS kept
FROM v JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) m ON m.node = v.vec_id
"""


def _op7_sql() -> str:
    words = licenses.words_of
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = ", ".join(f"('{t}', {i}, '{w}')" for t, (body, _) in licenses.TEMPLATES.items() for i, w in enumerate(words(body)))
    bodies = ", ".join(f"('{t}', {quoted(words(body))}, {quoted(words(key))})" for t, (body, key) in licenses.TEMPLATES.items())
    phrases = ", ".join(f"('{label}', {quoted(words(p))})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH place(label, q, word) AS (VALUES {places}), body(label, b, k) AS (VALUES {bodies}), phrase(label, k) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
base AS (SELECT pos.doc_id, p AS st, label FROM pos JOIN phrase ON word = k[1] JOIN d ON d.doc_id = pos.doc_id WHERE list_slice(w, p + 1, p + len(k)) = k),
lic AS (SELECT * FROM pos WHERE word IN (SELECT word FROM place)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM lic GROUP BY word),
rare AS (SELECT label, word FROM (SELECT label, word, row_number() OVER (PARTITION BY label ORDER BY n, word) AS r FROM (SELECT DISTINCT label, unnest(k) AS word FROM body) JOIN df USING (word)) WHERE r <= {licenses.RARE_WORDS}),
start AS (SELECT doc_id, label, p - q AS st FROM lic JOIN place USING (word) JOIN rare USING (label, word) GROUP BY ALL HAVING count(DISTINCT word) >= {licenses.VOTES}),
kp AS (SELECT label, b, k, list_filter(range(len(b)), lambda i: list_slice(b, i + 1, i + len(k)) = k)[1] AS kq FROM body),
span AS (SELECT s.doc_id, s.label, s.st, len(list_filter(range(len(b)), lambda i: st + i >= 0 AND w[st + i + 1] = b[i + 1])) / len(b) AS share
  FROM start s JOIN kp USING (label) JOIN d ON d.doc_id = s.doc_id WHERE st + kq >= 0 AND list_slice(w, st + kq + 1, st + kq + len(k)) = k),
bs AS (SELECT doc_id, count(*) AS n, min(st) AS a, max(st) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY doc_id),
ss AS (SELECT doc_id, max(share) AS share, string_agg(label || ':' || st, ',' ORDER BY label, st) AS s FROM span GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM span) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(bs.l, '') AS base_labels, coalesce(al.l, '') AS labels,
  CAST(greatest(coalesce(share, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score, coalesce(s, '') AS spans
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ss USING (doc_id) LEFT JOIN al USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_embedding_range_join": OP6_SQL,
        "op7_license_index": _op7_sql(),
        "op12_yinyang_clusters": yinyang.SQL,
        "op13_main_text": maintext.SQL,
    }
