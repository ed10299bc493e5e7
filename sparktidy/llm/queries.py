"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparktidy.llm import (bpe, hostrules, importance, infill, langid, mixing, neighbours, ngramjoin, personal, quality,
                           secrets, toxicity, warc)

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP1_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT r, unnest(range(len(w) - 7)) AS p, w FROM cut WHERE len(w) >= 8),
runs AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p + 1: p + 8]) AS n FROM places),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM runs WHERE n > 1) GROUP BY r),
counts AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM cut LEFT JOIN covered USING (r)),
ruled AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
         OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 60 * word_chars
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed
  FROM counts),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM ruled GROUP BY source),
pooled AS (SELECT sum(f) / sum(n) AS m, count(*) AS h, sum(n) AS n, sum(f * f / n) AS s, sum(n * n) AS q FROM hosts),
spread AS (
  SELECT m, CASE WHEN h > 1 AND n - q / n > 0 THEN (s - n * m * m - (h - 1) * m * (1 - m)) / (n - q / n) ELSE 0 END AS v
  FROM pooled),
prior AS (
  SELECT least(greatest(m, 1e-6), 1 - 1e-6) AS m, CASE WHEN m * (1 - m) <= 0 THEN 1
         WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM spread),
judged AS (SELECT source, (f + m * k) / (n + k) > 0.5 AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND NOT host_rejected AS kept, host_rejected
FROM ruled JOIN judged ON ruled.source IS NOT DISTINCT FROM judged.source"""


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = hostrules.judge_documents(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "host_rejected")


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op10_kind(name: str, pattern: str, value: str, group: int = 0, keep: str = "true") -> str:
    return f"""
{name}_cut AS (
  SELECT r, doc_id, source, regexp_split_to_array(text, '{pattern}') AS gaps,
         regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {group}) AS vals
  FROM texts),
{name}_all AS (
  SELECT r, doc_id, source, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
      's': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0),
      'n': length(found[i]), 'v': vals[i]}})) AS x
  FROM {name}_cut WHERE len(found) > 0),
{name} AS (
  SELECT r, doc_id, source, x.s::INT AS s, {value} AS k, (x.s + x.n)::INT AS e, x.v AS v FROM {name}_all WHERE {keep})"""


OP10_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
{_op10_kind("assigns", secrets.ASSIGN.replace("'", "''"), "0", 1, "length(x.v) >= 8")},
{_op10_kind("keys", secrets.ACCESS, "1")},
{_op10_kind("hexes", secrets.HEX, "2")},
{_op10_kind("loose", secrets.LOOSE, "3", 0, "regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]') AND regexp_matches(x.v, '[0-9]')")},
base AS (SELECT * FROM assigns UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM hexes),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = l.r AND b.s < l.e AND l.s < b.e)),
places AS (
  SELECT v, source, count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) AS repositories,
         bool_or((k < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8))
                 AND NOT regexp_matches(lower(v), 'example|changeme|placeholder|your_|^password$')) AS live
  FROM spans GROUP BY v, source),
verdicts AS (
  SELECT v, count(*) AS owners, sum(repositories)::BIGINT AS repositories, max(repositories) AS most, bool_or(live) AS live
  FROM places GROUP BY v),
judged AS (
  SELECT spans.*, owners || ':' || repositories AS held, CASE WHEN owners > 2 AND most < repositories * 0.9 THEN 'example' WHEN live THEN 'live' ELSE 'dull' END AS verdict
  FROM spans JOIN verdicts USING (v)),
listed AS (
  SELECT r, s, k, verdict, held, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e AS span, e FROM judged
  WHERE k < 3 OR verdict = 'live'),
per AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY s, k, e) AS spans,
         string_agg(held, ',' ORDER BY s, k, e) AS held_by,
         count(*) FILTER (k = 3) AS n_owned, count(*) FILTER (verdict = 'live') AS n_live,
         count(*) FILTER (verdict = 'example') AS n_example
  FROM listed GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(held_by, '') AS held_by
FROM texts LEFT JOIN per USING (r)"""


@query("op10_secrets", OP10_SQL)
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_language")
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < 5 THEN [w]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS g FROM cut),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM links UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
  SELECT a, min(b) AS b FROM walk GROUP BY a)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(reach.b, doc_id)) AS component_id
FROM sets LEFT JOIN reach ON doc_id = a"""


@query("op5_ngram_join", OP5_SQL)
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.link_documents(table(spark, folder, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


OP9_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, strlen(body) AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)),
    lambda a, b: a || b) AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


OP11_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(lines[1:least(x, y)], '') AS p, array_to_string(lines[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(lines[greatest(x, y) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts"""


@query("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH bits AS (
  SELECT range AS i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, range) AS c
  FROM range(256)),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits),
cut AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT false, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT own, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM cut),
grams AS (SELECT own, r, f, count(*) AS n FROM runs GROUP BY ALL),
names AS (SELECT DISTINCT f FROM grams),
bytes AS (
  SELECT f, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 1 + 2 * i, 2))::BIGINT) AS b FROM names),
crcs AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM bytes, steps),
hashed AS (SELECT own, r, bucket, n FROM grams JOIN crcs USING (f)),
sums AS (SELECT sum(n) FILTER (own)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM hashed),
buckets AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (NOT own), 0) + 1) * (any_value(sums.s) + 10000)
         / ((coalesce(sum(n) FILTER (own), 0) + 1) * (any_value(sums.t) + 10000))))::BIGINT AS gain
  FROM hashed, sums GROUP BY bucket),
sized AS (SELECT r, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM hashed JOIN buckets USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                              / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN sized USING (r) WHERE own),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY words >= 20) AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND p <= 25 * n // 100 THEN p END AS rank FROM ranked"""


@query("op13_importance", OP13_SQL)
def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_pii")
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal.scan(table(spark, folder, "documents"))
