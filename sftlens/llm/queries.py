"""One query per operator over its whole table, and the SQL that must agree where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sftlens.llm import (
    decontamination,
    filter_audit,
    language_id,
    license_scan,
    mixing,
    ppm,
    quality,
    secret_scan,
    sentence_spans,
    superminhash,
    surrogates,
    token_alignment,
    token_files,
)
from sftlens.llm.tables import read_table, shared_path

TOKEN_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"
# Production passes its own secret; a query has to give the same rows every time.
SURROGATE_KEY = "example key, not a secret"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(read_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = superminhash.NearDuplicates(shingle=3, percent=85)
    return superminhash.near_duplicates(read_table(spark, sf_dir, "documents"), near)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.train(docs))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeated_spans(read_table(spark, sf_dir, "documents"))


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op6-tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path(TOKEN_FILE), path)
    return token_files.read_token_files(spark, path)


def op7_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = secret_scan.TokenEfficiency(tokenizer_path(RANK_FILE))
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"), rule)


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read_table(spark, sf_dir, "documents"))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mixed(docs).select("doc_id", "source", "pass", "block", "slot")


def op10_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.contaminated(docs, benchmark)


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return filter_audit.audit_filters(docs, labels)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_alignment.Tokenizers(tokenizer_path(TOKEN_FILE), tokenizer_path(PIECE_FILE))
    return token_alignment.align_tokens(read_table(spark, sf_dir, "documents"), files)


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_superminhash": op2_superminhash,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_quality_cascade": op4_quality_cascade,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_simple8b": op6_simple8b,
    "op7_token_efficiency": op7_token_efficiency,
    "op8_ppm": op8_ppm,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_pigeonhole": op10_pigeonhole,
    "op11_license_join": op11_license_join,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_alignment": op13_token_alignment,
}


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _license_sql() -> str:
    """Every block against every template, without a join order."""
    templates = ", ".join(
        f"('{t.label}', {k.step}, {license_scan.needed(t, 0.8)}, {_sql_list(sorted(set(t.words)))})"
        for k in license_scan.kinds_of(license_scan.TEMPLATES)
        for t in k.templates
    )
    phrases = ", ".join(f"({_sql_list(p.split(' '))}, '{label}')" for p, label in license_scan.PHRASES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
phrase(p, label) AS (VALUES {phrases}),
place AS (
  SELECT r, label, unnest(list_filter(range(0, len(ws) - len(p) + 1), lambda i: ws[i + 1:i + len(p)] = p)) AS pos
  FROM d, phrase),
base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
    list_sort(list(DISTINCT label)) AS base_labels FROM place GROUP BY r),
template(label, step, need, words) AS (VALUES {templates}),
block AS (SELECT r, step, unnest(range(0, greatest(1, len(ws)), step)) AS pos FROM d, (SELECT DISTINCT step FROM template)),
held AS (
  SELECT r, step, list_distinct(ws[pos + 1:pos + 2 * step]) AS ws FROM block JOIN d USING (r)),
matches AS (
  SELECT r, label, len(list_intersect(ws, words)) AS n, need, len(words) AS size FROM held JOIN template USING (step)),
more AS (
  SELECT r, list(DISTINCT label) AS labels, max(n / size) AS best FROM matches WHERE n >= need GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '')
    AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


ORACLES = {
    "op2_superminhash": r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE
      WHEN len(ws) = 0 THEN []
      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
    FROM lists)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.r AS component_id, d.doc_id = m.r AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON m.v = d.doc_id""",
    "op4_quality_cascade": r"""
WITH lists AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3),
    lambda i: array_to_string(ws[i:i + 4], ' '))) AS w
  FROM lists WHERE len(ws) >= 5),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(5) r(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letter_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM lists LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words
  AND 10 * n_dup_lines <= 3 * n_lines AND 10 * n_letter_words >= 7 * n_words AND n_upper <= n_lower AS kept
FROM judged""",
    "op11_license_join": _license_sql(),
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
marked AS (
  SELECT part, doc_id,
    [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
     100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
     regexp_matches(t, '[#$%&*|]'),
     coalesce(EXISTS (SELECT 1 FROM d e WHERE e.t = d.t AND e.doc_id < d.doc_id), false)] AS fails,
    coalesce(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1), false) AS good,
    coalesce(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1), false) AS toxic
  FROM d),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || x.l || e.l AS filter_order FROM letter a, letter b, letter c, letter x, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, x.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
each AS (
  SELECT part, filter_order, step, good, toxic,
    fails[ascii(filter_order[step]) - 64] AS failed,
    list_bool_or(list_transform(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) AS gone,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM marked, steps),
counted AS (
  SELECT part, filter_order, step,
    count(*) FILTER (WHERE NOT coalesce(gone, false) AND NOT failed) AS kept,
    count(*) FILTER (WHERE NOT coalesce(gone, false) AND failed) AS removed,
    count(*) FILTER (WHERE gone AND failed) AS redundant,
    count(*) FILTER (WHERE failed AND n_fails = 1) AS unique_fails,
    count(*) FILTER (WHERE NOT coalesce(gone, false) AND failed AND good) AS good_lost,
    count(*) FILTER (WHERE NOT coalesce(gone, false) AND failed AND toxic) AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM counted""",
}
