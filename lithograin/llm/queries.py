"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, license_scan, line_dedup, lm, minhash, packing, quality, sharding, url_filter
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.in_fold("doc_id", 7, 2), F.lit(False))
    scored = lm.score_texts(docs, ~held_out)
    return scored.withColumn("held_out", F.coalesce(quality.in_fold("doc_id", 7, 2), F.lit(False)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "terms")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks", "wrapped")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands at the repository's top and imports this module

    return corpus_pipeline.run(spark, sf_dir)


def _url_terms_sql() -> str:
    policy = url_filter.UrlPolicy()

    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    terms = sorted({*policy.strict, *policy.soft})
    strict = " + ".join(f"{hit(t)}::INT" for t in policy.strict)
    soft = " + ".join(f"{hit(t)}::INT" for t in policy.soft)
    listed = ", ".join(f"CASE WHEN {hit(t)} THEN '{t}' END" for t in terms)
    return f"({strict})::INT AS n_strict, ({soft})::INT AS n_soft, concat_ws(',', {listed}) AS terms"


ASCII_SPACE_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, source, line, trim(line, {ASCII_SPACE_SQL}) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents)
), bad AS (
  SELECT norm, min(doc_id) AS keeper FROM lines WHERE norm <> ''
  GROUP BY norm HAVING count(DISTINCT coalesce(source, '')) >= {line_dedup.MIN_SITES}
    OR (count(DISTINCT doc_id) >= 2 AND len(regexp_extract_all(norm, '[^\\x20\\x09-\\x0D]+')) > {line_dedup.LONG_WORDS})
), marked AS (
  SELECT l.doc_id, l.pos, l.line, b.norm IS NOT NULL AS removed
  FROM lines l LEFT JOIN bad b ON l.norm = b.norm AND b.keeper <> l.doc_id
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS text
FROM marked GROUP BY doc_id
"""

OP8_SQL = f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, u,
         translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut
), judged AS (
  SELECT *, {_url_terms_sql()},
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, terms
FROM judged
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


#: All windows on all diagonals that have enough equal words, whatever masks see.
OP7_SQL = f"""
WITH train AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {ALNUM_WORDS}) AS words FROM documents)
), test AS (
  SELECT item_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS pos
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), {ALNUM_WORDS}) AS words FROM benchmark)
), diagonals AS (
  SELECT doc_id, item_id, n, least({decontam.WINDOW}, n) AS size, a.pos - b.pos AS shift, list(DISTINCT b.pos) AS places
  FROM train a JOIN test b ON a.word = b.word GROUP BY ALL
  HAVING count(DISTINCT b.pos) >= ceil(least({decontam.WINDOW}, n) * {decontam.MIN_SHARE} - 1e-9)
), windows AS (
  SELECT doc_id, item_id, size, shift, [p FOR p IN places IF p >= s AND p < s + size] AS inside
  FROM (SELECT *, unnest(range(0, n - size + 1)) AS s FROM diagonals)
)
SELECT doc_id, item_id, count(DISTINCT shift) AS n_places, min(list_min(inside) + shift) AS first_word, max(len(inside)) AS matched, max(size) AS compared
FROM windows WHERE len(inside) >= ceil(size * {decontam.MIN_SHARE} - 1e-9) GROUP BY doc_id, item_id
"""


def _license_sql() -> str:
    sizes = [(t.need, t.span) for t in license_scan.ordered_templates({})]
    templates = ", ".join(f"{{'tid': {k}, 'label': '{label}', 'words': {words}, 'need': {need}, 'span': {span}}}" for k, ((label, words), (need, span)) in enumerate(zip(license_scan.template_words(), sizes, strict=True)))
    places, labelled = [], []
    for phrase, label in license_scan.PHRASES:
        words = phrase.split()
        same = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(words))
        found = f"[i FOR i IN range(0, greatest(len(words) - {len(words)} + 1, 0)) IF {same}]"
        places.append(found)
        labelled.append(f"CASE WHEN len({found}) > 0 THEN '{label}' END")
    return f"""
WITH t AS (SELECT unnest([{templates}], recursive := true)),
d AS (SELECT doc_id, {ASCII_LOWER} AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {ALNUM_WORDS}) AS words FROM d),
b AS (SELECT doc_id, words, list_concat({", ".join(places)}) AS places, [x FOR x IN [{", ".join(labelled)}] IF x IS NOT NULL] AS base FROM w),
lines AS (
  SELECT doc_id, line_no, regexp_extract_all(line, {ALNUM_WORDS}) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d)
), m AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(lines.words), t.words)) / len(t.words) AS share
  FROM lines, t WHERE len(list_intersect(list_distinct(lines.words), t.words)) >= need
), placed AS (
  SELECT doc_id, line_no, word, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, nth) AS pos
  FROM (SELECT doc_id, line_no, unnest(words) AS word, unnest(range(len(words))) AS nth FROM lines)
), own AS (
  SELECT doc_id, line_no, word, pos, tid, label, need, span, len(t.words) AS size
  FROM placed JOIN (SELECT *, unnest(words) AS own_word FROM t) t ON word = own_word
  QUALIFY max(line_no) OVER (PARTITION BY doc_id, tid) > min(line_no) OVER (PARTITION BY doc_id, tid)
), wrapped AS (
  SELECT a.doc_id, a.label, count(DISTINCT b.word) / any_value(a.size) AS share
  FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.tid = b.tid AND b.pos BETWEEN a.pos AND a.pos + a.span - 1
  GROUP BY a.doc_id, a.tid, a.label, a.pos, a.line_no, a.need HAVING count(DISTINCT b.word) >= a.need AND arg_max(b.line_no, b.pos) <> a.line_no
), g AS (
  SELECT doc_id, list(label) AS found, max(share) AS best, count(*) FILTER (WHERE kind = 'line') AS n_blocks
  FROM (SELECT *, 'line' AS kind FROM m UNION ALL SELECT *, 'window' FROM wrapped) GROUP BY doc_id
)
SELECT b.doc_id, len(words) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
       greatest(CASE WHEN len(base) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS score, coalesce(n_blocks, 0) AS n_blocks
FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""


OP10_SQL = _license_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_line_dedup": op2_line_dedup,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_sharding": op4_sharding,
        "op5_near_dedup": op5_near_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_url_filter": op8_url_filter,
        "op9_packing": op9_packing,
        "op10_license_scan": op10_license_scan,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_license_scan": OP10_SQL}
