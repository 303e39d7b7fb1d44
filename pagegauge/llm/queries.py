"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_text, media, mixing, ngram_join, quality_rules, secrets, toxicity, urls
from .shared import materialise, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


#: The vocabulary that op2 and the pipeline encode with.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.segments(turns.unionByName(probe)))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(pages)).select("page_id", "host", "path", "rule", "verdict")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(table(spark, sf_dir, "documents")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.report(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality_rules.statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    rules = quality_rules.fit(stats, table(spark, sf_dir, "labels"))
    out = quality_rules.judge(stats, rules)
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule_number")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5 SQL can tell: the base kinds."""
    return op5_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 SQL can tell: each source's size, target and taken words."""
    return op8_source_mixing(spark, sf_dir).groupBy("source", "source_size").agg(F.round(F.max("target"), 4).alias("target"), F.sum("taken").alias("taken"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can tell: the base statistics and their verdict."""
    stats = quality_rules.statistics(table(spark, sf_dir, "documents"))
    return stats.select("doc_id", *quality_rules.BASE, quality_rules.base_failed().alias("base_failed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_chat_format": op3_chat_format,
        "op4_html_text": op4_html_text,
        "op5_secret_scans": op5_secret_scans,
        "op6_url_filter": op6_url_filter,
        "op7_media_columns": op7_media_columns,
        "op8_source_mixing": op8_source_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "secret_base_spans": secret_base_spans,
        "mix_source_totals": mix_source_totals,
        "quality_base": quality_base,
    }


#: op1 in SQL: all pairs that share a shingle, then the least id over links and their number. The other queries' digests, models and
#: hashed keys are beyond SQL; brute-force tests hold them.
NGRAM_JOIN = r"""
WITH RECURSIVE split_ AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split_
), all_ AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT x, row_number() OVER () AS k FROM all_ GROUP BY x HAVING count(*) > 1
), each_ AS MATERIALIZED (
  SELECT doc_id, n, k AS x FROM all_ JOIN shared USING (x)
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each_ a JOIN each_ b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.id
), counted AS (
  SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(seen) AS component_id, coalesce(max(n), 0)::BIGINT AS n_links
FROM sets JOIN reach ON reach.id = sets.doc_id LEFT JOIN counted ON counted.doc_id = sets.doc_id GROUP BY sets.doc_id, len(s)
"""


def _spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Rows (r, start, number, kind, end) of a pattern's matches: running lengths of what lies between and of the matches."""
    lengths = lambda of, upto: f"coalesce(list_sum(list_transform({of}[1:{upto}], lambda x: len(x))), 0)"
    return f"""
  SELECT r, start_ AS a, {number} AS k, '{kind}' AS kind, start_ + len(m[i]) AS z FROM (
    SELECT r, m, v, i, ({lengths("g", "i")} + {lengths("m", "i - 1")})::BIGINT AS start_ FROM (
      SELECT r, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {group}) AS v, string_split_regex(t, {pattern}) AS g FROM docs WHERE regexp_matches(t, {pattern})
    ), unnest(range(1, len(m) + 1)) u(i)
  ) WHERE len(v[i]) >= {least}"""


_ASSIGN = r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_HEX = "'[0-9a-f]{24,}'"
SECRET_BASE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_spans("access", 1, "'AKIA[A-Z0-9]+'", 0, 20)} UNION ALL {_spans("hex", 2, _HEX, 0, 24)}
), told AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS said FROM spans GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM docs LEFT JOIN told USING (r)
"""

#: Targets by sharing out once for every source that stops, in the order in which they stop.
MIX_TOTALS = r"""
WITH sizes AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sizes
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n FROM ranked
), levels AS (
  SELECT o.n, (1.5::DOUBLE * (SELECT sum(source_size) FROM ranked) - coalesce((SELECT sum(cap) FROM ordered e WHERE e.n < o.n), 0)) / (SELECT sum(w) FROM ordered e WHERE e.n >= o.n) AS level, cap / w AS stops FROM ordered o
), aims AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(level, n) FROM levels WHERE level <= stops), 1e300::DOUBLE)) AS target FROM ranked
), parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM aims)
SELECT source, source_size, round(target, 4) AS target, (epochs * source_size + round(target - epochs * source_size))::BIGINT AS taken FROM parts
"""

QUALITY_BASE = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM docs, unnest(range(1, greatest(len(w) - 6, 1))) u(i)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN, "secret_base_spans": SECRET_BASE, "mix_source_totals": MIX_TOTALS, "quality_base": QUALITY_BASE}
