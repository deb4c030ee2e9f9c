"""Queries and oracle SQL of this package's operators, by registered name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, ctph, linededup, lm, mixing, neardup, packing, pii, quality, rules, spelling, topk, toxicity
from .base import table


def _documents(operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"))

    return run


def _labelled(operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    return run


def _mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


# the columns that contracts fix for personal data and rules, which SQL can state
_WORD = r"[^\x20\x09-\x0D]+"
_LUHN = """list_sum(list_transform(list_reverse(string_split(regexp_replace(x, '[ -]', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0"""
PII_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email,
       len(list_filter(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS n_ip,
       len(list_filter(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: length(regexp_replace(x, '[ -]', '', 'g')) BETWEEN 16 AND 19 AND {_LUHN})) AS n_card,
       len(list_filter(regexp_extract_all(text, '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) AS n_phone
FROM d
"""
RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT rid, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) > 2), h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS often FROM g),
r AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM h WHERE often > 1) GROUP BY rid),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')))) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
"""

QUERIES = {
    "op1_pii": _documents(pii.detect),
    "op2_line_dedup": _documents(linededup.dedup_lines),
    "op3_topk": lambda spark, sf_dir: topk.search(table(spark, sf_dir, "embeddings")),
    "op4_near_dup": _documents(neardup.near_duplicates),
    "op5_quality": _labelled(quality.classify),
    "op6_toxicity": _labelled(toxicity.classify),
    "op7_rules": _documents(rules.apply_rules),
    "op8_mixing": _documents(_mixed),
    "op9_packing": _documents(packing.pack),
    "op10_lm": _documents(lm.score_corpus),
    "op11_spelling": _documents(spelling.group_variants),
    "op12_fingerprints": _documents(ctph.fingerprints),
    "op13_centroids": lambda spark, sf_dir: centroids.cluster_vectors(table(spark, sf_dir, "embeddings")),
    "pii_counts": _documents(lambda docs: pii.detect(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")),
    "rule_counts": _documents(lambda docs: rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
}

ORACLES = {"pii_counts": PII_SQL, "rule_counts": RULES_SQL, "op2_line_dedup": linededup.ORACLE, "op3_topk": topk.ORACLE, "op4_near_dup": neardup.ORACLE, "op11_spelling": spelling.ORACLE, "op13_centroids": centroids.ORACLE}
