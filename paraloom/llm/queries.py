"""Queries over the text operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm import bitext, canonical_copies, encodings, languages, main_body, mixture, sentences, site_lines, tokens
from paraloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its equivalent SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINE_KEYS = r"""
WITH l AS (SELECT row_id, lower(domain) AS domain, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
           FROM cc_token WHERE domain IS NOT NULL),
k AS (SELECT row_id, domain, line_no::BIGINT AS line_no, line,
        regexp_replace(lower(line), '[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}\p{Nd}]', '', 'g') AS key FROM l),
c AS (SELECT domain, key FROM k WHERE regexp_matches(key, '\p{L}') GROUP BY ALL HAVING count(DISTINCT row_id) >= 12)
"""


@query(LINE_KEYS + "SELECT row_id, line_no FROM k JOIN c USING (domain, key)")
def p1_found(spark, sf):
    return site_lines.repeated_lines(table(spark, sf, "cc_token")).select("row_id", "line_no")


@query(LINE_KEYS + """, t AS (SELECT row_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (c.key IS NULL) AS kept,
  count(c.key) AS n_dropped FROM k LEFT JOIN c USING (domain, key) GROUP BY row_id)
SELECT row_id, coalesce(CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE text END, text) AS text, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM cc_token LEFT JOIN t USING (row_id)""")
def p1_cleaned(spark, sf):
    return site_lines.cleaned(table(spark, sf, "cc_token")).select("row_id", "text", "n_dropped")


@query()
def p2_found(spark, sf):
    return main_body.furniture(table(spark, sf, "cc_token"))


@query()
def p2_main_body(spark, sf):
    return main_body.main_body(table(spark, sf, "cc_token")).select("row_id", "text")


@query()
def p4_found(spark, sf):
    cases = languages.identify(table(spark, sf, "cc_token"), table(spark, sf, "lang_sample"), only_cases=True)
    return cases.select("row_id", F.explode("languages.language").alias("language"))


@query()
def p4_segments(spark, sf):
    return languages.identify(table(spark, sf, "cc_token"), table(spark, sf, "lang_sample")).select("row_id", F.explode("segments").alias("s")).select("row_id", "s.*")


@query()
def p5_found(spark, sf):
    return canonical_copies.copies(table(spark, sf, "cc_token"))


@query()
def p5_collapsed(spark, sf):
    return canonical_copies.collapsed(table(spark, sf, "cc_token"))


def _aligned(spark, sf):
    return bitext.aligned(table(spark, sf, "cc_token"), table(spark, sf, "doc_align"), table(spark, sf, "corpus_pair"))


@query()
def p6_found(spark, sf):
    return _aligned(spark, sf).select("row_id_a", "line_a", "row_id_b", "line_b")


@query()
def p6_scored(spark, sf):
    return _aligned(spark, sf)


@query()
def p7_found(spark, sf):
    return encodings.garbled(table(spark, sf, "cc_token"), table(spark, sf, "lang_sample")).select("row_id")


@query()
def p7_restored(spark, sf):
    return encodings.garbled(table(spark, sf, "cc_token"), table(spark, sf, "lang_sample"))


@query()
def p8_ids(spark, sf):
    return tokens.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


@query()
def p8_round_trip(spark, sf):
    encoded = tokens.encode(table(spark, sf, "documents").select("doc_id", "text"))
    return tokens.decode(encoded).select("doc_id", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("same"))


@query()
def p9_shares(spark, sf):
    return mixture.shares(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


@query()
def p9_mixture(spark, sf):
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


@query()
def p10_found(spark, sf):
    return sentences.sentences(table(spark, sf, "documents"))
