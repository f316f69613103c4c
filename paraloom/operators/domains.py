"""Web text: paragraph filters, domain selection, deduplication, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import text as T
from paraloom.operators.hot_keys import domain_profile, language_code


def paragraphs(web: DataFrame, languages: tuple[str, ...] = ("en", "cs"), confidence: float = 0.99, least: int = 100) -> DataFrame:
    """Texts of at least ``least`` characters after white-space normalisation, without Specials, in a wanted language with confidence.

    NaN confidences fail the comparison, as null ones do.
    """
    out = web.withColumn("text", T.normalise_space(F.col("text"))).withColumn("language", language_code(F.col("language")))
    sure = (F.col("confidence") >= confidence) & ~F.isnan("confidence")
    return out.filter((F.length("text") >= least) & ~T.has_specials(F.col("text")) & F.col("language").isin(*languages) & sure)


def bilingual_domains(profile: DataFrame, first: str = "en", second: str = "cs", least: int = 1) -> DataFrame:
    """Domains with at least ``least`` distinct texts in both languages."""
    return profile.filter((F.col(f"text_count_{first}") >= least) & (F.col(f"text_count_{second}") >= least))


def balanced(profile: DataFrame, first: str = "en", second: str = "cs", ratio: float = 0.01) -> DataFrame:
    """Domains whose summed text lengths relate above ``ratio`` both ways; strict, zero and null lengths fail."""
    a, b = F.col(f"text_length_{first}"), F.col(f"text_length_{second}")
    return profile.filter(a.isNotNull() & b.isNotNull() & (F.try_divide(F.least(a, b), F.greatest(a, b)) > ratio))


def distinct_texts(web: DataFrame) -> DataFrame:
    """``(domain, text, language, uri)``: each text once per domain, with its smallest URI.

    Grouped on (domain, text), so a large domain spreads over all tasks.
    """
    known = web.filter("domain IS NOT NULL AND text IS NOT NULL")
    return known.groupBy(F.lower("domain").alias("domain"), "text").agg(F.min("uri").alias("uri"), F.min("language").alias("language"))


def in_domains(web: DataFrame, domains: DataFrame | None, most_broadcast: int = 2_000_000) -> DataFrame:
    """Rows whose domain is listed; no list keeps all.  The list is broadcast up to ``most_broadcast`` names."""
    if domains is None:
        return web
    names = domains.select(F.lower("domain").alias("domain")).distinct()
    names = F.broadcast(names) if names.count() <= most_broadcast else names
    return web.withColumn("domain", F.lower("domain")).join(names, "domain", "left_semi")


def select_bilingual(web: DataFrame) -> DataFrame:
    """The whole selection: profile, both languages, balance, and the distinct texts of the domains left."""
    kept = paragraphs(web)
    chosen = balanced(bilingual_domains(domain_profile(kept)))
    return distinct_texts(in_domains(kept, chosen.select("domain")))
