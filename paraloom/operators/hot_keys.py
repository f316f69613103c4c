"""Per-key results when a few keys hold most rows: value-frequency compression.

Every operator here first groups by ``(key, value)`` and only then by ``key``.  The first
grouping hashes on both columns, so a key that holds a third of all rows is spread over all
tasks; after it a key has one weighted row per distinct value, and the second grouping is
again partially aggregated before its shuffle.  Distinct counts, modes and percentiles are
exact, computed from the weights.

Nulls: a null key forms the group of null keys (callers filter it where a key is needed); a
null value is counted in ``n_rows`` and ignored by distinct counts, modes and percentiles.
Empty input gives no rows.  Extra columns are ignored; only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.operators.rows import running_sums


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(key, value, weight)``: each distinct value of each key with its number of rows."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def heavy_keys(df: DataFrame, key: Column, value: Column, share: float) -> DataFrame:
    """``(key, n_rows)`` of the keys that hold at least ``share`` of all rows, null keys excluded.

    All rows count for the total, those without a key too.
    """
    per_key = compress(df, key, value).groupBy("key").agg(F.sum("weight").alias("n_rows"))
    total = per_key.agg(F.sum("n_rows").alias("total"))
    # one row on the broadcast side by construction
    return (
        per_key.filter("key IS NOT NULL").join(F.broadcast(total)).filter(F.col("n_rows") >= F.lit(share) * F.col("total")).select("key", "n_rows")
    )


def weighted_distinct_and_mode(pairs: DataFrame) -> DataFrame:
    """From ``compress``: ``(key, n_rows, n_distinct, mode_value, mode_weight)``; ties go to the smaller value."""
    known = F.col("value").isNotNull()
    # max_by on (weight, value) would give the larger value, so compare the smallest of the heaviest
    best = pairs.groupBy("key").agg(
        F.sum("weight").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.max(F.when(known, F.col("weight"))).alias("mode_weight"),
    )
    tied = pairs.filter(known).groupBy("key", "weight").agg(F.min("value").alias("mode_value"))
    tied = tied.withColumnRenamed("weight", "mode_weight")
    return best.alias("b").join(
        tied.alias("t"), F.expr("b.key <=> t.key AND b.mode_weight = t.mode_weight"), "left"
    ).select("b.key", "n_rows", "n_distinct", "mode_value", "b.mode_weight")


def weighted_percentiles(pairs: DataFrame, fractions: list[float]) -> DataFrame:
    """From ``compress``: ``(key, fraction, value)``, the smallest value whose cumulated weight reaches the fraction.

    The running sum is over distinct values, never over rows, and range-partitioned by key and value, so a key of many values is many tasks.
    """
    known = pairs.filter("value IS NOT NULL").select("key", "value", "weight")
    # one running sum over all keys in their order; a key's own begins where those of the keys before it end
    running = running_sums(known, [F.col("key"), F.col("value")], ["weight"])
    of_key = running.groupBy("key").agg(F.min(F.col("upto_weight") - F.col("weight")).alias("before"), F.sum("weight").alias("total"))
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    return (
        running.alias("r").join(of_key.alias("k"), F.col("r.key").eqNullSafe(F.col("k.key")))
        .select("r.key", "value", F.explode(wanted).alias("fraction"), (F.col("upto_weight") - F.col("before")).alias("upto"), "total")
        .filter(F.col("upto") >= F.col("fraction") * F.col("total"))
        .groupBy("key", "fraction")
        .agg(F.min("value").alias("value"))
    )


def language_code(label: Column) -> Column:
    """A label without letter case and region suffix; null and blank give null."""
    code = F.lower(F.trim(F.regexp_replace(label, "[-_].*$", "")))
    return F.when(code != "", code)


def domain_profile(web: DataFrame, languages: tuple[str, ...] = ("en", "cs")) -> DataFrame:
    """Distinct URIs, and distinct texts and their summed length per language, of each domain.

    One pass: URIs and texts become tagged values, texts as SHA-256 digests so that the
    shuffle carries 32 bytes and not the text.  Domains compare without letter case; rows
    without a domain are left out.  A length is in code points.
    """
    lang = language_code(F.col("language"))
    values = F.array(
        F.struct(F.lit("uri").alias("kind"), F.unhex(F.sha2("uri", 256)).alias("digest"), F.lit(0).alias("len")),
        F.struct(
            F.when(lang.isin(*languages), lang).alias("kind"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.length("text").alias("len"),
        ),
    )
    tagged = (
        web.filter("domain IS NOT NULL")
        .select(F.lower("domain").alias("domain"), F.explode(values).alias("v"))
        .select("domain", "v.kind", "v.digest", "v.len")
    )
    distinct = tagged.groupBy("domain", "kind", "digest").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("weight"))
    aggs = [F.count(F.when(F.col("kind") == "uri", F.col("digest"))).alias("uri_count")]
    for code in languages:
        mine = (F.col("kind") == code) & F.col("digest").isNotNull()
        aggs += [
            F.count(F.when(mine, 1)).alias(f"text_count_{code}"),
            F.coalesce(F.sum(F.when(mine, F.col("len").cast("long"))), F.lit(0)).alias(f"text_length_{code}"),
        ]
    return distinct.groupBy("domain").agg(*aggs)
