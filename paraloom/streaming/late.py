"""New web text as a stream: windowed counts per domain that wait for late loads, and scoring against a static dictionary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def domain_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``(window_start, domain, n)`` by fetch time; rows later than ``late`` behind the newest are dropped by the watermark.

    Works on streams and on tables alike, where the watermark has no effect.
    """
    known = stream.filter("fetched_at IS NOT NULL AND domain IS NOT NULL").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    counted = known.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window), F.lower("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "domain", "n")


def score_each(stream: DataFrame, score: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that scores every new batch of candidates and hands the rows with the batch's number to ``write``.

    A batch may come again after a failure; ``write`` overwrites by its number to stay exact.
    """
    return stream.writeStream.foreachBatch(lambda df, n: write(score(df), n)).option("checkpointLocation", checkpoint).start()
