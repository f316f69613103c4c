"""Bounded training samples that cost each task only its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 20


def bounded(df: DataFrame, key: str, most: int, n_rows: int) -> DataFrame:
    """About ``most`` of the ``n_rows`` rows that ``df`` comes from, never above twice that, by a hash of ``key``.

    An ordered limit would send ``most`` rows of every task to the driver; here a task sends its
    share of the sample, whatever the number of tasks.
    """
    share = min(1.0, most / max(1, n_rows))
    return df.filter(F.pmod(F.xxhash64(key), F.lit(GRAIN)) < F.lit(int(share * GRAIN))).limit(2 * most)
