"""Row numbers, bins and splits without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraloom.session import cut


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """``df`` with a global 0-based row number in the given order.

    Rows are range-partitioned and sorted; a partition's rows are numbered where they lie and
    shifted by the number of rows in the partitions before it.  Only one count per partition
    reaches the driver.
    """
    spark = df.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    return placed.withColumn("__part", part).join(F.broadcast(_before(counts, ["n"])), "__part").withColumn(name, (F.col("before_n") + at).cast("long")).drop("__id", "__part", "before_n")


def _before(per_part: DataFrame, names: list[str]) -> DataFrame:
    """``(__part, before_<name>)``: the sums over the partitions before each; one row a partition, so one task holds it."""
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return cut(per_part.select("__part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"before_{n}") for n in names]))


def running_sums(df: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """``df`` with ``upto_<name>``, the sum of each column over all rows up to and with this one in the given order.

    Rows are range-partitioned; each partition sums its own and is shifted by the sums of those before it.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    shift = _before(placed.groupBy("__part").agg(*[F.sum(n).alias(n) for n in names]), names)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"__upto_{n}": F.sum(n).over(w) for n in names}).join(F.broadcast(shift), "__part")
    return summed.withColumns({f"upto_{n}": F.col(f"__upto_{n}") + F.col(f"before_{n}") for n in names}).drop("__part", *[f"__upto_{n}" for n in names], *[f"before_{n}" for n in names])


def bins(numbered: DataFrame, size: int) -> DataFrame:
    """Supervised bins: ``bin`` is the eight-digit number of the block of ``size`` rows, ``doc_id`` the row number."""
    return numbered.withColumn("bin", F.lpad(F.floor(F.col("row_no") / size).cast("string"), 8, "0")).withColumn("doc_id", F.col("row_no"))


def head_tail(numbered: DataFrame, total: int, percent: int) -> DataFrame:
    """``part`` is head for the first floor(n * percent / 100) rows, tail for the others."""
    return numbered.withColumn("part", F.when(F.col("row_no") < total * percent // 100, "head").otherwise("tail"))


def web_bins(web: DataFrame, languages: tuple[str, ...], language: Column) -> DataFrame:
    """Web documents numbered per language in the order of their domain and row: ``(bin, language, doc_id, row_id, text)``."""
    parts = []
    for code in languages:
        own = web.filter((language == code) & F.col("domain").isNotNull() & F.col("text").isNotNull()).select(
            F.lower("domain").alias("bin"), F.lit(code).alias("language"), "row_id", "text"
        )
        parts.append(number_rows(own, [F.col("bin"), F.col("row_id")], "doc_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_lengths(numbered: DataFrame, value: str, block: int = 100_000) -> DataFrame:
    """``(first_row, n, value)`` of each run of equal values in the order of ``row_no``, a 0-based number without gaps.

    Rows are compared with the one before within blocks of ``block`` rows; the last row of each block is handed to the next.
    """
    own = numbered.select("row_no", F.col(value).alias("value"), F.floor(F.col("row_no") / block).alias("block"))
    handed = own.filter(F.col("row_no") % block == block - 1).withColumn("block", F.col("block") + 1)
    w = Window.partitionBy("block").orderBy("row_no")
    changed = own.unionByName(handed).withColumn("changed", ~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag("row_no").over(w).isNull())
    starts = changed.filter((F.floor(F.col("row_no") / block) == F.col("block")) & F.col("changed"))
    # a run ends where the next begins
    counted = number_rows(starts.select("row_no", "value"), [F.col("row_no")], "run")
    ends = counted.select((F.col("run") - 1).alias("run"), F.col("row_no").alias("end"))
    total = numbered.agg(F.count(F.lit(1)).alias("total"))
    return counted.join(ends, "run", "left").join(F.broadcast(total)).select(
        F.col("row_no").alias("first_row"), (F.coalesce("end", "total") - F.col("row_no")).alias("n"), "value"
    )


def chunks(numbered: DataFrame, size: int = 100_000) -> DataFrame:
    """``chunk``: the number of the block of ``size`` rows."""
    return numbered.withColumn("chunk", F.floor(F.col("row_no") / size).cast("long"))
