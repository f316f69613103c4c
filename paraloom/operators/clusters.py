"""Spherical k-means with a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import vectors as V


def _centroids(assigned: DataFrame, dims: int) -> DataFrame:
    """Normalised means; a cluster's count starts at one."""
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("vec", F.lit(i))).alias(f"d{i}") for i in range(dims)])
    mean = F.array(*[F.col(f"d{i}") / (F.col("n") + 1) for i in range(dims)])
    return sums.select("cluster", V.unit(mean).alias("centroid"))


def spherical_kmeans(points: DataFrame, k: int, dims: int, rounds: int = 10) -> DataFrame:
    """``(id, cluster)`` of ``(id, vec)``: seeds are id modulo k, assignment takes the largest dot product with the unnormalised point.

    The k centroids travel as literals, k * dims numbers, so a round is one aggregation without a
    join.  Ties go to the smaller cluster.
    """
    assigned = points.withColumn("cluster", F.pmod(F.col("id"), F.lit(k)).cast("int"))
    for _ in range(rounds):
        rows = sorted(_centroids(assigned, dims).collect(), key=lambda r: r.cluster)
        options = F.array(*[F.struct(F.lit(int(r.cluster)).alias("c"), F.array(*[F.lit(float(x)) for x in r.centroid]).alias("v")) for r in rows])
        scored = F.transform(options, lambda o: F.struct(F.round(V.dot(F.col("vec"), o["v"]), 12).alias("s"), (-o["c"]).alias("c")))
        assigned = points.withColumn("cluster", (-F.array_max(scored)["c"]).cast("int"))
    return assigned.select("id", "cluster")
