"""Statistics of labelled samples: moments, histograms, ROC and match curves, nearest-label classification, projections and mixtures."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.functions import metrics
from paraloom.operators.rows import running_sums


def moments(df: DataFrame, column: str, by: str) -> DataFrame:
    """``(by, position, n, mean, variance)`` of each place of the vectors, with population variance."""
    each = df.select(by, F.posexplode(column).alias("position", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy(by, "position").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)`` of equal bins; values beyond the ends count in the outer bins, nulls and NaN nowhere."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int")
    known = df.filter(value.isNotNull() & ~F.isnan(value))
    return known.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def roc(scored: DataFrame) -> DataFrame:
    """``(score, true_rate, false_rate)`` for accepting scores of at least each distinct one, of ``(score, correct)`` rows.

    Scores are counted first, so the running sums are over distinct scores.
    """
    per = scored.groupBy("score").agg(F.sum(F.col("correct").cast("long")).alias("p"), F.sum((~F.col("correct")).cast("long")).alias("f"))
    summed = running_sums(per, [F.desc("score")], ["p", "f"])
    total = per.agg(F.sum("p").alias("all_p"), F.sum("f").alias("all_f"))
    return summed.select("score", F.col("upto_p").alias("p"), F.col("upto_f").alias("f")).join(F.broadcast(total)).select(
        "score", F.try_divide("p", "all_p").alias("true_rate"), F.try_divide("f", "all_f").alias("false_rate")
    )


def nearest_label(queries: DataFrame, known: DataFrame, block: int = 20_000) -> DataFrame:
    """``(id, label, got)``: the label of the Euclidean nearest other row; ``queries`` is a stated set.

    Both sides are dealt to blocks, and a block of queries meets each block of known rows in an equi-join.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    n_q, n_k = parts(queries), parts(known)

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    q = dealt(queries.select("id", "label", F.col("vec").alias("q")), "id", "qb", n_q, "kb", n_k)
    others = dealt(known.select(F.col("id").alias("other"), F.col("label").alias("got"), "vec"), "other", "kb", n_k, "qb", n_q)
    d = others.join(q, ["qb", "kb"]).filter("id != other")
    best = F.min_by("got", F.struct(F.round(metrics.square_distance(F.col("q"), F.col("vec")), 9), "other"))
    return d.groupBy("id", "label").agg(best.alias("got"))


def match_curve(ranks: DataFrame, most: int) -> DataFrame:
    """``(rank, share)``: the share of sources whose right answer is within each rank, from ``mindex``."""
    total = ranks.agg(F.count(F.lit(1)).alias("total"))
    steps = F.explode(F.sequence(F.coalesce("mindex", F.lit(most)).cast("int"), F.lit(most)))
    hits = ranks.select(steps.alias("rank")).filter(F.col("rank") < most).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(total)).select("rank", (F.col("n") / F.col("total")).alias("share"))


def principal(df: DataFrame, column: str, k: int) -> DataFrame:
    """``df`` with ``projected``, the first ``k`` principal components of the vectors."""
    given = df.withColumn("__x", array_to_vector(column))
    return PCA(k=k, inputCol="__x", outputCol="__y").fit(given).transform(given).withColumn("projected", vector_to_array("__y")).drop("__x", "__y")


def mixture(df: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """``df`` with ``component`` and its probability ``share`` under a Gaussian mixture."""
    given = df.withColumn("__x", array_to_vector(column))
    model = GaussianMixture(k=k, seed=seed, featuresCol="__x", predictionCol="component", probabilityCol="__p").fit(given)
    return model.transform(given).withColumn("share", F.array_max(vector_to_array("__p"))).drop("__x", "__p")


def regression(df: DataFrame, column: str, label: str, ridge: float = 0.0) -> DataFrame:
    """``df`` with ``predicted`` by linear regression."""
    given = df.withColumn("__x", array_to_vector(column))
    model = LinearRegression(featuresCol="__x", labelCol=label, predictionCol="predicted", regParam=ridge).fit(given)
    return model.transform(given).drop("__x")
