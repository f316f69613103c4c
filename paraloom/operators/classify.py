"""Classifiers of candidate pairs on the four features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["length_sim", "length_conf", "weight_sim", "weight_conf"]


def training_rows(features: DataFrame, ranks: DataFrame) -> DataFrame:
    """Features labelled 1 where the source's correct target ranks first, 0 where it isn't found; other ranks are left out."""
    return features.join(ranks, ["bin", "src_doc_id"]).filter("mindex = 0 OR mindex IS NULL").withColumn("label", F.when(F.col("mindex") == 0, 1.0).otherwise(0.0))


def balance(rows: DataFrame, share: float = 0.2, seed: int = 1) -> DataFrame:
    """Keeps every negative row and positives at ``share`` of half over their ratio, by a seeded hash of the key: reproducible on any layout."""
    ratio = rows.agg(F.avg("label").alias("ratio"))
    unit = F.pmod(F.xxhash64("bin", "src_doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    keep = F.least(F.lit(1.0), F.lit(share) * 0.5 / F.greatest("ratio", F.lit(1e-9)))
    return rows.join(F.broadcast(ratio)).filter((F.col("label") == 0) | (unit < keep)).drop("ratio")


def running_ratio(rows: DataFrame) -> DataFrame:
    """The share of positive rows so far within each bin, in the order of the source id."""
    w = Window.partitionBy("bin").orderBy("src_doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ratio", F.avg("label").over(w))


def fit_mlp(rows: DataFrame, seed: int = 1) -> PipelineModel:
    """A perceptron with four inputs, sixteen hidden units and two outputs."""
    mlp = MultilayerPerceptronClassifier(layers=[4, 16, 2], maxIter=60, solver="l-bfgs", seed=seed, featuresCol="x")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), mlp]).fit(rows)


def fit_tree(rows: DataFrame, seed: int = 1) -> PipelineModel:
    tree = DecisionTreeClassifier(maxDepth=7, seed=seed, featuresCol="x")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), tree]).fit(rows)


def apply(model: PipelineModel, features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(bin, src_doc_id, trg_doc_id, score)``: the probability of a correct pair, strictly above ``threshold``."""
    known = features.dropna(subset=FEATURES)
    return model.transform(known).select("bin", "src_doc_id", "trg_doc_id", vector_to_array("probability")[1].alias("score")).filter(F.col("score") > threshold)


def error_rate(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Percent of rows whose prediction isn't the label."""
    return model.transform(rows).agg((F.avg((F.col("prediction") != F.col("label")).cast("double")) * 100).alias("error_percent"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
