"""Evaluation of word vectors: rank correlation with human judgements, analogy accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import vectors as V
from paraloom.operators.rows import running_sums


def word_similarity(judged: DataFrame, vocab: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """``(w1, w2, human, model)``; words match as given or in lower case, others take the vector of ``unknown``, else of zeros."""
    v = vocab.select("word", "vec").unionByName(
        vocab.filter(F.lower("word") != F.col("word")).select(F.lower("word").alias("word"), "vec")
    ).groupBy("word").agg(F.first("vec").alias("vec"))
    unk = vocab.filter(F.col("word") == unknown).agg(F.first("vec").alias("unk"))
    side = lambda w, n: v.select(F.col("word").alias(w), F.col("vec").alias(n))
    joined = judged.withColumns({"w1": F.lower("w1"), "w2": F.lower("w2")}).join(side("w1", "a"), "w1", "left").join(side("w2", "b"), "w2", "left")
    joined = joined.join(F.broadcast(unk), F.lit(True), "left")
    return joined.select("w1", "w2", "human", V.correlation_similarity(F.coalesce("a", "unk"), F.coalesce("b", "unk")).alias("model"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(rho, n)``: Pearson correlation of average ranks; rows with a null are left out.

    Ranks come from running sums of counts per distinct value, so ties need no window over rows.
    """
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        per = known.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return running_sums(per, [F.col(c)], ["n"]).select(F.col(c), (F.col("upto_n") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    return known.join(ranks(a), a).join(ranks(b), b).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"), F.count(F.lit(1)).alias("n"))


def analogy_accuracy(answers: DataFrame, semantic: list[str]) -> DataFrame:
    """``(kind, category, n, correct, accuracy)`` with subtotals by kind and the total, as nulls, in one pass."""
    kind = F.when(F.col("category").isin(*semantic), "semantic").otherwise("syntactic")
    right = (F.upper("answer") == F.upper("d")).cast("long")
    return answers.withColumn("kind", kind).rollup("kind", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("correct"), F.avg(right).alias("accuracy")
    )
