"""Document vectors: tf-idf weighted sums of word vectors, per bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import text as T
from paraloom.operators.rows import number_rows


def distinct_docs(docs: DataFrame) -> DataFrame:
    """``(bin, doc_id, text)``: each text once per bin, under its smallest id."""
    return docs.filter("text IS NOT NULL").groupBy("bin", "text").agg(F.min("doc_id").alias("doc_id")).select("bin", "doc_id", "text")


def tfidf(docs: DataFrame) -> DataFrame:
    """``(bin, doc_id, word, tf, idf)`` over distinct documents; idf is log10(documents of the bin / documents with the word)."""
    unique = distinct_docs(docs)
    sizes = unique.groupBy("bin").agg(F.count(F.lit(1)).alias("n_docs"))
    terms = unique.select("bin", "doc_id", F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("bin", "doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("bin", "word").agg(F.count(F.lit(1)).alias("df"))
    return (
        terms.join(df, ["bin", "word"]).join(sizes, "bin")
        .select("bin", "doc_id", "word", "tf", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))
    )


def doc_vectors(docs: DataFrame, wordvec: DataFrame, dims: int, most_broadcast: int = 100_000) -> DataFrame:
    """``(bin, doc_id, vec)``: the sum of tf * idf * word vector; a document without a known word gives no row.

    Weights are shuffled to their documents before they meet at most ``most_broadcast`` word
    vectors, counted first, so no vector is shuffled.  Beyond that the vectors meet in a shuffled
    join, and one sum per dimension combines on the map side.  No word list of a document is gathered.
    """
    weights = tfidf(docs)
    if wordvec.limit(most_broadcast + 1).count() <= most_broadcast:
        weighted = weights.select("bin", "doc_id", "word", (F.col("tf") * F.col("idf")).alias("w")).repartition("bin", "doc_id").join(F.broadcast(wordvec), "word")
    else:
        weighted = weights.join(wordvec, "word").withColumn("w", F.col("tf") * F.col("idf"))
    sums = weighted.groupBy("bin", "doc_id").agg(*[F.sum(F.col("w") * F.get("vec", F.lit(i))).alias(f"d{i}") for i in range(dims)])
    return sums.select("bin", "doc_id", F.array(*[F.col(f"d{i}") for i in range(dims)]).alias("vec"))


def word_vectors(vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors for a ranked vocabulary: rank r takes the vector of the r-th smallest vec_id."""
    numbered = number_rows(embeddings.select("vec_id", "embedding"), [F.col("vec_id")], "n").select("n", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return vocab.select("word", F.col("rank").alias("n")).join(numbered, "n").select("word", "vec")
