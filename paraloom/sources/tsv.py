"""Tab- and space-separated relations and word vector files, as explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "doc": "bin string, doc_id long, text string",
    "align": "bin string, src_doc_id long, trg_doc_id long, score double",
    "dict": "src_word string, trg_word string, weight double",
    "corpus": "id string, probab double, src_text string, trg_text string",
    "web": "domain string, language string, confidence double, uri string, text string",
    "domain_info": "domain string, uri_count long, text_count_en long, text_length_en long, text_count_cs long, text_length_cs long",
    "word_similarity": "w1 string, w2 string, human double",
}


def read(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """A tab-separated relation without a header; quotes are ordinary characters, a file or a folder of files."""
    return spark.read.csv(path, schema=SCHEMAS[relation], sep="\t", quote="", escape="", mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def last_wins(docs: DataFrame) -> DataFrame:
    """One text per (bin, doc_id), the last by file position where ids repeat."""
    at = F.monotonically_increasing_id()
    return docs.withColumn("__at", at).groupBy("bin", "doc_id").agg(F.max_by("text", "__at").alias("text"))


def write(df: DataFrame, path: str, parts: int | None = None, by: str | None = None) -> None:
    """Tab-separated, without a header; ``parts`` files, rows of one value of ``by`` together."""
    if parts:
        df = df.repartition(parts, by) if by else df.repartition(parts)
    df.write.mode("overwrite").csv(path, sep="\t", quote="", escapeQuotes=False, emptyValue="", nullValue="")


def read_spaced(spark: SparkSession, path: str, names: list[str], kinds: list[str]) -> DataFrame:
    """Fields parted by any white space: parameters, vocabularies, dictionaries."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(*[f[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def analogies(spark: SparkSession, path: str) -> DataFrame:
    """``(category, a, b, c, d)``; the category is the name of the file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(name.alias("category"), f.alias("f")).filter(F.size("f") == 4).select("category", *[F.col("f")[i].alias(x) for i, x in enumerate("abcd")])


def params(spark: SparkSession, path: str) -> DataFrame:
    return read_spaced(spark, path, ["w1", "w2", "p"], ["string", "string", "double"])


def id_params(spark: SparkSession, path: str) -> DataFrame:
    return read_spaced(spark, path, ["src_id", "trg_id", "param"], ["int", "int", "double"])


def vocab(spark: SparkSession, path: str) -> DataFrame:
    return read_spaced(spark, path, ["word_id", "word", "cnt"], ["int", "string", "long"])


def word_vectors(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``word v1 .. vD`` per line; a first line of two numbers is dropped."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") > 1)
    if header:
        rows = rows.filter(~((F.size("f") == 2) & F.col("f")[0].rlike(r"^\d+$") & F.col("f")[1].rlike(r"^\d+$")))
    return rows.select(F.col("f")[0].alias("word"), F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("double")).alias("vec"))


def split_word_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and matrix rows of one file, each with the row's position."""
    numbered = vectors.withColumn("row_no", F.monotonically_increasing_id())
    return numbered.select("row_no", "word"), numbered.select("row_no", "vec")


def binary_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The binary layout: a line ``V D``, then ``word``, a space, D 32-bit floats and a line end for each word."""
    import numpy as np

    def decode(content: bytes) -> list[tuple[str, list[float]]]:
        head, _, rest = content.partition(b"\n")
        n, d = map(int, head.split())
        out, at = [], 0
        for _ in range(n):
            end = rest.index(b" ", at)
            word = rest[at:end].lstrip(b"\n").decode("utf-8", "replace")
            out.append((word, np.frombuffer(rest, "<f4", d, end + 1).astype(float).tolist()))
            at = end + 1 + 4 * d
        return out

    rows = F.udf(decode, "array<struct<word:string,vec:array<double>>>")
    return spark.read.format("binaryFile").load(path).select(F.explode(rows("content")).alias("r")).select("r.word", "r.vec")


def write_word_vectors(vectors: DataFrame, path: str, kind: str = "input") -> None:
    """Text vectors of ``(word, in_vec, out_vec)``: ``input``, ``sum`` or ``output`` vectors."""
    chosen = {"input": F.col("in_vec"), "sum": F.zip_with("in_vec", "out_vec", lambda a, b: a + b), "output": F.col("out_vec")}[kind]
    line = F.concat_ws(" ", "word", F.array_join(F.transform(chosen, lambda x: F.format_string("%.6f", x)), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Multi-line records in the order of bin, source and falling score."""
    records.orderBy("bin", "src_doc_id", F.desc("score")).select("record").write.mode("overwrite").text(path)


def missing(manifest: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """What a manifest lists and a folder lacks."""
    return manifest.join(present.select(name).distinct(), name, "left_anti")


def complete(manifest: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """``(n_listed, n_present, complete)``."""
    n = present.join(manifest.select(name).distinct(), name, "left_semi").select(name).distinct().agg(F.count(F.lit(1)).alias("n_present"))
    return manifest.agg(F.count_distinct(name).alias("n_listed")).join(F.broadcast(n)).select("n_listed", "n_present", (F.col("n_listed") == F.col("n_present")).alias("complete"))
