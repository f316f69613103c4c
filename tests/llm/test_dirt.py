"""All text queries over tables with nulls in every column, very long texts, repeated rows and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from paraloom.llm import queries

CLASHING = ["hash", "cell", "key", "keys", "lang", "h1", "n", "label", "host", "salt", "prior_en", "ids", "offsets", "n_tokens", "languages", "segments", "variant", "kept_row_id", "rank", "line_no", "word", "src", "trg", "s", "t", "copies", "whole", "extra", "n_dropped", "decoded"]


@pytest.fixture(scope="module")
def dirty(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dirty")
    rng = random.Random(7)
    long = " ".join(rng.choice(["Dlouhý", "text", "The", "same", "line.", "zaloÅ¾ena", "ก", "x" * 500, "\n", "a: b | c: d", "。"]) for _ in range(60_000))
    for name in ("cc_token", "documents", "doc_align", "corpus_pair", "lang_sample", "mix_target"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        first = df.limit(6).cache()
        parts = [first, first] + [first.withColumn(c, F.lit(None).cast(t)) for c, t in df.dtypes] + [first.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])]
        if "text" in df.columns:
            parts += [first.limit(2).withColumn("text", F.lit(x)) for x in (long, "", " \n\t", "\n", "1234", "\x00a")]
        out = df
        for p in parts:
            out = out.unionByName(p)
        for c in CLASHING:
            if c not in df.columns:
                out = out.withColumn(c, F.lit("clash"))
        out.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_survives(spark, dirty, name):
    queries.QUERIES[name](spark, dirty).write.format("noop").mode("overwrite").save()
