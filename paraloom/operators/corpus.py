"""The sentence-aligned training corpus: cleaning, statistics, dictionaries, vocabularies, phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.functions import text as T
from paraloom.session import cut

PAIR_ORDER = ("id", "probab", "src_text", "trg_text")


def rejection(least: int, most: int) -> Column:
    """Why a pair is rejected, the first reason in order; null for a pair that is kept."""
    n_src, n_trg = F.coalesce(F.size(F.split(F.trim("src_text"), r"\s+")), F.lit(0)), F.coalesce(F.size(F.split(F.trim("trg_text"), r"\s+")), F.lit(0))
    empty = F.coalesce(F.trim("src_text"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("trg_text"), F.lit("")).eqNullSafe("")
    return (
        F.when(empty | (n_src < least) | (n_trg < least), "min_tokens")
        .when((n_src > most) | (n_trg > most), "max_tokens")
        .when(~T.has_letter(F.col("src_text")), "src_no_letter")
        .when(~T.has_letter(F.col("trg_text")), "trg_no_letter")
    )


def clean(pairs: DataFrame, least: int = 1, most: int = 50) -> DataFrame:
    """Pairs of ``least`` to ``most`` tokens on both sides with a letter on both sides."""
    return pairs.filter(rejection(least, most).isNull())


def rejections(pairs: DataFrame, least: int = 1, most: int = 50) -> DataFrame:
    """``(reason, n)``, kept pairs under ``kept``."""
    return pairs.groupBy(F.coalesce(rejection(least, most), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def length_ratio(pairs: DataFrame) -> DataFrame:
    """Mean and population deviation of target to source length in characters."""
    known = pairs.filter("length(src_text) > 0 AND trg_text IS NOT NULL")
    ratio = F.length("trg_text").cast("double") / F.length("src_text")
    return known.agg(F.avg(ratio).alias("mean"), F.stddev_pop(ratio).alias("std"), F.count(F.lit(1)).alias("n"))


def dice(pairs: DataFrame, least: float = 0.1) -> DataFrame:
    """``(src_word, trg_word, weight)``: 2 * both / (src + trg) above ``least``, counted over pairs that hold the words.

    Words are counted on their own first, so the pairs of words meet only counts.
    """
    sets = pairs.select(F.array_distinct(T.tokens(F.col("src_text"))).alias("s"), F.array_distinct(T.tokens(F.col("trg_text"))).alias("t"))
    of = lambda side, word, n: sets.select(F.explode(side).alias(word)).groupBy(word).agg(F.count(F.lit(1)).alias(n))
    both = sets.select(F.explode("s").alias("src_word"), "t").select("src_word", F.explode("t").alias("trg_word")).groupBy("src_word", "trg_word").agg(F.count(F.lit(1)).alias("n"))
    weight = 2 * F.col("n") / (F.col("n_src") + F.col("n_trg"))
    return (
        both.join(of("s", "src_word", "n_src"), "src_word").join(of("t", "trg_word", "n_trg"), "trg_word")
        .select("src_word", "trg_word", weight.alias("weight")).filter(F.col("weight") > least)
    )


def conditional_params(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward p(trg | src) and reverse p(src | trg) relative frequencies over pairs of words: ``(w1, w2, p)``."""
    sets = pairs.select(F.array_distinct(T.tokens(F.col("src_text"))).alias("s"), F.array_distinct(T.tokens(F.col("trg_text"))).alias("t"))
    both = sets.select(F.explode("s").alias("s"), "t").select("s", F.explode("t").alias("t")).groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))
    both = cut(both)
    total = lambda c: both.groupBy(c).agg(F.sum("n").alias("total"))
    forward = both.join(total("s"), "s").select(F.col("s").alias("w1"), F.col("t").alias("w2"), (F.col("n") / F.col("total")).alias("p"))
    reverse = both.join(total("t"), "t").select(F.col("t").alias("w1"), F.col("s").alias("w2"), (F.col("n") / F.col("total")).alias("p"))
    return forward, reverse


def merge_params(forward: DataFrame, reverse: DataFrame, least: float = 0.0, log: bool = False) -> DataFrame:
    """``(src_word, trg_word, weight)``: the harmonic mean of both directions, at least ``least``.

    Pairs of one direction only are dropped; zero probabilities give weight 0.  With ``log`` the
    inputs are natural logarithms.
    """
    value = F.exp("p") if log else F.col("p")
    f = forward.select(F.col("w1").alias("src_word"), F.col("w2").alias("trg_word"), value.alias("f"))
    r = reverse.select(F.col("w2").alias("src_word"), F.col("w1").alias("trg_word"), value.alias("r"))
    mean = F.coalesce(F.try_divide(2 * F.col("f") * F.col("r"), F.col("f") + F.col("r")), F.lit(0.0))
    return f.join(r, ["src_word", "trg_word"]).select("src_word", "trg_word", mean.alias("weight")).filter(F.col("weight") >= least)


def decode_params(params: DataFrame, src_vocab: DataFrame, trg_vocab: DataFrame) -> DataFrame:
    """``(w1, w2, p)`` from ``(src_id, trg_id, param)`` and two ``(word_id, word)`` vocabularies; unknown ids are dropped."""
    s = src_vocab.select(F.col("word_id").alias("src_id"), F.col("word").alias("w1"))
    t = trg_vocab.select(F.col("word_id").alias("trg_id"), F.col("word").alias("w2"))
    return params.join(s, "src_id").join(t, "trg_id").select("w1", "w2", F.col("param").alias("p"))


def vocabulary(texts: Column, df: DataFrame, least: int = 1) -> DataFrame:
    """``(word, cnt)`` of at least ``least`` occurrences."""
    words = df.select(F.explode(T.tokens(texts)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= least)


def ranked(vocab: DataFrame) -> DataFrame:
    """``(word, cnt, rank)``, rank 0 the most frequent; ties by the word's bytes."""
    from paraloom.operators.rows import number_rows

    return number_rows(vocab, [F.desc("cnt"), F.asc("word")], "rank")


def phrase_scores(texts: Column, df: DataFrame, least: int = 5, threshold: float = 100.0) -> DataFrame:
    """``(first, second, score)`` of the bigrams to merge: (ab - least) / a / b * N above ``threshold``.

    Bigrams are counted within a text; words and bigrams below ``least`` give none.
    """
    words = df.select(T.tokens(texts).alias("w"))
    n = F.size("w")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("w", i - 1).alias("first"), F.get("w", i).alias("second")))
    uni = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    total = uni.agg(F.sum("cnt").alias("total"))
    bi = words.filter(n > 1).select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= least)
    common = uni.filter(F.col("cnt") >= least)
    score = (F.col("both") - least) / F.col("a") / F.col("b") * F.col("total")
    return (
        bi.join(common.select(F.col("word").alias("first"), F.col("cnt").alias("a")), "first")
        .join(common.select(F.col("word").alias("second"), F.col("cnt").alias("b")), "second")
        .join(F.broadcast(total)).select("first", "second", score.alias("score")).filter(F.col("score") > threshold)
    )


def merge_phrases(words: Column, phrases: Column) -> Column:
    """Tokens with marked bigrams joined by an underscore, left to right; a merged word starts no further bigram.

    ``phrases`` is a map from ``first second`` to anything, of bounded size.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("merged"))

    def step(acc, word):
        joins = (F.size(acc["done"]) > 0) & ~acc["merged"] & F.map_contains_key(phrases, F.concat_ws(" ", F.try_element_at(acc["done"], F.lit(-1)), word))
        head = F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0)))
        glued = F.concat(head, F.array(F.concat_ws("_", F.try_element_at(acc["done"], F.lit(-1)), word)))
        return F.struct(F.when(joins, glued).otherwise(F.concat(acc["done"], F.array(word))).alias("done"), F.coalesce(joins, F.lit(False)).alias("merged"))

    return F.aggregate(words, start, step, lambda acc: acc["done"])


def _word_list(words: DataFrame) -> pa.Array:
    """The distinct words of a column ``w`` of arrays, the most frequent first."""
    counts = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).toArrow()
    return counts.sort_by([("n", "descending"), ("word", "ascending")])["word"].combine_chunks().cast(pa.string())


def _lists(lengths: pa.Array, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths.to_numpy(zero_copy_only=False))].astype(np.int32)), values)


def _coded(words: dict[str, pa.Array]):
    """Token lists as lists of the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_lists(b.column(c).value_lengths(), pc.index_in(b.column(c).flatten(), value_set=words[c]).cast(pa.int32())) for c in ("s", "t")]
            yield pa.RecordBatch.from_arrays(ids, ["s", "t"])

    return run


def _cells(width: int):
    """One row for the links of a bucket: each link's cell, the number of links of each (unit, target word) and its copies, and the word pair of each cell."""

    def run(rows: pa.Table) -> pa.Table:
        s = rows["s"].combine_chunks()
        n = s.value_lengths().to_numpy(zero_copy_only=False)
        keys, cell = np.unique(np.repeat(rows["t"].to_numpy().astype(np.int64) * width, n) + s.flatten().to_numpy(), return_inverse=True)
        parts = (cell.astype(np.int32), n.astype(np.int32), rows["copies"].to_numpy().astype(np.int64), keys)
        return pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("cell", "n", "copies", "keys"), parts, strict=True)})

    return run


def _expected(width: int, totals: list[np.ndarray], prune: float, words: tuple[pa.Array, pa.Array] | None):
    """Of each bucket the expected counts of the round after those of ``totals``, summed by source word: ``(s, total)``; with ``words`` the probabilities of the last of them.

    Earlier rounds of the bucket are gone through again, so that nothing but the totals passes from round to round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cell, n, copies, keys = (np.frombuffer(b.column(c)[k].as_buffer(), kind) for c, kind in (("cell", np.int32), ("n", np.int32), ("copies", np.int64), ("keys", np.int64)))
                src, p, first = keys % width, np.ones(len(keys)), np.cumsum(n) - n
                for total in [*totals, None][: len(totals) + (words is None)]:
                    weight = p[cell]
                    sums = np.add.reduceat(weight, first)
                    # a word whose every link was pruned gives no count
                    share = np.divide(copies, sums, out=np.zeros(len(sums)), where=sums > 0)
                    p = np.bincount(cell, weights=weight * np.repeat(share, n), minlength=len(keys))
                    if total is not None:
                        p = np.divide(p, total[src], out=np.zeros(len(p)), where=total[src] > 0)
                        p[p < prune] = 0
                if words is None:
                    sums = np.bincount(src, weights=p)
                    there = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["s", "total"])
                else:
                    kept = np.flatnonzero(p)
                    yield pa.RecordBatch.from_arrays([words[0].take(pa.array(src[kept])), words[1].take(pa.array(keys[kept] // width)), pa.array(p[kept])], ["src_word", "trg_word", "p"])

    return run


def ibm1(pairs: DataFrame, rounds: int = 5, prune: float = 1e-7, per_bucket: int = 1_000_000) -> DataFrame:
    """``(src_word, trg_word, p)``: translation probabilities p(trg | src) by expectation maximisation.

    A source word NULL takes part.  Probabilities below ``prune`` are dropped.

    Units are dealt once to buckets by target word, about ``per_bucket`` links each, so all that a
    round counts of a target word lies in one bucket; between rounds only one total for each source
    word is summed.  A frequent target word's links are held by one task, the word lists and the
    totals by the driver.
    """
    spark = pairs.sparkSession
    sets = pairs.filter("src_text IS NOT NULL AND trg_text IS NOT NULL").select(
        F.concat(F.array(F.lit("<null>")), F.array_distinct(T.tokens(F.col("src_text")))).alias("s"), F.array_distinct(T.tokens(F.col("trg_text"))).alias("t")
    )
    words = {c: _word_list(sets.filter(F.size("t") > 0).select(F.col(c).alias("w"))) for c in ("s", "t")}
    width = max(1, len(words["s"]))
    units = cut(sets.filter(F.size("t") > 0).mapInArrow(_coded(words), "s array<int>, t array<int>").groupBy("s", "t").agg(F.count(F.lit(1)).alias("copies")))
    n = units.agg(F.sum(F.size("s").cast("long") * F.size("t"))).first()[0] or 0
    buckets = max(4 * spark.sparkContext.defaultParallelism, -(-n // per_bucket))
    # numbers follow the frequency, so the remainder deals frequent words to different buckets
    dealt = units.select(F.explode("t").alias("t"), "s", "copies").withColumn("bucket", F.col("t") % buckets)
    cells = cut(dealt.groupBy("bucket").applyInArrow(lambda rows: _cells(width)(rows), "cell binary, n binary, copies binary, keys binary"))
    totals: list[np.ndarray] = []
    for _ in range(rounds):
        got = cells.mapInArrow(_expected(width, totals, prune, None), "s long, total double").groupBy("s").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros(width)
        total[got["s"].to_numpy()] = got["total"].to_numpy()
        totals.append(total)
    return cut(cells.mapInArrow(_expected(width, totals, prune, (words["s"], words["t"])), "src_word string, trg_word string, p double"))


def lemmatise(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``words`` with ``lemma``, by a ``(word, lemma)`` dictionary; a word it doesn't have is its own lemma."""
    unique = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    return words.join(unique, "word", "left").withColumn("lemma", F.coalesce("lemma", "word"))


def kept_positions(words: Column, keep: Column) -> Column:
    """For each position its index among the positions kept, null where dropped; ``keep`` is an array of booleans."""
    upto = lambda i: F.size(F.filter(F.slice(keep, 1, i + 1), lambda k: k)) - 1
    return F.transform(words, lambda w, i: F.when(F.get(keep, i), upto(i)))


def join_lines(pairs: DataFrame) -> DataFrame:
    """``line``: target and source parted by three bars, for external aligners; a pair without one of them gives none."""
    return pairs.filter("src_text IS NOT NULL AND trg_text IS NOT NULL").select(F.concat_ws(" ||| ", "trg_text", "src_text").alias("line"))
