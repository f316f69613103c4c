"""Rescoring, features, ranks and reports of candidate document pairs.

Candidates are ``(bin, src_doc_id, trg_doc_id, score)``; documents ``(bin, doc_id, text)``; a
dictionary ``(src_word, trg_word, weight)``.  Pairs of words exist only where the dictionary has
them: documents are first reduced to distinct words with counts.  A pair of words is given once
by a dictionary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.functions import text as T
from paraloom.session import cut

NULL_WEIGHT = 1e-9


def _keyed(docs: DataFrame, side: str) -> DataFrame:
    return docs.select("bin", F.col("doc_id").alias(f"{side}_doc_id"), F.col("text").alias(f"{side}_text"))


def with_texts(cands: DataFrame, src: DataFrame, trg: DataFrame) -> DataFrame:
    """Candidates with both texts; a candidate without one of its documents is dropped."""
    return cands.join(_keyed(src, "src"), ["bin", "src_doc_id"]).join(_keyed(trg, "trg"), ["bin", "trg_doc_id"])


def _words(pairs: DataFrame, side: str) -> DataFrame:
    """One row per distinct document and word of one side, with its count and the document's number of tokens."""
    docs = pairs.select("bin", f"{side}_doc_id", f"{side}_text").dropDuplicates(["bin", f"{side}_doc_id"])
    words = docs.select("bin", f"{side}_doc_id", T.tokens(F.col(f"{side}_text")).alias("w"))
    each = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("word"), F.size(F.filter("w", lambda y: y == x)).alias("cnt")))
    return words.select("bin", f"{side}_doc_id", F.size("w").alias(f"{side}_size"), F.explode(each).alias("e")).select(
        "bin", f"{side}_doc_id", f"{side}_size", F.col("e.word").alias(f"{side}_word"), F.col("e.cnt").alias(f"{side}_cnt")
    )


KEY = ["bin", "src_doc_id", "trg_doc_id"]


def _matches(pairs: DataFrame, dictionary: DataFrame, same: bool = False) -> DataFrame:
    """The pairs of words of each candidate that the dictionary has, with ``same`` also equal words it hasn't, at weight 1.

    A source document meets the dictionary once, however many candidates it has.
    """
    s, t = _words(pairs, "src"), _words(pairs, "trg")
    known = s.join(dictionary.select("src_word", "trg_word", "weight"), "src_word")
    if same:
        own = dictionary.filter("src_word = trg_word").select("src_word").distinct()
        known = known.unionByName(s.join(own, "src_word", "left_anti").withColumns({"trg_word": F.col("src_word"), "weight": F.lit(1.0)}))
    return pairs.select(*KEY).join(t, ["bin", "trg_doc_id"]).join(known, ["bin", "src_doc_id", "trg_word"])


def _lookup(dictionary: DataFrame, most: int) -> Broadcast | None:
    """source word -> {target word: weight} on all executors, or None if the dictionary has more than ``most`` entries."""
    rows = dictionary.select("src_word", "trg_word", "weight").limit(most + 1).collect() if most else []
    if not most or len(rows) > most:
        return None
    table: dict[str, dict[str, float]] = {}
    for r in rows:
        table.setdefault(r["src_word"], {})[r["trg_word"]] = r["weight"]
    return dictionary.sparkSession.sparkContext.broadcast(table)


def _tokenised(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY, T.tokens(F.col("src_text")).alias("s"), T.tokens(F.col("trg_text")).alias("t"))


def _by_pair(score, table: Broadcast, names: list[str]):
    """``score(source counts, target counts, target size, dictionary)`` of each candidate as columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [score(Counter(s or ()), Counter(t or ()), len(t or ()), table.value) for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True)]
            values = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), *(pa.array(v, pa.float64()) for v in values)], [*KEY, *names])

    return run


def _ibm1(s: Counter, t: Counter, size: int, table: dict) -> tuple[float]:
    base = NULL_WEIGHT * (2 if size else 1)
    total = sum(s.values()) * math.log(base)
    for word, n in s.items():
        known = table.get(word)
        if known:
            few, many = (known, t) if len(known) < len(t) else (t, known)
            add = sum(t[x] * (known[x] - NULL_WEIGHT) for x in few if x in many) / size if size else 0.0
            if add:
                total += n * math.log1p(add / base)
    return (total,)


def log_ibm1(pairs: DataFrame, dictionary: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """``KEY, log_score``: the natural logarithm of the product over source tokens of 1e-9 + sum over target tokens of weight / size.

    A missing weight counts 1e-9, so a source word adds 2e-9 plus what the dictionary adds for
    the target words it matches.  An empty target leaves 1e-9 per source token, an empty source 0.
    A dictionary of at most ``most_broadcast`` entries is sent to the executors and candidates are
    scored where they lie; a larger one is joined.
    """
    if table := _lookup(dictionary, most_broadcast):
        return _tokenised(pairs).mapInArrow(_by_pair(_ibm1, table, ["log_score"]), _key_types(pairs) + ", log_score double")
    found = _matches(pairs, dictionary).groupBy(*KEY, "src_word").agg(
        F.first("src_cnt").alias("src_cnt"), F.sum(F.col("trg_cnt") * (F.col("weight") - NULL_WEIGHT) / F.col("trg_size")).alias("add")
    )
    more = found.groupBy(*KEY).agg(F.sum(F.col("src_cnt") * F.log1p(F.col("add") / (2 * NULL_WEIGHT))).alias("more"))
    size = lambda side: F.greatest(F.coalesce(F.size(T.tokens(F.col(f"{side}_text"))), F.lit(0)), F.lit(0))
    base = F.when(size("trg") == 0, NULL_WEIGHT).otherwise(2 * NULL_WEIGHT)
    return pairs.select(*KEY, (size("src") * F.ln(base)).alias("least")).join(more, KEY, "left").select(*KEY, (F.col("least") + F.coalesce("more", F.lit(0.0))).alias("log_score"))


def _key_types(df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in KEY)


def rescore(cands: DataFrame, src: DataFrame, trg: DataFrame, dictionary: DataFrame, mean: float = 1.0, std: float = 0.5) -> DataFrame:
    """Candidates with ``log_score`` = ln(length likelihood) + ln(IBM-1), ``score`` = exp of it, and ``rank``; ties keep the order of the old score.

    Ranking in the log domain keeps the order that a product of small numbers would lose.
    Candidates with an empty source have no length ratio and are dropped.
    """
    pairs = cut(with_texts(cands.groupBy(*KEY).agg(F.max("score").alias("knn_score")), src, trg))
    likelihood = T.length_likelihood(F.length("src_text"), F.length("trg_text"), mean, std)
    scored = log_ibm1(pairs, dictionary).join(pairs, KEY).filter(F.length("src_text") > 0).select(
        *KEY, "knn_score", (F.ln(F.greatest(likelihood, F.lit(1e-300))) + F.col("log_score")).alias("log_score")
    )
    order = Window.partitionBy("bin", "src_doc_id").orderBy(F.desc(F.round("log_score", 9)), F.desc_nulls_last("knn_score"), "trg_doc_id")
    return scored.select(*KEY, "knn_score", "log_score", F.exp("log_score").alias("score"), (F.row_number().over(order) - 1).alias("rank"))


def _resolved(s: Counter, t: Counter, size: int, table: dict) -> tuple[float, float, float]:
    total = resolved = matching = 0.0
    for word, n in s.items():
        weight = n * len(word)
        total += weight
        known = table.get(word, {})
        few, many = (known, t) if len(known) < len(t) else (t, known)
        best = max((known[x] for x in few if x in many), default=None)
        if word in t and word not in known:
            best = 1.0 if best is None else max(best, 1.0)
        if best is not None:
            resolved += weight
            matching += weight * best
    return total, resolved, matching


def features(pairs: DataFrame, dictionary: DataFrame, mean: float = 1.0, std: float = 0.5, most_broadcast: int = 2_000_000) -> DataFrame:
    """``KEY, length_sim, length_conf, weight_sim, weight_conf`` of candidate pairs with texts.

    A source word's weight is the largest of its dictionary weights to the target's words, zero
    weights counting as missing, and 1 where the target has the word itself; means are weighted
    by word length, and a denominator of 0 gives 0.  Dictionaries are sent or joined as in ``log_ibm1``.
    """
    dictionary = dictionary.filter("weight != 0")
    if table := _lookup(dictionary, most_broadcast):
        sums = _tokenised(pairs).mapInArrow(_by_pair(_resolved, table, ["total", "resolved", "matching"]), _key_types(pairs) + ", total double, resolved double, matching double")
    else:
        best = _matches(pairs, dictionary, same=True).groupBy(*KEY, "src_word").agg(F.first("src_cnt").alias("src_cnt"), F.max("weight").alias("best"))
        size = F.col("src_cnt") * F.length("src_word")
        of_pair = best.groupBy(*KEY).agg(F.sum(size).alias("resolved"), F.sum(size * F.col("best")).alias("matching"))
        total = F.aggregate(T.tokens(F.col("src_text")), F.lit(0), lambda x, w: x + F.length(w))
        sums = pairs.select(*KEY, total.alias("total")).join(of_pair, KEY, "left")
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return pairs.join(sums, KEY, "left").select(
        *KEY, T.length_likelihood(F.length("src_text"), F.length("trg_text"), mean, std).alias("length_sim"),
        T.length_confidence(F.length("src_text")).alias("length_conf"), zero("matching", "resolved").alias("weight_sim"), zero("resolved", "total").alias("weight_conf"),
    )


def correct_rank(cands: DataFrame, trg: DataFrame) -> DataFrame:
    """``(bin, src_doc_id, mindex)``: the rank of the first candidate whose text is that of the target of the source's own id; null if none is."""
    order = Window.partitionBy("bin", "src_doc_id").orderBy(F.desc("score"), "trg_doc_id")
    ranked = cands.withColumn("rank", F.row_number().over(order) - 1)
    text = lambda c, n: trg.select("bin", F.col("doc_id").alias(c), F.sha2("text", 256).alias(n))
    both = ranked.join(text("trg_doc_id", "got"), ["bin", "trg_doc_id"]).join(text("src_doc_id", "wanted"), ["bin", "src_doc_id"])
    return both.groupBy("bin", "src_doc_id").agg(F.min(F.when(F.col("got") == F.col("wanted"), F.col("rank"))).alias("mindex"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """``(mindex, freq)``, the null rank counting sources whose target wasn't found."""
    return ranks.groupBy("mindex").agg(F.count(F.lit(1)).alias("freq"))


def top_one(cands: DataFrame) -> DataFrame:
    """The best candidate of each source; ties go to the smaller target id."""
    return cands.groupBy("bin", "src_doc_id").agg(F.max_by(F.struct("trg_doc_id", "score"), F.struct("score", -F.col("trg_doc_id"))).alias("b")).select(
        "bin", "src_doc_id", "b.trg_doc_id", "b.score"
    )


def above(cands: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Candidates whose score is strictly above the threshold."""
    return cands.filter(F.col("score") > threshold)


def records(cands: DataFrame, src: DataFrame, trg: DataFrame, debug: bool = False) -> DataFrame:
    """``KEY, score, record``: a header line, both texts and, with ``debug``, the target of the source's own id, then an empty line."""
    pairs = with_texts(cands, src, trg)
    header = F.concat_ws("\t", "bin", F.col("src_doc_id").cast("string"), F.col("trg_doc_id").cast("string"), F.format_string("%.6f", "score"))
    lines = [header, F.col("src_text"), F.col("trg_text")]
    if debug:
        own = trg.select("bin", F.col("doc_id").alias("src_doc_id"), F.col("text").alias("own_text"))
        pairs = pairs.join(own, ["bin", "src_doc_id"], "left")
        lines.append(F.coalesce("own_text", F.lit("")))
    return pairs.select(*KEY, "score", F.concat_ws("\n", *lines, F.lit("")).alias("record"))


def precision_recall(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(threshold, n_above, n_correct, precision, recall)`` of ``(confidence, correct)`` rows, strictly above each threshold.

    Each row adds to the thresholds below it by one array expression; no join.
    """
    wanted = F.array(*[F.lit(float(x)) for x in thresholds])
    total = scored.agg(F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("all_correct"))
    each = scored.select(F.explode(wanted).alias("threshold"), "confidence", "correct").groupBy("threshold").agg(
        F.count(F.when(F.col("confidence") > F.col("threshold"), 1)).alias("n_above"),
        F.count(F.when((F.col("confidence") > F.col("threshold")) & F.col("correct"), 1)).alias("n_correct"),
    )
    return each.join(F.broadcast(total)).select(
        "threshold", "n_above", "n_correct", F.try_divide("n_correct", "n_above").alias("precision"), F.try_divide("n_correct", "all_correct").alias("recall")
    )


def pairs_per_domain(cands: DataFrame) -> DataFrame:
    """``(bin, n, share)`` of all pairs."""
    per = cands.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total")).alias("share"))
