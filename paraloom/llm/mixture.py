"""Mixing sources to target weights: subset-sum budget fitting on exact token lengths.

Sizes are tokens of a public tokenizer.  Each source is reduced to the histogram of its
documents' exact token lengths.  The largest total at which every source with documents can reach
its share within its repeat cap fixes a token budget per source.  A source then gives whole
copies of all its documents as far as they fit, and the rest of its budget is fitted by choosing
how many documents of each length to add: a proportional part of each length first, then a
bounded-knapsack dynamic programme over what remains, which finds the fill nearest to the budget.
Documents of a length are picked by a seeded hash, so the choice is reproducible.

Shares of sources without documents can't be met; the others keep their proportions.

Cases: documents without a source, or of a source without a target, aren't used; null, empty and
blank texts count the tokens they have (0 for null and empty) and are never picked for a
partial copy; a null ``max_repeat`` counts as 1; a null or non-positive share excludes a source;
a repeated doc_id counts as two documents; empty tables give no mixture and shares of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.llm.tokens import VOCABULARY, count_tokens
from paraloom.session import cut

WINDOW = 1 << 15


def fit(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take so that their sum is nearest to ``budget``.

    A proportional part of every length leaves a remainder below the sum of the lengths; single
    documents, longest first, bring it under ``window``; the dynamic programme does the rest,
    giving up to the longest length of what was taken so that it can also trade.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    for i in order:
        if rest <= window:
            break
        more = min(counts[i] - take[i], max(0, (rest - window // 2) // lengths[i]))
        take[i] += more
        rest -= more * lengths[i]
    # binary splitting of the free documents of each length, reachable sums as bits of an integer
    limit = (1 << (rest + max(lengths[i] for i in order) + 1)) - 1
    reach, steps = 1, []
    for i in order:
        left, size = min(counts[i] - take[i], (rest // lengths[i]) + 1), 1
        while left > 0:
            size = min(size, left)
            steps.append((i, size, reach))
            reach |= (reach << (size * lengths[i])) & limit
            left -= size
            size *= 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above_bits = reach >> rest
    above = rest + ((above_bits & -above_bits).bit_length() - 1) if above_bits else None
    at = above if above is not None and above - rest < rest - below else below
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            take[i] += size
            at -= size * lengths[i]
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n_tokens")
    lengths, counts = pdf.n_tokens.tolist(), pdf.docs.tolist()
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = int(pdf.budget.iloc[0])
    most = int(pdf.max_repeat.iloc[0])
    whole = min(budget // total, most) if total else 0
    rest = budget - whole * total if whole < most else 0
    extra = fit(lengths, counts, rest) if rest else [0] * len(lengths)
    if rest and sum(n * e for n, e in zip(lengths, extra, strict=True)) != rest and most - whole > 1:
        # no exact fill with one more copy of some documents: let them repeat within their cap
        extra = fit(lengths, [c * (most - whole) for c in counts], rest)
    each, some = zip(*(divmod(e, c) for e, c in zip(extra, counts, strict=True)), strict=True)
    return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "whole": [whole + e for e in each], "extra": some})


def sized(docs: DataFrame, target: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents whose source has a target."""
    wanted = target.filter("target_share > 0 AND source IS NOT NULL").select("source").distinct()
    used = docs.select("doc_id", "source", "text").join(F.broadcast(wanted), "source", "left_semi")
    return cut(count_tokens(used, vocabulary))


def plan(sizes: DataFrame, target: DataFrame) -> DataFrame:
    """``(source, n_tokens, whole, extra)``: copies of all documents, and how many of each length get one more."""
    hist = sizes.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    caps = target.filter("target_share > 0").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.coalesce(F.max("max_repeat"), F.lit(1)).alias("max_repeat")
    )
    totals = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("total")).filter("total > 0")
    have = totals.join(caps, "source")
    largest = have.agg(F.min(F.col("total") * F.col("max_repeat") / F.col("target_share")).alias("scale"))
    # one row; target tables are small by their nature, one row per source
    budgets = have.crossJoin(F.broadcast(largest)).select(
        "source", "max_repeat", F.floor(F.col("scale") * F.col("target_share")).cast("long").alias("budget")
    )
    return hist.join(budgets, "source").groupBy("source").applyInPandas(
        _fit_source, "source string, n_tokens long, whole long, extra long"
    )


def _mixed(docs: DataFrame, target: DataFrame, seed: int, vocabulary: str) -> DataFrame:
    sizes = sized(docs, target, vocabulary)
    chosen = cut(plan(sizes, target))
    order = Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    partial = chosen.filter("extra > 0").select("source", "n_tokens")
    # only lengths that are partly taken need an order among their documents
    ranked = sizes.join(partial, ["source", "n_tokens"], "left_semi").withColumn("rank", F.row_number().over(order))
    rest = sizes.join(partial, ["source", "n_tokens"], "left_anti").withColumn("rank", F.lit(1))
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return (
        ranked.unionByName(rest).join(chosen, ["source", "n_tokens"])
        .select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")
    )


def mix(docs: DataFrame, target: DataFrame, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of the mixture."""
    return _mixed(docs, target, seed, vocabulary)


def shares(docs: DataFrame, target: DataFrame, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target source: its share asked for and reached, tokens, documents and the most copies of one."""
    got = _mixed(docs, target, seed, vocabulary).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("max_copies")
    )
    got = cut(got)
    total = got.agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        target.select("source", "target_share", "max_repeat").join(got, "source", "left").crossJoin(F.broadcast(total))
        .select("source", "target_share", "max_repeat", zero("tokens"), zero("n_docs"), zero("max_copies"),
                F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)).alias("actual_share"))
    )
