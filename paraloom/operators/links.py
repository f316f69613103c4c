"""Word alignments: parsing, symmetrisation, interpolation, and training pairs for word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.functions import text as T

LINKS = "array<struct<i:int,j:int>>"


def parse(pharaoh: Column) -> Column:
    """``0-1 2-3`` as an array of (i, j)."""
    found = F.filter(F.split(F.trim(pharaoh), r"\s+"), lambda x: x.rlike(r"^\d+-\d+$"))
    return F.transform(found, lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("i"), F.split(x, "-")[1].cast("int").alias("j")))


def triple(line: Column) -> Column:
    """``target {##} source {##} links`` as a struct of token arrays and links."""
    part = F.split(line, r" \{##\} ")
    return F.struct(F.split(part[1], " ").alias("src_tokens"), F.split(part[0], " ").alias("trg_tokens"), parse(F.coalesce(F.get(part, F.lit(2)), F.lit(""))).alias("links"))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def grow(forward: set[tuple[int, int]], reverse: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Starts from the agreed links, grows to neighbours (diagonal too) that link a free word, then adds the rest whose words are both free."""
    either, links = forward | reverse, forward & reverse
    left, right = {i for i, _ in links}, {j for _, j in links}
    around = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    new = True
    while new:
        new = False
        for i, j in sorted(links):
            for x, y in around:
                at = (i + x, j + y)
                if at in either and at not in links and (at[0] not in left or at[1] not in right):
                    links.add(at)
                    left.add(at[0])
                    right.add(at[1])
                    new = True
    for side in (forward, reverse):
        for i, j in sorted(side):
            if i not in left and j not in right:
                links.add((i, j))
                left.add(i)
                right.add(j)
    return links


def grow_diag_final_and(df: DataFrame, key: str, forward: str, reverse: str) -> DataFrame:
    """``(key, links)``, the symmetrised links of each row; a null side counts as no links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        for b in batches:
            sets = [[{(x["i"], x["j"]) for x in xs or ()} for xs in b.column(c).to_pylist()] for c in (forward, reverse)]
            out = [[{"i": i, "j": j} for i, j in sorted(grow(f, r))] for f, r in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, kind)], [key, "links"])

    return df.select(key, forward, reverse).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, links {LINKS}")


def interpolate(links: Column, size: Column) -> Column:
    """For each of ``size`` source positions its target: the last link, else the integer mean of the nearest linked neighbours, else the one there is."""
    at = lambda p: F.element_at(F.filter(links, lambda x: x["i"] == p), -1)["j"]
    has = lambda p: F.exists(links, lambda x: x["i"] == p)
    before = lambda p: F.array_max(F.filter(F.transform(links, lambda x: x["i"]), lambda i: i < p))
    after = lambda p: F.array_min(F.filter(F.transform(links, lambda x: x["i"]), lambda i: i > p))

    def one(p: Column) -> Column:
        a, b = before(p), after(p)
        mean = F.floor((F.try_element_at(F.transform(F.filter(links, lambda x: x["i"] == a), lambda x: x["j"]), F.lit(-1)) + F.try_element_at(F.transform(F.filter(links, lambda x: x["i"] == b), lambda x: x["j"]), F.lit(-1))) / 2).cast("int")
        only = F.coalesce(
            F.try_element_at(F.transform(F.filter(links, lambda x: x["i"] == a), lambda x: x["j"]), F.lit(-1)),
            F.try_element_at(F.transform(F.filter(links, lambda x: x["i"] == b), lambda x: x["j"]), F.lit(-1)),
        )
        return F.when(has(p), F.try_element_at(F.transform(F.filter(links, lambda x: x["i"] == p), lambda x: x["j"]), F.lit(-1))).otherwise(F.coalesce(mean, only))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), one)).otherwise(F.array().cast("array<int>"))


def uniform(src_size: Column, trg_size: Column) -> Column:
    """For each source position s the target floor(s * target size / source size)."""
    return F.when(src_size > 0, F.transform(F.sequence(F.lit(0), src_size - 1), lambda s: F.floor(s * trg_size / src_size).cast("int"))).otherwise(F.array().cast("array<int>"))


def skip_pairs(words: Column, window: int) -> Column:
    """(word, context) of each position and its neighbours within the window."""
    n = F.size(words)
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, n - 1)), lambda j: j != i),
        lambda j: F.struct(F.get(words, i).alias("word"), F.get(words, j).alias("context")),
    ))
    return F.when(n > 0, F.flatten(spread))


def random_skip_pairs(words: Column, window: int, *key: Column) -> Column:
    """``skip_pairs`` with a window of its own at each position, 1 to ``window``, drawn from the key and the position."""
    n = F.size(words)

    def around(i: Column) -> Column:
        reach = F.lit(window) - F.floor(T.draw(*key, i) * window).cast("int")
        near = F.filter(F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach, n - 1)), lambda j: j != i)
        return F.transform(near, lambda j: F.struct(F.get(words, i).alias("word"), F.get(words, j).alias("context")))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), around)))


def cross_pairs(src: Column, trg: Column, target_of: Column, window: int) -> Column:
    """(source word, target context) around each source position's aligned target position."""
    n = F.size(trg)
    spread = F.transform(src, lambda w, i: F.transform(
        F.sequence(F.greatest(F.get(target_of, i) - window, F.lit(0)), F.least(F.get(target_of, i) + window, n - 1)),
        lambda j: F.struct(w.alias("word"), F.get(trg, j).alias("context")),
    ))
    return F.when((F.size(src) > 0) & (n > 0), F.flatten(spread))
