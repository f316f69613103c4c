"""Top-k similarity joins of document vectors within bins: exact, blocked and by hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.functions import vectors as V
from paraloom.session import cut

PAIRS = "bin string, src_doc_id long, trg_doc_id long, cosine double"


def _top(pairs: DataFrame, k: int) -> DataFrame:
    # equal up to rounding is a tie
    order = Window.partitionBy("bin", "src_doc_id").orderBy(F.desc(F.round("cosine", 9)), "trg_doc_id")
    return pairs.withColumn("knn_rank", F.row_number().over(order) - 1).filter(F.col("knn_rank") < k).select(
        "bin", "src_doc_id", "trg_doc_id", V.angular(F.col("cosine")).alias("score"), "knn_rank"
    )


def exact(src: DataFrame, trg: DataFrame, k: int = 10) -> DataFrame:
    """``(bin, src_doc_id, trg_doc_id, score, knn_rank)`` by a join on the bin; ties go to the smaller target id.

    For bins of bounded size; ``blocked`` is for large ones.
    """
    s = src.select("bin", F.col("doc_id").alias("src_doc_id"), V.unit(F.col("vec")).alias("u"))
    t = trg.select("bin", F.col("doc_id").alias("trg_doc_id"), V.unit(F.col("vec")).alias("v"))
    return _top(s.join(t, "bin").select("bin", "src_doc_id", "trg_doc_id", V.dot(F.col("u"), F.col("v")).alias("cosine")), k)


def _side(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of one block."""
    rows = column.slice(row, 1).flatten()
    return rows.field("doc_id").to_numpy(zero_copy_only=False), rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Of each band the codes of all rows, the signs of ``bits`` projections."""
    codes = (x @ planes >= 0).reshape(len(x), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return np.ascontiguousarray(codes.T.astype(np.min_scalar_type((1 << bits) - 1)))


def _block(k: int, kind: pa.DataType, planes: np.ndarray | None = None, bits: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                src, x = _side(b.column("s"), i)
                trg, y = _side(b.column("t"), i)
                sims = x @ y.T
                if planes is not None:
                    shared = np.zeros(sims.shape, dtype=bool)
                    for one, other in zip(_codes(x, planes, bits), _codes(y, planes, bits), strict=True):
                        shared |= one[:, None] == other
                    sims[~shared] = -np.inf
                n = min(k, len(trg))
                # the block's top k of each row, with those that tie up to rounding
                cutoff = -np.partition(-sims, n - 1, axis=1)[:, n - 1] - 1e-8
                r, c = np.nonzero((sims >= cutoff[:, None]) & (sims > -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("bin")[i].as_py()] * len(r), pa.string()), pa.array(src[r], kind), pa.array(trg[c], kind), pa.array(sims[r, c])],
                    ["bin", "src_doc_id", "trg_doc_id", "cosine"],
                )

    return run


def block_pairs(src: DataFrame, trg: DataFrame, k: int, block: int, planes: np.ndarray | None = None, bits: int = 0) -> DataFrame:
    """``(bin, src_doc_id, trg_doc_id, cosine)``: of each source row the top ``k``, and what ties with them, of each block of its bin's targets.

    Rows of a bin are dealt to blocks of about ``block`` rows a side by hash, the number of blocks
    following the bin's size.  A block is copied once for each block of the other side and meets
    it in a join on (bin, source block, target block), so the pairs of blocks of a large bin are
    spread over all tasks and a task holds two blocks at a time.  With ``planes`` only rows that
    share the code of a band of ``bits`` planes are taken.
    """
    sizes = lambda df, name: df.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = cut(sizes(src, "s_blocks").join(sizes(trg, "t_blocks"), "bin"))

    def dealt(df: DataFrame, own: str, other: str, alias: str) -> DataFrame:
        placed = df.join(blocks, "bin").withColumn(f"{own}_block", F.pmod(F.xxhash64("doc_id"), F.col(f"{own}_blocks")).cast("int"))
        rows = placed.groupBy("bin", f"{own}_block", f"{other}_blocks").agg(F.collect_list(F.struct("doc_id", V.unit(F.col("vec")).alias("vec"))).alias(alias))
        return rows.select("bin", f"{own}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"), alias)

    met = dealt(src, "s", "t", "s").join(dealt(trg, "t", "s", "t"), ["bin", "s_block", "t_block"]).select("bin", "s", "t")
    text = dict(src.dtypes)["doc_id"] == "string"
    return met.mapInArrow(_block(k, pa.string() if text else pa.int64(), planes, bits), PAIRS.replace("_id long", "_id string") if text else PAIRS)


def blocked(src: DataFrame, trg: DataFrame, k: int = 10, block: int = 1_000) -> DataFrame:
    """The result of ``exact`` by matrix products of blocks; a source row's top k are merged from its blocks by the final window, which keeps k rows per partition before its shuffle."""
    return _top(block_pairs(src.select("bin", "doc_id", "vec"), trg.select("bin", "doc_id", "vec"), k, block), k)


def fit_bits(src: DataFrame, trg: DataFrame, k: int, bands: int, recall: float, most: int) -> int:
    """The largest number of bits a band whose expected recall is at least ``recall``, from a sample of about ``most`` rows of each side.

    Two rows at an angle t agree in a bit with probability 1 - t / pi.  The sample's nearest rows
    are farther than those of all rows, so the expectation errs on the low side.
    """
    def drawn(df: DataFrame) -> list:
        n = df.count()
        share = F.pmod(F.xxhash64("bin"), F.lit(1 << 20)) < F.lit(int(min(1.0, most / max(1, n)) * (1 << 20)))
        # whole bins, so that rows meet their own neighbours; rows of the sample's bins above the bound are left out
        return df.filter(share).select("bin", "doc_id", V.unit(F.col("vec")).alias("u")).limit(2 * most).collect() or df.select("bin", "doc_id", V.unit(F.col("vec")).alias("u")).limit(most).collect()

    sides: tuple[dict, dict] = ({}, {})
    for side, rows in zip(sides, (drawn(src), drawn(trg)), strict=True):
        for r in rows:
            side.setdefault(r["bin"], []).append(r["u"])
    angles = [np.zeros(0)]
    for name in sides[0].keys() & sides[1].keys():
        sims = np.clip(np.array(sides[0][name]) @ np.array(sides[1][name]).T, -1, 1)
        angles.append(np.arccos(-np.sort(-sims, axis=1)[:, :k]).ravel())
    agree = 1 - np.concatenate(angles) / np.pi
    good = [b for b in range(1, 25) if len(agree) and np.mean(1 - (1 - agree**b) ** bands) >= recall]
    return max(good, default=1)


def _coded(planes: np.ndarray, bits: int):
    """Of each row its band codes: the band's number and the signs of ``bits`` projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            codes = _codes(x, planes, bits).T.astype(np.int64)
            codes += np.arange(codes.shape[1], dtype=np.int64) << bits
            yield pa.RecordBatch.from_arrays([b.column("bin"), b.column("doc_id"), pa.array(list(codes), pa.list_(pa.int64()))], ["bin", "doc_id", "codes"])

    return run


def hashed(src: DataFrame, trg: DataFrame, k: int = 10, dims: int = 64, bands: int = 32, recall: float = 0.97, most: int = 5_000, bits: int | None = None, seed: int = 1, block: int = 1_000) -> DataFrame:
    """Approximate: rows that share a band of random-hyperplane bits are compared exactly.

    Every row of both sides is indexed.  The bits a band are fitted for the wanted recall on a
    bounded sample, about ``most`` rows a side, unless given: the nearer the nearest rows are, the
    more bits and the fewer comparisons.  Where chance alone would put more rows of pairs into a
    join on the codes than values into copies of blocks, codes are compared block by block
    instead, and no pair is stored; the result is the same.
    """
    src, trg = cut(src.select("bin", "doc_id", "vec")), cut(trg.select("bin", "doc_id", "vec"))
    bits = bits or fit_bits(src, trg, k, bands, recall, most)
    planes = np.random.default_rng(seed).standard_normal((dims, bands * bits))
    sizes = src.groupBy("bin").agg(F.count(F.lit(1)).cast("double").alias("n")).join(trg.groupBy("bin").agg(F.count(F.lit(1)).cast("double").alias("m")), "bin")
    pairs, copies = sizes.agg(F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.ceil(F.col("m") / block) + F.col("m") * F.ceil(F.col("n") / block))).first()
    # a pair of ids takes about the room of five values
    if (pairs or 0) * bands / 2**bits * 5 > (copies or 0) * dims:
        return _top(block_pairs(src, trg, k, block, planes, bits), k)

    def banded(df: DataFrame, name: str) -> DataFrame:
        return df.mapInArrow(_coded(planes, bits), "bin string, doc_id long, codes array<long>").select("bin", F.col("doc_id").alias(name), F.explode("codes").alias("code"))

    met = cut(banded(src, "src_doc_id").join(banded(trg, "trg_doc_id"), ["bin", "code"]).select("bin", "src_doc_id", "trg_doc_id").distinct())
    s = src.select("bin", F.col("doc_id").alias("src_doc_id"), V.unit(F.col("vec")).alias("u"))
    t = trg.select("bin", F.col("doc_id").alias("trg_doc_id"), V.unit(F.col("vec")).alias("v"))
    cos = met.join(s, ["bin", "src_doc_id"]).join(t, ["bin", "trg_doc_id"]).select("bin", "src_doc_id", "trg_doc_id", V.dot(F.col("u"), F.col("v")).alias("cosine"))
    return _top(cos, k)


def _words(df: DataFrame, name: str, vec: str) -> DataFrame:
    return df.select(F.lit("").alias("bin"), F.col(name).alias("doc_id"), F.col(vec).alias("vec"))


def nearest(queries: DataFrame, vocab: DataFrame, k: int = 40, block: int = 1_000) -> DataFrame:
    """``(query, word, similarity, rank)``: the words nearest to each query vector, positive similarities only.

    ``queries`` is ``(query, vec)``; a word is not its own neighbour.  Blocks of both sides are
    compared by matrix products, so neither side need fit a task.
    """
    found = block_pairs(_words(queries, "query", "vec"), _words(vocab, "word", "vec"), k + 1, block)
    sims = found.select(F.col("src_doc_id").alias("query"), F.col("trg_doc_id").alias("word"), F.col("cosine").alias("similarity")).filter("word != query AND similarity > 0")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "word")
    return sims.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def analogies(questions: DataFrame, vocab: DataFrame, block: int = 1_000) -> DataFrame:
    """``(category, a, b, c, d, answer)``: the word nearest to b - a + c, the three excepted; questions with unknown words are dropped.

    Questions and vocabulary are compared by blocks; of each block the four nearest, and what ties
    with them, hold the nearest that isn't one of the three.
    """
    v = cut(vocab.select("word", V.unit(F.col("vec")).alias("v")))
    of = lambda x: v.select(F.col("word").alias(x), F.col("v").alias(f"v_{x}"))
    known = questions.join(of("a"), "a").join(of("b"), "b").join(of("c"), "c").join(v.select(F.col("word").alias("d")), "d", "left_semi")
    key = F.concat_ws("\t", "category", "a", "b", "c", "d")
    asked = cut(known.select(key.alias("key"), "category", "a", "b", "c", "d", V.analogy(F.col("v_a"), F.col("v_b"), F.col("v_c")).alias("u")).dropDuplicates(["key"]))
    sims = block_pairs(_words(asked, "key", "u"), _words(v, "word", "v"), 4, block).select(F.col("src_doc_id").alias("key"), F.col("trg_doc_id").alias("word"), F.col("cosine").alias("s"))
    best = sims.join(asked.drop("u"), "key").filter(~F.col("word").isin(F.col("a"), F.col("b"), F.col("c")))
    return best.groupBy("category", "a", "b", "c", "d").agg(F.max_by("word", F.struct(F.round("s", 9), "word")).alias("answer"))
