"""Word vectors: monolingual by the library's trainer, bilingual by a partition-parallel skip-gram.

The bilingual trainer learns from four kinds of pairs, words with their neighbours in both
languages and words with the neighbours of their aligned word in the other language.  A round
trains each partition from the current weights and averages the results, weighted by the number
of pairs; weights are vocabulary * dims numbers, bounded by ``most_words``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import text as T
from paraloom.operators import links
from paraloom.session import cut


def monolingual(texts: DataFrame, dims: int = 40, least: int = 5, rounds: int = 1, seed: int = 1) -> DataFrame:
    """``(word, vec)`` by skip-gram with hierarchical softmax, of a frame with a ``text`` column."""
    words = texts.filter("text IS NOT NULL").select(T.tokens(F.col("text")).alias("w"))
    model = Word2Vec(vectorSize=dims, minCount=least, maxIter=rounds, seed=seed, inputCol="w", outputCol="v").fit(words)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def keep_probability(count, total, sample: float):
    """The chance that an occurrence of a word stays: (sqrt(f / (s n)) + 1) * s n / f."""
    sn = F.lit(sample) * total
    return (F.sqrt(count / sn) + 1) * sn / count


def subsampled(tokens: DataFrame, vocab: DataFrame, sample: float, *key: str) -> DataFrame:
    """``tokens`` (one row per occurrence, with ``word``) without those that frequency sub-sampling drops; ``vocab`` is ``(word, cnt)``.

    Whether an occurrence stays is drawn from its ``key`` columns, so a lost task draws the same again.
    """
    total = vocab.agg(F.sum("cnt").alias("total"))
    keep = vocab.join(F.broadcast(total)).select("word", keep_probability(F.col("cnt"), F.col("total"), sample).alias("__keep"))
    return tokens.join(keep, "word").filter(T.draw(*[F.col(k) for k in key]) < F.col("__keep")).drop("__keep")


def of_words(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """The vectors of a list of words."""
    return vectors.join(words.select("word"), "word", "left_semi")


def huffman(counts: dict[str, int]) -> dict[str, str]:
    """The code of each word in a Huffman tree of the counts, for hierarchical softmax; ties go to the earlier word, then to words before trees.

    Two queues give the tree in one pass after sorting: words by count, and trees in the order they are made.
    """
    leaves = deque((n, (w,)) for w, n in sorted(counts.items(), key=lambda x: (x[1], x[0])))
    trees: deque = deque()
    children: list[tuple] = []

    def least():
        return leaves.popleft() if leaves and (not trees or leaves[0][0] <= trees[0][0]) else trees.popleft()

    while len(leaves) + len(trees) > 1:
        a, b = least(), least()
        children.append((a[1], b[1]))
        trees.append((a[0] + b[0], len(children) - 1))
    out: dict[str, str] = {}
    todo = [(trees[0][1], "")] if trees else [(leaves[0][1], "0")] if leaves else []
    while todo:
        node, code = todo.pop()
        if isinstance(node, tuple):
            out[node[0]] = code
        else:
            todo += [(children[node][0], code + "0"), (children[node][1], code + "1")]
    return out


def huffman_codes(vocab: DataFrame, most: int = 5_000_000) -> DataFrame:
    """``(word, cnt, code)``; the tree is built on the driver, so a vocabulary of more than ``most`` words is refused."""
    rows = vocab.select("word", "cnt").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    codes = huffman({r["word"]: r["cnt"] for r in rows})
    return vocab.sparkSession.createDataFrame([(r["word"], r["cnt"], codes[r["word"]]) for r in rows], "word string, cnt long, code string")


def value_range(vectors: DataFrame, column: str) -> DataFrame:
    """``(least, most, mean)`` over all values of all vectors."""
    return vectors.select(F.explode(column).alias("x")).select(F.col("x").cast("double").alias("x")).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))


def training_pairs(corpus: DataFrame, window: int = 5) -> DataFrame:
    """``(word, context)`` tagged ``s:`` and ``t:``, of both languages and across the uniform alignment."""
    tag = lambda side, name: F.transform(T.tokens(F.col(side)), lambda w: F.concat(F.lit(f"{name}:"), w))
    both = corpus.filter("src_text IS NOT NULL AND trg_text IS NOT NULL").select(tag("src_text", "s").alias("s"), tag("trg_text", "t").alias("t"))
    both = both.withColumn("st", links.uniform(F.size("s"), F.size("t"))).withColumn("ts", links.uniform(F.size("t"), F.size("s")))
    empty = F.array().cast("array<struct<word:string,context:string>>")
    pairs = F.concat(*[F.coalesce(x, empty) for x in (
        links.skip_pairs(F.col("s"), window), links.skip_pairs(F.col("t"), window),
        links.cross_pairs(F.col("s"), F.col("t"), F.col("st"), window), links.cross_pairs(F.col("t"), F.col("s"), F.col("ts"), window),
    )])
    return both.select(F.explode(pairs).alias("p")).select("p.word", "p.context")


def _side(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each row its number of tokens and where they begin, and the tokens of all rows."""
    lists = b.column(name)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return n, np.cumsum(n) - n, lists.flatten()


def _aligned(n: np.ndarray, start: np.ndarray, other_n: np.ndarray, other_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each token its row, its place in the row, where its own row begins, the place uniformly aligned with it and where the other side's row begins."""
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - start[row]
    return row, at, start[row], at * other_n[row] // np.maximum(1, n[row]), other_start[row]


def _around(centre: np.ndarray, size: np.ndarray, window: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places within the window of each centre, and which of them exist; with ``own`` without the centre itself."""
    near = centre[:, None] + np.arange(-window, window + 1)
    there = (near >= 0) & (near < size[:, None])
    if own:
        there[:, window] = False
    return near, there


def _pair_counts(window: int):
    """Of each batch ``(word, n)``: in how many of the training pairs the word stands first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = _side(b, "s"), _side(b, "t")
            for tag, (n, start, words), (m, other, _) in (("s:", s, t), ("t:", t, s)):
                row, at, _, to, _ = _aligned(n, start, m, other)
                reach = lambda centre, size: np.maximum(0, np.minimum(centre + window, size - 1) - np.maximum(centre - window, 0) + 1)
                codes = words.dictionary_encode()
                sums = np.bincount(codes.indices.to_numpy(), weights=reach(at, n[row]) - 1 + reach(to, m[row]), minlength=len(codes.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([tag + w for w in codes.dictionary.to_pylist()], pa.string()), pa.array(sums)], ["word", "n"])

    return run


def pair_ids(b: pa.RecordBatch, s_known: pa.Array, s_ids: np.ndarray, t_known: pa.Array, t_ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``training_pairs`` of a batch of token lists, row by row in the same order; pairs with an unknown word are left out."""
    s, t = _side(b, "s"), _side(b, "t")
    coded = lambda words, known, ids: np.append(ids, -1)[pc.fill_null(pc.index_in(words, value_set=known), len(ids)).to_numpy()]
    s_at, t_at = _aligned(*s[:2], *t[:2]), _aligned(*t[:2], *s[:2])
    s_id, t_id = coded(s[2], s_known, s_ids), coded(t[2], t_known, t_ids)
    found = []
    for (row, at, start, _, _), ids, n in ((s_at, s_id, s[0]), (t_at, t_id, t[0])):
        near, there = _around(at, n[row], window, True)
        who, k = np.nonzero(there)
        found.append((row[who], ids[who], ids[(near + start[:, None])[who, k]]))
    for (row, _, _, to, other), ids, others, m in ((s_at, s_id, t_id, t[0]), (t_at, t_id, s_id, s[0])):
        near, there = _around(to, m[row], window, False)
        who, k = np.nonzero(there)
        found.append((row[who], ids[who], others[(near + other[:, None])[who, k]]))
    row, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    order = order[(i[order] >= 0) & (j[order] >= 0)]
    return i[order], j[order]


def _add(to: np.ndarray, at: np.ndarray, by: np.ndarray, steps: np.ndarray) -> None:
    """``to[at] += by * steps`` with equal places summed first; a step goes to as many places as ``at`` has columns."""
    flat = at.ravel()
    order = np.argsort(flat.astype(np.min_scalar_type(len(to))), kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    to[ordered[first]] += np.add.reduceat(by.ravel()[order, None] * steps[order // at.shape[1]], first, axis=0)


def _train(words: list[str], cum: np.ndarray, w_in: np.ndarray, w_out: np.ndarray, window: int, rate: float, negative: int, seed: int):
    sides = []
    for tag in ("s:", "t:"):
        own = np.array([k for k, w in enumerate(words) if w.startswith(tag)], dtype=np.int64)
        sides += [[words[k][2:] for k in own], own]
    # a draw's slice of the table bounds where in ``cum`` it lies; most slices are of one word
    slices = 1 << 16
    low = np.searchsorted(cum, np.arange(slices + 1) / slices * cum[-1])
    single = low[:-1] == low[1:]

    def drawn(u: np.ndarray) -> np.ndarray:
        at = (u * slices).astype(np.int64)
        out = low[at]
        rest = ~single[at]
        out[rest] = np.searchsorted(cum, u[rest] * cum[-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, rng, n = w_in.copy(), w_out.copy(), np.random.default_rng(seed), 0
        known = [pa.array(sides[0], pa.string()), sides[1], pa.array(sides[2], pa.string()), sides[3]]
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                i, j = pair_ids(batch.slice(first, 500), *known, window)
                ys_all = np.c_[j, drawn(rng.random((len(i), negative)))]
                for at in range(0, len(i), 512):
                    x, ys = i[at : at + 512], ys_all[at : at + 512]
                    v, u = a[x], b[ys]
                    grad = (u @ v[:, :, None])[:, :, 0]
                    grad = -rate / (1 + np.exp(-np.clip(grad, -6, 6)))
                    grad[:, 0] += rate
                    # a batch adds to a frequent word as often as eight occurrences at most would, or it diverges
                    often = lambda k: 8 / np.maximum(8, np.bincount(k.ravel()))[k]
                    _add(b, ys, grad * often(ys), v)
                    _add(a, x[:, None], often(x), (grad[:, None, :] @ u)[:, 0, :])
                    n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([a.astype(np.float64).tobytes()], pa.binary()), pa.array([b.astype(np.float64).tobytes()], pa.binary())], ["n", "a", "b"])

    return run


def token_lists(corpus: DataFrame, per_task: int = 5_000) -> DataFrame:
    """``(s, t)``: the token lists of rows with both texts, spread over as many tasks as rows of ``per_task`` allow, twice the cores at most.

    A row's place is drawn from its texts and its number among equal rows: equal rows are spread too, and any layout of the corpus gives the same order.
    """
    both = corpus.filter("src_text IS NOT NULL AND trg_text IS NOT NULL")
    parts = max(1, min(2 * corpus.sparkSession.sparkContext.defaultParallelism, both.count() // per_task))
    copies = both.groupBy("src_text", "trg_text").agg(F.count(F.lit(1)).alias("n")).select("src_text", "trg_text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    placed = copies.select(T.tokens(F.col("src_text")).alias("s"), T.tokens(F.col("trg_text")).alias("t"), F.xxhash64("src_text", "trg_text", "k").alias("place"))
    return cut(placed.repartition(parts, "place").sortWithinPartitions("place", "s", "t").select("s", "t"))


def bilingual(corpus: DataFrame, dims: int = 40, window: int = 5, rounds: int = 3, negative: int = 5, rate: float = 0.025, least: int = 5, most_words: int = 100_000, seed: int = 1) -> DataFrame:
    """``(word, in_vec, out_vec)``; words carry the tag of their language.

    Workers make the pairs of ``training_pairs`` from token lists, so no pair is ever stored.
    """
    lists = token_lists(corpus)
    counts = lists.mapInArrow(_pair_counts(window), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most_words).collect()
    words = [r.word for r in counts]
    cum = np.cumsum([r.n**0.75 for r in counts]) if counts else np.zeros(1)
    rng = np.random.default_rng(seed)
    w_in, w_out = (rng.random((len(words), dims)) - 0.5) / dims, np.zeros((len(words), dims))
    for k in range(rounds if words else 0):
        step = max(1e-4, rate * (1 - k / rounds))
        # trained in all tasks at once, then one partition's weights at a time reach the driver
        got = cut(lists.mapInArrow(_train(words, cum, w_in, w_out, window, step, negative, seed + k), "n long, a binary, b binary").filter("n > 0")).toLocalIterator()
        total, sum_in, sum_out = 0, np.zeros_like(w_in), np.zeros_like(w_out)
        for r in got:
            total += r.n
            sum_in += r.n * np.frombuffer(bytes(r.a)).reshape(w_in.shape)
            sum_out += r.n * np.frombuffer(bytes(r.b)).reshape(w_out.shape)
        w_in, w_out = sum_in / total, sum_out / total
    rows = [(w, w_in[k].tolist(), w_out[k].tolist()) for k, w in enumerate(words)]
    return corpus.sparkSession.createDataFrame(rows, "word string, in_vec array<double>, out_vec array<double>")
