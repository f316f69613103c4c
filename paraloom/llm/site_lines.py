"""Lines repeated across one site's documents.

Pass 1 builds mergeable Misra-Gries summaries of line keys per source.  A summary belongs to a
(source, cell), the cell being some bits of the key's hash, so that a source holding a third of
all rows is spread over many summaries and tasks.  Each task tallies its own lines, the tallies
are shuffled by cell and merged; a summary that outgrows its capacity is reduced by the count of
its capacity-th key, and the sum of these reductions bounds how much any count is too low.  Every
key that may reach the threshold within that bound is a candidate; where the bound itself reaches
the threshold, all keys of the cell are candidates.  So no repeated line is missed.

Pass 2 counts the candidates exactly, by their key and not by its hash; pass 3 picks the
confirmed lines out of each document with a broadcast set, or a shuffled join where the set is
larger than ``most_broadcast`` rows.

Cases: lines compare in lower case without white space and decimal digits; lines without a letter
and rows without a domain are never repeated lines; null and empty texts have none; a line that
occurs twice in one row counts once; the same row_id given twice counts as two rows only if its
texts differ in the line.  Extra columns are kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.session import cut, task_count

CAPACITY = 1 << 16
ROWS_PER_CELL = 50_000
SUMMARY = "cell long, hash long, cnt long, err long"


def line_keys(text: Column) -> Column:
    """The key of each line: lower case, no white space (no-break too), no decimal digits."""
    squeezed = F.regexp_replace(F.lower(text), r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}\p{Nd}&&[^\n]]", "")
    return F.split(squeezed, "\n", -1)


def _rows(web: DataFrame) -> DataFrame:
    return web.filter("domain IS NOT NULL AND text IS NOT NULL").select(
        "row_id", F.lower("domain").alias("domain"), line_keys(F.col("text")).alias("keys")
    )


def merge(cell: np.ndarray, key: np.ndarray, cnt: np.ndarray, err: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Merge Misra-Gries counters: sum equal keys, then reduce each cell to its capacity.

    ``err`` is per row here: the reductions that came with the row's summary; a summary states
    its reductions once, on a row of count 0 with key 0.
    """
    order = np.lexsort((key, cell))
    cell, key, cnt, err = cell[order], key[order], cnt[order], err[order]
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return cell, key, cnt, err
    cell, key, cnt, err = cell[at], key[at], np.add.reduceat(cnt, at), np.add.reduceat(err, at)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    big = np.flatnonzero(sizes > capacity)
    if not len(big):
        return cell, key, cnt, err
    keep = np.ones(len(cell), bool)
    extra = []
    for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
        own = cnt[s : s + n]
        cutoff = int(np.partition(own, n - capacity - 1)[n - capacity - 1])
        own -= cutoff
        keep[s : s + n] = (own > 0) | (err[s : s + n] > 0)
        np.maximum(own, 0, out=own)
        extra.append((cell[s], cutoff))
    cell, key, cnt, err = cell[keep], key[keep], cnt[keep], err[keep]
    cells, cutoffs = (np.array(x, np.int64) for x in zip(*extra, strict=True))
    zero = np.zeros(len(cells), np.int64)
    cell, key, cnt, err = np.r_[cell, cells], np.r_[key, zero], np.r_[cnt, zero], np.r_[err, cutoffs]
    order = np.lexsort((key, cell))
    return cell[order], key[order], cnt[order], err[order]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "hash", "cnt", "err"])


def _tally(capacity: int, most: int = 1 << 20):
    """Map side: the task's own summaries, given out whenever they reach ``most`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            cell, key = (b.column(c).to_numpy() for c in ("cell", "hash"))
            held.append((cell, key, np.ones(len(cell), np.int64), np.zeros(len(cell), np.int64)))
            size += len(cell)
            if size > most:
                held = [merge(*(np.concatenate(x) for x in zip(*held, strict=True)), capacity)]
                size = len(held[0][0])
                if size > most // 2:
                    yield _batch(*held[0])
                    held, size = [], 0
        if held:
            yield _batch(*merge(*(np.concatenate(x) for x in zip(*held, strict=True)), capacity))

    return run


def _candidates(capacity: int, threshold: int):
    """Reduce side: merges the summaries of each cell, which arrive one cell after another."""

    def done(cell, key, cnt, err):
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        bound = np.repeat(np.add.reduceat(err, starts), np.diff(np.r_[starts, len(cell)]))
        full = bound >= threshold
        counted = (cnt > 0) & ~full & (cnt + bound >= threshold)
        whole = np.unique(cell[full])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[cell[counted], whole]), pa.array(np.r_[key[counted], np.zeros(len(whole), np.int64)]), pa.array(np.r_[np.zeros(int(counted.sum()), bool), np.ones(len(whole), bool)])],
            ["cell", "hash", "whole"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = tuple(b.column(c).to_numpy() for c in ("cell", "hash", "cnt", "err"))
            held = merge(*(new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))), capacity)
            ready = held[0] != new[0][-1]  # sorted input: only the last cell may go on
            if ready.any():
                yield done(*(x[ready] for x in held))
                held = tuple(x[~ready] for x in held)
        if held is not None:
            yield done(*held)

    return run


def candidates(rows: DataFrame, threshold: int, n_rows: int, capacity: int = CAPACITY) -> DataFrame:
    """``(cell, hash, whole)``: keys that may occur in ``threshold`` rows; ``whole`` marks cells where any key may."""
    cells = max(16, n_rows // ROWS_PER_CELL)
    marked = rows.select(F.explode(F.transform(
        F.filter(F.array_distinct("keys"), lambda k: k.rlike(r"\p{L}")), lambda k: key_hash(F.col("domain"), k)
    )).alias("hash"), "domain").select(cell_of(F.col("domain"), F.col("hash"), cells).alias("cell"), "hash")
    local = marked.mapInArrow(_tally(capacity), SUMMARY)
    parts = task_count(rows.sparkSession, n_rows, 100_000)
    return local.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(
        _candidates(capacity, threshold), "cell long, hash long, whole boolean"
    )


def key_hash(domain: Column, key: Column) -> Column:
    return F.xxhash64(domain, key)


def cell_of(domain: Column, hashed: Column, cells: int) -> Column:
    return F.xxhash64(domain, F.pmod(hashed, F.lit(cells)))


def repeated_lines(web: DataFrame, threshold: int = 12, most_broadcast: int = 1_000_000) -> DataFrame:
    """``(row_id, line_no, domain, key)`` of each line whose key occurs in ``threshold`` or more rows of its domain."""
    rows = _rows(web)
    n_rows = web.count()
    cells = max(16, n_rows // ROWS_PER_CELL)
    cand = cut(candidates(rows, threshold, n_rows))
    lines = rows.select("row_id", "domain", F.posexplode("keys").alias("line_no", "key")).filter(F.col("key").rlike(r"\p{L}"))
    lines = lines.withColumn("hash", key_hash(F.col("domain"), F.col("key")))
    size = cand.count()

    def small(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= most_broadcast else df

    some = lines.join(small(cand.filter("NOT whole").select("hash"), size), "hash", "left_semi")
    whole = cand.filter("whole").select("cell").distinct()
    if size and whole.head(1):
        celled = lines.withColumn("cell", cell_of(F.col("domain"), F.col("hash"), cells))
        some = some.unionByName(celled.join(small(whole, size), "cell", "left_semi").drop("cell"))
    exact = some.select("row_id", "domain", "key", "hash").groupBy("domain", "key", "hash")
    confirmed = cut(exact.agg(F.count_distinct("row_id").alias("n")).filter(F.col("n") >= threshold).select("domain", "key", "hash"))
    return lines.join(small(confirmed, confirmed.count()), ["hash", "domain", "key"]).select(
        "row_id", F.col("line_no").cast("long").alias("line_no"), "domain", "key"
    )


def cleaned(web: DataFrame, threshold: int = 12) -> DataFrame:
    """Each row with its repeated lines taken out of ``text`` and their number in ``n_dropped``.

    A text that loses all lines becomes empty; a null text stays null.
    """
    drop = repeated_lines(web, threshold).groupBy(F.col("row_id").alias("__row")).agg(F.collect_set("line_no").alias("__drop"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__drop", i.cast("long")))
    out = web.drop("n_dropped").join(drop, F.col("row_id") == F.col("__row"), "left")
    return out.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).withColumn(
        "n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    ).drop("__row", "__drop")
