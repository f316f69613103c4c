"""Records that are equal but for formatting: skip-and-fold hashing of code points.

A record's text is never rewritten.  Its code points go through one lookup table that maps a
character to 0 (skipped: neither letter nor digit) or to its folded form, and the folded values
feed two polynomial hashes modulo 2**64 directly from the flat array of a batch.  A text made of
two or more ``name: value`` fields parted by ``|``, ``;`` or ``/`` is hashed field by field and
the set of field hashes is summed, so that field order does not matter.  Groups of equal hashes
are verified: each differing spelling is compared with the kept record by a two-pointer scan that
skips the disregarded characters.

Cases: null text and texts without letters and digits form no group; null and blank languages are
equal; region suffixes and letter case of the language do not matter.  Repeated rows, extra
columns and empty tables need no care; very long texts are hashed in one linear scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.llm.codepoints import SIZE, categories, chunks, flat
from paraloom.operators.hot_keys import language_code
from paraloom.session import cut

SEPARATORS = re.compile(r"[|;/]")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2**64
MASK = (1 << 64) - 1
HASHES = "row_id long, lang string, h1 long, h2 long, n int, raw binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def fold_table() -> np.ndarray:
    """0 for a skipped code point, else the code point of its lower-case form."""
    fold = np.zeros(SIZE, np.uint32)
    cats = categories()
    for i in np.flatnonzero((cats == ord("L")) | (cats == ord("N"))).tolist():
        low = chr(i).lower()
        fold[i] = ord(low[0])
    return fold


@lru_cache(1)
def composing() -> np.ndarray:
    """Code points that may change under NFC: marks, Hangul vowels and finals, singletons."""
    cats = categories()
    flag = cats == ord("M")
    flag[0x1160:0x1200] = True
    for i in [*range(0x340, 0x345), 0x374, 0x37E, 0x387, *range(0x1F71, 0x2000), *range(0x2000, 0x2002), 0x2126, 0x212A, 0x212B, *range(0xF900, 0xFB50)]:
        flag[i] = True
    return flag


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n asked for."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def hash_slices(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both polynomial hashes and the number of kept characters of each slice ``cp[begin:end]``.

    Slices ascend and don't overlap.  Each is hashed as the sum of value * base**position over
    the flat array, divided by base**(its own start).
    """
    folded = fold_table()[cp]
    at = np.flatnonzero(folded)
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
    values = _mix(folded[at])
    out = []
    for base in BASES:
        p = powers(base, len(at) + 1)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(values * p[: len(at)], out=total[1:])
        back = powers(pow(base, -1, 1 << 64), len(at) + 1)
        out.append((total[hi] - total[lo]) * back[lo])
    return out[0], out[1], (hi - lo).astype(np.int64)


def fields(text: str) -> list[tuple[int, int]] | None:
    """The (begin, end) of each field where the text is two or more ``name: value`` fields, else None."""
    if ":" not in text:
        return None
    out, begin = [], 0
    for end in [*(m.start() for m in SEPARATORS.finditer(text)), len(text)]:
        part = text[begin:end]
        if part.strip():
            name, colon, value = part.partition(":")
            if not colon or not any(map(str.isalnum, name)) or not any(map(str.isalnum, value)):
                return None
            out.append((begin, end))
        begin = end + 1
    return out if len(out) > 1 else None


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and kept lengths of whole texts, composed (NFC) where that matters."""
    cp, starts = flat(texts)
    flagged = np.flatnonzero(composing()[cp])
    if len(flagged):
        texts = list(texts)
        for i in np.unique(np.searchsorted(starts, flagged, "right") - 1).tolist():
            texts[i] = unicodedata.normalize("NFC", texts[i])
        cp, starts = flat(texts)
    h1, h2, n = hash_slices(cp, starts[:-1], starts[1:])
    for i, t in enumerate(texts):
        if n[i] and (parts := fields(t)):
            b, e = np.array(parts).T
            f1, f2, m = hash_slices(flat([t])[0], b, e)
            f1, pick = np.unique(f1, return_index=True)
            h1[i], h2[i], n[i] = _mix(f1).sum(dtype=np.uint64), _mix(f2[pick]).sum(dtype=np.uint64), -m[pick].sum()
    return h1, h2, n


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts):
            h1, h2, n = hash_texts(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id")[a:b], batch.column("lang")[a:b], pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int32)), batch.column("raw")[a:b]],
                ["row_id", "lang", "h1", "h2", "n", "raw"],
            )


def same_slice(a: str, b: str) -> bool:
    """Two-pointer comparison that skips disregarded characters and folds the others."""
    fold = _fold_of
    i = j = 0
    while True:
        while i < len(a) and not fold(a[i]):
            i += 1
        while j < len(b) and not fold(b[j]):
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if fold(a[i]) != fold(b[j]):
            return False
        i += 1
        j += 1


@lru_cache(100_000)
def _fold_of(ch: str) -> int:
    return int(fold_table()[ord(ch)])


def same_record(a: str, b: str) -> bool:
    """Whether two texts are the same record; a text of fields is a set of fields."""
    a, b = unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)
    fa, fb = fields(a), fields(b)
    if (fa is None) != (fb is None):
        return False
    if fa is None:
        return same_slice(a, b)

    def covers(x: str, px: list, y: str, py: list) -> bool:
        return all(any(same_slice(x[s:e], y[u:v]) for u, v in py) for s, e in px)

    return covers(a, fa, b, fb) and covers(b, fb, a, fa)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [same_record(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("kept_text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("kept_row_id", "variant")] + [pa.array(same, pa.bool_())], ["kept_row_id", "variant", "same"])


def hashed(web: DataFrame) -> DataFrame:
    """``(row_id, lang, h1, h2, n, raw)`` of each record with letters or digits."""
    rows = web.filter("text IS NOT NULL").select(
        "row_id", F.coalesce(language_code(F.col("language")), F.lit("")).alias("lang"), "text",
        F.unhex(F.md5("text")).alias("raw"),
    )
    return rows.mapInArrow(_hash_batches, HASHES).filter("n != 0")


def copies(web: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """``(kept_row_id, row_id)``: every copy with the smallest row_id of its group, itself excluded.

    One aggregation over all rows finds the groups; only their members go on.  Rows with the same
    bytes collapse to one variant, so a group that holds a third of all rows is compared once per
    spelling, and only texts of differing spellings are shuffled.  Groups and
    the ids of texts to compare are broadcast up to ``most_broadcast`` rows.
    """
    h = cut(hashed(web))
    key = ["lang", "h1", "h2", "n"]

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= most_broadcast else df

    groups = cut(h.groupBy(*key).agg(F.min("row_id").alias("kept_row_id"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members"))
    members = h.join(small(groups), key).select("kept_row_id", "raw", "row_id")
    variants = cut(members.groupBy("kept_row_id", "raw").agg(F.min("row_id").alias("variant")))
    differing = variants.filter("variant != kept_row_id").select("kept_row_id", "variant")
    needed = cut(differing.select(F.col("variant").alias("row_id")).union(differing.select("kept_row_id")).distinct())
    texts = web.select("row_id", "text").join(small(needed), "row_id", "left_semi")
    pairs = (
        differing.join(texts.withColumnRenamed("row_id", "variant"), "variant")
        .join(texts.select(F.col("row_id").alias("kept_row_id"), F.col("text").alias("kept_text")), "kept_row_id")
    )
    verified = pairs.mapInArrow(_verify, "kept_row_id long, variant long, same boolean").filter("same").select("variant")
    good = variants.join(verified.withColumn("ok", F.lit(True)), "variant", "left").filter("ok OR variant = kept_row_id")
    return members.join(good.select("kept_row_id", "raw"), ["kept_row_id", "raw"]).filter("row_id != kept_row_id").select("kept_row_id", "row_id")


def collapsed(web: DataFrame) -> DataFrame:
    """One row for each group: ``(row_id, n_copies)``; records that form no group count one copy."""
    found = copies(web)
    sizes = found.groupBy("kept_row_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    gone = found.select("row_id")
    return (
        web.select("row_id").join(gone, "row_id", "left_anti")
        .join(sizes.withColumnRenamed("kept_row_id", "row_id"), "row_id", "left")
        .select("row_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    )
