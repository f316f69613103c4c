"""Byte-level BPE of a whole corpus with a public vocabulary.

Pre-tokenisation needs no regular expression.  Code points are mapped to four classes (letter,
number, white space, other); whether a token begins at a position is a function of the classes of
a bounded neighbourhood.  The transition function of the pattern is definite, so composing it
over a run always forgets the state before the run, and the scan over positions becomes a
handful of shifted array comparisons.  The slices go through a bounded cache of merged tokens;
the rare uncached ones are merged with a heap, so that a token of n bytes costs n log n.

Cases: null and empty texts give an empty list of ids; offsets are code points into the text.
Very long texts are one linear scan.  Special tokens' spellings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.llm.codepoints import categories, chunks, flat

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LETTER, NUMBER, SPACE, OTHER = range(4)
CACHE = 400_000
#: White space of the pre-tokenisation pattern; fixed values of the Unicode White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are tokens of their own after an apostrophe; fixed values of the vocabulary's pattern.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    cats = categories()
    out = np.full(len(cats), OTHER, np.uint8)
    out[cats == ord("L")] = LETTER
    out[cats == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def _after(cp: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
    """The value ``k`` positions later."""
    out = np.full_like(cp, fill)
    out[: len(cp) - k] = cp[k:]
    return out


def starts_of(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which a token begins; no token crosses a text's start."""
    if not len(cp):
        return np.zeros(0, np.int64)
    cls = classes()[cp]
    first = np.zeros(len(cp), bool)
    first[text_starts[text_starts < len(cp)]] = True
    change = first.copy()
    change[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    # the last white space before something else stands apart: joined to it if a plain space, else alone
    last = space & _after(change, 1, False) & ~_after(first, 1, True)
    begin = change.copy()
    begin |= last
    joined = last & (cp == 0x20)
    begin[1:] &= ~joined[:-1]
    # contractions: an apostrophe that begins a token of its own, directly followed by one of the endings
    quote = np.flatnonzero((cp == 0x27) & begin & ~joined)
    for at in quote[_after(cls, 1, OTHER)[quote] == LETTER].tolist():
        for end in CONTRACTIONS:
            n = len(end)
            if at + n < len(cp) and all(cp[at + 1 + j] == ord(end[j]) for j in range(n)) and not first[at + 1 : at + n + 1].any():
                begin[at + 1 : at + n + 1] = False
                if at + n + 1 < len(cp):
                    begin[at + n + 1] = True
                    # what follows begins a token unless a space there was to be joined
                break
    return np.flatnonzero(begin)


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(token: bytes, rank: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: always the lowest-ranked pair, the leftmost of equals, by a heap over a linked list."""
    if token in rank:
        return [rank[token]]
    parts: list[bytes | None] = [token[i : i + 1] for i in range(len(token))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
        h = before[i]
        if h >= 0 and (r := rank.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
    return [rank[p] for p in parts if p is not None]


def encode_texts(texts: list[str], rank: dict[bytes, int], cache: dict[str, list[int]], want: str = "ids") -> Iterator:
    """For each text its ids, or ids and token offsets, or their number."""
    for a, b in chunks(texts):
        cp, starts = flat(texts[a:b])
        begin = starts_of(cp, starts[:-1])
        bounds = np.searchsorted(begin, starts)
        for i in range(b - a):
            text, own = texts[a + i], (begin[bounds[i] : bounds[i + 1]] - starts[i]).tolist()
            ids: list[int] = []
            offsets: list[int] = []
            for s, e in zip(own, [*own[1:], len(text)], strict=True) if own else ():
                piece = text[s:e]
                got = cache.get(piece)
                if got is None:
                    got = merge(piece.encode("utf-8", "surrogatepass"), rank)
                    if len(cache) >= CACHE:
                        cache.clear()
                    if len(piece) <= 64:
                        cache[piece] = got
                ids += got
                if want == "offsets":
                    offsets += [s] * len(got)
            yield (ids, offsets) if want == "offsets" else len(ids) if want == "count" else ids


_CACHES: dict[str, dict[str, list[int]]] = {}


def _encode(path: str, want: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cache = ranks(path), _CACHES.setdefault(path, {})
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                got = list(encode_texts(texts[a:b], rank, cache, want))
                part = batch.slice(a, b - a)
                if want == "count":
                    extra = {"n_tokens": pa.array(got, pa.int64())}
                elif want == "offsets":
                    extra = {"ids": pa.array([g[0] for g in got], pa.list_(pa.int32())), "offsets": pa.array([g[1] for g in got], pa.list_(pa.int32()))}
                else:
                    extra = {"ids": pa.array(got, pa.list_(pa.int32()))}
                keep = [c for c in part.schema.names if want != "count" or c != "text"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(extra.values()), keep + list(extra))

    return run


def encode(df: DataFrame, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` of its ``text`` and, if asked for, the ``offsets`` of the pre-token of each id."""
    base = df.drop("ids", "offsets")
    kinds = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", ids array<int>" + ", offsets array<int>" * offsets
    return base.mapInArrow(_encode(vocabulary, "offsets" if offsets else "ids"), kinds)


def count_tokens(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its ``text`` and with ``n_tokens``."""
    base = df.drop("n_tokens")
    kinds = ", ".join(f"`{n}` {t}" for n, t in base.dtypes if n != "text") + ", n_tokens long"
    return base.mapInArrow(_encode(vocabulary, "count"), kinds)


def decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``decoded``, the text of its ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {v: k for k, v in ranks(vocabulary).items()}
        for b in batches:
            out = [b"".join(map(back.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    base = df.drop("decoded")
    return base.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", decoded string")


def stats(encoded: DataFrame) -> DataFrame:
    """Documents and tokens of an encoded table."""
    return encoded.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))
