"""The main body of pages: furniture found with suffix arrays over each host's pages.

Pages are range-partitioned and sorted by host, so a host's pages lie together, a host that
holds a third of all rows spreads over many partitions, and small hosts share a block.  Within a
block of up to ``BLOCK`` pages the token streams are concatenated, each line beginning with a
token of its own, numbers as one class and the words of the host's own name as another.  A suffix
array is sorted by prefix doubling to a depth of 2, 4 and 8 tokens of one line.  Its groups, the
substrings repeated across pages, decide in two ways; no wording is given.

By repetition on the host: substrings of ``WINDOW`` tokens of one line, or the whole line if it is
shorter, that ``STRONG_PAGES`` and ``STRONG_SHARE`` of the host's distinct pages share remove a
line if they cover ``STRONG_COVER`` of it.  A host within one block is decided there.  For the
first and last host of a block, which may go on in others, substrings above ``SPARE`` times that
share of the block's pages of the host and the lines they cover are given out, and counted over
all blocks.

By frames: the first two and the last three tokens of a line are its frames, and so is its form
where separators or wide gaps part it into three or more short parts.  Prose begins and ends
lines as it does sentences within lines; furniture stands in lines of its own, around the body.
A frame is counted over the pages of all hosts.  One that ``FRAME_PAGES`` and ``FRAME_SHARE`` of
all distinct pages have, of whose occurrences ``BOUND`` stand at that end of a line, is
line-bound.  Of these, frames are furniture if ``EDGE`` of the lines with them have nothing but
furniture between them and the begin or the end of their page: all line-bound ones are taken for
furniture first, and those that fail are taken for body until none fails, ``ROUNDS`` times at
most.  A line with a frame that is furniture goes.

Pages of the same letters and digits on one host count once.  Lines that are covered by no
repeated substring stay.

Cases: null and empty texts and blank lines have no furniture; rows without a domain form blocks
of their own and lose lines by their frames alone; pages on which all lines are line-bound tell
nothing of edges; very long pages are one part of one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.session import cut, task_count

BLOCK, BLOCK_CHARS = 2_000, 2_000_000
WINDOW, STRONG_PAGES, STRONG_SHARE, STRONG_COVER, SPARE = 8, 20, 0.05, 0.8, 0.25
FRAME_PAGES, FRAME_SHARE, BOUND, EDGE, ROUNDS = 8, 0.0005, 0.9, 0.8, 6
#: Tokens of a line with its LINE, at least, to go by repetition on the host.
LEAST_TOKENS = 3
LINE, NUMBER, HOST = range(3)
TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,:/\xa0 ]*|\n|[^\w\s]|_")
#: What isn't a letter or digit: the ASCII bytes, and all else.
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalnum())
NO_LETTERS_BEYOND = re.compile(r"[^\w\x00-\x7f]+")
PARTS = re.compile(r" ?([|»>•]) ?| (/) ")
GAPS = re.compile(r"[ \xa0]{2,}|\t")
MANY = ("|", "»", ">", "•", "/", "\t", "  ", " \xa0", "\xa0 ", "\xa0\xa0")
SENTENCE_END = re.compile(r"[.?!…][\"”“»«')\]]*$")
HIDDEN = "­​⁠﻿"
MIX = np.uint64(0x100000001B3)


def shown(text: str) -> str:
    """The text without soft hyphens and zero-width characters."""
    if not text.isascii():
        for c in HIDDEN:
            text = text.replace(c, "")
    return text


def letters(text: str) -> bytes:
    """The letters and digits of a text in lower case."""
    text = text.lower()
    if not text.isascii():
        text = NO_LETTERS_BEYOND.sub("", text)
    return text.encode(errors="surrogatepass").translate(None, NO_LETTERS)


def form(line: str) -> tuple[str, int] | None:
    """The separator and the number of parts, up to 5, of a line of three or more short parts, none a sentence or a ``name: value`` field."""
    if not any(x in line for x in MANY) or line.lstrip()[:1] in "•*–—-":
        return None
    cut_ = PARTS.split(line.strip())
    parts, mark = [p for p in cut_[::3] if p.strip()], next((m for m in cut_[1:] if m in ("|", "»", ">", "•", "/")), "")
    if len(parts) < 3:
        # where all spaces of a line are doubled a gap separates nothing
        parts, mark = GAPS.split(line.strip()), " "
        if len(parts) < 3 or len(parts) == len(line.split()) > 6:
            return None
    if all(len(p.split()) <= 4 and not SENTENCE_END.search(p.strip()) for p in parts) and sum(":" in p for p in parts) < 2:
        return mark, min(len(parts), 5)
    return None


class _Numbers(dict):
    """Token -> number, new tokens getting the next one."""

    def __missing__(self, token: str) -> int:
        n = self[token] = NUMBER if token[0].isdigit() else len(self) + 3
        return n


def block_tokens(texts: list[str], hosts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Token numbers of all pages, and the page and the line number of each; a line begins with the token LINE; the numbers given."""
    ids = _Numbers()
    ids["\n"] = LINE
    flat: list[int] = []
    ends = []
    for text in texts:
        flat += map(ids.__getitem__, TOKEN.findall("\n" + shown(text).lower()))
        ends.append(len(flat))
    tokens = np.array(flat, np.int64)
    page = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    count = np.cumsum(tokens == LINE)
    first = np.r_[0, ends[:-1]].astype(np.int64) if texts else np.zeros(0, np.int64)
    line = count - count[first][page] if len(tokens) else count
    # the words of a host's name, on its own pages
    begin = 0
    for k in range(1, len(hosts) + 1):
        if k == len(hosts) or hosts[k] != hosts[begin]:
            part = tokens[first[begin] : ends[k - 1]]
            for word in TOKEN.findall(hosts[begin]):
                if len(word) > 2 and (n := ids.get(word)) is not None:
                    part[part == n] = HOST
            begin = k
    return tokens, page, line, ids


def suffix_ranks(tokens: np.ndarray, ends: np.ndarray, depth: int = WINDOW) -> dict[int, np.ndarray]:
    """The rank of each suffix, cut at ``ends``, among those of a block, by its first 2, 4, .. ``depth`` tokens.

    Prefix doubling: the rank at depth 2h follows from the ranks at depth h, here and h positions
    on; suffixes of equal rank are neighbours in the suffix array.
    """
    n, rank, h, out = len(tokens), tokens, 1, {}
    at = np.arange(n)
    while h < depth:
        beyond = np.where(at + h < ends, rank[np.minimum(at + h, n - 1)] + 1, 0)
        both = rank * (int(rank.max()) + 2) + beyond
        order = np.argsort(both, kind="stable")
        key = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        h *= 2
        out[h] = rank
    return out


def token_hashes(ids: dict[str, int]) -> np.ndarray:
    """A hash of each token number that is the same in all blocks."""
    out = np.zeros(max(HOST, max(ids.values())) + 1, np.uint64)
    for token, n in ids.items():
        if n > HOST:
            out[n] = int.from_bytes(blake2b(token.encode(errors="replace"), digest_size=8).digest())
    out[LINE], out[NUMBER], out[HOST] = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    return out


def substring_hashes(tokens: np.ndarray, ends: np.ndarray, start: np.ndarray, depth: int, hashes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes, the same in all blocks, of the substrings of ``depth`` tokens from ``start``, cut at the line's end."""
    key = np.full(len(start), seed, np.uint64)
    for k in range(depth):
        at = start + k
        key *= MIX
        key += np.where(at < ends[start], hashes[tokens[np.minimum(at, len(tokens) - 1)]], np.uint64(0))
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def distinct_pages(group: np.ndarray, page: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each group the number of distinct pages, copies of a page left out, that have it; pages ascend."""
    order = np.argsort(group, kind="stable")
    g, p = group[order], page[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])]
    return np.bincount(g, weights=new & first[p]).astype(np.int64)


class Block:
    """What a block of pages gives.

    ``framed_lines``: pages, where each one's lines begin, and of all their lines the numbers, hashes of first
    and last frames and of forms, 0 without one, and whether the line goes by repetition; ``framed`` has them by page; ``frames``: hash -> (distinct pages, occurrences at its end of a line, all
    occurrences); of hosts that may go on in other blocks ``lines`` (page, line number, tokens,
    starts, keys) and ``counts`` host -> (distinct pages, {key: distinct pages}).
    """

    def __init__(self, texts: list[str], hosts: list[str], open_hosts: set[str], by_host: bool = True):
        self.framed_lines: tuple[np.ndarray, ...] | None = None
        self.frames: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
        self.lines: list[tuple[int, int, int, list[int], list[int]]] = []
        self.counts: dict[str, tuple[int, dict[int, int]]] = {}
        self.pages = 0
        tokens, page, line, ids = block_tokens(texts, hosts)
        if not len(tokens):
            return
        begin = np.flatnonzero(tokens == LINE)
        sizes = np.diff(np.r_[begin, len(tokens)])
        ends = np.repeat(begin + sizes, sizes)
        names: dict[str, int] = {}
        host = np.array([names.setdefault(h, len(names)) for h in hosts])
        seen: set[tuple[str, bytes]] = set()
        first = np.zeros(len(texts), bool)
        for k, (h, t) in enumerate(zip(hosts, texts, strict=True)):
            key = (h, letters(t))
            first[k] = key not in seen
            seen.add(key)
        self.pages = int(first.sum())
        ranks, hashes = suffix_ranks(tokens, ends, WINDOW if by_host else 2), token_hashes(ids)
        sure = self._strong(hosts, host, names, first, open_hosts, tokens, page, line, begin, sizes, ends, ranks, hashes) if by_host else np.zeros(len(begin), bool)
        self._frames(texts, tokens, page, line, begin, sizes, ends, first, sure, ranks, hashes)

    @property
    def framed(self) -> dict[int, tuple[list[int], list[int], list[int], list[int], list[bool]]]:
        """Page -> (line numbers, hashes of first and last frames and of forms, whether the line goes by repetition)."""
        if not self.framed_lines:
            return {}
        pages, begins, *of_lines = self.framed_lines
        return {p: tuple(x[a:b].tolist() for x in of_lines) for p, a, b in zip(pages.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True)}

    def _frames(self, texts, tokens, page, line, begin, sizes, ends, first, sure, ranks, hashes) -> None:
        """The frames of all lines, and their counts in the block's suffix array."""
        some = np.flatnonzero(sizes > 1)
        if not len(some):
            return
        head = begin[some] + 1
        tail = np.maximum(begin[some] + sizes[some] - 3, head)
        weight = first[page].astype(np.float64)
        of_pair = np.bincount(ranks[2], weights=weight)
        # three tokens that end a line occur where the first two of them do
        ends_line = np.zeros(int(ranks[2].max()) + 1, bool)
        ends_line[ranks[2][tail]] = True
        may = np.flatnonzero(ends_line[ranks[2]])
        third = np.where(may + 2 < ends[may], tokens[np.minimum(may + 2, len(tokens) - 1)] + 1, 0)
        _, triple = np.unique(ranks[2][may] * (int(tokens.max()) + 3) + third, return_inverse=True)
        of_triple = np.bincount(triple, weights=weight[may])
        at_tail = triple[np.searchsorted(may, tail)]
        heads = substring_hashes(tokens, ends, head, 2, hashes, 1)
        tails = substring_hashes(tokens, ends, tail, 3, hashes, 2)
        forms = np.zeros(len(some), np.int64)
        at, lines = -1, []
        for k, (p, n) in enumerate(zip(page[head].tolist(), line[head].tolist(), strict=True)):
            if p != at:
                at, lines = p, texts[p].split("\n")
            if f := form(lines[n]):
                forms[k] = ord(f[0]) * 8 + f[1]
        formed = np.flatnonzero(forms)
        for place, group, everywhere, key in ((head, ranks[2][head], of_pair, heads), (tail, at_tail, of_triple, tails), (head[formed], forms[formed], np.bincount(forms[formed], weights=weight[head[formed]]), forms[formed])):
            if not len(place):
                continue
            _, one, small = np.unique(group, return_index=True, return_inverse=True)
            pages = distinct_pages(small, page[place], first)
            here = np.bincount(small, weights=weight[place])
            for column, values in zip(self.frames, (key[one], pages, here.astype(np.int64), everywhere[group[one]].astype(np.int64)), strict=True):
                column += values.tolist()
        of_page = page[begin[some]]
        cuts = np.r_[0, np.flatnonzero(np.diff(of_page)) + 1]
        self.framed_lines = (of_page[cuts], np.r_[cuts, len(some)], line[begin[some]], heads, tails, forms, sure[some])

    def _strong(self, hosts, host, names, first, open_hosts, tokens, page, line, begin, sizes, ends, ranks, hashes) -> np.ndarray:
        """Whether each line repeats word by word on a share of its host's distinct pages; lines and counts of open hosts."""
        pages = np.bincount(host, weights=first, minlength=len(names)).astype(np.int64)
        is_open = np.array([h in open_hosts for h in names])
        for h, n, o in zip(names, pages.tolist(), is_open.tolist(), strict=True):
            if o and h:
                self.counts[h] = (n, {})
        need = np.where(is_open, np.maximum(1, np.ceil(SPARE * STRONG_SHARE * pages)), np.maximum(STRONG_PAGES, np.ceil(STRONG_SHARE * pages)))
        if "" in names:
            need[names[""]] = len(tokens) + 1  # pages without a domain are of no host
        whole = np.arange(len(tokens)) + WINDOW <= ends
        whole[begin] = sizes >= LEAST_TOKENS
        # substrings of hosts that can't reach what they need aren't counted
        start = np.flatnonzero(whole & (pages >= need)[host[page]])
        good = np.zeros(len(begin), bool)
        if not len(start):
            return good
        _, group = np.unique(ranks[WINDOW][start] * len(names) + host[page[start]], return_inverse=True)
        count = distinct_pages(group, page[start], first)[group]
        hot = count >= need[host[page[start]]]
        start, count = start[hot], count[hot]
        of_line = np.searchsorted(begin, start, "right") - 1
        until = np.minimum(start + WINDOW, ends[start])
        delta = np.bincount(start, minlength=len(tokens) + 1) - np.bincount(until, minlength=len(tokens) + 1)
        covered = (np.cumsum(delta[:-1]) > 0).astype(np.int64)
        good = (sizes >= LEAST_TOKENS) & (np.add.reduceat(covered, begin) >= STRONG_COVER * sizes)
        going_on = is_open[host[page[begin]]]
        # all lines' substrings are hashed at once
        asked = np.flatnonzero(good & going_on)
        of_asked = (good & going_on)[of_line]
        start, count, of_line = start[of_asked], count[of_asked], of_line[of_asked]
        keys = substring_hashes(tokens, ends, start, WINDOW, hashes, 3).tolist()
        at, count = (start - begin[of_line]).tolist(), count.tolist()
        parts = zip(page[begin[asked]].tolist(), line[begin[asked]].tolist(), sizes[asked].tolist(), *(np.searchsorted(of_line, asked, side).tolist() for side in ("left", "right")), strict=True)
        for p, n, size, a, b in parts:
            self.lines.append((p, n, size, at[a:b], keys[a:b]))
            self.counts[hosts[p]][1].update(zip(keys[a:b], count[a:b], strict=True))
        return good & ~going_on


KINDS = {
    "row_id": pa.int64(), "line_no": pa.int64(), "host": pa.string(), "size": pa.int64(), "starts": pa.list_(pa.int32()), "keys": pa.list_(pa.int64()), "pages": pa.list_(pa.int64()),
    "lines": pa.list_(pa.int32()), "heads": pa.list_(pa.int64()), "tails": pa.list_(pa.int64()), "forms": pa.list_(pa.int64()), "sure": pa.list_(pa.bool_()), "here": pa.list_(pa.int64()), "everywhere": pa.list_(pa.int64()),
}
OF_LINES = ("lines", "heads", "tails", "forms", "sure")
BLOCK_ROWS = (
    "row_id long, line_no long, host string, size long, starts array<int>, keys array<long>, pages array<long>, "
    "lines array<int>, heads array<long>, tails array<long>, forms array<long>, sure array<boolean>, here array<long>, everywhere array<long>"
)


def _blocks(by_host: bool):
    """Rows of four kinds: a page's lines with their frames; lines to be decided by their host's counts; of hosts (no row) the counts; of a block (neither) its frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        texts: list[str] = []
        hosts: list[str] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            b = Block(texts, hosts, {hosts[0], hosts[-1]}, by_host)
            if b.framed_lines:
                pages, begins, *of_lines = b.framed_lines
                begins = pa.array(begins, pa.int32())
                columns = {c: pa.ListArray.from_arrays(begins, pa.array(x, KINDS[c].value_type)) for c, x in zip(OF_LINES, of_lines, strict=True)}
                columns["row_id"] = pa.array([rows[p] for p in pages.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(pages), k) for c, k in KINDS.items()], list(KINDS))
            out = [{"row_id": rows[p], "line_no": n, "host": hosts[p], "size": tokens, "starts": starts, "keys": keys} for p, n, tokens, starts, keys in b.lines]
            out += [{"host": h, "size": n, "keys": list(c), "pages": list(c.values())} for h, (n, c) in b.counts.items()]
            out.append({"size": b.pages} | dict(zip(("keys", "pages", "here", "everywhere"), b.frames, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], k) for c, k in KINDS.items()], list(KINDS))

        for b in batches:
            for row, text, host in zip(*(b.column(c).to_pylist() for c in ("row_id", "text", "host")), strict=True):
                rows.append(row)
                texts.append(text)
                hosts.append(host)
                size += len(text)
                if len(rows) == BLOCK or size > BLOCK_CHARS:
                    yield from flush()
                    rows, texts, hosts, size = [], [], [], 0
        if rows:
            yield from flush()

    return run


def _across_blocks(blocks: DataFrame) -> DataFrame:
    """``(row_id, line_no)`` of lines of hosts in several blocks that repeat on a share of all the host's distinct pages."""
    of_hosts = blocks.filter("host IS NOT NULL AND pages IS NOT NULL")
    total = of_hosts.groupBy("host").agg(F.sum("size").alias("of"))
    each = of_hosts.select("host", F.explode(F.arrays_zip("keys", "pages")).alias("e")).groupBy("host", F.col("e.keys").alias("key")).agg(F.sum("e.pages").alias("n"))
    strong = each.filter(F.col("n") >= STRONG_PAGES).join(total, "host").filter(F.col("n") >= STRONG_SHARE * F.col("of")).select("host", "key")
    lines = blocks.filter("starts IS NOT NULL").select("row_id", "line_no", "host", "size", F.explode(F.arrays_zip("starts", "keys")).alias("e"))
    hot = lines.select("row_id", "line_no", "host", "size", F.col("e.starts").alias("start"), F.col("e.keys").alias("key")).join(strong, ["host", "key"])
    starts = hot.groupBy("row_id", "line_no").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("start")).alias("starts"))
    none = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", none, lambda x, s: F.struct(s.alias("at"), (x["n"] + F.least(F.lit(WINDOW), s - x["at"])).alias("n")))["n"]
    return starts.filter(F.least(covered, F.col("size")) >= STRONG_COVER * F.col("size")).select("row_id", "line_no")


def line_bound(blocks: DataFrame) -> list[int]:
    """Hashes of line-bound frames.  As each is on ``FRAME_SHARE`` of all pages, there are at most the lines of 1 / ``FRAME_SHARE`` pages, twice."""
    of_blocks = blocks.filter("everywhere IS NOT NULL")
    n = of_blocks.agg(F.sum("size")).first()[0] or 0
    each = of_blocks.select(F.explode(F.arrays_zip("keys", "pages", "here", "everywhere")).alias("e")).groupBy(F.col("e.keys").alias("key")).agg(
        F.sum("e.pages").alias("pages"), F.sum("e.here").alias("here"), F.sum("e.everywhere").alias("everywhere")
    )
    often = each.filter((F.col("pages") >= max(FRAME_PAGES, FRAME_SHARE * n)) & (F.col("here") >= BOUND * F.col("everywhere")))
    return [r.key for r in often.select("key").collect()]


FRAMES = ("heads", "tails", "forms")


def _hits(b: pa.RecordBatch, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each kind of frame the place in the sorted ``keys`` of each line's, and whether it is there."""
    out = []
    for c in FRAMES:
        k = b.column(c).flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        out.append((at, keys[at] == k))
    return out


def _edges(keys: np.ndarray):
    """Of each frame of ``keys`` the lines with it, and those of them at an edge of their page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, edge = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("heads")).to_numpy(zero_copy_only=False).astype(np.int64)
            hits = _hits(b, keys)
            body = ~(hits[0][1] | hits[1][1] | hits[2][1] | b.column("sure").flatten().to_numpy(zero_copy_only=False))
            # lines of body before each line, and around its page; a page without any tells nothing
            before = np.r_[0, np.cumsum(body)]
            begin = np.r_[0, np.cumsum(sizes)][:-1].repeat(sizes)
            ends = np.cumsum(sizes).repeat(sizes)
            here = np.arange(len(body))
            told = before[ends] > before[begin]
            outside = (before[here] == before[begin]) | (before[ends] == before[here])
            for at, hit in hits:
                total += np.bincount(at[hit & told], minlength=len(keys))
                edge += np.bincount(at[hit & told & outside], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(total[some]), pa.array(edge[some])], ["key", "n", "at_edge"])

    return run


def around_the_body(framed: DataFrame, keys: np.ndarray) -> np.ndarray:
    """The line-bound frames that stand at the edges of pages."""
    for _ in range(ROUNDS):
        if not len(keys):
            break
        each = framed.select(*FRAMES, "sure").mapInArrow(_edges(keys), "key long, n long, at_edge long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("at_edge").alias("at_edge"))
        left = np.array(sorted(r.key for r in each.filter(F.col("at_edge") >= EDGE * F.col("n")).select("key").collect()), np.int64)
        keys, done = left, len(left) == len(keys)
        if done:
            break
    return keys


def _framed(accepted: np.ndarray):
    """Lines that have a frame that is furniture, or go by repetition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("heads")).to_numpy(zero_copy_only=False).astype(np.int64)
            out = b.column("sure").flatten().to_numpy(zero_copy_only=False)
            for _, hit in _hits(b, accepted) if len(accepted) else ():
                out = out | hit
            rows = b.column("row_id").take(pa.array(np.arange(b.num_rows).repeat(sizes)[out]))
            lines = b.column("lines").flatten().to_numpy(zero_copy_only=False)[out].astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows, pa.array(lines, pa.int64())], ["row_id", "line_no"])

    return run


def _pages(web: DataFrame) -> DataFrame:
    return web.filter("text IS NOT NULL AND text != ''").select("row_id", "text", F.coalesce(F.lower("domain"), F.lit("")).alias("host"))


def furniture_by_frames(web: DataFrame, ids: DataFrame) -> DataFrame:
    """``(row_id, line_no)`` of the lines of the pages in ``ids`` that have a frame that is furniture; frames are counted over all of ``web``, which isn't shuffled."""
    framed = cut(_pages(web).mapInArrow(_blocks(False), BLOCK_ROWS))
    accepted = around_the_body(framed.filter("lines IS NOT NULL"), np.array(sorted(line_bound(framed)), np.int64))
    of_ids = framed.filter("lines IS NOT NULL").select("row_id", "lines", *FRAMES, "sure").join(ids, "row_id", "left_semi")
    return of_ids.mapInArrow(_framed(accepted), "row_id long, line_no long")


def furniture(web: DataFrame) -> DataFrame:
    """``(row_id, line_no)`` of each line that isn't part of its page's main body."""
    # copies of a page lie together, so that they count once
    pages = _pages(web).withColumn("salt", F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")))
    parts = task_count(web.sparkSession, web.count(), 20_000)
    order = ("host", "salt", F.xxhash64("row_id"))
    placed = pages.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = cut(placed.select("row_id", "text", "host").mapInArrow(_blocks(True), BLOCK_ROWS))
    framed = blocks.filter("lines IS NOT NULL").select("row_id", "lines", *FRAMES, "sure")
    accepted = around_the_body(framed, np.array(sorted(line_bound(blocks)), np.int64))
    return framed.mapInArrow(_framed(accepted), "row_id long, line_no long").unionByName(_across_blocks(blocks)).distinct()


def main_body(web: DataFrame) -> DataFrame:
    """``web`` with the furniture taken out of ``text``; a null text stays null."""
    drop = furniture(web).groupBy(F.col("row_id").alias("__row")).agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__drop", i.cast("long")))
    out = web.join(drop, F.col("row_id") == F.col("__row"), "left")
    return out.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__row", "__drop")
