"""Text garbled by a wrong character encoding: found and restored by scored encode-decode chains.

A chain encodes text back to bytes by the encoding it was wrongly read in and decodes it by the
one it was written in.  A smoothed character n-gram model, trained on all clean records (the
labelled samples, twice, and the rows whose label and address agree), scores every
token before and after each chain; the chain with the largest total gain over a row's tokens is
accepted where the gain exceeds a margin.  Multi-byte chains must in addition decode strictly to
letters and marks that the languages use, and single-byte chains must change more than a token's
first letter, as a correct foreign name may begin with any letter.  A token that clean records have
isn't garbled for a single-byte chain, and at least ``KNOWN`` of the tokens such a chain restores
in a row must be tokens of clean records: so correct text in a language that the records lack,
which any chain may make a little likelier, stays.

Tokens without suspicious characters are skipped and decisions are kept in a bounded cache, so
clean text costs one scan.  A row with U+FFFD or with control characters of the C1 block shows
lost or garbled characters in any case.

Cases: null, empty and plain ASCII texts are never garbled; composed and decomposed accents,
zero-width and soft-hyphen characters and typographic marks are no evidence; lost characters are
left as they are in the restored text.  Rows given twice are given twice.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.llm.languages import LANGUAGES, address_language
from paraloom.operators.hot_keys import language_code
from paraloom.session import cut

#: (wrongly read as, written in); fixed values, names of public encodings.
MULTI = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1250", "utf-8"), ("iso8859-2", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp852", "utf-8"), ("mac_roman", "utf-8")]
SINGLE = [("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "iso8859-2"), ("latin-1", "iso8859-2"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("cp1250", "cp852"), ("cp1252", "cp852"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp852", "cp1250"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "cp1250")]
MARGIN, TOKEN_MARGIN = 9.0, 3.0
#: Least score a character of a token restored by a single-byte chain, and the most a token may lose when a whole text is decoded.
LIKELY, LOSS = -5.0, 2.0
RARER = 20
#: Share of the tokens restored by a single-byte chain that clean records must have.
KNOWN = 0.5
#: Occurrences in clean records that make a token a word of theirs.
LEAST = 4
#: Marks and spaces that occur in correct text.
PLAIN = " ­​ ﻿–—’‘“”„‚…•»«›‹€£¥§©®×°½¼¾²³−™·¿¡´`"
#: Marks that letters of another encoding are often taken for, when beside letters.
DOUBTFUL = "¼¾³²½"
SUSPECT = re.compile(rf"[{DOUBTFUL}][^\W\d_]|[^\W\d_][{DOUBTFUL}]|[^\x00-\x7f{PLAIN}̀-ͯ]|\w[^\x00-\x7f\w’–— ­​̀-ͯ]\w|[£¡‚]\w")
LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")
DIGITS = re.compile(r"\d+")
RUN = re.compile(r"[^\x00-\x7f]+")
#: Marks around a word.
AROUND = ".,;:!?…()[]\"'„“”‚‘’«»–—|"
CACHE = 200_000


def _codes(name: str) -> dict[str, int]:
    """Character to byte; bytes an encoding leaves undefined are the control characters of that number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


CODES = {name: _codes(name) for name in {x for chain in MULTI + SINGLE for x in chain} - {"utf-8"}}
CHARS = {name: {b: c for c, b in codes.items()} for name, codes in CODES.items()}


def count_grams(words: Iterable[tuple[str, int]]) -> dict[str, Counter]:
    """Context of up to two characters -> counts of the character after it."""
    grams: dict[str, Counter] = defaultdict(Counter)
    for w, n in words:
        p = f"  {w} "
        for i in range(2, len(p)):
            for k in range(3):
                grams[p[i - k : i]][p[i]] += min(n, 5)
    return grams


class NGrams:
    """Interpolated character trigrams over tokens."""

    def __init__(self, grams: dict[str, Counter]):
        self.grams = grams
        self.totals = {k: (sum(c.values()), len(c)) for k, c in self.grams.items()}
        self.alphabet = set(self.grams.get("", ()))

    def score(self, token: str) -> float:
        """Log likelihood of a token, numbers counting as one sign; a no-break space parts words as a space does."""
        token = DIGITS.sub("0", token)
        return sum(map(self._word, token.split("\xa0"))) if "\xa0" in token else self._word(token)

    def _word(self, token: str) -> float:
        p, total = f"  {token} ", 0.0
        for i in range(2, len(p)):
            x = 1e-5
            for k in range(3):
                if (t := self.totals.get(p[i - k : i])) is None:
                    break
                x = (self.grams[p[i - k : i]].get(p[i], 0) + t[1] * x) / (t[0] + t[1])
            total += math.log(x)
        return total


def decode_multi(token: str, enc: str) -> str | None:
    """The token with each non-ASCII run that is valid UTF-8 under ``enc`` decoded, or None if none is."""
    codes, changed = CODES[enc], False

    def run(m: re.Match) -> str:
        nonlocal changed
        try:
            out = bytes([codes[c] for c in m[0]]).decode()
        except (KeyError, UnicodeDecodeError):
            return m[0]
        changed = True
        return out

    got = RUN.sub(run, token)
    return got if changed else None


def decode_single(token: str, enc: str, dec: str) -> str | None:
    codes, chars = CODES[enc], CHARS[dec]
    got = "".join(c if c < "\x80" else chars[codes[c]] if c in codes else "\0" for c in token)
    return None if "\0" in got or got == token else got


class Judge:
    """Gains of the chains on tokens, and verdicts on rows.

    ``words`` holds the keys of clean records' tokens, at least those that ``asked`` gives of a row.
    """

    def __init__(self, words: dict[str, int], grams: dict[str, Counter] | None = None, known: set[str] | None = None):
        self.model = NGrams(count_grams(words.items()) if grams is None else grams)
        self.words = {self.key(w) for w in words} if known is None else known
        self.cache: dict[str, tuple[str, dict, dict]] = {}

    @staticmethod
    def key(token: str) -> str:
        """A token without case, marks around it and the digits of its numbers."""
        return DIGITS.sub("0", token.lower()).strip(AROUND)

    def plausible(self, s: str) -> bool:
        return all(c < "ƀ" and not "\x7f" <= c < "\xa0" or c in self.model.alphabet or c in PLAIN or c in "−≈" for c in s)

    def gains(self, token: str) -> dict[tuple, tuple[float, str, bool]]:
        """chain -> (gain, restored token, whether it is more than the first letter that changes)."""
        key, multi, _ = self._cached(token)
        return multi if key in self.words else multi | self._single(token)

    def _cached(self, token: str) -> tuple[str, dict, dict]:
        """The token's key, its gains by multi-byte chains and, once asked for, by single-byte chains."""
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            got = self.cache[token] = (self.key(token), self._multi_gains(token), {})
        return got

    def _single(self, token: str) -> dict[tuple, tuple[float, str, bool]]:
        single = self._cached(token)[2]
        if not single:
            single["gains"] = self._single_gains(token)
        return single["gains"]

    def _multi_gains(self, token: str) -> dict[tuple, tuple[float, str, bool]]:
        out = {}
        base = self.model.score(token.lower())
        for enc, dec in MULTI:
            if (x := decode_multi(token, enc)) and self.plausible(x):
                twice = decode_multi(x, enc)
                if twice and self.plausible(twice):
                    out[enc, dec, enc, dec] = (self.model.score(twice.lower()) - base, twice, True)
                else:
                    out[enc, dec] = (self.model.score(x.lower()) - base, x, True)
            elif x and (twice := decode_multi(x, enc)) and self.plausible(twice):
                out[enc, dec, enc, dec] = (self.model.score(twice.lower()) - base, twice, True)
        return out

    def _single_gains(self, token: str) -> dict[tuple, tuple[float, str, bool]]:
        out = {}
        base = self.model.score(token.lower())
        for enc, dec in SINGLE:
            if (x := decode_single(token, enc, dec)) and self.plausible(x):
                score = self.model.score(x.lower())
                gain = score - base if score >= LIKELY * len(x) else 0.0
                first = next((i for i, c in enumerate(token) if c.isalnum()), 0)
                if gain > 0 and not (token.isupper() and any(map(str.islower, x))):
                    out[enc, dec] = (gain, x, any(a != b for i, (a, b) in enumerate(zip(token, x, strict=True)) if i != first or a.islower() or not a.isalpha() or not b.isalpha()))
        return out

    def asked(self, text: str) -> set[str]:
        """Keys that the verdict on a text looks up."""
        tokens = suspects(text)
        chains = {c for t in tokens for c in self._single(t)}
        return {self.key(t) for t in tokens} | {self.key(decode_single(t, *c) or t) for t in beyond_ascii(text) for c in chains}

    def likely_words(self, tokens: set[str], chain: tuple) -> bool:
        """Whether clean records have enough of the tokens that a chain restores."""
        got = [self.key(g[chain][1]) in self.words for t in tokens if chain in (g := self.gains(t)) and g[chain][0] > TOKEN_MARGIN]
        return sum(got) >= KNOWN * len(got)

    def row(self, text: str) -> tuple[str, float, dict[str, str]] | None:
        """(chain, gain, token -> restored token) of the best chain beyond the margin, else None."""
        totals: dict[tuple, float] = defaultdict(float)
        firm: set[tuple] = set()
        tokens = suspects(text)
        for t in tokens:
            for chain, (gain, _, deep) in self.gains(t).items():
                if gain > TOKEN_MARGIN or chain[1] == "utf-8" and gain > 0:
                    totals[chain] += gain
                    if deep:
                        firm.add(chain)
        firm = {c for c in firm if c[1] == "utf-8" or self.likely_words(tokens, c)}
        best = max(firm, key=lambda c: (totals[c], c), default=None)
        if best is None or totals[best] < (TOKEN_MARGIN if best[1] == "utf-8" else MARGIN):
            return None
        fixes = {}
        if best[1] != "utf-8":
            # a text that was garbled as a whole is decoded as a whole, unless that harms a token; one that clean records have isn't harmed
            whole = {t: decode_single(t, *best) or t for t in beyond_ascii(text)}
            if all(self.key(x) in self.words or self.model.score(x.lower()) - self.model.score(t.lower()) > -LOSS for t, x in whole.items()):
                return ">".join(best), totals[best], whole
        for t in tokens:
            g = self.gains(t)
            options = [g[c] for c in g if (c == best or c[1] == "utf-8" == best[1]) and g[c][0] > 0]
            if options:
                fixes[t] = max(options)[1]
        return ">".join(best), totals[best], fixes


def suspects(text: str) -> set[str]:
    """The tokens with suspicious characters."""
    return {t for t in re.split(r"[ \n\t\r]+", text) if SUSPECT.search(t)}


def beyond_ascii(text: str) -> set[str]:
    return {t for t in re.split(r"[ \n\t\r]+", text) if not t.isascii()}


def _readable(run: str) -> bool:
    """Whether a multi-byte chain turns the non-ASCII characters into letters and marks in use."""
    return any((x := decode_multi(run, enc)) and all(c < "ƀ" or c in PLAIN for c in x) for enc, _ in MULTI)


class WordCounter:
    """Counts tokens of texts that show no sign of garbling, in the case they have: bytes differ between cases."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.runs: dict[str, bool] = {}

    def clean(self, text: str) -> bool:
        if text.isascii():
            return not LOST.search(text)
        if LOST.search(text):
            return False
        runs = self.runs
        for r in set(RUN.findall(text)):
            bad = runs.get(r)
            if bad is None:
                if len(runs) > CACHE:
                    runs.clear()
                bad = runs[r] = _readable(r)
            if bad:
                return False
        return True

    def update(self, texts: Iterable[str]) -> None:
        # tokens are what spaces, tabs and line ends part
        flat = DIGITS.sub("0", " ".join(filter(self.clean, texts))).translate({10: " ", 9: " ", 13: " "})
        self.counts.update(flat.split(" "))
        self.counts.pop("", None)


def clean_words(texts: list[str], least: int = LEAST) -> dict[str, int]:
    """Tokens of the texts that show no sign of garbling, in lower case, with their counts.

    A token that a single-byte chain turns into one ``RARER`` times as frequent is a garbled one
    that came through, and left out.
    """
    counter = WordCounter()
    counter.update(texts)
    every: Counter = Counter()
    for w, n in counter.counts.items():
        every[w.lower()] += n
    words = Counter(every)
    for w, n in counter.counts.items():
        if any(every.get(x, 0) >= RARER * n for x in turned(w)):
            words[w.lower()] -= n
    return {w: n for w, n in words.items() if n >= least}


def turned(word: str) -> set[str]:
    """What the single-byte chains turn a word into, in lower case."""
    return set() if word.isascii() else {x.lower() for c in SINGLE if (x := decode_single(word, *c))}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = WordCounter()
    for b in batches:
        counter.update(b.column("text").to_pylist())
        if len(counter.counts) > CACHE:
            yield _counted(counter.counts)
            counter.counts.clear()
    yield _counted(counter.counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in lower case with what the chains turn them into, and without."""
    for b in batches:
        rows = [(w, w.lower(), n, x) for w, n in zip(*(b.column(c).to_pylist() for c in ("word", "n")), strict=True) for x in (None, *turned(w))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["cased", "word", "n", "other"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, c, n) for k, after in count_grams(zip(*(b.column(c).to_pylist() for c in ("word", "n")), strict=True)).items() for c, n in after.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["context", "after", "n"])


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(set(map(Judge.key, b.column("word").to_pylist()))), pa.string())], ["key"])


def counted_words(web: DataFrame, samples: DataFrame) -> DataFrame:
    """``(word, n)`` as ``clean_words`` gives them, counted over all samples, twice, and all rows whose label is what their address names."""
    label = language_code(F.col("language"))
    agreeing = web.filter(label.isin(*LANGUAGES) & (label == address_language(F.col("uri"))) & F.col("text").isNotNull()).select("text")
    texts = samples.filter("text IS NOT NULL").select("text")
    counts = texts.unionByName(texts).unionByName(agreeing).mapInArrow(_count_words, "word string, n long")
    cased = cut(counts.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_turn, "cased string, word string, n long, other string"))
    words = cased.filter("other IS NULL").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    others = words.filter(F.col("n") >= RARER).select(F.col("word").alias("other"), F.col("n").alias("of_other"))
    bad = cased.join(others, "other").filter(F.col("of_other") >= RARER * F.col("n")).select("cased", "word", "n").distinct()
    left = words.join(bad.groupBy("word").agg(F.sum("n").alias("garbled")), "word", "left").withColumn("n", F.col("n") - F.coalesce("garbled", F.lit(0)))
    return cut(left.filter(F.col("n") >= LEAST).select("word", "n"))


_JUDGES: dict[int, Judge] = {}


def _of_worker(key: int, grams: dict[str, Counter], known: set[str]) -> Judge:
    if key not in _JUDGES:
        _JUDGES[key] = Judge({}, grams, known)
    return _JUDGES[key]


def _may_be_garbled(text: str) -> bool:
    return not text.isascii() and bool(SUSPECT.search(text) or LOST.search(text))


def _judge(key: int, grams: dict[str, Counter], known: set[str] | None):
    """Verdicts; without ``known`` words the rows bring theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _of_worker(key, grams, known or set())
        for b in batches:
            out = []
            of_rows = b.column("known").to_pylist() if known is None else None
            for i, text in enumerate(b.column("text").to_pylist()):
                if not _may_be_garbled(text):
                    continue
                if of_rows is not None:
                    judge.words = set(of_rows[i] or ())
                lost, got = bool(LOST.search(text)), judge.row(text)
                if got or lost:
                    chain, gain, fixes = got or ("", 0.0, {})
                    fixed = "".join(fixes.get(x, x) for x in re.split(r"([ \n\t\r]+)", text)) if fixes else text
                    out.append((i, fixed, chain, gain, "�" in fixed))
            if out:
                rows, fixed, chain, gain, left = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row_id").take(pa.array(rows, pa.int64())), pa.array(fixed, pa.string()), pa.array(chain, pa.string()), pa.array(gain, pa.float64()), pa.array(left, pa.bool_())],
                    ["row_id", "restored", "chain", "gain", "lost"],
                )

    return run


def _ask(key: int, grams: dict[str, Counter]):
    """The keys that each row's verdict looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _of_worker(key, grams, set())
        for b in batches:
            asked = [judge.asked(t) if _may_be_garbled(t) else () for t in b.column("text").to_pylist()]
            of = pa.array([i for i, keys in enumerate(asked) for _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row_id").take(of), pa.array([k for keys in asked for k in keys], pa.string())], ["row_id", "key"])

    return run


def garbled(web: DataFrame, samples: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """``(row_id, restored, chain, gain, lost)`` of each garbled row; ``lost``: characters are gone for good.

    Up to ``most_broadcast`` known words are sent to the workers; beyond, those that a row asks for are joined to it.
    """
    words = counted_words(web, samples)
    grams: dict[str, Counter] = defaultdict(Counter)
    for r in words.mapInArrow(_gram_rows, "context string, after string, n long").groupBy("context", "after").agg(F.sum("n").alias("n")).collect():
        grams[r.context][r.after] = r.n
    keys = words.mapInArrow(_word_keys, "key string").distinct()
    rows = web.filter("text IS NOT NULL").select("row_id", "text")
    known = None
    if words.count() <= most_broadcast:
        known = {r.key for r in keys.collect()}
    key = hash((frozenset((k, c, n) for k, after in grams.items() for c, n in after.items()), known is None or frozenset(known)))
    if known is None:
        asked = rows.mapInArrow(_ask(key, grams), "row_id long, key string").join(keys, "key").groupBy("row_id").agg(F.collect_set("key").alias("known"))
        asked = asked.withColumnRenamed("row_id", "__row")
        rows = rows.join(asked, F.col("row_id").eqNullSafe(F.col("__row")), "left").select("row_id", "text", "known")
    return rows.mapInArrow(_judge(key, grams, known), "row_id long, restored string, chain string, gain double, lost boolean")
