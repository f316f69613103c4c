"""Language of documents and segments by Bayesian evidence fusion.

Each sentence's posterior over the languages combines three sources of evidence, added as log
likelihoods: the text (a word model mixed with an interpolated character n-gram model), the
declared label and the address's language path or suffix, and a host prior.  Host priors are
counted over all rows by a grouped aggregation and smoothed towards the counts of all hosts, so a
host with few rows leans on the whole.  Declared evidence is bounded: it decides where the text
says little and yields where the text is clear.

The text model is fitted on at most ``most_samples`` labelled sentences and the sentences of about
``most_rows`` rows whose label and address agree: first all under their row's label, then, once
more, each under the language that this model and the label together give it, so that a foreign
sentence in a row is counted for its own language.  A word's scores are computed once per worker
and kept in a bounded cache, so a sentence costs a few look-ups.

A sentence is evidence of a language of its own if it has ``MIN_WORDS`` words or more, its best
language leads by ``MARGIN`` nats and, where that isn't the document's likeliest language, beats
that by ``OTHER_MARGIN``; other units join the language of the document.  A background model of
the letters of all languages stands for every other language: a word that a language's vocabulary
lacks speaks against it as much as such words are rare in held-out sentences of the language.  A
sentence likelier under the background by ``MARGIN`` is of none of the languages, and so is a text none of
whose sentences is of one.

Cases: texts without words (null, empty, numbers only) get no language; labels are compared
without letter case and region suffix; names and single foreign words cannot outweigh a sentence
because a word's contribution is clipped; a text in none of LANGUAGES gets none, and only its
label tells whether it fits; words are seen composed and without hidden characters; words broken by wrong decoding say nothing, and the
models know words without their accents, too.  Ties between languages go to the declared one, then to the order of LANGUAGES.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.llm.samples import bounded
from paraloom.operators.hot_keys import language_code
from paraloom.session import cut

LANGUAGES = ("en", "cs", "de", "sk", "fr")
MIN_WORDS, MARGIN, OTHER_MARGIN = 4, 4.0, 12.0
CLIP, NAME_WEIGHT = 5.0, 0.2
#: The most a known word speaks for a language against the background, and the bounds of the rate of unknown words.
KNOWN, UNKNOWN = 2.0, (0.15, 0.2)
DECLARED, ADDRESS = 3.0, 2.0
#: Characters that wrong decoding leaves in words; the letters beside them are fragments and say nothing.
BROKEN = "\u0080-\u009f¡-¦¨©¬-¯±-´¶¸-º¼-¾ƒˆ-˝‚†‡‰√∂≈∞≤≥⌐─-▟�"
ANY_BROKEN = re.compile(f"[{BROKEN}]")
WORD = re.compile(rf"(?<![^\W\d_])(?<![{BROKEN}])[^\W\d_]++(?![{BROKEN}])")
BREAK = re.compile(r"(?<=[.?!…])[\"”“»«'’)\]]*\s+|\n+|\s+[/|–—•»>]\s+|(?<=[a-zà-ž][.?!])(?=[A-ZÀ-Ž])|;\s+")
CACHE = 300_000


class TextModel:
    """log P(word | language) from labelled sentences, mixing whole words and character n-grams."""

    def __init__(self, words: list[dict[str, int]], unknown: list[float] | None = None, order: int = 4):
        self.order = order
        self.words = words
        self.strange = [math.log(x) for x in unknown or [UNKNOWN[0]] * len(LANGUAGES)]
        self.grams = [defaultdict(Counter) for _ in LANGUAGES]
        self.alphabet = {c for ws in self.words for w in ws for c in w}
        self.floor = 1 / (len(self.alphabet) + 200)
        for at, ws in enumerate(self.words):
            for w, n in ws.items():
                padded = " " * (order - 1) + w + " "
                for i in range(order - 1, len(padded)):
                    for k in range(order):
                        self.grams[at][padded[i - k : i]][padded[i]] += min(n, 3)
        self.totals = [{k: (sum(c.values()), len(c)) for k, c in g.items()} for g in self.grams]
        self.sizes = [max(1, sum(ws.values())) for ws in self.words]
        letters: Counter = Counter()
        for g in self.grams:
            letters.update(g[""])
        self.letters = {c: math.log(n / letters.total()) for c, n in letters.items()}

    def _chars(self, at: int, word: str) -> float:
        grams, totals, total = self.grams[at], self.totals[at], 0.0
        padded = " " * (self.order - 1) + word + " "
        for i in range(self.order - 1, len(padded)):
            p = self.floor
            for k in range(self.order):
                context = padded[i - k : i]
                if (t := totals.get(context)) is None:
                    break
                n, kinds = t
                p = (grams[context].get(padded[i], 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total

    def score(self, word: str) -> list[float]:
        """Scores of the word per language, centred and clipped, then those against the background; a capitalised word may be a name and weighs little.

        A word with a character that no labelled sentence has speaks against all languages, but not between them.
        """
        weight = NAME_WEIGHT if word[0].isupper() and not word.isupper() else 1.0
        word = word.lower()
        if not self.alphabet.issuperset(word):
            return [0.0] * len(LANGUAGES) + [weight * x for x in self.strange]
        raw = []
        for at in range(len(LANGUAGES)):
            chars = math.exp(max(self._chars(at, word), -600))
            raw.append(math.log(0.7 * self.words[at].get(word, 0) / self.sizes[at] + 0.3 * chars + 1e-300))
        best = max(raw)
        ground = sum(map(self.letters.__getitem__, word)) + self.letters[" "]
        known = [min(KNOWN, r - ground) if word in ws else x for r, ws, x in zip(raw, self.words, self.strange, strict=True)]
        return [weight * max(r - best, -CLIP) for r in raw] + [weight * x for x in known]


class Scorer:
    """Word scores by look-up, with a bounded cache."""

    def __init__(self, words: list[dict[str, int]], unknown: list[float] | None = None):
        self.model = TextModel(words, unknown)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, 2 * len(LANGUAGES)))

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit the summed scores between the languages, those against the background, and the number of words."""
        if len(self.ids) > CACHE:
            self._reset()
        ids, flat, counts = self.ids, [], []
        for u in units:
            ws = WORD.findall(plain(u))
            counts.append(len(ws))
            if ws:
                ws[0] = ws[0].lower()
            for w in ws:
                k = ids.get(w)
                if k is None:
                    k = ids[w] = len(ids)
                    if k >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[k] = self.model.score(w)
                flat.append(k)
        n = np.array(counts, np.int64)
        total = np.zeros((len(flat) + 1, 2 * len(LANGUAGES)))
        if flat:
            np.cumsum(self.rows[np.array(flat)], axis=0, out=total[1:])
        ends = np.cumsum(n)
        both = total[ends] - total[ends - n]
        return both[:, : len(LANGUAGES)], both[:, len(LANGUAGES) :], n


_SCORERS: dict[int, Scorer] = {}
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def plain(text: str) -> str:
    """The text with accents composed and without soft hyphens and zero-width characters, which part no words."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(HIDDEN))


def units_of(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the text's sentences and lines."""
    out, begin = [], 0
    for m in BREAK.finditer(text):
        if m.end() > begin:
            out.append((begin, m.end()))
            begin = m.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def count_words(samples: list[tuple[str, str]]) -> list[Counter]:
    """Words of the labelled sentences of each language."""
    words = [Counter() for _ in LANGUAGES]
    for lang, text in samples:
        if lang in LANGUAGES:
            words[LANGUAGES.index(lang)].update(WORD.findall(plain(text).lower()))
    return words


def without_accents(words: Counter, share: float = 0.1) -> Counter:
    """The words with their forms without accents added at ``share`` of their counts."""
    plain: Counter = Counter()
    for w, n in words.items():
        if (p := "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))) != w:
            plain[p] += math.ceil(share * n)
    return words + plain


def refine(words: list[Counter], rows: list[tuple[str, str]], trust: float = 10.0, least: int = 3) -> list[Counter]:
    """The words with those of the rows' sentences added, first under the row's label, then each sentence under its likeliest language.

    The row's label counts ``trust`` nats; single words are left out, and so are words of fewer
    than ``least`` occurrences, mostly names.
    """
    units = [(label, u, ws) for label, text in rows for s, e in units_of(text) if len(ws := WORD.findall(plain(u := text[s:e]))) >= 2]
    declared = np.array([[x == label for x in LANGUAGES] for label, _, _ in units], float).reshape(-1, len(LANGUAGES))
    at = declared.argmax(axis=1) if len(units) else []
    for again in (True, False):
        more = [Counter() for _ in LANGUAGES]
        for (_, _, ws), k in zip(units, at, strict=True):
            more[k].update([w.lower() for w in ws])
        both = [without_accents(a + Counter({w: c for w, c in b.items() if c >= least})) for a, b in zip(words, more, strict=True)]
        if again and units:
            score, _, _ = Scorer(both)([u for _, u, _ in units])
            at = (score + trust * declared).argmax(axis=1)
    return both


def unknown_rates(words: list[Counter], rows: list[tuple[str, str]]) -> list[float]:
    """Of each language the share of lower-case words of one half of the rows, split by their texts' digests, that the other half and ``words`` lack."""
    halves: tuple[list[Counter], list[Counter]] = ([Counter() for _ in LANGUAGES], [Counter() for _ in LANGUAGES])
    for label, text in rows:
        if label in LANGUAGES:
            halves[blake2b(text.encode(errors="replace"), digest_size=1).digest()[0] & 1][LANGUAGES.index(label)].update(w for w in WORD.findall(plain(text)) if w.islower())
    out = []
    for at in range(len(LANGUAGES)):
        held = halves[1][at]
        seen = halves[0][at].keys() | words[at].keys()
        missing = sum(n for w, n in held.items() if w not in seen)
        out.append(min(UNKNOWN[1], max(UNKNOWN[0], missing / max(1, held.total()))))
    return out


def _identify(words: list[dict[str, int]], unknown: list[float], only_cases: bool):
    key = hash((*unknown, *(frozenset(w.items()) for w in words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS[key] = Scorer(words, unknown)
        scorer = _SCORERS[key]
        for b in batches:
            if b.num_rows:
                yield _batch(b, scorer, only_cases)

    return run


KINDS = pa.list_(pa.struct([("language", pa.string()), ("confidence", pa.float64())]))
SEGMENTS = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))


def _batch(b: pa.RecordBatch, scorer: Scorer, only_cases: bool) -> pa.RecordBatch:
    texts, labels = b.column("text").to_pylist(), b.column("label").to_pylist()
    prior = np.stack([np.array(b.column(f"prior_{x}").to_pylist(), float) for x in LANGUAGES], axis=1)
    spans, units, owner = [], [], []
    for i, t in enumerate(texts):
        for s, e in units_of(t):
            spans.append((s, e))
            units.append(t[s:e])
            owner.append(i)
    own = np.array(owner, np.int64)
    score, known, n = scorer(units)
    whole = np.zeros((len(texts), len(LANGUAGES)))
    whole_known = np.zeros((len(texts), len(LANGUAGES)))
    words = np.zeros(len(texts), np.int64)
    np.add.at(whole, own, score)
    np.add.at(whole_known, own, known)
    np.add.at(words, own, n)
    doc = whole + prior
    posterior = softmax(score + prior[own]) if len(own) else np.zeros((0, len(LANGUAGES)))
    ranked = np.sort(score, axis=1)
    sure = (n >= MIN_WORDS) & (ranked[:, -1] - ranked[:, -2] >= MARGIN)
    best = score.argmax(axis=1) if len(own) else np.zeros(0, np.int64)
    strange = known[np.arange(len(own)), best] < -MARGIN
    bounds = np.searchsorted(own, np.arange(len(texts) + 1))
    doc_best, doc_p = doc.argmax(axis=1), softmax(doc)
    at = np.arange(len(own))
    sure &= ((best == doc_best[own]) | (score[at, best] - score[at, doc_best[own]] >= OTHER_MARGIN)) & ~strange
    rows, langs, right, segments = [], [], [], []
    for i, label in enumerate(labels):
        if not words[i]:
            if not only_cases:
                rows.append(i), langs.append([]), right.append(True), segments.append([])
            continue
        lo, hi = bounds[i], bounds[i + 1]
        found: dict[int, float] = {}
        for k in np.flatnonzero(sure[lo:hi]) + lo:
            found[int(best[k])] = max(found.get(int(best[k]), 0.0), float(posterior[k, best[k]]))
        if not found and words[i] >= MIN_WORDS and whole_known[i, doc_best[i]] < -MARGIN and not ANY_BROKEN.search(texts[i]):
            if not only_cases:  # a text in none of the languages
                rows.append(i), langs.append([]), right.append(label is None), segments.append([])
            continue
        if not found:
            at = int(doc_best[i])
            if label is not None and doc[i, at] - doc[i, LANGUAGES.index(label)] < OTHER_MARGIN:
                at = LANGUAGES.index(label)  # without a sentence the label holds unless the words speak clearly
            found = {at: float(doc_p[i, at])}
        elif len(found) == 1 and label is not None and doc[i, (at := next(iter(found)))] - doc[i, LANGUAGES.index(label)] < OTHER_MARGIN:
            found = {LANGUAGES.index(label): float(doc_p[i, LANGUAGES.index(label)])}  # sure of its sentences, but not against the label
        fits = len(found) == 1 and LANGUAGES[next(iter(found))] == label
        if only_cases and fits:
            continue
        rows.append(i)
        right.append(fits)
        langs.append([{"language": LANGUAGES[x], "confidence": p} for x, p in sorted(found.items(), key=lambda z: (-z[1], z[0]))])
        segments.append([] if only_cases else _segments(lo, hi, spans, best, sure, posterior, int(max(found, key=found.get))))
    return pa.RecordBatch.from_arrays(
        [b.column("row_id").take(pa.array(rows, pa.int64())), pa.array(langs, KINDS), pa.array(right, pa.bool_()), pa.array(segments, SEGMENTS)],
        ["row_id", "languages", "label_fits", "segments"],
    )


def _segments(lo, hi, spans, best, sure, posterior, fallback: int) -> list[dict]:
    """Runs of units of one language; an unsure unit continues the run before it."""
    out: list[dict] = []
    current = next((int(best[k]) for k in range(lo, hi) if sure[k]), fallback)
    for k in range(lo, hi):
        current = int(best[k]) if sure[k] else current
        p = float(posterior[k, current])
        if out and out[-1]["language"] == LANGUAGES[current]:
            out[-1]["end_char"] = spans[k][1]
            out[-1]["confidence"] = max(out[-1]["confidence"], p)
        else:
            out.append({"start_char": spans[k][0], "end_char": spans[k][1], "language": LANGUAGES[current], "confidence": p})
    return out


def address_language(uri: Column) -> Column:
    """The language an address names: a path element after the host, or the host's last label."""
    path = F.regexp_extract(uri, r"^[a-z]+://[^/]+/([a-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)
    suffix = F.regexp_extract(uri, r"^[a-z]+://[^/]*\.([a-z]{2})(?:[:/]|$)", 1)
    named = F.when(path != "", path).when(suffix != "", suffix)
    return F.when(named == "cz", F.lit("cs")).when(named == "uk", F.lit("en")).when(named == "at", F.lit("de")).otherwise(named)


def host_priors(web: DataFrame, strength: float = 10.0) -> DataFrame:
    """``(host, host_<language>)``: log priors of each host, smoothed towards all hosts with ``strength`` pseudo-rows."""
    label = language_code(F.col("language"))
    counts = web.filter("domain IS NOT NULL").groupBy(F.lower("domain").alias("host")).agg(
        *[F.count(F.when(label == x, 1)).alias(f"c_{x}") for x in LANGUAGES]
    )
    overall = counts.agg(*[F.sum(f"c_{x}").alias(f"g_{x}") for x in LANGUAGES])
    n = sum((F.col(f"c_{x}") for x in LANGUAGES), F.lit(0))
    g = sum((F.col(f"g_{x}") + 1 for x in LANGUAGES), F.lit(0))
    # one row on the broadcast side
    return counts.crossJoin(F.broadcast(overall)).select("host", *[
        F.log((F.col(f"c_{x}") + F.lit(strength) * (F.col(f"g_{x}") + 1) / g) / (n + F.lit(strength))).alias(f"host_{x}") for x in LANGUAGES
    ])


def agreeing_rows(web: DataFrame, most_rows: int) -> list[tuple[str, str]]:
    """(label, text) of about ``most_rows`` rows whose label is what their address names: a bounded training sample."""
    label = language_code(F.col("language"))
    rows = web.filter(label.isin(*LANGUAGES) & (label == address_language(F.col("uri"))) & F.col("text").isNotNull())
    return [tuple(r) for r in bounded(rows, "row_id", most_rows, web.count()).select(label, "text").collect()]


def identify(web: DataFrame, samples: DataFrame, only_cases: bool = False, most_samples: int = 20_000, most_rows: int = 10_000, most_broadcast: int = 500_000) -> DataFrame:
    """``(row_id, languages, label_fits, segments)`` of each row; with ``only_cases`` those whose label doesn't fit, without segments."""
    web = web.select("row_id", "domain", "language", "uri", "text")
    labelled = samples.filter("text IS NOT NULL AND language IS NOT NULL").orderBy("sample_id").limit(most_samples)
    words = count_words([(r.language, r.text) for r in labelled.select("language", "text").collect()])
    label, address = language_code(F.col("language")), address_language(F.col("uri"))
    trusted = agreeing_rows(web, most_rows)
    unknown = unknown_rates(words, trusted)
    words = refine(words, trusted)
    hosts = cut(host_priors(web))
    hosts = F.broadcast(hosts) if hosts.count() <= most_broadcast else hosts
    rows = web.filter("text IS NOT NULL").join(hosts, F.lower("domain") == F.col("host"), "left").select(
        "row_id", "text", F.when(label.isin(*LANGUAGES), label).alias("label"),
        *[
            (F.coalesce(F.col(f"host_{x}"), F.lit(0.0)) + F.when(label == x, DECLARED).otherwise(0.0) + F.when(address == x, ADDRESS).otherwise(0.0)).alias(f"prior_{x}")
            for x in LANGUAGES
        ],
    )
    return rows.mapInArrow(
        _identify(words, unknown, only_cases),
        "row_id long, languages array<struct<language: string, confidence: double>>, label_fits boolean, "
        "segments array<struct<start_char: int, end_char: int, language: string, confidence: double>>",
    )
