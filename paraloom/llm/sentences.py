"""Sentences of texts in many languages and scripts: a linear-chain model with Viterbi decoding.

A text is first parted where line breaks decide: at blank lines, and at every line break unless
the text is hard-wrapped (its paragraphs are parted by blank lines).  Within such a unit each
possible boundary, a final mark with its closing quotes and brackets, an emoji, or for scripts
without final marks a space, is tagged boundary or inside.  The emissions are what stands left
and right of the place, the tags form a first-order chain whose transitions depend on the
distance between two places, and Viterbi gives the best tagging.  A unit begins as after a boundary.
Marks within quotes and brackets are inside.

Training needs no labels.  Ends of units are boundaries, marks before a lower-case letter are
inside, the others are assigned by expectation maximisation; emissions and transitions are counted
from the posteriors of each unit's whole chain.  In units of an unpunctuated script
the same is done on text stripped of its punctuation, where only unit ends are known; there a final
mark that decides by its form is a place, too.  The sample
is bounded by ``most_docs``.

Cases: null, empty and blank texts give no sentences; texts without any mark are one sentence per
unit; a repeated doc_id gives its sentences each time; very long texts take one linear scan.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame

from paraloom.llm.samples import bounded

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "»": "«", "‚": "‘"}
CLOSE = "”“»«›」』)）]》’\"'"
FINAL = ".?!…。！？｡।॥؟۔"
FULL = "。！？｡।॥؟۔"
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
THAI = re.compile(r"[฀-๿]")
EMOJI = "\U0001f300-\U0001faff☀-➿"
PLACE = re.compile(rf"(?P<mark>[{FINAL}]+)|(?P<emoji>[{EMOJI}]️?)(?=\s)|(?P<open>[“„«‹「『(（\[《])|(?P<close>[”“»›」』)）\]》])")
WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?|\d+")
LEFT = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ॿ.,’'])+$")
ROMAN = re.compile(r"[IVXLC]+$")
QUOTE_REACH = 300
#: Characters between two places below which their distance is of each class; the last class has no end.
GAPS = (3,)
PUNCTUATION = re.compile(r"[^\w\s\u0300-\u036f\u0900-\u0e7f]|[।॥]")


def units_of(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the units that line breaks part."""
    wrapped = BLANK.search(text.strip("\n\r\t ")) is not None
    out, begin = [], 0
    for m in (BLANK if wrapped else re.compile(r"\n+")).finditer(text):
        out.append((begin, m.start()))
        begin = m.end()
    out.append((begin, len(text)))
    return [(b, e) for b, e in out if text[b:e].strip()]


def _trim(text: str, b: int, e: int) -> tuple[int, int]:
    while b < e and text[b].isspace():
        b += 1
    while e > b and text[e - 1].isspace():
        e -= 1
    return b, e


def left_of(unit: str, at: int) -> str:
    """What stands before a mark at ``at``: a word, or a class for numbers, initials, long words and scripts without spaces."""
    if at and unit[at - 1] >= "⺀" and unit[at - 1].isalpha():
        return "cjk"  # no spaces, so no word to look at
    m = LEFT.search(unit, max(0, at - 24), at)
    if not m:
        return "closer" if at and unit[at - 1] in CLOSE else "none"
    w = m[0].lstrip(".,’'")
    if not w:
        return "none"
    tail = w.rstrip(".,’'")
    if tail.isdigit():
        return f"num{min(len(tail), 3)}" if "." not in w and "," not in w else "decimal"
    if len(tail) == 1 and tail.isupper():
        return "initial"
    if ROMAN.match(tail):
        return "roman"
    if len(w) > 7 or len(w) > 5 and w[0].isupper():
        return "long~" + w[-3:].lower()
    return w.lower()


def right_of(unit: str, at: int) -> tuple[str, str]:
    """The first word after ``at`` and its class."""
    k = at
    while k < len(unit) and (unit[k].isspace() or unit[k] in "“„«‹「『(（[《\"'–—-•"):
        k += 1
    if k >= len(unit):
        return "", "end"
    c = unit[k]
    m = WORD.match(unit, k)
    word = m[0] if m else c
    if c.isdigit():
        return word, "digit"
    if c.isalpha():
        kind = "upper" if c.isupper() else "lower" if c.islower() else "letter"
        return word if kind != "letter" else word[:4], kind
    return c, "mark"


class Place:
    """A possible boundary: the end of what closes the sentence, and its evidence."""

    __slots__ = ("end", "left", "right", "kind", "fixed")

    def __init__(self, end: int, left: str, right: str, kind: str, fixed: int | None = None):
        self.end, self.left, self.right, self.kind, self.fixed = end, left, right, kind, fixed


def places_of(unit: str) -> list[Place]:
    """The places of a unit in order; ``fixed`` is 1 or 0 where the form alone decides."""
    out: list[Place] = []
    stack: list[tuple[str, int]] = []
    n, skip = len(unit), 0
    last = 0
    for m in PLACE.finditer(unit):
        at = m.start()
        if at < skip:
            continue
        if m["open"] and not (stack and unit[at] in OPEN[stack[-1][0]]):
            c = unit[at]
            if any(unit.find(x, at + 1, at + QUOTE_REACH) >= 0 for x in OPEN[c]):
                stack.append((c, at))
            continue
        if m["open"] or m["close"]:
            if stack and unit[at] in OPEN[stack[-1][0]]:
                stack.pop()
            continue
        if m["emoji"]:
            end = m.end()
            word, kind = right_of(unit, end)
            if not stack and kind != "end":
                out.append(Place(end, "emoji", word, kind, 1 if kind in ("upper", "letter") else 0))
            continue
        end, opened = m.end(), -1
        depth = list(stack)
        while end < n and (unit[end] in CLOSE or unit[end] in "️"):
            if depth and unit[end] in OPEN[depth[-1][0]]:
                opened = depth.pop()[1]
            elif depth or unit[end] in "“«":
                break
            end += 1
        if depth:
            continue
        if end != m.end():
            stack = depth
            skip = end
        if end >= n or not unit[end:].strip():
            continue
        mark, space = m["mark"], unit[end].isspace()
        word, kind = right_of(unit, end)
        left = left_of(unit, at)
        fixed = None
        if mark[-1] in FULL or mark[-1] in "!?" and kind == "letter":
            # a quote that opened the sentence goes on with who said it
            begins = opened >= 0 and not unit[last:opened].strip()
            fixed = 0 if begins and kind == "letter" and unit[opened] in "“「『《«" else 1
        elif not space and not (left == "cjk" and kind in ("letter", "digit")):
            good = kind == "upper" and end == m.end() and len(word) > 1 and not word.isupper() and left not in ("initial", "none") and not left.startswith(("num", "decimal"))
            glued = opened >= 0 or mark[-1] in "!?"
            if not good and not (glued and kind == "upper"):
                continue
        if fixed is None and kind == "lower":
            fixed = 0
        if fixed is None and left.startswith("num") and not unit[last:at].strip().rstrip("0123456789"):
            fixed = 0
        if fixed is None and mark[-1] in "?!" and kind in ("upper", "letter", "digit", "mark"):
            fixed = 1
        kinds = f"{mark[-1]}{'q' if opened >= 0 else ''}"
        out.append(Place(end, left + kinds, word, kind, fixed))
        if fixed:
            last = end
    return out


def thai_places(unit: str) -> list[Place]:
    """For text without final marks every space is a place, seen by the letters around it; so are marks that decide by their form."""
    out = [p for p in places_of(unit) if p.fixed]
    marked = {p.end for p in out}
    for m in re.finditer(r"\s+", unit):
        b, e = m.start(), m.end()
        if b == 0 or e == len(unit) or b in marked:
            continue
        # seen as in training, without punctuation
        left, right = PUNCTUATION.sub("", unit[max(0, b - 12) : b]), PUNCTUATION.sub("", unit[e : e + 12])
        if left.strip() and right.strip():
            out.append(Place(b, thai_left(left, len(left)), thai_right(right.lstrip(), 0), "thai", None))
    return sorted(out, key=lambda p: p.end)


def thai_left(unit: str, b: int) -> str:
    k = b
    while k and unit[k - 1].isdigit():
        k -= 1
    if k < b:
        return "alone" if k == 0 or unit[k - 1].isspace() else unit[max(0, k - 2) : k] + "0"
    return unit[max(0, b - 3) : b]


def thai_right(unit: str, e: int) -> str:
    return "0" if unit[e].isdigit() else unit[e : e + 3]


def gap(before: int, end: int) -> int:
    """The class of the distance between two places."""
    return sum(end - before >= g for g in GAPS)


class Chain:
    """Counts of two tags: naive emissions of left and right, and transitions by distance, fitted by EM."""

    def __init__(self, smooth: float = 0.5):
        self.smooth = smooth
        self.left = [Counter(), Counter()]
        self.right = [Counter(), Counter()]
        self.steps = [[[1.0, 1.0], [1.0, 1.0]] for _ in range(len(GAPS) + 1)]

    def add(self, p: Place, tag: int, weight: float, starters: set[str], only_right: bool = False) -> None:
        """``only_right``: what ends a sentence is learned from unit ends alone, so that an abbreviation never seen there stays inside."""
        if not only_right:
            self.left[tag][p.left] += weight
        self.right[tag][p.right if p.right in starters else "~" + p.kind] += weight

    def table(self, starters: set[str]) -> Model:
        kinds = len(set(self.left[0]) | set(self.left[1])) + 1
        rights = len(set(self.right[0]) | set(self.right[1])) + 1
        s = self.smooth
        total = [sum(c.values()) for c in self.left]
        ratio = lambda c, k, n, x: math.log((c[1][x] + s) / (total[1] + s * n)) - math.log((c[0][x] + s) / (total[0] + s * n))
        left = {x: ratio(self.left, total, kinds, x) for x in set(self.left[0]) | set(self.left[1])}
        right = {x: ratio(self.right, total, rights, x) for x in set(self.right[0]) | set(self.right[1])}
        return Model(left, right, [[[n / sum(row) for n in row] for row in step] for step in self.steps], starters)


class Model:
    """Log-odds of a boundary by what stands left and right, and probabilities of a tag after another by distance."""

    def __init__(self, left: dict[str, float], right: dict[str, float], steps: list, starters: set[str]):
        self.left, self.right, self.steps, self.starters = left, right, steps, starters
        self.logs = [[[math.log(x) for x in row] for row in step] for step in steps]

    def odds(self, p: Place) -> float:
        right = p.right if p.right in self.starters else "~" + p.kind
        left = self.left.get(p.left)
        if left is None:
            left = 0.0
        return left + self.right.get(right, 0.0)

    def tag(self, places: list[Place]) -> list[int]:
        """Viterbi from the unit's begin, which counts as a boundary."""
        score, back = [-1e9, 0.0], []
        before = 0
        for p in places:
            emit = [0.0, self.odds(p)] if p.fixed is None else [0.0, 1e6] if p.fixed else [0.0, -1e6]
            step = self.logs[gap(before, p.end)]
            to0 = max((score[0] + step[0][0], 0), (score[1] + step[1][0], 1))
            to1 = max((score[0] + step[0][1], 0), (score[1] + step[1][1], 1))
            back.append((to0[1], to1[1]))
            score = [to0[0] + emit[0], to1[0] + emit[1]]
            before = p.end
        at = int(score[1] > score[0])
        tags = []
        for b in reversed(back):
            tags.append(at)
            at = b[at]
        return tags[::-1]

    def posteriors(self, places: list[Place]) -> tuple[list[float], list[tuple[int, list[list[float]]]]]:
        """Forward-backward: of each place the probability of a boundary, and of each step its distance and the probabilities of tag pairs."""
        emits, gaps, forward = [], [], [[0.0, 1.0]]
        before = 0
        for p in places:
            emits.append((1.0, math.exp(max(-30.0, min(30.0, self.odds(p))))) if p.fixed is None else (0.0, 1.0) if p.fixed else (1.0, 0.0))
            gaps.append(gap(before, p.end))
            before = p.end
            step, f = self.steps[gaps[-1]], forward[-1]
            now = [(f[0] * step[0][t] + f[1] * step[1][t]) * emits[-1][t] for t in (0, 1)]
            forward.append([x / sum(now) for x in now])
        after, tags, pairs = [1.0, 1.0], [], []
        for k in range(len(places) - 1, -1, -1):
            step = self.steps[gaps[k]]
            tags.append(forward[k + 1][1] * after[1] / (forward[k + 1][0] * after[0] + forward[k + 1][1] * after[1]))
            pair = [[forward[k][a] * step[a][b] * emits[k][b] * after[b] for b in (0, 1)] for a in (0, 1)]
            total = sum(map(sum, pair))
            pairs.append((gaps[k], [[x / total for x in row] for row in pair]))
            after = [sum(step[a][b] * emits[k][b] * after[b] for b in (0, 1)) for a in (0, 1)]
            after = [x / sum(after) for x in after]
        return tags[::-1], pairs[::-1]


def _unpunctuated(text: str) -> bool:
    return len(THAI.findall(text)) * 2 > len(text.strip())


def train(texts: list[str], rounds: int = 6) -> tuple[Model, Model]:
    """The models of punctuated and of unpunctuated text, by EM from unit ends."""
    chains: tuple[list[list[Place]], list[list[Place]]] = ([], [])
    first: Counter = Counter()
    for t in texts:
        units = [t[b:e].strip() for b, e in units_of(t)]
        for u, nxt in zip_longest(units, units[1:]):
            bare, end = _unpunctuated(u), []
            if bare:
                u = PUNCTUATION.sub("", u).strip()
                nxt = PUNCTUATION.sub("", nxt).strip() if nxt and _unpunctuated(nxt) else None
                if not u:
                    continue
                first[thai_right(u, 0)] += 1
                if nxt and " " in u and (" " in nxt or len(nxt) > 12):
                    end = [Place(len(u), thai_left(u, len(u)), thai_right(nxt, 0), "thai", 1)]
            else:
                word, kind = right_of(u, 0)
                if kind in ("upper", "letter") and len(u.split()) > 3:
                    first[word] += 1
                m = re.search(rf"[{FINAL}]+$", u)
                if m and nxt:
                    word, kind = right_of(nxt, 0)
                    end = [Place(len(u), left_of(u, m.start()) + m[0][-1], word, kind, 1)]
            places = (thai_places(u) if bare else places_of(u)) + end
            if places:
                chains[bare].append(places)
    starters = {w for w, n in first.items() if n >= 5}
    models = []
    for at in (0, 1):
        model = Model({}, {}, [[[0.5, 0.5], [0.5, 0.5]]] * (len(GAPS) + 1), starters)
        for _ in range(rounds):
            chain = Chain()
            for places in chains[at]:
                tags, pairs = model.posteriors(places)
                for p, g in zip(places, tags, strict=True):
                    if p.fixed is not None:
                        chain.add(p, p.fixed, 1.0, starters)
                        continue
                    chain.add(p, 1, g, starters, only_right=True)
                    chain.add(p, 0, 1 - g, starters)
                for k, pair in pairs:
                    for a in (0, 1):
                        for b in (0, 1):
                            chain.steps[k][a][b] += pair[a][b]
            model = chain.table(starters)
        models.append(model)
    return models[0], models[1]


def split(text: str, models: tuple[Model, Model]) -> list[tuple[int, int]]:
    """(start, end) of each sentence of the text."""
    if not text or not text.strip():
        return []
    out = []
    for b, e in units_of(text):
        unit = text[b:e]
        bare = _unpunctuated(unit)
        places = thai_places(unit) if bare else places_of(unit)
        begin = 0
        for p, tag in zip(places, models[bare].tag(places) if places else (), strict=True):
            if tag:
                out.append(_trim(text, b + begin, b + p.end))
                begin = p.end
        out.append(_trim(text, b + begin, e))
    return [(b, e) for b, e in out if b < e]


def _split(models: tuple[Model, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows, starts, ends = [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    for s, e in split(t, models):
                        rows.append(i)
                        starts.append(s)
                        ends.append(e)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                    ["doc_id", "start_char", "end_char"],
                )

    return run


def sentences(docs: DataFrame, most_docs: int = 6_000) -> DataFrame:
    """``(doc_id, start_char, end_char)`` of each sentence."""
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    sample = [r.text for r in bounded(texts, "doc_id", most_docs, docs.count()).select("text").collect()]
    return texts.mapInArrow(_split(train(sample)), "doc_id long, start_char long, end_char long")
