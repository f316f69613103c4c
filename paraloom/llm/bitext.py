"""Sentence alignment of document pairs through shared paired-document concepts.

A concept is the paired document of all training pairs whose target side holds one word.  A source word
is represented by its similarities to the concepts: the cosine between the set of training pairs
that hold the word and the concept's set.  It keeps its ``TOP`` nearest concepts; a target word is
represented by its own concept alone.  So a sentence is a sparse vector of some twenty weights, and numbers and name stems are
concepts of their own.  Sentences of a document pair meet in a sparse cosine join on
(document, concept).  A pair of sentences is taken if each is the other's best; where two adjacent
sentences together match one better than either alone, the merged window is taken; a sentence
that holds more than its partner, as far as names and numbers show, may be the best of several.
Sentences of one pattern about other things are told apart by the names and numbers they share.
Lines follow from their sentences, so joined, moved, added and left-out lines need no extra care.

Training is one aggregation over all training pairs.  The concept table is sent to the workers and holds at most ``most_words`` words
a side, the most frequent; rarer words are represented by themselves.

Lines that have a frame of furniture, by ``main_body`` over all pages, are left out.

Cases: candidate pairs given twice count once; null ids, null or empty texts and furniture lines
give no rows; ties go to the nearer position, then the earlier sentence; documents may be in many
pairs; a document paired with itself gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.llm import main_body
from paraloom.session import cut

TOP, LEAST_COSINE, LEAST_COUNT = 3, 0.08, 3
NAME_WEIGHT, NUMBER_WEIGHT, NAME_STEM = 5.0, 5.0, 5
#: A capitalised word below this weight, too common for a name, begins a sentence that was joined to the one before by a conjunction.
COMMON, LEAST_WORDS = 5.0, 4
ACCEPT, PLAIN_ACCEPT, MERGED, MERGE_PART, MERGE_GAIN = 0.45, 0.75, 0.6, 0.3, 0.08
#: Of the names and numbers of the sentence with fewer, the share to be found in the other; above WHOLE of the one with more it is no part.
SHARED, WHOLE = 0.6, 0.75
CUT = re.compile(r"(?<=[.?!…;])[\"”“»’)]*\s+|\s+[–—|/]\s+|(?<=[a-zà-ž][.?!])(?=[A-ZÀ-Ž])")
TOKEN = re.compile(r"\d+(?:[ \xa0.,]?\d+)*|[^\W\d_]+")
#: The word class of the SQL side, the same as in TOKEN.
WORDS = r"[\p{L}\p{M}]+"


def word_sets(text) -> F.Column:
    """Distinct lower-case words of a sentence column, sorted: numbers and their order don't matter."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)))


def concept_table(corpus: DataFrame) -> DataFrame:
    """``(side, word, concept, weight)``: the nearest concepts of each word of the source (0) and target (1) side."""
    sets = corpus.filter("src_text IS NOT NULL AND trg_text IS NOT NULL").select(
        word_sets(F.col("src_text")).alias("src"), word_sets(F.col("trg_text")).alias("trg")
    ).filter("size(src) > 0 AND size(trg) > 0 AND src != trg")
    src_df = sets.select(F.explode("src").alias("word")).groupBy("word").count().filter(F.col("count") >= LEAST_COUNT)
    trg_df = sets.select(F.explode("trg").alias("word")).groupBy("word").count().filter(F.col("count") >= LEAST_COUNT)
    s = sets.select(F.explode("src").alias("s"), "trg").select("s", F.explode("trg").alias("t")).groupBy("s", "t").agg(F.count(F.lit(1)).alias("both"))
    joined = (
        s.filter(F.col("both") >= LEAST_COUNT)
        .join(src_df.select(F.col("word").alias("s"), F.col("count").alias("n_s")), "s")
        .join(trg_df.select(F.col("word").alias("t"), F.col("count").alias("n_t")), "t")
        .withColumn("cosine", F.col("both") / F.sqrt(F.col("n_s") * F.col("n_t")))
        .filter(F.col("cosine") >= LEAST_COSINE)
    )
    order = Window.partitionBy("s").orderBy(F.desc("cosine"), "t")
    nearest = joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    total = sets.agg(F.count(F.lit(1)).alias("n"))
    idf = trg_df.join(F.broadcast(total)).select(F.col("word").alias("concept"), F.log((F.col("n") + 1) / F.col("count")).alias("idf"), F.col("count").alias("df"))
    of_src = nearest.join(idf, F.col("t") == F.col("concept")).select(
        F.lit(0).alias("side"), F.col("s").alias("word"), "concept", (F.col("idf") * F.col("cosine")).alias("weight"), F.col("n_s").alias("df")
    )
    of_trg = idf.select(F.lit(1).alias("side"), F.col("concept").alias("word"), "concept", F.col("idf").alias("weight"), "df")
    return of_src.unionByName(of_trg)


def load_table(concepts: DataFrame, most_words: int) -> tuple[dict, dict]:
    """word -> ((concept, weight), ...) of both sides, for the ``most_words`` most frequent words a side."""
    order = Window.partitionBy("side").orderBy(F.desc("df"), "word", "concept")
    rows = concepts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_words * TOP).collect()
    sides: tuple[dict, dict] = ({}, {})
    for r in rows:
        sides[r.side].setdefault(r.word, []).append((r.concept, r.weight))
    for side in sides:
        for w, got in side.items():
            # a word's own weight is that of its concepts, shared among them
            scale = sum(x for _, x in got)
            top = max(x for _, x in got)
            side[w] = tuple((c, top * x / scale * math.sqrt(len(got))) for c, x in got)
    return sides


def vector(segment: str, words: dict) -> dict[str, float]:
    out: dict[str, float] = {}
    for k, t in enumerate(TOKEN.findall(segment)):
        if t[0].isdigit():
            key = "0" + "".join(c for c in t if c.isdigit())
            out[key] = NUMBER_WEIGHT
            continue
        low = t.lower()
        known = words.get(low)
        if known and (k == 0 or not t[0].isupper() or t.isupper()):
            for c, w in known:
                out[c] = out.get(c, 0.0) + w
        elif t[0].isupper() and len(t) >= NAME_STEM:
            out["^" + low[:NAME_STEM]] = NAME_WEIGHT
    return out


def parts_of(line: str, words: dict) -> Iterator[str]:
    """The sentences of a line: at marks and dashes, and where a common word has a capital after a lower-case word."""
    for part in CUT.split(line):
        begin = at = 0
        for n, m in enumerate(TOKEN.finditer(part or "")):
            w = m[0]
            if n - at >= LEAST_WORDS and w[0].isupper() and (w[1:].islower() or len(w) == 1) and m.start() > 1 and part[m.start() - 1] == " " and part[m.start() - 2].islower():
                known = words.get(w.lower())
                if known and max(x for _, x in known) < COMMON:
                    yield part[begin : m.start()]
                    begin, at = m.start(), n
        if part:
            yield part[begin:]


SEGMENT = "doc_id long, seg int, line_no int, norm double, named int, keys array<string>, weights array<double>"


def _segments(words: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, seg, line_no, norms, named, keys, weights = [], [], [], [], [], [], []
            for i, (text, drop) in enumerate(zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True)):
                n, drop = 0, set(drop or ())
                for no, line in enumerate(text.split("\n")):
                    if not line.strip() or no in drop:
                        continue
                    for part in parts_of(line, words):
                        v = vector(part, words)
                        if len(v) < 2:
                            continue
                        norm = math.sqrt(sum(w * w for w in v.values()))
                        doc.append(i)
                        seg.append(n)
                        line_no.append(no)
                        norms.append(norm)
                        named.append(sum(k[0] in "^0" for k in v))
                        keys.append(list(v))
                        weights.append([w / norm for w in v.values()])
                        n += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(seg, pa.int32()), pa.array(line_no, pa.int32()), pa.array(norms, pa.float64()), pa.array(named, pa.int32()), pa.array(keys, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))],
                ["doc_id", "seg", "line_no", "norm", "named", "keys", "weights"],
            )

    return run


def _of(docs: DataFrame, ids: DataFrame, most_broadcast: int) -> DataFrame:
    """The documents in ``ids``."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "doc_id", "left_semi")


def packed(segments: DataFrame) -> DataFrame:
    """``(doc_id, place, mass, concept, w)`` of each sentence and concept, narrow as it is shuffled twice.

    ``place`` holds the sentence's and the line's number, ``mass`` the number of names and
    numbers and the norm in sixteenths; the last bit of ``concept`` tells names and numbers.
    """
    place = F.shiftleft(F.col("seg").cast("long"), 32).bitwiseOR(F.col("line_no").cast("long"))
    norm = F.least(F.lit(65535), F.round(F.col("norm") * 16)).cast("int")
    mass = F.shiftleft(F.least(F.lit(32767), F.col("named")), 16).bitwiseOR(norm)
    concept = lambda k: F.xxhash64(k).bitwiseAND(-2).bitwiseOR(k.rlike("^[\\^0]").cast("long"))
    each = F.arrays_zip(F.transform("keys", concept).alias("k"), F.transform("weights", lambda w: w.cast("float")).alias("w"))
    return segments.select("doc_id", place.alias("place"), mass.alias("mass"), F.explode(each).alias("e")).select("doc_id", "place", "mass", F.col("e.k").alias("concept"), "e.w")


def unpacked(side: str) -> F.Column:
    place, mass = F.col(f"{side}_place"), F.col(f"{side}_mass")
    return F.struct(
        F.shiftright(place, 32).cast("int").alias("seg"), place.bitwiseAND(0xFFFFFFFF).cast("int").alias("line"),
        (mass.bitwiseAND(65535) / 16).alias("norm"), F.shiftright(mass, 16).alias("named"),
    )


def aligned(web: DataFrame, pairs: DataFrame, corpus: DataFrame, most_words: int = 200_000, most_broadcast: int = 2_000_000) -> DataFrame:
    """``(row_id_a, line_a, row_id_b, line_b, score)`` of the lines that translate each other, ``row_id_a < row_id_b``."""
    src_words, trg_words = load_table(concept_table(corpus), most_words)
    pairs = pairs.filter("src_doc_id != trg_doc_id").select(F.col("src_doc_id").alias("src"), F.col("trg_doc_id").alias("trg")).distinct()
    pairs = cut(pairs)
    source, target = pairs.select(F.col("src").alias("doc_id")), pairs.select(F.col("trg").alias("doc_id"))
    docs = web.filter("text IS NOT NULL").select(F.col("row_id").alias("doc_id"), "text")
    of_pairs = source.unionByName(target).distinct().withColumnRenamed("doc_id", "row_id")
    of_pairs = F.broadcast(of_pairs) if of_pairs.count() <= most_broadcast else of_pairs
    drop = cut(main_body.furniture_by_frames(web, of_pairs).groupBy(F.col("row_id").alias("doc_id")).agg(F.collect_set("line_no").alias("drop")))
    drop = F.broadcast(drop) if drop.count() <= most_broadcast // 10 else drop
    s = _of(docs, source, most_broadcast).join(drop, "doc_id", "left").mapInArrow(_segments(src_words), SEGMENT)
    t = _of(docs, target, most_broadcast).join(drop, "doc_id", "left").mapInArrow(_segments(trg_words), SEGMENT)
    sx = packed(s).select(F.col("doc_id").alias("src"), F.col("place").alias("s_place"), F.col("mass").alias("s_mass"), "concept", F.col("w").alias("ws"))
    tx = packed(t).select(F.col("doc_id").alias("trg"), F.col("place").alias("t_place"), F.col("mass").alias("t_mass"), "concept", F.col("w").alias("wt"))
    dots = (
        pairs.join(sx, "src").join(tx, ["trg", "concept"])
        .groupBy("src", "trg", "s_place", "s_mass", "t_place", "t_mass")
        .agg(F.sum(F.col("ws") * F.col("wt").cast("double")).alias("cosine"), F.sum(F.col("concept").bitwiseAND(1)).alias("shared"))
        .filter(F.col("cosine") >= MERGE_PART)
        .select("src", "trg", unpacked("s").alias("s"), unpacked("t").alias("t"), "cosine", "shared")
    )
    return expand(dots)


def agreeing(s_named: F.Column, t_named: F.Column, shared: F.Column, cosine: F.Column) -> F.Column:
    """Whether two sentences, or a window and a sentence, are about the same things, by their names and numbers."""
    fewer = F.least(s_named, t_named)
    return F.when(fewer > 0, shared >= SHARED * fewer).otherwise(cosine >= PLAIN_ACCEPT)


def expand(dots: DataFrame) -> DataFrame:
    """Mutual best sentences and merged windows, as lines."""
    far = F.abs(F.col("s.seg") - F.col("t.seg"))
    # pairs that don't agree are kept as parts of windows, behind all that do
    by_s = Window.partitionBy("src", "trg", "s").orderBy(F.desc("agree"), F.desc("cosine"), far, "t.seg")
    by_t = Window.partitionBy("src", "trg", "t").orderBy(F.desc("agree"), F.desc("cosine"), far, "s.seg")
    dots = dots.withColumn("agree", agreeing(F.col("s.named"), F.col("t.named"), F.col("shared"), F.col("cosine")))
    ranked = dots.withColumn("of_s", F.row_number().over(by_s)).withColumn("of_t", F.row_number().over(by_t))
    # two adjacent sentences against one: their joint cosine from the parts, which share few concepts
    next_s = Window.partitionBy("src", "trg", "t").orderBy("s.seg")
    next_t = Window.partitionBy("src", "trg", "s").orderBy("t.seg")

    def joint(side: str, w: Window) -> F.Column:
        other, d = F.lead(side).over(w), F.lead("cosine").over(w)
        joined = (F.col(f"{side}.norm") * F.col("cosine") + other["norm"] * d) / F.sqrt(F.pow(F.col(f"{side}.norm"), 2) + F.pow(other["norm"], 2))
        whole = "t" if side == "s" else "s"
        # a part that doesn't agree by itself must have its best here; the window's names are those of both parts
        fits = F.lead("agree").over(w) | (F.lead(f"of_{side}").over(w) == 1)
        agree = agreeing(F.col(f"{side}.named") + other["named"], F.col(f"{whole}.named"), F.col("shared") + F.lead("shared").over(w), joined)
        good = fits & agree & (other["seg"] == F.col(f"{side}.seg") + 1) & (joined >= MERGED) & (joined >= F.greatest("cosine", d) + MERGE_GAIN)
        return F.when(good, F.struct(other["line"].alias("line"), joined.alias("score")))

    both = ranked.withColumn("more_s", joint("s", next_s)).withColumn("more_t", joint("t", next_t))
    part = F.col("shared") < WHOLE * F.greatest("s.named", "t.named")
    rows = both.select("src", "trg", F.explode(F.filter(F.array(
        F.when(F.col("agree") & ((F.col("of_s") == 1) & (F.col("of_t") == 1) | part & ((F.col("of_s") == 1) | (F.col("of_t") == 1))) & (F.col("cosine") >= ACCEPT), F.struct(F.col("s.line").alias("ls"), F.col("t.line").alias("lt"), F.col("cosine").alias("score"))),
        # the window's first line where its sentence's best is this one, and its second line
        F.when((F.col("of_s") == 1) & F.col("more_s").isNotNull(), F.struct(F.col("s.line").alias("ls"), F.col("t.line").alias("lt"), F.col("more_s.score").alias("score"))),
        F.when((F.col("of_s") == 1) & F.col("more_s").isNotNull(), F.struct(F.col("more_s.line").alias("ls"), F.col("t.line").alias("lt"), F.col("more_s.score").alias("score"))),
        F.when((F.col("of_t") == 1) & F.col("more_t").isNotNull(), F.struct(F.col("s.line").alias("ls"), F.col("t.line").alias("lt"), F.col("more_t.score").alias("score"))),
        F.when((F.col("of_t") == 1) & F.col("more_t").isNotNull(), F.struct(F.col("s.line").alias("ls"), F.col("more_t.line").alias("lt"), F.col("more_t.score").alias("score"))),
    ), lambda x: x.isNotNull())).alias("x"))
    first = F.col("src") < F.col("trg")
    either = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return rows.select(
        either("src", "trg").alias("row_id_a"), either("x.ls", "x.lt").cast("long").alias("line_a"),
        either("trg", "src").alias("row_id_b"), either("x.lt", "x.ls").cast("long").alias("line_b"), F.col("x.score").alias("score"),
    ).groupBy("row_id_a", "line_a", "row_id_b", "line_b").agg(F.max("score").alias("score"))
