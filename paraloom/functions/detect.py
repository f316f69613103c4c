"""Language detection for the paragraph filter: naive Bayes over letter trigrams.

Scores are sums of log probabilities with half a count of smoothing, over the trigrams that any
labelled sentence has; the result lists languages of probability 0.1 or more, the likeliest
first.  Texts without a known trigram, null and empty texts get no language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 0.5


def letters(text: Column) -> Column:
    """Lower case, with runs of other characters than letters as one space, and a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(s: str) -> list[str]:
    return [s[i : i + 3] for i in range(len(s) - 2)]


def fit(samples: list[tuple[str, str]]) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Languages, trigram numbers and the matrix of log probabilities, of (language, prepared text)."""
    counts: dict[str, Counter] = {}
    for lang, s in samples:
        counts.setdefault(lang, Counter()).update(trigrams(s))
    langs = sorted(counts)
    grams = sorted({g for c in counts.values() for g in c})
    logp = np.array([[np.log((counts[x][g] + SMOOTH) / (sum(counts[x].values()) + SMOOTH * len(grams))) for x in langs] for g in grams])
    return langs, {g: i for i, g in enumerate(grams)}, logp.reshape(len(grams), len(langs))


def _detect(langs: list[str], ids: dict[str, int], logp: np.ndarray):
    kind = pa.list_(pa.struct([("language", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = [], []
            for s in b.column("letters").to_pylist():
                got = [k for g in trigrams(s or "") if (k := ids.get(g)) is not None]
                flat += got
                sizes.append(len(got))
            total = np.zeros((len(flat) + 1, len(langs)))
            if flat:
                np.cumsum(logp[flat], axis=0, out=total[1:])
            ends = np.cumsum(sizes)
            score = total[ends] - total[ends - sizes] if len(sizes) else total[:0]
            p = np.exp(score - score.max(axis=1, keepdims=True)) if len(sizes) else score
            p = p / p.sum(axis=1, keepdims=True) if len(sizes) else p
            out = [
                [{"language": langs[j], "confidence": float(p[i, j])} for j in np.argsort(-p[i], kind="stable") if p[i, j] >= 0.1] if n else []
                for i, n in enumerate(sizes)
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "letters"), pa.array(out, kind)], [*(c for c in b.schema.names if c != "letters"), "languages"])

    return run


def detect(df: DataFrame, text: str, samples: DataFrame, most_samples: int = 20_000) -> DataFrame:
    """``df`` with ``languages``, an array of (language, confidence); fitted on at most ``most_samples`` sentences."""
    known = samples.filter("language IS NOT NULL AND text IS NOT NULL").orderBy("sample_id").limit(most_samples)
    model = fit([tuple(r) for r in known.select("language", letters(F.col("text"))).collect()])
    base = df.drop("languages", "letters")
    kinds = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", languages array<struct<language:string,confidence:double>>"
    return base.withColumn("letters", letters(F.col(text))).mapInArrow(_detect(*model), kinds)
