"""The three pipelines as functions of DataFrames: extraction, training, alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions.detect import detect
from paraloom.operators import classify, corpus, docvec, domains, knn, rows, scoring
from paraloom.operators.hot_keys import domain_profile
from paraloom.session import cut
from paraloom.sources import warc


@dataclass(frozen=True)
class Extraction:
    languages: tuple[str, ...] = ("en", "cs")
    confidence: float = 0.99
    text_length: int = 100
    text_count: int = 1
    ratio: float = 0.01

    def __post_init__(self):
        if not 0 <= self.confidence <= 1 or self.text_length < 0 or self.text_count < 0 or len(self.languages) < 2:
            raise ValueError("confidence lies in 0 to 1, lengths and counts aren't negative, and two languages are needed")


def extract(records: DataFrame, samples: DataFrame, config: Extraction = Extraction()) -> DataFrame:
    """Web text of crawl records: ``(domain, language, confidence, uri, text)``; pages are parsed once for all later steps."""
    found = detect(warc.page_paragraphs(warc.latest(records), config.text_length), "text", samples)
    top = F.try_element_at("languages", F.lit(1))
    return found.select(F.col("host").alias("domain"), top["language"].alias("language"), top["confidence"].alias("confidence"), "uri", "text").filter(
        F.col("language").isin(*config.languages) & (F.col("confidence") >= config.confidence)
    )


def select(web: DataFrame, config: Extraction = Extraction()) -> DataFrame:
    """The distinct texts of balanced bilingual domains."""
    a, b = config.languages[:2]
    profile = domain_profile(web, config.languages)
    chosen = domains.balanced(domains.bilingual_domains(profile, a, b, config.text_count), a, b, config.ratio)
    return domains.distinct_texts(domains.in_domains(web, chosen))


@dataclass(frozen=True)
class Training:
    head_percent: int = 50
    head_tokens: int = 50
    tail_tokens: int = 10_000
    dice: float = 0.1


def train(pairs: DataFrame, config: Training = Training()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(head, tail, dictionary) of a training corpus."""
    order = [F.col(c) for c in corpus.PAIR_ORDER]
    numbered = rows.number_rows(pairs, order)
    parts = rows.head_tail(numbered, numbered.count(), config.head_percent)
    head = cut(corpus.clean(parts.filter("part = 'head'"), 1, config.head_tokens))
    tail = corpus.clean(parts.filter("part = 'tail'"), 1, config.tail_tokens)
    return head, tail, cut(corpus.dice(head, config.dice))


@dataclass(frozen=True)
class Alignment:
    k: int = 20
    mean: float = 1.08
    std: float = 0.28
    confidence: float = 0.5
    dims: int = 64


def candidates(src: DataFrame, trg: DataFrame, src_vec: DataFrame, trg_vec: DataFrame, config: Alignment = Alignment()) -> DataFrame:
    """Top-k candidates of each source document within its bin."""
    return knn.blocked(docvec.doc_vectors(src, src_vec, config.dims), docvec.doc_vectors(trg, trg_vec, config.dims), config.k)


def fit(cands: DataFrame, src: DataFrame, trg: DataFrame, dictionary: DataFrame, config: Alignment = Alignment()) -> PipelineModel:
    """A classifier trained on rescored candidates of documents whose pairs share their id."""
    scored = cut(scoring.rescore(cands, src, trg, dictionary, config.mean, config.std))
    by_log = scored.select("bin", "src_doc_id", "trg_doc_id", F.col("log_score").alias("score"))
    ranks = scoring.correct_rank(by_log, trg)
    feats = scoring.features(scoring.with_texts(scoring.top_one(by_log), src, trg), dictionary, config.mean, config.std)
    return classify.fit_mlp(cut(classify.balance(classify.training_rows(feats, ranks))))


def align(cands: DataFrame, src: DataFrame, trg: DataFrame, dictionary: DataFrame, model: PipelineModel, config: Alignment = Alignment()) -> DataFrame:
    """``(bin, src_doc_id, trg_doc_id, score)``: the best candidate of each source where the classifier is confident."""
    scored = scoring.rescore(cands, src, trg, dictionary, config.mean, config.std)
    best = scoring.top_one(scored.select("bin", "src_doc_id", "trg_doc_id", F.col("log_score").alias("score")))
    feats = scoring.features(scoring.with_texts(best, src, trg), dictionary, config.mean, config.std)
    return classify.apply(model, feats, config.confidence)
