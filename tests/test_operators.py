import gzip
import io
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paraloom.functions import detect
from paraloom.functions import text as T
from paraloom.functions import vectors as V
from paraloom.operators import classify, clusters, corpus, crawl, docvec, domains, embeddings, evaluate, hot_keys, knn, links, rows, scoring
from paraloom.sources import tsv, warc
from paraloom.streaming import late


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_supervised_bins_and_split(spark):
    df = frame(spark, [(x,) for x in "ebdac"], "k string")
    n = rows.number_rows(df, [F.col("k")])
    got = {r.k: (r.bin, r.doc_id, r.part) for r in rows.head_tail(rows.bins(n, 2), 5, 50).collect()}
    assert got == {"a": ("00000000", 0, "head"), "b": ("00000000", 1, "head"), "c": ("00000001", 2, "tail"), "d": ("00000001", 3, "tail"), "e": ("00000002", 4, "tail")}
    assert rows.number_rows(df.filter("false"), [F.col("k")]).count() == 0


def test_balance(spark):
    info = frame(spark, [("a", 37, 39), ("b", 500, 5), ("c", 499, 5), ("d", 0, 0), ("e", None, 5)], "domain string, text_length_en long, text_length_cs long")
    assert {r.domain for r in domains.balanced(info).collect()} == {"a", "c"}


def test_clean(spark):
    pairs = frame(spark, [("1", 1.0, "12 _ .", "a"), ("2", 1.0, "a1", "b"), ("3", None, None, "b"), ("4", 1.0, "a " * 60, "b"), ("5", 1.0, "a", "  ")], "id string, probab double, src_text string, trg_text string")
    assert [r.id for r in corpus.clean(pairs).collect()] == ["2"]
    assert {r.reason: r.n for r in corpus.rejections(pairs).collect()} == {"kept": 1, "src_no_letter": 1, "min_tokens": 2, "max_tokens": 1}


def test_dice(spark):
    pairs = frame(spark, [("a b", "x"), ("a", "x y")], "src_text string, trg_text string")
    got = {(r.src_word, r.trg_word): r.weight for r in corpus.dice(pairs, 0.1).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): pytest.approx(2 / 3), ("b", "x"): pytest.approx(2 / 3)}


def test_harmonic_merge(spark):
    f, r = frame(spark, [("s", "t", 0.5), ("s", "u", 1.0)], "w1 string, w2 string, p double"), frame(spark, [("t", "s", 0.25), ("v", "s", 1.0)], "w1 string, w2 string, p double")
    assert [(x.src_word, x.trg_word, round(x.weight, 6)) for x in corpus.merge_params(f, r).collect()] == [("s", "t", 0.333333)]


def test_phrases_never_chain(spark):
    words = F.array(*map(F.lit, ["new", "york", "times"]))
    known = F.create_map(F.lit("new york"), F.lit(1), F.lit("york times"), F.lit(1))
    assert spark.range(1).select(corpus.merge_phrases(words, known).alias("w")).first().w == ["new_york", "times"]


def test_ibm1_prefers_cooccurring(spark):
    pairs = frame(spark, [("dům", "house"), ("velký dům", "big house"), ("velký pes", "big dog")] * 3, "src_text string, trg_text string")
    p = {(r.src_word, r.trg_word): r.p for r in corpus.ibm1(pairs, 8).collect()}
    assert p["dům", "house"] > 0.6 and p["velký", "big"] > 0.6
    for word in ("dům", "velký"):
        assert sum(v for (s, _), v in p.items() if s == word) == pytest.approx(1, abs=1e-3)


def _ibm1_by_hand(pairs, rounds, prune):
    p = {}
    for k in range(rounds):
        counts = Counter()
        for s, t in pairs:
            for y in set(t.split()):
                w = {x: p.get((x, y), 0.0) if k else 1.0 for x in {"<null>", *s.split()}}
                for x in w:
                    counts[x, y] += w[x] / sum(w.values()) if sum(w.values()) else 0
        totals = Counter()
        for (x, _), c in counts.items():
            totals[x] += c
        p = {(x, y): c / totals[x] for (x, y), c in counts.items() if c and c / totals[x] >= prune}
    return p


@pytest.mark.parametrize("rounds, prune", [(1, 0.0), (4, 1e-7), (4, 0.05)])
def test_ibm1_over_buckets(spark, rounds, prune):
    rng = random.Random(3)
    line = lambda c, n: " ".join(f"{c}{rng.randrange(12)}" for _ in range(rng.randrange(n)))
    pairs = [(line("a", 8), line("b", 7)) for _ in range(120)]
    pairs += pairs[:30]
    got = corpus.ibm1(frame(spark, [*pairs, (None, "b1"), ("a1", None)], "src_text string, trg_text string"), rounds, prune, per_bucket=100)
    assert {(r.src_word, r.trg_word): r.p for r in got.collect()} == pytest.approx(_ibm1_by_hand(pairs, rounds, prune))
    assert corpus.ibm1(frame(spark, pairs[:0], "src_text string, trg_text string"), rounds, prune).count() == 0


def _shuffled(spark, f):
    """Rows that the stages of ``f`` write to shuffles."""
    sc = spark.sparkContext

    def upto():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = upto()
    f()
    return sum(n for k, n in upto().items() if k not in before)


def test_ibm1_rounds_shuffle_no_links(spark):
    words = [f"a{k}" for k in range(30)]
    pairs = frame(spark, [(" ".join(words[k:] + words[:k]), " ".join(words[:k + 1])) for k in range(30)], "src_text string, trg_text string")
    one, three = (_shuffled(spark, lambda n=n: corpus.ibm1(pairs, n).count()) for n in (1, 3))
    # 30 units hold 14,415 links; a round sums 31 totals of a bucket
    assert three - one < 14_415


def test_doc_vectors(spark):
    docs = frame(spark, [("x", 0, "a a b"), ("x", 1, "b"), ("x", 2, "b"), ("x", 3, "zzz"), ("x", 4, None)], "bin string, doc_id long, text string")
    wv = frame(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    got = {r.doc_id: r.vec for r in docvec.doc_vectors(docs.filter("doc_id < 3"), wv, 2).collect()}
    assert got[0] == pytest.approx([2 * math.log10(2), 0]) and got[1] == pytest.approx([0, 0]) and set(got) == {0, 1}
    assert {r.doc_id for r in docvec.doc_vectors(docs, wv, 2).collect()} == {0, 1}


def test_similarities(spark):
    one = spark.range(1).select(*[V.angular(F.lit(c)).alias(n) for c, n in ((1.0, "a"), (0.0, "b"), (-1.0, "c"))], V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert (one.a, one.c, one.z) == (1.0, 0.0, 0.0) and one.b == pytest.approx(0.2928932)


def _random_vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    return frame(spark, [("b%d" % (i % 2), i, rng.standard_normal(16).tolist()) for i in range(n)], "bin string, doc_id long, vec array<double>")


def test_knn_blocked_is_exact_and_hashing_recalls(spark):
    s, t = _random_vectors(spark, 60, 1), _random_vectors(spark, 90, 1)
    key = lambda df: {(r.bin, r.src_doc_id, r.trg_doc_id): round(r.score, 6) for r in df.collect()}
    exact = key(knn.exact(s, t, 5))
    assert key(knn.blocked(s, t, 5, block=7)) == exact and all(0 <= x <= 1 for x in exact.values())
    assert key(knn.hashed(s, t, 5, dims=16)).keys() & exact.keys()
    assert knn.blocked(s.filter("false"), t, 5).count() == 0


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_hashed_recall_on_independent_sides(spark, spread):
    # the query's own parameters; sources and targets are drawn apart, around shared centres or not
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 64)) * (spread < 1)
    rows = lambda n: frame(spark, [("b%d" % (i % 3), i, (centres[rng.integers(40)] + rng.standard_normal(64) * (0.5 if spread < 1 else 1)).tolist()) for i in range(n)], "bin string, doc_id long, vec array<double>")
    s, t = rows(300), rows(400)
    pairs = lambda df: {(r.bin, r.src_doc_id, r.trg_doc_id) for r in df.collect()}
    exact = pairs(knn.exact(s, t, 10))
    assert len(pairs(knn.hashed(s, t, 10)) & exact) >= 0.9 * len(exact)


def test_hashed_by_blocks_stores_no_pairs_and_equals_the_join(spark):
    rng = np.random.default_rng(7)
    rows = lambda n: frame(spark, [("b%d" % (i % 2), i, rng.standard_normal(16).tolist()) for i in range(n)], "bin string, doc_id long, vec array<double>")
    s, t = rows(300), rows(240)
    got = lambda **x: {(r.bin, r.src_doc_id, r.trg_doc_id, r.knn_rank): round(r.score, 9) for r in knn.hashed(s, t, 5, dims=16, bits=5, bands=8, **x).collect()}
    # blocks of one row make their copies dearer than the join
    joined, blocks = got(block=1), got(block=60)
    assert joined == blocks and joined != {(r.bin, r.src_doc_id, r.trg_doc_id, r.knn_rank): round(r.score, 9) for r in knn.exact(s, t, 5).collect()}
    # 36,000 pairs of rows, each of which 8 bands of 3 bits make one of by chance
    assert _shuffled(spark, lambda: knn.hashed(s, t, 5, dims=16, bits=3, bands=8).count()) < 36_000


def test_doc_vectors_shuffle_no_word_vectors(spark):
    docs = frame(spark, [("b", i, f"w{i} w{i % 7} x{i % 5}") for i in range(60)], "bin string, doc_id long, text string")
    wv = frame(spark, [(f"{c}{i}", [float(i + 1), -1.0]) for i in range(60) for c in "wx"], "word string, vec array<double>")
    got = [{r.doc_id: [round(x, 9) for x in r.vec] for r in docvec.doc_vectors(docs, wv, 2, most_broadcast=n).collect()} for n in (0, 1_000)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_length(spark):
    one = spark.range(1).select(T.length_likelihood(F.lit(100), F.lit(108), 1.08, 0.28).alias("a"), T.length_confidence(F.lit(100)).alias("b"), T.length_likelihood(F.lit(0), F.lit(1), 1.0, 0.5).alias("c")).first()
    assert one.a == pytest.approx(1) and one.b == pytest.approx(0.6321206) and one.c is None


def _naive_ibm1(s, t, w):
    total = 0.0
    for a in s:
        total += math.log(1e-9 + sum(w.get((a, b), 1e-9) / len(t) for b in t))
    return total


def test_ibm1_score_equals_naive_product(spark):
    rng = random.Random(3)
    words = "abcdef"
    w = {(a, b): rng.random() for a in words for b in words if rng.random() < 0.4} | {("a", "x"): 0.5}
    dictionary = frame(spark, [(a, b, v) for (a, b), v in w.items()], "src_word string, trg_word string, weight double")
    texts = [(" ".join(rng.choices(words, k=rng.randint(1, 9))), " ".join(rng.choices(words + "x", k=rng.randint(1, 9)))) for _ in range(40)] + [("a", "x y"), ("q q", "z")]
    pairs = frame(spark, [("b", i, i, s, t) for i, (s, t) in enumerate(texts)], "bin string, src_doc_id long, trg_doc_id long, src_text string, trg_text string")
    got = {r.src_doc_id: r.log_score for r in scoring.log_ibm1(pairs, dictionary).collect()}
    joined = {r.src_doc_id: r.log_score for r in scoring.log_ibm1(pairs, dictionary, most_broadcast=0).collect()}
    assert joined.keys() == got.keys() and all(joined[k] == pytest.approx(got[k]) for k in got)
    for i, (s, t) in enumerate(texts):
        assert got[i] == pytest.approx(_naive_ibm1(s.split(), t.split(), w), abs=1e-9)
    assert math.exp(got[len(texts) - 2]) == pytest.approx(0.2500000015) and math.exp(got[len(texts) - 1]) == pytest.approx(4e-18)


def test_features(spark):
    pairs = frame(spark, [("b", 0, 0, "ab cde f", "x cde")], "bin string, src_doc_id long, trg_doc_id long, src_text string, trg_text string")
    d = frame(spark, [("ab", "x", 0.4), ("f", "x", 0.0)], "src_word string, trg_word string, weight double")
    r = scoring.features(pairs, d).first()
    assert tuple(scoring.features(pairs, d, most_broadcast=0).first()) == pytest.approx(tuple(r))
    assert r.weight_sim == pytest.approx(0.76) and r.weight_conf == pytest.approx(5 / 6)


def test_bench_histogram(spark):
    trg = frame(spark, [("b", i, t) for i, t in enumerate(["t0", "t1", "t2", "t3", "t1"])], "bin string, doc_id long, text string")
    cands = frame(spark, [("b", 0, 0, 0.9), ("b", 1, 4, 0.9), ("b", 2, 0, 0.9), ("b", 2, 1, 0.8), ("b", 2, 2, 0.7), ("b", 3, 0, 0.5)], "bin string, src_doc_id long, trg_doc_id long, score double")
    assert {r.mindex: r.freq for r in scoring.rank_histogram(scoring.correct_rank(cands, trg)).collect()} == {0: 2, 2: 1, None: 1}


def test_thresholds_are_strict(spark):
    cands = frame(spark, [("b", 0, 0, 0.5), ("b", 1, 0, 0.51)], "bin string, src_doc_id long, trg_doc_id long, score double")
    assert [r.src_doc_id for r in scoring.above(cands, 0.5).collect()] == [1]
    pr = scoring.precision_recall(frame(spark, [(0.5, True), (0.9, True), (0.9, False)], "confidence double, correct boolean"), [0.5, 0.95]).collect()
    assert {(r.threshold, r.n_above, r.n_correct, r.precision, r.recall) for r in pr} == {(0.5, 2, 1, 0.5, 0.5), (0.95, 0, 0, None, 0.0)}


def test_records(spark):
    src, trg = frame(spark, [("b", 1, "s")], "bin string, doc_id long, text string"), frame(spark, [("b", 1, "own"), ("b", 2, "t")], "bin string, doc_id long, text string")
    r = scoring.records(frame(spark, [("b", 1, 2, 0.25)], "bin string, src_doc_id long, trg_doc_id long, score double"), src, trg, debug=True).first()
    assert r.record == "b\t1\t2\t0.250000\ns\nt\nown\n"


def test_classifiers_learn(spark):
    rng = np.random.default_rng(1)
    data = [("b", i, i, *(float(x) for x in np.clip(rng.normal(0.8 if i % 2 else 0.2, 0.1, 4), 0, 1)), float(i % 2)) for i in range(200)]
    rows_ = frame(spark, data, "bin string, src_doc_id long, trg_doc_id long, length_sim double, length_conf double, weight_sim double, weight_conf double, label double")
    for fit in (classify.fit_mlp, classify.fit_tree):
        model = fit(rows_)
        assert classify.error_rate(model, rows_).first().error_percent < 5
        got = classify.apply(model, rows_.drop("label"), 0.5)
        assert 80 <= got.count() <= 120
    assert classify.balance(rows_, 0.2).filter("label = 1").count() < 60
    assert classify.running_ratio(rows_).filter("src_doc_id = 3").first().ratio == 0.5


def test_links(spark):
    df = frame(spark, [("0-1 1-2 x", "a b {##} c d e {##} 0-0 1-2")], "p string, t string")
    r = df.select(links.parse(F.col("p")).alias("l"), links.triple(F.col("t")).alias("t")).first()
    assert [tuple(x) for x in r.l] == [(0, 1), (1, 2)] and r.t.src_tokens == ["c", "d", "e"] and r.t.trg_tokens == ["a", "b"] and len(r.t.links) == 2
    l = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 2), (2, 5))])
    one = spark.range(1).select(links.interpolate(l, F.lit(4)).alias("x"), links.uniform(F.lit(4), F.lit(6)).alias("u"), links.union(l, l).alias("n")).first()
    assert one.x == [2, 3, 5, 5] and one.u[3] == 4 and len(one.n) == 2
    assert links.grow({(0, 0), (1, 1)}, {(0, 0), (1, 2), (2, 2)}) >= {(0, 0), (1, 1)}
    g = links.grow_diag_final_and(spark.range(1).select("id", l.alias("f"), F.lit(None).cast(links.LINKS).alias("r")), "id", "f", "r").first()
    assert [tuple(x) for x in g.links] == [(0, 2), (2, 5)]


def test_skip_pairs(spark):
    got = spark.range(1).select(links.skip_pairs(F.array(*map(F.lit, "abc")), 1).alias("p")).first().p
    assert [tuple(x) for x in got] == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_bilingual_vectors_bring_translations_together(spark):
    rng = random.Random(2)
    words = [("pes", "dog"), ("dům", "house"), ("auto", "car"), ("strom", "tree")]
    data = []
    for _ in range(400):
        a, b = rng.choice(words), rng.choice(words)
        data.append((f"{a[0]} {a[0]} {b[0]}", f"{a[1]} {a[1]} {b[1]}"))
    v = {r.word: np.array(r.in_vec) for r in embeddings.bilingual(frame(spark, data, "src_text string, trg_text string").repartition(1), 8, 1, 30, rate=0.1).collect()}
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    right = np.mean([cos(v[f"s:{a}"], v[f"t:{b}"]) for a, b in words])
    wrong = np.mean([cos(v[f"s:{a}"], v[f"t:{d}"]) for a, _ in words for c, d in words if a != c])
    assert right > wrong + 0.2


def _texts(spark, n, parts):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(7)))
    return frame(spark, [(line(), line()) for _ in range(n)], "src_text string, trg_text string").repartition(parts)


def test_bilingual_pairs_made_by_workers_are_the_training_pairs(spark):
    corpus = _texts(spark, 60, 1)
    words = [f"w{k}" for k in range(28)]
    ids = {f"{side}:{w}": k + at for side, at in (("s", 0), ("t", 28)) for k, w in enumerate(words)}
    for window in (1, 3):
        want = [(r.word, r.context) for r in embeddings.training_pairs(corpus, window).collect()]
        b = corpus.select(T.tokens(F.col("src_text")).alias("s"), T.tokens(F.col("trg_text")).alias("t")).toArrow().to_batches()[0]
        i, j = embeddings.pair_ids(b, pa.array(words), np.arange(28), pa.array(words), np.arange(28, 56), window)
        assert list(zip(i, j, strict=True)) == [(ids[x], ids[y]) for x, y in want if x in ids and y in ids]
        counted = [(w, n) for r in embeddings._pair_counts(window)(iter([b])) for w, n in zip(*r.to_pydict().values(), strict=True)]
        assert {w: n for w, n in counted if n} == Counter(x for x, _ in want)


def test_bilingual_vectors_train_in_all_tasks_at_once(spark):
    # trained partition after partition, a round has a job of its own for each of them
    spark.sparkContext.setJobGroup("bilingual", "")
    embeddings.bilingual(_texts(spark, 200, 24), 4, 1, 1)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bilingual")) < 24
    assert embeddings.token_lists(_texts(spark, 400, 1), 100).rdd.getNumPartitions() == 4


def test_kmeans(spark):
    pts = frame(spark, [(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "id long, vec array<double>")
    got = {r.id: r.cluster for r in clusters.spherical_kmeans(pts, 2, 2, 5).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1


def test_spearman_with_ties(spark):
    df = frame(spark, [(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 9.0), (None, 1.0)], "a double, b double")
    r = evaluate.spearman(df, "a", "b").first()
    assert r.n == 4 and r.rho == pytest.approx(0.9486832980505138)


def test_word_similarity_falls_back(spark):
    v = frame(spark, [("Cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("<unk>", [1.0, 0.0])], "word string, vec array<double>")
    got = {(r.w1, r.w2): r.model for r in evaluate.word_similarity(frame(spark, [("cat", "dog", 1.0), ("CAT", "zzz", 2.0)], "w1 string, w2 string, human double"), v).collect()}
    assert got == {("cat", "dog"): 1.0, ("cat", "zzz"): 2.0}


def test_nearest_lists_positive_only(spark):
    v = frame(spark, [("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.5, 0.5])], "word string, vec array<double>")
    q = v.filter("word = 'a'").select(F.col("word").alias("query"), "vec")
    assert [r.word for r in knn.nearest(q, v).collect()] == ["c"]


def test_hot_keys(spark):
    rng = random.Random(4)
    data = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", rng.choice([None, 1, 2, 3])) for _ in range(2000)]
    df = frame(spark, data, "k string, v int")
    pairs = hot_keys.compress(df, F.col("k"), F.col("v"))
    per = {}
    for k, v in data:
        per.setdefault(k, []).append(v)
    got = {r.key: r for r in hot_keys.weighted_distinct_and_mode(pairs).collect()}
    for k, vs in per.items():
        known = [v for v in vs if v is not None]
        top = max(known.count(x) for x in set(known)) if known else None
        assert got[k].n_rows == len(vs) and got[k].n_distinct == len(set(known)) and got[k].mode_weight == top
        assert got[k].mode_value == min((x for x in set(known) if known.count(x) == top), default=None)
    med = {r.key: r.value for r in hot_keys.weighted_percentiles(pairs, [0.5]).collect()}
    for k, vs in per.items():
        known = sorted(v for v in vs if v is not None)
        assert not known or med[k] == known[math.ceil(len(known) / 2) - 1]
    assert {r.key for r in hot_keys.heavy_keys(df, F.col("k"), F.col("v"), 0.3).collect()} == {"hot"}
    assert hot_keys.heavy_keys(df.filter("false"), F.col("k"), F.col("v"), 0.3).count() == 0
    web = frame(spark, [("A", "en-GB", "u", "text"), ("a", "EN", "u", "text"), ("a", "cs", None, None), (None, "en", "v", "x")], "domain string, language string, uri string, text string")
    r = hot_keys.domain_profile(web).collect()
    assert [tuple(x) for x in r] == [("a", 1, 1, 4, 0, 0)]


def test_crawl(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    seeds = frame(spark, [(1,)], "node long")
    assert {(r.node, r.depth) for r in crawl.reach(edges, seeds).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert crawl.reach(edges, seeds, 1).count() == 2


def test_html_and_charsets():
    page = warc.parse('<head><script>var a="</p>";</script></head><body><p>one <b>bold</b><p>two<div>x<a href="/q#f">l</a><a href="http://h/y">m</a></div></body>', "http://h/a/b")
    assert [p.strip() for p in page.paragraphs] == ["one bold", "two"] and page.links == ["http://h/q#f", "http://h/y"]
    assert warc.best_decode("Žluť".encode("cp1250"), "cp1250")[0] == "Žluť"
    assert warc.best_decode("Žluť".encode(), "x-none") == ("Žluť", "utf-8")
    assert warc.best_decode(b"\xff\xe1", "utf-8")[1] == "iso8859-1" or warc.best_decode(b"\xff\xe1", "utf-8")[0] == "ÿá"


def test_warc_source(spark, tmp_path):
    def record(kind, uri, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(record("warcinfo", "", b"") + record("response", "http://h/x", b"HTTP/1.1 200 OK\r\n\r\nhi"))
    (tmp_path / "b.warc").write_bytes(record("response", "http://h/y", b"z")[:-5] + b"WARC/1.0\r\nContent-Length: x\r\n\r\n")
    spark.dataSource.register(warc.WarcSource)
    got = {(r.rec_type, r.target_uri, bytes(r.content)) for r in spark.read.format("warc").option("path", str(tmp_path)).load().collect()}
    assert ("response", "http://h/x", b"HTTP/1.1 200 OK\r\n\r\nhi") in got and any(u == "http://h/y" for _, u, _ in got)


def test_tsv(spark, tmp_path):
    docs = frame(spark, [("b", 1, 'say "hi"'), ("b", 1, "later"), ("c", 2, "x")], "bin string, doc_id long, text string").coalesce(1)
    tsv.write(docs, str(tmp_path / "d"))
    back = tsv.read(spark, str(tmp_path / "d"), "doc")
    assert {r.text for r in back.collect()} == {'say "hi"', "later", "x"}
    assert {(r.doc_id, r.text) for r in tsv.last_wins(back).collect()} == {(1, "later"), (2, "x")}
    v = frame(spark, [("w", [1.0, 2.0], [3.0, 4.0])], "word string, in_vec array<double>, out_vec array<double>")
    tsv.write_word_vectors(v, str(tmp_path / "v"), "sum")
    assert tsv.word_vectors(spark, str(tmp_path / "v")).first().vec == [4.0, 6.0]
    (tmp_path / "bin").write_bytes(b"2 2\n" + b"a " + np.array([1, 2], "<f4").tobytes() + b"\nb " + np.array([3, 4], "<f4").tobytes() + b"\n")
    assert {r.word: r.vec for r in tsv.binary_word_vectors(spark, str(tmp_path / "bin")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    listed = frame(spark, [("a",), ("b",)], "name string")
    assert [r.name for r in tsv.missing(listed, listed.filter("name = 'a'")).collect()] == ["b"]
    assert not tsv.complete(listed, listed.filter("name = 'a'")).first().complete


def test_detect_unknown_text_has_no_language(spark):
    samples = frame(spark, [(1, "en", "the house and the dog"), (2, "cs", "ten dům a ten pes")], "sample_id long, language string, text string")
    texts = frame(spark, [(1, "the dog"), (2, "1234"), (3, None), (4, "ten pes")], "id long, text string")
    got = {r.id: [x.language for x in r.languages] for r in detect.detect(texts, "text", samples).collect()}
    assert got[1][0] == "en" and got[4][0] == "cs" and got[2] == [] and got[3] == []


def test_stream(spark, small, tmp_path):
    source = spark.read.parquet(f"{small}/cc_token.parquet")
    source.select("domain", "fetched_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.select("domain", "fetched_at").schema).parquet(str(tmp_path / "in"))
    q = late.domain_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").count() >= 0
    seen = []
    q = late.score_each(stream, lambda df: df.groupBy().count(), lambda df, n: seen.append((n, df.first()[0])), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(n for _, n in seen) == source.count()


def test_paragraph_filters(spark):
    long = "x" * 100
    web = frame(spark, [(long, "EN-gb", 0.99), (long, "en", float("nan")), (long, None, 1.0), (long[:-1], "en", 1.0), (long + "�", "en", 1.0), (None, "en", 1.0)], "text string, language string, confidence double")
    assert [r.language for r in domains.paragraphs(web).collect()] == ["en"]


def test_metrics_at_the_edges(spark):
    from paraloom.functions import metrics

    z, a, b = (F.array(*map(F.lit, v)) for v in ([0.0, 0.0], [1.0, 0.0], [0.0, 2.0]))
    q = F.array(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0)))
    r = spark.range(1).select(
        metrics.angle(a, b).alias("angle"), metrics.quadratic_form(a, a, q).alias("form"), metrics.quadratic_difference(a, b, q).alias("diff"), metrics.intersection(z, z).alias("inter"),
        metrics.chi_square(z, z).alias("chi"), metrics.divergence(a, b).alias("kl"), metrics.jeffrey(a, b).alias("j"), metrics.hamming_share(a, b).alias("h"), metrics.minkowski(a, b, 1.0).alias("m"),
        metrics.smallest_difference(a, a).alias("low"), metrics.euclidean(F.lit(None).cast("array<double>"), a).alias("none"),
    ).first()
    assert r.angle == pytest.approx(math.pi / 2) and r.form == 2 and r["diff"] == 14 and r.inter is None and r.chi == 0 and r.kl == float("inf")
    assert r.j == pytest.approx(3 * math.log(2)) and r.h == 1 and r.m == 3 and r.low == 0 and r.none is None


def test_samples(spark):
    from paraloom.operators import samples

    s = frame(spark, [(0.9, True), (0.9, False), (0.1, True), (None, True)], "score double, correct boolean")
    assert [(r.score, r.true_rate, r.false_rate) for r in samples.roc(s.filter("score IS NOT NULL")).orderBy(F.desc("score")).collect()] == [(0.9, 0.5, 1.0), (0.1, 1.0, 1.0)]
    assert {r["bin"]: r.n for r in samples.histogram(s, F.col("score"), 0.0, 0.5, 5).collect()} == {4: 2, 1: 1}
    curve = samples.match_curve(frame(spark, [(0,), (2,), (None,), (0,)], "mindex int"), 4)
    assert {r.rank: r.share for r in curve.collect()} == {0: 0.5, 1: 0.5, 2: 0.75, 3: 0.75}
    pts = frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)], "id long, vec array<double>")
    assert len(samples.principal(pts, "vec", 2).first().projected) == 2
    reg = samples.regression(pts.withColumn("y", F.col("id") * 3.0), "vec", "y").filter("id = 7").first()
    assert reg.predicted == pytest.approx(21, abs=1e-3)


def test_lemmas_and_positions(spark):
    words = frame(spark, [("psi",), ("dům",), (None,)], "word string")
    lemmas = frame(spark, [("psi", "pes"), ("psi", "pso")], "word string, lemma string")
    assert {(r.word, r.lemma) for r in corpus.lemmatise(words, lemmas).collect()} == {("psi", "pes"), ("dům", "dům"), (None, None)}
    w, k = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, [True, False, True, True]))
    assert spark.range(1).select(corpus.kept_positions(w, k).alias("p")).first().p == [0, None, 1, 2]
    r = embeddings.value_range(frame(spark, [([1.0, 3.0],)], "v array<double>"), "v").first()
    assert (r.least, r.most, r.mean) == (1.0, 3.0, 2.0)
    assert spark.range(1).select(embeddings.keep_probability(F.lit(1000), F.lit(1000), 1e-3).alias("p")).first().p == pytest.approx((math.sqrt(1000) + 1) / 1000)


def test_pipelines(spark, small):
    from paraloom.plans import pipelines

    records, langs = spark.read.parquet(f"{small}/warc_record.parquet"), spark.read.parquet(f"{small}/lang_sample.parquet")
    web = pipelines.extract(records, langs, pipelines.Extraction(text_length=40, confidence=0.5))
    assert web.count() > 0 and pipelines.select(web).count() >= 0
    with pytest.raises(ValueError):
        pipelines.Extraction(confidence=2)
    head, tail, dictionary = pipelines.train(spark.read.parquet(f"{small}/corpus_pair.parquet"))
    assert head.count() > 0 and tail.count() > 0 and dictionary.count() > 0
    numbered = rows.bins(rows.number_rows(head.drop("row_no", "part"), [F.col("id")]), 100)
    src, trg = (numbered.select("bin", "doc_id", F.col(f"{s}_text").alias("text")) for s in ("src", "trg"))
    texts = src.union(trg)
    wv = docvec.word_vectors(corpus.ranked(corpus.vocabulary(F.col("text"), texts)), spark.read.parquet(f"{small}/embeddings.parquet"))
    cands = pipelines.candidates(src, trg, wv, wv)
    model = pipelines.fit(cands, src, trg, dictionary)
    assert pipelines.align(cands, src, trg, dictionary, model).count() >= 0


def test_damaged_warc_files_end_at_the_damage(spark, tmp_path):
    body = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/%d\r\nContent-Length: 40\r\n\r\n%s\r\n\r\n" % (i, bytes(random.Random(i).randbytes(40))) for i in range(8))
    packed = gzip.compress(body)
    full = list(warc.records(gzip.GzipFile(fileobj=io.BytesIO(packed))))
    assert len(full) == 8
    for at in range(0, len(packed), 7):
        flipped = packed[:at] + bytes([packed[at] ^ 0x55]) + packed[at + 1 :]
        for damaged in (packed[:at], flipped):
            got = list(warc.records(gzip.GzipFile(fileobj=io.BytesIO(damaged))))
            # flipped bits may show before the checksum at the end tells
            assert damaged is flipped or got == full[: len(got)]
    (tmp_path / "a.warc.gz").write_bytes(packed)
    (tmp_path / "b.warc.gz").write_bytes(packed[: len(packed) // 2])
    spark.dataSource.register(warc.WarcSource)
    plain = spark.read.format("warc").load(str(tmp_path)).collect()
    told = spark.read.format("warc").option("damaged", "true").load(f"file://{tmp_path}").filter("rec_type = 'damaged'").collect()
    assert 8 <= len(plain) < 16 and [r.target_uri.endswith("b.warc.gz") for r in told] == [True]


def test_running_sums(spark):
    rng = random.Random(4)
    data = [(rng.randrange(50), rng.randrange(9)) for _ in range(400)]
    per = {}
    for k, v in data:
        per[k] = per.get(k, 0) + v
    got = {r.k: r.upto_v for r in rows.running_sums(frame(spark, list(per.items()), "k long, v long"), [F.col("k")], ["v"]).collect()}
    assert got == {k: sum(v for x, v in per.items() if x <= k) for k in per}
    assert rows.running_sums(frame(spark, [], "k long, v long"), [F.col("k")], ["v"]).count() == 0


def test_huffman_is_optimal_and_prefix_free():
    import heapq

    rng = random.Random(2)
    for size in (0, 1, 2, 3, 40):
        counts = {f"w{i}": rng.randrange(1, 60) for i in range(size)}
        codes = embeddings.huffman(counts)
        assert codes.keys() == counts.keys() and not any(a != b and codes[b].startswith(codes[a]) for a in codes for b in codes)
        heap, best = list(counts.values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            n = heapq.heappop(heap) + heapq.heappop(heap)
            best += n
            heapq.heappush(heap, n)
        assert sum(len(codes[w]) * n for w, n in counts.items()) == (best if size > 1 else size and counts["w0"])


def test_clean_html():
    html = '<html><head><title>t</title></head><body onload="x()"><script>var a="</p>";</script><p class="c">a &amp; <b onclick="y">b</b><br><a href="javascript:z" title="q">l</a><a href="/m">m</a><form>f</form></p></body>'
    assert warc.clean_html(html) == '<p>a &amp; <b>b</b><br><a title="q">l</a><a href="/m">m</a>f</p>'


def test_run_lengths_across_blocks(spark):
    rng = random.Random(9)
    values = [rng.choice(["a", "a", "b", None]) for _ in range(60)]
    want, at = [], 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[at]:
            want.append((at, i - at, values[at]))
            at = i
    df = frame(spark, list(enumerate(values)), "row_no long, v string")
    for block in (4, 7, 1000):
        assert sorted(tuple(r) for r in rows.run_lengths(df, "v", block).collect()) == want
    assert rows.run_lengths(df.filter("false"), "v").count() == 0


def test_analogy_files_and_saved_models(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "capital-world.txt").write_text("athens greece  oslo norway\nbroken line\n")
    assert [tuple(r) for r in tsv.analogies(spark, str(tmp_path / "a")).collect()] == [("capital-world", "athens", "greece", "oslo", "norway")]
    data = frame(spark, [("b", i, i, float(i % 2), 0.5, float(i % 2), 0.1, float(i % 2)) for i in range(20)], "bin string, src_doc_id long, trg_doc_id long, " + ", ".join(f"{f} double" for f in classify.FEATURES) + ", label double")
    model = classify.fit_tree(data)
    classify.save(model, str(tmp_path / "m"))
    classify.save(model, str(tmp_path / "m"))
    key = lambda m: sorted((r.src_doc_id, r.score) for r in classify.apply(m, data).collect())
    assert key(classify.load(str(tmp_path / "m"))) == key(model)


def test_random_windows_and_draws(spark):
    df = frame(spark, [("k%d" % i, [f"w{j}" for j in range(12)]) for i in range(40)], "k string, w array<string>")
    got = df.select("k", F.explode(links.random_skip_pairs(F.col("w"), 4, F.col("k"))).alias("p")).select(F.abs(F.substring("p.word", 2, 9).cast("int") - F.substring("p.context", 2, 9).cast("int")).alias("d")).groupBy("d").count().collect()
    n = {r["d"]: r["count"] for r in got}
    assert sorted(n) == [1, 2, 3, 4] and n[1] > n[2] > n[3] > n[4]
    assert frame(spark, [("k", [])], "k string, w array<string>").select(links.random_skip_pairs(F.col("w"), 4, F.col("k")).alias("p")).first().p is None
    x = spark.range(2000).select(T.draw(F.col("id")).alias("x")).agg(F.min("x"), F.max("x"), F.avg("x")).first()
    assert 0 <= x[0] < 0.01 < 0.99 < x[1] < 1 and abs(x[2] - 0.5) < 0.03
