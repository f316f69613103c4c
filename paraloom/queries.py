"""Queries over the core operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.functions import detect, metrics
from paraloom.functions import text as T
from paraloom.functions import vectors as V
from paraloom.operators import classify, clusters, corpus, crawl, docvec, domains, embeddings, evaluate, hot_keys, knn, links, rows, samples, scoring
from paraloom.plans import pipelines
from paraloom.session import cut, table
from paraloom.sources import tsv, warc
from paraloom.streaming import late

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its equivalent SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT lower(domain) AS domain FROM cc_token WHERE domain IS NOT NULL
GROUP BY 1 HAVING count(*) >= 0.03 * (SELECT count(*) FROM cc_token)""")
def p3_found(spark, sf):
    web = table(spark, sf, "cc_token")
    return hot_keys.heavy_keys(web, F.lower("domain"), F.lower("language"), 0.03).select(F.col("key").alias("domain"))


@query("""
WITH t AS (SELECT lower(domain) AS domain, uri, text,
             lower(trim(regexp_replace(language, '[-_].*$', ''))) AS lang
           FROM cc_token WHERE domain IS NOT NULL)
SELECT domain, count(DISTINCT uri) AS uri_count,
  count(DISTINCT CASE WHEN lang = 'en' THEN text END) AS text_count_en,
  (SELECT coalesce(sum(length(text)), 0) FROM (SELECT DISTINCT text FROM t u WHERE u.domain = t.domain AND lang = 'en'))::BIGINT AS text_length_en,
  count(DISTINCT CASE WHEN lang = 'cs' THEN text END) AS text_count_cs,
  (SELECT coalesce(sum(length(text)), 0) FROM (SELECT DISTINCT text FROM t u WHERE u.domain = t.domain AND lang = 'cs'))::BIGINT AS text_length_cs
FROM t GROUP BY domain""")
def p3_domain_profile(spark, sf):
    return hot_keys.domain_profile(table(spark, sf, "cc_token"))


@query("""
WITH t AS (SELECT lower(domain) AS domain, length(text) AS len FROM cc_token WHERE domain IS NOT NULL),
c AS (SELECT domain, len, count(*) AS w FROM t GROUP BY ALL),
r AS (SELECT domain, len, sum(w) OVER (PARTITION BY domain ORDER BY len) AS upto,
        sum(w) OVER (PARTITION BY domain) AS total FROM c WHERE len IS NOT NULL)
SELECT domain, f AS fraction, min(len)::BIGINT AS text_length
FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) v(f) WHERE upto >= f * total GROUP BY ALL""")
def p3_length_percentiles(spark, sf):
    web = table(spark, sf, "cc_token").filter("domain IS NOT NULL")
    pairs = hot_keys.compress(web, F.lower("domain"), F.length("text").cast("long"))
    return hot_keys.weighted_percentiles(pairs, [0.5, 0.9]).select(F.col("key").alias("domain"), "fraction", F.col("value").alias("text_length"))


@query("""
WITH c AS (SELECT lower(domain) AS domain, lower(language) AS lang, count(*) AS w FROM cc_token WHERE domain IS NOT NULL GROUP BY ALL),
m AS (SELECT domain, arg_min(lang, (-w, lang)) AS mode_language, max(w) AS mode_weight FROM c WHERE lang IS NOT NULL GROUP BY domain)
SELECT c.domain, sum(w)::BIGINT AS n_rows, count(lang) AS n_distinct, any_value(mode_language) AS mode_language, any_value(mode_weight) AS mode_weight
FROM c LEFT JOIN m USING (domain) GROUP BY c.domain""")
def p3_language_mode(spark, sf):
    web = table(spark, sf, "cc_token").filter("domain IS NOT NULL")
    pairs = hot_keys.compress(web, F.lower("domain"), F.lower("language"))
    return hot_keys.weighted_distinct_and_mode(pairs).select(
        F.col("key").alias("domain"), "n_rows", "n_distinct", F.col("mode_value").alias("mode_language"), "mode_weight"
    )


TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
SRC, TRG, TXT = TOK.format("src_text"), TOK.format("trg_text"), TOK.format("text")
NORMAL = r"trim(regexp_replace({}, '[\p{{Z}}\p{{C}}]+', ' ', 'g'))"
LANG = "lower(trim(regexp_replace(language, '[-_].*$', '')))"
NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY id NULLS FIRST, probab NULLS FIRST, src_text NULLS FIRST, trg_text NULLS FIRST) - 1 AS row_no FROM corpus_pair)"
KEPT = f"""kept_rows AS (SELECT * FROM corpus_pair WHERE coalesce(trim(src_text), '') != '' AND coalesce(trim(trg_text), '') != ''
  AND len(regexp_split_to_array(trim(src_text), '\\s+')) BETWEEN 1 AND 50 AND len(regexp_split_to_array(trim(trg_text), '\\s+')) BETWEEN 1 AND 50
  AND regexp_matches(src_text, '\\p{{L}}') AND regexp_matches(trg_text, '\\p{{L}}'))"""
SETS = f"sets AS (SELECT row_number() OVER () AS n, list_distinct({SRC}) AS s, list_distinct({TRG}) AS t FROM kept_rows)"
DICE = f"""{KEPT}, {SETS},
sw AS (SELECT w, count(*) AS n FROM (SELECT unnest(s) AS w FROM sets) GROUP BY w),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM sets) GROUP BY w),
bw AS (SELECT s, t, count(*) AS n FROM (SELECT s, unnest(t) AS t FROM (SELECT unnest(s) AS s, t FROM sets)) GROUP BY s, t),
dict AS (SELECT bw.s AS src_word, bw.t AS trg_word, 2 * bw.n / (sw.n + tw.n) AS weight FROM bw JOIN sw ON sw.w = bw.s JOIN tw ON tw.w = bw.t WHERE 2 * bw.n / (sw.n + tw.n) > 0.1)"""
BIN = 500
DOCS = f"""{NUMBERED},
src_docs AS (SELECT lpad((row_no // {BIN})::VARCHAR, 8, '0') AS bin, row_no AS doc_id, src_text AS text FROM numbered WHERE src_text IS NOT NULL),
trg_docs AS (SELECT lpad((row_no // {BIN})::VARCHAR, 8, '0') AS bin, row_no AS doc_id, trg_text AS text FROM numbered WHERE trg_text IS NOT NULL)"""
VECTORS = f"""vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS n FROM
  (SELECT unnest({SRC}) AS word FROM corpus_pair UNION ALL SELECT unnest({TRG}) FROM corpus_pair) GROUP BY word),
wordvec AS (SELECT word, vec FROM vocab JOIN (SELECT row_number() OVER (ORDER BY vec_id) AS n, embedding::DOUBLE[] AS vec FROM embeddings) USING (n))"""
TFIDF = f"""uniq AS (SELECT bin, text, min(doc_id) AS doc_id FROM {{docs}} GROUP BY bin, text),
terms AS (SELECT bin, doc_id, word, count(*) AS tf FROM (SELECT bin, doc_id, unnest({TXT}) AS word FROM uniq) GROUP BY ALL),
sizes AS (SELECT bin, count(*) AS n_docs FROM uniq GROUP BY bin), dfs AS (SELECT bin, word, count(*) AS df FROM terms GROUP BY ALL),
tfidf AS (SELECT bin, doc_id, word, tf, log10(n_docs / df) AS idf FROM terms JOIN dfs USING (bin, word) JOIN sizes USING (bin))"""


def _docvec_sql(docs: str, name: str) -> str:
    parts = TFIDF.replace("{docs}", docs)
    for x in ("uniq", "terms", "sizes", "dfs", "tfidf"):
        parts = parts.replace(f"{x} AS", f"{x}_{name} AS").replace(f"FROM {x} ", f"FROM {x}_{name} ").replace(f"FROM {x})", f"FROM {x}_{name})").replace(f"JOIN {x} ", f"JOIN {x}_{name} ")
    return parts + f""", dims_{name} AS (SELECT bin, doc_id, i, sum(tf * idf * vec[i]) AS x FROM tfidf_{name} JOIN wordvec USING (word), range(1, 65) r(i) GROUP BY ALL),
{name} AS (SELECT bin, doc_id, list(x ORDER BY i) AS vec FROM dims_{name} GROUP BY bin, doc_id)"""


def _corpus(spark, sf):
    return table(spark, sf, "corpus_pair")


def _kept(spark, sf):
    return corpus.clean(_corpus(spark, sf))


def _numbered(spark, sf):
    return rows.number_rows(_corpus(spark, sf), [F.col(c) for c in corpus.PAIR_ORDER])


def _docs(spark, sf, side):
    binned = rows.bins(_numbered(spark, sf), BIN)
    return binned.filter(F.col(f"{side}_text").isNotNull()).select("bin", "doc_id", F.col(f"{side}_text").alias("text"))


def _wordvec(spark, sf):
    c = _corpus(spark, sf)
    texts = c.select(F.col("src_text").alias("text")).unionByName(c.select(F.col("trg_text").alias("text")))
    return docvec.word_vectors(corpus.ranked(corpus.vocabulary(F.col("text"), texts)), table(spark, sf, "embeddings"))


def _docvec(spark, sf, side):
    return docvec.doc_vectors(_docs(spark, sf, side), _wordvec(spark, sf), 64)


def _six(*names):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


@query(f"""SELECT row_id, {LANG} AS language, {NORMAL.format('text')} AS text FROM cc_token
WHERE length({NORMAL.format('text')}) >= 100 AND NOT regexp_matches({NORMAL.format('text')}, '[\\x{{FFF0}}-\\x{{FFFF}}]')
AND {LANG} IN ('en', 'cs') AND confidence >= 0.99 AND NOT isnan(confidence)""")
def web_paragraphs(spark, sf):
    return domains.paragraphs(table(spark, sf, "cc_token")).select("row_id", "language", "text")


@query("""SELECT domain, uri_count, text_count_en, text_length_en, text_count_cs, text_length_cs FROM domain_info
WHERE text_count_en >= 1 AND text_count_cs >= 1 AND least(text_length_en, text_length_cs) / nullif(greatest(text_length_en, text_length_cs), 0) > 0.01
AND text_length_en IS NOT NULL AND text_length_cs IS NOT NULL""")
def balance_filter(spark, sf):
    return domains.balanced(domains.bilingual_domains(table(spark, sf, "domain_info")))


@query("""SELECT lower(domain) AS domain, text, min(uri) AS uri, min(language) AS language FROM cc_token
WHERE domain IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2""")
def distinct_texts(spark, sf):
    return domains.distinct_texts(table(spark, sf, "cc_token"))


SELECTED = f"""kept AS (SELECT lower(domain) AS domain, uri, {LANG} AS language, {NORMAL.format('text')} AS text FROM cc_token
  WHERE domain IS NOT NULL AND length({NORMAL.format('text')}) >= 100 AND NOT regexp_matches({NORMAL.format('text')}, '[\\x{{FFF0}}-\\x{{FFFF}}]')
  AND {LANG} IN ('en', 'cs') AND confidence >= 0.99 AND NOT isnan(confidence)),
len AS (SELECT domain, language, count(*) AS n, sum(length(text)) AS len FROM (SELECT DISTINCT domain, language, text FROM kept) GROUP BY ALL),
good AS (SELECT a.domain FROM len a JOIN len b ON a.domain = b.domain AND a.language = 'en' AND b.language = 'cs' WHERE least(a.len, b.len) / greatest(a.len, b.len) > 0.01)"""


@query(f"""WITH {SELECTED} SELECT domain, text, min(uri) AS uri, min(language) AS language FROM kept WHERE domain IN (SELECT domain FROM good) GROUP BY domain, text""")
def bilingual_texts(spark, sf):
    return domains.select_bilingual(table(spark, sf, "cc_token"))


@query(f"WITH {NUMBERED} SELECT lpad((row_no // {BIN})::VARCHAR, 8, '0') AS bin, row_no AS doc_id, src_text, trg_text FROM numbered")
def bins_supervised(spark, sf):
    return rows.bins(_numbered(spark, sf), BIN).select("bin", "doc_id", "src_text", "trg_text")


@query(f"""WITH w AS (SELECT lower(domain) AS bin, {LANG} AS language, row_id, text FROM cc_token WHERE domain IS NOT NULL AND text IS NOT NULL AND {LANG} IN ('en', 'cs'))
SELECT bin, language, row_number() OVER (PARTITION BY language ORDER BY bin, row_id) - 1 AS doc_id, row_id, text FROM w""")
def bins_web(spark, sf):
    return rows.web_bins(table(spark, sf, "cc_token"), ("en", "cs"), hot_keys.language_code(F.col("language")))


@query(f"WITH {NUMBERED} SELECT id, row_no, CASE WHEN row_no < (SELECT count(*) * 50 // 100 FROM corpus_pair) THEN 'head' ELSE 'tail' END AS part FROM numbered")
def split_head_tail(spark, sf):
    n = _numbered(spark, sf)
    return rows.head_tail(n, n.count(), 50).select("id", "row_no", "part")


@query(f"WITH {KEPT} SELECT id, src_text, trg_text FROM kept_rows")
def clean_corpus(spark, sf):
    return _kept(spark, sf).select("id", "src_text", "trg_text")


@query(r"""WITH r AS (SELECT CASE
  WHEN coalesce(trim(src_text), '') = '' OR coalesce(trim(trg_text), '') = '' THEN 'min_tokens'
  WHEN len(regexp_split_to_array(trim(src_text), '\s+')) > 50 OR len(regexp_split_to_array(trim(trg_text), '\s+')) > 50 THEN 'max_tokens'
  WHEN NOT regexp_matches(src_text, '\p{L}') THEN 'src_no_letter' WHEN NOT regexp_matches(trg_text, '\p{L}') THEN 'trg_no_letter' ELSE 'kept' END AS reason FROM corpus_pair)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def clean_rejections(spark, sf):
    return corpus.rejections(_corpus(spark, sf))


@query("""SELECT round(avg(length(trg_text) / length(src_text)), 6) AS mean, round(stddev_pop(length(trg_text) / length(src_text)), 6) AS std, count(*) AS n
FROM corpus_pair WHERE length(src_text) > 0 AND trg_text IS NOT NULL""")
def length_ratio_stats(spark, sf):
    return corpus.length_ratio(_corpus(spark, sf)).select(*_six("mean", "std"), "n")


@query(r"""SELECT id, trim(regexp_replace(src_text, '[\p{Z}\p{C}]+', ' ', 'g')) AS spaced, regexp_replace(lower(src_text), '[0-9]+', '0', 'g') AS masked,
replace(regexp_replace(src_text, '[^\s\p{Z}\p{L}\p{M}\p{N}\p{Pc}\x{0}-\x{7F}]+', '•', 'g'), '•', '<unk>') AS unknown FROM corpus_pair""")
def normalise_text(spark, sf):
    s = F.col("src_text")
    return _corpus(spark, sf).select("id", T.normalise_space(s).alias("spaced"), T.mask_digits(F.lower(s)).alias("masked"), T.unknown_to_token(T.mark_unknown(s)).alias("unknown"))


@query(f"WITH {DICE} SELECT src_word, trg_word, round(weight, 6) AS weight FROM dict")
def dice_dictionary(spark, sf):
    return corpus.dice(_kept(spark, sf)).select("src_word", "trg_word", *_six("weight"))


PARAMS = f"""{KEPT}, {SETS}, bw AS (SELECT s, t, count(*) AS n FROM (SELECT s, unnest(t) AS t FROM (SELECT unnest(s) AS s, t FROM sets)) GROUP BY s, t),
p AS (SELECT s, t, n / sum(n) OVER (PARTITION BY s) AS f, n / sum(n) OVER (PARTITION BY t) AS r FROM bw)"""


@query(f"WITH {PARAMS} SELECT s AS src_word, t AS trg_word, round(2 * f * r / (f + r), 6) AS weight FROM p WHERE 2 * f * r / (f + r) >= 0.05")
def merge_params_words(spark, sf):
    return corpus.merge_params(*corpus.conditional_params(_kept(spark, sf)), 0.05).select("src_word", "trg_word", *_six("weight"))


@query(SQL["merge_params_words"].replace("0.05", "0.0512345"))
def merge_params_log(spark, sf):
    logs = [x.withColumn("p", F.ln("p")) for x in corpus.conditional_params(_kept(spark, sf))]
    # no ratio of small counts equals this threshold, so rounding of the logarithms can't tell
    return corpus.merge_params(*logs, 0.0512345, log=True).select("src_word", "trg_word", *_six("weight"))


@query(SQL["merge_params_words"])
def merge_params_ids(spark, sf):
    kept = _kept(spark, sf)
    sides = [corpus.ranked(corpus.vocabulary(F.col(c), kept)).select(F.col("rank").cast("int").alias("word_id"), "word") for c in ("src_text", "trg_text")]
    coded = []
    for params, (a, b) in zip(corpus.conditional_params(kept), (sides, sides[::-1]), strict=True):
        ids = params.join(a.select(F.col("word").alias("w1"), F.col("word_id").alias("src_id")), "w1").join(b.select(F.col("word").alias("w2"), F.col("word_id").alias("trg_id")), "w2")
        coded.append(corpus.decode_params(ids.select("src_id", "trg_id", F.col("p").alias("param")), a, b))
    return corpus.merge_params(*coded, 0.05).select("src_word", "trg_word", *_six("weight"))


@query(f"SELECT word, count(*) AS cnt FROM (SELECT unnest({TRG}) AS word FROM corpus_pair) GROUP BY word HAVING count(*) >= 5")
def vocabulary(spark, sf):
    return corpus.vocabulary(F.col("trg_text"), _corpus(spark, sf), 5)


@query(f"SELECT word, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS rank FROM (SELECT unnest({TRG}) AS word FROM corpus_pair) GROUP BY word")
def vocabulary_ranks(spark, sf):
    return corpus.ranked(corpus.vocabulary(F.col("trg_text"), _corpus(spark, sf)))


@query(f"""WITH w AS (SELECT {TRG} AS w FROM corpus_pair), u AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word),
b AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1) GROUP BY a, b)
SELECT b.a AS first, b.b AS second, round((b.n - 5) / x.n / y.n * (SELECT sum(n) FROM u), 6) AS score FROM b JOIN u x ON x.word = b.a JOIN u y ON y.word = b.b
WHERE b.n >= 5 AND x.n >= 5 AND y.n >= 5 AND (b.n - 5) / x.n / y.n * (SELECT sum(n) FROM u) > 10""")
def phrase_scores(spark, sf):
    return corpus.phrase_scores(F.col("trg_text"), _corpus(spark, sf), 5, 10.0).select("first", "second", *_six("score"))


@query(f"WITH {DOCS}, {TFIDF.replace("{docs}", "src_docs")} SELECT bin, doc_id, word, tf, round(idf, 6) AS idf FROM tfidf")
def tfidf_weights(spark, sf):
    return docvec.tfidf(_docs(spark, sf, "src")).select("bin", "doc_id", "word", "tf", *_six("idf"))


@query(f"WITH {DOCS}, {VECTORS}, {_docvec_sql('src_docs', 'sv')} SELECT bin, doc_id, round(list_sum(list_transform(vec, lambda x: x * x)), 4) AS squared, round(vec[1], 4) AS first FROM sv")
def doc_vectors(spark, sf):
    v = _docvec(spark, sf, "src")
    return v.select("bin", "doc_id", F.round(V.dot(F.col("vec"), F.col("vec")), 4).alias("squared"), F.round(F.col("vec")[0], 4).alias("first"))


KNN = f"""WITH {DOCS}, {VECTORS}, {_docvec_sql('src_docs', 'sv')}, {_docvec_sql('trg_docs', 'tv')},
sims AS (SELECT s.bin, s.doc_id AS src_doc_id, t.doc_id AS trg_doc_id, coalesce(CASE WHEN list_sum(list_transform(s.vec, lambda x: x * x)) = 0 OR list_sum(list_transform(t.vec, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(s.vec, t.vec) END, 0) AS c
  FROM sv s JOIN tv t USING (bin)),
top AS (SELECT *, row_number() OVER (PARTITION BY bin, src_doc_id ORDER BY round(c, 9) DESC, trg_doc_id) - 1 AS knn_rank FROM sims)
SELECT bin, src_doc_id, trg_doc_id, round(1 - sqrt(2 * greatest(0, 1 - c)) / 2, 5) AS score, knn_rank FROM top WHERE knn_rank < 10"""


def _knn(found):
    return found.select("bin", "src_doc_id", "trg_doc_id", F.round("score", 5).alias("score"), F.col("knn_rank").cast("long").alias("knn_rank"))


@query(KNN)
def knn_exact(spark, sf):
    return _knn(knn.exact(_docvec(spark, sf, "src"), _docvec(spark, sf, "trg")))


@query(KNN)
def knn_blocked(spark, sf):
    return _knn(knn.blocked(_docvec(spark, sf, "src"), _docvec(spark, sf, "trg"), block=200))


@query()
def knn_hashed(spark, sf):
    return knn.hashed(_docvec(spark, sf, "src"), _docvec(spark, sf, "trg"))


def _candidates(spark, sf):
    pairs = table(spark, sf, "doc_align")
    return pairs.select(F.lit("web").alias("bin"), "src_doc_id", "trg_doc_id", "score")


def _web_docs(spark, sf, column):
    used = table(spark, sf, "doc_align").select(F.col(column).alias("doc_id")).distinct()
    docs = table(spark, sf, "cc_token").filter("text IS NOT NULL").select(F.lit("web").alias("bin"), F.col("row_id").alias("doc_id"), "text")
    return docs.join(used, "doc_id", "left_semi").select("bin", "doc_id", "text")


PAIRS = """pairs AS (SELECT 'web' AS bin, src_doc_id, trg_doc_id, max(score) AS knn_score, any_value(s.text) AS src_text, any_value(t.text) AS trg_text
  FROM doc_align JOIN cc_token s ON s.row_id = src_doc_id JOIN cc_token t ON t.row_id = trg_doc_id WHERE s.text IS NOT NULL AND t.text IS NOT NULL GROUP BY src_doc_id, trg_doc_id)"""
LENGTH = "exp(-power((length(trg_text) / nullif(length(src_text), 0) - 1.08) / 0.28, 2) / 2)"
SCORED = f"""{DICE}, {PAIRS},
sx AS (SELECT src_doc_id, trg_doc_id, unnest({SRC}) AS src_word, len({TRG}) AS m, {TRG} AS tw FROM pairs),
tx AS (SELECT DISTINCT ON (src_doc_id, trg_doc_id, src_word) src_doc_id, trg_doc_id, src_word, m, tw FROM sx),
ty AS (SELECT src_doc_id, trg_doc_id, src_word, m, unnest(tw) AS trg_word FROM tx),
term AS (SELECT src_doc_id, trg_doc_id, src_word, 1e-9 + sum(coalesce(weight, 1e-9) / m) AS p FROM ty LEFT JOIN dict USING (src_word, trg_word) GROUP BY ALL),
ibm AS (SELECT src_doc_id, trg_doc_id, sum(ln(coalesce(p, 1e-9))) AS log_score FROM sx LEFT JOIN term USING (src_doc_id, trg_doc_id, src_word) GROUP BY ALL),
scored AS (SELECT bin, src_doc_id, trg_doc_id, knn_score, ln(greatest({LENGTH}, 1e-300)) + coalesce(log_score, 0) AS log_score FROM pairs LEFT JOIN ibm USING (src_doc_id, trg_doc_id) WHERE length(src_text) > 0)"""


def _dictionary(spark, sf):
    return corpus.dice(_kept(spark, sf))


def _rescored(spark, sf):
    return scoring.rescore(_candidates(spark, sf), _web_docs(spark, sf, "src_doc_id"), _web_docs(spark, sf, "trg_doc_id"), _dictionary(spark, sf), 1.08, 0.28)


@query(f"""WITH {PAIRS} SELECT src_doc_id, trg_doc_id, round({LENGTH}, 6) AS length_sim, round(1 - exp(-0.01 * length(src_text)), 6) AS length_conf FROM pairs""")
def score_length(spark, sf):
    p = scoring.with_texts(_candidates(spark, sf).drop("score").distinct(), _web_docs(spark, sf, "src_doc_id"), _web_docs(spark, sf, "trg_doc_id"))
    s, t = F.length("src_text"), F.length("trg_text")
    return p.select("src_doc_id", "trg_doc_id", F.round(T.length_likelihood(s, t, 1.08, 0.28), 6).alias("length_sim"), F.round(T.length_confidence(s), 6).alias("length_conf"))


@query(f"""WITH {SCORED} SELECT src_doc_id, trg_doc_id, round(log_score, 4) AS log_score,
row_number() OVER (PARTITION BY bin, src_doc_id ORDER BY round(log_score, 9) DESC, knn_score DESC NULLS LAST, trg_doc_id) - 1 AS rank FROM scored""")
def score_ibm1(spark, sf):
    return _rescored(spark, sf).select("src_doc_id", "trg_doc_id", F.round("log_score", 4).alias("log_score"), F.col("rank").cast("long").alias("rank"))


RANKS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY bin, src_doc_id ORDER BY score DESC, trg_doc_id) - 1 AS rank FROM found),
ranks AS (SELECT r.bin, r.src_doc_id, min(CASE WHEN g.text = w.text THEN rank END) AS mindex
  FROM ranked r JOIN trg_docs g ON g.bin = r.bin AND g.doc_id = r.trg_doc_id JOIN trg_docs w ON w.bin = r.bin AND w.doc_id = r.src_doc_id GROUP BY ALL)"""


@query(KNN.rpartition("SELECT bin")[0].rstrip() + ", found AS (SELECT bin, src_doc_id, trg_doc_id, -knn_rank AS score FROM top WHERE knn_rank < 10), " + RANKS + " SELECT mindex, count(*) AS freq FROM ranks GROUP BY mindex")
def bench_histogram(spark, sf):
    found = knn.blocked(_docvec(spark, sf, "src"), _docvec(spark, sf, "trg"), block=200).select("bin", "src_doc_id", "trg_doc_id", (-F.col("knn_rank")).alias("score"))
    return scoring.rank_histogram(scoring.correct_rank(found, _docs(spark, sf, "trg"))).select(F.col("mindex").cast("long").alias("mindex"), "freq")


FEATURES = f"""{DICE}, {PAIRS},
sx AS (SELECT src_doc_id, trg_doc_id, unnest({SRC}) AS src_word, {TRG} AS tw FROM pairs),
tx AS (SELECT DISTINCT ON (src_doc_id, trg_doc_id, src_word) src_doc_id, trg_doc_id, src_word, tw FROM sx),
ty AS (SELECT src_doc_id, trg_doc_id, src_word, unnest(tw) AS trg_word FROM tx),
best AS (SELECT src_doc_id, trg_doc_id, src_word, max(coalesce(nullif(weight, 0), CASE WHEN src_word = trg_word THEN 1.0 END)) AS best FROM ty LEFT JOIN dict USING (src_word, trg_word) GROUP BY ALL),
sums AS (SELECT src_doc_id, trg_doc_id, sum(length(src_word)) AS total, sum(CASE WHEN best IS NOT NULL THEN length(src_word) END) AS resolved, sum(length(src_word) * best) AS matching
  FROM sx LEFT JOIN best USING (src_doc_id, trg_doc_id, src_word) GROUP BY ALL)"""


@query(f"""WITH {FEATURES} SELECT src_doc_id, trg_doc_id, round({LENGTH}, 6) AS length_sim, round(1 - exp(-0.01 * length(src_text)), 6) AS length_conf,
round(coalesce(matching / nullif(resolved, 0), 0), 6) AS weight_sim, round(coalesce(resolved / nullif(total, 0), 0), 6) AS weight_conf FROM pairs LEFT JOIN sums USING (src_doc_id, trg_doc_id)""")
def classifier_features(spark, sf):
    p = scoring.with_texts(_candidates(spark, sf).drop("score").distinct(), _web_docs(spark, sf, "src_doc_id"), _web_docs(spark, sf, "trg_doc_id"))
    return scoring.features(p, _dictionary(spark, sf), 1.08, 0.28).select("src_doc_id", "trg_doc_id", *_six(*classify.FEATURES))


@query("""WITH b AS (SELECT src_doc_id, max(score) AS score FROM doc_align GROUP BY src_doc_id)
SELECT src_doc_id, min(trg_doc_id) AS trg_doc_id, score FROM doc_align JOIN b USING (src_doc_id, score) GROUP BY src_doc_id, score HAVING score > 0.5""")
def filter_threshold(spark, sf):
    known = _candidates(spark, sf).filter("score IS NOT NULL").distinct()
    return scoring.above(scoring.top_one(known), 0.5).select("src_doc_id", "trg_doc_id", "score")


@query("""SELECT src_doc_id, trg_doc_id, score, 'web' || chr(9) || src_doc_id || chr(9) || trg_doc_id || chr(9) || printf('%.6f', score) || chr(10) || s.text || chr(10) || t.text || chr(10) AS record
FROM (SELECT DISTINCT src_doc_id, trg_doc_id, score FROM doc_align WHERE score IS NOT NULL) d JOIN cc_token s ON s.row_id = src_doc_id JOIN cc_token t ON t.row_id = trg_doc_id WHERE s.text IS NOT NULL AND t.text IS NOT NULL""")
def dump_records(spark, sf):
    known = _candidates(spark, sf).filter("score IS NOT NULL").distinct()
    return scoring.records(known, _web_docs(spark, sf, "src_doc_id"), _web_docs(spark, sf, "trg_doc_id")).select("src_doc_id", "trg_doc_id", "score", "record")


THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]


@query(f"""WITH x AS (SELECT probab AS c, len({SRC}) > 0 AND len({TRG}) > 0 AND src_text != trg_text AS ok FROM corpus_pair WHERE probab IS NOT NULL AND src_text IS NOT NULL AND trg_text IS NOT NULL)
SELECT t AS threshold, count(*) FILTER (c > t) AS n_above, count(*) FILTER (c > t AND ok) AS n_correct,
round(count(*) FILTER (c > t AND ok) / nullif(count(*) FILTER (c > t), 0), 6) AS precision, round(count(*) FILTER (c > t AND ok) / (SELECT count(*) FROM x WHERE ok), 6) AS recall
FROM x, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) v(t) GROUP BY t""")
def precision_by_threshold(spark, sf):
    known = _corpus(spark, sf).filter("probab IS NOT NULL AND src_text IS NOT NULL AND trg_text IS NOT NULL")
    right = (F.size(T.tokens(F.col("src_text"))) > 0) & (F.size(T.tokens(F.col("trg_text"))) > 0) & (F.col("src_text") != F.col("trg_text"))
    scored = known.select(F.col("probab").alias("confidence"), right.alias("correct"))
    return scoring.precision_recall(scored, THRESHOLDS).select("threshold", "n_above", "n_correct", *_six("precision", "recall"))


@query("SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM doc_align), 6) AS share FROM doc_align GROUP BY bin")
def pairs_per_domain(spark, sf):
    return scoring.pairs_per_domain(table(spark, sf, "doc_align")).select("bin", "n", *_six("share"))


def _judged(spark, sf):
    """Word pairs of the dictionary as judged pairs, their Dice weight the judgement."""
    return _dictionary(spark, sf).select(F.col("src_word").alias("w1"), F.col("trg_word").alias("w2"), F.round("weight", 9).alias("human"))


COS = "CASE WHEN list_sum(list_transform({0}, lambda x: x * x)) = 0 OR list_sum(list_transform({1}, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity({0}, {1}) END"


@query(f"""WITH {DICE}, {VECTORS}, m AS (SELECT round(weight, 9) AS human, round(1 + coalesce({COS.format('a.vec', 'b.vec')}, 0), 9) AS model FROM dict LEFT JOIN wordvec a ON a.word = src_word LEFT JOIN wordvec b ON b.word = trg_word),
r AS (SELECT rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2 AS rh, rank() OVER (ORDER BY model) + (count(*) OVER (PARTITION BY model) - 1) / 2 AS rm FROM m)
SELECT round(corr(rh, rm), 5) AS rho, count(*) AS n FROM r""")
def wordsim_spearman(spark, sf):
    sims = evaluate.word_similarity(_judged(spark, sf), _wordvec(spark, sf)).filter("model IS NOT NULL").withColumn("model", F.round("model", 9))
    return evaluate.spearman(sims, "human", "model").select(F.round("rho", 5).alias("rho"), "n")


@query(f"""WITH {VECTORS}, u AS (SELECT word, vec FROM wordvec), s AS (SELECT q.word AS query, w.word, list_cosine_similarity(q.vec, w.vec) AS c FROM u q JOIN u w ON q.word != w.word)
SELECT query, word, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, word) AS rank FROM s WHERE c > 0
QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, word) <= 40""")
def nearest_words(spark, sf):
    v = cut(_wordvec(spark, sf))
    return knn.nearest(v.select(F.col("word").alias("query"), "vec"), v).select("query", "word", *_six("similarity"), F.col("rank").cast("long").alias("rank"))


def _questions(spark, sf):
    """Analogies between neighbours in the vocabulary: words of ranks 4n to 4n + 3, by parity of n in two categories."""
    c = _corpus(spark, sf)
    texts = c.select(F.col("src_text").alias("text")).unionByName(c.select(F.col("trg_text").alias("text")))
    vocab = corpus.ranked(corpus.vocabulary(F.col("text"), texts))
    n = F.floor(F.col("rank") / 4)
    words = vocab.groupBy(n.alias("n")).agg(*[F.max(F.when(F.col("rank") % 4 == k, F.col("word"))).alias(x) for k, x in enumerate("abcd")])
    return words.select(F.when(F.col("n") % 2 == 0, "family").otherwise("plural").alias("category"), "a", "b", "c", "d")


ANALOGY = f"""{VECTORS}, q AS (SELECT CASE WHEN k % 2 = 0 THEN 'family' ELSE 'plural' END AS category, max(word) FILTER (r % 4 = 0) AS a, max(word) FILTER (r % 4 = 1) AS b, max(word) FILTER (r % 4 = 2) AS c, max(word) FILTER (r % 4 = 3) AS d
  FROM (SELECT word, n - 1 AS r, (n - 1) // 4 AS k FROM vocab) GROUP BY k),
n AS (SELECT word, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS v FROM wordvec),
asked AS (SELECT q.*, list_transform(range(1, 65), lambda i: b.v[i] - a.v[i] + c.v[i]) AS u FROM q JOIN n a ON a.word = q.a JOIN n b ON b.word = q.b JOIN n c ON c.word = q.c JOIN n d ON d.word = q.d),
ans AS (SELECT category, a, b, c, d, arg_max(word, (round(list_cosine_similarity(u, v), 9), word)) AS answer FROM asked JOIN n ON word NOT IN (a, b, c) GROUP BY ALL)"""


@query(f"WITH {ANALOGY} SELECT * FROM ans")
def word_analogy(spark, sf):
    return knn.analogies(_questions(spark, sf), cut(_wordvec(spark, sf)))


@query(f"""WITH {ANALOGY}, k AS (SELECT *, CASE WHEN category = 'family' THEN 'semantic' ELSE 'syntactic' END AS kind, (upper(answer) = upper(d))::INT AS ok FROM ans)
SELECT kind, category, count(*) AS n, sum(ok)::BIGINT AS correct, round(avg(ok), 6) AS accuracy FROM k GROUP BY ROLLUP (kind, category)""")
def analogy_accuracy(spark, sf):
    return evaluate.analogy_accuracy(word_analogy(spark, sf), ["family"]).select("kind", "category", "n", "correct", *_six("accuracy"))


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("vec"))


@query("""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
s AS (SELECT id % 8 AS cluster, i, sum(vec[i]) / (count(*) + 1) AS x FROM p, range(1, 65) r(i) GROUP BY ALL),
c AS (SELECT cluster, list(x ORDER BY i) AS v FROM s GROUP BY cluster)
SELECT id, arg_max(cluster, (round(list_sum(list_transform(range(1, 65), lambda i: vec[i] * v[i])) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 12), -cluster))::INT AS cluster FROM p, c GROUP BY id""")
def kmeans_one_round(spark, sf):
    return clusters.spherical_kmeans(_points(spark, sf), 8, 64, 1)


@query()
def kmeans_ten_rounds(spark, sf):
    return clusters.spherical_kmeans(_points(spark, sf), 8, 64, 10)


@query(f"""WITH w AS (SELECT {TRG} AS w FROM corpus_pair WHERE trg_text IS NOT NULL)
SELECT w[i] AS word, w[j] AS context, count(*) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w) a, range(-2, 3) r(k), LATERAL (SELECT i + k AS j) WHERE k != 0 AND j BETWEEN 1 AND len(w) GROUP BY 1, 2""")
def skip_pairs(spark, sf):
    words = _corpus(spark, sf).select(T.tokens(F.col("trg_text")).alias("w"))
    return words.select(F.explode(links.skip_pairs(F.col("w"), 2)).alias("p")).groupBy("p.word", "p.context").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT {SRC} AS s, {TRG} AS t FROM corpus_pair WHERE src_text IS NOT NULL AND trg_text IS NOT NULL),
a AS (SELECT s[i + 1] AS word, t, i * len(t) // len(s) AS p FROM (SELECT s, t, unnest(range(0, len(s))) AS i FROM w WHERE len(t) > 0))
SELECT word, t[p + 1 + k] AS context, count(*) AS n FROM a, range(-1, 2) r(k) WHERE p + k BETWEEN 0 AND len(t) - 1 GROUP BY 1, 2""")
def cross_pairs(spark, sf):
    w = _corpus(spark, sf).filter("src_text IS NOT NULL AND trg_text IS NOT NULL").select(T.tokens(F.col("src_text")).alias("s"), T.tokens(F.col("trg_text")).alias("t"))
    at = w.withColumn("at", links.uniform(F.size("s"), F.size("t")))
    return at.select(F.explode(links.cross_pairs(F.col("s"), F.col("t"), F.col("at"), 1)).alias("p")).groupBy("p.word", "p.context").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {KEPT}, u AS (SELECT src_text, trg_text, count(*) AS copies, list_concat(['<null>'], list_distinct({SRC})) AS s, list_distinct({TRG}) AS t FROM kept_rows GROUP BY src_text, trg_text),
l AS (SELECT copies / len(s) AS c, s, unnest(t) AS t FROM u), c AS (SELECT unnest(s) AS s, t, c FROM l), g AS (SELECT s, t, sum(c) AS c FROM c GROUP BY s, t)
SELECT s AS src_word, t AS trg_word, round(c / sum(c) OVER (PARTITION BY s), 9) AS p FROM g""")
def ibm1_one_round(spark, sf):
    return corpus.ibm1(_kept(spark, sf), 1, 0.0).select("src_word", "trg_word", F.round("p", 9).alias("p"))


def _ibm1_sql(rounds: int, prune: float) -> str:
    sql = f"""WITH {KEPT}, u AS (SELECT row_number() OVER () AS pid, count(*) AS copies, list_concat(['<null>'], list_distinct({SRC})) AS s, list_distinct({TRG}) AS t FROM kept_rows GROUP BY src_text, trg_text),
l AS (SELECT pid, copies, s, unnest(t) AS t FROM (SELECT pid, copies, unnest(s) AS s, t FROM u)), q0 AS (SELECT DISTINCT s, t, 1.0::DOUBLE AS p FROM l)"""
    for k in range(1, rounds + 1):
        sql += f""",
c{k} AS (SELECT s, t, sum(copies * p / total) AS c FROM (SELECT *, sum(p) OVER (PARTITION BY pid, t) AS total FROM l JOIN q{k - 1} USING (s, t)) GROUP BY s, t),
q{k} AS (SELECT * FROM (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS p FROM c{k}) WHERE p >= {prune})"""
    return sql + f" SELECT s AS src_word, t AS trg_word, round(p, 6) AS p FROM q{rounds}"


@query(_ibm1_sql(3, 1e-7))
def ibm1_em(spark, sf):
    return corpus.ibm1(_kept(spark, sf), 3).select("src_word", "trg_word", *_six("p"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src_doc_id AS src, trg_doc_id AS dst FROM doc_align UNION SELECT DISTINCT trg_doc_id, src_doc_id FROM doc_align),
seeds AS (SELECT DISTINCT src_doc_id AS node FROM doc_align WHERE score >= 0.99),
r(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def crawl_frontier(spark, sf):
    a = table(spark, sf, "doc_align")
    edges = a.select(F.col("src_doc_id").alias("src"), F.col("trg_doc_id").alias("dst")).union(a.select("trg_doc_id", "src_doc_id")).distinct()
    return crawl.reach(edges, a.filter("score >= 0.99").select(F.col("src_doc_id").alias("node")), 3)


@query(r"""WITH r AS (SELECT record_id, target_uri, content::VARCHAR AS c FROM (SELECT DISTINCT ON (record_id) * FROM warc_record ORDER BY record_id, loaded_at DESC NULLS LAST) WHERE rec_type = 'response'),
h AS (SELECT record_id, regexp_extract(target_uri, '^[a-z]+://([^/:]+)', 1) AS host, lower(regexp_extract(split_part(c, '\x0D\x0A\x0D\x0A', 1), '(?i)Content-Type:[ ]*([^;\\]*)', 1)) AS mime,
  lower(regexp_extract(split_part(c, '\x0D\x0A\x0D\x0A', 1), '(?i)charset=([^;\\]*)', 1)) AS charset FROM r)
SELECT record_id, host, trim(mime) AS mime, nullif(charset, '') AS charset FROM h WHERE trim(mime) = 'text/html' AND host != ''""")
def response_headers(spark, sf):
    return warc.responses(warc.latest(table(spark, sf, "warc_record"))).select("record_id", "host", "mime", "charset")


@query("""SELECT DISTINCT rec_type, target_uri, octet_length(content) AS n_bytes, md5(content) AS digest FROM warc_record""")
def warc_scan(spark, sf):
    """The records written to WARC files in the shared folder and scanned again."""
    return warc.through_files(table(spark, sf, "warc_record")).select("rec_type", "target_uri", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest")).distinct()


@query()
def page_paragraphs(spark, sf):
    return warc.page_paragraphs(warc.latest(table(spark, sf, "warc_record")), 1)


@query()
def page_texts(spark, sf):
    return warc.pages(warc.latest(table(spark, sf, "warc_record"))).select("record_id", "encoding", F.posexplode("texts").alias("line_no", "text"))


@query(r"""WITH s AS (SELECT language, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM lang_sample WHERE language IS NOT NULL AND text IS NOT NULL),
g AS (SELECT language, gram, count(*) AS n FROM (SELECT language, substr(t, i, 3) AS gram FROM (SELECT language, t, unnest(range(1, length(t) - 1)) AS i FROM s)) GROUP BY ALL),
v AS (SELECT count(DISTINCT gram) AS v FROM g), tot AS (SELECT language, sum(n) AS total FROM g GROUP BY language),
lp AS (SELECT a.gram, tot.language, ln((coalesce(g.n, 0) + 0.5) / (total + 0.5 * v)) AS lp FROM (SELECT DISTINCT gram FROM g) a CROSS JOIN tot CROSS JOIN v LEFT JOIN g ON g.gram = a.gram AND g.language = tot.language),
d AS (SELECT row_id, gram, count(*) AS n FROM (SELECT row_id, substr(t, i, 3) AS gram FROM (SELECT row_id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT row_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM cc_token WHERE text IS NOT NULL))) GROUP BY ALL),
sc AS (SELECT row_id, language, sum(n * lp) AS s FROM d JOIN lp USING (gram) GROUP BY ALL)
SELECT row_id, arg_max(language, (s, language)) AS language, round(1 / sum(exp(s - m)), 4) AS confidence FROM (SELECT *, max(s) OVER (PARTITION BY row_id) AS m FROM sc) GROUP BY row_id""")
def lang_detect(spark, sf):
    web = table(spark, sf, "cc_token").filter("text IS NOT NULL").select("row_id", "text")
    top = F.try_element_at("languages", F.lit(1))
    return detect.detect(web, "text", table(spark, sf, "lang_sample")).filter(F.size("languages") > 0).select("row_id", top["language"].alias("language"), F.round(top["confidence"], 4).alias("confidence"))


@query("""SELECT DISTINCT src_doc_id AS doc_id FROM (SELECT src_doc_id FROM doc_align UNION ALL SELECT trg_doc_id FROM doc_align) WHERE src_doc_id NOT IN (SELECT row_id FROM cc_token WHERE domain IS NOT NULL)""")
def manifest_missing(spark, sf):
    a = table(spark, sf, "doc_align")
    listed = a.select(F.col("src_doc_id").alias("doc_id")).union(a.select("trg_doc_id")).distinct()
    return tsv.missing(listed, table(spark, sf, "cc_token").filter("domain IS NOT NULL").select(F.col("row_id").alias("doc_id")), "doc_id")


@query("""SELECT time_bucket(INTERVAL 1 DAY, fetched_at, TIMESTAMP '1970-01-01') AS window_start, lower(domain) AS domain, count(*) AS n FROM cc_token WHERE fetched_at IS NOT NULL AND domain IS NOT NULL GROUP BY 1, 2""")
def fetches_per_day(spark, sf):
    return late.domain_counts(table(spark, sf, "cc_token")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "domain", "n")


def _training(spark, sf):
    """Rescored candidates of supervised bins, their ranks and the features of the best."""
    src, trg, words = _docs(spark, sf, "src"), _docs(spark, sf, "trg"), _wordvec(spark, sf)
    dictionary = cut(_dictionary(spark, sf))
    found = cut(pipelines.candidates(src, trg, words, words, pipelines.Alignment(k=20)))
    return found, src, trg, dictionary


def _classified(spark, sf, fit):
    found, src, trg, dictionary = _training(spark, sf)
    scored = cut(scoring.rescore(found.select("bin", "src_doc_id", "trg_doc_id", "score"), src, trg, dictionary, 1.08, 0.28))
    by_log = scored.select("bin", "src_doc_id", "trg_doc_id", F.col("log_score").alias("score"))
    feats = cut(scoring.features(scoring.with_texts(scoring.top_one(by_log), src, trg), dictionary, 1.08, 0.28))
    model = fit(cut(classify.balance(classify.training_rows(feats, scoring.correct_rank(by_log, trg)))))
    return classify.apply(model, feats, 0.5)


@query()
def apply_mlp(spark, sf):
    return _classified(spark, sf, classify.fit_mlp)


@query()
def apply_tree(spark, sf):
    return _classified(spark, sf, classify.fit_tree)


@query()
def vectors_monolingual(spark, sf):
    return embeddings.monolingual(_kept(spark, sf).select(F.col("trg_text").alias("text")), 40)


@query()
def vectors_bilingual(spark, sf):
    return embeddings.bilingual(_kept(spark, sf), 16, 2, 1)


@query()
def extracted_web(spark, sf):
    return pipelines.extract(table(spark, sf, "warc_record"), table(spark, sf, "lang_sample"), pipelines.Extraction(text_length=60, confidence=0.9))


@query(f"""WITH v AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({TRG}) AS word FROM corpus_pair) GROUP BY word), l AS (SELECT left(word, 4) AS stem, min(word) AS lemma FROM v WHERE length(word) > 4 GROUP BY 1)
SELECT v.word, cnt, coalesce(CASE WHEN length(word) > 4 THEN lemma END, word) AS lemma FROM v LEFT JOIN l ON left(v.word, 4) = stem""")
def lemmatised_vocabulary(spark, sf):
    vocab = cut(corpus.vocabulary(F.col("trg_text"), _corpus(spark, sf)))
    long = vocab.filter(F.length("word") > 4).withColumn("stem", F.substring("word", 1, 4))
    lemmas = long.join(long.groupBy("stem").agg(F.min("word").alias("lemma")), "stem").select("word", "lemma")
    return corpus.lemmatise(vocab, lemmas).select("word", "cnt", "lemma")


@query(f"""WITH v AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({TRG}) AS word FROM corpus_pair) GROUP BY word), n AS (SELECT 1e-3 * sum(cnt) AS sn FROM v)
SELECT word, round((sqrt(cnt / sn) + 1) * sn / cnt, 6) AS keep FROM v, n""")
def subsampling_rates(spark, sf):
    vocab = corpus.vocabulary(F.col("trg_text"), _corpus(spark, sf))
    total = vocab.agg(F.sum("cnt").alias("total"))
    return vocab.join(F.broadcast(total)).select("word", F.round(embeddings.keep_probability(F.col("cnt"), F.col("total"), 1e-3), 6).alias("keep"))


@query("SELECT round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def embedding_range(spark, sf):
    return embeddings.value_range(table(spark, sf, "embeddings"), "embedding").select(*_six("least", "most", "mean"))


@query("""WITH b AS (SELECT src_doc_id, max(score) AS s FROM doc_align WHERE score IS NOT NULL GROUP BY src_doc_id)
SELECT src_doc_id, CASE WHEN s > 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, round(avg(CASE WHEN s > 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY src_doc_id // 100 ORDER BY src_doc_id), 6) AS ratio FROM b""")
def running_label_ratio(spark, sf):
    best = scoring.top_one(_candidates(spark, sf).filter("score IS NOT NULL")).withColumn("label", F.when(F.col("score") > 0.9, 1.0).otherwise(0.0))
    binned = best.withColumn("bin", F.floor(F.col("src_doc_id") / 100).cast("string"))
    return classify.running_ratio(binned).select("src_doc_id", "label", *_six("ratio"))


@query(f"""WITH w AS (SELECT id, probab, src_text, trg_text, {TRG} AS w FROM corpus_pair WHERE trg_text IS NOT NULL), p AS (SELECT DISTINCT w FROM w)
SELECT w AS words, list_transform(w, lambda x, i: CASE WHEN length(x) > 3 THEN len(list_filter(w[1:i], lambda y: length(y) > 3)) - 1 END)::INT[] AS kept FROM p""")
def kept_positions(spark, sf):
    words = _corpus(spark, sf).filter("trg_text IS NOT NULL").select(T.tokens(F.col("trg_text")).alias("words")).distinct()
    return words.select("words", corpus.kept_positions(F.col("words"), F.transform("words", lambda w: F.length(w) > 3)).alias("kept"))


def _identical(spark, sf):
    """Links between identical tokens of both sides, as a stand-in for an aligner's output."""
    w = _corpus(spark, sf).filter("src_text IS NOT NULL AND trg_text IS NOT NULL").select(
        F.xxhash64(*corpus.PAIR_ORDER).alias("pair"), T.tokens(F.col("src_text")).alias("s"), T.tokens(F.col("trg_text")).alias("t")
    ).distinct()
    found = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), (F.array_position("t", x).cast("int") - 1).alias("j"))), lambda x: x["j"] >= 0)
    back = F.filter(F.transform("t", lambda x, j: F.struct((F.array_position("s", x).cast("int") - 1).alias("i"), j.alias("j"))), lambda x: x["i"] >= 0)
    return w.select("pair", "s", "t", found.alias("forward"), back.alias("reverse"))


@query(f"""WITH w AS (SELECT row_number() OVER () AS pair, s, t FROM (SELECT DISTINCT {SRC} AS s, {TRG} AS t FROM corpus_pair WHERE src_text IS NOT NULL AND trg_text IS NOT NULL)),
p AS (SELECT pair, i - 1 AS i, nullif(list_position(t, s[i]), 0) - 1 AS j FROM (SELECT pair, s, t, unnest(range(1, len(s) + 1)) AS i FROM w)),
n AS (SELECT pair, i, j, last_value(j IGNORE NULLS) OVER (PARTITION BY pair ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(j IGNORE NULLS) OVER (PARTITION BY pair ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM p),
f AS (SELECT pair, list(coalesce(j, (a + b) // 2, a, b)::INT ORDER BY i) AS target_of FROM n GROUP BY pair)
SELECT array_to_string(s, ' ') AS src, array_to_string(t, ' ') AS trg, coalesce(target_of, []::INT[]) AS target_of FROM w LEFT JOIN f USING (pair)""")
def links_interpolated(spark, sf):
    at = links.interpolate(F.col("forward"), F.size("s"))
    return _identical(spark, sf).select(F.array_join("s", " ").alias("src"), F.array_join("t", " ").alias("trg"), at.alias("target_of")).distinct()


@query()
def links_symmetrised(spark, sf):
    return links.grow_diag_final_and(_identical(spark, sf), "pair", "forward", "reverse")


@query(f"""WITH w AS (SELECT DISTINCT id, probab, src_text, trg_text, {SRC} AS s, {TRG} AS t FROM corpus_pair WHERE src_text IS NOT NULL AND trg_text IS NOT NULL),
f AS (SELECT id, i - 1 AS i, list_position(t, s[i]) - 1 AS j FROM w, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE list_position(t, s[i]) > 0),
r AS (SELECT id, list_position(s, t[j]) - 1 AS i, j - 1 AS j FROM w, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS j) WHERE list_position(s, t[j]) > 0)
SELECT i, j, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT * FROM r)) GROUP BY i, j""")
def links_union(spark, sf):
    w = _corpus(spark, sf).filter("src_text IS NOT NULL AND trg_text IS NOT NULL")
    pairs = w.select("id", T.tokens(F.col("src_text")).alias("s"), T.tokens(F.col("trg_text")).alias("t")).distinct()
    f = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), (F.array_position("t", x).cast("int") - 1).alias("j"))), lambda x: x["j"] >= 0)
    r = F.filter(F.transform("t", lambda x, j: F.struct((F.array_position("s", x).cast("int") - 1).alias("i"), j.alias("j"))), lambda x: x["i"] >= 0)
    each = pairs.select("id", F.explode(links.union(f, r)).alias("l")).select("id", F.col("l.i").cast("long").alias("i"), F.col("l.j").cast("long").alias("j")).distinct()
    return each.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


METRICS = {
    "square": "list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i])))",
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i]))))",
    "correlation": "1 - list_cosine_similarity(a, b)",
    "angle": "acos(greatest(-1, least(1, list_cosine_similarity(a, b))))",
    "city": "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))",
    "largest": "list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))",
    "smallest": "list_min(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))",
    "minkowski3": "pow(list_sum(list_transform(range(1, 65), lambda i: pow(abs(a[i] - b[i]), 3.0))), 1.0 / 3)",
    "weighted": "list_sum(list_transform(range(1, 65), lambda i: i * (a[i] - b[i]) * (a[i] - b[i])))",
    "hamming": "list_sum(list_transform(range(1, 65), lambda i: ((a[i] > 0) != (b[i] > 0))::INT))::DOUBLE",
    "hamming_share": "list_sum(list_transform(range(1, 65), lambda i: ((a[i] > 0) != (b[i] > 0))::INT)) / 64",
    "intersection": "list_sum(list_transform(range(1, 65), lambda i: least(p[i], q[i]))) / least(list_sum(p), list_sum(q))",
    "chi_square": "list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]) / (2 * (p[i] + q[i]))))",
    "divergence": "list_sum(list_transform(range(1, 65), lambda i: p[i] * ln(p[i] / q[i])))",
    "jeffrey": "list_sum(list_transform(range(1, 65), lambda i: p[i] * ln(2 * p[i] / (p[i] + q[i])) + q[i] * ln(2 * q[i] / (p[i] + q[i]))))",
}


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: abs(x) + 0.001) AS h FROM embeddings) SELECT x.vec_id, "
       + ", ".join(f"round({f}, 6) AS {n}" for n, f in METRICS.items())
       + " FROM (SELECT l.vec_id, l.v AS a, r.v AS b, l.h AS p, r.h AS q FROM e l JOIN e r ON r.vec_id = l.vec_id + 1) x")
def vector_metrics(spark, sf):
    e = _points(spark, sf).withColumn("h", F.transform("vec", lambda x: F.abs(x) + 0.001))
    r = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"), F.col("h").alias("q"))
    a, b, p, q = F.col("vec"), F.col("b"), F.col("h"), F.col("q")
    ramp = F.array(*[F.lit(float(i)) for i in range(1, 65)])
    found = {
        "square": metrics.square_distance(a, b), "euclidean": metrics.euclidean(a, b), "correlation": metrics.correlation_distance(a, b), "angle": metrics.angle(a, b),
        "city": metrics.city_block(a, b), "largest": metrics.largest_difference(a, b), "smallest": metrics.smallest_difference(a, b), "minkowski3": metrics.minkowski(a, b, 3.0),
        "weighted": metrics.weighted_square_distance(a, b, ramp), "hamming": metrics.hamming(a, b), "hamming_share": metrics.hamming_share(a, b),
        "intersection": metrics.intersection(p, q), "chi_square": metrics.chi_square(p, q), "divergence": metrics.divergence(p, q), "jeffrey": metrics.jeffrey(p, q),
    }
    return e.join(r, "id").select(F.col("id").alias("vec_id"), *[F.round(c, 6).alias(n) for n, c in found.items()])


@query("""SELECT label, i - 1 AS position, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance
FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""")
def label_moments(spark, sf):
    got = samples.moments(table(spark, sf, "embeddings"), "embedding", "label")
    return got.select("label", F.col("position").cast("long").alias("position"), "n", *_six("mean", "variance"))


@query("""SELECT greatest(0, least(19, floor(score / 0.05)))::INT AS bin, count(*) AS n FROM doc_align WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1""")
def score_histogram(spark, sf):
    return samples.histogram(table(spark, sf, "doc_align"), F.col("score"), 0.0, 1.0, 20)


@query(f"""WITH x AS (SELECT round(probab, 3) AS score, len({SRC}) > 0 AND len({TRG}) > 0 AND src_text != trg_text AS ok FROM corpus_pair WHERE probab IS NOT NULL AND src_text IS NOT NULL AND trg_text IS NOT NULL),
s AS (SELECT score, count(*) FILTER (ok) AS p, count(*) FILTER (NOT ok) AS f FROM x GROUP BY score)
SELECT score, round(sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM s), 6) AS true_rate, round(sum(f) OVER (ORDER BY score DESC) / (SELECT sum(f) FROM s), 6) AS false_rate FROM s""")
def roc_curve(spark, sf):
    known = _corpus(spark, sf).filter("probab IS NOT NULL AND src_text IS NOT NULL AND trg_text IS NOT NULL")
    right = (F.size(T.tokens(F.col("src_text"))) > 0) & (F.size(T.tokens(F.col("trg_text"))) > 0) & (F.col("src_text") != F.col("trg_text"))
    return samples.roc(known.select(F.round("probab", 3).alias("score"), right.alias("correct"))).select("score", *_six("true_rate", "false_rate"))


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.id, q.label, k.label AS got, k.id AS other, round(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - k.v[i]) * (q.v[i] - k.v[i]))), 9) AS d FROM e q JOIN e k ON q.id != k.id WHERE q.id % 20 = 0)
SELECT id, label, arg_min(got, (d, other)) AS got FROM d GROUP BY id, label""")
def nearest_label(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", V.as_double(F.col("embedding")).alias("vec"))
    # a search takes as queries every row whose id is divisible by 20, against all rows
    return samples.nearest_label(e.filter("id % 20 = 0"), e)


@query(SQL["bench_histogram"].rpartition("SELECT mindex")[0] + "SELECT r AS rank, round(count(*) FILTER (mindex <= r) / count(*), 6) AS share FROM ranks, range(0, 10) x(r) GROUP BY r HAVING count(*) FILTER (mindex <= r) > 0")
def match_curve(spark, sf):
    found = knn.blocked(_docvec(spark, sf, "src"), _docvec(spark, sf, "trg"), block=200).select("bin", "src_doc_id", "trg_doc_id", (-F.col("knn_rank")).alias("score"))
    curve = samples.match_curve(scoring.correct_rank(found, _docs(spark, sf, "trg")), 10)
    return curve.select(F.col("rank").cast("long").alias("rank"), *_six("share"))


@query()
def principal_components(spark, sf):
    return samples.principal(_points(spark, sf), "vec", 4).select("id", "projected")


@query()
def gaussian_mixture(spark, sf):
    return samples.mixture(samples.principal(_points(spark, sf), "vec", 2).select("id", "projected"), "projected", 3).select("id", "component", "share")


@query("""WITH k AS (SELECT id, length(src_text)::DOUBLE AS x, length(trg_text)::DOUBLE AS y FROM corpus_pair WHERE src_text IS NOT NULL AND trg_text IS NOT NULL),
m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k)
SELECT id, y, round(a * x + b, 6) AS predicted FROM k, m""")
def length_regression(spark, sf):
    known = _corpus(spark, sf).filter("src_text IS NOT NULL AND trg_text IS NOT NULL")
    x = known.select("id", F.array(F.length("src_text").cast("double")).alias("x"), F.length("trg_text").cast("double").alias("y"))
    return samples.regression(x, "x", "y").select("id", "y", *_six("predicted"))


@query("SELECT concat(trg_text, ' ||| ', src_text) AS line FROM corpus_pair WHERE src_text IS NOT NULL AND trg_text IS NOT NULL")
def join_lines(spark, sf):
    return corpus.join_lines(_corpus(spark, sf))


#: The SQL of functions.text.draw for a key.
DRAW = "list_sum(list_transform(range(1, 7), lambda i: (instr('0123456789abcdef', substr(md5({k}), i, 1)) - 1) / power(16, i)))"


@query(f"""WITH d AS (SELECT DISTINCT trg_text AS x, {TRG} AS w FROM corpus_pair WHERE trg_text IS NOT NULL), o AS (SELECT x, i - 1 AS pos, w[i] AS word FROM (SELECT x, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
v AS (SELECT word, count(*) AS cnt FROM o GROUP BY word), n AS (SELECT 1e-3 * sum(cnt) AS sn FROM v)
SELECT word, count(*) AS n FROM o JOIN v USING (word), n WHERE {DRAW.format(k="concat(x, chr(9), pos::VARCHAR)")} < (sqrt(cnt / sn) + 1) * sn / cnt GROUP BY word""")
def subsampled_counts(spark, sf):
    texts = _corpus(spark, sf).filter("trg_text IS NOT NULL").select(F.col("trg_text").alias("x")).distinct()
    words = texts.select("x", F.posexplode(T.tokens(F.col("x"))).alias("at", "word"))
    vocab = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return embeddings.subsampled(words, vocab, 1e-3, "x", "at").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT DISTINCT trg_text AS x, {TRG} AS w FROM corpus_pair WHERE trg_text IS NOT NULL), o AS (SELECT x, w, unnest(range(1, len(w) + 1)) AS i FROM d),
b AS (SELECT w, i, 5 - floor({DRAW.format(k="concat(x, chr(9), (i - 1)::VARCHAR)").replace("lambda i:", "lambda z:").replace(", i, 1)", ", z, 1)").replace("power(16, i)", "power(16, z)")} * 5)::INT AS reach FROM o)
SELECT w[i] AS word, w[j] AS context, count(*) AS n FROM b, range(-5, 6) r(k), LATERAL (SELECT i + k AS j) WHERE k != 0 AND abs(k) <= reach AND j BETWEEN 1 AND len(w) GROUP BY 1, 2""")
def random_skip_pairs(spark, sf):
    texts = _corpus(spark, sf).filter("trg_text IS NOT NULL").select("trg_text").distinct()
    pairs = links.random_skip_pairs(T.tokens(F.col("trg_text")), 5, F.col("trg_text"))
    return texts.select(F.explode(pairs).alias("p")).groupBy("p.word", "p.context").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_no, lower(domain) AS d FROM cc_token), c AS (SELECT row_no, d, row_no = 0 OR d IS DISTINCT FROM lag(d) OVER (ORDER BY row_no) AS new FROM n),
g AS (SELECT row_no, d, sum(new::INT) OVER (ORDER BY row_no) AS run FROM c) SELECT min(row_no) AS first_row, count(*) AS n, any_value(d) AS value FROM g GROUP BY run""")
def bin_runs(spark, sf):
    numbered = rows.number_rows(table(spark, sf, "cc_token").select("row_id", F.lower("domain").alias("domain")), [F.col("row_id")])
    return rows.run_lengths(numbered, "domain")


@query("SELECT count(DISTINCT uri) AS uris, count(DISTINCT text) AS texts FROM cc_token")
def crawl_distinct(spark, sf):
    """Addresses and texts of the whole crawl, distinct as digests."""
    web = table(spark, sf, "cc_token")
    tagged = web.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.sha2("uri", 256).alias("v")), F.struct(F.lit(1).alias("k"), F.sha2("text", 256).alias("v")))).alias("x")).select("x.k", "x.v")
    each = tagged.filter("v IS NOT NULL").distinct()
    return each.agg(F.count(F.when(F.col("k") == 0, 1)).alias("uris"), F.count(F.when(F.col("k") == 1, 1)).alias("texts"))


@query("SELECT language, string_agg(trim(text), chr(10) ORDER BY trim(text)) AS lines, count(*) AS n FROM lang_sample WHERE trim(text) != '' GROUP BY language")
def end_marks(spark, sf):
    """Lines joined with end marks, as for an external tokeniser, and parted again."""
    marked = table(spark, sf, "lang_sample").filter("trim(text) != ''").select("language", T.end_marked(F.trim("text")).alias("x"))
    joined = marked.groupBy("language").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    parts = joined.select("language", T.at_end_marks(F.col("x")).alias("p"))
    return parts.select("language", F.array_join(F.array_sort("p"), "\n").alias("lines"), F.size("p").cast("long").alias("n"))


@query("""SELECT vec_id, i - 1 AS place, round(CASE WHEN x >= 6 THEN 1 WHEN x <= -6 THEN 0 ELSE 1 / (1 + exp(-((floor((x + 6) * (1000 / 6.0 / 2)) / 1000) * 2 - 1) * 6)) END, 6) AS y
FROM (SELECT vec_id, i, 20 * embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))""")
def sigmoid_table(spark, sf):
    each = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return each.select("vec_id", F.col("place").cast("long").alias("place"), F.round(T.sigmoid(F.col("x").cast("double") * 20), 6).alias("y"))


@query(f"""WITH v AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({TRG}) AS word FROM corpus_pair) GROUP BY word), {VECTORS.removeprefix('WITH ')}
SELECT word, round(vec[1], 6) AS first FROM wordvec WHERE word IN (SELECT word FROM v WHERE cnt >= 20)""")
def selected_words(spark, sf):
    wanted = corpus.vocabulary(F.col("trg_text"), _corpus(spark, sf)).filter("cnt >= 20")
    return embeddings.of_words(_wordvec(spark, sf), wanted).select("word", F.round(F.col("vec")[0], 6).alias("first"))


@query()
def huffman_codes(spark, sf):
    return embeddings.huffman_codes(corpus.vocabulary(F.col("trg_text"), _corpus(spark, sf)))


@query()
def page_cleaned(spark, sf):
    return warc.cleaned_pages(warc.latest(table(spark, sf, "warc_record")))


@query()
def page_links(spark, sf):
    return warc.crawl_links(warc.pages(warc.latest(table(spark, sf, "warc_record"))))
