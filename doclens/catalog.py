"""Registered queries over the driver's tables, each with the SQL that another engine runs for the same rows.

Doubles are rounded to 6 digits and ordered by the rounded value, then by key; counts are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import text as tx
from doclens.functions.image_kernels import glcm_column, histogram_column, tensor_column
from doclens.functions.stemming import stemmed_tokens, stemmed_words
from doclens.functions.stopwords import STOP_WORDS
from doclens.operators import corpus as cp
from doclens.operators import evaluate as ev
from doclens.operators import images as im
from doclens.operators import ingest as ig
from doclens.operators import layout as ly
from doclens.operators import learning as ml
from doclens.operators import machines as mc
from doclens.operators import neighbours as nb
from doclens.operators import network as nw
from doclens.operators import tfidf as tf
from doclens.operators.search import SearchIndex
from doclens.plans.ocr import ocr_results, ocr_statistics
from doclens.session import hold
from doclens.sources.corpus import documents_corpus, table, text_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Five terms that the invented prose of the documents holds.
SEARCH = {
    1: "anthe tion oron erin reed", 2: "leoi chention queau", 3: "schach heit chung einer", 4: "quemente lado ciesll",
    5: "ting ention reed", 6: "einer heit unden", 7: "ment queen paque", 8: "del que dota",
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run

    return register


W = "[ \\t\\n\\r\\f]"
STRIP = lambda c: f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"
FOLD = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 \\t\\n\\r\\f]', '', 'g'), '[0-9]+', '', 'g'), '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g')"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = lambda c: f"list_filter(string_split({FOLD(f'coalesce({c}, chr(32))')}, ' '), lambda w: len(w) > 1 AND NOT list_contains({STOP}, w))"
CORPUS = f"corpus AS (SELECT doc_id, lang AS class, lang || '/' || lang || '_' || lpad(doc_id::VARCHAR, greatest(5, len(doc_id::VARCHAR))::INT, '0') || '.txt' AS path, {STRIP('text')} AS text FROM documents WHERE len({STRIP('text')}) >= 1)"
TOK = f"{CORPUS}, toks AS MATERIALIZED (SELECT doc_id, class, path, text, {TOKENS('text')} AS w FROM corpus)"
POST = f"{TOK}, post AS MATERIALIZED (SELECT doc_id, class, term, count(*) AS tf FROM (SELECT doc_id, class, unnest(w) AS term FROM toks) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM toks WHERE len(w) > 0)"
BAND = "band AS (SELECT term, count(*) AS df FROM post GROUP BY term HAVING count(*) >= 2 AND count(*) <= (SELECT floor(n * 0.95) FROM nd))"
GRAMS = f"{CORPUS}, uni AS (SELECT doc_id, class, path, text, {TOKENS('text')} AS w FROM corpus), toks AS MATERIALIZED (SELECT doc_id, class, path, text, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS w FROM uni), post AS MATERIALIZED (SELECT doc_id, class, term, count(*) AS tf FROM (SELECT doc_id, class, unnest(w) AS term FROM toks) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM toks)"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return documents_corpus(spark, d)


def words() -> F.Column:
    return tx.tokens(F.col("text"))


def grams() -> F.Column:
    return tx.ngrams(F.col("w"), 1, 2)


def posted(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """The corpus is tokenised once; all that a query needs comes from this table."""
    return hold(tf.postings(corpus(spark, d), words(), *keep))


def posted_grams(spark: SparkSession, d: str) -> DataFrame:
    return hold(tf.postings(corpus(spark, d).withColumn("w", words()), grams()))


# ---- scans, classes, counts -------------------------------------------------------------------------------------


@query("s4_corpus_scan", f"WITH {CORPUS} SELECT doc_id, class, path, len(text)::BIGINT AS n FROM corpus")
def _(spark, d):
    return corpus(spark, d).select("doc_id", "class", "path", F.length("text").cast("long").alias("n"))


@query("s6_min_length_scan", f"WITH {CORPUS} SELECT class, count(*)::BIGINT AS n_docs FROM corpus WHERE len(text) >= 10 GROUP BY class")
def _(spark, d):
    return documents_corpus(spark, d, 10).groupBy("class").agg(F.count(F.lit(1)).alias("n_docs"))


@query("a1_class_rollup", f"WITH {CORPUS} SELECT coalesce(class, 'TOTAL') AS class, count(*)::BIGINT AS n_docs FROM corpus GROUP BY ROLLUP (class)")
def _(spark, d):
    counts = corpus(spark, d).rollup("class").agg(F.grouping("class").alias("whole"), F.count(F.lit(1)).alias("n_docs"))
    return counts.select(F.when(F.col("whole") == 1, "TOTAL").otherwise(F.col("class")).alias("class"), "n_docs")


@query("a13_label_counts", "SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY label ORDER BY label")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")


@query("s12_parquet_scan", "SELECT event_type AS class, count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("s13_filtered_first", "SELECT vec_id, label FROM embeddings WHERE label = 7 ORDER BY vec_id LIMIT 1")
def _(spark, d):
    return table(spark, d, "embeddings").filter("label = 7").orderBy("vec_id").limit(1).select("vec_id", "label")


@query("f10_label_range", "SELECT vec_id, label FROM embeddings WHERE label BETWEEN 0 AND 6 AND label IN (1, 3, 5, 9)")
def _(spark, d):
    return table(spark, d, "embeddings").filter(F.col("label").between(0, 6) & F.col("label").isin(1, 3, 5, 9)).select("vec_id", "label")


# ---- text and weights -------------------------------------------------------------------------------------------


@query("x1_normalized_tokens", f"WITH {TOK} SELECT doc_id, coalesce(array_to_string(w, ' '), '') AS normalized, len(w)::BIGINT AS n_tokens FROM toks")
def _(spark, d):
    w = corpus(spark, d).select("doc_id", words().alias("w"))
    return w.select("doc_id", F.array_join("w", " ").alias("normalized"), F.size("w").cast("long").alias("n_tokens"))


@query("x13_word_pattern", "SELECT doc_id, len(regexp_extract_all(lower(text), '([a-z0-9_][a-z0-9_]+)', 1))::BIGINT AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.word_pattern_tokens(F.col("text"))).cast("long").alias("n"))


@query("x14_bigrams", f"WITH {GRAMS} SELECT term AS bigram, sum(tf)::BIGINT AS n FROM post WHERE contains(term, ' ') GROUP BY term HAVING sum(tf) >= 2")
def _(spark, d):
    docs = corpus(spark, d).select("doc_id", words().alias("w"))
    return docs.select(F.explode(tx.ngrams(F.col("w"), 2, 2)).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("a2_document_frequency", f"WITH {POST} SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term")
def _(spark, d):
    return tf.document_frequency(posted(spark, d))


@query("x4_vocabulary", f"WITH {POST}, {BAND} SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id, df::BIGINT AS df FROM band")
def _(spark, d):
    post = posted(spark, d)
    return tf.with_term_ids(tf.vocabulary(tf.document_frequency(post), tf.document_count(post))).select("term", "term_id", "df")


@query("a5_vocab_stats", f"WITH {POST}, {BAND} SELECT (SELECT count(DISTINCT term) FROM post)::BIGINT AS total, (SELECT count(*) FROM band)::BIGINT AS kept, ((SELECT count(DISTINCT term) FROM post) - (SELECT count(*) FROM band))::BIGINT AS dropped")
def _(spark, d):
    post = posted(spark, d)
    df, n = tf.document_frequency(post), tf.document_count(post)
    kept = F.col("df").between(2, int(n * 0.95))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


@query("x5_tf", f"WITH {POST}, {BAND} SELECT doc_id, term, tf::BIGINT AS tf FROM post SEMI JOIN band USING (term)")
def _(spark, d):
    post = posted(spark, d)
    return post.join(tf.vocabulary(tf.document_frequency(post), tf.document_count(post)), "term", "left_semi").select("doc_id", "term", "tf")


@query("x6_idf_log10", f"WITH {POST}, {BAND} SELECT term, round(log10(n::DOUBLE / greatest(df, 1)) + 1, 6) AS idf FROM band, nd")
def _(spark, d):
    post = posted(spark, d)
    n = tf.document_count(post)
    return tf.vocabulary(tf.document_frequency(post), n).select("term", F.round(tf.idf_log10(F.col("df"), n), 6).alias("idf"))


@query("a7_idf_stats", f"WITH {POST}, {BAND}, i AS (SELECT log10(n::DOUBLE / df) + 1 AS idf FROM band, nd) SELECT round(min(idf), 6) AS idf_min, round(max(idf), 6) AS idf_max, round(avg(idf), 6) AS idf_mean FROM i")
def _(spark, d):
    post = posted(spark, d)
    n = tf.document_count(post)
    idf = tf.vocabulary(tf.document_frequency(post), n).select(tf.idf_log10(F.col("df"), n).alias("idf"))
    return idf.agg(F.round(F.min("idf"), 6).alias("idf_min"), F.round(F.max("idf"), 6).alias("idf_max"), F.round(F.avg("idf"), 6).alias("idf_mean"))


COURSE = f"{POST}, {BAND}, course AS (SELECT doc_id, class, term, tf * (log10(n::DOUBLE / df) + 1) AS tfidf FROM post JOIN band USING (term), nd)"


def _course(spark, d, *keep):
    post = posted(spark, d, *keep)
    n = tf.document_count(post)
    return tf.course_tfidf(post, tf.vocabulary(tf.document_frequency(post), n), n)


@query("x7_tfidf_course", f"WITH {COURSE} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM course")
def _(spark, d):
    return _course(spark, d).select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query("x8_tfidf_unsmoothed", f"WITH {POST}, nall AS (SELECT count(*) AS n FROM toks), top AS (SELECT term, count(*) AS df, sum(tf) AS c FROM post GROUP BY term ORDER BY c DESC, term LIMIT 5000) SELECT doc_id, term, round(tf * (ln(n::DOUBLE / df) + 1), 6) AS weight FROM post JOIN top USING (term), nall")
def _(spark, d):
    post = posted(spark, d)
    v = tf.Vectorizer(sublinear=False, smooth=False, l2=False)
    return v.transform(post, v.fit(post, corpus(spark, d).count())).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _weights(features: int, sublinear: bool, source: str = "post", n: str = "nd") -> str:
    w = "(1 + ln(tf))" if sublinear else "tf"
    return f"top AS (SELECT term, count(*) AS df, sum(tf) AS c FROM {source} GROUP BY term ORDER BY c DESC, term LIMIT {features}), raw AS (SELECT doc_id, class, term, {w} * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x FROM post JOIN top USING (term), {n}), vec AS MATERIALIZED (SELECT doc_id, class, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"


@query("x9_tfidf_l2_sublinear", f"WITH {GRAMS}, {_weights(5000, True)} SELECT doc_id, term, round(weight, 6) AS weight FROM vec")
def _(spark, d):
    v, post = tf.Vectorizer(), posted_grams(spark, d)
    return v.transform(post, v.fit(post, corpus(spark, d).count())).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("a6_sparsity", f"WITH {POST}, {BAND}, s AS (SELECT (SELECT n FROM nd) AS n, (SELECT count(*) FROM band) AS v, (SELECT count(*) FROM post SEMI JOIN band USING (term)) AS z) SELECT n::BIGINT AS n_docs, v::BIGINT AS n_terms, z::BIGINT AS nnz, round((1 - z / (n * v)::DOUBLE) * 100, 6) AS sparsity FROM s")
def _(spark, d):
    post = posted(spark, d)
    n = tf.document_count(post)
    vocab = tf.vocabulary(tf.document_frequency(post), n)
    return tf.matrix_stats(post.join(vocab, "term", "left_semi"), n, vocab.count())


@query("x16_top_terms_per_class", f"WITH {COURSE}, sizes AS (SELECT class, count(*) AS k FROM toks GROUP BY class), m AS (SELECT class, term, round(sum(tfidf) / any_value(k), 6) AS score FROM course JOIN sizes USING (class) GROUP BY class, term), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, term) AS rank FROM m) SELECT class, rank::INTEGER AS rank, term, score FROM r WHERE rank <= 10 AND score > 0")
def _(spark, d):
    sizes = corpus(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n_docs"))
    return tf.top_terms(tf.class_term_means(_course(spark, d, "class"), sizes)).select("class", "rank", "term", "score")


def _search_sql(queries: dict[int, str] | None = None, source: str = "") -> str:
    rows = ", ".join(f"({k}, '{q}')" for k, q in (queries or {}).items())
    source = source or f"(VALUES {rows}) t(query_id, query)"
    asked = f"q AS (SELECT query_id, {TOKENS('query')} AS w FROM {source}), qg AS (SELECT query_id, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS w FROM q), qp AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(w) AS term FROM qg) GROUP BY ALL), qx AS (SELECT query_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x FROM qp JOIN top USING (term), nd), qv AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS q FROM qx)"
    return f"WITH {GRAMS}, {_weights(5000, True)}, {asked}, s AS (SELECT query_id, doc_id, round(sum(weight * q), 6) AS similarity FROM vec JOIN qv USING (term) GROUP BY query_id, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s WHERE similarity > 0) SELECT query_id, rank::INTEGER AS rank, doc_id, class, path, similarity, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM r JOIN corpus USING (doc_id) WHERE rank <= 5"


def search(spark: SparkSession, d: str, queries: dict[int, str] | DataFrame, k: int = 5, tokens: Callable[[F.Column], F.Column] = tx.tokens) -> DataFrame:
    """The k best documents a query (query_id, query); with stemmed tokens as the application searches, or plain ones."""
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    index = SearchIndex.build(corpus(spark, d).withColumn("w", tokens(F.col("text"))), grams())
    return index.search(queries.withColumn("w", tokens(F.col("query"))), grams(), k)


@query("x17_search_topk", _search_sql({1: SEARCH[1]}))
def x17_search_topk(spark, d):
    return search(spark, d, {1: SEARCH[1]})


@query("x18_batch_search", _search_sql(SEARCH))
def _(spark, d):
    return search(spark, d, SEARCH)


@query("x18_document_search", _search_sql(source="(SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 50 = 0)"))
def _(spark, d):
    """Every document whose id is divisible by 50 as a query, against all documents."""
    return search(spark, d, table(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))


@query("x3_stemmed_search")
def _(spark, d):
    """The batch of searches as the application runs them: texts and queries are stemmed."""
    return search(spark, d, SEARCH, tokens=stemmed_words)


@query("x2_stemmed_tokens")
def _(spark, d):
    """The whole normalisation, stems included; a document without tokens stays, with an empty text."""
    return stemmed_tokens(corpus(spark, d).select("doc_id", words().alias("w")))


# ---- splits, scalers, classifiers -------------------------------------------------------------------------------

SPLIT = lambda rows, key, share: f"sz AS (SELECT class, count(*) AS n FROM {rows} GROUP BY class), qb AS (SELECT class, n, n * {share} // 1000 AS base, n * {share} % 1000 AS rest FROM sz), qt AS (SELECT class, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, class) <= ((SELECT sum(n) FROM sz) * {share} + 999) // 1000 - (SELECT sum(base) FROM qb) THEN 1 ELSE 0 END AS quota FROM qb), sp AS MATERIALIZED (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.class ORDER BY md5({key}::VARCHAR || '-42'), {key}) <= quota THEN 'test' ELSE 'train' END AS part FROM {rows} s JOIN qt USING (class))"


@query("m1_split_quota", f"WITH {CORPUS}, {SPLIT('corpus', 'doc_id', 200)} SELECT class, n::BIGINT AS n, quota::BIGINT AS quota FROM qt")
def _(spark, d):
    return ml.split_quotas(corpus(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")))


@query("m1_stratified_split", f"WITH {CORPUS}, {SPLIT('corpus', 'doc_id', 200)} SELECT doc_id, class, part FROM sp")
def _(spark, d):
    return ml.stratified_split(hold(corpus(spark, d).select("doc_id", "class")))


@query("m2_split_75_25", f"WITH {CORPUS}, {SPLIT('corpus', 'doc_id', 250)} SELECT doc_id, class, part FROM sp")
def _(spark, d):
    return ml.stratified_split(hold(corpus(spark, d).select("doc_id", "class")), test_tenths_of_percent=250)


TRAIN = f"{GRAMS}, {SPLIT('toks', 'doc_id', 200)}, tp AS (SELECT * FROM post WHERE doc_id IN (SELECT doc_id FROM sp WHERE part = 'train')), nt AS (SELECT count(*) AS n FROM sp WHERE part = 'train')"


def _train_weights(spark: SparkSession, d: str, v: tf.Vectorizer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split documents (doc_id, class, part), weights of all of them fitted on the training part, and the vocabulary."""
    keys = hold(corpus(spark, d).select("doc_id", "class"))
    part = ml.split_part(keys)
    docs = keys.withColumn("part", part)
    rows, repeat = corpus(spark, d).withColumn("w", words()).withColumn("part", part), tf.counted_ids(keys)[1]
    idf = hold(tf.fitted(rows.filter("part = 'train'"), grams(), v, docs.filter("part = 'train'").count(), repeat))
    return docs, tf.weighted(rows, grams(), v, idf, repeat, "class", "part"), idf


@query("x10_tfidf_train_only", f"WITH {TRAIN}, {_weights(3000, True, 'tp', 'nt')} SELECT doc_id, term, round(weight, 6) AS weight FROM vec")
def _(spark, d):
    return _train_weights(spark, d, tf.Vectorizer(3000))[1].select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("x11_tfidf_train_plain_tf", f"WITH {TRAIN}, {_weights(3000, False, 'tp', 'nt')} SELECT doc_id, term, round(weight, 6) AS weight FROM vec")
def _(spark, d):
    return _train_weights(spark, d, tf.Vectorizer(3000, sublinear=False))[1].select("doc_id", "term", F.round("weight", 6).alias("weight"))


UNI = f"{TOK}, post AS MATERIALIZED (SELECT doc_id, class, term, count(*) AS tf FROM (SELECT doc_id, class, unnest(w) AS term FROM toks) GROUP BY ALL), {SPLIT('toks', 'doc_id', 250)}, tp AS (SELECT * FROM post WHERE doc_id IN (SELECT doc_id FROM sp WHERE part = 'train')), nt AS (SELECT count(*) AS n FROM sp WHERE part = 'train')"


@query("x12_tfidf_unigrams", f"WITH {UNI}, {_weights(3000, False, 'tp', 'nt')} SELECT doc_id, term, round(weight, 6) AS weight FROM vec")
def _(spark, d):
    keys = hold(corpus(spark, d).select("doc_id", "class"))
    part = ml.split_part(keys, test_tenths_of_percent=250)
    docs, post = keys.withColumn("part", part), hold(tf.postings(corpus(spark, d).withColumn("part", part), words(), "part"))
    v = tf.Vectorizer(3000, sublinear=False)
    idf = v.fit(post.filter("part = 'train'"), docs.filter("part = 'train'").count())
    return v.transform(post, idf).select("doc_id", "term", F.round("weight", 6).alias("weight"))


NB = f"{TRAIN}, {_weights(3000, False, 'tp', 'nt')}, cls AS (SELECT class, count(*) AS k FROM sp WHERE part = 'train' GROUP BY class), cw AS (SELECT class, term, sum(weight) AS v FROM vec WHERE doc_id IN (SELECT doc_id FROM sp WHERE part = 'train') GROUP BY ALL), mass AS (SELECT class, sum(v) AS m FROM cw GROUP BY class), lp AS MATERIALIZED (SELECT c.class AS guess, t.term, ln((coalesce(v, 0) + 1) / (coalesce(m, 0) + (SELECT count(*) FROM top))) AS l FROM cls c CROSS JOIN top t LEFT JOIN cw ON cw.class = c.class AND cw.term = t.term LEFT JOIN mass ON mass.class = c.class), sc AS (SELECT doc_id, guess, sum(weight * l) AS s FROM vec JOIN lp USING (term) GROUP BY ALL), full_ AS (SELECT sp.doc_id, sp.class, cls.class AS guess, round(coalesce(s, 0) + ln(k / (SELECT n FROM nt)::DOUBLE), 6) AS s FROM sp CROSS JOIN cls LEFT JOIN sc ON sc.doc_id = sp.doc_id AND sc.guess = cls.class WHERE part = 'test'), nb AS (SELECT doc_id, class AS label, guess AS predicted FROM full_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, guess) = 1)"


def nb_predictions(spark: SparkSession, d: str) -> DataFrame:
    docs, weights, idf = _train_weights(spark, d, tf.Vectorizer(3000, sublinear=False))
    model = ml.multinomial_nb(weights.filter("part = 'train'"), docs.filter("part = 'train'"), idf)
    found = ml.nb_predictions(weights.filter("part = 'test'"), docs.filter("part = 'test'"), model)
    return found.select("doc_id", F.col("class").alias("label"), "predicted")


@query("m9_multinomial_nb_predict", f"WITH {NB} SELECT * FROM nb")
def _(spark, d):
    return nb_predictions(spark, d)


EMB = "emb AS (SELECT vec_id, label AS class, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("label").alias("class"), F.col("embedding").alias("vector"))


def split_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = ml.stratified_split(vectors(spark, d), "vec_id")
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


def _exploded(scaled: DataFrame) -> DataFrame:
    return scaled.select("vec_id", F.posexplode("vector").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


@query("m3_standard_scale", f"WITH {EMB}, {SPLIT('emb', 'vec_id', 200)}, e AS (SELECT vec_id, part, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM sp), st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE part = 'train' GROUP BY pos) SELECT vec_id, pos::INTEGER AS pos, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS x FROM e JOIN st USING (pos)")
def _(spark, d):
    train, _ = split_vectors(spark, d)
    return _exploded(ml.standard_scaled(vectors(spark, d), train))


@query("m4_minmax_scale", f"WITH {EMB}, e AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM emb), st AS (SELECT pos, min(x) AS a, max(x) AS b FROM e GROUP BY pos) SELECT vec_id, pos::INTEGER AS pos, round(CASE WHEN a = b THEN 0 ELSE (x - a) / (b - a) END, 6) AS x FROM e JOIN st USING (pos)")
def _(spark, d):
    return _exploded(ml.minmax_scaled(vectors(spark, d), vectors(spark, d)))


KNN = f"{EMB}, {SPLIT('emb', 'vec_id', 200)}, dist AS (SELECT t.vec_id, t.label, r.vec_id AS t_id, r.label AS t_label, round(list_sum(list_transform(range(1, len(t.v) + 1), lambda i: (t.v[i] - r.v[i]) * (t.v[i] - r.v[i]))), 9) AS dd FROM sp t, sp r WHERE t.part = 'test' AND r.part = 'train'), best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd, t_id) <= 5), votes AS (SELECT vec_id, label, t_label, count(*) AS c FROM best GROUP BY ALL), knn AS (SELECT vec_id, label, t_label AS predicted FROM votes QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, t_label) = 1)"


def knn(spark: SparkSession, d: str) -> DataFrame:
    train, test = split_vectors(spark, d)
    return nb.knn_predictions(train, test)


@query("m6_lbp_knn_predict")
def _(spark, d):
    """The five nearest by local binary patterns, scaled on the training part."""
    rows = hold(ml.stratified_split(lbp_vectors(spark, d), "vec_id"))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    return nb.knn_predictions(ml.standard_scaled(train, train), ml.standard_scaled(test, train))


@query("m6_knn_predict", f"WITH {KNN} SELECT vec_id, label, predicted FROM knn")
def _(spark, d):
    return knn(spark, d)


@query("j8_fusion_keyed", f"WITH {CORPUS}, {EMB} SELECT doc_id, label, len(list_concat(v, [len(text)::DOUBLE]))::BIGINT AS width, round(list_sum(v) + len(text), 4) AS total FROM corpus JOIN emb ON doc_id = vec_id")
def _(spark, d):
    docs = corpus(spark, d).select(F.col("doc_id"), F.array(F.length("text").cast("double")).alias("t"))
    fused = docs.join(vectors(spark, d), F.col("doc_id") == F.col("vec_id")).withColumn("v", ml.fused_vector(F.col("vector"), F.col("t")))
    return fused.select("doc_id", "label", F.size("v").cast("long").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("p9_j8_fusion_positional", f"WITH {CORPUS}, a AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM corpus) SELECT vec_id, doc_id, label FROM a JOIN b USING (rn)")
def _(spark, d):
    return ml.positional_fusion(vectors(spark, d).select("vec_id", "label"), corpus(spark, d).select("doc_id"), "vec_id", "doc_id").select("vec_id", "doc_id", "label")


# ---- evaluation -------------------------------------------------------------------------------------------------

PRED = f"{KNN}, p AS MATERIALIZED (SELECT 'knn' AS model, label, predicted FROM knn UNION ALL SELECT 'parity', label, CASE WHEN vec_id % 2 = 0 THEN label ELSE (label + 1) % 10 END FROM sp WHERE part = 'test' UNION ALL SELECT 'constant', label, 0 FROM sp WHERE part = 'test')"
LABELS = "lb AS (SELECT DISTINCT model, unnest([label, predicted]) AS c FROM p), cm AS MATERIALIZED (SELECT a.model, a.c AS actual, b.c AS predicted, (SELECT count(*) FROM p WHERE p.model = a.model AND p.label = a.c AND p.predicted = b.c) AS n FROM lb a JOIN lb b ON a.model = b.model)"
REP = "rp AS MATERIALIZED (SELECT model, class, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM (SELECT r.model, r.c AS class, CASE WHEN k = 0 THEN 0 ELSE h / k::DOUBLE END AS precision, CASE WHEN s = 0 THEN 0 ELSE h / s::DOUBLE END AS recall, s AS support FROM (SELECT model, actual AS c, sum(n) AS s, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS h FROM cm GROUP BY ALL) r JOIN (SELECT model, predicted AS c, sum(n) AS k FROM cm GROUP BY ALL) q ON r.model = q.model AND r.c = q.c))"
METRICS = "mt AS (SELECT model, CASE model WHEN 'knn' THEN 'visual' ELSE 'rule' END AS kind, CASE model WHEN 'knn' THEN 0 WHEN 'parity' THEN 1 ELSE 2 END AS ord, round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, any_value(pr) AS precision, any_value(rc) AS recall, any_value(f) AS f1 FROM p JOIN (SELECT model, round(avg(precision), 6) AS pr, round(avg(recall), 6) AS rc, round(avg(f1), 6) AS f FROM rp GROUP BY model) USING (model) GROUP BY model)"
FULL = f"WITH {PRED}, {LABELS}, {REP}, {METRICS}"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    _, test = split_vectors(spark, d)
    other = lambda name, p: test.select(F.lit(name).alias("model"), "label", p.cast("int").alias("predicted"))
    parity = F.when(F.col("vec_id") % 2 == 0, F.col("label")).otherwise((F.col("label") + 1) % 10)
    return hold(knn(spark, d).select(F.lit("knn").alias("model"), "label", "predicted").unionByName(other("parity", parity)).unionByName(other("constant", F.lit(0))))  # reports read them several times


def metrics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("model") == "knn", "visual").otherwise("rule")
    order = F.when(F.col("model") == "knn", 0).when(F.col("model") == "parity", 1).otherwise(2)
    return ev.model_metrics(predictions(spark, d)).select("model", kind.alias("kind"), order.alias("ord"), "accuracy", "precision", "recall", "f1")


@query("e1_accuracy", f"WITH {PRED} SELECT model, round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM p GROUP BY model")
def _(spark, d):
    return ev.accuracy(predictions(spark, d))


@query("e2_confusion", f"{FULL} SELECT model, actual, predicted, n::BIGINT AS n FROM cm")
def _(spark, d):
    return ev.confusion(predictions(spark, d))


@query("e3_class_report", f"{FULL} SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM rp")
def _(spark, d):
    report = ev.class_report(ev.confusion(predictions(spark, d)))
    return report.select("model", "class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("e4_macro", f"{FULL} SELECT model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM rp GROUP BY model")
def _(spark, d):
    return ev.macro(ev.class_report(ev.confusion(predictions(spark, d)))).select("model", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("e6_report", f"{FULL} SELECT model, class::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM rp UNION ALL SELECT model, 'accuracy', NULL, NULL, round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), 6), count(*) FROM p GROUP BY model UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM rp GROUP BY model UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM rp GROUP BY model")
def _(spark, d):
    return ev.full_report(predictions(spark, d))


@query("e8_model_comparison", f"{FULL} SELECT model, kind, accuracy, precision, recall, f1, row_number() OVER (ORDER BY accuracy DESC, ord) AS position FROM mt")
def _(spark, d):
    return ev.comparison(metrics(spark, d)).drop("ord")


@query("e9_radar", f"{FULL}, b AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY kind ORDER BY accuracy DESC, ord) = 1) SELECT kind, model, metric, value FROM (UNPIVOT (SELECT kind, model, accuracy, precision, recall, f1 FROM b) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)")
def _(spark, d):
    return ev.radar(metrics(spark, d)).select("kind", "model", "metric", "value")


@query("e10_best_per_kind", f"{FULL} SELECT kind, model, accuracy, f1 FROM mt QUALIFY row_number() OVER (PARTITION BY kind ORDER BY accuracy DESC, ord) = 1")
def _(spark, d):
    return ev.best_per_kind(metrics(spark, d)).select("kind", "model", "accuracy", "f1")


@query("e12_training_curve", "SELECT min(epoch) AS epoch, val_accuracy FROM (SELECT event_id % 15 AS epoch, round(avg(value), 6) AS val_accuracy FROM events GROUP BY 1) GROUP BY val_accuracy ORDER BY val_accuracy DESC LIMIT 1")
def _(spark, d):
    history = table(spark, d, "events").groupBy((F.col("event_id") % 15).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("val_accuracy"))
    return ev.best_epoch(history)


@query("e12_curve", "WITH h AS (SELECT event_id % 15 AS epoch, round(avg(value), 6) AS val_accuracy FROM events GROUP BY 1) SELECT epoch, val_accuracy, max(val_accuracy) OVER (ORDER BY epoch) AS best_so_far, val_accuracy > coalesce(max(val_accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS improved FROM h")
def _(spark, d):
    history = table(spark, d, "events").groupBy((F.col("event_id") % 15).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("val_accuracy"))
    return ev.training_curve(history)


# ---- images -----------------------------------------------------------------------------------------------------

PIX = "px AS MATERIALIZED (SELECT vec_id AS img_id, label, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, CASE WHEN hi = lo THEN 0 ELSE floor((embedding[i]::DOUBLE - lo) / (hi - lo) * 255)::INT END AS v FROM (SELECT vec_id, label, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, unnest(range(1, 65)) AS i FROM embeddings))"


def images(spark: SparkSession, d: str) -> DataFrame:
    return im.grey_images(table(spark, d, "embeddings"))


HIST = f"{PIX}, hs AS (SELECT i.img_id, b.v, round(coalesce(n, 0) / 64.0::DOUBLE, 6) AS freq FROM (SELECT DISTINCT img_id FROM px) i CROSS JOIN (SELECT unnest(range(0, 256)) AS v) b LEFT JOIN (SELECT img_id, v, count(*) AS n FROM px GROUP BY ALL) c ON c.img_id = i.img_id AND c.v = b.v)"


@query("i3_intensity_histogram", f"WITH {HIST} SELECT img_id, v::INTEGER AS v, freq FROM hs")
def _(spark, d):
    return im.image_histograms(images(spark, d))


@query("a12_class_histogram_profile", f"WITH {HIST} SELECT label, v::INTEGER AS v, round(avg(freq), 8) AS mean, round(stddev_pop(freq), 8) AS deviation, round(greatest(avg(freq) - stddev_pop(freq), 0), 8) AS lower FROM hs JOIN embeddings ON vec_id = img_id GROUP BY label, v")
def _(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), "label")
    return im.class_profile(im.image_histograms(images(spark, d)), labels)


GLCM = " UNION ALL ".join(f"SELECT img_id, {dy} AS dy, {dx} AS dx, a.i, b.i AS j FROM q a JOIN q b USING (img_id) WHERE b.y = a.y + {dy} AND b.x = a.x + {dx}" for dy, dx in sorted(set(im.OFFSETS)))


@query("i2_glcm_features", f"WITH {PIX}, q AS (SELECT img_id, y, x, v // 4 AS i FROM px), o AS ({GLCM}), s AS (SELECT img_id, dy, dx, i, j FROM o UNION ALL SELECT img_id, dy, dx, j, i FROM o), c AS (SELECT img_id, dy, dx, i, j, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY img_id, dy, dx)::DOUBLE AS p FROM c), g AS (SELECT img_id, dy, dx, sum(p * (i - j) * (i - j)) AS a, sum(p * abs(i - j)) AS b, sum(p / (1 + (i - j) * (i - j))) AS h, sqrt(sum(p * p)) AS e, sum(p * i) AS m, sum(p * i * i) AS q2, sum(p * i * j) AS ij FROM p GROUP BY ALL) SELECT img_id, dy, dx, round(a, 6) AS contrast, round(b, 6) AS dissimilarity, round(h, 6) AS homogeneity, round(e, 6) AS energy, round(CASE WHEN q2 - m * m < 1e-12 THEN 1 ELSE (ij - m * m) / (q2 - m * m) END, 6) AS correlation FROM g")
def _(spark, d):
    return im.image_glcm(images(spark, d), 8)


@query("i5_otsu_threshold", f"WITH {PIX}, c AS (SELECT img_id, v, count(*) AS n FROM px GROUP BY ALL), u AS (SELECT img_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY img_id) AS t, sum(n * v) OVER (PARTITION BY img_id) AS s FROM c WINDOW w AS (PARTITION BY img_id ORDER BY v)), b AS (SELECT img_id, v, CASE WHEN t = w0 THEN 0 ELSE round(w0 * (t - w0) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (t - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (t - w0)), 6) END AS x FROM u) SELECT img_id, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY x DESC, v) = 1")
def _(spark, d):
    return im.image_otsu(images(spark, d))


@query("p12_quantise_argmax", f"WITH {PIX} SELECT img_id, sum(v // 4)::BIGINT AS levels, round(sum(v / 255.0::DOUBLE), 6) AS scaled, min(y * 8 + x) FILTER (WHERE v = 255)::INTEGER AS brightest FROM px GROUP BY img_id")
def _(spark, d):
    total = lambda f, zero: F.aggregate(F.transform("pixels", f), zero, lambda s, x: s + x)
    return images(spark, d).select("img_id", total(lambda v: F.floor(v / 4).cast("long"), F.lit(0).cast("long")).alias("levels"), F.round(total(lambda v: v / 255, F.lit(0.0)), 6).alias("scaled"), im.first_argmax(F.col("pixels")).alias("brightest"))


@query("i1_lbp")
def _(spark, d):
    from doclens.functions.image_kernels import lbp_column

    return images(spark, d).select("img_id", "label", lbp_column(F.col("pixels"), 8).alias("lbp"))


@query("i4_preprocess")
def _(spark, d):
    from doclens.functions.image_kernels import preprocess_column

    return images(spark, d).select("img_id", preprocess_column(F.col("pixels"), 8, 16).alias("pixels"))


# ---- ingestion, manifests, names --------------------------------------------------------------------------------


@query("w1_class_quota", "SELECT event_id, event_type AS class FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 100")
def _(spark, d):
    return ig.class_cap(table(spark, d, "events"), "event_type", ["event_id"], 100).select("event_id", F.col("event_type").alias("class"))


@query("w2_file_numbering", "SELECT event_id, n, event_type || '_' || lpad(n::VARCHAR, greatest(5, len(n::VARCHAR))::INT, '0') || '.jpg' AS file_name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) + CASE WHEN event_type = 'click' THEN 7 ELSE 0 END AS n FROM events)")
def _(spark, d):
    have = spark.createDataFrame([("click", 7)], "event_type string, n long")
    return ig.numbered_files(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], have).select("event_id", "n", "file_name")


@query("j12_topup_deficit", "SELECT class, coalesce(n, 0)::BIGINT AS existing, greatest(2000 - coalesce(n, 0), 0)::BIGINT AS missing FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'view']) AS class) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) ON class = event_type")
def _(spark, d):
    classes = spark.createDataFrame([(c,) for c in ("click", "error", "purchase", "refund", "view")], "class string")
    return ig.deficits(table(spark, d, "events").select(F.col("event_type").alias("class")), classes, 2000)


@query("a19_quota_reached", "SELECT bool_and(n >= 1000) AS reached FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").count().agg(F.every(F.col("count") >= 1000).alias("reached"))


@query("j4_resume_anti", f"WITH {CORPUS} SELECT doc_id, path FROM corpus ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND n_chars > 500) USING (doc_id)")
def _(spark, d):
    done = table(spark, d, "documents").filter("doc_id % 3 = 0").select("doc_id", F.col("n_chars").alias("size"))
    return ig.pending(corpus(spark, d), done, "doc_id", 501).select("doc_id", "path")


@query("j6_three_way_semi", f"WITH {CORPUS} SELECT doc_id, path FROM corpus SEMI JOIN (SELECT doc_id FROM labels) USING (doc_id) SEMI JOIN (SELECT vec_id AS doc_id FROM embeddings) USING (doc_id)")
def _(spark, d):
    versions = [table(spark, d, "labels"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")]
    return ig.with_all_versions(corpus(spark, d), versions, "doc_id").select("doc_id", "path")


@query("j7_hit_image_left", f"WITH {CORPUS} SELECT doc_id, coalesce('img_' || label, '(no image)') AS image_path FROM corpus LEFT JOIN embeddings ON vec_id = doc_id AND vec_id % 2 = 0")
def _(spark, d):
    images = table(spark, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("img_"), F.col("label").cast("string")).alias("path"))
    return ig.hits_with_images(corpus(spark, d).select("doc_id"), images, "doc_id")


_ALPHA = "['" + "', '".join(ig.ALPHABETICAL) + "']"


@query("p3_class_resolution", f"SELECT event_id, CASE WHEN list_contains({_ALPHA}, event_type) THEN event_type WHEN event_id % 20 < 16 THEN {_ALPHA}[(event_id % 20 + 1)::INT] END AS class FROM events WHERE list_contains({_ALPHA}, event_type) OR event_id % 20 < 16")
def _(spark, d):
    found = table(spark, d, "events").select("event_id", ig.resolved_class(F.col("event_type"), (F.col("event_id") % 20).cast("int"), ig.ALPHABETICAL).alias("class"))
    return found.filter("class IS NOT NULL")


_CUSTOM = "['" + "', '".join(ig.CUSTOM) + "']"
_MANIFEST = f"mf AS (SELECT event_id, {_CUSTOM}[(event_id % 16 + 1)::INT] AS class_name, (event_id % 16)::INT AS label, {_CUSTOM}[(event_id % 16 + 1)::INT] || '/' || {_CUSTOM}[(event_id % 16 + 1)::INT] || '_' || lpad(event_id::VARCHAR, greatest(5, len(event_id::VARCHAR))::INT, '0') || '.jpg' AS path FROM events)"


def _manifest(spark, d):
    name = F.element_at(F.array(*map(F.lit, ig.CUSTOM)), (F.col("event_id") % 16 + 1).cast("int"))
    rows = table(spark, d, "events").select(name.alias("class_name"), (F.col("event_id") % 16).cast("int").alias("label"), "event_id")
    return rows.withColumn("path", F.concat(F.col("class_name"), F.lit("/"), F.format_string("%s_%05d.jpg", F.col("class_name"), F.col("event_id"))))


@query("j10_label_permutation", f"WITH {_MANIFEST} SELECT class_name AS old_class, {_ALPHA}[label + 1] AS new_class, count(*)::BIGINT AS n FROM mf GROUP BY ALL")
def _(spark, d):
    return _manifest(spark, d).groupBy(F.col("class_name").alias("old_class"), ig.corrected_class(F.col("class_name")).alias("new_class")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_renamed_manifest", f"WITH {_MANIFEST} SELECT {_ALPHA}[label + 1] || '/' || {_ALPHA}[label + 1] || '_' || string_split(path, '_')[-1] AS path, {_ALPHA}[label + 1] AS class_name, label FROM mf")
def _(spark, d):
    return ig.repaired_manifest(_manifest(spark, d))


@query("p10_class_index", f"WITH {CORPUS} SELECT doc_id, (dense_rank() OVER (ORDER BY class) - 1)::INTEGER AS class_id FROM corpus")
def _(spark, d):
    return ig.class_index(corpus(spark, d), "class").select("doc_id", "class_id")


@query("p1_path_parts", f"WITH {CORPUS} SELECT doc_id, string_split(path, '/')[-2] AS class, string_split(path, '/')[-1] AS file, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM corpus")
def _(spark, d):
    p = F.col("path")
    return corpus(spark, d).select("doc_id", tx.class_of_path(p).alias("class"), tx.file_name(p).alias("file"), tx.stem(p).alias("stem"))


@query("p6_image_extension", "SELECT page_id, CASE WHEN k = 'jpeg' THEN 'jpg' WHEN k = 'tiff' THEN 'tif' WHEN k IN ('png', 'bmp', 'gif') THEN k WHEN s <> '' THEN s ELSE 'tif' END AS ext FROM (SELECT page_id, ['jpeg', 'tiff', 'png', 'webp', 'bmp'][(page_id % 5 + 1)::INT] AS k, regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) AS s FROM (SELECT page_id, lower(url) AS url FROM pages))")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("jpeg", "tiff", "png", "webp", "bmp"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", tx.image_extension(kind, F.col("url")).alias("ext"))


@query("p7_preview", "SELECT doc_id, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, CASE WHEN len(text) > 400 THEN substr(text, 1, 400) || chr(10) || '...(truncado)' ELSE text END AS display FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"), tx.display_text(F.col("text")).alias("display"))


@query("c8_safe_name", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("c9_base64_roundtrip", "SELECT page_id, md5(html) AS digest, len(base64(encode(html)))::BIGINT AS coded FROM pages")
def _(spark, d):
    coded = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "[\r\n]", "")
    return table(spark, d, "pages").withColumn("c", coded).select("page_id", F.md5(F.unbase64("c")).alias("digest"), F.length("c").cast("long").alias("coded"))


@query("c12_title_names", f"SELECT unnest({_ALPHA}) AS class, array_to_string(list_transform(string_split(unnest({_ALPHA}), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in ig.ALPHABETICAL], "class string").withColumn("title", tx.title_name(F.col("class")))


@query("c15_strip_astral", "SELECT doc_id, len(regexp_replace(text || chr(128512) || chr(9989) || 'x', '[\\x{10000}-\\x{10FFFF}' || chr(9203) || chr(9989) || chr(9888) || chr(10060) || chr(10004) || chr(65039) || ']', '', 'g'))::BIGINT AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(tx.strip_astral(F.concat("text", F.lit("\U0001f600\u2705x")))).cast("long").alias("n"))


_TENTHS = "CAST(floor(abs(value) * 10000) AS BIGINT)"
_SAID = f"CASE WHEN value < 0 THEN '-' ELSE '' END || CAST({_TENTHS} // 10000 AS VARCHAR) || '.' || lpad(CAST({_TENTHS} % 10000 AS VARCHAR), 4, '0')"


@query("s17_scraped_accuracy", f"SELECT event_id, try_cast(regexp_extract('Model A\nAccuracy (test): ' || {_SAID} || '\nAccuracy: 9', 'Accuracy.*?:\\s*([\\d.]+)', 1) AS DOUBLE) AS accuracy FROM events")
def _(spark, d):
    from doclens.sources.corpus import scraped_accuracy

    tenths = F.floor(F.abs("value") * 10000).cast("long")
    said = F.concat(F.when(F.col("value") < 0, "-").otherwise(""), F.floor(tenths / 10000).cast("string"), F.lit("."), F.lpad((tenths % 10000).cast("string"), 4, "0"))
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("Model A\nAccuracy (test): "), said, F.lit("\nAccuracy: 9")).alias("value"))
    return scraped_accuracy(rows).select("event_id", "accuracy")


@query("u3_missing_classes", f"SELECT class FROM (SELECT unnest({_ALPHA}) AS class) WHERE class NOT IN (SELECT {_ALPHA}[label + 1] FROM embeddings)")
def _(spark, d):
    expected = spark.createDataFrame([(c,) for c in ig.ALPHABETICAL], "class string")
    present = table(spark, d, "embeddings").select(F.element_at(F.array(*map(F.lit, ig.ALPHABETICAL)), F.col("label") + 1).alias("class"))
    return ig.missing_classes(present, expected, "class")


@query("u4_present_classes", "SELECT DISTINCT label FROM embeddings ORDER BY label")
def _(spark, d):
    return table(spark, d, "embeddings").select("label").distinct().orderBy("label")


@query("u2_union_sources", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'doc' AS kind FROM documents UNION ALL SELECT 'page' FROM pages) GROUP BY kind")
def _(spark, d):
    kinds = table(spark, d, "documents").select(F.lit("doc").alias("kind")).unionByName(table(spark, d, "pages").select(F.lit("page").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("a9_a10_ocr_stats", f"WITH r AS (SELECT lang AS class, len({STRIP('text')}) AS a, len(coalesce(array_to_string({TOKENS('text')}, ' '), '')) AS b FROM documents) SELECT coalesce(class, 'TOTAL') AS class, count(*)::BIGINT AS total, count(*) FILTER (a > 0)::BIGINT AS successes, round(count(*) FILTER (a > 0) / count(*)::DOUBLE * 100, 6) AS rate, round(coalesce(avg(a) FILTER (a > 0), 0), 6) AS avg_len_raw, round(coalesce(avg(b) FILTER (a > 0), 0), 6) AS avg_len_processed, coalesce(max(b) FILTER (a > 0), 0)::BIGINT AS max_len, coalesce(min(b) FILTER (a > 0), 0)::BIGINT AS min_len FROM r GROUP BY ROLLUP (class)")
def _(spark, d):
    rows = table(spark, d, "documents").select(text_path(F.col("lang"), F.col("doc_id")).alias("path"), F.col("lang").alias("class"), tx.strip(F.coalesce("text", F.lit(""))).alias("raw"))
    return ocr_statistics(ocr_results(rows, tx.normalize))  # SQL has no stemmer


# ---- layout -----------------------------------------------------------------------------------------------------

BOXES = "bx AS MATERIALIZED (SELECT conv_id AS image_id, turn AS item, array_to_string(string_split(text, ' ')[1:3], ' ') AS text, (turn % 4) * 60.0::DOUBLE + turn % 3 AS min_x, (turn % 4) * 60.0::DOUBLE + turn % 3 + 42 AS max_x, (turn // 4) * 64.0::DOUBLE + (turn % 2) * 4 AS min_y, (turn // 4) * 64.0::DOUBLE + (turn % 2) * 4 + 12 AS max_y, (turn // 4) * 64.0::DOUBLE + (turn % 2) * 4 + 6 AS center_y FROM conversations), ed AS MATERIALIZED (SELECT a.image_id, a.item AS a, b.item AS b FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.item < b.item AND ((abs(a.center_y - b.center_y) < 6 AND greatest(0, a.min_x - b.max_x, b.min_x - a.max_x) < 20) OR (greatest(0, a.min_x - b.max_x, b.min_x - a.max_x) < 25 AND greatest(0, a.min_y - b.max_y, b.min_y - a.max_y) < 50)))"
BLOCKS = f"{BOXES}, sym AS (SELECT image_id, a, b FROM ed UNION ALL SELECT image_id, b, a FROM ed), rc AS (SELECT image_id, item, item AS other FROM bx UNION SELECT rc.image_id, rc.item, sym.b FROM rc JOIN sym ON sym.image_id = rc.image_id AND sym.a = rc.other), bl AS (SELECT image_id, item, min(other) AS block FROM rc GROUP BY ALL)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    x, y = (turn % 4) * 60.0 + turn % 3, F.floor(turn / 4) * 64.0 + (turn % 2) * 4
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    poly = F.array(corner(x, y), corner(x + 42, y), corner(x + 42, y + 12), corner(x, y + 12))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), turn.alias("item"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"), poly.alias("poly"))
    return ly.boxes_from_polygons(rows).drop("poly")


@query("a15_text_boxes", f"WITH {BOXES} SELECT * FROM bx")
def _(spark, d):
    return boxes(spark, d)


@query("j9_box_edges", f"WITH {BOXES} SELECT * FROM ed")
def _(spark, d):
    return ly.box_edges(boxes(spark, d))


@query("i10_components", f"WITH RECURSIVE {BLOCKS} SELECT image_id, item, block FROM bl")
def _(spark, d):
    return ly.reading_order(boxes(spark, d)).select("image_id", "item", "block")


@query("a14_block_boxes", f"WITH RECURSIVE {BLOCKS} SELECT image_id, block, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, (min(min_x) + max(max_x)) / 2 AS center_x, (min(min_y) + max(max_y)) / 2 AS center_y FROM bl JOIN bx USING (image_id, item) GROUP BY image_id, block")
def _(spark, d):
    found = hold(boxes(spark, d))
    return ly.block_boxes(found, ly.reading_order(found))


@query("i9_reading_order")
def _(spark, d):
    found = hold(boxes(spark, d))
    return ly.page_text(found, ly.reading_order(found))


# ---- models that SQL cannot express -----------------------------------------------------------------------------


def lbp_vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, class, vector: the local binary pattern histogram of each image."""
    from doclens.functions.image_kernels import lbp_column

    return images(spark, d).select(F.col("img_id").alias("vec_id"), "label", F.col("label").alias("class"), lbp_column(F.col("pixels"), 8).alias("vector"))


def glcm_vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, class, vector: five descriptors of each of the twelve offsets."""
    described = glcm_column(F.col("pixels"), 8, im.OFFSETS)
    flat = F.flatten(F.transform(described, lambda g: F.array(*(g[c] for c in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")))))
    return images(spark, d).select(F.col("img_id").alias("vec_id"), "label", F.col("label").alias("class"), flat.alias("vector"))


def combined_vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, class, vector: patterns, descriptors and histogram side by side."""
    histogram = images(spark, d).select(F.col("img_id").alias("vec_id"), histogram_column(F.col("pixels")).alias("h"))
    both = lbp_vectors(spark, d).join(glcm_vectors(spark, d).select("vec_id", F.col("vector").alias("g")), "vec_id").join(histogram, "vec_id")
    return both.withColumn("vector", ml.fused_vector(F.col("vector"), F.col("g"), F.col("h"))).drop("g", "h")


def rbf_svm(rows: DataFrame) -> DataFrame:
    """Scaled on the training part, an RBF kernel of the scale gamma, cost 10, one-vs-one."""
    rows = hold(ml.stratified_split(rows, "vec_id"))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    scaled = hold(ml.standard_scaled(train, train))
    return mc.kernel_predictions(scaled, ml.standard_scaled(test, train), mc.Kernel(gamma=mc.scale_gamma(scaled)))


@query("m5_rbf_svm_predict")
def _(spark, d):
    return rbf_svm(lbp_vectors(spark, d))


@query("m5_glcm_svm_predict")
def _(spark, d):
    return rbf_svm(glcm_vectors(spark, d))


@query("m5_combined_svm_predict")
def _(spark, d):
    return rbf_svm(combined_vectors(spark, d))


TEXT_TERMS = 3000


def _text_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """Documents (doc_id, class, part), their weights, the terms' numbers and the classes (null first), fitted on the training part."""
    docs, weights, idf = _train_weights(spark, d, tf.Vectorizer(TEXT_TERMS))
    ids = hold(tf.with_term_ids(idf).select("term", F.col("term_id").cast("int").alias("term_id")))
    classes = [r["class"] for r in docs.select("class").distinct().orderBy(F.asc_nulls_first("class")).collect()]  # few
    number = F.coalesce(*(F.when(F.col("class").eqNullSafe(F.lit(c)), F.lit(k)) for k, c in enumerate(classes)), F.lit(0))
    return docs.withColumn("place", number), weights, ids, classes


@query("m7_linear_svc_predict")
def _(spark, d):
    """Squared hinge, cost 1, one-vs-rest, on sparse TF-IDF of one and two words."""
    docs, weights, ids, classes = _text_rows(spark, d)
    rows = hold(tf.sparse_rows(weights, docs, ids))
    w = mc.squared_hinge(rows.filter("part = 'train'").select(F.col("doc_id").alias("id"), "place", "at", "x"), TEXT_TERMS, len(classes))
    found = mc.linear_predictions(rows.filter("part = 'test'").select(F.col("doc_id").alias("id"), F.col("class").alias("label"), "at", "x"), w, classes)
    return found.withColumnRenamed("id", "doc_id")


@query("m8_logistic_predict")
def _(spark, d):
    docs, weights, ids, classes = _text_rows(spark, d)
    rows = hold(ml.tfidf_features(weights, docs.withColumn("label", F.col("place").cast("double")), ids, TEXT_TERMS))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    name = lambda c: F.element_at(F.array(*map(F.lit, classes)), F.col(c) + 1).alias(c)
    return ml.fit_features(ml.logistic_regression(train.count()), train, test, "doc_id")[1].select("doc_id", name("label"), name("predicted"))


@query("m10_perceptron_predict")
def _(spark, d):
    train, test = split_vectors(spark, d)
    return ml.fit_predict(ml.perceptron(64, 10), train, test)[1]


#: Side to which the small images are enlarged: the least that the network's layers take is 22.
NETWORK_SIDE = 24


def trained_network(spark: SparkSession, d: str) -> tuple[nw.Trained, DataFrame]:
    """The network trained on the training part of the images, and the test part with its tensors."""
    rows = images(spark, d).select("img_id", "label", F.col("label").alias("class"), tensor_column(F.col("pixels"), F.lit(8), NETWORK_SIDE).alias("tensor"))
    rows = hold(ml.stratified_split(rows, "img_id"))
    return nw.train(rows.filter("part = 'train'"), NETWORK_SIDE), rows.filter("part = 'test'")


@query("m10_convolutional_predict")
def _(spark, d):
    trained, test = trained_network(spark, d)
    return nw.predict(trained, test)


@query("e12_network_history")
def _(spark, d):
    """The epochs of the network's own training, with the best validation accuracy so far."""
    trained, test = trained_network(spark, d)
    history = nw.history_rows(trained, test)
    return history.join(ev.training_curve(history).select("epoch", "best_so_far", "improved"), "epoch")


FUSED_TERMS = 1000


@query("m11_fusion_predict")
def _(spark, d):
    """MinMax of the LBP vectors next to MinMax of the FUSED_TERMS most frequent terms' weights, standardised, RBF-SVM."""
    v, post = tf.Vectorizer(FUSED_TERMS), posted(spark, d)
    idf = hold(v.fit(post, corpus(spark, d).count()))
    size = idf.count()
    dense = hold(ml.tfidf_arrays(v.transform(post, idf), tf.with_term_ids(idf).select("term", "term_id"), size))
    visual = hold(lbp_vectors(spark, d))
    both = ml.minmax_scaled(visual, visual).join(ml.minmax_scaled(dense, dense).select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("t")), "vec_id")
    return rbf_svm(both.withColumn("vector", ml.fused_vector(F.col("vector"), F.col("t"))).drop("t"))


# ---- summaries and samples --------------------------------------------------------------------------------------


@query("x20_corpus_summary", f"WITH {TOK}, t AS (SELECT doc_id, class, unnest(w) AS term FROM toks), z AS (SELECT class, count(*) AS k, count(DISTINCT term) AS v FROM t GROUP BY ROLLUP (class)), s AS (SELECT class, count(*) AS n FROM toks GROUP BY ROLLUP (class)) SELECT coalesce(s.class, 'TOTAL') AS class, n::BIGINT AS n_docs, coalesce(k, 0)::BIGINT AS n_tokens, coalesce(v, 0)::BIGINT AS n_terms FROM s LEFT JOIN z ON s.class IS NOT DISTINCT FROM z.class")
def _(spark, d):
    return cp.corpus_summary(corpus(spark, d), words())


@query("t6_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 20")
def _(spark, d):
    return cp.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 20)


@query("x21_text_distance", "SELECT event_id, levenshtein(event_type, lower(props))::BIGINT AS distance FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cp.text_distance(F.col("event_type"), F.lower("props")).alias("distance"))


@query("e5_weighted", f"{FULL} SELECT model, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM rp GROUP BY model")
def _(spark, d):
    return ev.weighted(ev.class_report(ev.confusion(predictions(spark, d)))).select("model", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("e7_best_model", f"{FULL} SELECT model, accuracy, f1 FROM mt ORDER BY accuracy DESC, ord LIMIT 1")
def _(spark, d):
    return metrics(spark, d).orderBy(F.desc("accuracy"), "ord").limit(1).select("model", "accuracy", "f1")


@query("k7_report_lines")
def _(spark, d):
    from doclens.sources.sinks import report_lines

    return report_lines(ev.full_report(predictions(spark, d)))


@query("i5_binarised", f"WITH {PIX}, c AS (SELECT img_id, v, count(*) AS n FROM px GROUP BY ALL), u AS (SELECT img_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY img_id) AS t, sum(n * v) OVER (PARTITION BY img_id) AS s FROM c WINDOW w AS (PARTITION BY img_id ORDER BY v)), b AS (SELECT img_id, v, CASE WHEN t = w0 THEN 0 ELSE round(w0 * (t - w0) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (t - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (t - w0)), 6) END AS x FROM u), th AS (SELECT img_id, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY x DESC, v) = 1) SELECT img_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM px JOIN th USING (img_id)")
def _(spark, d):
    return im.image_binarised(images(spark, d), 8)
