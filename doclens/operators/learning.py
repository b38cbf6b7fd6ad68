"""Splits, scalers and classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.operators.joins import null_safe_join
from doclens.operators.numbering import first_by_hash, numbered, range_of
from doclens.session import hold


def split_quotas(sizes: DataFrame, test_tenths_of_percent: int = 200) -> DataFrame:
    """class, n, quota: test rows a class by largest remainder, ceil(share * N) in all; ties to the class that sorts first.

    Shares are thousandths and all arithmetic is on integers. Classes are few: one row each.
    """
    share = test_tenths_of_percent
    whole = sizes.agg(F.floor((F.sum("n") * share + 999) / 1000).alias("wanted"))
    base = sizes.select("class", "n", F.floor(F.col("n") * share / 1000).cast("long").alias("base"), F.pmod(F.col("n") * share, F.lit(1000)).alias("rest"))
    left = base.agg(F.sum("base").alias("given")).crossJoin(whole).select((F.col("wanted") - F.col("given")).alias("left"))
    ranked = base.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "class")))
    return ranked.crossJoin(left).select("class", "n", (F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("quota"))


def split_part(rows: DataFrame, id_col: str = "doc_id", seed: int = 42, test_tenths_of_percent: int = 200) -> Column:
    """`part` (test or train) of a row with its `class` and id: of each class (null is one) the quota's rows of smallest md5(id-seed) are test.

    The bounds are found on ids and classes alone, which are held unless `rows` is, so that `rows` is computed once for them.
    """
    keys = rows if rows.is_cached else hold(rows.select("class", id_col))
    quotas = split_quotas(keys.groupBy("class").agg(F.count(F.lit(1)).alias("n")), test_tenths_of_percent)
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    return F.when(first_by_hash(keys, quotas.select("class", "quota"), "class", order, id_col), "test").otherwise("train")


def stratified_split(rows: DataFrame, id_col: str = "doc_id", seed: int = 42, test_tenths_of_percent: int = 200) -> DataFrame:
    """rows with their `part`. Rows stay where they are."""
    return rows.withColumn("part", split_part(rows, id_col, seed, test_tenths_of_percent))


def _by_position(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.select(F.posexplode(vector).alias("pos", "x"))


def standard_scaled(vectors: DataFrame, fit_on: DataFrame, vector: str = "vector") -> DataFrame:
    """(x - mean) / population deviation, fitted on `fit_on`; a constant component is only centred."""
    stats = _by_position(fit_on, vector).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    return _scaled(vectors, stats, vector, lambda x, p: (x - p["m"]) / F.when(p["s"] == 0, F.lit(1.0)).otherwise(p["s"]))


def minmax_scaled(vectors: DataFrame, fit_on: DataFrame, vector: str = "vector") -> DataFrame:
    """(x - min) / (max - min), fitted on `fit_on`; a constant component becomes 0."""
    stats = _by_position(fit_on, vector).groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("m"), F.max(F.col("x").cast("double")).alias("s"))
    return _scaled(vectors, stats, vector, lambda x, p: F.when(p["s"] == p["m"], F.lit(0.0)).otherwise((x - p["m"]) / (p["s"] - p["m"])))


def _scaled(vectors: DataFrame, stats: DataFrame, vector: str, f) -> DataFrame:
    """Statistics are one row a component; they become one array, broadcast to the rows."""
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("__p"))
    return vectors.join(F.broadcast(packed), how="cross").withColumn(vector, F.zip_with(F.col(vector).cast("array<double>"), "__p", f)).drop("__p")


def multinomial_nb(train: DataFrame, train_docs: DataFrame, vocab: DataFrame, value: str = "weight", alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(class, term, log_p) for every class and term of the vocabulary, and (class, log_prior); priors unsmoothed."""
    classes = train_docs.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = train_docs.count()
    n_terms = vocab.count()
    sums = train.groupBy("class", "term").agg(F.sum(value).alias("v"))
    masses = sums.groupBy("class").agg(F.sum("v").alias("mass"))
    grid = F.broadcast(classes.select("class")).crossJoin(vocab.select("term"))
    joined = null_safe_join(null_safe_join(grid, sums, ["class", "term"], "left"), F.broadcast(masses), "class", "left")
    log_p = F.log((F.coalesce("v", F.lit(0.0)) + alpha) / (F.coalesce("mass", F.lit(0.0)) + alpha * n_terms))
    return joined.select("class", "term", log_p.alias("log_p")), classes.select("class", F.log(F.col("n") / F.lit(float(total))).alias("log_prior"))


def nb_predictions(test: DataFrame, test_docs: DataFrame, model: tuple[DataFrame, DataFrame], value: str = "weight") -> DataFrame:
    """doc_id, class, predicted; ties to the class that sorts first. Documents without known terms follow the priors. The model, a row a class and term, is broadcast."""
    likelihood, priors = model
    scores = test.select("doc_id", "term", value).join(F.broadcast(likelihood.withColumnRenamed("class", "guess")), "term").groupBy("doc_id", "guess").agg(F.sum(F.col(value) * F.col("log_p")).alias("s"))
    grid = test_docs.select("doc_id", "class").crossJoin(F.broadcast(priors.withColumnRenamed("class", "guess")))
    full = null_safe_join(grid, scores, ["doc_id", "guess"], "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)) + F.col("log_prior"), 6))
    return full.groupBy("doc_id", "class").agg(F.min_by("guess", F.struct(-F.col("s"), F.col("guess"))).alias("predicted"))


def positional_fusion(visual: DataFrame, textual: DataFrame, visual_id: str, textual_id: str) -> DataFrame:
    """Rows joined by their position in the order of either id, as far as both go (the compatible mode of J8)."""
    number = lambda rows, key: _numbered(rows, key)
    return number(visual, visual_id).join(number(textual, textual_id), "rn")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    return numbered(rows, [key], range_of(rows, key), name="rn")


def random_fourier_features(vectors: DataFrame, dims: int, n_features: int = 200, gamma: float = 1.0, seed: int = 42, vector: str = "vector") -> DataFrame:
    """Features whose inner products approach the RBF kernel exp(-gamma |x - y|^2). Each worker draws the same projection from the seed."""

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, (2 * gamma) ** 0.5, (n_features, dims)), rng.uniform(0, 2 * np.pi, n_features)
        x = np.stack([np.asarray(v, dtype=float) for v in batch]) if len(batch) else np.zeros((0, dims))
        return pd.Series(list((2.0 / n_features) ** 0.5 * np.cos(x @ w.T + b)))

    return vectors.withColumn(vector, project(F.col(vector)))


def _features(rows: DataFrame, vector: str, label: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))


def fit_predict(estimator, train: DataFrame, test: DataFrame, vector: str = "vector", label: str = "label", id_col: str = "vec_id") -> tuple[Model, DataFrame]:
    """The fitted model and (id, label, predicted) of the test rows."""
    return fit_features(estimator, _features(train, vector, label), _features(test, vector, label), id_col)


def fit_features(estimator, train: DataFrame, test: DataFrame, id_col: str) -> tuple[Model, DataFrame]:
    """The same for rows with the columns features and label (a double)."""
    model = estimator.fit(hold(train.select("features", "label").repartition(max(1, train.count() // 5000))))  # solvers read them again and again
    out = model.transform(test.select(id_col, "features", "label"))
    return model, out.select(id_col, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def linear_svc(n_train: int, c: float = 1.0, max_iter: int = 100) -> OneVsRest:
    """One-vs-rest linear SVC of cost c a row. Spark's loss is the hinge, not its square."""
    return OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(1, n_train)), tol=1e-4, standardization=False), parallelism=8)


def logistic_regression(n_train: int, c: float = 1.0) -> LogisticRegression:
    return LogisticRegression(family="multinomial", regParam=1.0 / (c * max(1, n_train)), standardization=False, maxIter=1000)


def perceptron(dims: int, classes: int, hidden: int = 64, seed: int = 42) -> MultilayerPerceptronClassifier:
    """The stand-in for the convolutional network, for which no framework is at hand: dense layers on pooled pixels."""
    return MultilayerPerceptronClassifier(layers=[dims, hidden, classes], maxIter=100, seed=seed)


def fused_vector(*parts: Column) -> Column:
    return F.concat(*(p.cast("array<double>") for p in parts))


def tfidf_arrays(weights: DataFrame, vocab_ids: DataFrame, size: int) -> DataFrame:
    """doc_id and a dense array of weights by term_id, for the vocabularies of a few thousand terms that fused classifiers use."""
    found = weights.join(F.broadcast(vocab_ids), "term").groupBy("doc_id").agg(F.collect_list(F.struct("term_id", "weight")).alias("m"))

    @F.pandas_udf("array<double>")
    def dense(batch: pd.Series) -> pd.Series:
        def one(row) -> np.ndarray:
            out = np.zeros(size)
            for r in row:
                out[r["term_id"]] = r["weight"]
            return out

        return batch.map(one)

    return found.select("doc_id", dense("m").alias("vector"))


def tfidf_features(weights: DataFrame, docs: DataFrame, vocab_ids: DataFrame, size: int) -> DataFrame:
    """The rows of docs (doc_id, ...) with `features`, their sparse vector of weights by term_id; zero for a document without known terms."""
    found = weights.join(F.broadcast(vocab_ids), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("__m"))
    sparse = F.udf(lambda m: Vectors.sparse(size, [(int(x["term_id"]), float(x["weight"])) for x in m or []]), VectorUDT())
    return docs.join(found, "doc_id", "left").withColumn("features", sparse("__m")).drop("__m")
