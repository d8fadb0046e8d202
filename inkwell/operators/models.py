"""MLlib classifiers, calibration, stacking, searches and experiments.

Feature frames are persisted once per text configuration; folds and parameters
vary over the persisted frame.  What reaches the driver is one metric per fit.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from inkwell.operators import blockfit
from inkwell.operators.features import RandomFourierFeatures, tfidf_stages
from inkwell.session import lineage_cuts


@contextmanager
def kept(df: DataFrame):
    """Persist for the span of several fits (lost blocks are recomputed from lineage)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


#: Bytes of stored vector elements that one task of a fit works on; smaller inputs take fewer tasks.
FIT_BYTES = 16 << 20


#: Bytes of gradients that MLlib may send the driver in one fit; larger fits keep them in blocks of features.
SENT_BYTES = 64 << 20


class _ByRows:
    """A linear classifier whose penalty is 1 / (c * rows of the fit), for tables of any number of terms.

    One pass counts rows and vector elements.  Every iteration of a fit is a job over all
    partitions, so a table of few elements is fitted in few of them.
    """

    c = 1.0

    def _fit(self, dataset: DataFrame):
        vector, label = self.getFeaturesCol(), self.getLabelCol()
        weight = self.getWeightCol() if self.isSet(self.weightCol) else None
        with kept(dataset.select(vector, label, *([weight] if weight else []))) as rows:
            stored = F.unwrap_udt(vector)
            counts = rows.agg(
                F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(stored["values"])), F.lit(0)).alias("elements"),
                F.max(F.coalesce(stored["size"], F.size(stored["values"]))).alias("size"), F.min(label).alias("low"), F.max(label).alias("high"),
                F.count_if(F.col(label).isin(0, 1) & (F.col(weight) >= 0 if weight else F.lit(True))).alias("usable"),
            ).first()
            penalty = 1.0 / (self.c * max(counts["n"], 1))
            binary = counts["usable"] == counts["n"] and (counts["low"], counts["high"]) == (0, 1)
            if binary and 2 * self.getMaxIter() * 8 * counts["size"] > SENT_BYTES:
                table = rows.select(
                    stored.alias("v"), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")
                )
                svm = isinstance(self, LinearSVC)
                found, intercept = blockfit.fit(table, counts["size"], counts["elements"], svm, penalty, self.getMaxIter(), self.getTol())
                return self._copyValues(_linear_model(self.uid, svm, found, intercept))
            fitted = rows.coalesce(max(1, -(-counts["elements"] * 12 // FIT_BYTES)))  # never more partitions than there are
            return super(_ByRows, self.copy({self.regParam: penalty}))._fit(fitted)


def _linear_model(uid: str, svm: bool, coefficients: np.ndarray, intercept: float) -> Model:
    """MLlib's model of given coefficients."""
    spark, kind = SparkSession.active(), LinearSVCModel if svm else LogisticRegressionModel
    make = getattr(spark._jvm.org.apache.spark.ml.classification, kind.__name__)
    return kind(make(uid, _py2java(spark.sparkContext, Vectors.dense(coefficients)), intercept))


class LogisticByRows(_ByRows, LogisticRegression):
    """Logistic regression with inverse strength ``c``: its penalty is 1 / (c * rows of the fit)."""


class SvmByRows(_ByRows, LinearSVC):
    """Linear SVM with inverse strength ``c``: its penalty is 1 / (c * rows of the fit)."""


def logistic(c: float = 1.0, max_iter: int = 100, **params) -> LogisticByRows:
    out = LogisticByRows(standardization=False, maxIter=max_iter, **params)
    out.c = c
    return out


def logistic_baseline(text_col: str, stop: Sequence[str] = ()) -> Pipeline:
    """The hundred most frequent words, as its definition says."""
    return Pipeline(stages=[*tfidf_stages(text_col, "features", vocab_size=100, stop=stop), logistic(1.0)])


def logistic_improved(text_col: str, stop: Sequence[str] = ()) -> Pipeline:
    """The 5,000 most frequent words and word pairs, as its definition says."""
    stages = tfidf_stages(text_col, "features", n_max=2, vocab_size=5000, sublinear=True, stop=stop)
    return Pipeline(stages=[*stages, logistic(1.0)])


def linear_svm(c: float = 1.0, max_iter: int = 100, **params) -> SvmByRows:
    out = SvmByRows(standardization=False, maxIter=max_iter, **params)
    out.c = c
    return out


def class_weights(df: DataFrame, label_col: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * n_class)`` as a column, for any number of classes; a null label weighs 1."""
    counts = df.groupBy(label_col).count()
    totals = counts.agg(F.sum("count").alias("_total"), F.count("*").alias("_classes"))  # one row
    weights = counts.crossJoin(F.broadcast(totals)).select(
        F.col(label_col).alias("_label"), (F.col("_total") / (F.col("_classes") * F.col("count"))).alias(out)
    )
    joined = df.join(weights, F.col(label_col) == F.col("_label"), "left").drop("_label")
    return joined.withColumn(out, F.coalesce(out, F.lit(1.0)))


def naive_bayes(kind: str = "complement", alpha: float = 1.0, **params) -> NaiveBayes:
    return NaiveBayes(modelType=kind, smoothing=alpha, **params)


def random_forest(trees: int = 200, seed: int = 0, **params) -> RandomForestClassifier:
    """Also stands in for extra-trees, whose random thresholds MLlib lacks."""
    return RandomForestClassifier(numTrees=trees, seed=seed, **params)


class BoostedTrees(GBTClassifier):
    """MLlib's boosted trees, whose errors of the rows depend on all rounds before unless checkpoints cut that."""

    def _fit(self, dataset: DataFrame):
        lineage_cuts(dataset.sparkSession)
        elements = dataset.agg(F.coalesce(F.sum(F.size(F.unwrap_udt(self.getFeaturesCol())["values"])), F.lit(0))).first()[0]
        return super()._fit(dataset.coalesce(max(1, -(-elements * 8 // FIT_BYTES))))  # every level of a tree is a job over all partitions


def boosted_trees(rounds: int = 300, depth: int = 4, rate: float = 0.05, subsample: float = 0.8, seed: int = 0, **params) -> BoostedTrees:
    return BoostedTrees(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, **params)


def kernel_svm_rbf(
    train: DataFrame, vector_col: str = "features", size: int = 256, c: float = 1.0, seed: int = 0, max_iter: int = 100
) -> PipelineModel:
    """RBF machine on scaled vectors, re-aimed as random Fourier features and a linear SVM.

    ``gamma = 1 / (d * var)`` with the variance of the scaled features.
    """
    scaler = StandardScaler(inputCol=vector_col, outputCol="_scaled", withMean=True, withStd=True).fit(train)
    scaled = scaler.transform(train)
    spread = scaled.select(F.explode(vector_to_array("_scaled")).alias("x"))
    row = scaled.agg(F.max(F.size(vector_to_array("_scaled"))).alias("d")).first()
    variance = spread.agg(F.var_pop("x")).first()[0] or 1.0
    rff = RandomFourierFeatures("_scaled", "_rff", size, 1.0 / (row["d"] * variance), seed)
    svm = linear_svm(c, max_iter, featuresCol="_rff").fit(rff.transform(scaled))
    return PipelineModel(stages=[scaler, rff, svm])


def margin(scored: DataFrame, out: str = "margin") -> DataFrame:
    return scored.withColumn(out, vector_to_array("rawPrediction")[1])


def _without_outputs(df: DataFrame) -> DataFrame:
    return df.drop("rawPrediction", "probability", "prediction")


#: Column of counts of numbered terms that views of held-out sets read in place of a text.
CODES = "_codes"

#: Gives the fitted view of the text for a named held-out set (None: nothing held out).
Views = Callable[[str | None], Model]


def _seen(views: Views | None, held: str | None, df: DataFrame) -> DataFrame:
    """The features of a frame by a view that never saw the held-out rows; frames that have features pass."""
    return df if views is None else views(held).transform(df)


def calibrate_scores(
    train: DataFrame, score: DataFrame, base: Estimator, fold_col: str, k: int = 3, views: Views | None = None, outer: str | None = None
) -> DataFrame:
    """Sigmoid-calibrated probability: mean over folds of (base, sigmoid) pairs.

    Each sigmoid is fitted on margins of rows its base model never saw.  With ``views``,
    the frames carry texts, and the vocabulary of a fold has not seen its rows either,
    nor those of the held-out set ``outer`` around it.
    """
    assemble = VectorAssembler(inputCols=["margin"], outputCol="_margin")

    def fitted(fold: int) -> tuple[str, Model, Model]:
        held = f"{fold_col}={fold}" if outer is None else f"{outer}|{fold_col}={fold}"
        with kept(_seen(views, held, train).drop(CODES)) as rows:
            model = base.fit(rows.filter(F.col(fold_col) != fold))
            held_out = assemble.transform(margin(model.transform(rows.filter(F.col(fold_col) == fold))))
            return held, model, LogisticRegression(featuresCol="_margin").fit(held_out.select("label", "_margin"))

    # inside an outer fold other fits run beside this one, each with its history of gradients on the driver
    with ThreadPoolExecutor(1 if outer else k) as pool:
        pairs = list(pool.map(fitted, range(k)))
    probability, out = F.lit(0.0), score
    for fold, (held, model, sigmoid) in enumerate(pairs):
        scored = sigmoid.transform(_without_outputs(assemble.transform(margin(model.transform(_seen(views, held, out))))))
        out = _without_outputs(
            scored.withColumn(f"_p{fold}", vector_to_array("probability")[1])
        ).drop("margin", "_margin")
        probability = probability + F.col(f"_p{fold}")
    out = out.withColumn("probability", probability / k).drop(*[f"_p{i}" for i in range(k)])
    return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))


def _positive_score(scored: DataFrame, out: str) -> DataFrame:
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return _without_outputs(scored.withColumn(out, vector_to_array(column)[1]))


class Calibrated:
    """A base of a stack whose margins become probabilities by sigmoids fitted on other folds."""

    def __init__(self, base: Estimator, fold_col: str, k: int = 3):
        self.base, self.fold_col, self.k = base, fold_col, k


def _scored_by(
    base: Estimator | Calibrated, train: DataFrame, score: DataFrame, out: str, views: Views | None, held: str | None
) -> DataFrame:
    """``score`` with a column of positive scores of a base fitted on ``train``."""
    if isinstance(base, Calibrated):
        done = calibrate_scores(train, score, base.base, base.fold_col, base.k, views, held)
        return done.withColumn(out, F.col("probability")).drop("probability", "prediction")
    with kept(_seen(views, held, train).drop(CODES)) as rows:
        model = base.fit(rows)
    return _positive_score(model.transform(_seen(views, held, score)), out)


def out_of_fold(
    train: DataFrame, bases: dict[str, Estimator | Calibrated], key_col: str, fold_col: str, k: int, views: Views | None = None
) -> DataFrame:
    """``(key, label, *base scores)`` where no base, and no vocabulary, scored a row it had seen."""
    def scored(fold: int) -> DataFrame:
        part, rest = train.filter(F.col(fold_col) == fold), train.filter(F.col(fold_col) != fold)
        for name, base in bases.items():
            part = _scored_by(base, rest, part, name, views, f"{fold_col}={fold}")
        return part.select(key_col, "label", *bases)

    with ThreadPoolExecutor(k) as pool:
        parts = list(pool.map(scored, range(k)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def stack_models(
    train: DataFrame, score: DataFrame, bases: dict[str, Estimator | Calibrated], key_col: str, fold_col: str, k: int = 3,
    views: Views | None = None,
) -> DataFrame:
    """Logistic meta model over out-of-fold base scores, applied to ``score``."""
    assemble = VectorAssembler(inputCols=list(bases), outputCol="_stack")
    with kept(assemble.transform(out_of_fold(train, bases, key_col, fold_col, k, views))) as stacked:
        meta = LogisticRegression(featuresCol="_stack").fit(stacked)
    out = score
    for name, base in bases.items():
        out = _scored_by(base, train, out, name, views, None)
    return meta.transform(assemble.transform(out)).drop("_stack", "rawPrediction", *bases)


def holdout_accuracy(model: Model, df: DataFrame) -> float:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return model.transform(df).agg(F.avg(hit)).first()[0] or 0.0


def grid(**axes: Sequence) -> list[dict]:
    """All combinations of the named parameter values."""
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def draw_configs(configs: Sequence[dict], n: int, seed: int) -> list[dict]:
    """Seeded draw without replacement."""
    return random.Random(seed).sample(list(configs), min(n, len(configs)))


Fold = tuple[DataFrame, DataFrame]


def grid_search(
    folds: Sequence[Fold], make: Callable[[dict], Estimator], configs: Sequence[dict], parallelism: int = 4
) -> DataFrame:
    """``(config, mean_accuracy, std_accuracy, folds)`` per configuration.

    Works for expanding-prefix folds as well as disjoint ones: a fold is any
    (train, validate) pair of filters over one persisted frame.
    """
    def run(task: tuple[int, Fold]) -> tuple[int, float]:
        place, (train, validate) = task
        return place, holdout_accuracy(make(configs[place]).fit(train), validate)

    tasks = [(place, fold) for place in range(len(configs)) for fold in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(run, tasks))
    return run_table(folds[0][0].sparkSession, configs, results)


def run_table(spark: SparkSession, configs: Sequence[dict], results: Sequence[tuple[int, float]]) -> DataFrame:
    """``(config, mean_accuracy, std_accuracy, folds)`` of (place of a configuration, accuracy) pairs."""
    named = [(", ".join(f"{k}={v}" for k, v in configs[p].items()), a) for p, a in results]
    runs = spark.createDataFrame(named, "config string, accuracy double")
    return runs.groupBy("config").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
        F.count(F.lit(1)).alias("folds"),
    )


def prefix_folds(sliced: DataFrame, k: int) -> list[Fold]:
    """Rolling folds as filters over a ``slice`` column."""
    return [(sliced.filter(F.col("slice") <= i), sliced.filter(F.col("slice") == i + 1)) for i in range(k)]


def disjoint_folds(df: DataFrame, fold_cols: Sequence[str], k: int) -> list[Fold]:
    return [
        (df.filter(F.col(c) != i), df.filter(F.col(c) == i)) for c in fold_cols for i in range(k)
    ]


def experiment(
    variants: dict[str, tuple[DataFrame, DataFrame, Pipeline]], split: str = "holdout"
) -> DataFrame:
    """Runs table ``(model, split, accuracy)``: one fit and one evaluation per variant."""
    def run(item):
        name, (train, test, pipeline) = item
        return name, split, holdout_accuracy(pipeline.fit(train), test)

    with ThreadPoolExecutor(4) as pool:  # a fit in one task leaves the other cores free
        rows = list(pool.map(run, variants.items()))
    test = next(iter(variants.values()))[1]
    return test.sparkSession.createDataFrame(rows, "model string, split string, accuracy double")


def save_model(model: PipelineModel, path: str) -> None:
    """Preprocessing and classifier as one unit."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
