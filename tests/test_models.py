import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from inkwell.operators import evaluate as ev, features as ft, models as md, splits as sp, topics as tp
from inkwell.session import scratch_path


@pytest.fixture(scope="module")
def planted(spark):
    """Headlines whose label shows in one word of several."""
    rng = np.random.default_rng(0)
    common = [f"word{i}" for i in range(20)]
    rows = []
    for i in range(160):
        label = i % 2
        mark = ("storm", "market")[label] if rng.random() < 0.95 else "neutral"
        rows.append((i, " ".join([*rng.choice(common, 5), mark]), float(label)))
    df = ft.text_views(spark.createDataFrame(rows, "key int, title string, label double"), "title")
    return sp.repeated_folds(df.withColumn("class", F.col("label").cast("int")), "class", "key", 2, 1, 0).cache()


def word_view(**options):
    return ft.tfidf_stages("text_clean", "features", sublinear=True, **options)


def test_tfidf_vector_equals_the_formula(spark):
    df = spark.createDataFrame([(0, "aa aa bb"), (1, "bb cc"), (2, "bb")], "key int, text_clean string")
    model = Pipeline(stages=word_view()).fit(df)
    vocab = [r["term"] for r in model.stages[0].vocabulary.table.orderBy("id").collect()]
    rows = {r["key"]: r["a"] for r in model.transform(df).select("key", vector_to_array("features").alias("a")).collect()}
    idf = {t: np.log((1 + 3) / (1 + n)) + 1 for t, n in (("aa", 1), ("bb", 3), ("cc", 1))}
    want = np.array([{"aa": (1 + np.log(2)) * idf["aa"], "bb": idf["bb"]}.get(t, 0.0) for t in vocab])
    assert np.allclose(rows[0], want / np.linalg.norm(want))


@pytest.mark.parametrize(
    "make",
    [
        lambda: md.logistic(1.0, 20), lambda: md.linear_svm(1.0, 20), lambda: md.naive_bayes("complement"),
        lambda: md.naive_bayes("multinomial"), lambda: md.random_forest(10),
    ],
    ids=["logistic", "svm", "complement", "multinomial", "forest"],
)
def test_models_beat_the_majority(planted, make):
    train, test = planted.filter("fold_0 = 0"), planted.filter("fold_0 = 1")
    assert md.holdout_accuracy(Pipeline(stages=[*word_view(), make()]).fit(train), test) > 0.75


def test_saved_model_predicts_alike(spark, planted):
    stages = [*ft.feature_union().getStages(), md.logistic(1.0, 5)]
    model = Pipeline(stages=stages).fit(planted)
    path = scratch_path(spark, "model")
    md.save_model(model, path)
    first = {r["key"]: r["prediction"] for r in ev.predict_table(model, planted, "key").collect()}
    again = {r["key"]: r["prediction"] for r in ev.predict_table(md.load_model(path), planted, "key").collect()}
    assert first == again


def test_stack_and_calibrate(planted):
    features = Pipeline(stages=word_view()).fit(planted).transform(planted).select("key", "label", "features", "fold_0").cache()
    score = features.select("key", "label", "features")
    stacked = md.stack_models(features, score, {"svm": md.linear_svm(1.0, 10), "nb": md.naive_bayes("multinomial")}, "key", "fold_0", 2)
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    assert stacked.agg(hit).first()[0] > 0.8
    calibrated = md.calibrate_scores(features, score, md.linear_svm(1.0, 10), "fold_0", 2)
    row = calibrated.agg(hit.alias("hit"), F.min("probability").alias("lo"), F.max("probability").alias("hi")).first()
    assert row["hit"] > 0.8 and 0 <= row["lo"] <= row["hi"] <= 1


def test_nested_calibration_fits_one_model_at_a_time(planted):
    """The folds around it run side by side already; each fit holds its history of gradients on the driver."""
    features = Pipeline(stages=word_view()).fit(planted).transform(planted).select("key", "label", "features", "fold_0").cache()
    running, most = [], []

    class Watched:
        def fit(self, df):
            running.append(1)
            most.append(len(running))
            try:
                return md.linear_svm(1.0, 3).fit(df)
            finally:
                running.pop()

    md.calibrate_scores(features, features.select("key", "label", "features"), Watched(), "fold_0", 2, outer="other=0")
    assert most == [1, 1]


def test_searches(planted):
    folds = md.disjoint_folds(planted, ["fold_0"], 2)
    configs = md.draw_configs(md.grid(size=[5, 50], c=[0.1, 1.0]), 2, 3)
    assert configs == md.draw_configs(md.grid(size=[5, 50], c=[0.1, 1.0]), 2, 3)
    runs = md.grid_search(folds, lambda c: Pipeline(stages=[*word_view(vocab_size=c["size"]), md.logistic(c["c"], 5)]), configs)
    assert runs.count() == 2 and all(r["folds"] == 2 for r in runs.collect())


def test_external_model(spark):
    class Shout:
        def predict(self, texts):
            return [int(t.isupper()) for t in texts]

    df = spark.createDataFrame([(1, "ABC"), (2, "abc")], "key int, text string")
    got = {r["key"]: r["prediction"] for r in ev.predict_external(df, "key", "text", Shout).collect()}
    assert got == {1: 1, 2: 0}


def test_svd_directions_are_orthonormal_and_ordered(planted):
    weights = Pipeline(stages=word_view()).fit(planted).transform(planted).select("key", "features")
    projection, singular = ft.svd_projection(weights, "features", 5, "low")
    v = projection.matrix.T
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-6) and singular == sorted(singular, reverse=True)
    total = projection.transform(weights).select(F.explode(vector_to_array("low")).alias("x")).agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    assert total == pytest.approx(sum(s * s for s in singular), rel=1e-6)


def test_custom_cleaner_is_a_parameter(spark):
    from inkwell.operators.hygiene import dedup_text

    df = spark.createDataFrame([(1, "a b", "A"), (2, "a  c", "A")], "key int, t string, s string")
    assert dedup_text(df, "t", "s", "key", cleaner=lambda t: F.substring(t, 1, 1)).count() == 1


def test_topics_separate_clear_blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.1, 6) + (i % 3) * 5).tolist()) for i in range(90)] + [(99, [200.0] * 6)]
    df = spark.createDataFrame(rows, "key int, v array<double>")
    got = {r["key"]: r["topic"] for r in tp.topics_from_vectors(df, "key", "v", k=4, dims=2, min_size=5).collect()}
    assert got[99] == -1 and len({got[i] for i in range(90) if got[i] >= 0}) >= 2


def test_predict_table_scores_every_page(spark):
    from inkwell.plans import QUERIES

    path = "/root/testdata/sf0.001"
    assert QUERIES["predict_table"](spark, path).count() == spark.read.parquet(f"{path}/pages.parquet").count()


def test_cluster_sweep_covers_all_dimensions(spark):
    from inkwell.plans import QUERIES

    swept = QUERIES["cluster_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["dims"] for r in swept) == [3, 5, 8, 10]


def test_tree_ensembles_boost_all_rounds(monkeypatch, spark):
    """Three hundred rounds as the survey lists them, with lineage cut by checkpoints."""
    from inkwell.plans import QUERIES

    asked = []

    class Asked(Exception):
        pass

    def boosted(*args, **params):
        asked.append(make(*args, **params))
        raise Asked

    make = md.boosted_trees
    monkeypatch.setattr(md, "boosted_trees", boosted)
    monkeypatch.setattr(md, "random_forest", lambda trees, seed, **params: RandomForestClassifier(numTrees=1, seed=seed, **params))
    with pytest.raises(Asked):
        QUERIES["tree_ensembles"](spark, "/root/testdata/sf0.001")
    assert asked[0].getMaxIter() == 300 and asked[0].getMaxDepth() == 4 and asked[0].getSubsamplingRate() == 0.8


def test_boosting_gives_the_application_a_checkpoint_folder(monkeypatch, planted):
    cut = []
    monkeypatch.setattr(md, "lineage_cuts", cut.append)
    train = Pipeline(stages=word_view()).fit(planted).transform(planted).select("label", "features")
    assert md.holdout_accuracy(md.boosted_trees(3, 2).fit(train), train) > 0.75 and len(cut) == 1


def test_variants_of_an_experiment_run_side_by_side(planted):
    """A fit in one task leaves cores to the others; before, one variant ran after another."""
    together = threading.Barrier(2, timeout=60)

    class Watched:
        def fit(self, df):
            together.wait()
            return Pipeline(stages=[*word_view(), md.naive_bayes("multinomial")]).fit(df)

    train, test = planted.filter("fold_0 = 0"), planted.filter("fold_0 = 1")
    runs = md.experiment({name: (train, test, Watched()) for name in ("one", "two")}).collect()
    assert [r["model"] for r in runs] == ["one", "two"] and all(r["accuracy"] > 0.75 for r in runs)
