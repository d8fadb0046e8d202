import pickle

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from inkwell.operators import blockfit, models as md


@pytest.fixture(scope="module")
def sparse(spark):
    """Rows of 40 features: some rare, one constant, one in no row; weights of two sizes, an empty row."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        held = sorted({0, *rng.choice(np.arange(1, 39), 6, replace=False).tolist()}) if i else []
        values = [2.0 if j == 0 else float(rng.random()) for j in held]
        label = float(sum(v for j, v in zip(held, values) if 0 < j < 20) + rng.normal(0, 0.3) > 1.2)
        rows.append((i, Vectors.sparse(40, held, values), label, 0.5 + i % 2))
    return spark.createDataFrame(rows, ["key", "features", "label", "weight"]).repartition(3, "key").cache()


@pytest.mark.parametrize("rounds", [2, 12])
@pytest.mark.parametrize(
    "make", [lambda n: md.linear_svm(2.0, n, weightCol="weight"), lambda n: md.logistic(2.0, n), lambda n: md.logistic(0.5, n, weightCol="weight")],
    ids=["svm", "logistic", "weighted"],
)
def test_blocks_give_the_model_of_mllib(monkeypatch, sparse, make, rounds):
    want = make(rounds).fit(sparse)
    monkeypatch.setattr(md, "SENT_BYTES", 0)
    monkeypatch.setattr(blockfit, "BLOCK", 7)
    monkeypatch.setattr(blockfit, "RECORD", 64)
    model = make(rounds).fit(sparse)
    assert type(model) is type(want)
    got = model.coefficients.toArray()
    assert np.allclose(got, want.coefficients.toArray(), rtol=1e-5, atol=1e-6) and model.intercept == pytest.approx(want.intercept, abs=1e-5)
    first, second = (m.transform(sparse).orderBy("key").select("prediction").collect() for m in (want, model))
    assert first == second


def test_driver_sees_no_gradient(monkeypatch, spark):
    """Results of a job are inner products, a small part of a gradient of 700,000 features."""
    size, seen = 700_000, []
    rows = [(Vectors.sparse(size, [i, size // 2 + i, size - 1], [1.0, 0.5, 1.0]), float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, ["features", "label"])
    trial = blockfit._Trial
    monkeypatch.setattr(blockfit, "_Trial", lambda state, blocks, weight: seen.append(len(pickle.dumps(blocks))) or trial(state, blocks, weight))
    model = md.linear_svm(1.0, 7).fit(df)
    assert len(seen) > 3 and max(seen) < size * 8 // 100
    assert md.holdout_accuracy(model, df) == 1.0


def test_odd_labels_go_to_mllib(monkeypatch, sparse):
    """One class only, or more than two, are not fitted in blocks."""
    monkeypatch.setattr(md, "SENT_BYTES", 0)
    monkeypatch.setattr(blockfit, "fit", None)
    assert md.logistic(1.0, 3).fit(sparse.withColumn("label", F.lit(1.0))).intercept == float("inf")
    assert md.logistic(1.0, 3).fit(sparse.withColumn("label", F.col("key") % 3)).numClasses == 3


def test_pipeline_fits_and_saves_in_blocks(monkeypatch, spark, sparse, tmp_path):
    monkeypatch.setattr(md, "SENT_BYTES", 0)
    model = Pipeline(stages=[md.logistic(1.0, 2)]).fit(sparse)
    md.save_model(model, str(tmp_path / "model"))
    again = md.load_model(str(tmp_path / "model"))
    assert [r["prediction"] for r in again.transform(sparse).orderBy("key").collect()] == [
        r["prediction"] for r in model.transform(sparse).orderBy("key").collect()
    ]


@pytest.mark.parametrize("tasks", [0, 1 << 30], ids=["tiles", "one task"])
@pytest.mark.parametrize("make", [lambda: md.linear_svm(2.0, 12, weightCol="weight"), lambda: md.logistic(0.5, 12, weightCol="weight")], ids=["svm", "logistic"])
def test_one_task_and_tiles_give_the_model_of_mllib(monkeypatch, sparse, make, tasks):
    want = make().fit(sparse)
    for name, value in (("BLOCK", 7), ("RECORD", 64), ("PASS", 50), ("TASK_BYTES", tasks)):
        monkeypatch.setattr(blockfit, name, value)
    monkeypatch.setattr(md, "SENT_BYTES", 0)
    got = make().fit(sparse)
    assert np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), rtol=1e-5, atol=1e-6)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-5)


def test_a_small_fit_is_few_jobs(monkeypatch, sparse):
    """Before, every evaluation was a job of three stages."""
    monkeypatch.setattr(md, "SENT_BYTES", 0)
    context = sparse.sparkSession.sparkContext
    sparse.count()
    context.setJobGroup("one-task", "fit")
    try:
        md.logistic(1.0, 30).fit(sparse)
        assert len(context.statusTracker().getJobIdsForGroup("one-task")) <= 4
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
