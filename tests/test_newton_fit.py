"""Linear fits of few columns by Newton steps: the optimum, in few jobs."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from scorelens.operators import models as MD


@pytest.fixture(scope="module")
def measured(spark):
    """Twelve columns that nearly follow from one another, one that does so exactly."""
    rng = np.random.default_rng(5)
    base = rng.lognormal(size=(400, 3))
    x = np.hstack([base, *[base @ rng.normal(size=(3, 3)) + 10.0 ** -k * rng.normal(size=(400, 3)) for k in (1, 2, 3)]])
    x = np.hstack([x, x[:, :1] + x[:, 1:2]])
    x = (x - x.mean(0)) / x.std(0)
    y = (rng.random(400) < 1 / (1 + np.exp(1 - base[:, 0]))).astype(float)
    w = np.where(y == 1, 2.0, 0.5)
    df = spark.createDataFrame([(Vectors.dense(r), float(a), float(b)) for r, a, b in zip(x, y, w)], ["features", "label", MD.WEIGHT_COL])
    return df.coalesce(2), x, y, w


def test_newton_fit_ends_at_the_optimum_in_few_jobs(spark, measured):
    df, x, y, w = measured
    sc = spark.sparkContext
    sc.setJobGroup("newton", "one linear fit")
    model = MD.LogRegByC(C=1.0, turned=True).fit(df)
    sc.setJobGroup("after", "")
    coef, b = model.coefficients.toArray(), model.intercept
    off = w * (1 / (1 + np.exp(-(x @ coef + b))) - y)
    assert abs(off.sum()) / w.sum() < 1e-6
    assert np.abs(x.T @ off + coef).max() / w.sum() < 1e-6  # C = 1: the penalty's gradient is the coefficients
    assert len(sc.statusTracker().getJobIdsForGroup("newton")) < 60
    assert np.allclose([r["p"][1] for r in model.transform(df).selectExpr("probability p").collect()], 1 / (1 + np.exp(-(x @ coef + b))))


def test_newton_fit_leaves_many_columns_and_bad_values(spark, measured):
    lr = MD.LogisticRegression(weightCol=MD.WEIGHT_COL, regParam=0.1, standardization=False)
    many = spark.createDataFrame([(Vectors.dense([0.0] * 64), 0.0, 1.0), (Vectors.dense([1.0] * 64), 1.0, 1.0)],
                                 ["features", "label", MD.WEIGHT_COL])
    assert MD.newton_fit(many, lr) is None
    bad = spark.createDataFrame([(Vectors.dense([float("nan"), 1.0]), 0.0, 1.0), (Vectors.dense([1.0, 2.0]), 1.0, 1.0)],
                                ["features", "label", MD.WEIGHT_COL])
    assert MD.newton_fit(bad, lr) is None
    assert MD.newton_fit(many.limit(0), lr) is None
