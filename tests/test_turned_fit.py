"""Wide linear fits turn their measured columns onto principal axes; narrow or one-sided ones are fitted as they are."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scorelens.operators import models as MD
from scorelens.operators import tuning as T
from scorelens.plans import fitted as FT


def rows_of(spark, x, y, w):
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)],
                               f"x array<double>, label double, {MD.WEIGHT_COL} double")
    return df.select(array_to_vector("x").alias("features"), "label", F.col(MD.WEIGHT_COL))


def data(n=150, d=80):
    rng = np.random.default_rng(3)
    x = (rng.random((n, d)) < 0.6).astype(float)
    size = 5000 + 900 * rng.standard_normal(n)
    x[:, 0], x[:, 1] = size, 1.0  # far off scale; the same in every row
    x[:, 2] = size * 2 - x[:, 3]  # follows from others
    near = rng.standard_normal((n, 6))
    x[:, 4:10] = size[:, None] * np.arange(1, 7) + near  # nearly does
    y = (near.sum(1) + x[:, 12:16].sum(1) + rng.standard_normal(n) > 2.4).astype(float)
    return x, y, np.where(y == 1, 0.7, 1.4)


def objective(fitted, x, y, w):
    margin = x @ fitted.coefficients.toArray() + fitted.intercept
    return w @ (np.logaddexp(0, margin) - y * margin) / w.sum() + fitted.getRegParam() / 2 * (fitted.coefficients.toArray() ** 2).sum()


def test_turned_fits_reach_the_same_optimum_in_fewer_passes(spark, monkeypatch):
    x, y, w = data()
    rows = rows_of(spark, x, y, w).coalesce(1).cache()
    passes, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: (passes.append(fit(self, df)), passes[-1])[1])
    turned = MD.LogRegByC(C=1.0, turned=True).fit(rows)
    monkeypatch.setattr(MD, "turned_fit", lambda *a: None)
    plain = MD.LogRegByC(C=1.0, turned=True).fit(rows)
    assert len(passes) == 2 and passes[0].summary.totalIterations < passes[1].summary.totalIterations / 2
    assert turned.getRegParam() == plain.getRegParam() == pytest.approx(1 / w.sum(), rel=1e-12)
    assert objective(turned, x, y, w) <= objective(plain, x, y, w) + 2e-6 and turned.numFeatures == 80
    p = 1 / (1 + np.exp(-(x @ turned.coefficients.toArray() + turned.intercept)))
    told = turned.transform(rows).select("probability").collect()
    assert np.allclose(sorted(r[0][1] for r in told), sorted(p), atol=1e-12)


def test_one_class_and_narrow_rows_are_fitted_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(MD, "PCA", lambda **k: pytest.fail("nothing to turn here"))
    x, y, w = data(30)
    assert MD.LogRegByC().fit(rows_of(spark, x, y, w)).numFeatures == 80  # not asked for
    assert MD.LogRegByC(turned=True).fit(rows_of(spark, x, np.ones(30), w)).intercept == float("inf")
    assert MD.LogRegByC(turned=True).fit(rows_of(spark, x[:, 8:13], y, w)).numFeatures == 5
    assert MD.LogRegByC(turned=True).fit(rows_of(spark, x[:, 10:], y, w)).numFeatures == 70


def test_the_fitted_run_asks_for_turned_fits():
    turned = [FT.run_builder("Combined_Naive", m, FT.RUN_PARAMS[m]).getStages()[-1] for m in ("logreg", "rf", "gbt")]
    assert turned[0].getOrDefault("turned") and not any(s.hasParam("turned") for s in turned[1:])
    assert not T.default_builder("Combined_Naive", "logreg", {"C": 1.0}).getStages()[-1].getOrDefault("turned")
    assert "turned" not in FT.RUN_PARAMS["logreg"]
