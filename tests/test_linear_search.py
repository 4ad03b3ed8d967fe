"""All linear fits of the fitted run side by side: the optimum of each, in few passes over the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scorelens.operators import linear as L
from scorelens.operators import models as MD
from scorelens.operators import tuning as T
from scorelens.operators.descriptors import DESCRIPTOR_COLUMNS
from scorelens.operators.folds import stratified_folds
from scorelens.session import scratch_path

GRID = [{"C": 0.1}, {"C": 1.0}]
SETS = ("Descriptors", "Combined_Naive", "Combined_Scaled", "ECFP")


def entities(spark, positive, n=90):
    """Entities with 12 slots and 15 columns: one does not vary, one follows from others; ids 1 and null come twice."""
    i = F.col("id")
    cols = {c: F.sin(i * (j + 1)) * 10.0 ** (j % 4) + 50 for j, c in enumerate(DESCRIPTOR_COLUMNS)}
    cols[DESCRIPTOR_COLUMNS[3]] = F.lit(7.0)
    cols[DESCRIPTOR_COLUMNS[5]] = cols[DESCRIPTOR_COLUMNS[0]] + 2 * cols[DESCRIPTOR_COLUMNS[1]]
    slots = array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda b: (F.crc32(F.concat_ws(",", b, "id")) % 2).cast("double")))
    df = spark.range(1, n + 1).select(F.when(i > n - 2, None).when(i == 2, 1).otherwise(i).alias("doc_id"),
                                      positive.cast("double").alias("label"), slots.alias("ecfp"),
                                      *[v.cast("double").alias(c) for c, v in cols.items()])
    return stratified_folds(df, "doc_id", "label", k=5)


@pytest.fixture(scope="module")
def searched(spark):
    path = scratch_path(spark, "rows")
    entities(spark, F.crc32(F.col("id").cast("string")) % 3 + F.sin(F.col("id")) > 1).repartition(2).write.parquet(path)
    features, out = spark.read.parquet(path), scratch_path(spark, "inner")
    return features, T.linear_search(features, SETS, GRID, out), spark.read.parquet(out)


def objective(clf, rows):
    x, y, w = (np.array(v) for v in zip(*[(r["features"].toArray(), r["label"], r[MD.WEIGHT_COL]) for r in rows]))
    m = x @ clf.coefficients.toArray() + clf.intercept
    return w @ (np.logaddexp(0, m) - y * m) / w.sum() + clf.getRegParam() / 2 * (clf.coefficients.toArray() ** 2).sum()


@pytest.mark.parametrize("feature_set", SETS)
def test_each_fit_is_at_the_optimum_of_its_own_rows(searched, feature_set):
    features, known, _ = searched
    assert len(known) == 20
    params, score, got = known[feature_set, "logreg", 2]
    train = features.where("fold <> 2")
    alone = T.default_builder(feature_set, "logreg", params | {"turned": True}).fit(train)
    assert [type(s) for s in got.stages] == [type(s) for s in alone.stages] and 0 <= score <= 1 and params in GRID
    assert T.gradient_ratio(got, train) < 1e-5
    a, b = got.stages[-1], alone.stages[-1]
    assert a.getRegParam() == pytest.approx(b.getRegParam(), rel=1e-12) and a.numFeatures == b.numFeatures
    rows = T.prepared(alone, train).collect()
    assert objective(a, rows) == pytest.approx(objective(b, rows), abs=1e-7)
    p, q = ({tuple(r)[:2]: r["y_prob"] for r in T.positive_probability(m.transform(features.where("fold = 2"))).select(
        "doc_id", "label", "y_prob").collect()} for m in (got, alone))
    assert p == pytest.approx(q, abs=2e-4)
    facts, want = T.model_facts(got, train), T.model_facts(alone, train)
    assert facts[:2] == pytest.approx(want[:2]) and facts[4] == want[4]
    if want[2]:
        assert facts[2] == pytest.approx(want[2], rel=1e-9) and facts[3] == pytest.approx(want[3], rel=1e-9, abs=1e-9)


def test_inner_predictions_are_those_of_fits_one_by_one(searched):
    features, known, kept = searched
    train = features.where("fold <> 3 AND doc_id > 2")
    assert kept.count() == 4 * 2 * 4 * features.count()  # sets, points, the other four outer folds
    mine = kept.where("feature_set = 'Combined_Scaled' AND fold = 3")
    assert mine.groupBy("point", "inner_fold").count().where("count not in (14, 15)").count() == 0
    told = {r["inner_fold"] for r in kept.select("inner_fold").distinct().collect()}
    assert told == {1, 2, 3, 4, 5} and train.count() > 60
    assert T.best_point(T.point_scores(mine))[1] == pytest.approx(known["Combined_Scaled", "logreg", 3][1], abs=1e-12)


def test_inner_folds_and_scores_match_the_plain_search_in_few_passes(spark, monkeypatch):
    passes, once = [], L._Sums.loss_and_slope
    monkeypatch.setattr(L._Sums, "loss_and_slope", lambda *a: (passes.append(1), once(*a))[1])
    path = scratch_path(spark, "rows")
    entities(spark, F.crc32(F.col("id").cast("string")) % 3 + F.sin(F.col("id")) > 1).where("doc_id > 1").write.parquet(path)
    features, out = spark.read.parquet(path), scratch_path(spark, "inner")
    T.linear_search(features, ("Descriptors",), GRID, out)
    assert len(passes) < 120  # for 60 fits
    keys = ["point", "inner_fold", "doc_id", "y_true"]
    got = {tuple(r[k] for k in keys): r["y_prob"] for r in spark.read.parquet(out).where("fold = 1").collect()}
    plain = T.inner_predictions(features.where("fold <> 1"), "Descriptors", "logreg", GRID,
                                builder=lambda s, m, p: T.default_builder(s, m, p | {"turned": True}))
    assert got == pytest.approx({tuple(r[k] for k in keys): r["y_prob"] for r in plain.collect()}, abs=2e-4)


def test_folds_that_lack_a_class_and_odd_rows_are_left_to_the_plain_fit(spark):
    path = scratch_path(spark, "rows")
    entities(spark, F.col("id") == 5).write.parquet(path)  # one positive: no outer fold has it in all its inner fits
    assert T.linear_search(spark.read.parquet(path), ("Descriptors",), GRID, scratch_path(spark, "inner")) == {}
    odd = spark.read.parquet(path).withColumn(DESCRIPTOR_COLUMNS[2], F.lit(float("nan")))
    assert L.packed_rows(odd, DESCRIPTOR_COLUMNS) is None and L.packed_rows(odd.limit(0), DESCRIPTOR_COLUMNS) is None
