"""Grid scoring, nested cross-validation, plug-ins, stored outputs."""

import json
import warnings

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scorelens.operators import tuning as T
from scorelens.operators.descriptors import DESCRIPTOR_COLUMNS
from scorelens.operators.folds import stratified_folds
from scorelens.session import scratch_path
from scorelens.sources import files as IO


def rows(spark, n, positive):
    """n entities with descriptors; the label follows two of them where ``positive`` says so."""
    cols = [F.sin(F.col("doc_id") * (j + 1)).alias(c) for j, c in enumerate(DESCRIPTOR_COLUMNS)]
    df = spark.range(1, n + 1).withColumnRenamed("id", "doc_id").select("doc_id", *cols)
    return df.withColumn("label", F.when(positive, 1.0).otherwise(0.0))


@pytest.fixture(scope="module")
def features(spark):
    df = rows(spark, 60, F.col("mol_wt") + F.col("tpsa") > 0)
    return stratified_folds(df, "doc_id", "label", k=3).repartition(1).cache()


def small(feature_set, model, params):
    return T.default_builder(feature_set, model, params)


def test_point_scores_are_exact_and_null_without_both_classes(spark):
    pred = spark.createDataFrame(
        [(0, 1, 1, 0.9), (0, 1, 0, 0.1), (0, 2, 0, 0.2), (0, 2, 0, 0.3),          # fold 2 has no positive
         (1, 1, 1, 0.5), (1, 1, 0, 0.5), (1, 2, 0, 0.9), (1, 2, 0, 0.8),          # a tie counts half
         (2, 1, 0, 0.5), (2, 2, 0, 0.5)], "point int, inner_fold int, y_true int, y_prob double")
    got = {r["point"]: (r["mean_auc"], r["n_scored"], r["n_folds"]) for r in T.point_scores(pred).collect()}
    assert got == {0: (1.0, 1, 2), 1: (0.5, 1, 2), 2: (None, 0, 2)}
    assert T.best_point(T.point_scores(pred)) == (0, 1.0)
    assert T.best_point(T.point_scores(pred.where("point = 2"))) == (2, None)
    tied = pred.where("point = 0").unionByName(pred.where("point = 0").withColumn("point", F.lit(5)))
    assert T.best_point(T.point_scores(tied)) == (0, 1.0)


def test_one_class_inner_fold_does_not_move_the_pick(spark):
    """Three positives over five inner folds: two folds have none and must not count as 0 or 1."""
    train = rows(spark, 40, F.col("doc_id").isin(7, 20, 33)).repartition(1)
    pred = T.inner_predictions(train, "Descriptors", "logreg", [{"C": 0.1}, {"C": 1.0}])
    scores = {r["point"]: r for r in T.point_scores(pred).collect()}
    assert all(r["n_scored"] == 3 and r["n_folds"] == 5 for r in scores.values())
    for point, row in scores.items():
        want = []
        local = pred.where(F.col("point") == point).collect()
        for f in range(1, 6):
            pos = [r["y_prob"] for r in local if r["inner_fold"] == f and r["y_true"] == 1]
            neg = [r["y_prob"] for r in local if r["inner_fold"] == f and r["y_true"] == 0]
            if pos and neg:
                want.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
        assert row["mean_auc"] == pytest.approx(sum(want) / len(want), abs=1e-12)


def test_grid_search_scores_one_point_on_request(spark, features):
    fitted, params, score = T.grid_search(features, "Descriptors", "logreg", quick=True, k=3, score_single=True)
    assert params == {"C": 1} and 0.5 < score <= 1 and fitted.stages[-1].numFeatures == 15
    assert T.grid_search(features, "Descriptors", "logreg", quick=True)[2] is None


def test_rf_grid_drops_what_spark_lacks():
    points = T.distinct_points("rf", quick=False)
    assert len(points) == 24 and all("min_samples_split" not in p for p in points)
    assert len(T.distinct_points("gbt", quick=False)) == 144


def test_nested_cv_stores_scores_explanations_and_parameters(spark, features):
    out = scratch_path(spark, "nested")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        info = T.nested_cv(features, out, ("Descriptors", "Nonsense"), ("logreg", "no_such_model"), n_folds=3, explained=True)
    assert sorted(str(w.message).split("'")[1] for w in seen if "skipped" in str(w.message)) == ["Nonsense", "no_such_model"]
    assert [(i["feature_set"], i["model"], i["fold"]) for i in info] == [("Descriptors", "logreg", f) for f in (1, 2, 3)]
    pred = IO.scan_predictions(spark, f"{out}/predictions")
    text = IO.scan_predictions(spark, f"{out}/predictions_csv", "csv")
    assert sorted(map(tuple, pred.select(text.columns).collect())) == sorted(map(tuple, text.collect()))
    assert dict(text.dtypes) == {"doc_id": "bigint", "y_true": "int", "y_prob": "double", "y_pred": "int", "dataset": "string",
                                 "feature_set": "string", "model": "string", "fold": "bigint"}
    assert sorted(r["doc_id"] for r in pred.collect()) == list(range(1, 61))  # each entity is a test row once
    told = spark.read.parquet(f"{out}/attributions")
    assert told.where("split = 'train'").count() == 120 and told.where("split = 'test'").count() == 60
    for r in told.collect():
        assert r["baseline"] + sum(r["phi"]) == pytest.approx(r["output"], abs=1e-9)
    imp = spark.read.parquet(f"{out}/importance").where("fold = 2 AND feature = 'tpsa'").first()
    phis = [abs(r["phi"][imp["feature_idx"]]) for r in told.where("fold = 2 AND split = 'train'").collect()]
    assert imp["mean_abs"] == pytest.approx(sum(phis) / len(phis), rel=1e-9)
    params = IO.read_params(spark, f"{out}/best_params").orderBy("fold").collect()
    assert [(r["fold"], r["best_params"], r["inner_cv_best_score"]) for r in params] == [(f, {"C": "1"}, None) for f in (1, 2, 3)]
    facts = spark.read.parquet(f"{out}/facts").collect()
    assert {(r["n_train"], r["n_test"], r["n_features"]) for r in facts} == {(40, 20, 15)}
    assert all(r["gradient_ratio"] < 1e-4 and abs(r["weight_0"] * 2 - 40 / (40 - r["weight_1"] ** -1 * 20)) < 1e-9 for r in facts)


def test_user_builder_and_tuner_run_through(spark, features):
    """An estimator the library does not know, tuned by the user's own function."""
    calls = []

    def builder(feature_set, model, params):
        return Pipeline(stages=[VectorAssembler(inputCols=["mol_wt", "tpsa"], outputCol="features"),
                                LogisticRegression(regParam=params["reg"], labelCol="label")])

    def tuner(train, feature_set, model):
        calls.append((feature_set, model, train.count()))
        return {"reg": 0.5}, 0.75

    out = scratch_path(spark, "own")
    info = T.nested_cv(features, out, ("Descriptors",), ("mine",), n_folds=3, builder=builder, tuner=tuner, workers=1)
    assert calls == [("Descriptors", "mine", 40)] * 3
    assert [(json.loads(i["best_params"]), i["inner_cv_best_score"]) for i in info] == [({"reg": 0.5}, 0.75)] * 3
    pred = IO.scan_predictions(spark, out)
    assert pred.count() == 60 and {r["model"] for r in pred.select("model").distinct().collect()} == {"mine"}


def test_other_classifiers_are_not_explained(spark, features):
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["mol_wt"], outputCol="features"), LinearSVC(labelCol="label")])
    assert T.explain(pipe.fit(features), features, features, ["doc_id"]) is None
