"""F1: forests whose trees outgrow the driver are grown, stored and scored a group of trees at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from scorelens.operators import models as MD
from scorelens.operators import treeshap as TS


@pytest.fixture(scope="module")
def data(spark):
    """60 rows, two of them equal, whose label follows two of five columns."""
    x = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.sin(F.greatest("doc_id", F.lit(2)) * j))
    df = spark.range(1, 61).withColumnRenamed("id", "doc_id").select("doc_id", array_to_vector(x).alias("features"))
    y = (vector_to_array("features")[0] + vector_to_array("features")[2] > 0).cast("double")
    return df.select("*", y.alias("label"), (1 + y).alias(MD.WEIGHT_COL)).repartition(2).cache()


def test_groups_make_one_forest(spark, data, monkeypatch):
    monkeypatch.setattr(MD, "TREE_ROWS", 60 * 3)
    grown, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: (grown.append(self.getNumTrees()), fit(self, df))[1])
    model = MD.build_rf(n_estimators=7, max_depth=None, min_samples_leaf=1).fit(data)
    assert grown == [3, 3, 1] and model.numFeatures == 5
    tables = TS.tree_tables(spark, model, "rf")
    assert len(tables["trees"]) == 7 and len({str(t["threshold"]) for t in tables["trees"]}) > 1
    got = {r["doc_id"]: (r["p"], r["raw"], r["prediction"]) for r in model.transform(data).select(
        "doc_id", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("raw"), "prediction").collect()}
    rows = data.select("doc_id", "features").collect()
    x = np.array([r["features"].toArray() for r in rows])
    want = sum(TS.leaf_values(x, t) for t in tables["trees"]) / 7
    for r, p in zip(rows, want):
        assert got[r["doc_id"]][0] == pytest.approx([1 - p, p], abs=1e-12)
        assert got[r["doc_id"]][1] == pytest.approx([7 - 7 * p, 7 * p], abs=1e-9) and got[r["doc_id"]][2] == float(p > 0.5)
    told = TS.explain_rows(data.withColumn("x", vector_to_array("features")), tables, "x", ["doc_id"], 5).collect()
    assert len(got) == len(told) == 60
    for r in told:
        assert r["baseline"] + sum(r["phi"]) == pytest.approx(got[r["doc_id"]][0][1], abs=1e-9)


def test_small_forests_are_sparks_own_and_score_alike(spark, data):
    model = MD.build_rf(n_estimators=4, max_depth=None, min_samples_leaf=1).fit(data)
    assert isinstance(model, RandomForestClassificationModel) and model.getNumTrees == 4
    lean = data.select(F.col("doc_id").alias("_row"), vector_to_array("features").alias("x"))
    votes = {r["_row"]: r["votes"] for r in TS.forest_votes(lean, TS.tree_tables(spark, model, "rf")["trees"]).collect()}
    for r in model.transform(data).collect():
        assert votes[r["doc_id"]] / 4 == pytest.approx(r["probability"][1], abs=1e-12)
