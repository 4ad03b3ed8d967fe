"""the fitted run searches every feature set and model by inner folds."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scorelens.operators import tuning as T
from scorelens.operators.descriptors import DESCRIPTOR_COLUMNS
from scorelens.operators.folds import stratified_folds
from scorelens.plans import fitted as FT
from scorelens.session import scratch_path

KEYS = ["feature_set", "model", "fold"]


@pytest.fixture(scope="module")
def features(spark):
    """60 entities with 12 slots and descriptors; the label follows two of them."""
    cols = [F.sin(F.col("doc_id") * (j + 1)).alias(c) for j, c in enumerate(DESCRIPTOR_COLUMNS)]
    slots = array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda b: (F.crc32(
        F.concat_ws(",", b, "doc_id")) % 2).cast("double")))
    df = spark.range(1, 61).withColumnRenamed("id", "doc_id").select("doc_id", slots.alias("ecfp"), *cols)
    df = df.withColumn("label", (F.col("mol_wt") + F.col("tpsa") > 0).cast("double"))
    return stratified_folds(df, "doc_id", "label", k=5).repartition(1).cache()


@pytest.mark.parametrize("feature_set, model", [("Descriptors", "rf"), ("Combined_Naive", "gbt"), ("ECFP", "logreg")])
def test_the_run_searches_every_model(spark, features, feature_set, model):
    out = scratch_path(spark, "searched")
    point, score = FT.run_tuner(out)(features.where("fold <> 2"), feature_set, model)
    assert len(FT.SEARCH_GRIDS[model]) > 1 and point in FT.SEARCH_GRIDS[model] and 0 <= score <= 1
    kept = spark.read.parquet(f"{out}/inner_predictions")
    assert [tuple(r) for r in kept.select(KEYS).distinct().collect()] == [(feature_set, model, 2)]
    n = features.where("fold <> 2").count()
    assert {(r["point"], r["count"]) for r in kept.groupBy("point").count().collect()} == {(0, n), (1, n)}
    assert T.best_point(T.point_scores(kept))[1] == pytest.approx(score, abs=1e-12)
