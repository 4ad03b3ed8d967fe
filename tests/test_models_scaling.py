"""Scaler, attribution additivity, grids, encoders, weights."""

import pytest
from pyspark.sql import functions as F

from scorelens.operators import attribution as A
from scorelens.operators import clean as C
from scorelens.operators import models as MD
from scorelens.operators.scaling import FamilyScaler


def test_scaler_population_std_and_constant_column(spark):
    train = spark.createDataFrame([(1.0, 5.0, 1), (3.0, 5.0, 0), (5.0, 5.0, 1)], "a double, c double, bit int")
    test = spark.createDataFrame([(7.0, 9.0, 1)], "a double, c double, bit int")
    m = FamilyScaler(inputCols=["a", "c"], outputCols=["a", "c"]).fit(train)
    z = m.transform(train).agg(F.avg("a"), F.var_pop("a")).first()
    assert z[0] == pytest.approx(0.0, abs=1e-12) and z[1] == pytest.approx(1.0)
    t = m.transform(test).first()
    assert t["c"] == pytest.approx(4.0)  # zero spread in train: divide by 1
    assert t["bit"] == 1  # other families untouched


def test_linear_attribution_additivity(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    w, mu = A.class_mean_difference(df, "embedding", 64, F.col("label") < 5)
    att = A.linear_attributions(df, "embedding", w, mu, intercept=0.25)
    gap = att.select(F.abs(F.col("baseline") + A.attribution_sum("phi") - F.col("raw_score")).alias("d"))
    assert gap.agg(F.max("d")).first()[0] < 1e-9


def test_grid_sizes():
    assert [len(MD.grid_points(m, False)) for m in ("rf", "logreg", "xgb")] == [48, 4, 144]
    assert [len(MD.grid_points(m, True)) for m in ("rf", "logreg", "xgb")] == [1, 1, 1]
    with pytest.raises(ValueError):
        MD.grid_points("svm", True)


def test_label_encoder_sorted_and_unseen_is_error(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "t string")
    m = C.fit_label_encoder(train, "t", "code")
    codes = {r["t"]: r["code"] for r in m.transform(train).collect()}
    assert codes == {"a": 0.0, "b": 1.0, "c": 2.0}
    with pytest.raises(Exception):
        m.transform(spark.createDataFrame([("z",)], "t string")).collect()


def test_balanced_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = {r["label"]: r["weight"] for r in C.class_weights(df).collect()}
    assert w[0] == pytest.approx(8 / 12) and w[1] == pytest.approx(8 / 4)
    bw = MD.BalancedWeights(labelCol="label").fit(df)
    got = {r["label"]: r["class_weight"] for r in bw.transform(df).distinct().collect()}
    assert got == pytest.approx(w)


def test_label_codes_follow_the_order_over_many_partitions(spark):
    train = spark.range(5000).selectExpr("concat('v', id % 1000) AS t", "id AS _code").unionByName(
        spark.createDataFrame([(None, 1)], "t string, _code long"))
    got = {r["t"]: r["t_code"] for r in C.fit_label_encoder(train, "t").transform(train.where("t IS NOT NULL")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(1000)))}
    nums = spark.createDataFrame([(3,), (-1,), (10,), (3,)], "n int")
    assert sorted((r["n"], r["c"]) for r in C.fit_label_encoder(nums, "n", "c").transform(nums).collect()) == [
        (-1, 0), (3, 1), (3, 1), (10, 2)]
    with pytest.raises(Exception, match="without a code"):
        C.fit_label_encoder(nums, "n", "c").transform(spark.createDataFrame([(4,)], "n int")).collect()
    assert C.fit_label_encoder(nums.limit(0), "n", "c").transform(nums.limit(0)).count() == 0
