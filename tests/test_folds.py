"""Fold sizes and class split as in the published folds; partition invariance."""

from pyspark.sql import functions as F

from scorelens.operators.folds import inner_folds, stratified_folds


def _labels(spark, n0=267, n1=183):
    rows = [(i, 0) for i in range(n0)] + [(n0 + i, 1) for i in range(n1)]
    return spark.createDataFrame(rows, "id long, label int")


def test_published_fold_sizes(spark):
    f = stratified_folds(_labels(spark), "id", "label")
    sizes = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    pos = {r["fold"]: r["count"] for r in f.filter("label = 1").groupBy("fold").count().collect()}
    assert sizes == {1: 90, 2: 90, 3: 90, 4: 90, 5: 90}
    assert pos == {1: 36, 2: 36, 3: 37, 4: 37, 5: 37}


def test_partitioning_does_not_change_folds(spark):
    df = _labels(spark, 120, 57)
    a = {r["id"]: r["fold"] for r in stratified_folds(df.repartition(1), "id", "label").collect()}
    b = {r["id"]: r["fold"] for r in stratified_folds(df.repartition(13), "id", "label").collect()}
    c = {r["id"]: r["fold"] for r in stratified_folds(df, "id", "label", prefix_hex=1).collect()}
    assert a == b == c


def test_null_labels_rejected(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "id long, label int")
    assert stratified_folds(df, "id", "label").count() == 2


def test_inner_folds_exclude_test_rows(spark):
    outer = stratified_folds(_labels(spark, 60, 40), "id", "label")
    inner = inner_folds(outer, "id", "label")
    assert inner.filter(F.col("fold") == F.col("outer_fold")).count() == 0
    assert inner.count() == 100 * 4
    per = inner.groupBy("outer_fold", "inner_fold").count().collect()
    for o in range(1, 6):
        sizes = [r["count"] for r in per if r["outer_fold"] == o]
        assert max(sizes) - min(sizes) <= 1
