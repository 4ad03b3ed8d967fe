"""Tree attributions add up to the model output and reproduce Spark's probability."""

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelens.operators import treeshap as TS


@pytest.fixture(scope="module")
def data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    df = df.select("vec_id", (F.col("label") < 5).cast("double").alias("label"),
                   *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(6)])
    return VectorAssembler(inputCols=[f"e{j}" for j in range(6)], outputCol="features").transform(df)


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_additivity_and_output(spark, data, kind):
    est = (RandomForestClassifier(numTrees=7, maxDepth=4, seed=1) if kind == "rf"
           else GBTClassifier(maxIter=5, maxDepth=3, seed=1))
    model = est.fit(data)
    tables = TS.tree_tables(spark, model, kind)
    scored = model.transform(data).withColumn("x", vector_to_array("features")) \
        .withColumn("p1", vector_to_array("probability")[1])
    out = TS.explain_rows(scored, tables, "x", ["vec_id"], 6) \
        .join(scored.select("vec_id", "p1"), "vec_id").collect()
    for r in out:
        assert r["baseline"] + sum(r["phi"]) == pytest.approx(r["output"], abs=1e-9)
        p = r["output"] if kind == "rf" else 1 / (1 + pytest.importorskip("math").exp(-2 * r["output"]))
        assert p == pytest.approx(r["p1"], abs=1e-9)


def _expected(tree, x, known, node=0):
    """Model output when only the features in ``known`` are known: others follow the covers."""
    left, right, cover = tree["left"], tree["right"], tree["cover"]
    if left[node] < 0:
        return tree["value"][node]
    if tree["feature"][node] in known:
        go = left[node] if x[tree["feature"][node]] <= tree["threshold"][node] else right[node]
        return _expected(tree, x, known, go)
    return sum(cover[c] / cover[node] * _expected(tree, x, known, c) for c in (left[node], right[node]))


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_equals_shapley_values_over_all_subsets(spark, data, kind):
    import itertools
    import math

    import numpy as np

    est = (RandomForestClassifier(numTrees=3, maxDepth=6, seed=2) if kind == "rf"
           else GBTClassifier(maxIter=3, maxDepth=5, seed=2))
    tables = TS.tree_tables(spark, est.fit(data), kind)
    x = np.array([[r[f"e{j}"] for j in range(6)] for r in data.limit(12).collect()])
    for tree in tables["trees"]:
        phi = np.zeros((12, 6))
        TS.add_attributions(x, TS.leaf_paths(tree), phi, 1.0)
        for row in range(12):
            for i in range(6):
                rest = [j for j in range(6) if j != i]
                want = sum(math.factorial(k) * math.factorial(5 - k) / 720
                           * (_expected(tree, x[row], {*s, i}) - _expected(tree, x[row], set(s)))
                           for k in range(6) for s in itertools.combinations(rest, k))
                assert phi[row, i] == pytest.approx(want, abs=1e-9)


def test_stump_and_leaf_only_trees():
    import numpy as np

    leaf = {"left": [-1], "right": [-1], "feature": [-1], "threshold": [0.0], "value": [0.25], "cover": [8.0]}
    stump = {"left": [1, -1, -1], "right": [2, -1, -1], "feature": [1, -1, -1], "threshold": [0.5, 0.0, 0.0],
             "value": [0.25, 0.0, 1.0], "cover": [8.0, 6.0, 2.0]}
    x = np.array([[9.0, 0.5], [9.0, 0.6]])
    for tree, want in ((leaf, [[0, 0], [0, 0]]), (stump, [[0, -0.25], [0, 0.75]])):
        phi = np.zeros((2, 2))
        TS.add_attributions(x, TS.leaf_paths(tree), phi, 1.0)
        assert phi.tolist() == want
    assert TS.leaf_values(x, stump).tolist() == [0.0, 1.0] and TS.leaf_values(x, leaf).tolist() == [0.25, 0.25]
