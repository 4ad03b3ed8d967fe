"""Ties, null-safe merge, lookup default."""

from scorelens.operators import importance as I


def test_topn_ties_by_index(spark):
    df = spark.createDataFrame([("m", i, 1.0 if i < 25 else 0.5) for i in range(30)],
                               "model string, feature_idx long, mean_abs double")
    top = I.top_n_per_group(df, ["model"], 20).collect()
    assert sorted(r["feature_idx"] for r in top) == list(range(20))
    assert [r["feature_idx"] for r in I.top_n(df, 3).collect()] == [0, 1, 2]


def test_merge_groups_null_fragments(spark):
    df = spark.createDataFrame(
        [("a", "f1", 1.0, None), ("b", "f1", 2.0, None), ("a", "f2", 3.0, "x"), ("b", "f2", 4.0, "y")],
        "model string, feature string, mean_abs double, fragment string")
    out = I.merge_models(df, ["a", "b"]).collect()
    assert len(out) == 3
    nullrow = [r for r in out if r["feature"] == "f1"][0]
    assert nullrow["mean_abs_a"] == 1.0 and nullrow["mean_abs_b"] == 2.0


def test_lookup_na_only_when_absent(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "bit long")
    dic = spark.createDataFrame([(1, "frag"), (2, None)], "bit long, fragment string")
    got = {r["bit"]: r["fragment"] for r in I.lookup_with_default(left, dic, ["bit"], "fragment").collect()}
    assert got == {1: "frag", 2: None, 3: "N/A"}


def test_last_per_key_keeps_null_winner(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 1)], "bit long, fragment string, o int")
    got = {r["bit"]: r["fragment"] for r in I.last_per_key(df, ["bit"], "fragment", ["o"]).collect()}
    assert got == {1: None, 2: "b"}
