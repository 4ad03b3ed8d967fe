"""Fits and tree attributions spread over the cores and cost what the rows need."""

from scorelens.operators import models as MD
from scorelens.operators import treeshap as TS
from scorelens.plans import job as JOB


def test_features_are_spread_over_the_cores():
    assert JOB.fit_partitions(0, 12) == JOB.fit_partitions(999, 12) == 1
    assert JOB.fit_partitions(3_980, 12) == 3
    assert JOB.fit_partitions(20_598, 12) == 12
    assert JOB.fit_partitions(1_200_000, 12) == 24


def test_forests_keep_the_node_of_a_row(spark):
    assert MD.build_rf().getCacheNodeIds()


def test_one_entry_per_edge_of_a_tree():
    # features 0, 1, 0: the third edge pair replaces the bounds of the first
    tree = {"left": [1, -1, 3, -1, 5, -1, -1], "right": [2, -1, 4, -1, 6, -1, -1], "feature": [0, -1, 1, -1, 0, -1, -1],
            "threshold": [0.0, 0, 0.0, 0, 1.0, 0, 0], "value": [0.0, 1.0, 0, 2.0, 0, 3.0, 4.0],
            "cover": [10.0, 4.0, 6.0, 2.0, 4.0, 1.0, 3.0]}
    edges = TS.leaf_paths(tree)
    assert len(edges["z"]) == 6 and edges["width"] == 2 and edges["levels"] == [0, 2, 4, 6]
    assert edges["parent"].tolist() == [-1, -1, 1, 1, 3, 3] and edges["before"].tolist() == [-1, -1, -1, -1, 1, 1]
    assert edges["low"].tolist()[4:] == [0.0, 1.0] and edges["high"].tolist()[4:] == [1.0, float("inf")]
    assert abs(edges["z"][5] - 0.6 * 3 / 4) < 1e-12
