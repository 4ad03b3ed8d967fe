import random

import pytest

from scorelens.operators.components import connected_labels


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_labels_equal_union_find(spark, kind):
    rng = random.Random(2)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
             "path": list(zip(range(120), range(1, 121), strict=True)),
             "star": [(500, i) for i in range(100)] + [(i, i) for i in range(90, 95)],
             "loops": [(3, 3), (4, 4), (4, 4)]}[kind]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long")
    got = {r.node: r.component for r in connected_labels(df).collect()}
    assert got == union_find(edges)


def test_no_edges(spark):
    assert connected_labels(spark.createDataFrame([], "a long, b long")).count() == 0
