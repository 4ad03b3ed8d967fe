import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.llm import negatives


def brute(rows, every, k=5):
    usable = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows
              if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, va in {(i, lab, tuple(v)) for i, lab, v in usable if i % every == 0}:
        score = [(sum(p * q for p, q in zip(va, v)), i, lab) for i, lab, v in usable if len(v) == len(va)]
        pos = sorted((-s, i) for s, i, lab in score if lab == label and i != a)[:k]
        neg = [(s, i) for s, i, lab in score if lab != label]
        for p, pid in pos:
            fit = sorted((-s, i) for s, i in neg if 80 * -p <= 100 * s <= 100 * -p)[:k]
            out += [(a, pid, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit)]
    return sorted(out)


def table(spark, rows):
    wide = [(i, v, lab, "clash") for i, lab, v in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, positive_id string").repartition(4)


def vectors(seed, n, dims, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dims)
    data = (base + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, int(rng.integers(0, 4)), [float(x) for x in data[i]]) for i in range(n)]


@pytest.mark.parametrize("seed,dims,spread,size,anchors", [(1, 16, 1.0, 1 << 14, 1 << 14), (2, 64, 0.2, 37, 3), (3, 5, 3.0, 8, 2)])
def test_equals_brute_force(spark, seed, dims, spread, size, anchors):
    rows = vectors(seed, 400, dims, spread)
    got = negatives.hard_negatives(table(spark, rows), F.col("id") % 20 == 0, block_rows=size, block_anchors=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = vectors(4, 60, 6, 0.5) + [(None, 1, [1.0] * 6), (100, None, [1.0] * 6), (101, 1, None), (102, 1, [1.0, None] * 3),
                                     (103, 2, [float("nan")] * 6), (104, 2, [float("inf")] * 6), (200, 1, []), (201, 1, []), (202, 2, []),
                                     (300, 1, [1.0, 2.0]), (301, 1, [1.0, 2.0]), (302, 2, [0.9, 2.0]), (303, 2, [0.9, 2.0])]
    rows += [(20, 3, [0.5] * 6), (40, 0, [0.0] * 6), (41, 0, [0.0] * 6), (400, 0, [-1.0] * 6)]  # a second anchor row 20, zeros
    rng.shuffle(rows)
    got = negatives.hard_negatives(table(spark, rows), F.col("id") % 20 == 0, block_rows=16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_common_vector_and_ties(spark):
    rows = [(i, i % 2, [1.0, 2.0, 3.0]) for i in range(120)] + vectors(9, 40, 3)
    rows = [(n, lab, v) for n, (_, lab, v) in enumerate(rows)]
    got = negatives.hard_negatives(table(spark, rows), F.col("id") % 20 == 0, block_rows=32)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_empty_and_too_large(spark):
    assert negatives.hard_negatives(table(spark, []), F.col("id") % 20 == 0).count() == 0
    assert negatives.hard_negatives(table(spark, vectors(1, 5, 3)), F.col("id") < 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(table(spark, [(0, 1, [1e9, 1.0]), (1, 1, [1.0, 1.0])]), F.col("id") == 0).count()


def test_scan_reads_fewer_rows_than_there_are():
    rng = np.random.default_rng(1)
    data = rng.integers(-5, 5, (5000, 32))
    data[:10] += 100
    block = negatives.Block(np.arange(5000), np.zeros(5000, int), data)
    seen = []
    shrink = negatives.keep_best(5, None)

    def watch(low, high):
        seen.append(len(low))
        return shrink(low, high)

    rows, scores = block.scan(np.full(32, 50), np.ones(5000, dtype=bool), watch)
    assert seen[0] == 5000 and seen[-1] <= 10
    want = data @ np.full(32, 50)
    assert sorted(scores)[-5:] == sorted(want)[-5:] and (want[rows] == scores).all()
