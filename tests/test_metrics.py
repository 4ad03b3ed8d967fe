"""W2, W3, A4-A9, P20 against brute force and the published golden rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from scorelens.operators import metrics as M


def brute_auc(p, y):
    pos = [a for a, b in zip(p, y) if b == 1]
    neg = [a for a, b in zip(p, y) if b == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(p, y):
    P = sum(y)
    ap = 0.0
    for t in sorted(set(p), reverse=True):
        tp_t = sum(1 for a, b in zip(p, y) if a == t and b == 1)
        ctp = sum(1 for a, b in zip(p, y) if a >= t and b == 1)
        call = sum(1 for a in p if a >= t)
        ap += tp_t / P * ctp / call
    return ap


def _pred(spark, p, y, group="g"):
    return spark.createDataFrame([(group, float(a), int(b)) for a, b in zip(p, y)],
                                 "g string, y_prob double, y_true int")


def test_ties_match_brute_force(spark):
    p = [.9, .8, .8, .8, .5, .5, .1]
    y = [1, 1, 0, 1, 0, 1, 0]
    r = M.fold_metrics(_pred(spark, p, y), ["g"]).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(p, y), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(brute_ap(p, y), abs=1e-12)
    # p = 0.5 is class 0 (strictly greater than the threshold)
    assert r["tp"] == 3 and r["fp"] == 1


def test_many_buckets_equal_single_bucket(spark):
    import random

    rnd = random.Random(7)
    p = [round(rnd.random(), 2) for _ in range(500)]
    y = [rnd.randint(0, 1) for _ in range(500)]
    pred = _pred(spark, p, y)
    a = M.ranking_metrics(M.threshold_table(pred, ["g"], n_buckets=1), ["g"]).first()
    b = M.ranking_metrics(M.threshold_table(pred, ["g"], n_buckets=37), ["g"]).first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"], abs=1e-12)
    assert a["roc_auc"] == pytest.approx(brute_auc(p, y), abs=1e-12)
    assert b["pr_auc"] == pytest.approx(brute_ap(p, y), abs=1e-12)


def test_one_class_and_zero_division(spark):
    r = M.fold_metrics(_pred(spark, [.2, .7, .4], [0, 0, 0]), ["g"]).first()
    assert r["roc_auc"] is None and r["pr_auc"] is None
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert r["balanced_accuracy"] == pytest.approx(2 / 3)


# Published per-fold metrics of one feature set / model and its
# published summary row (mean and sample std over the 5 folds).
GOLDEN_FOLDS = [
    (0.7444444444444445, 0.7175925925925926, 0.7241379310344828, 0.5833333333333334,
     0.6461538461538462, 0.790380658436214, 0.7553875376068506),
    (0.7555555555555555, 0.7222222222222222, 0.7692307692307693, 0.5555555555555556,
     0.6451612903225806, 0.86059670781893, 0.8061824763424907),
    (0.7888888888888889, 0.7595614482406936, 0.8461538461538461, 0.5945945945945946,
     0.6984126984126984, 0.8561958184599695, 0.8282359925075544),
    (0.6888888888888889, 0.6624171341152474, 0.6551724137931034, 0.5135135135135135,
     0.5757575757575758, 0.7613462519122897, 0.64375371704841),
    (0.7666666666666667, 0.7284548699643039, 0.8636363636363636, 0.5135135135135135,
     0.6440677966101694, 0.8867924528301887, 0.8359271533164838),
]
GOLDEN_SUMMARY = {
    "accuracy": (0.7488888888888889, 0.03735052514215914),
    "balanced_accuracy": (0.718049653427012, 0.035157126161605275),
    "precision": (0.7716662647697131, 0.0863750402713763),
    "recall": (0.5521021021021021, 0.03798383340882355),
    "f1": (0.6419106414513741, 0.043594539119478054),
    "roc_auc": (0.8310623778915185, 0.052737909162031284),
    "pr_auc": (0.7738973753643579, 0.07925069763834985),
}


def test_metric_summary_golden(spark):
    rows = [("ECFP", "RF", f + 1, *vals) for f, vals in enumerate(GOLDEN_FOLDS)]
    df = spark.createDataFrame(rows, ["feature_set", "model", "fold", *M.METRIC_NAMES])
    r = M.metric_summary(df, ["feature_set", "model"]).first()
    for m, (mean, std) in GOLDEN_SUMMARY.items():
        assert r[f"{m}_mean"] == pytest.approx(mean, abs=1e-12)
        assert r[f"{m}_std"] == pytest.approx(std, abs=1e-12)


def test_confusion_pivot(spark):
    pred = _pred(spark, [.9, .1, .6, .4], [1, 1, 0, 0]).withColumn("y_pred", M.predict_class("y_prob"))
    cm = {r["actual"]: (r["pred_0"], r["pred_1"]) for r in M.confusion_matrix(pred, ["g"]).collect()}
    assert cm == {1: (1, 1), 0: (1, 1)}


def test_roc_reduction_keeps_ends_and_turns(spark):
    th = M.threshold_table(_pred(spark, [.9, .8, .7, .6, .5], [1, 1, 1, 0, 0]), ["g"]) \
        .withColumnRenamed("score", "threshold")
    kept = sorted(r["threshold"] for r in M.roc_points_reduced(th, ["g"]).collect())
    assert kept == [0.5, 0.7, 0.9]


def _steps(p, y):
    """Plain reduction: the first and the last score and every turn of the exact curve."""
    levels = sorted(set(p), reverse=True)
    step = [(sum(1 for a, b in zip(p, y) if a == t and b == 0), sum(1 for a, b in zip(p, y) if a == t and b == 1))
            for t in levels]
    return [t for i, t in enumerate(levels) if i in (0, len(levels) - 1)
            or step[i][0] * step[i + 1][1] != step[i][1] * step[i + 1][0]]


@pytest.mark.parametrize("n", [1, 7, 40])
def test_reduction_across_partitions_equals_plain_loop(spark, n):
    import random

    rnd = random.Random(n)
    groups = {g: ([round(rnd.random(), 2) for _ in range(size)], [rnd.randint(0, 1) for _ in range(size)])
              for g, size in (("a", 400), ("b", 30), ("c", 1))}
    pred = None
    for g, (p, y) in groups.items():
        part = _pred(spark, p, y, g)
        pred = part if pred is None else pred.unionByName(part)
    th = M.threshold_table(pred, ["g"], n_buckets=n).withColumnRenamed("score", "threshold")
    kept = M.roc_points_reduced(th, ["g"]).collect()
    for g, (p, y) in groups.items():
        assert sorted((r["threshold"] for r in kept if r["g"] == g), reverse=True) == _steps(p, y)


def test_input_is_read_once_and_exchanges_are_few(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    pred = _pred(spark, [i / 1000 for i in range(1000)], [i % 2 for i in range(1000)])
    counted = pred.mapInArrow(count, pred.schema)
    th = M.threshold_table(counted, ["g"])
    th.collect()
    M.ranking_metrics(th, ["g"]).collect()
    assert reads.value == 1000
    plan = th._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") <= 4 and "Python" not in initial


def test_pair_counts_beyond_64_bits(spark):
    big = 6_000_000_000
    th = spark.createDataFrame([("g", .9, big, 0, big, 0, big, big), ("g", .1, 0, big, big, big, big, big)],
                               "g string, score double, pos long, neg long, cum_pos long, cum_neg long, P long, N long")
    r = M.ranking_metrics(th, ["g"]).first()
    assert r["roc_auc"] == 1.0 and r["pr_auc"] == 1.0
