"""Evaluation metrics over a predictions table.

Input: one row per scored entity with the group keys (e.g. model, fold), a
0/1 ``y_true`` and a probability ``y_prob``.  Every metric is an aggregate, so
all groups (all models, all folds) are evaluated in one pass.

Ranking metrics are exact:

* ROC-AUC counts tied scores as half (Mann-Whitney), never down-samples.
* PR-AUC is average precision, the step sum over distinct thresholds, not a
  trapezoid.

Both need running totals over the scores in descending order.  Scores are
first collapsed to distinct values per group (ties merge, map-side partial
aggregation), range-partitioned by (group, score) and checkpointed: the input
is read once, and totals, offsets, running sums and the confusion counts all
come from that table.  A running sum is taken inside one range partition and
shifted by the sum of the group's earlier ones, so no group, however large,
lands in one task and nothing large is joined on the group keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.exprs import safe_div
from scorelens.session import checkpointed

METRIC_NAMES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def predict_class(y_prob, threshold: float = 0.5):
    """P20: positive iff the probability is strictly above the threshold."""
    return (F.col(y_prob) > F.lit(threshold)).cast("int") if isinstance(y_prob, str) \
        else (y_prob > F.lit(threshold)).cast("int")


def confusion_counts(pred: DataFrame, group_cols: Sequence[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """tp / fp / tn / fn / n per group (one aggregate, partial on the map side)."""
    return pred.groupBy(*group_cols).agg(*_confusion_aggs(y_true, y_pred)).withColumnRenamed("n_rows", "n")


def _confusion_aggs(y_true: str, y_pred: str) -> list:
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(t & ~p).alias("fn"),
    ]


def classification_metrics(counts: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 (0 on 0/0).

    Balanced accuracy is the mean recall of the classes present in y_true.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    tpr, tnr = tp / pos, tn / neg
    return counts.select(
        *group_cols, "n", "tp", "fp", "tn", "fn",
        safe_div(tp + tn, F.col("n")).alias("accuracy"),
        F.when((pos > 0) & (neg > 0), (tpr + tnr) / 2)
        .when(pos > 0, tpr).when(neg > 0, tnr).alias("balanced_accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, pos).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


CONFUSION = ("n_rows", "tp", "fp", "tn", "fn")


def score_counts(pred: DataFrame, group_cols: Sequence[str], y_true: str = "y_true", y_prob: str = "y_prob",
                 y_pred: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """Checkpointed (group..., score, pos, neg[, n_rows, tp, fp, tn, fn], _part): one row per distinct score of a group.

    ``_part`` grows with the order (group, score descending); ``n_buckets``
    range partitions, else the session's shuffle partitions.  With ``y_pred``
    the confusion counts of the rows at each score come along.
    """
    dist = pred.groupBy(*group_cols, F.col(y_prob).alias("score")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"),
        F.count_if(F.col(y_true) == 0).alias("neg"),
        *(_confusion_aggs(y_true, y_pred) if y_pred else []),
    )
    order = [*[F.col(c) for c in group_cols], F.col("score").desc()]
    ranged = dist.repartitionByRange(n_buckets, *order) if n_buckets else dist.repartitionByRange(*order)
    return checkpointed(ranged.withColumn("_part", F.spark_partition_id()))


def threshold_table(pred: DataFrame, group_cols: Sequence[str], y_true: str = "y_true", y_prob: str = "y_prob",
                    y_pred: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """One row per (group, distinct score) with counts and cumulative counts from the top.

    Columns: group..., score, pos, neg[, n_rows, tp, fp, tn, fn], cum_pos, cum_neg, P, N and
    next_pos, next_neg (counts of the group's next lower score, null at its last).
    """
    group_cols = list(group_cols)
    counts = score_counts(pred, group_cols, y_true, y_prob, y_pred, n_buckets)
    keys = [*group_cols, "_part"]
    # at most one row a group and one a range partition
    parts = counts.groupBy(*keys).agg(
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"),
        F.max(F.struct("score", "pos", "neg")).alias("_top"))
    group = Window.partitionBy(*group_cols)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.lead("_top").over(group.orderBy("_part"))
    offsets = parts.select(
        *keys,
        F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_off_pos"),
        F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_off_neg"),
        F.sum("_pos").over(group).alias("P"), F.sum("_neg").over(group).alias("N"),
        below["pos"].alias("_below_pos"), below["neg"].alias("_below_neg"))
    part = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    upto = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = counts.join(offsets, keys)
    return joined.select(
        *[c for c in counts.columns if c != "_part"],
        (F.col("_off_pos") + F.sum("pos").over(upto)).alias("cum_pos"),
        (F.col("_off_neg") + F.sum("neg").over(upto)).alias("cum_neg"), "P", "N",
        F.coalesce(F.lead("pos").over(part), F.col("_below_pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(part), F.col("_below_neg")).alias("next_neg"))


def ranking_metrics(thresholds: DataFrame, group_cols: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """W2 + W3: ROC-AUC with half ties and average precision, per group (and the sums of ``sums``).

    AUC = sum_s pos_s * (2 * (N - cum_neg_s) + neg_s) / (2 P N), all in integers
    (of 38 digits: P * N passes 64 bits at some 3 billion rows a class) up to the last
    division; null when a class is absent.
    AP  = sum_s pos_s * cum_pos_s / (cum_pos_s + cum_neg_s) / P; null when P = 0.
    """
    pos, neg, cp, cn = (F.col(c) for c in ("pos", "neg", "cum_pos", "cum_neg"))
    pairs = pos.cast("decimal(18,0)") * (2 * (F.col("N") - cn) + neg).cast("decimal(19,0)")
    agg = thresholds.groupBy(*group_cols).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(pairs).alias("_auc_num"),
        F.sum(F.when(pos > 0, pos * (cp / (cp + cn)))).alias("_ap_num"),
        *[F.sum(c).alias(c) for c in sums],
    )
    P, N = F.col("P"), F.col("N")
    return agg.select(
        *group_cols,
        F.when((P > 0) & (N > 0),
               F.col("_auc_num").cast("double") / (2.0 * P.cast("double") * N.cast("double"))
               ).alias("roc_auc"),
        F.when(P > 0, F.col("_ap_num") / P.cast("double")).alias("pr_auc"),
        *sums,
    )


def roc_points(thresholds: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, cumulative from the top."""
    return thresholds.select(
        *group_cols,
        F.col("score").alias("threshold"),
        safe_div(F.col("cum_neg"), F.col("N"), None).alias("fpr"),
        safe_div(F.col("cum_pos"), F.col("P"), None).alias("tpr"),
    )


def roc_points_reduced(points: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Drop ROC points that lie on the segment between their neighbours.

    Input: the threshold table (``threshold`` = distinct score).  A point is
    kept if it is the first or the last of its group, or if its step (neg, pos)
    is not parallel to the next step (next_neg, next_pos):
    neg * next_pos - pos * next_neg != 0 (38-digit integers, no float noise).
    """
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("pos", "neg", "next_pos", "next_neg")}
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    turn = wide["neg"] * wide["next_pos"] - wide["pos"] * wide["next_neg"]
    return points.filter(first | F.col("next_pos").isNull() | (turn != 0)).drop("next_pos", "next_neg")


def fold_metrics(pred: DataFrame, group_cols: Sequence[str], y_true: str = "y_true",
                 y_prob: str = "y_prob", threshold: float = 0.5) -> DataFrame:
    """All seven metrics per group (e.g. dataset, feature_set, model, fold)."""
    group_cols = list(group_cols)
    scored = pred.withColumn("y_pred", predict_class(y_prob, threshold)) \
        if "y_pred" not in pred.columns else pred
    ranked = ranking_metrics(threshold_table(scored, group_cols, y_true, y_prob, "y_pred"), group_cols, CONFUSION)
    return classification_metrics(ranked.withColumnRenamed("n_rows", "n"), [*group_cols, "roc_auc", "pr_auc"])


def metric_summary(per_fold: DataFrame, group_cols: Sequence[str],
                   metrics: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """A4 + A5: mean and sample std (ddof = 1) of each metric per group."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return per_fold.groupBy(*group_cols).agg(*aggs)


def confusion_matrix(pred: DataFrame, group_cols: Sequence[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Rows actual class, columns predicted class (pivot on the fixed values 0, 1)."""
    return (
        pred.groupBy(*group_cols, F.col(y_true).alias("actual"))
        .pivot(y_pred, [0, 1]).count()
        .withColumnRenamed("0", "pred_0").withColumnRenamed("1", "pred_1")
        .na.fill(0, ["pred_0", "pred_1"])
    )
