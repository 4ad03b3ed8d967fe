"""Importance tables and reports.

Importance of a feature for a model = mean |attribution| over rows.  For a
binary slot x_b under the class-mean-difference model (weight
w_b = P(b | y=1) - P(b | y=0), background p_b = P(b)), mean |phi_b| is
|w_b| * 2 p_b (1 - p_b): it follows from three counts per slot, so the
importance of every hashed slot is one group-by over the (entity, bit) pairs
-- no dense entity x 1024 matrix is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ECFP_PREFIX = "ECFP_"


def bit_importance(bits: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   label_col: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., bit, n1, n0, mean_abs) from distinct (id, bit) pairs and (id, label).

    Class totals come from ``labels``; per-slot counts from one aggregate of
    the pairs joined to their label.
    """
    group_cols = list(group_cols)
    keys = group_cols or ["_all"]
    if not group_cols:
        labels = labels.withColumn("_all", F.lit(1))
    tot = labels.groupBy(*keys).agg(
        F.count_if(F.col(label_col) == 1).alias("tot_pos"),
        F.count_if(F.col(label_col) == 0).alias("tot_neg"))
    # one label row a model and id: hashed, so the slots stream past without a sort
    per = bits.join(labels.hint("shuffle_hash"), id_col, "inner").groupBy(*keys, "bit").agg(
        F.count_if(F.col(label_col) == 1).alias("n1"),
        F.count_if(F.col(label_col) == 0).alias("n0"))
    j = per.join(tot, keys, "inner")
    w = F.col("n1") / F.col("tot_pos") - F.col("n0") / F.col("tot_neg")
    p = (F.col("n1") + F.col("n0")) / (F.col("tot_pos") + F.col("tot_neg"))
    return j.select(*group_cols, "bit", "n1", "n0",
                    (F.abs(w) * 2 * p * (1 - p)).alias("mean_abs"))


def pooled_bit_importance(bits: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "label",
                          fold_col: str = "fold", group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """F8: (group..., bit, mean_abs): mean over outer folds of the slot importance on each fold's training rows.

    Training counts are totals minus the fold's own, so a row is counted once, not
    once per fold it trains in.  A fold whose training rows never set the slot
    says nothing about it and leaves the mean alone.
    """
    keys = list(group_cols)
    pos, neg = F.count_if(F.col(label_col) == 1), F.count_if(F.col(label_col) == 0)

    def per_fold(rows, extra):
        by = rows.groupBy(*keys, *extra, fold_col).agg(pos.alias("p"), neg.alias("n"))
        return by.groupBy(*keys, *extra).agg(  # one entry per fold
            F.map_from_entries(F.collect_list(F.struct(F.col(fold_col), F.struct("p", "n")))).alias("by"),
            F.sum("p").alias("p"), F.sum("n").alias("n"))

    totals = per_fold(labels, []).select(*keys, F.col("by").alias("tot"), F.col("p").alias("tp"), F.col("n").alias("tn"))
    slots = per_fold(bits.join(labels.hint("shuffle_hash"), id_col), ["bit"]).join(totals, keys)

    def value(fold):
        own, all_ = F.col("by")[fold], F.col("tot")[fold]
        n1, n0 = F.col("p") - F.coalesce(own["p"], F.lit(0)), F.col("n") - F.coalesce(own["n"], F.lit(0))
        t1, t0 = F.col("tp") - all_["p"], F.col("tn") - all_["n"]
        share = (n1 + n0) / (t1 + t0)
        return F.when(n1 + n0 > 0, F.abs(n1 / t1 - n0 / t0) * 2 * share * (1 - share))

    return slots.select(*keys, "bit", F.explode(F.map_keys("tot")).alias("_fold"), "by", "tot", "p", "n", "tp", "tn").select(
        *keys, "bit", value(F.col("_fold")).alias("mean_abs")).groupBy(*keys, "bit").agg(F.avg("mean_abs").alias("mean_abs"))


def feature_name(prefix: str, idx_col: str):
    return F.concat(F.lit(prefix), F.col(idx_col).cast("string"))


def feature_index(name_col: str = "feature"):
    """P11: 'ECFP_123' -> 123."""
    return F.regexp_extract(F.col(name_col), r"_(\d+)$", 1).cast("bigint")


def family_filter(df: DataFrame, prefix: str = ECFP_PREFIX, name_col: str = "feature") -> DataFrame:
    """P5: keep the features of one family, by name prefix."""
    return df.filter(F.col(name_col).startswith(prefix))


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], n: int, value: str = "mean_abs",
                    tie: str = "feature_idx", rank_col: str = "rank") -> DataFrame:
    """N largest per group, ties by the feature index (planned as a group limit).

    The window runs over an importance table: one row per (group, feature),
    bounded by the feature count, not by the data.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(value).desc(), F.col(tie).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n) \
        .withColumn(rank_col, F.col(rank_col).cast("bigint"))


def top_n(df: DataFrame, n: int, value: str = "mean_abs", tie: str = "feature_idx") -> DataFrame:
    """L1: global top n (TakeOrderedAndProject: per-task top n, then one merge of n rows each)."""
    return df.orderBy(F.col(value).desc(), F.col(tie).asc()).limit(n)


def mean_of_fold_means(per_fold: DataFrame, keys: Sequence[str], fold: str = "fold",
                       value: str = "mean_abs") -> DataFrame:
    """A3: unweighted mean over folds of per-fold means (not the pooled mean)."""
    return per_fold.groupBy(*keys).agg(F.avg(value).alias(value),
                                       F.count(fold).alias("n_folds"))


def last_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """W5 / J4 dictionary: value of the LAST row per key (explicit ordinal).

    ``max_by`` over a struct keeps a null winner distinguishable from no row.
    """
    return df.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")),
                                          F.struct(*order)).alias("_w")) \
        .select(*keys, F.col("_w.v").alias(value))


def lookup_with_default(left: DataFrame, dictionary: DataFrame, keys: Sequence[str], value: str,
                        default: str = "N/A") -> DataFrame:
    """Left join to a key -> value dictionary; 'N/A' only when the key is absent
    (a present key with a null value stays null)."""
    d = dictionary.withColumn("_hit", F.lit(True))
    j = left.join(d, list(keys), "left")
    return j.withColumn(value, F.when(F.col("_hit").isNull(), F.lit(default))
                        .otherwise(F.col(value))).drop("_hit")


def merge_models(df: DataFrame, models: Sequence[str], keys: Sequence[str] = ("feature", "fragment"),
                 value: str = "mean_abs") -> DataFrame:
    """Outer merge of per-model tables on (feature, fragment) as ONE pivot.

    Grouping treats null fragments as equal (as an outer merge on
    null-safe keys does) and needs one shuffle instead of a chain of joins.
    """
    piv = df.groupBy(*keys).pivot("model", list(models)).agg(F.max(value))
    return piv.select(*keys, *[F.col(m).alias(f"{value}_{m}") for m in models])
