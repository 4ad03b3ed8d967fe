"""Stratified k-fold assignment, shuffled by a seed.

Rows are dealt round-robin in (class, seeded hash, id) order: the row with
global rank ``j`` (0-based) in that order goes to fold ``j mod k``.  The rank
carries on across classes, so fold sizes differ by at most one and each class
is split as evenly as possible -- the same per-(fold, class) counts as the
usual stratified k-fold.  Folds are numbered 1..k.

The rank is exact but never computed in one task: the hash prefix is a bucket
that is monotone in the order, so ``running_totals`` ranks inside
(class, prefix) partitions and adds the count of all earlier buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.prefix import running_totals


def order_hash(id_col: str, seed: int = 42):
    """md5 of '<seed>-<id>': the shuffle order inside a class."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def stratified_folds(
    df: DataFrame,
    id_col: str,
    label_col: str,
    k: int = 5,
    seed: int = 42,
    fold_col: str = "fold",
    prefix_hex: int = 4,
    part_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``fold_col`` (1..k).  Rows with a null label are rejected first.

    ``prefix_hex`` hex digits of the order hash form the buckets: at most
    n_classes x 16**prefix_hex offsets, independent of the row count.
    """
    base = df.filter(F.col(label_col).isNotNull())
    keyed = base.select(
        *[F.col(c) for c in base.columns],
        order_hash(id_col, seed).alias("_h"),
        F.lit(1).cast("bigint").alias("_one"),
    ).withColumn("_hb", F.substring("_h", 1, prefix_hex))
    ranked = running_totals(
        keyed,
        part_cols=list(part_cols),
        bucket_cols=[label_col, "_hb"],
        order_cols=["_h", id_col],
        sum_cols=["_one"],
    )
    return ranked.select(
        *[F.col(c) for c in base.columns],
        ((F.col("cum__one") - 1) % k + 1).cast("bigint").alias(fold_col),
    )


def inner_folds(df: DataFrame, id_col: str, label_col: str, outer_col: str = "fold",
                k: int = 5, seed: int = 42, n_outer: int = 5) -> DataFrame:
    """For each outer fold f, stratified folds of the rows not in f.

    One output row per (row, outer fold it trains in): columns of ``df`` plus
    ``outer_fold`` and ``inner_fold``.  No join: each row is exploded to the
    outer folds it is a training row of, then ranked per outer fold.
    """
    pairs = df.withColumn(
        "outer_fold",
        F.explode(F.filter(F.sequence(F.lit(1), F.lit(n_outer)).cast("array<bigint>"),
                           lambda f: f != F.col(outer_col))),
    )
    return stratified_folds(pairs, id_col, label_col, k=k, seed=seed,
                            fold_col="inner_fold", part_cols=("outer_fold",))
