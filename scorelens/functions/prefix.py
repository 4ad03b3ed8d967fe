"""Exact running totals without a single-task window.

A window ``sum(..) over (partition by g order by k rows unbounded preceding)``
puts a whole group ``g`` into one task.  When one group can hold a third of all
rows that task is the job.  Here the order is cut into buckets that are
monotone in the order key:

1. totals per (group, bucket)            -- small: groups x buckets rows
2. offset of each bucket = sum of the earlier buckets (window on the small table)
3. running sum inside (group, bucket) + offset   -- many small window partitions

The result is the same running total, computed with bounded partitions.  The
offset table is an aggregate whose size AQE measures at run time, so it is
broadcast only when it is actually small and sort-merge joined otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def running_totals(
    df: DataFrame,
    part_cols: Sequence[str],
    bucket_cols: Sequence[str],
    order_cols: Sequence[str],
    sum_cols: Sequence[str],
    descending: bool = False,
    prefix: str = "cum_",
) -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of each ``c`` within ``part_cols``.

    ``bucket_cols`` must be coarser than and monotone in ``order_cols`` (same
    direction): every row of an earlier bucket comes before every row of a
    later bucket.  ``order_cols`` must be unique within a group for the result
    to be deterministic.
    """
    part_cols, bucket_cols = list(part_cols), list(bucket_cols)
    keys = part_cols + bucket_cols
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    before = (
        Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()
    ).orderBy(*_ordered(bucket_cols, descending)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_bt_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*_ordered(order_cols, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = df.join(offsets, on=keys, how="inner")
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_off_{c}") + F.sum(c).over(inside)).alias(f"{prefix}{c}") for c in sum_cols],
    )
