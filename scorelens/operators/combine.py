"""Combine tables that must describe the same entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key with the columns of both tables; a key that only one of them has ends the job.

    The check is part of the join itself: a full outer join costs the same
    shuffle as an inner one, and ``raise_error`` names the first key without a
    partner.  A null key has no partner.
    """
    a = left.withColumn("_left", F.lit(True))
    b = right.withColumnRenamed(key, "_other").withColumn("_right", F.lit(True))
    both = a.join(b, a[key] == b["_other"], "full_outer")
    message = F.concat(F.lit(f"tables are not aligned: {key} "), F.coalesce(F.col(key), F.col("_other")).cast("string"),
                       F.when(F.col("_left").isNull(), " is missing on the left").otherwise(" is missing on the right"))
    aligned = F.when(F.col("_left") & F.col("_right"), F.lit(True)).otherwise(
        F.raise_error(F.coalesce(message, F.lit(f"tables are not aligned: null {key}"))).cast("boolean"))
    # a filter, so that the check runs whichever columns are used afterwards
    return both.where(aligned).select(*left.columns, *[c for c in right.columns if c != key])
