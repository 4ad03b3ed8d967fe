"""Validity filter, ids, X/y split, encoders, label stats.

The validity predicate is a native column expression, evaluated once; the
valid rows and the quarantine are two filters over it and the counts one
aggregate, so a single scan serves all three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.exprs import count_char, is_blank
from scorelens.session import checkpointed

ID_LIKE = ("id", "doc_id", "entity_id", "sampleid", "sample_id", "name")


def text_is_valid(text_col: str = "text", length_col: str | None = "n_chars") -> Column:
    """Valid text: not blank, stated length matches, brackets balanced."""
    ok = ~is_blank(text_col) & (count_char(text_col, "(") == count_char(text_col, ")"))
    if length_col:
        ok = ok & (F.length(text_col) == F.col(length_col))
    return F.coalesce(ok, F.lit(False))


def with_validity(df: DataFrame, predicate: Column, name: str = "is_valid") -> DataFrame:
    return df.withColumn(name, predicate)


def split_valid(df: DataFrame, flag: str = "is_valid") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) -- two filters over one flag column."""
    return df.filter(F.col(flag)), df.filter(~F.col(flag))


def validity_counts(df: DataFrame, flag: str = "is_valid") -> DataFrame:
    """A1: n_total, n_valid, n_dropped in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col(flag)).alias("n_valid"),
        F.count_if(~F.col(flag)).alias("n_dropped"),
    )


def sample_id(name_col: str, ordinal_col: str) -> Column:
    """The name as a string, else 'sample_<ordinal>'."""
    return F.coalesce(F.col(name_col).cast("string"),
                      F.concat(F.lit("sample_"), F.col(ordinal_col).cast("string")))


def split_xy(df: DataFrame, label_col: str, id_col: str,
             drop_cols: Sequence[str] = ("text",)) -> tuple[DataFrame, list[str]]:
    """Keep id + label + feature columns; return the frame and the feature names.

    A feature whose name looks like an id is refused (it would leak).
    """
    drop = {label_col, id_col, *drop_cols}
    feats = [c for c in df.columns if c not in drop]
    leaks = [c for c in feats if c.lower() in ID_LIKE]
    if leaks:
        raise ValueError(f"id-like columns among features: {leaks}")
    return df.select(id_col, label_col, *feats), feats


class LabelEncoder:
    """Sorted categories -> 0..n-1, as a table (value, code) that never reaches the driver."""

    def __init__(self, codes: DataFrame, col: str, out_col: str):
        self.codes, self.col, self.out_col = codes, col, out_col

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the code column (long); a null or unseen value ends the job."""
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        value = F.col("row").getField(self.col)
        unseen = F.raise_error(F.concat(F.lit(f"{self.col} holds a value without a code: "),
                                        F.coalesce(value.cast("string"), F.lit("null"))))
        return rows.join(self.codes, value == F.col("value"), "left").select(
            "row.*", F.coalesce("code", unseen.cast("long")).alias(self.out_col))


def fit_label_encoder(train: DataFrame, col: str, out_col: str | None = None) -> LabelEncoder:
    """The encoder of the non-null values of ``train``.

    Distinct values are range-partitioned and numbered inside their partition; the
    numbers move up by the sizes of the earlier partitions (one row each).
    """
    values = train.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    part = checkpointed(values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy("value")
    codes = part.join(F.broadcast(offsets), "_part").select(  # at most spark.sql.shuffle.partitions rows
        "value", (F.col("_off") + F.row_number().over(inside) - 1).alias("code"))
    return LabelEncoder(codes, col, out_col or f"{col}_code")


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(train: DataFrame, label_col: str = "label") -> DataFrame:
    """A10: 'balanced' weights n / (n_classes * n_c), from the given (training) rows."""
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy()  # over the class table: one row per class
    return counts.select(
        label_col, "n_c",
        (F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c"))).alias("weight"))
