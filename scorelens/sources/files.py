"""File sources and sinks.

Between stages the engine keeps parquet; CSV / TSV / JSON appear only at
the edges, with an explicit schema on read (no inference) and the latin-1
encoding the raw entity files use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LATIN1 = "ISO-8859-1"
RESULTS_DIR = "results"
QUICK_SUFFIX = "_quicktest"
PREDICTION_KEYS = ("dataset", "feature_set", "model", "fold")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             encoding: str = LATIN1, multiline: bool = False) -> DataFrame:
    """Headered delimited text with a fixed schema.

    ``multiline``: values hold line ends; each file is then one task.
    """
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("encoding", encoding).option("multiLine", multiline)
            .option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8",
              mode: str = "overwrite", trim: bool = True) -> None:
    """Headered delimited text (no row-number column); ``trim``: values lose white space at their ends."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
     .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
     .option("encoding", encoding).option("escape", '"').csv(path))


def discover_datasets(spark: SparkSession, raw_dir: str, schema: StructType | str, encoding: str = LATIN1) -> DataFrame:
    """Every ``<name>.csv`` in a folder is one dataset of that name, be it a file or a folder of part files.

    All datasets are read in one scan; ``dataset`` comes from the path, and a filter on
    it leaves the other datasets' files unread.  Raises if the folder holds no CSV row.
    """
    df = read_csv(spark, f"{raw_dir.rstrip('/')}/*.csv", schema, encoding=encoding)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    df = df.withColumn("dataset", F.regexp_extract(path, r"/([^/]+)\.csv(?:/[^/]+)?$", 1))
    if df.select("dataset").limit(1).count() == 0:
        raise FileNotFoundError(f"no CSV datasets in {raw_dir}")
    return df


def results_base(base: str, quick: bool) -> str:
    """Quick runs write beside the real results, never over them."""
    return base.rstrip("/") + (QUICK_SUFFIX if quick else "")


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = PREDICTION_KEYS,
                      fmt: str = "parquet", **options) -> None:
    """results/<dataset>/<feature_set>/<model>/<fold> as partition folders.

    Dynamic partition overwrite: re-running one (feature_set, model) replaces
    only its own folders.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .options(**options).partitionBy(*keys).format(fmt).save(path))


PREDICTION_SCHEMA = "doc_id long, y_true int, y_prob double, y_pred int"


def scan_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S4 + S5: every prediction file under a tree, typed, keys from the partition folders.

    Parquet finds the partition folders by itself.  CSV files are found at any depth
    and read with ``PREDICTION_SCHEMA``; their keys come from the ``key=value`` folders of
    their paths.  No prediction at all raises.
    """
    if fmt == "csv":
        df = (spark.read.schema(PREDICTION_SCHEMA).option("header", True).option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.csv").csv(path))
        df = df.select("*", *[named_folder(k).cast("long" if k == "fold" else "string").alias(k) for k in PREDICTION_KEYS])
    else:
        df = spark.read.format(fmt).option("recursiveFileLookup", False).load(path)
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"no predictions under {path}")
    return df


def named_folder(key: str, col: str = "_metadata.file_path"):
    """Value of the ``key=value`` folder in a file's path, percent signs undone."""
    return F.url_decode(F.replace(F.regexp_extract(F.col(col), f"/{key}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """The JSON sink of the chosen parameters back: keys, best_params (map of strings), inner_cv_best_score."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    keys = [named_folder(k).cast("long" if k == "fold" else "string").alias(k) for k in PREDICTION_KEYS]
    told = F.from_json("value", "best_params map<string,string>, inner_cv_best_score double").alias("_j")
    return raw.select(*keys, told).select(*PREDICTION_KEYS, "_j.*")


def keys_from_path(col: str = "_metadata.file_path", depth: Sequence[str] = ("fold", "model", "feature_set")):
    """S5 for a plain folder layout: the k-th folder from the end names a key."""
    parts = F.split(F.col(col), "/")
    return [F.element_at(parts, -(i + 2)).alias(name) for i, name in enumerate(depth)]


def best_params_json(df: DataFrame, params_col: str = "best_params",
                     score_col: str = "inner_cv_best_score", strip_prefix: str = "clf__") -> DataFrame:
    """S8 + P12: ``{"best_params": {...}, "inner_cv_best_score": x}`` per row.

    Keys lose an estimator prefix via ``transform_keys`` on the MAP column.
    """
    clean = F.transform_keys(params_col, lambda k, v: F.regexp_replace(k, f"^{strip_prefix}", ""))
    return df.withColumn("params_json", F.to_json(F.struct(
        clean.alias("best_params"), F.col(score_col).alias("inner_cv_best_score"))))
