"""Readers for the parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan: Catalyst prunes columns and pushes filters into it.

    Text tables feed CPU-heavy per-row work, so a narrow scan of one is
    spread over the cluster (``spread``; a no-op for a many-split input).
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def table_version(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """(session, folder, files with size and time) of the named tables: changes when one of them is rewritten."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        for f in path.getFileSystem(conf).listStatus(path):
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted(files))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when a scan is narrower than the cluster.

    A table stored as one file with one row group scans as one task; the
    CPU-heavy per-row work after it (tokenising long texts, hashing) would
    then run on one core.  On a large input the scan already has thousands
    of splits and this is a no-op.  Call it on a plain scan: there the
    partition count is planning-only (on a plan with shuffles it is not).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
