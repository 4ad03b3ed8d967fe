"""Spark session and shared scratch locations.

On a cluster the session already names a shared ``spark.checkpoint.dir``; we
read it and never replace it.  Only a session without one (tests, a laptop)
gets a fresh local folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(cpus: int | str = "*", app: str = "scorelens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on and the UI off (for tests and bench runs)."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    A machine-local folder is made only when the setting is absent and every
    task runs in this process (``local`` masters); on a cluster without the
    setting this raises, since executors could not see such a folder.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{_CHECKPOINT_KEY} is not set: master {master!r} needs a folder "
                               "that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="scorelens-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/scorelens-scratch/{uuid.uuid4().hex}/{name}"


def default_sf_dir() -> str:
    return os.environ.get("SCORELENS_SF_DIR", "/root/testdata/sf0.01")


def checkpointed(df):
    """Reliable checkpoint (eager) into the session's checkpoint folder.

    Works in any session: the folder is the cluster's ``spark.checkpoint.dir``
    when set, else a fresh local one (tests).  Never ``localCheckpoint``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
