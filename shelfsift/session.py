"""Session settings shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_FOLDER = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "shelfsift", shared: str = "/tmp/checkpoints") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from the submitter.

    ``shared`` becomes the shared folder only where the environment names none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    if spark.conf.get(_FOLDER, None) is None:
        spark.stop()
        spark = builder.config(_FOLDER, shared).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``."""
    configured = spark.conf.get(_FOLDER, None)
    if configured is None:
        raise ValueError(f"{_FOLDER} must name a folder that the driver and all executors share")
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed here."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
