"""Session and scratch-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "ratewell", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RATEWELL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")  # a rating run has more than the default 100
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without one (tests, a laptop) gets a fresh temporary folder, remembered in the
    session so later calls agree on it; on a cluster a machine-local folder would lose data.
    """
    for folder in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir(),
                   spark.conf.get("spark.ratewell.folder", None)):
        if folder:
            return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="ratewell-")
    spark.conf.set("spark.ratewell.folder", folder)
    return folder
