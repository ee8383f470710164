"""Session settings the jobs rely on.

On a cluster the session already exists and its own settings stand; only the
settings that decide *results* are set here.  Sizing (shuffle partitions,
memory) belongs to the deployment and is left alone unless a test asks for it.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

RESULT_SETTINGS = {
    # Periods are civil dates, so no job may depend on the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g",
                  broadcast_bytes: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    broadcast_bytes "-1" times the plan that large tables get: joins by sort and merge, and rows spread over the cores.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    if broadcast_bytes is not None:
        builder = builder.config("spark.sql.autoBroadcastJoinThreshold", broadcast_bytes)
    for key, value in RESULT_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage; a temporary one only where none is set and all runs on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder
