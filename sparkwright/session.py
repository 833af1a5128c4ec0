"""Session construction and cluster-wide settings.

On a cluster the session already exists and carries its own settings; ``get_session``
only fills what is unset. Tests and ``bench.py`` run on ``local[N]``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package relies on. ANSI stays on (Spark 4 default); all
# lenient conversions go through try_* functions instead.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Compressed bytes a task reads: narrow joined rows grow some twentyfold in memory once the
    # texts of parts and customers are attached and grouped, so Spark's 64 MB are too many.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM and a Python worker each hold a batch, and what is made of it, beside the heap;
    # Spark's 64 MB a batch took executors of 3 GB over their memory.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # HotSpot does not JIT methods above 8000 bytecodes; wider generated stages fall
    # back to per-expression codegen instead of running interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sparkwright") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("SPARKWRIGHT_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def _is_set(spark: SparkSession, key: str) -> bool:
    return bool(spark._jsparkSession.sessionState().conf().contains(key))


def configure(spark: SparkSession) -> SparkSession:
    """Fill in the session-level settings that the caller has left unset."""
    for key, value in DEFAULT_CONF.items():
        if not _is_set(spark, key):
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name one: executors cannot see each other's disks. In local mode, where
    there is one machine, an unset folder is replaced by a private one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwright-"))
    return spark.sparkContext.getCheckpointDir()
