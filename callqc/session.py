"""Session settings that the operators are designed around.

On a cluster the caller owns the SparkSession; ``tuned_conf`` lists the settings the
plans rely on (AQE for runtime join selection, skew splitting and partition coalescing)
so a job can apply them with ``spark.conf.set`` or ``--conf``.  ``local_session`` is for
tests and the benchmark only.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Shuffle partitions for a 100 TB run: ~128-256 MB per reducer after AQE coalescing.
CLUSTER_SHUFFLE_PARTITIONS = 8000


def tuned_conf(shuffle_partitions: int = CLUSTER_SHUFFLE_PARTITIONS) -> dict[str, str]:
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Static broadcast decisions use plan size estimates, which are upper bounds for
        # scans, filters and projections; AQE re-checks with measured shuffle sizes.
        "spark.sql.autoBroadcastJoinThreshold": "32m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.files.maxPartitionBytes": "256m",
        # Every timestamp in the model is zone-less; keep rendering independent of the host.
        "spark.sql.session.timeZone": "UTC",
    }


def apply_conf(spark: SparkSession, conf: dict[str, str] | None = None) -> SparkSession:
    """Apply the runtime-settable (``spark.sql.*``) part of ``conf`` to a running session.

    Core settings (such as the checkpoint cleaner) only take effect at start-up; pass
    them with ``--conf`` or the session builder.
    """
    for key, value in (conf or tuned_conf()).items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "callqc",
                  warehouse: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks (UI off, no server started)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CALLQC_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    for key, value in tuned_conf(shuffle_partitions).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
