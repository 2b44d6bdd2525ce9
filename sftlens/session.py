"""Session set-up shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "sftlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master[master.find("[") + 1 : -1] if "[" in master else ""
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("SFTLENS_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        )
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # State of many runs belongs on disk, not on the heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The directory the cluster names in ``spark.checkpoint.dir`` is used as it is. Only a
    local session without one gets a temporary folder; on a cluster that is an error,
    because executors could not read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sftlens-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
