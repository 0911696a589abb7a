"""Session helpers.

Library code never invents storage locations: lineage cuts and intermediate
tables go to the shared folder named by ``spark.checkpoint.dir``. Only a local
session built here for tests or the bench sets that value, and only when it is
unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "quarry", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and UTC time.

    On a cluster the master and checkpoint folder come from the launcher; a
    local test session gets a checkpoint folder under the system temp dir.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if master and master.startswith("local"):
        ensure_checkpoint_dir(spark, default=tempfile.mkdtemp(prefix="quarry-ckpt-"))
    return spark


def ensure_checkpoint_dir(spark: SparkSession, default: str) -> str:
    """Use the session's ``spark.checkpoint.dir``; set ``default`` only if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        spark.conf.set("spark.checkpoint.dir", default)
        spark.sparkContext.setCheckpointDir(default)
        current = default
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session whose driver and executors are one process (``local[...]``, as in
    tests) gets a folder of its own when the setting is missing; on any cluster
    a missing setting is an error, because executors share no local disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for intermediate tables")
        current = ensure_checkpoint_dir(spark, default=tempfile.mkdtemp(prefix="quarry-ckpt-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-{name}-{uuid.uuid4().hex[:12]}"
