"""Registry of saved models (B6): an append-only log of versions and stages.

A version's number is claimed by creating a file of that name, which one run
alone can do, so runs at the same time never share one. Every change is a row;
the state of a version is its last row, found by an aggregate.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("version long, name string, stage string, model_path string, run_id string, task_type string, metric string, "
          "score double, at timestamp, change string")
# The stages of a version.
NONE, STAGING, PRODUCTION, ARCHIVED = "None", "Staging", "Production", "Archived"


def _create(spark, fs, file) -> bool:
    """Create an empty file unless it exists; one of several callers at most gets True."""
    if file.toUri().getScheme() == "file":  # Hadoop's local file system first looks and then creates
        return spark._jvm.java.io.File(file.toUri().getPath()).createNewFile()
    try:
        fs.create(file, False).close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def claim_version(spark, path: str) -> int:
    """The next free version number, taken for good. The file system must create a file for one caller only, as HDFS
    and local ones do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path.rstrip('/')}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = fs.makeQualified(folder)
    fs.mkdirs(folder)
    number = 1 + max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=0)
    while not _create(spark, fs, hadoop(folder, str(number))):
        number += 1
    return number


def _append(spark, path: str, rows: list[tuple]) -> None:
    now = datetime.now(timezone.utc)
    spark.createDataFrame([(*r, now, uuid.uuid4().hex) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{path.rstrip('/')}/log")


def register(spark, path: str, name: str, model_path: str, run_id: str | None = None, task: str | None = None,
             metric: str | None = None, score: float | None = None, stage: str = STAGING) -> int:
    """A new version of a saved model; returns its number."""
    version = claim_version(spark, path)
    _append(spark, path, [(version, name, stage, model_path, run_id, task, metric, score)])
    return version


def models(spark, path: str) -> DataFrame:
    """The last state of each version."""
    log = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/log")
    fields = [f for f in log.columns if f not in ("version", "change")]
    last = log.groupBy("version").agg(F.max_by(F.struct(*fields), F.struct("at", "change")).alias("s"))
    return last.select("version", "s.*")


def promote(spark, path: str, version: int) -> None:
    """Make a version the production model; the one before it is archived in the same append."""
    # versions in production or about to be: a handful whatever the log's size
    told = models(spark, path).where((F.col("version") == version) | (F.col("stage") == PRODUCTION)).drop("at").collect()
    if version not in {r["version"] for r in told}:
        raise KeyError(f"no version {version} in {path}")
    _append(spark, path, [(r["version"], r["name"], PRODUCTION if r["version"] == version else ARCHIVED, r["model_path"],
                           r["run_id"], r["task_type"], r["metric"], r["score"]) for r in told])
