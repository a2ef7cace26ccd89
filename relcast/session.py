"""Spark session defaults for relcast.

Cluster runs pass their own session; these settings are what the engine
expects to find (UTC session zone, AQE on).  A checkpoint folder is only set
when the cluster has not configured ``spark.checkpoint.dir`` (tests, local
runs), and then it is a fresh folder made with ``tempfile.mkdtemp``.
"""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession, functions as F

INPUT_BYTES = 2 << 20  # of the tables' files for each shuffle partition, before AQE merges small ones
ADVISORY_BYTES = 4 << 20  # of shuffled rows in a task; anchors multiply them by up to 60 inside it
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "relcast", extra: dict | None = None) -> SparkSession:
    """Local/test session; on a cluster use the session the platform gives."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("RELCAST_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession, sf_dir: str | None = None) -> SparkSession:
    """Apply the session-level settings the operators rely on; with ``sf_dir``, also shuffles sized by its tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset(ALL_KEYS)
    ensure_checkpoint_dir(spark)
    if sf_dir is not None:
        size_shuffles(spark, _input_bytes(sf_dir, id(spark)))
    return spark


@lru_cache(maxsize=64)
def _input_bytes(sf_dir: str, spark_id: int) -> int:
    """Bytes of the files below a folder (listed, not read)."""
    files = SparkSession.getActiveSession().read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir)
    return files.agg(F.sum("length")).first()[0] or 0


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Shuffle partitions in proportion to the input, merged by AQE only up to ``ADVISORY_BYTES``.

    The slot plans multiply a task's rows by the anchors after a shuffle, so what a task holds follows from the
    partition it reads; with a fixed number of partitions it would grow with the input."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(initial, str(max(least, -(-input_bytes // INPUT_BYTES))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(ADVISORY_BYTES))


def join_where_they_lie(spark: SparkSession) -> None:
    """Until the next ``configure``, sides dealt out by one of the join's keys (an entity's, with a row per anchor) are joined
    where they lie; else the planner deals both out again by all keys."""
    spark.conf.set(ALL_KEYS, "false")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a private one is set only where it is unset and everything runs in one process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="relcast-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut lineage by a reliable checkpoint into the shared checkpoint folder
    (survives executor loss; never a machine-local copy)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
