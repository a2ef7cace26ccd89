"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import relcast.llm
from relcast.session import configure, ensure_checkpoint_dir

ARROW_ROWS, ARROW_BYTES = 512, 64 << 20  # of an Arrow batch: bound a Python worker's memory with long texts and packed rows


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (UTC, AQE, small Arrow batches).

    Task functions of this package are pickled by value, so executors need no copy of it."""
    cloudpickle.register_pickle_by_value(relcast.llm)
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def prepare_packed(spark: SparkSession) -> SparkSession:
    """The same for operators whose rows hold many records each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/relcast-{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner the
    true size, so that a later join is broadcast only if its side really is small.
    Inside a ``Scratch`` block the table is deleted at the block's end, unless it is kept."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[Scratch] = []


class Scratch:
    """Deletes the shared tables written inside the block, but for those that ``keep`` names."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _SCRATCH.append(self)
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df`` as a shared table that outlives the block (an outer block deletes it)."""
        out = shared_table(df, name)
        path = self.paths.pop()
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].paths.append(path)
        return out

    def drop(self) -> None:
        """Delete what has been written so far; nothing that is read later may go back to it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()

    def __exit__(self, *error: object) -> None:
        _SCRATCH.remove(self)
        self.drop()
