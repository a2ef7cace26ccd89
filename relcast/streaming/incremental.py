"""Incremental maintenance of slot partials with Structured Streaming.

The batch history plans reduce events to per-(key, slot) partial aggregates
before anything else.  Here the same partials are kept up to date from a
stream of event files.  Every micro-batch maps its events to their slots, combines
them per (key, slot) and writes these partials into its own folder
``__batch=<id>``, overwriting it when a failed batch is repeated.  Partials of
different batches add up, so no state and no watermark are needed: an event counts
however late it comes.  Readers merge the partials of all batches and finish with the
batch running-window plan, so a stream result equals the batch result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..plans.history import (SLOT, TS, Agg, _check, _merge, _partial, first_anchor_index,
                             running_from_partials)
from ..session import ensure_checkpoint_dir

BATCH = "__batch"


def start_slot_partials(spark: SparkSession, source: str, schema: StructType, keys: list[str],
                        time_col: str, anchors, aggs: list[Agg], sink: str, checkpoint: str,
                        strict: bool = False, available_now: bool = True, where: str | None = None,
                        file_glob: str | None = None, files_per_batch: int | None = None):
    """Start the maintaining stream over the files of folder ``source`` (optionally
    only names matching ``file_glob``); returns the ``StreamingQuery``."""
    anchors = _check(anchors)
    m = len(anchors)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    ev = reader.parquet(source)
    if where:
        ev = ev.where(where)
    t = F.col(time_col).cast("timestamp_ntz")
    ev = ev.where(t.isNotNull()).withColumn(SLOT, first_anchor_index(t, anchors, strict))
    ev = ev.where(F.col(SLOT) < m)

    def write(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*keys, SLOT).agg(*[_partial(a) for a in aggs])
        part.write.mode("overwrite").parquet(os.path.join(sink, f"{BATCH}={batch_id}"))

    w = ev.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_slot_partials(spark: SparkSession, sink: str, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """Every (key, slot) partial, merged over the batches written by the stream."""
    df = spark.read.parquet(sink)
    return df.groupBy(*keys, SLOT).agg(*[_merge(a, F.col(a.name)).alias(a.name) for a in aggs])


def streamed_cumulative(spark: SparkSession, source: str, schema: StructType, keys: list[str],
                        time_col: str, anchors, aggs: list[Agg], work_dir: str | None = None,
                        where: str | None = None, strict: bool = False,
                        file_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Run the maintainer once over everything available and return the cumulative
    (key, anchor) aggregates built from the streamed partials."""
    base = work_dir or os.path.join(ensure_checkpoint_dir(spark), "relcast-stream-" + uuid.uuid4().hex)
    sink, ckpt = os.path.join(base, "partials"), os.path.join(base, "checkpoint")
    q = start_slot_partials(spark, source, schema, keys, time_col, anchors, aggs, sink, ckpt,
                            where=where, strict=strict, file_glob=file_glob, files_per_batch=files_per_batch)
    q.awaitTermination()
    partial = read_slot_partials(spark, sink, keys, aggs)
    out = running_from_partials(partial, keys, anchors, aggs)
    return out.select(*keys, TS, *[a.name for a in aggs])
