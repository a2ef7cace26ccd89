"""Operator 13: exact deduplication with Structured Streaming state.

1. A stream over the document files turns every row into its digest (SHA-256 of the text's bytes) and its content
   locator (file and row in the file).  Texts do not leave the scan.
2. A second stream keeps one entry per digest in the state store (RocksDB on the executors' disks, changelog and
   snapshots in the shared folder): the number of rows, the stable identifier (the largest id) and the locator of the
   row that holds it.  There is no watermark, so nothing expires: a copy that comes in a later run meets its original.
   Rows of one digest are combined before the shuffle, so a text that a third of all rows share is one row per task.
3. A hit is a digest with several rows.  The rows of hits are read again and grouped by digest *and whole text*, so
   two texts are only ever called equal after a comparison of all bytes.  The content at the retained locator keeps
   the digest's group; any other content under the same digest (a collision) is a group of its own.

Everything is DataFrame functions.  ``absorb`` may be called again with the same state folder when files have been
added; only new files are digested.  A failed micro-batch is repeated and overwrites its own folder.

Defined cases: a null text equals the empty text; a null id is less than every id, and a group without ids has a null
keep_id; of rows that share the kept id and the text exactly one, that with the greatest locator, is kept;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_path, shared_table
from .counted_join import join_counted

PLACE = "struct<id: bigint, file: string, row: bigint>"
DIGESTS = f"digest string, place {PLACE}"
GROUPS = f"digest string, rows bigint, keep {PLACE}"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a commit writes what has changed
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}  # no preallocated files: there are many small stores
BATCH_BYTES = 1 << 38  # input of one micro-batch


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(stream: DataFrame, mode: str, sink: str, checkpoint: str) -> None:
    """Run a stream over all that is there; every micro-batch overwrites its own folder of ``sink``."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _as_pattern(path: str) -> str:
    """The path as a pattern, which a file stream takes for a single file as well as for a folder."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def absorb(spark: SparkSession, source: str, state: str, id_col: str = "doc_id", text_col: str = "text",
           digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES, files: int | None = None) -> None:
    """Take the files of ``source`` that ``state`` has not seen into its digests and groups.

    ``files``: files of one micro-batch, in place of ``batch_bytes``."""
    for part, schema in (("digests", DIGESTS), ("groups", GROUPS)):  # an empty first part, so that both can be read
        spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{state}/{part}/batch=-1")
    fields = spark.read.parquet(source).select(f"`{id_col}`", f"`{text_col}`").schema
    reader = spark.readStream.schema(fields)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader.option("maxBytesPerTrigger", batch_bytes)
    docs = reader.parquet(_as_pattern(source))
    _run(_rows(docs, id_col, text_col, digest).drop("content"), "append", f"{state}/digests", f"{state}/seen")
    rows = spark.readStream.schema(f"{DIGESTS}, batch bigint").parquet(f"{state}/digests")
    kept = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.max("place").alias("keep"))
    with _settings(spark, ROCKS):
        _run(kept, "update", f"{state}/groups", f"{state}/state")


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, place, content of the rows of a scan."""
    at = docs.metadataColumn("_metadata")
    place = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(digest(text).alias("digest"), place.alias("place"), text.alias("content"))


def retained(spark: SparkSession, state: str) -> DataFrame:
    """digest, rows, keep: every entry of the state as the last micro-batch that changed it wrote it."""
    written = spark.read.schema(f"{GROUPS}, batch bigint").parquet(f"{state}/groups")
    return written.groupBy("digest").agg(F.max_by(F.struct("rows", "keep"), "batch").alias("x")).select("digest", "x.*")


def resolve(spark: SparkSession, source: str, state: str, id_col: str = "doc_id", text_col: str = "text",
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row that ``state`` has seen."""
    groups = shared_table(retained(spark, state), "retained")
    hits = groups.where("rows > 1").select("digest", "rows")
    full = _rows(spark.read.parquet(source).select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col, digest)
    # Spark tests each scanned row against a Bloom filter of the hits, so few texts of other rows are shuffled
    with _settings(spark, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
                           "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1p"}):
        contents = shared_table(join_counted(full, hits, "digest", "rows").groupBy("digest", "content")
                                .agg(F.count(F.lit(1)).alias("rows"), F.max("place").alias("keep")).drop("content"), "contents")
    several = shared_table(contents.groupBy("digest").count().where("count > 1").select("digest"), "collisions")
    rows = spark.read.schema(f"{DIGESTS}, batch bigint").parquet(f"{state}/digests").select("digest", "place")
    sure = groups.where("rows = 1").unionByName(contents).join(several, "digest", "left_anti")
    found = join_counted(rows, shared_table(sure, "groups"), "digest", "rows")
    if not several.isEmpty():  # different contents under one digest: their rows go by the content
        of = full.join(several, "digest", "left_semi")
        each = of.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("rows"), F.max("place").alias("keep"))
        found = found.unionByName(of.join(each, ["digest", "content"]).select("digest", "place", "rows", "keep"))
    mine = (F.col("place.file") == F.col("keep.file")) & (F.col("place.row") == F.col("keep.row"))
    return found.select(F.col("place.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("rows").alias("group_size"),
                        mine.alias("kept"), "digest")


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it."""
    prepare(spark)
    source, state = f"{sf_dir.rstrip('/')}/documents.parquet", shared_path(spark, "dedup-state")
    absorb(spark, source, state)
    return resolve(spark, source, state).withColumnRenamed("digest", "text_sha256")


ORACLE_OP13 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
