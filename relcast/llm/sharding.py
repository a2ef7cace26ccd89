"""Operator 4: proportional stratified interleaving into shards (DataFrame functions only).

Rows are put in a seeded random order within each source; row k of a source with n
rows gets the fractional rank (k - 1/2) / n.  Sorting all rows by fractional rank
interleaves the sources in proportion, and equal cuts of that order give shards that
all match the mixture and whose row counts differ by at most one (law ``rows``).

Nothing is ranked in one task.  Ranks within a source come from a histogram over
hash buckets plus a ``row_number`` inside (source, bucket); positions in the global
order come the same way from equal slices of the fractional rank.  A source with a
third of all rows is spread over as many buckets as its rows need.

Defined cases: a null text has size 1 and crc32 0; an empty one likewise.  A null
source is a source of its own.  Null ids and repeated rows are rows like others.
Ties of the seeded hash are broken by id, crc32, size; rows equal in all of these
are interchangeable.  An empty table gives no rows.  Fewer rows than shards leave
some shards empty.  Extra columns are ignored.

``stream_manifest`` shards rows that already come in an order, such as the mixed stream of
operator 10, by the same method: a row's place in the stream takes the place of the seeded
hash, so fractional ranks within a source follow the stream, every shard matches the mixture,
and a shard's slots keep the stream's order and so its weights.  The stream's order is that of
the Parquet files (by part number, then path) and of the rows in them; a histogram over the
files is all that is needed to count places.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LEAST_BUCKET = 1_000


def _offsets(counts: DataFrame, part: list[str], order: str) -> DataFrame:
    """Rows before each bucket, from a histogram ``n``."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _fields(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> list[Column]:
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
            F.col(f"`{source_col}`").isNull().alias("no_source"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw.cast("binary")).alias("text_crc32")]


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id",
               source_col: str = "source", text_col: str = "text",
               rows_per_bucket: int | None = None) -> DataFrame:
    """id, size, text_crc32, source, position (from 0), shard, slot for every row."""
    rows = docs.select(*_fields(id_col, source_col, text_col))
    total = docs.count()
    buckets = _buckets(total, rows_per_bucket)
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = rows.withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    return (_stratified(rows, total, buckets, shards)
            .select("doc_id", "size", "text_crc32", F.when(~F.col("no_source"), F.col("source")).alias("source"),
                    "position", "shard", "slot"))


def _buckets(total: int, rows_per_bucket: int | None = None) -> int:
    """Buckets of about sqrt(rows): neither a bucket nor the list of buckets becomes one task's burden."""
    return max(1, -(-total // (rows_per_bucket or max(LEAST_BUCKET, math.isqrt(total)))))


def _stratified(rows: DataFrame, total: int, buckets: int, shards: int) -> DataFrame:
    """Rows (``_fields``, their order ``h`` and its bucket ``b``) with position, shard and slot in the order of fractional ranks."""
    # order within a source: (b, h, doc_id, ...): any order that the seed fixes will do
    key = ["source", "no_source"]
    per = rows.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy(*key).agg(F.sum("n").alias("of"))
    hist = _offsets(per, key, "b").join(sizes, key).drop("n")
    in_bucket = Window.partitionBy(*key, "b").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("k", F.row_number().over(in_bucket)).join(hist, [*key, "b"])
    ranked = ranked.withColumn("f", (F.col("before") + F.col("k") - F.lit(0.5)) / F.col("of"))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1))).drop("before", "k", "of")
    # the slices' sizes follow from the source sizes alone: count of k with floor((k - 1/2) / n * G) = g
    slices = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    start = _offsets(slices, [], "g").drop("n") if buckets > 1 else slices.select("g", F.lit(0).alias("before"))
    in_slice = Window.partitionBy("g").orderBy("f", "h", *key, "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("k", F.row_number().over(in_slice)).join(start, "g")
    placed = placed.withColumn("position", F.col("before") + F.col("k") - 1)
    shard = F.expr(f"cast((position * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``."""
    return shard_manifest(table(spark, sf_dir, "documents"))


def shard_manifest(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    return _manifest(interleave(docs, shards, seed))


def stream_manifest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The manifest of rows that come in the order of ``docs``' Parquet files, ``position`` being the place in that order;
    of rows without files, ``shard_manifest``."""
    try:
        rows = docs.select(*_fields(), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return shard_manifest(docs, shards)
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("order", F.struct(part.alias("part"), "file"))
    start = _offsets(files, [], "order").select("file", "before")
    total = docs.count()
    buckets = _buckets(total)
    rows = rows.join(start, "file").withColumn("h", F.col("before") + F.col("at")).drop("file", "before", "at")
    rows = rows.withColumn("b", F.expr(f"h * {buckets} div {max(total, 1)}"))
    placed = _stratified(rows, total, buckets, shards).drop("slot", "before", "k").withColumn("position", F.col("h"))
    # slots: the shard's rows in the order of the stream, counted bucket by bucket
    hist = _offsets(placed.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n")), ["shard"], "b").drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "b").orderBy("h"))
    placed = placed.withColumn("k", place).join(hist, ["shard", "b"]).withColumn("slot", F.col("before") + F.col("k") - 1)
    return _manifest(placed.withColumn("source", F.when(~F.col("no_source"), F.col("source"))))


def _manifest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source", "position")
