"""Corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet
into the shared folder and reads them again as the next stage's documents.  All stages but the last return the
columns of ``documents``; the last returns the shard manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcast.llm.common import prepare, shared_table, table
from relcast.llm.decontam import drop_contaminated
from relcast.llm.mixing import mix_documents
from relcast.llm.ngram_join import near_components
from relcast.llm.quality import drop_rejected
from relcast.llm.sharding import stream_manifest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of like texts: the one with the smallest id (null last), then text hash.

    Groups are found among the different texts, named by their hash, so ids may be null or repeat.  A text without
    words is like no other; of its rows with the same id and hash one stays."""
    prepare(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    rows = shared_table(keyed.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")), "row-keys")
    least = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("x"))
    least = shared_table(least.select("key", "x.none", "x.id", "x.n"), "least")  # one row per text; joins go by it, not by its copies
    of = least.select(F.col("key").alias("__key"), F.col("id").alias("__id"))
    texts = keyed.join(of, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    texts = texts.dropDuplicates(["key"]).select(F.col("key").alias("doc_id"), "text")
    groups = near_components(shared_table(texts, "texts")).select(F.col("doc_id").alias("key"), "n_shingles", "component_id")
    groups = shared_table(groups, "groups")
    best = (least.join(groups.where("n_shingles > 0"), "key").groupBy("component_id").agg(F.min(F.struct("none", "id", "key", "n")).alias("x"))
            .select("x.id", "x.key", "x.n").unionByName(rows.join(groups.where("n_shingles = 0"), "key", "left_semi").select("id", "key", "n")))
    kept = shared_table(best.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("n").alias("__n")), "kept")

    def stay(which: str) -> DataFrame:
        of = kept.where(which)
        same = F.xxhash64(docs["text"]).eqNullSafe(of["__key"]) & docs["doc_id"].cast("long").eqNullSafe(of["__id"])
        return docs.join(of, same, "left_semi").select(*docs.columns)

    # only rows that repeat an id with its text need to be compared once more
    again = stay("__n > 1").withColumn("__key", F.xxhash64("text")).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return stay("__n = 1").unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, their rows and files in the order of the mixed stream."""
    prepare(spark)
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document: the mixed stream, dealt out in turn."""
    prepare(spark)
    return stream_manifest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: The classifier's scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = shared_table(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
