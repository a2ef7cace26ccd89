"""Operator 5: benchmark decontamination by MinHash containment search.

A document contains a test item when it holds at least ``threshold`` (0.8) of the item's
distinct five-word shingles, wherever they are.  Items are short and documents long, so
Jaccard similarity says nothing; the search is for containment.

Items are partitioned by size.  The sketch of an item is its bottom-k MinHash: the k
smallest hash values of its shingles.  In the partition of items with up to u shingles,
k = floor((1 - threshold) * u) + 1: a document that misses at most that share of the
item's shingles must hold one of the k minima, so the search loses nothing, however
long the document.  A hit is verified by counting the item's shingles in the document.

Documents are never sketched or shuffled when the items are small (``max_broadcast`` hash values, some 17 bytes
each on the driver and in every task): one pass over each document's shingles probes a sorted array.  Beyond that
size, documents' shingles are joined with the sketches on the hash and candidates are
verified by a join on (document, shingle); both ways give the same rows.

Defined cases: null and empty texts have no shingles and match nothing; an item with fewer
than five words has one shingle, its whole word sequence, and is contained only in documents
with the very same words; rows with the same document id, or with none, are matched one by
one and reported once per id and item, by their best row; rows with the same item id are one item (their shingles
together); an item without an id is no item; no items or no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_table, table
from .shingles import distinct_per_row, list_column, shingle_hashes

THRESHOLD = 0.8
MAX_BROADCAST = 2_000_000  # hash values of all items together: 16 MB


def shingle_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, of, h): the distinct shingles h of each row; ``of`` tells texts with the same id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, r = distinct_per_row(*shingle_hashes(b.column("t")))
            yield pa.RecordBatch.from_arrays([b.column("id"), list_column(h, r, len(b.column("t")))], ["id", "h"])

    picked = df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as t")
    return picked.mapInArrow(run, "id long, h array<long>").select("id", F.xxhash64("h").alias("of"), F.explode("h").alias("h"))


def item_shingles(items: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """item_id, h, n (the item's shingles), sketch (whether h is among its k minima)."""
    rows = shingle_rows(items.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col).select("id", "h").distinct()
    lists = rows.groupBy("id").agg(F.sort_array(F.collect_set("h")).alias("hs"))  # one test item's words
    n = F.size("hs")
    upper = F.pow(F.lit(2), F.ceil(F.log2(n)))  # its size partition: (u / 2, u]
    lists = lists.withColumn("n", n).withColumn("k", F.least(n, (F.floor(F.lit(1 - threshold + 1e-9) * upper) + 1).cast("int")))
    return lists.select(F.col("id").alias("item_id"), "n", "k", F.posexplode("hs").alias("at", "h")).select(
        "item_id", "n", "h", (F.col("at") < F.col("k")).alias("sketch"))


def _probe(docs: DataFrame, shingles: pa.Table, threshold: float) -> DataFrame:
    """One pass over the documents with all items' shingles at hand (at most MAX_BROADCAST values)."""
    hs, ids, sk = (shingles.column(c).to_numpy() for c in ("h", "item_id", "sketch"))
    hs, sk = hs.astype(np.int64).view(np.uint64), sk.astype(bool)
    order = np.argsort(hs, kind="stable")
    hs, ids, sk = hs[order], ids[order], sk[order]
    items, item_at = np.unique(ids, return_inverse=True)
    size = np.bincount(item_at, minlength=len(items))
    need = np.ceil(threshold * size - 1e-9).astype(np.int64)
    minima = np.unique(hs[sk])
    shared = docs.sparkSession.sparkContext.broadcast((hs, item_at, sk, items, size, need, minima))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, item_at, sk, items, size, need, minima = shared.value
        for b in batches:
            h, r = shingle_hashes(b.column("t"))
            got: list[tuple[int, int, int]] = []
            if len(h) and len(minima):
                at = np.minimum(np.searchsorted(minima, h), len(minima) - 1)
                cand = np.unique(r[minima[at] == h])  # documents that hold some item's minimum
                if len(cand):
                    mine = np.isin(r, cand)
                    ch, cr = distinct_per_row(h[mine], r[mine])
                    lo, hi = np.searchsorted(hs, ch, "left"), np.searchsorted(hs, ch, "right")
                    n = hi - lo
                    src = np.repeat(np.arange(len(ch)), n)
                    ent = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                    pair = cr[src].astype(np.int64) * len(items) + item_at[ent]
                    keys, counts = np.unique(pair, return_counts=True)
                    hit = np.isin(keys, pair[sk[ent]])  # only candidates: they share a minimum
                    ok = hit & (counts >= need[keys % len(items)])
                    got = [(k // len(items), k % len(items), c) for k, c in zip(keys[ok], counts[ok])]
            rows, its, cnt = (np.array([g[j] for g in got], np.int64) for j in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column("i").take(pa.array(rows)), pa.array(items[its] if len(its) else its, pa.int64()),
                 pa.array(size[its] if len(its) else its, pa.int64()), pa.array(cnt, pa.int64())],
                ["doc_id", "item_id", "n_item", "n_shared"])

    return docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every contained item."""
    index = shared_table(item_shingles(items, item_col, item_text, threshold), "items")
    size = index.count()
    picked = docs.selectExpr(f"cast(`{doc_col}` as bigint) as i", f"`{text_col}` as t")
    if size <= max_broadcast:
        found = _probe(picked, index.select("h", "item_id", "sketch").toArrow(), threshold)
    else:
        # a row is named by its id, whether it has one, and the hash of its shingles: no part of the name is null
        row = ["id", "none", "of", "item_id"]
        rows = shingle_rows(picked, "i", "t").withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
        cand = rows.join(index.where("sketch").select("h", "item_id"), "h").select(*row).distinct()
        held = (rows.join(index.select("h", "item_id", "n"), "h").groupBy(*row)
                .agg(F.max("n").cast("long").alias("n_item"), F.count_distinct("h").alias("n_shared")))
        held = held.join(cand, row, "left_semi").withColumn("id", F.when(~F.col("none"), F.col("id")))
        found = (held.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - F.lit(1e-9)))
                 .select(F.col("id").alias("doc_id"), "item_id", "n_item", "n_shared"))
    found = found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with the item's shingles contained to 0.8 or more."""
    prepare(spark)
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that contain an item; every row is judged by its own text, whatever its id."""
    key = F.xxhash64("text")
    texts = docs.where("text is not null").select(key.alias("doc_id"), "text")
    bad = find_contaminated(texts, items, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    bad = shared_table(bad, "contaminated")
    return docs.join(bad, F.when(docs["text"].isNotNull(), key) == bad["__bad"], "left_anti").select(*docs.columns)


# Items' and documents' distinct shingles in DuckDB; the whole tables, no subset.
ORACLE_OP5 = """
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (),
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT kind, id, row, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
d AS (SELECT DISTINCT id, row, g FROM s WHERE kind = 'd'),
i AS (SELECT DISTINCT id, g FROM s WHERE kind = 'i'),
n AS (SELECT id, count(*) AS n_item FROM i GROUP BY id),
r AS (SELECT d.row, d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM d JOIN i USING (g) GROUP BY ALL),
m AS (SELECT doc_id, item_id, max(shared) AS n_shared FROM r GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n ON n.id = item_id WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""
