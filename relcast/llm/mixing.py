"""Operator 10: mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's rows, in a seeded random order, are cut into blocks.  A slot of the
mixed stream takes one block.  A source whose share of the stream is w may run its
i-th block (from 1) in the slots from floor((i - 1) / w) up to ceil(i / w) - 1: these
are the block's release time and deadline.  Running, slot by slot, the released block
with the earliest deadline meets every deadline, so after any number of slots a source
is less than one block away from its share.

Target weights are whole numbers (``weights``, or by default the sources' row counts to
the power ``alpha``, scaled so that the largest weight is ``resolution``).  The schedule
goes in cycles: in one cycle a source gives as many blocks as its weight says, until its
blocks run out.  Hence a cycle's schedule depends on which sources still have blocks, not
on how many: at most two kinds of cycle per source, each at most ``sources x resolution``
slots long, whatever the size of the data.  One SQL ``aggregate`` per kind computes its slots; every
other row is placed by arithmetic.  Rows are never dropped or repeated: when a source
has run out the others go on in their proportions, and the deviation bound holds
against the shares of each cycle.

Plan: a histogram of (source, hash bucket) and a ``row_number`` inside a bucket give each
row its rank (no source is ranked in one task); the pattern table has one row per
source and slot of a cycle and is joined on (kind, source, index), so a hot source is
spread over as many keys as its weight.

Defined cases: a null source is a source of its own; a source missing from ``weights`` or
with a weight below 1 gets weight 1; null texts, null ids and repeated rows are rows like
others; ties of the seeded order are broken by id and crc32 of the text; an empty table
gives no rows.  Extra columns are passed through by ``mix_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK_ROWS = 16
RESOLUTION = 100
ALPHA = 0.7
LEAST_BUCKET = 1_000


def source_weights(sizes: DataFrame, weights: dict[str, int] | None, alpha: float, resolution: int) -> DataFrame:
    """(source, no_source, n) -> the same with the whole-number weight ``w`` (at least 1)."""
    if weights is None:
        top = sizes.agg(F.max("n")).scalar()
        w = F.round(F.pow(F.col("n") / top, F.lit(alpha)) * resolution)
        return sizes.withColumn("w", F.greatest(w.cast("long"), F.lit(1)))
    given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    known = F.when(~F.col("no_source"), F.try_element_at(given, F.col("source")))
    return sizes.withColumn("w", F.greatest(F.coalesce(known, F.lit(1)), F.lit(1)).cast("long"))


def _ceil_div(a: str, b: str) -> str:
    return f"(({a}) + ({b}) - 1) div ({b})"


# One slot: among sources with a released block, take the one with the earliest deadline (ties: first
# in the list).  The state holds how many blocks of each source have run and the slots so far.
EDF_SQL = """
aggregate(
  sequence(0L, m - 1),
  named_struct('done', transform(give, x -> 0L), 'slots', cast(array() as array<int>)),
  (s, t) -> transform(array(array_min(transform(give, (a, k) ->
      if(s.done[k] < a and (s.done[k] * m) div a <= t,
         named_struct('deadline', ((s.done[k] + 1) * m + a - 1) div a, 'k', k),
         named_struct('deadline', 9223372036854775807L, 'k', k))))), best ->
    named_struct('done', transform(s.done, (d, k) -> if(k = best.k, d + 1, d)),
                 'slots', concat(s.slots, array(best.k))))[0],
  s -> s.slots)
"""


def cycle_patterns(blocks: DataFrame) -> DataFrame:
    """Slots of every kind of cycle.

    ``blocks``: source, no_source, w, blocks (its number of blocks).  Returns kind, first_cycle,
    until_cycle, first_slot (of its first cycle), m (slots in a cycle), source, no_source, i (index of the
    source's block in the cycle, from 0) and slot (in the cycle)."""
    full = F.expr("blocks div w")
    events = (blocks.select(F.explode(F.array(full, full + 1)).alias("c"))
              .unionByName(blocks.select(F.lit(0).cast("long").alias("c"))).distinct())
    by = Window.partitionBy(F.lit(1)).orderBy("c")
    kinds = events.withColumn("until", F.lead("c").over(by)).where("until is not null")
    sources = blocks.agg(F.collect_list(F.struct("no_source", "source", "w", "blocks"))).scalar()
    pairs = (kinds.withColumn("x", F.explode(sources)).select("c", "until", "x.*")
             .withColumn("a", F.expr("least(greatest(blocks - c * w, 0L), w)")).where("a > 0"))
    listed = (pairs.groupBy("c", "until")
              .agg(F.sort_array(F.collect_list(F.struct("no_source", "source", "a"))).alias("of"), F.sum("a").alias("m"))
              .withColumn("give", F.expr("transform(of, x -> x.a)")))
    # the kinds' first slots: a running sum over at most two rows per source
    before = Window.partitionBy(F.lit(1)).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("first_slot", F.coalesce(F.sum(F.col("m") * (F.col("until") - F.col("c"))).over(before), F.lit(0)))
    slots = (listed.repartition("c").withColumn("slots", F.expr(EDF_SQL))
             .select("c", "until", "first_slot", "m", "of", F.posexplode("slots").alias("slot", "k"))
             .select("c", "until", "first_slot", "m", "slot", F.expr("of[k].source").alias("source"),
                     F.expr("of[k].no_source").alias("no_source")))
    nth = Window.partitionBy("c", "source", "no_source").orderBy("slot")
    return (slots.withColumn("i", (F.row_number().over(nth) - 1).cast("long"))
            .withColumnRenamed("c", "first_cycle").withColumnRenamed("until", "until_cycle"))


def ranked_rows(rows: DataFrame, of_key: DataFrame, key: list[str], order: list[str | Column], rows_per_bucket: int | None,
                total: int) -> DataFrame:
    """Adds ``rank`` (from 0) within ``key`` by hash ``h`` and ``order``, without a window over a whole key.

    The columns of ``of_key`` (one row per key) come along with the histogram, so no join is on ``key`` alone."""
    buckets = max(1, -(-total // (rows_per_bucket or max(LEAST_BUCKET, math.isqrt(total)))))
    rows = rows.withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    per = rows.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    hist = per.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0))).drop("cnt").join(of_key, key)
    inside = Window.partitionBy(*key, "b").orderBy("h", *order)
    return (rows.withColumn("k", F.row_number().over(inside)).join(hist, [*key, "b"])
            .withColumn("rank", F.col("before") + F.col("k") - 1).drop("before", "k", "b"))


def pfair_order(rows: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA,
                resolution: int = RESOLUTION, rows_per_bucket: int | None = None) -> DataFrame:
    """``rows`` with source, no_source, doc_id, text_crc32, h get weight, block, slot (of the whole stream) and nth (in the block)."""
    key = ["no_source", "source"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    blocks = source_weights(sizes, weights, alpha, resolution).withColumn("blocks", F.expr(_ceil_div("n", str(block_rows))))
    total = rows.count()
    pattern = cycle_patterns(blocks)
    ranked = ranked_rows(rows, blocks.select(*key, "w", "blocks"), key, ["doc_id", "text_crc32"], rows_per_bucket, total)
    ranked = (ranked.withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("nth", F.expr(f"cast(rank % {block_rows} as int)"))
              .withColumn("cycle", F.expr("block div w")).withColumn("i", F.expr("block % w")))
    # kinds are runs of cycles: a cycle's run starts at its last event at or before it, a value of the short event list
    events = pattern.agg(F.collect_set("first_cycle")).scalar()
    ranked = (ranked.withColumn("events", events)
              .withColumn("first_cycle", F.array_max(F.filter("events", lambda e: e <= F.col("cycle")))).drop("events"))
    placed = ranked.join(pattern.withColumnRenamed("slot", "at"), ["first_cycle", *key, "i"])
    return placed.withColumn("slot", F.expr("first_slot + (cycle - first_cycle) * m + at"))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"),
                       F.col("source").isNull().alias("no_source"), F.crc32(text.cast("binary")).alias("text_crc32")
                       ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))


def mix_documents(docs: DataFrame, weights: dict[str, int] | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS,
                  alpha: float = ALPHA, resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` with the same columns, its rows (and so its files) in the mixed order."""
    order = pfair_order(_rows(docs, seed), weights, block_rows, alpha, resolution).select(
        F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("source").alias("__source"),
        F.col("no_source").alias("__none"), "slot", "nth")
    # copies of a row are interchangeable: they share the first of their places
    order = order.groupBy("__id", "__crc", "__source", "__none").agg(F.min(F.struct("slot", "nth")).alias("__at"))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(order, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.crc32(text.cast("binary")) == F.col("__crc"))
                       & (F.coalesce(docs["source"], F.lit("")) == F.col("__source")) & (docs["source"].isNull() == F.col("__none")))
    return joined.repartitionByRange("__at").sortWithinPartitions("__at").select(*[docs[c] for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixed stream: slot of its block, place in the block, and the weight used."""
    placed = pfair_order(_rows(table(spark, sf_dir, "documents"), 7))
    return placed.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "w", "block", "slot", "nth")
