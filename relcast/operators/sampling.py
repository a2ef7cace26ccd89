"""Candidate rows and per-anchor sampling (group C).

Random choices use the portable seeded hash (``functions.hashing``) so samples
are reproducible and checkable.  The per-anchor "first k by score" cut never
puts a whole anchor into one task: scores are bucketed, a small
(anchor, bucket) histogram finds the bucket holding the k-th row, buckets
before it are kept whole and only the boundary bucket is ranked with a window.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import epoch_seconds, typed_part, unit_hash
from ..plans.history import TS, Agg, cumulative_aggregate, expand_created
from ..sources import schema as S
from ..sources.rdb import Rdb

N_BUCKETS = 1024
SEED = 42


def static_candidates(rdb: Rdb, table: str) -> DataFrame:
    """Every entity once with its include-columns, no timestamp."""
    return rdb[table].select(*rdb.schema.table(table).include_columns())


def creation_candidates(rdb: Rdb, table: str, anchors) -> DataFrame:
    """(anchor, entity) for every entity whose time column is <= anchor."""
    ts = rdb.schema.table(table)
    cols = ts.include_columns()
    base = rdb[table].select(*dict.fromkeys(cols + [ts.time_column]))
    return expand_created(base, ts.time_column, anchors).select(TS, *cols)


def activity_counts(rdb: Rdb, table: str, anchors) -> DataFrame:
    """C4: per referencing FK edge (child tables with a time column, self-references
    ignored): number of child rows with time <= t, by (edge, t, fk value)."""
    parts = []
    for r in rdb.schema.relationships():
        child = rdb.schema.table(r.child_table)
        if r.parent_table != table or r.child_table == table or not child.time_column:
            continue
        c = cumulative_aggregate(rdb[r.child_table], [r.child_column], child.time_column, anchors,
                                 [Agg("activity_count", "count")])
        parts.append(c.select(F.lit(f"{r.child_table}.{r.child_column}").alias("edge"), TS,
                              F.col(r.child_column).alias("entity_id"), "activity_count"))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts)


def activity_total(rdb: Rdb, table: str, anchors) -> DataFrame | None:
    """Activity summed over edges; inner join to the entity table drops NULL
    and dangling keys; None when no edge exists."""
    counts = activity_counts(rdb, table, anchors)
    if counts is None:
        return None
    pk = rdb.schema.table(table).primary_key
    tot = counts.groupBy(TS, "entity_id").agg(F.sum("activity_count").alias("total_activity"))
    ents = rdb[table].select(F.col(pk).alias("entity_id"))
    return tot.join(ents, "entity_id").select(TS, "entity_id", "total_activity")


def sample_size(total: Column, rate: float) -> Column:
    """greatest(1, round(total * rate)) in exact decimal arithmetic (rounds half up)."""
    r = F.lit(Decimal(str(rate)))
    return F.greatest(F.lit(1), F.round(total.cast("decimal(20,0)") * r).cast("long"))


def topk_per_group(df: DataFrame, group: str, bucket: Column, order: list[Column],
                   k_of_total) -> DataFrame:
    """Exact first-``k`` rows per ``group`` in ascending ``order``, k = ``k_of_total(n_rows_in_group)``.

    ``bucket`` must be an integer that is non-decreasing along ``order``.  Rows that are kept or dropped for certain
    are never moved: (1) a (group, bucket) histogram (map-side combined) gives each group's boundary bucket and how many
    of its rows are needed; (2) only the rows of boundary buckets are ranked, which gives each group's last kept order key
    and how many rows share it; (3) a filter against that key (one row per group, bounded by the anchor count, so
    broadcast) keeps the rows before it, and rows equal to it are ranked to make up the number.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    b = df.withColumns({"__b": bucket, "__o": key})
    hist = b.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    wg = Window.partitionBy(group)
    w = wg.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("__cum", F.sum("__n").over(w))
            .withColumn("__k", k_of_total(F.sum("__n").over(wg)))
            .withColumn("__before", F.col("__cum") - F.col("__n")))
    boundary = hist.where((F.col("__before") < F.col("__k")) & (F.col("__cum") >= F.col("__k"))).select(
        group, F.col("__b").alias("__bstar"), (F.col("__k") - F.col("__before")).alias("__need"))
    # coalesce keeps the condition null-tolerant: no IsNotNull(__b) is inferred and
    # pushed below the projection (which would re-inline the score expression).
    edge = b.join(F.broadcast(boundary), group).where(F.coalesce(F.col("__b"), F.lit(-1)) == F.col("__bstar"))
    counts = edge.groupBy(group, "__o", "__bstar", "__need").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(group).orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__cum", F.sum("__n").over(run))
    last = counts.where((F.col("__cum") >= F.col("__need")) & (F.col("__cum") - F.col("__n") < F.col("__need"))).select(
        group, "__bstar", F.col("__o").alias("__last"), (F.col("__need") - F.col("__cum") + F.col("__n")).alias("__ties"), F.col("__n").alias("__same"))
    tagged = b.join(F.broadcast(last), group)
    at = F.coalesce(F.col("__b"), F.lit(-1))
    before = (at < F.col("__bstar")) | ((at == F.col("__bstar")) & (
        (F.col("__o") < F.col("__last")) | ((F.col("__o") == F.col("__last")) & (F.col("__same") == F.col("__ties")))))
    equal = (at == F.col("__bstar")) & (F.col("__o") == F.col("__last")) & (F.col("__same") > F.col("__ties"))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.lit(1)))
    some = tagged.where(equal).withColumn("__rn", rn).where(F.col("__rn") <= F.col("__ties")).drop("__rn")
    return tagged.where(before).unionByName(some).drop("__b", "__o", "__bstar", "__last", "__ties", "__same")


def _k(rate: float):
    return lambda total: F.least(total, sample_size(total, rate))


def proportional_sample(cands: DataFrame, id_col: str, rate: float = 0.3, seed: int = SEED,
                        group: str = TS) -> DataFrame:
    """Per anchor keep the first greatest(1, round(n * rate)) rows by u = hash(seed, t, id)."""
    u = unit_hash(seed, epoch_seconds(F.col(group)), typed_part(cands, id_col))
    c = cands.withColumn("__u", u)
    bucket = F.floor(F.col("__u") * N_BUCKETS).cast("int")
    return topk_per_group(c, group, bucket, [F.col("__u"), F.col(id_col)], _k(rate)).drop("__u")


def activity_biased_sample(cands: DataFrame, id_col: str, activity_col: str, rate: float = 0.3,
                           bias: float = 2.0, seed: int = SEED, group: str = TS) -> DataFrame:
    """Per anchor keep the first greatest(1, round(n * rate)) rows by
    pow(coalesce(activity, 1), bias) * u descending (ties by id)."""
    u = unit_hash(seed, epoch_seconds(F.col(group)), typed_part(cands, id_col))
    score = F.pow(F.coalesce(F.col(activity_col).cast("double"), F.lit(1.0)), F.lit(bias)) * u
    c = cands.withColumn("__s", score)
    # log-scale bucket, negated so that it grows as the score falls; zero scores last.
    bucket = F.when(F.col("__s") > 0, -F.floor(F.log2(F.col("__s")) * 64)).otherwise(F.lit(1 << 30)).cast("int")
    return topk_per_group(c, group, bucket, [-F.col("__s"), F.col(id_col)], _k(rate)).drop("__s")


def placeholder_label(df: DataFrame, id_col: str, seed: int = SEED + 1, group: str | None = TS) -> DataFrame:
    """Random 0/1 label (parity demos only)."""
    parts = [epoch_seconds(F.col(group))] if group else []
    return df.withColumn("__label__", (unit_hash(seed, *parts, typed_part(df, id_col)) < 0.5).cast("int"))


def sample_labels(labels: DataFrame, rate: float = 0.3, seed: int = SEED,
                  activity: DataFrame | None = None, bias: float = 2.0) -> DataFrame:
    """Sample a label frame per anchor (proportional, or activity-biased when an
    activity frame (``__timestamp``, ``__id``, ``total_activity``) is given)."""
    if activity is None:
        return proportional_sample(labels, S.ID, rate, seed)
    joined = labels.join(activity.select(TS, F.col("entity_id").alias(S.ID), "total_activity"),
                         [TS, S.ID], "left")
    return activity_biased_sample(joined, S.ID, "total_activity", rate, bias, seed).drop("total_activity")


def cap_rows(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """C11: at most ``n`` rows, a seeded random subset without replacement
    (global top-n by hash: each partition keeps n, the driver merges n per partition)."""
    parts = [typed_part(df, c) for c in key_cols]
    return df.withColumn("__u", unit_hash(seed, *parts)).orderBy("__u", *key_cols).limit(n).drop("__u")


def random_rows(df: DataFrame, key_col: str, n: int = 5, seed: int = SEED) -> DataFrame:
    """``n`` seeded random rows of a table."""
    return df.withColumn("__u", unit_hash(seed, typed_part(df, key_col))).orderBy("__u", key_col).limit(n).drop("__u")


def sampling_report(before: DataFrame, after: DataFrame, group: str = TS) -> DataFrame:
    """Rows per anchor before and after sampling and the effective fraction."""
    b = before.groupBy(group).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(group).agg(F.count(F.lit(1)).alias("n_after"))
    out = b.join(a, group, "left").select(group, "n_before",
                                          F.coalesce(F.col("n_after"), F.lit(0)).cast("long").alias("n_after"))
    return out.withColumn("fraction", F.round(F.col("n_after") / F.col("n_before"), 6))
