"""Task tables and point-in-time joins (group E)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeparts import to_datetime, ts_lit
from ..plans.asof import CUT, prefix_aggregate
from ..plans.history import Agg
from ..sources import schema as S
from ..sources.rdb import Rdb
from . import sampling as C

ID, TS, LABEL = S.ID, S.TS, S.LABEL


def entity_columns(rdb: Rdb, table: str) -> list[str]:
    """Entity columns carried into task tables: all but PK, FKs and datetime columns."""
    ts = rdb.schema.table(table)
    return [c.name for c in ts.columns
            if c.dtype not in (S.PRIMARY_KEY, S.FOREIGN_KEY, S.DATETIME) and c.name != ts.time_column]


def train_table(rdb: Rdb, table: str, labels: DataFrame, rate: float | None = 0.3,
                seed: int = C.SEED, activity: DataFrame | None = None) -> DataFrame:
    """E1 (via C10): labels -> per-anchor sample -> entity columns by key.

    ``[__id, __timestamp, __label, <entity columns>]``; the key join is an
    equi-join on the PK (sort-merge, or broadcast when AQE measures a small side).
    """
    pk = rdb.schema.table(table).primary_key
    sampled = labels if rate is None else C.sample_labels(labels, rate, seed, activity)
    cols = entity_columns(rdb, table)
    ents = rdb[table].select(F.col(pk).alias(ID), *cols)
    return sampled.join(ents, ID, "inner").select(ID, TS, LABEL, *cols)


def test_table(rdb: Rdb, table: str, today, entity_ids=None) -> DataFrame:
    """Entities (all, a list, or a frame of ids) at ``__timestamp = T`` with a NULL label."""
    pk = rdb.schema.table(table).primary_key
    cols = entity_columns(rdb, table)
    ents = rdb[table].select(F.col(pk).alias(ID), *cols)
    ents = entity_filter(ents, entity_ids)
    label_type = "double"
    return ents.select(ID, ts_lit(today).alias(TS), F.lit(None).cast(label_type).alias(LABEL), *cols)


def entity_filter(df: DataFrame, entity_ids, id_col: str = ID) -> DataFrame:
    """Keep ids in ``entity_ids`` (a list, or a frame whose first column is the id) by a
    left-semi join; ids that the key's type cannot hold match nothing."""
    if entity_ids is None:
        return df
    if not isinstance(entity_ids, DataFrame):
        entity_ids = df.sparkSession.createDataFrame([(None if i is None else str(i),) for i in entity_ids], "id string")
    first = entity_ids.columns[0]
    return df.join(entity_ids.select(F.col(first).try_cast(df.schema[id_col].dataType).alias(id_col)), id_col, "left_semi")


def label_feature_join(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner merge on (id, timestamp)."""
    return features.join(labels, [ID, TS], "inner")


def latest_before(snapshots: DataFrame, before, id_col: str = ID, ts_col: str = TS) -> DataFrame:
    """E5: per entity the row with the largest timestamp strictly before ``before``.

    An aggregate (``max_by`` over a struct), so a hot entity is reduced map-side
    instead of being sorted in one task; entities with no earlier row vanish.
    """
    others = [c for c in snapshots.columns if c != id_col]
    packed = F.struct(*[F.col(c) for c in others])
    agg = (snapshots.where(F.col(ts_col) < ts_lit(before))
           .groupBy(id_col).agg(F.max_by(packed, F.col(ts_col)).alias("__row")))
    return agg.select(id_col, *[F.col(f"__row.{c}").alias(c) for c in others])


def realign(df: DataFrame, today, ts_col: str = "__timestamp__") -> DataFrame:
    """Replace datetime-part features of the snapshot time with those of ``today``
    (only for columns that exist).  Day of week is Monday = 0."""
    d = to_datetime(today)
    repl = {
        f"YEAR({ts_col})": F.lit(d.year),
        f"MONTH({ts_col})": F.lit(d.month),
        f"DAY({ts_col})": F.lit(d.day),
        f"DAYOFWEEK({ts_col})": F.lit(d.weekday()),
        f"TIMESTAMP_{ts_col}": F.lit(int((d - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000),
    }
    present = {k: v.cast(df.schema[k].dataType) for k, v in repl.items() if k in df.columns}
    return df.withColumns(present) if present else df


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_cols: list[str], bucket: str = "day", tie_col: str | None = None) -> DataFrame:
    """Each left row gets the latest right row with the same key and
    ``right_ts <= left_ts`` (NULLs when none); of right rows at one time the one with
    the largest ``tie_col`` (one of ``right_cols``; the first of them by default).

    Skew-safe plan: time is cut into coarse buckets.  Per (key, bucket) the last
    right row is found by an aggregate and carried forward across buckets with
    a running window over the (small) per-key bucket summaries; inside a bucket
    a union of left and right rows is scanned by a window partitioned by
    (key, bucket), so no key's whole history lands in one task.
    """
    lt, rt = F.col(left_ts), F.col(right_ts)
    L = left.withColumn("__bk", F.date_trunc(bucket, lt.cast("timestamp")).cast("timestamp_ntz"))
    R = right.select(key, right_ts, *right_cols).withColumn(
        "__bk", F.date_trunc(bucket, rt.cast("timestamp")).cast("timestamp_ntz"))
    packed = F.struct(rt.alias("__rts"), *[F.col(c) for c in right_cols])
    tie = tie_col or right_cols[0]
    summ = R.groupBy(key, "__bk").agg(F.max_by(packed, F.struct(rt, F.col(tie))).alias("__last"))
    w = Window.partitionBy(key).orderBy("__bk")
    # latest right row from buckets strictly before each bucket of interest
    allb = L.select(key, "__bk").unionByName(summ.select(key, "__bk")).distinct()
    full = allb.join(summ, [key, "__bk"], "left")
    full = full.withColumn("__prev", F.last("__last", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    prev = full.select(key, "__bk", "__prev")
    # inside the bucket: union rows, right rows sort first on equal time
    lrows = L.withColumn("__side", F.lit(1)).withColumn("__t", lt)
    rrows = R.select(key, "__bk", F.lit(0).alias("__side"), rt.alias("__t"),
                     packed.alias("__r"))
    u = lrows.withColumn("__r", F.lit(None).cast(rrows.schema["__r"].dataType)).unionByName(
        rrows, allowMissingColumns=True)
    wb = Window.partitionBy(key, "__bk").orderBy("__t", "__side", F.col("__r")[tie]).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("__in", F.last("__r", ignorenulls=True).over(wb)).where(F.col("__side") == 1)
    u = u.join(prev, [key, "__bk"], "left")
    best = F.coalesce(F.col("__in"), F.col("__prev"))
    out = u.select(*[F.col(c) for c in left.columns], *[best.getField(c).alias(c) for c in right_cols])
    return out


def split_by_time(df: DataFrame, t1, t2, ts_col: str = TS) -> DataFrame:
    """Temporal split label: train (ts <= T1), validation (T1 < ts <= T2), test (later)."""
    t = F.col(ts_col)
    return df.withColumn("split", F.when(t <= ts_lit(t1), "train").when(t <= ts_lit(t2), "validation")
                         .otherwise("test"))


def task_metadata(rdb: Rdb, table: str, train: DataFrame, task_type: str = "classification",
                  metric: str = "auroc") -> dict:
    """Task record -- name, target table, task type, label / time column, metric and
    the ordered column list with semantic types; empty training data raises."""
    if train.isEmpty():
        raise ValueError(f"no training data generated for table {table}")
    ts = rdb.schema.table(table)
    cols = []
    if TS in train.columns:
        cols.append({"name": TS, "dtype": S.DATETIME})
    cols.append({"name": ID, "dtype": S.PRIMARY_KEY})
    cols.append({"name": LABEL, "dtype": "category" if task_type == "classification" else "float"})
    for c in ts.columns:
        if c.name in train.columns and c.dtype not in (S.PRIMARY_KEY, S.FOREIGN_KEY) and c.name != ts.time_column:
            cols.append({"name": c.name, "dtype": c.dtype})
    return {"name": f"{table}-template", "target_table": table, "task_type": task_type,
            "target_column": LABEL, "time_column": TS if TS in train.columns else None,
            "evaluation_metric": metric, "format": "parquet",
            "source": f"{table}-template/{{split}}", "columns": cols}


def status(models: dict, snapshots: dict | None = None, today=None) -> dict:
    """Which targets have a fitted model and how many cached anchors each has
    (B3, counted from the snapshot frames -- a bounded distinct count)."""
    from .anchors import cached_anchors
    out = {}
    for target, fm in models.items():
        n = None
        if snapshots and target in snapshots and today is not None:
            n = cached_anchors(snapshots[target], today).count()
        out[target] = {"fitted": fm is not None, "task_type": getattr(fm, "task", None),
                       "n_features": len(getattr(fm, "feature_names", []) or []), "n_anchors": n}
    return out


def entity_as_of(target: DataFrame, versions: DataFrame, key: str, since: str | None, cols: list[str], id_col: str = ID,
                 ts_col: str = TS, closed: str = "left") -> DataFrame:
    """Each target row with its entity's columns as they were known at the row's cutoff.

    ``versions`` holds one row per entity and ``since`` (the time from which its values hold), or one row per entity where
    ``since`` is the creation time.  The latest version before the cutoff counts (at it too for ``closed='right'``; of
    versions with one time the largest values), NULLs where there is none; without ``since`` the entity's row always
    holds.  One running maximum per entity answers all cutoffs, however many versions or target rows an entity has."""
    packed = F.struct(*([F.col(since).cast("timestamp_ntz").alias("__since")] if since else []), *[F.col(f"`{c}`").alias(f"__e{i}") for i, c in enumerate(cols)])
    mine = [F.col(f"`{c}`") for c in target.columns]
    values = [F.col(f"__v.__e{i}").alias(c) for i, c in enumerate(cols)]
    if since is None:
        rows = versions.select(F.col(key).alias(id_col), packed.alias("__v")).groupBy(id_col).agg(F.max("__v").alias("__v"))
        return target.join(rows, id_col, "left").select(*mine, *values)
    rows = versions.select(F.col(key).alias(id_col), F.col(since).cast("timestamp_ntz").alias("__since"), packed.alias("__v"))
    out = target.withColumn(CUT, F.col(ts_col).cast("timestamp_ntz"))
    found = prefix_aggregate(out.select(id_col, CUT), rows, [id_col], CUT, "__since", [Agg("__v", "max", "__v")], inclusive=closed != "left")
    return out.join(found, [id_col, CUT], "left").select(*mine, *values)
