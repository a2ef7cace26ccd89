"""Time anchors (group B).

Anchors are the shared prediction times.  The exponential back-off rule yields
about seven anchors per doubling of the look-back span (59 for 6.6 years,
~90 for a century), so the list always lives on the driver and is shipped to
executors as literals inside expressions or as a broadcast frame of checked,
bounded size (``MAX_ANCHORS``).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from itertools import count, takewhile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeparts import to_datetime
from ..sources.rdb import Rdb

MAX_ANCHORS = 4096
ANCHOR_COL = "__timestamp"


def earliest_date(rdb: Rdb) -> DataFrame:
    """B1: one-row frame ``earliest`` = min over every table's time column."""
    parts = []
    for t in rdb.schema.tables:
        if t.time_column and t.name in rdb.tables:
            parts.append(rdb.tables[t.name].select(
                F.min(F.col(t.time_column).cast("timestamp_ntz")).alias("earliest")))
    if not parts:
        return rdb.spark.createDataFrame([], "earliest timestamp_ntz")
    return reduce(DataFrame.unionByName, parts).agg(F.min("earliest").alias("earliest"))


def earliest_value(rdb: Rdb) -> dt.datetime | None:
    row = earliest_date(rdb).first()
    return None if row is None or row[0] is None else to_datetime(row[0])


def backoff_anchors(today, earliest) -> list[dt.datetime]:
    """B2: anchors back from ``today``, seven at each spacing of 1, 2, 4, ... days.

    Anchor i lies 7 (2^k - 1) + (i mod 7) 2^k days before ``today``, with k = i div 7;
    the list holds those not before ``earliest``, latest first.  Empty when either
    bound is missing.
    """
    if today is None or earliest is None:
        return []
    start, span = to_datetime(today), (to_datetime(today) - to_datetime(earliest))
    offsets = (dt.timedelta(days=7 * (2 ** (i // 7) - 1) + i % 7 * 2 ** (i // 7)) for i in count())
    return [start - d for d in takewhile(lambda d: d <= span, offsets)]


def make_anchors(rdb: Rdb, today, lookback_days: float | None = None,
                 horizon: dt.timedelta | None = None, data_end=None) -> list[dt.datetime]:
    """Anchors for an RDB, ascending.  B4 ``lookback_days`` keeps anchors no older
    than that before ``today``; B5 ``horizon`` + ``data_end`` drops censored anchors
    whose label window ends after the data."""
    anchors = sorted(backoff_anchors(today, earliest_value(rdb)))
    if lookback_days is not None:
        anchors = lookback_filter(anchors, today, lookback_days)
    if horizon is not None and data_end is not None:
        anchors = censor_filter(anchors, horizon, data_end)
    return anchors


def lookback_filter(anchors, today, lookback_days: float) -> list[dt.datetime]:
    """Anchors no older than ``lookback_days`` before ``today``."""
    lo = to_datetime(today) - dt.timedelta(days=lookback_days)
    return sorted(a for a in map(to_datetime, anchors) if a >= lo)


def censor_filter(anchors, horizon: dt.timedelta, data_end) -> list[dt.datetime]:
    """Keep anchors whose forward window ``(t, t+h]`` ends inside the data."""
    end = to_datetime(data_end)
    return sorted(a for a in map(to_datetime, anchors) if a + horizon <= end)


def anchors_frame(spark: SparkSession, anchors, name: str = ANCHOR_COL) -> DataFrame:
    """Anchors as a small frame (``timestamp_ntz``), size checked before use."""
    anchors = sorted(set(map(to_datetime, anchors)))
    if len(anchors) > MAX_ANCHORS:
        raise ValueError(f"{len(anchors)} anchors exceed MAX_ANCHORS={MAX_ANCHORS}")
    return spark.createDataFrame([(a,) for a in anchors], f"{name} timestamp_ntz")


def cached_anchors(snapshots: DataFrame, before, ts_col: str = ANCHOR_COL) -> DataFrame:
    """Distinct snapshot timestamps strictly before ``before``, ascending."""
    from ..functions.timeparts import ts_lit
    return (snapshots.select(F.col(ts_col).cast("timestamp_ntz").alias(ts_col))
            .where(F.col(ts_col) < ts_lit(before)).distinct().orderBy(ts_col))


def anchors_plan(rdb: Rdb, today, lookback_days: float | None = None, horizon: dt.timedelta | None = None, data_end=None) -> DataFrame:
    """B1-B5 as one plan: the anchors of ``make_anchors`` as a frame that starts at the tables' earliest time.

    The earliest time (one row, combined in the scans) is exploded into the closed form's offsets; nothing passes through
    the driver, and the number of rows is seven per doubling of the span."""
    micros = lambda x: int((to_datetime(x) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    day = 86_400_000_000
    first = earliest_date(rdb).where(F.col("earliest").isNotNull()).select(F.unix_micros(F.col("earliest").cast("timestamp")).alias("first"))
    i = first.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7 * 20))))  # spacings up to 2^20 days, some 20,000 years back
    step = F.expr("shiftleft(1L, cast(i div 7 as int))")
    at = F.lit(micros(today)) - ((step - 1) * 7 + F.expr("i % 7") * step) * F.lit(day)
    out = i.withColumn("at", at).where(F.col("at") >= F.col("first"))
    if lookback_days is not None:
        out = out.where(F.col("at") >= F.lit(micros(today) - round(lookback_days * day)))
    if horizon is not None and data_end is not None:
        out = out.where(F.col("at") + F.lit(horizon // dt.timedelta(microseconds=1)) <= F.lit(micros(data_end)))
    return out.select(F.timestamp_micros("at").cast("timestamp_ntz").alias(ANCHOR_COL))
