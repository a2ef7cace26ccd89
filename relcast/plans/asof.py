"""Point-in-time aggregation at per-row cutoffs (no shared anchors).

Where every target row has a time of its own, the time line cannot be cut at a short list of anchors.  Targets and events
are united instead and one running pass answers them all:

1. the union is dealt out by key; a key with more than ``HOT_ROWS`` rows (found in a part of the rows, which decides
   nothing but where rows lie) is cut into up to ``PIECES`` stretches of time, so it is no task's burden;
2. inside each (key, piece) a running window aggregates the events up to each cutoff;
3. only for keys that were cut, the totals of a key's earlier pieces (one row per key and piece) are merged into the
   running values.

Target rows travel once, with their columns, so nothing is joined back to them.  No row is copied and no events x cutoffs
pairs are made, whatever the number of distinct cutoffs.
``windowed_aggregate`` answers look-back windows (t - h, t] in the same way without subtracting anything: time is cut into
buckets of length h, so a window is the end of one bucket and the beginning of the next, a backward and a forward pass.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .history import Agg, _add_moments, _merge, _partial, _td_us, time_micros

CUT = "__cut"
HOT_ROWS = 500_000  # rows of a key above which it is cut into pieces
PIECES = 64         # of such a key
PART = 16           # the rows of one in this many (key, time) pairs tell which keys are hot
_ZERO = ("count", "count_nonnull")


def _no_moments() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))


def combine(a: Agg, x: Column, y: Column) -> Column:
    """Aggregates of two disjoint sets of events together; NULL stands for no events."""
    if a.kind == "moments":
        return _add_moments(F.coalesce(x, _no_moments()), F.coalesce(y, _no_moments()))
    if a.kind in _ZERO:
        return F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    if a.kind == "sum":
        return F.coalesce(x + y, x, y)
    if a.kind == "hll":
        return F.coalesce(F.hll_union(x, y), x, y)
    if a.kind == "min":
        return F.when(x <= y, x).otherwise(F.coalesce(y, x))
    if a.kind == "max":
        return F.when(x >= y, x).otherwise(F.coalesce(y, x))
    raise ValueError(a.kind)


def _running(a: Agg, over: Window) -> Column:
    return _merge(a, F.col(a.name)).over(over)


def _running_moments(df: DataFrame, a: Agg, order: Window, over: Window) -> DataFrame:
    """Adds the moments of column ``a.name`` over the frame ``over``, as deviations from the first mean in ``order``
    (no squares of large values are subtracted)."""
    p = F.col(a.name)
    ref = f"__r_{a.name}"
    first = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(ref, F.first(F.when(p["n"] > 0, p["mean"]), ignorenulls=True).over(first))
    d = p["mean"] - F.col(ref)
    n = F.coalesce(F.sum(p["n"]).over(over), F.lit(0)).cast("long")
    s1 = F.sum(p["n"] * d).over(over)
    s2 = F.sum(p["m2"] + p["n"] * d * d).over(over)
    some = n > 0
    return df.withColumn(f"__m_{a.name}", F.struct(
        n.alias("n"), F.when(some, F.col(ref) + s1 / n).otherwise(0.0).alias("mean"),
        F.when(some, s2 - s1 * s1 / n).otherwise(0.0).alias("m2"))).drop(ref)


def hot_keys(rows: DataFrame, keys: list[str], t: str) -> DataFrame | None:
    """(keys, ``__at``): keys with more than ``HOT_ROWS`` rows and the times at which they are cut; None where there are none."""
    part = rows.select(*keys, t).where(F.pmod(F.xxhash64(*keys, t), F.lit(PART)) == 0)
    often = materialize(part.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * PART > HOT_ROWS).select(*keys))
    if often.isEmpty():
        return None
    at = F.percentile_approx(t, [i / PIECES for i in range(1, PIECES)])
    return materialize(part.join(F.broadcast(often), keys).groupBy(*keys).agg(F.array_sort(F.array_distinct(at)).alias("__at")))


def _single(a: Agg, dtype) -> Column:
    """The partial aggregate (``history._partial``) of a single row."""
    if a.kind == "count":
        return F.lit(1).cast(dtype).alias(a.name)
    c = F.col(a.col)
    if a.kind == "count_nonnull":
        return F.when(c.isNotNull(), 1).otherwise(0).cast(dtype).alias(a.name)
    if a.kind == "moments":
        x = c.cast("double")
        return F.struct(F.when(x.isNotNull(), 1).otherwise(0).cast("long").alias("n"), x.alias("mean"),
                        F.when(x.isNotNull(), F.lit(0.0)).alias("m2")).alias(a.name)
    return c.cast(dtype).alias(a.name)


def _run(df: DataFrame, aggs: list[Agg], order: Window, over: Window) -> DataFrame:
    """Adds the running value ``__m_<name>`` of every aggregate."""
    for a in aggs:
        df = _running_moments(df, a, order, over) if a.kind == "moments" else df.withColumn(f"__m_{a.name}", _running(a, over))
    return df


def attach_prefix(targets: DataFrame, events: DataFrame, keys: list[str], cut: str, time_col: str, aggs: list[Agg],
                  inclusive: bool = False, backward: bool = False, probe: bool = True) -> DataFrame:
    """All rows and columns of ``targets`` with the aggregates of their key's events before the cutoff (``backward``: after
    it); events at the cutoff itself count if ``inclusive``.

    Counts are 0, sums, minima and maxima NULL, moments (0, 0, 0) where there is no event, also for rows without a key or
    cutoff.  Events without a key or time take no part.  ``probe``: whether keys may be hot by their targets alone."""
    t, side, piece = "__t", "__side", "__piece"
    names = [a.name for a in aggs]
    sign = -1 if backward else 1
    col = lambda c: F.col(f"`{c}`")
    known = reduce(lambda x, y: x & y, [col(k).isNotNull() for k in keys])
    ev = events.where(known & F.col(time_col).isNotNull()).withColumn(t, time_micros(F.col(time_col)) * sign)
    rows = targets.withColumn(t, time_micros(col(cut)) * sign)
    seen = ev.select(*keys, t)
    if probe:
        seen = seen.unionByName(rows.where(known & F.col(t).isNotNull()).select(*[col(k) for k in keys], t))
    hot = hot_keys(seen, keys, t)
    combined = ev.groupBy(*keys, t).agg(*[_partial(a) for a in aggs])
    types = {f.name: f.dataType for f in combined.schema}
    if hot is None and not any(a.kind == "hll" for a in aggs):
        combined = ev.select(*keys, t, *[_single(a, types[a.name]) for a in aggs])  # the window combines them in any case

    def placed(df: DataFrame) -> DataFrame:
        at = F.lit(0)
        if hot is not None:
            df = df.join(F.broadcast(hot), keys, "left")
            at = F.when(F.col("__at").isNull(), 0).otherwise(F.size(F.filter("__at", lambda c: c <= F.col(t))))
        return df.withColumn(piece, F.when(known, at).otherwise(F.pmod(F.xxhash64(t), F.lit(1024))).cast("int"))

    given = {f.name: f.dataType for f in targets.schema if f.name not in keys}
    mine = 1 if inclusive else 0
    left = placed(combined).select(*keys, t, piece, F.lit(1 - mine).alias(side), *names,
                                   *[F.lit(None).cast(d).alias(f"__p{i}") for i, d in enumerate(given.values())])
    right = placed(rows).select(*[col(k) for k in keys], t, piece, F.lit(mine).alias(side), *[F.lit(None).cast(types[n]).alias(n) for n in names],
                                *[col(c).alias(f"__p{i}") for i, c in enumerate(given)])
    order = Window.partitionBy(*keys, piece).orderBy(t, side)
    over = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _run(left.union(right), aggs, order, over).where(F.col(side) == mine)
    value = {a.name: F.coalesce(F.col(f"__m_{a.name}"), F.lit(0)) if a.kind in _ZERO else F.col(f"__m_{a.name}") for a in aggs}
    if hot is not None:
        # what a hot key's events of one piece come to, handed on to the key's later pieces
        own = _run(left.join(F.broadcast(hot.select(*keys)), keys, "left_semi"), aggs, order, over)
        state = F.struct(*[F.col(f"__m_{n}").alias(n) for n in names])
        totals = own.groupBy(*keys, piece).agg(F.max_by(state, F.struct(t, side)).alias("__total"))
        grid = hot.select(*keys, F.explode(F.sequence(F.lit(0), F.size("__at"))).alias(piece))
        totals = grid.join(totals, [*keys, piece], "left").select(*keys, piece, *[F.col(f"__total.{n}").alias(n) for n in names])
        parts = Window.partitionBy(*keys).orderBy(piece)
        carried = _run(totals, aggs, parts, parts.rowsBetween(Window.unboundedPreceding, -1))
        carried = carried.select(*keys, piece, *[F.col(f"__m_{n}").alias(f"__c_{n}") for n in names])
        out = out.join(F.broadcast(carried), [*keys, piece], "left")
        value = {a.name: combine(a, F.col(f"__c_{a.name}"), F.col(f"__m_{a.name}")) for a in aggs}
    place = {c: f"__p{i}" for i, c in enumerate(given)}
    return out.select(*[F.col(place[c]).alias(c) if c in place else col(c) for c in targets.columns], *[value[n].alias(n) for n in names])


def prefix_aggregate(targets: DataFrame, events: DataFrame, keys: list[str], cut: str, time_col: str, aggs: list[Agg],
                     inclusive: bool = False, backward: bool = False) -> DataFrame:
    """(keys, ``cut``, aggregates): one row per distinct (keys, cutoff) of ``targets`` with the aggregates of the
    key's events before the cutoff (``attach_prefix``).  Rows without a key or time take no part."""
    cuts = targets.select(*keys, cut)
    for c in [*keys, cut]:
        cuts = cuts.where(F.col(c).isNotNull())
    return attach_prefix(cuts.distinct(), events, keys, cut, time_col, aggs, inclusive, backward)


def windowed_aggregate(targets: DataFrame, events: DataFrame, keys: list[str], cut: str, time_col: str, aggs: list[Agg],
                       span: dt.timedelta, closed: str = "left") -> DataFrame:
    """The same over look-back windows: [t - span, t) for ``closed='left'``, (t - span, t] for ``'right'``."""
    us = _td_us(span)
    bucket = lambda c: time_micros(c) - F.pmod(time_micros(c), F.lit(us))
    rows = events.withColumn("__bk", bucket(F.col(time_col)))
    cuts = targets.select(*keys, cut).distinct()
    fore = cuts.withColumn("__bk", bucket(F.col(cut)))
    start = F.timestamp_micros(time_micros(F.col(cut)) - F.lit(us)).cast("timestamp_ntz")
    back = cuts.withColumn("__start", start).withColumn("__bk", bucket(F.col("__start")))
    right = closed == "right"
    a = prefix_aggregate(fore, rows, [*keys, "__bk"], cut, time_col, aggs, inclusive=right)
    b = prefix_aggregate(back, rows, [*keys, "__bk"], "__start", time_col, aggs, inclusive=not right, backward=True)
    a = a.drop("__bk").select(*keys, cut, *[F.col(x.name).alias(f"__a_{x.name}") for x in aggs])
    end = F.timestamp_micros(time_micros(F.col("__start")) + F.lit(us)).cast("timestamp_ntz")
    b = b.select(*keys, end.alias(cut), *[F.col(x.name).alias(f"__b_{x.name}") for x in aggs])
    return a.withColumn(cut, F.col(cut).cast("timestamp_ntz")).join(b, [*keys, cut], "left").select(
        *keys, cut, *[combine(x, F.col(f"__a_{x.name}"), F.col(f"__b_{x.name}")).alias(x.name) for x in aggs])
