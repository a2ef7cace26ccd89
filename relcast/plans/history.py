"""Point-in-time aggregation over shared anchors (the "slot" plans).

Every operator that looks forward (labels) or backward (features, activity)
from a set of anchor times ``t`` reduces to: for each (key, t), aggregate the
key's events whose time lies in a window relative to ``t``.

The anchor list is small (bounded by ``MAX_ANCHORS``) and lives on the driver.
Instead of joining events to anchors (a nested-loop range join that emits
events x anchors rows), we cut the time line at every window boundary and map
each event to the elementary interval ("slot") that contains it with a
balanced binary search written as nested ``CASE WHEN`` -- pure JVM codegen.

* ``window_aggregate``: bounded windows.  ``groupBy(key, slot)`` partial
  aggregates (map-side combine, one row per key and slot), each partial row is
  exploded only to the anchors whose window covers its slot, then one final
  ``groupBy(key, anchor)`` merges them.  A hot key is reduced to at most one row
  per slot before the first shuffle.
* ``cumulative_aggregate``: all-history windows ``(-inf, t]`` / ``(-inf, t)``.
  Slots are the anchors themselves; partials are merged by a running window per
  key and each running row is exploded to the anchors up to the next slot, so
  the output has exactly one row per (key, anchor at or after the first event).
* ``expand_to_anchors``: row-level expansion (for non-decomposable aggregates
  such as count-distinct or mode, and for creation-based candidates).

Nothing here collects data: anchors and cut points are driver constants.
"""

from __future__ import annotations

import bisect
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeparts import to_datetime, ts_lit
from ..operators.anchors import MAX_ANCHORS

ANCHOR_IDX = "__a"
SLOT = "__j"
TS = "__timestamp"

_EPOCH = dt.datetime(1970, 1, 1)
HLL_BITS = 12  # of a sketch of distinct values: a relative standard error of about 1.6 %


def _us(d: dt.datetime) -> int:
    delta = to_datetime(d) - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _td_us(d: dt.timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def time_micros(col: Column) -> Column:
    """Epoch microseconds of a timestamp / timestamp_ntz (session zone is UTC)."""
    return F.unix_micros(col.cast("timestamp"))


def bisect_expr(x: Column, cuts: list, side: str = "left", lit=F.lit) -> Column:
    """Number of ``cuts`` < x (side='left') or <= x (side='right'), as a balanced
    CASE tree of depth log2(len(cuts)).  ``cuts`` must be sorted; ``x`` should be a plain
    column, as an expression would be made again in every node of the tree."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        c = lit(cuts[mid])
        cond = (x <= c) if side == "left" else (x < c)
        return F.when(cond, build(lo, mid)).otherwise(build(mid + 1, hi))
    return build(0, len(cuts))


def bisect_time(t: Column, cuts: list[int], side: str = "left") -> Column:
    """``bisect_expr`` of a time among epoch microseconds.

    Times are compared with times: converting ``t`` in every node made methods of more than 8,000 bytes, which the JVM
    does not compile, so that whole stages were interpreted."""
    return bisect_expr(t, cuts, side, lambda us: ts_lit(_EPOCH + dt.timedelta(microseconds=us)))


def _int_array(values: list) -> Column:
    return F.array(*[F.lit(v).cast("int") if v is not None else F.lit(None).cast("int") for v in values])


def anchor_array(anchors: list) -> Column:
    return F.array(*[ts_lit(a) for a in anchors])


def anchor_ts(idx_col: Column, anchors: list) -> Column:
    """Map a 0-based anchor index to its timestamp."""
    return F.element_at(anchor_array(anchors), idx_col + 1)


def _check(anchors) -> list[dt.datetime]:
    out = sorted(set(map(to_datetime, anchors)))
    if not out:
        raise ValueError("empty anchor list")
    if len(out) > MAX_ANCHORS:
        raise ValueError(f"{len(out)} anchors exceed MAX_ANCHORS={MAX_ANCHORS}")
    return out


@dataclass(frozen=True)
class Win:
    """Window relative to an anchor t: (t+start, t+end] when closed='right',
    [t+start, t+end) when closed='left'.  ``None`` bounds are infinite."""
    name: str
    start: dt.timedelta | None
    end: dt.timedelta | None


@dataclass(frozen=True)
class Agg:
    """Decomposable aggregate: kind in count, count_nonnull, sum, min, max, hll (a sketch of the distinct
    values), or moments, whose value is a struct (n, mean, m2) with m2 the sum of squared deviations from the mean."""
    name: str
    kind: str
    col: str | None = None


_ZERO_DEFAULT = ("count", "count_nonnull")


def _partial(a: Agg) -> Column:
    c = F.col(a.col) if a.col else None
    if a.kind == "count":
        return F.count(F.lit(1)).alias(a.name)
    if a.kind == "count_nonnull":
        return F.count(c).alias(a.name)
    if a.kind == "sum":
        return F.sum(c).alias(a.name)
    if a.kind == "moments":
        x = c.cast("double")
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"),
                        (F.var_pop(x) * F.count(x)).alias("m2")).alias(a.name)
    if a.kind == "min":
        return F.min(c).alias(a.name)
    if a.kind == "max":
        return F.max(c).alias(a.name)
    if a.kind == "hll":
        return F.hll_sketch_agg(c.cast("string"), HLL_BITS).alias(a.name)
    raise ValueError(f"unknown aggregate kind {a.kind}")


def _add_moments(x: Column, y: Column) -> Column:
    """Moments of two disjoint sets of values together (no squares of large values are subtracted)."""
    n = x["n"] + y["n"]
    d = y["mean"] - x["mean"]
    both = F.struct(n.alias("n"), (x["mean"] + d * y["n"] / n).alias("mean"),
                    (x["m2"] + y["m2"] + d * d * x["n"] * y["n"] / n).alias("m2"))
    return F.when(y["n"] == 0, x).when(x["n"] == 0, y).otherwise(both)


def _merge(a: Agg, c: Column) -> Column:
    if a.kind == "moments":  # one partial per slot at most, so the list is short
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        return F.aggregate(F.collect_list(c), zero, _add_moments)
    if a.kind in ("count", "count_nonnull", "sum"):
        return F.sum(c)
    if a.kind == "min":
        return F.min(c)
    if a.kind == "max":
        return F.max(c)
    if a.kind == "hll":
        return F.hll_union_agg(c)
    raise ValueError(a.kind)


def _base(events: DataFrame, keys: list[str], time_col: str, aggs: list[Agg]) -> DataFrame:
    cols = list(dict.fromkeys(keys + [time_col] + [a.col for a in aggs if a.col]))
    return events.select(*cols)


def window_aggregate(events: DataFrame, keys: list[str], time_col: str, anchors,
                     windows: list[Win], aggs: list[Agg], closed: str = "right") -> DataFrame:
    """Per (keys, anchor) the aggregates of events inside each named window.

    Output columns: keys, ``__a`` (anchor index), ``__timestamp``, and
    ``<window>__<agg>`` per window and aggregate.  Only (key, anchor) pairs with
    at least one event in some window appear (sparse); counts are 0, other
    aggregates null, for windows without events.
    """
    anchors = _check(anchors)
    m = len(anchors)
    a_us = [_us(a) for a in anchors]
    bounds = {}
    finite = set()
    for w in windows:
        lo = [None if w.start is None else u + _td_us(w.start) for u in a_us]
        hi = [None if w.end is None else u + _td_us(w.end) for u in a_us]
        bounds[w.name] = (lo, hi)
        finite.update(v for v in lo + hi if v is not None)
    cuts = sorted(finite)
    K = len(cuts)
    pos = {c: i for i, c in enumerate(cuts)}
    # elementary interval j in [0, K]; window (lo, hi] covers j in [pos(lo)+1, pos(hi)]
    jlo, jhi = {}, {}
    amin = [None] * (K + 1)
    amax = [None] * (K + 1)
    for w in windows:
        lo, hi = bounds[w.name]
        jl = [0 if v is None else pos[v] + 1 for v in lo]
        jh = [K if v is None else pos[v] for v in hi]
        jlo[w.name], jhi[w.name] = jl, jh
        # jl and jh grow with the anchor, so the anchors covering slot j form a
        # contiguous range: first i with jh[i] >= j .. last i with jl[i] <= j.
        for j in range(K + 1):
            first = bisect.bisect_left(jh, j)
            last = bisect.bisect_right(jl, j) - 1
            if first <= last:
                amin[j] = first if amin[j] is None else min(amin[j], first)
                amax[j] = last if amax[j] is None else max(amax[j], last)

    t = F.col(time_col)
    ev = _base(events, keys, time_col, aggs).where(t.isNotNull())
    # Global range of all windows: pushed down to the scan as a plain time filter.
    all_lo = [v for w in windows for v in bounds[w.name][0]]
    all_hi = [v for w in windows for v in bounds[w.name][1]]
    if all(v is not None for v in all_lo):
        lo_ts = _EPOCH + dt.timedelta(microseconds=min(all_lo))
        ev = ev.where(t > ts_lit(lo_ts) if closed == "right" else t >= ts_lit(lo_ts))
    if all(v is not None for v in all_hi):
        hi_ts = _EPOCH + dt.timedelta(microseconds=max(all_hi))
        ev = ev.where(t <= ts_lit(hi_ts) if closed == "right" else t < ts_lit(hi_ts))

    side = "left" if closed == "right" else "right"
    ev = ev.withColumn(SLOT, bisect_time(t, cuts, side))
    amin_arr, amax_arr = _int_array(amin), _int_array(amax)
    ev = ev.where(F.element_at(amin_arr, F.col(SLOT) + 1).isNotNull())

    partial = ev.groupBy(*keys, SLOT).agg(*[_partial(a) for a in aggs])
    j = F.col(SLOT)
    exploded = partial.withColumn(
        ANCHOR_IDX, F.explode(F.sequence(F.element_at(amin_arr, j + 1), F.element_at(amax_arr, j + 1))))
    a1 = F.col(ANCHOR_IDX) + 1
    member = {w.name: (j >= F.element_at(_int_array(jlo[w.name]), a1)) &
                      (j <= F.element_at(_int_array(jhi[w.name]), a1)) for w in windows}
    for w in windows:
        exploded = exploded.withColumn(f"__in_{w.name}", member[w.name])
    any_member = None
    for w in windows:
        c = F.col(f"__in_{w.name}")
        any_member = c if any_member is None else (any_member | c)
    exploded = exploded.where(any_member)

    merged = []
    for w in windows:
        for a in aggs:
            val = _merge(a, F.when(F.col(f"__in_{w.name}"), F.col(a.name)))
            if a.kind in _ZERO_DEFAULT:
                val = F.coalesce(val, F.lit(0)).cast("long")
            merged.append(val.alias(f"{w.name}__{a.name}"))
    final = exploded.groupBy(*keys, ANCHOR_IDX).agg(*merged)
    return final.select(*keys, ANCHOR_IDX, anchor_ts(F.col(ANCHOR_IDX), anchors).alias(TS),
                        *[f"{w.name}__{a.name}" for w in windows for a in aggs])


def first_anchor_index(time: Column, anchors: list, strict: bool = False) -> Column:
    """Index of the first anchor t with time <= t (strict=False) or time < t (strict=True)."""
    cuts = [_us(a) for a in anchors]
    return bisect_time(time, cuts, "right" if strict else "left")


def last_anchor_index(time: Column, span: dt.timedelta, anchors: list, strict: bool = False) -> Column:
    """Index of the last anchor t with time > t - span (strict: time >= t - span); -1 if none."""
    cuts = [_us(a) - _td_us(span) for a in anchors]
    return bisect_time(time, cuts, "right" if strict else "left") - 1


def cumulative_aggregate(events: DataFrame, keys: list[str], time_col: str, anchors,
                         aggs: list[Agg], strict: bool = False, carry: DataFrame | None = None,
                         near: list[str] | None = None) -> DataFrame:
    """Per (keys, anchor) aggregates over all events with time <= t (strict: < t).

    ``carry`` holds further columns of the first key (one row per key value); they are
    joined to the partials, never to the events, and become part of the output keys.
    With ``near``, some of these columns, the rows of equal values of them lie in one task.

    Dense from the key's first event on: one row per anchor at or after it.
    Plan: slot = first anchor covering the event; ``groupBy(key, slot)``
    partials; running merge over ``Window.partitionBy(key).orderBy(slot)``;
    each running row explodes to the anchors before the key's next slot.
    """
    anchors = _check(anchors)
    m = len(anchors)
    t = F.col(time_col)
    last = ts_lit(anchors[-1])
    ev = (_base(events, keys, time_col, aggs)
          .where(t.isNotNull() & ((t < last) if strict else (t <= last)))
          .withColumn(SLOT, first_anchor_index(t, anchors, strict)))
    partial = ev.groupBy(*keys, SLOT).agg(*[_partial(a) for a in aggs])
    if carry is not None:
        partial = partial.join(carry, keys[0])
        keys = keys + [c for c in carry.columns if c not in keys]
    if near:
        partial = partial.repartition(*near)
    return running_from_partials(partial, keys, anchors, aggs)


def range_aggregate(events: DataFrame, keys: list[str], first: Column, last: Column, anchors,
                    aggs: list[Agg]) -> DataFrame:
    """Per (keys, anchor) aggregates where each event counts at the anchors with index
    ``first`` .. ``last``.  Events are combined per (keys, first, last) before any shuffle."""
    anchors = _check(anchors)
    ev = events.withColumns({"__lo": first, "__hi": F.least(last, F.lit(len(anchors) - 1))})
    ev = ev.where(F.col("__lo") <= F.col("__hi"))
    partial = ev.groupBy(*keys, "__lo", "__hi").agg(*[_partial(a) for a in aggs])
    out = partial.withColumn(ANCHOR_IDX, F.explode(F.sequence("__lo", "__hi")))
    return out.groupBy(*keys, ANCHOR_IDX).agg(*[_merge(a, F.col(a.name)).alias(a.name) for a in aggs])


def running_from_partials(partial: DataFrame, keys: list[str], anchors, aggs: list[Agg]) -> DataFrame:
    """Finish a cumulative aggregate from per-(key, slot) partials (also used by the
    streaming maintainer, whose state holds exactly these partials)."""
    anchors = _check(anchors)
    m = len(anchors)
    w = Window.partitionBy(*keys).orderBy(SLOT)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moments = [a.name for a in aggs if a.kind == "moments"]
    if moments:  # deviations are taken from the mean of the key's first slot with values
        partial = partial.withColumns({
            f"__r_{c}": F.first(F.col(f"{c}.mean"), ignorenulls=True).over(run) for c in moments})

    def merged(a: Agg) -> Column:
        if a.kind != "moments":
            return _merge(a, F.col(a.name)).over(run).alias(a.name)
        p, r = F.col(a.name), F.col(f"__r_{a.name}")
        d = p["mean"] - r
        n, s1 = F.sum(p["n"]).over(run), F.sum(p["n"] * d).over(run)
        s2 = F.sum(p["m2"] + p["n"] * d * d).over(run)
        return F.struct(n.alias("n"), (r + s1 / n).alias("mean"), (s2 - s1 * s1 / n).alias("m2")).alias(a.name)

    running = partial.select(
        *keys, SLOT,
        *[merged(a) for a in aggs],
        F.lead(SLOT, 1, m).over(w).alias("__next"))
    out = running.withColumn(ANCHOR_IDX, F.explode(F.sequence(F.col(SLOT), F.col("__next") - 1)))
    return out.select(*keys, ANCHOR_IDX, anchor_ts(F.col(ANCHOR_IDX), anchors).alias(TS),
                      *[a.name for a in aggs])


def running_best(events: DataFrame, keys: list[str], value: str, time_col: str, anchors, strict: bool = False,
                 carry: DataFrame | None = None) -> DataFrame:
    """(keys, carry columns, ``__a``, ``__best``): per (keys, anchor) the most frequent ``value`` of the events so far, as a struct
    (c = minus its count, v = the value); the smallest value on ties.

    A value's count changes only in slots where it has events, so (key, value, slot) rows suffice: their running
    count is a candidate from that slot on, and the best candidate so far is the answer (counts never fall)."""
    anchors = _check(anchors)
    t = F.col(time_col)
    last = ts_lit(anchors[-1])
    ev = (events.select(*keys, value, time_col).where(t.isNotNull() & ((t < last) if strict else (t <= last)))
          .withColumn(SLOT, first_anchor_index(t, anchors, strict)))
    counts = ev.groupBy(*keys, value, SLOT).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*keys, value).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = counts.withColumn("__c", F.sum("__n").over(own))
    best = so_far.groupBy(*keys, SLOT).agg(F.min(F.struct((-F.col("__c")).alias("c"), F.col(value).alias("v"))).alias("__best"))
    if carry is not None:
        best = best.join(carry, keys[0])
        keys = keys + [c for c in carry.columns if c not in keys]
    return running_from_partials(best, keys, anchors, [Agg("__best", "min", "__best")])


def expand_created(df: DataFrame, time_col: str | None, anchors, strict: bool = False,
                   keep_index: bool = True) -> DataFrame:
    """Creation-based expansion: each row once per anchor t with time <= t
    (strict: < t); rows without a time column appear at every anchor.

    An explode of a computed index range -- no join against the anchors, no
    shuffle; output size equals the candidate count.
    """
    anchors = _check(anchors)
    m = len(anchors)
    if time_col is None:
        first = F.lit(0)
        base = df
    else:
        t = F.col(time_col)
        last = ts_lit(anchors[-1])
        base = df.where(t.isNotNull() & ((t < last) if strict else (t <= last)))
        first = first_anchor_index(t, anchors, strict)
    out = base.withColumn(ANCHOR_IDX, F.explode(F.sequence(first, F.lit(m - 1))))
    out = out.withColumn(TS, anchor_ts(F.col(ANCHOR_IDX), anchors))
    return out if keep_index else out.drop(ANCHOR_IDX)


def expand_to_anchors(df: DataFrame, time_col: str, anchors, window: Win,
                      closed: str = "right") -> DataFrame:
    """Each row once per anchor whose window contains the row's time (row level).

    Used for aggregates that do not decompose over slots (distinct counts,
    modes).  Anchor range per row = two binary searches, then an explode.
    """
    anchors = _check(anchors)
    m = len(anchors)
    t = F.col(time_col)
    a_us = [_us(a) for a in anchors]
    # closed right: t+start < x <= t+end  <=>  x - end <= t < x - start
    if window.end is None:
        lo_idx = F.lit(0)
    else:
        shifted = [u + _td_us(window.end) for u in a_us]  # t+end >= x  (right) / t+end > x (left)
        lo_idx = bisect_time(t, shifted, "left" if closed == "right" else "right")
    if window.start is None:
        hi_idx = F.lit(m - 1)
    else:
        shifted = [u + _td_us(window.start) for u in a_us]  # t+start < x (right) / t+start <= x (left)
        hi_idx = bisect_time(t, shifted, "left" if closed == "right" else "right") - 1
    base = df.where(t.isNotNull()).withColumn("__lo", lo_idx).withColumn("__hi", hi_idx)
    base = base.where(F.col("__lo") <= F.col("__hi"))
    out = base.withColumn(ANCHOR_IDX, F.explode(F.sequence(F.col("__lo"), F.col("__hi")))).drop("__lo", "__hi")
    return out.withColumn(TS, anchor_ts(F.col(ANCHOR_IDX), anchors))
