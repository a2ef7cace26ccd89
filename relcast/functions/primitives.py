"""Aggregation and transform primitives for feature synthesis.

Decomposable numeric primitives are produced from the partial sums the slot
plans keep per (key, slot): n (non-null count), s (sum), m (count, mean and sum of
squared deviations), mn, mx.  ``mode`` and distinct counts need value-level plans and live in
``operators.features``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans.history import Agg

NUMERIC_PRIMITIVES = ("sum", "mean", "min", "max", "std")
DEFAULT_AGG_PRIMITIVES = ("count", "sum", "mean", "min", "max", "std", "mode", "time_since_last")
DEFAULT_TRANS_PRIMITIVES = ("year", "month", "day", "dayofweek")
STACK_PRIMITIVES = ("sum", "mean", "min", "max")


def partials_for(col: str, prims) -> list[Agg]:
    """Partial aggregates needed to finish the numeric primitives over ``col``."""
    need = set()
    for p in prims:
        if p in ("sum",):
            need |= {"s"}
        elif p == "mean":
            need |= {"s", "n"}
        elif p == "std":
            need |= {"m"}
        elif p == "min":
            need |= {"mn"}
        elif p == "max":
            need |= {"mx"}
    kinds = {"n": "count_nonnull", "s": "sum", "m": "moments", "mn": "min", "mx": "max"}
    return [Agg(f"{col}__{k}", kinds[k], col) for k in ("n", "s", "m", "mn", "mx") if k in need]


def finish(col: str, prim: str) -> Column:
    """Final value of a numeric primitive from the merged partial columns."""
    n, s, m = F.col(f"`{col}__n`"), F.col(f"`{col}__s`"), F.col(f"`{col}__m`")
    if prim == "sum":
        return F.col(f"`{col}__s`")
    if prim == "mean":
        return F.when(n > 0, s / n)
    if prim == "std":
        return F.when(m["n"] > 1, F.sqrt(F.greatest(m["m2"] / (m["n"] - 1), F.lit(0.0))))
    if prim == "min":
        return F.col(f"`{col}__mn`")
    if prim == "max":
        return F.col(f"`{col}__mx`")
    raise ValueError(prim)


def stacked(prim: str, c: Column) -> Column:
    """Aggregate of an already computed per-row feature (depth >= 2)."""
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max,
            "std": F.stddev_samp, "count": F.count}[prim](c)
