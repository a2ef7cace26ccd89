"""Time helpers: NTZ literals, datetime parts, epoch conversions.

Day of week follows the Monday=0 convention everywhere (``F.weekday``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def to_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime().replace(tzinfo=None)
    return dt.datetime.fromisoformat(str(value))


def ts_lit(value) -> Column:
    """A timestamp_ntz literal (constant-folded by Catalyst)."""
    d = to_datetime(value)
    return F.expr(f"TIMESTAMP_NTZ '{d.isoformat(sep=' ')}'")


def ts_sql(value) -> str:
    """Plain SQL timestamp literal for oracle queries."""
    return f"TIMESTAMP '{to_datetime(value).isoformat(sep=' ')}'"


def as_ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def days(n: float) -> dt.timedelta:
    return dt.timedelta(days=n)


def interval_lit(delta: dt.timedelta) -> Column:
    micros = int(round(delta.total_seconds() * 1_000_000))
    return F.expr(f"make_dt_interval(0, 0, 0, {micros / 1_000_000:.6f})")


def epoch_micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def epoch_nanos(col: Column) -> Column:
    return epoch_micros(col) * F.lit(1000)


DATETIME_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "dayofweek": F.weekday,  # Monday = 0
}


def datetime_part(col: Column, part: str) -> Column:
    try:
        return DATETIME_PARTS[part](col)
    except KeyError:
        raise ValueError(f"unknown datetime part {part!r}; known {sorted(DATETIME_PARTS)}")
