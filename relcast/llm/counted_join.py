"""Joins to a table whose count column tells how many rows each key will meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1024


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, ``count`` the number of its rows in ``rows``).

    Keys that hold more than 1 / HOT_KEYS of all rows are joined by broadcast: there are fewer than HOT_KEYS of
    them, whatever the data.  All other keys are small, so the shuffle by key is even."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) * HOT_KEYS > total
    few = groups.where(frequent)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(groups.where(~frequent), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)
