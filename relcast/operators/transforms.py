"""Table transforms RDB -> RDB (group F).

Each transform is a pure function over lazy frames; statistics that a
transform needs (means, standard deviations, per-column redundancy facts) come
from one aggregation pass whose single result row is read on the driver -- a
bounded result, never the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeparts import datetime_part
from ..sources import schema as S
from ..sources.rdb import Rdb


def _cols_of(schema: S.TableSchema, kinds) -> list[str]:
    return [c.name for c in schema.columns if c.dtype in kinds]


def canonicalize_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """columns to double; unparsable text becomes NULL (``try_cast``, ANSI-safe)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def canonicalize_datetime(df: DataFrame, cols: list[str], fmt: str | None = None) -> DataFrame:
    """columns to ``timestamp_ntz``; unparsable text becomes NULL."""
    out = {}
    for c in cols:
        t = df.schema[c].dataType.simpleString()
        if t.startswith("timestamp") or t == "date":
            out[c] = F.col(c).cast("timestamp_ntz")
        else:
            parsed = F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)) if fmt else \
                F.try_to_timestamp(F.col(c).cast("string"))
            out[c] = parsed.cast("timestamp_ntz")
    return df.withColumns(out)


def featurize_datetime(df: DataFrame, cols: list[str], methods=("year", "month", "day")) -> DataFrame:
    """add ``<col>_<part>`` columns (Monday = 0 for dayofweek); originals kept."""
    return df.withColumns({f"{c}_{m}": datetime_part(F.col(c), m) for c in cols for m in methods})


def normalization_stats(frames: list[DataFrame], cols: list[str]) -> dict[str, tuple]:
    """(mean, sample std) per column over the union of ``frames`` (one pass)."""
    u = reduce(DataFrame.unionByName, [f.select(*cols) for f in frames])
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m__{c}"), F.stddev_samp(c).alias(f"s__{c}")]
    row = u.agg(*aggs).first()
    return {c: (row[f"m__{c}"], row[f"s__{c}"]) for c in cols}


def normalize_numeric(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    """z-score with given (mean, std) or statistics of ``df``; std 0 / NULL -> NULL."""
    stats = stats or normalization_stats([df], cols)
    out = {}
    for c in cols:
        m, s = stats[c]
        if m is None or s is None or s == 0:
            out[c] = F.lit(None).cast("double")
        else:
            out[c] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def redundant_columns(df: DataFrame, text_cols: list[str] = (), keep: list[str] = ()) -> list[str]:
    """F6 rule: all-NULL columns, constant columns, and text columns distinct on every
    row.  One aggregation pass (exact distinct counts for the text columns only)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"nn__{f.name}"))
        if f.dataType.typeName() in ("array", "map", "struct"):
            continue
        aggs.append(F.min(c).alias(f"mn__{f.name}"))
        aggs.append(F.max(c).alias(f"mx__{f.name}"))
        if f.name in text_cols:
            aggs.append(F.count_distinct(c).alias(f"nd__{f.name}"))
    r = df.agg(*aggs).first()
    n = r["__n"]
    drop = []
    for f in df.schema.fields:
        if f.name in keep:
            continue
        nn = r[f"nn__{f.name}"]
        if nn == 0:
            drop.append(f.name)
            continue
        if f.dataType.typeName() not in ("array", "map", "struct"):
            if nn == n and r[f"mn__{f.name}"] == r[f"mx__{f.name}"]:
                drop.append(f.name)
                continue
            if f.name in text_cols and r[f"nd__{f.name}"] == n and n > 1:
                drop.append(f.name)
    return drop


def drop_redundant(df: DataFrame, text_cols: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """drop the columns found by ``redundant_columns``."""
    return df.drop(*redundant_columns(df, text_cols, keep))


def dummy_tables(schema: S.RdbSchema) -> list[str]:
    """tables with nothing but key columns that link at most one other table
    (they add no values and are not on a path between two tables)."""
    out = []
    rels = schema.relationships()
    for t in schema.tables:
        if any(c.dtype not in (S.PRIMARY_KEY, S.FOREIGN_KEY) for c in t.columns):
            continue
        neighbours = {r.parent_table for r in rels if r.child_table == t.name} | \
                     {r.child_table for r in rels if r.parent_table == t.name}
        if len(neighbours - {t.name}) <= 1:
            out.append(t.name)
    return out


def handle_dummy_tables(rdb: Rdb) -> Rdb:
    """remove dummy tables from the RDB and its schema."""
    drop = set(dummy_tables(rdb.schema))
    schema = S.RdbSchema(tuple(t for t in rdb.schema.tables if t.name not in drop))
    return Rdb(rdb.spark, {k: v for k, v in rdb.tables.items() if k not in drop}, schema)


@dataclass(frozen=True)
class ColumnTransform:
    """``applies_to(table_schema, column_schema)`` selects columns; ``fn(col)``
    returns new columns by suffix; the original is dropped if ``replaces_original``."""
    applies_to: Callable[[S.TableSchema, S.ColumnSchema], bool]
    fn: Callable[[Column], dict]
    replaces_original: bool = False

    def __call__(self, rdb: Rdb) -> Rdb:
        tables = {}
        schema_tables = []
        for t in rdb.schema.tables:
            df = rdb.tables.get(t.name)
            cols = list(t.columns)
            if df is not None:
                for c in t.columns:
                    if not self.applies_to(t, c):
                        continue
                    new = self.fn(F.col(c.name))
                    df = df.withColumns({f"{c.name}{suffix}": v for suffix, v in new.items()})
                    cols += [S.ColumnSchema(f"{c.name}{suffix}", "float") for suffix in new]
                    if self.replaces_original:
                        df = df.drop(c.name)
                        cols = [x for x in cols if x.name != c.name]
                tables[t.name] = df
            schema_tables.append(S.TableSchema(t.name, tuple(cols), t.time_column))
        return Rdb(rdb.spark, {**rdb.tables, **tables}, S.RdbSchema(tuple(schema_tables)))


@dataclass(frozen=True)
class TableTransform:
    """user function ``(df, table_schema) -> df`` applied to every (or listed) table."""
    fn: Callable[[DataFrame, S.TableSchema], DataFrame]
    tables: tuple | None = None

    def __call__(self, rdb: Rdb) -> Rdb:
        new = {t.name: rdb[t.name].transform(lambda d, t=t: self.fn(d, t))
               for t in rdb.schema.tables if t.name in rdb.tables and (self.tables is None or t.name in self.tables)}
        return rdb.with_tables(new)


@dataclass(frozen=True)
class Pipeline:
    """F8: transforms applied in order; the result is still one lazy plan per table."""
    steps: tuple = field(default_factory=tuple)

    def __call__(self, rdb: Rdb) -> Rdb:
        return reduce(lambda acc, step: step(acc), self.steps, rdb)


def canonicalize_rdb(rdb: Rdb) -> Rdb:
    """F1 + F2 over every declared float / datetime column."""
    new = {}
    for t in rdb.schema.tables:
        if t.name not in rdb.tables:
            continue
        df = canonicalize_numeric(rdb[t.name], [c for c in _cols_of(t, ("float",)) if c in rdb[t.name].columns])
        df = canonicalize_datetime(df, [c for c in _cols_of(t, (S.DATETIME,)) if c in df.columns])
        new[t.name] = df
    return rdb.with_tables(new)


def normalize_amounts(suffix: str = "_log") -> ColumnTransform:
    """example user column transform -- signed log1p of float columns."""
    return ColumnTransform(
        applies_to=lambda t, c: c.dtype == "float",
        fn=lambda col: {suffix: F.signum(col) * F.log1p(F.abs(col))})
