"""Relational database value object, scans and sinks (group A).

``Rdb`` holds lazy DataFrames (one per table) plus the declared schema.  Nothing
is materialised here; scans are ``spark.read.parquet`` so column pruning and
filter pushdown reach the files.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType

from . import schema as S


@dataclass(frozen=True)
class Rdb:
    spark: SparkSession
    tables: dict = field(default_factory=dict)
    schema: S.RdbSchema = field(default_factory=S.RdbSchema)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def table_names(self) -> list[str]:
        return list(self.tables)

    def with_tables(self, replacements: dict, schema: S.RdbSchema | None = None) -> "Rdb":
        """New Rdb with some tables replaced (frames are immutable anyway)."""
        tables = dict(self.tables)
        tables.update(replacements)
        return Rdb(self.spark, tables, schema or self.schema)

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose each table to ``spark.sql`` under its name."""
        names = []
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def sql(self, query: str) -> DataFrame:
        """Ad-hoc SQL over the registered tables."""
        self.register_views()
        return self.spark.sql(query)


def _table_path(folder: str, name: str) -> str:
    for ext in (".parquet", ".pqt"):
        p = os.path.join(folder, name + ext)
        if os.path.exists(p):
            return p
    return os.path.join(folder, name)


def load_rdb(spark: SparkSession, folder: str, schema: S.RdbSchema | None = None,
             tables: list[str] | None = None) -> Rdb:
    """A2: every ``<table>.parquet`` / ``<table>.pqt`` in ``folder`` becomes a table.

    With a schema, only declared tables are loaded and only declared columns are
    selected (column pruning reaches the scan).
    """
    if schema is None and os.path.exists(os.path.join(folder, "metadata.yaml")):
        schema = S.load_schema_yaml(os.path.join(folder, "metadata.yaml"))
    names = tables or (schema.table_names if schema and schema.tables else sorted(
        os.path.splitext(f)[0] for f in os.listdir(folder)
        if f.endswith((".parquet", ".pqt"))))
    out = {}
    for name in names:
        df = spark.read.parquet(_table_path(folder, name))
        if schema is not None and name in schema.table_names:
            df = df.select(*schema.table(name).column_names)
        out[name] = df
    return Rdb(spark, out, schema or S.RdbSchema())


def read_snapshots(spark: SparkSession, store: str, target: str, ts_col: str = S.TS) -> DataFrame:
    """A3: all feature snapshots of one target table (Parquet feature store; the
    partition column is read back as timestamp_ntz)."""
    df = spark.read.parquet(os.path.join(store, target))
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp_ntz")) if ts_col in df.columns else df


def read_labels_csv(spark: SparkSession, path: str, id_type: str = "bigint",
                    label_type: str = "double") -> DataFrame:
    """A4: CSV ``[__id, __timestamp, __label]`` with the timestamp parsed (NTZ)."""
    df = spark.read.option("header", True).csv(path)
    missing = {S.ID, S.TS, S.LABEL} - set(df.columns)
    if missing:
        raise ValueError(f"label file lacks columns {sorted(missing)}")
    return df.select(F.expr(f"try_cast(`{S.ID}` AS {id_type})").alias(S.ID),
                     F.to_timestamp_ntz(F.col(S.TS)).alias(S.TS),
                     F.expr(f"try_cast(`{S.LABEL}` AS {label_type})").alias(S.LABEL))


def read_entity_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A5: a file with exactly one column of ids, cast to the key type."""
    df = spark.read.option("header", True).csv(path)
    if len(df.columns) != 1:
        raise ValueError(f"entity id file must have exactly one column, got {df.columns}")
    # try_cast: a text id for a numeric key becomes NULL (it can match no entity)
    return df.select(F.expr(f"try_cast(`{df.columns[0]}` AS {id_type})").alias(S.ID))


def write_task_tables(train: DataFrame, folder: str, table: str, mode: str = "overwrite") -> dict:
    """``<table>-template/train`` plus empty ``validation`` and ``test`` of the same schema."""
    base = os.path.join(folder, f"{table}-template")
    paths = {}
    for split, df in (("train", train), ("validation", train.limit(0)), ("test", train.limit(0))):
        p = os.path.join(base, split)
        df.write.mode(mode).parquet(p)
        paths[split] = p
    return paths


def write_sorted(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> str:
    """A table whose files, in order of their names, hold the rows in order of ``by`` (nulls first).

    Rows are range-partitioned and sorted inside each file, so no task sorts the whole table."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).parquet(path)
    return path


def read_sorted(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A table of ``write_sorted`` with each row's place in the whole order, from 0: the rows of the files before its own
    (one count per file) and its row in the file."""
    df = spark.read.parquet(path)
    at = df.metadataColumn("_metadata")
    rows = df.select(*df.columns, at["file_name"].alias("__file"), at["row_index"].alias("__row"))
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    files = files.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(files, "__file").select(*df.columns, (F.col("__before") + F.col("__row")).alias(position))


def write_predictions(pred: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Prediction sink (CSV with header, or Parquet)."""
    w = pred.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def copy_tables(rdb: Rdb, folder: str, mode: str = "overwrite") -> list[str]:
    """Entity tables copied unchanged."""
    out = []
    for name, df in rdb.tables.items():
        p = os.path.join(folder, name)
        df.write.mode(mode).parquet(p)
        out.append(p)
    return out


def write_splits(tasks: dict, folder: str, mode: str = "overwrite") -> dict:
    """Per task and split write one Parquet target table ({task: {split: df}})."""
    out = {}
    for task, splits in tasks.items():
        for split, df in splits.items():
            p = os.path.join(folder, task, split)
            df.write.mode(mode).parquet(p)
            out[(task, split)] = p
    return out


def with_row_index(df: DataFrame, name: str = "__row_id", stable_cols: list[str] | None = None) -> DataFrame:
    """Synthetic key for tables without a PK.  With ``stable_cols`` the key is a
    reproducible composite string; otherwise ``monotonically_increasing_id``."""
    if stable_cols:
        return df.withColumn(name, F.concat_ws("-", *[F.col(c).cast("string") for c in stable_cols]))
    return df.withColumn(name, F.monotonically_increasing_id())


def include_projection(rdb: Rdb, table: str) -> DataFrame:
    """All columns but FKs and the time column."""
    return rdb.table(table).select(*rdb.schema.table(table).include_columns())


def drop_excluded(df: DataFrame, table_schema: S.TableSchema, extra: list[str] = ()) -> DataFrame:
    """Drop PK, FKs, time column and reserved columns (the non-features)."""
    excluded = table_schema.exclusion_columns() | set(extra)
    return df.drop(*[c for c in df.columns if c in excluded])


def table_profile(rdb: Rdb) -> DataFrame:
    """Per table and column: rows, non-null count, approx distinct, min, max (as text).

    One aggregation pass per table; results are stacked into one long frame.
    """
    parts = []
    for name, df in rdb.tables.items():
        cols = [f for f in df.schema.fields]
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for f in cols:
            c = F.col(f"`{f.name}`")
            aggs.append(F.count(c).alias(f"nn__{f.name}"))
            simple = f.dataType.typeName() not in ("array", "map", "struct", "binary")
            if simple:
                aggs.append(F.approx_count_distinct(c).alias(f"nd__{f.name}"))
                aggs.append(F.min(c).cast("string").alias(f"mn__{f.name}"))
                aggs.append(F.max(c).cast("string").alias(f"mx__{f.name}"))
        wide = df.agg(*aggs)
        rows = []
        for f in cols:
            simple = f.dataType.typeName() not in ("array", "map", "struct", "binary")
            rows.append(F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"nn__{f.name}").alias("non_null"),
                (F.col(f"nd__{f.name}") if simple else F.lit(None).cast("long")).alias("approx_distinct"),
                (F.col(f"mn__{f.name}") if simple else F.lit(None).cast("string")).alias("min_value"),
                (F.col(f"mx__{f.name}") if simple else F.lit(None).cast("string")).alias("max_value"),
            ))
        parts.append(wide.select(F.lit(name).alias("table_name"), F.col("__rows").alias("n_rows"),
                                 F.explode(F.array(*rows)).alias("c")).select("table_name", "n_rows", "c.*"))
    return reduce(DataFrame.unionByName, parts)


def table_sample_text(df: DataFrame, n: int = 3, width: int = 30) -> DataFrame:
    """A15 (sample part): first ``n`` rows rendered as text cut to ``width`` chars."""
    return df.limit(n).select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c)
                                for c in df.columns])


def key_integrity(rdb: Rdb) -> DataFrame:
    """Per PK: rows, nulls, duplicates; per FK edge: rows, nulls, dangling.

    The dangling count is a left-anti join child -> parent on the key (a shuffle
    on the key; AQE broadcasts the parent when its runtime size is small).
    """
    parts = []
    for t in rdb.schema.tables:
        if t.name not in rdb.tables:
            continue
        df = rdb.tables[t.name]
        pk = t.primary_key
        if pk:
            k = F.col(pk)
            parts.append(df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.sum(F.when(k.isNull(), 1).otherwise(0)).cast("long").alias("n_null"),
                (F.count(k) - F.countDistinct(k)).cast("long").alias("n_bad"))
                .select(F.lit(t.name).alias("table_name"), F.lit(pk).alias("column_name"),
                        F.lit("primary_key").alias("check_kind"), F.lit(None).cast("string").alias("references"),
                        "n_rows", "n_null", "n_bad"))
    for r in rdb.schema.relationships():
        child = rdb.tables[r.child_table].select(F.col(r.child_column).alias("__k"))
        parent = rdb.tables[r.parent_table].select(F.col(r.parent_column).alias("__k")).distinct()
        dangling = child.where(F.col("__k").isNotNull()).join(parent, "__k", "left_anti")
        # Two one-row aggregates stacked and summed (no join needed to combine them).
        stats = child.select(F.lit(1).alias("r"), F.when(F.col("__k").isNull(), 1).otherwise(0).alias("nl"),
                             F.lit(0).alias("bd"))
        bad = dangling.select(F.lit(0).alias("r"), F.lit(0).alias("nl"), F.lit(1).alias("bd"))
        parts.append(stats.unionByName(bad).agg(
            F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("n_rows"),
            F.coalesce(F.sum("nl"), F.lit(0)).cast("long").alias("n_null"),
            F.coalesce(F.sum("bd"), F.lit(0)).cast("long").alias("n_bad")).select(
            F.lit(r.child_table).alias("table_name"), F.lit(r.child_column).alias("column_name"),
            F.lit("foreign_key").alias("check_kind"),
            F.lit(f"{r.parent_table}.{r.parent_column}").alias("references"),
            "n_rows", "n_null", "n_bad"))
    return reduce(DataFrame.unionByName, parts)


def cast_ids(df: DataFrame, col: str, key_type) -> DataFrame:
    """Cast an id column to the key type (string ids for bigint keys become null)."""
    t = key_type.simpleString() if hasattr(key_type, "simpleString") else str(key_type)
    return df.withColumn(col, F.expr(f"try_cast(`{col}` AS {t})"))


ID_TYPES = {"bigint": LongType(), "string": StringType()}


def write_snapshots(features: DataFrame, store: str, target: str, mode: str = "overwrite",
                    ts_col: str = S.TS) -> str:
    """Feature snapshots of one target written to the feature store (one
    folder per target, partitioned by snapshot time so B3 / E5 read only what they need)."""
    path = os.path.join(store, target)
    features.write.mode(mode).partitionBy(ts_col).parquet(path)
    return path
