"""Declared roles of tables and columns (driver-side metadata only).

A schema names, per table, its columns with a *semantic* dtype
(``primary_key``, ``foreign_key`` + ``link_to``, ``datetime``, ``float``,
``int``, ``category``, ``text``, ``array``) and an optional time column.  All
functions here touch metadata, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

PRIMARY_KEY = "primary_key"
FOREIGN_KEY = "foreign_key"
DATETIME = "datetime"
NUMERIC = ("float", "int", "integer")
CATEGORY = ("category", "bool", "boolean")
TEXT = ("text", "string")
ARRAY = "array"

# Reserved frame columns (fixed names of the label / prediction contract).
ID = "__id"
TARGET_ID = "__target_id"
TS = "__timestamp"
LABEL = "__label"
PRED = "__pred"
PROB = "__prob"
RESERVED = (ID, TARGET_ID, TS, LABEL, PRED, PROB, "__timestamp__", "__label__")


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    dtype: str
    link_to: str | None = None  # "table.column" for foreign keys

    @property
    def link(self) -> tuple[str, str] | None:
        if not self.link_to:
            return None
        table, column = self.link_to.split(".", 1)
        return table, column


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnSchema, ...]
    time_column: str | None = None

    def column(self, name: str) -> ColumnSchema:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name} has no column {name}")

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def primary_key(self) -> str | None:
        for c in self.columns:
            if c.dtype == PRIMARY_KEY:
                return c.name
        return None

    @property
    def foreign_keys(self) -> list[ColumnSchema]:
        return [c for c in self.columns if c.dtype == FOREIGN_KEY]

    def include_columns(self) -> list[str]:
        """Columns carried into candidate tables: all but FKs and the time column."""
        return [c.name for c in self.columns
                if c.dtype != FOREIGN_KEY and c.name != self.time_column]

    def exclusion_columns(self) -> set[str]:
        """Columns never used as model features: PK, FKs, time column, reserved."""
        out = {c.name for c in self.columns if c.dtype in (PRIMARY_KEY, FOREIGN_KEY)}
        if self.time_column:
            out.add(self.time_column)
        out.update(RESERVED)
        return out

    def with_columns(self, extra: list[ColumnSchema]) -> "TableSchema":
        return replace(self, columns=tuple(self.columns) + tuple(extra))


@dataclass(frozen=True)
class Relationship:
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str


@dataclass(frozen=True)
class RdbSchema:
    tables: tuple[TableSchema, ...] = field(default_factory=tuple)

    def table(self, name: str) -> TableSchema:
        for t in self.tables:
            if t.name == name:
                return t
        raise KeyError(f"unknown table {name}")

    @property
    def table_names(self) -> list[str]:
        return [t.name for t in self.tables]

    def relationships(self) -> list[Relationship]:
        out = []
        for t in self.tables:
            for c in t.foreign_keys:
                if c.link is None:
                    raise ValueError(f"{t.name}.{c.name} is a foreign key without link_to")
                pt, pc = c.link
                out.append(Relationship(t.name, c.name, pt, pc))
        return out

    def target_tables(self) -> list[str]:
        """Tables with a primary key, in schema order."""
        return [t.name for t in self.tables if t.primary_key]

    def strategies(self) -> dict[str, str]:
        """creation_based if the table has a time column; activity_based if another
        table with a time column references it; static otherwise."""
        rels = self.relationships()
        out = {}
        for name in self.target_tables():
            t = self.table(name)
            if t.time_column:
                out[name] = "creation_based"
                continue
            referenced = any(r.parent_table == name and r.child_table != name
                             and self.table(r.child_table).time_column
                             for r in rels)
            out[name] = "activity_based" if referenced else "static"
        return out

    def without_table(self, name: str) -> "RdbSchema":
        return RdbSchema(tuple(t for t in self.tables if t.name != name))

    def with_table(self, table: TableSchema) -> "RdbSchema":
        rest = [t for t in self.tables if t.name != table.name]
        return RdbSchema(tuple(rest) + (table,))


def primary_key(schema: TableSchema) -> str:
    pk = schema.primary_key
    if pk is None:
        raise ValueError(f"table {schema.name} has no primary key")
    return pk


def schema_from_dict(meta: dict) -> RdbSchema:
    """Build from the ``metadata.yaml`` layout: tables -> columns (name, dtype, link_to)."""
    tables = []
    for t in meta.get("tables", []):
        cols = tuple(ColumnSchema(c["name"], c["dtype"], c.get("link_to")) for c in t["columns"])
        tables.append(TableSchema(t["name"], cols, t.get("time_column")))
    return RdbSchema(tuple(tables))


def load_schema_yaml(path: str) -> RdbSchema:
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover - optional dependency
        raise RuntimeError("PyYAML is needed to read metadata.yaml") from exc
    with open(path) as fh:
        return schema_from_dict(yaml.safe_load(fh))


def schema_to_dict(schema: RdbSchema, tasks: list[dict] | None = None) -> dict:
    out = {"tables": []}
    for t in schema.tables:
        cols = []
        for c in t.columns:
            d = {"name": c.name, "dtype": c.dtype}
            if c.link_to:
                d["link_to"] = c.link_to
            cols.append(d)
        out["tables"].append({"name": t.name, "columns": cols, "time_column": t.time_column})
    if tasks is not None:
        out["tasks"] = tasks
    return out
