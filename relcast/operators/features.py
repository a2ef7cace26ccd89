"""Deep feature synthesis, backward-looking and point-in-time correct (group G).

Specs are enumerated on the driver (``enumerate_features``) by walking the
foreign-key graph from the target table; computation (``compute_features``)
turns the spec list into a handful of DataFrame plans:

* one fused slot aggregate per (child table, FK) edge computes every count /
  sum / mean / min / max / std / time-since-last / where-count of that edge in
  a single ``groupBy(key, slot)`` + running window (``plans.history``);
* ``mode`` uses the same plan keyed by (key, value) and a ``min_by`` pick;
* a value taken from a parent of the child row counts from the later of the
  child's and that parent's own time on (a line can be older than its order);
* stacked features (depth >= 2) evaluate the child's own features at the
  *target's* anchors, keyed by (child key, anchor), then aggregate them per
  (parent key, anchor) -- the cutoff is applied at every level;
* direct features are equi-joins to parent tables.

All blocks are keyed by (key, anchor index) and left-joined to the target
frame, so targets without history get count 0 and NULL elsewhere.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import primitives as P
from ..functions.timeparts import datetime_part, epoch_nanos
from ..plans.asof import CUT, attach_prefix, hot_keys, prefix_aggregate, windowed_aggregate
from ..plans.history import (ANCHOR_IDX, TS, Agg, Win, anchor_array, anchor_ts, cumulative_aggregate, expand_created,
                             first_anchor_index, last_anchor_index, range_aggregate, running_best, time_micros, window_aggregate)
from ..session import join_where_they_lie, materialize
from ..sources import schema as S
from ..sources.rdb import Rdb


PIECE = "__piece"
PIECE_ROWS = 100_000  # children of one parent that are aggregated in one task


@dataclass(frozen=True)
class DfsConfig:
    max_depth: int = 2
    agg_primitives: tuple = P.DEFAULT_AGG_PRIMITIVES
    stack_primitives: tuple = P.STACK_PRIMITIVES
    trans_primitives: tuple = ()
    where_primitives: tuple = ("count",)
    interesting_values: dict = field(default_factory=dict)   # {"table.column": [values]}
    include_entities: tuple | None = None
    ignore_entities: tuple = ()
    ignore_columns: dict = field(default_factory=dict)        # {table: [columns]}
    max_features: int | None = None
    use_cutoff_time: bool = True
    closed: str = "left"                                      # child time < cutoff
    lookback: dt.timedelta | None = None
    datetime_primitives: tuple = ()                           # min / max of the children's datetime columns
    array_primitives: tuple = ()                              # mean / max / min, element by element, of array columns
    direct_aggregates: bool = False                           # a parent's own aggregates as direct features
    # Distinct counts by mergeable sketches (about 1.6 % standard error) instead of exactly;
    # every other primitive is exact and decomposable anyway
    use_approximate_aggregations: bool = False

    def merged(self, overrides: dict | None) -> "DfsConfig":
        """Per-query overrides (``dfs_depth`` maps to ``max_depth``); unknown keys raise."""
        if not overrides:
            return self
        ov = dict(overrides)
        if "dfs_depth" in ov:
            ov["max_depth"] = ov.pop("dfs_depth")
        unknown = set(ov) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown DFS config keys {sorted(unknown)}")
        return replace(self, **ov)


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str                  # agg | where | mode | unique | tsl | array | stacked | direct | parent
    table: str                 # table whose rows the feature describes
    child: str | None = None
    fk: str | None = None
    column: str | None = None  # base column (in child rows, may be "parent.col")
    primitive: str | None = None
    inner: "FeatureSpec | None" = None
    where: tuple | None = None
    depth: int = 1


def _numeric(t: S.TableSchema, ignore) -> list[str]:
    return [c.name for c in t.columns if c.dtype in S.NUMERIC and c.name not in ignore]


def _datetimes(t: S.TableSchema, ignore) -> list[str]:
    return [c.name for c in t.columns if c.dtype == S.DATETIME and c.name not in ignore]


def _categorical(t: S.TableSchema, ignore) -> list[str]:
    return [c.name for c in t.columns if c.dtype in S.CATEGORY and c.name not in ignore]


def _edge_label(schema: S.RdbSchema, child: str, fk: str, parent: str) -> str:
    n = sum(1 for r in schema.relationships() if r.child_table == child and r.parent_table == parent)
    return child if n == 1 else f"{child}[{fk}]"


def _parent_label(t: S.TableSchema, fk) -> str:
    """Parent table name, with the FK column where several FKs of ``t`` lead to that table."""
    parent = fk.link[0]
    return parent if sum(1 for f in t.foreign_keys if f.link[0] == parent) == 1 else f"{parent}[{fk.name}]"


def _allowed(cfg: DfsConfig, table: str) -> bool:
    if table in cfg.ignore_entities:
        return False
    return cfg.include_entities is None or table in cfg.include_entities


def row_columns(schema: S.RdbSchema, table: str, depth: int, cfg: DfsConfig,
                came_from: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical row-level columns of ``table``: its own plus, while
    depth allows, its parents' (as ``parent.col``), never walking back to ``came_from``."""
    t = schema.table(table)
    ign = set(cfg.ignore_columns.get(table, []))
    nums, cats = _numeric(t, ign), _categorical(t, ign)
    if depth > 1:
        for fkcol in t.foreign_keys:
            pt, _pc = fkcol.link
            if pt == came_from or pt == table or not _allowed(cfg, pt):
                continue
            pn, pcats = row_columns(schema, pt, depth - 1, cfg, came_from=table)
            label = _parent_label(t, fkcol)
            nums += [f"{label}.{c}" for c in pn]
            cats += [f"{label}.{c}" for c in pcats]
    return nums, cats


def enumerate_features(schema: S.RdbSchema, target: str, cfg: DfsConfig,
                       came_from: str | None = None, depth: int | None = None) -> list[FeatureSpec]:
    """G1: feature definitions for ``target`` down to ``max_depth`` (nothing computed).

    Rules: never re-enter the table we came from (G14), keys and the time
    column are not features (G13), one array primitive per chain (G15),
    allow/deny lists (G7) and a deterministic cap (G8: breadth-first order).
    """
    depth = cfg.max_depth if depth is None else depth
    specs: list[FeatureSpec] = []
    if depth < 1:
        return specs
    for r in schema.relationships():
        if r.parent_table != target or r.child_table == came_from or not _allowed(cfg, r.child_table):
            continue
        if r.child_table == target:
            continue  # self-references only as direct features
        child = schema.table(r.child_table)
        lab = _edge_label(schema, r.child_table, r.child_column, target)
        nums, cats = row_columns(schema, r.child_table, depth, cfg, came_from=target)
        prims = cfg.agg_primitives
        if "count" in prims:
            specs.append(FeatureSpec(f"COUNT({lab})", "agg", target, r.child_table, r.child_column,
                                     None, "count", depth=1))
        for c in nums:
            for p in P.NUMERIC_PRIMITIVES:
                if p in prims:
                    specs.append(FeatureSpec(f"{p.upper()}({lab}.{c})", "agg", target, r.child_table,
                                             r.child_column, c, p, depth=1 + c.count(".")))
        for c in _datetimes(child, set(cfg.ignore_columns.get(r.child_table, []))):
            for p in cfg.datetime_primitives:
                specs.append(FeatureSpec(f"{p.upper()}({lab}.{c})", "agg", target, r.child_table, r.child_column, c, p, depth=1))
        if "mode" in prims:
            for c in cats:
                specs.append(FeatureSpec(f"MODE({lab}.{c})", "mode", target, r.child_table, r.child_column,
                                         c, "mode", depth=1 + c.count(".")))
        if "num_unique" in prims:
            for c in cats:
                specs.append(FeatureSpec(f"NUM_UNIQUE({lab}.{c})", "unique", target, r.child_table, r.child_column,
                                         c, "num_unique", depth=1 + c.count(".")))
        for c in child.columns:
            if c.dtype == S.ARRAY and c.name not in cfg.ignore_columns.get(r.child_table, []):
                for p in cfg.array_primitives:
                    specs.append(FeatureSpec(f"ARRAY{p.upper()}({lab}.{c.name})", "array", target, r.child_table, r.child_column, c.name, p, depth=1))
        if "time_since_last" in prims and child.time_column:
            specs.append(FeatureSpec(f"TIME_SINCE_LAST({lab})", "tsl", target, r.child_table, r.child_column,
                                     child.time_column, "time_since_last", depth=1))
        for key, values in cfg.interesting_values.items():
            tname, col = key.split(".", 1)
            if tname != r.child_table:
                continue
            for v in values:
                for p in cfg.where_primitives:
                    for c in [None] if p == "count" else _numeric(child, set(cfg.ignore_columns.get(r.child_table, []))):
                        of = lab if c is None else f"{lab}.{c}"
                        specs.append(FeatureSpec(f"{p.upper()}({of} WHERE {col} = {v})", "where", target, r.child_table,
                                                 r.child_column, c, p, where=(col, v), depth=1))
        if depth >= 2:
            inner = enumerate_features(schema, r.child_table, cfg, came_from=target, depth=depth - 1)
            for f in inner:
                if f.kind not in ("agg", "where", "tsl", "stacked"):
                    continue
                for p in cfg.stack_primitives:
                    specs.append(FeatureSpec(f"{p.upper()}({lab}.{f.name})", "stacked", target,
                                             r.child_table, r.child_column, None, p, inner=f,
                                             depth=1 + f.depth))
    t = schema.table(target)
    for fkcol in t.foreign_keys:
        pt, _pc = fkcol.link
        if pt == came_from or not _allowed(cfg, pt):
            continue
        pn, pc = row_columns(schema, pt, depth, cfg, came_from=target)
        for c in pn + pc:
            specs.append(FeatureSpec(f"{_parent_label(t, fkcol)}.{c}", "direct", target, pt, fkcol.name, c, None, depth=1 + c.count(".")))
        if cfg.direct_aggregates and came_from is None and depth >= 2:
            for f in enumerate_features(schema, pt, replace(cfg, max_features=None, direct_aggregates=False), depth=depth - 1):
                if f.kind != "direct":
                    specs.append(FeatureSpec(f"{_parent_label(t, fkcol)}.{f.name}", "parent", target, pt, fkcol.name, None, f.primitive, inner=f, depth=1 + f.depth))
    if came_from is None and cfg.max_features is not None:
        specs = sorted(specs, key=lambda s: (s.depth, s.name))[: cfg.max_features]
    return specs


# ---------------------------------------------------------------- computation

def _rows_with_parents(rdb: Rdb, table: str, cols: list[str], extra: list[str]) -> DataFrame:
    """Rows of ``table`` with the requested columns; ``parent.col`` names are
    resolved by equi-joins on the FK (recursively for deeper chains).  For each parent
    chain with a time column, ``__vt:<chain>`` is the latest time along it (NULL where
    one is missing): its values are known after that time only."""
    t = rdb.schema.table(table)
    own = [c for c in cols if "." not in c]
    needed = list(dict.fromkeys(extra + own))
    df = rdb[table]
    by_parent: dict[str, list[str]] = {}
    for c in cols:
        if "." in c:
            p, rest = c.split(".", 1)
            by_parent.setdefault(p, []).append(rest)
    out = df.select(*[F.col(c) for c in dict.fromkeys(needed + [f.name for f in t.foreign_keys])])
    for p, rest in by_parent.items():
        fk = next(f for f in t.foreign_keys if _parent_label(t, f) == p)
        ptab = rdb.schema.table(fk.link[0])
        pk, ptime = ptab.primary_key, ptab.time_column
        prow = _rows_with_parents(rdb, ptab.name, rest, [pk] + ([ptime] if ptime else []))
        own_time = [F.col(f"`{ptime}`").cast("timestamp_ntz")] if ptime else []
        times = [_latest(own_time).alias(f"__vt:{p}")] if ptime else []
        for chain in sorted({_chain(r) for r in rest} - {""}):
            known = own_time + [F.col(f"`{c}`") for c in prow.columns if c == f"__vt:{chain}"]
            if known:
                times.append(_latest(known).alias(f"__vt:{p}.{chain}"))
        key = f"__pk_{p}"
        prow = prow.select(F.col(pk).alias(key), *[F.col(f"`{r}`").alias(f"{p}.{r}") for r in rest], *times)
        out = out.join(prow, out[fk.name] == prow[f"`{key}`"], "left").drop(key)
    return out


def _chain(column: str | None) -> str:
    """``a.b`` of the column name ``a.b.c``; empty for a column of the row itself."""
    return column.rpartition(".")[0] if column else ""


def _latest(times: list):
    """The latest of the times; NULL when one is NULL."""
    known = reduce(lambda a, b: a & b, [t.isNotNull() for t in times])
    return F.when(known, F.greatest(*times) if len(times) > 1 else times[0])


def _source_chain(s: FeatureSpec) -> str:
    """The parent chain that a feature's value or condition comes from; empty for the child row itself."""
    return _chain(s.where[0] if s.kind == "where" else None if s.kind == "tsl" else s.column)


def _child_rows(rdb: Rdb, cfg: DfsConfig, child: str, fk: str, cols: list[str],
                chain: str) -> tuple[DataFrame, str | None, str | None]:
    """Child rows with ``cols`` (all of one parent chain), the column holding the time
    they become visible, and the child's own time column when that is another one."""
    tcol = rdb.schema.table(child).time_column
    rows = _rows_with_parents(rdb, child, cols, [fk] + ([tcol] if tcol else []))
    vt = f"__vt:{chain}"
    if not chain or vt not in rows.columns or not cfg.use_cutoff_time:
        return rows, tcol, None
    own = [F.col(f"`{tcol}`").cast("timestamp_ntz")] if tcol else []
    return rows.withColumn("__vis", _latest(own + [F.col(f"`{vt}`")])), "__vis", tcol


def _history(cfg: DfsConfig, events: DataFrame, keys: list[str], time_col: str | None, anchors,
             aggs: list[Agg], carry: DataFrame | None = None, own_time: str | None = None) -> DataFrame:
    """(keys, carry columns, __a) aggregates of child rows visible at each anchor.

    ``carry`` (columns that depend on the first key only) is joined after the rows are
    combined per key and slot, so a hot key is never joined row by row.  ``own_time`` is
    the child's time where ``time_col`` is a later one: a lookback window is about it."""
    strict = cfg.closed == "left"
    names = [a.name for a in aggs]
    if time_col is None or not cfg.use_cutoff_time:
        static = events.groupBy(*keys).agg(*[_static(a) for a in aggs])
        df = expand_created(static, None, anchors)
    elif cfg.lookback is not None and own_time is not None:
        df = range_aggregate(events.where(F.col(time_col).isNotNull()), keys,
                             first_anchor_index(F.col(time_col), anchors, strict),
                             last_anchor_index(F.col(own_time), cfg.lookback, anchors, strict), anchors, aggs)
    elif cfg.lookback is not None:
        win = Win("w", -cfg.lookback, dt.timedelta(0))
        df = window_aggregate(events, keys, time_col, anchors, [win], aggs, closed=cfg.closed)
        df = df.select(*keys, ANCHOR_IDX, *[F.col(f"w__{n}").alias(n) for n in names])
    else:
        df = cumulative_aggregate(events, keys, time_col, anchors, aggs, strict=strict, carry=carry, near=_near(keys, carry))
        return df.select(*_with_carry(keys, carry), ANCHOR_IDX, *names)
    if carry is not None:
        df = df.join(carry, keys[0])
    return df.select(*_with_carry(keys, carry), ANCHOR_IDX, *names)


def _near(keys: list[str], carry: DataFrame | None) -> list[str] | None:
    """The carried columns by which rows are to lie in one task: the parent key and, if it is cut, the piece of it."""
    return [c for c in carry.columns if c not in keys and c != "__cidx"] if carry is not None else None


def _at_anchors(block: DataFrame) -> DataFrame:
    """A frame with a row per key and anchor, as the side of a join that is not broadcast: the planner takes its size for that
    of the tables it is read from, before they are multiplied by the anchors."""
    return block.hint("merge")


def _with_carry(keys: list[str], carry: DataFrame | None) -> list[str]:
    return keys + ([c for c in carry.columns if c not in keys] if carry is not None else [])


def _static(a: Agg):
    from ..plans.history import _partial
    return _partial(a)


@dataclass(frozen=True)
class _EdgePlan:
    """What one (child, fk) edge and parent chain needs, whichever engine aggregates it."""
    rows: DataFrame
    time_col: str | None
    own_time: str | None
    aggs: list[Agg]
    specs: list[FeatureSpec]
    safe: dict
    wheres: dict

    def features(self, cut) -> list:
        """Feature columns from the merged aggregates; ``cut`` is the cutoff in epoch microseconds."""
        out = []
        for s in self.specs:
            if s.kind == "agg" and s.primitive == "count":
                out.append(F.col("__cnt").alias(s.name))
            elif s.kind == "agg":
                out.append(P.finish(self.safe[s.column], s.primitive).alias(s.name))
            elif s.kind == "where":
                out.append(F.col(self.wheres[s.name]).alias(s.name) if s.primitive == "count"
                           else P.finish(self.wheres[s.name], s.primitive).alias(s.name))
            elif s.kind == "tsl":
                out.append(((cut - F.col("__tmax")) / F.lit(1e6)).alias(s.name))
        return out


def _edge_plan(rdb: Rdb, cfg: DfsConfig, specs: list[FeatureSpec], key_alias: str) -> _EdgePlan:
    s0 = specs[0]
    cols = sorted({s.column for s in specs if s.kind == "agg" and s.column})
    wcols = sorted({c for s in specs if s.kind == "where" for c in (s.where[0], s.column) if c})
    rows, time_col, own_time = _child_rows(rdb, cfg, s0.child, s0.fk, sorted(set(cols) | set(wcols)), _source_chain(s0))
    safe = {c: f"__c{i}" for i, c in enumerate(cols)}
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{c}`").alias(n) for c, n in safe.items()])
    aggs = [Agg("__cnt", "count")]
    for c in cols:
        prims = [s.primitive for s in specs if s.kind == "agg" and s.column == c]
        aggs += [Agg(a.name, a.kind, a.col) for a in P.partials_for(safe[c], prims)]
    wheres: dict = {}
    for i, (key, ss) in enumerate(_by(specs, lambda s: (s.where, s.column) if s.kind == "where" else None).items()):
        (wc, wv), column = key
        name = f"__where{i}"
        value = F.lit(1) if column is None else F.col(f"`{column}`")
        rows = rows.withColumn(name, F.when(F.col(f"`{wc}`") == F.lit(wv), value))
        if column is None:
            aggs.append(Agg(name, "count_nonnull", name))
        else:
            aggs += P.partials_for(name, [s.primitive for s in ss])
        wheres.update({s.name: name for s in ss})
    if any(s.kind == "tsl" for s in specs):
        rows = rows.withColumn("__tmax", time_micros(F.col(time_col)))
        aggs.append(Agg("__tmax", "max", "__tmax"))
    return _EdgePlan(rows.withColumnRenamed(s0.fk, key_alias), time_col, own_time, aggs, specs, safe, wheres)


def _by(items: list, key) -> dict:
    """Items grouped by a key that is not None, in order of appearance."""
    out: dict = {}
    for x in items:
        if key(x) is not None:
            out.setdefault(key(x), []).append(x)
    return out


def _edge_block(rdb: Rdb, cfg: DfsConfig, specs: list[FeatureSpec], anchors, key_alias: str,
                carry: DataFrame | None = None) -> DataFrame:
    """All agg / where / tsl features of one (child, fk) edge and parent chain in one slot aggregate."""
    plan = _edge_plan(rdb, cfg, specs, key_alias)
    hist = _history(cfg, plan.rows, [key_alias], plan.time_col, anchors, plan.aggs, carry, plan.own_time)
    cut = time_micros(anchor_ts(F.col(ANCHOR_IDX), sorted(set(anchors))))
    return hist.select(*[F.col(k) for k in _with_carry([key_alias], carry)], ANCHOR_IDX, *plan.features(cut))


def _mode_rows(rdb: Rdb, cfg: DfsConfig, spec: FeatureSpec, key_alias: str) -> tuple[DataFrame, str | None, str | None]:
    """Child rows (key, ``__v``) of a MODE feature, the time they become visible, and their own time if another."""
    rows, time_col, own_time = _child_rows(rdb, cfg, spec.child, spec.fk, [spec.column], _chain(spec.column))
    rows = rows.select(F.col(spec.fk).alias(key_alias), F.col(f"`{spec.column}`").alias("__v"),
                       *[F.col(c) for c in (time_col, own_time) if c]).where(F.col("__v").isNotNull())
    return rows, time_col, own_time


def _mode_block(rdb: Rdb, cfg: DfsConfig, spec: FeatureSpec, anchors, key_alias: str,
                carry: DataFrame | None = None) -> DataFrame:
    """MODE: the most frequent value per (key, anchor), smallest value on ties.

    Counts only grow, so the best pair (count, value) among the (key, value, slot) rows seen so far is the mode:
    a running minimum over at most one row per (key, slot), and no value is carried to anchors it has no event at.
    A look-back window loses events again, so there the counts of each value are taken per anchor."""
    rows, time_col, own_time = _mode_rows(rdb, cfg, spec, key_alias)
    keys = _with_carry([key_alias], carry)
    if cfg.use_cutoff_time and time_col is not None and cfg.lookback is None:
        best = running_best(rows, [key_alias], "__v", time_col, sorted(set(anchors)), strict=cfg.closed == "left", carry=carry)
        return best.select(*keys, ANCHOR_IDX, F.col("__best.v").alias(spec.name))
    hist = _history(cfg, rows, [key_alias, "__v"], time_col, anchors, [Agg("__c", "count")], carry, own_time)
    return hist.groupBy(*keys, ANCHOR_IDX).agg(
        F.min_by(F.col("__v"), F.struct(-F.col("__c"), F.col("__v"))).alias(spec.name))


def _unique_block(rdb: Rdb, cfg: DfsConfig, spec: FeatureSpec, anchors, key_alias: str) -> DataFrame:
    """NUM_UNIQUE: distinct values per (key, anchor).

    Exact over all history: a value counts from its first event on, so first events are counted; in a look-back
    window each value is looked at per anchor.  With approximate aggregates one sketch per (key, slot) is merged."""
    rows, time_col, own_time = _mode_rows(rdb, cfg, spec, key_alias)
    if cfg.use_approximate_aggregations:
        hist = _history(cfg, rows, [key_alias], time_col, anchors, [Agg("__u", "hll", "__v")], own_time=own_time)
        value = F.coalesce(F.hll_sketch_estimate("__u"), F.lit(0))
    elif cfg.use_cutoff_time and time_col is not None and cfg.lookback is None:
        first = rows.groupBy(key_alias, "__v").agg(F.min(time_col).alias(time_col))
        hist = _history(cfg, first, [key_alias], time_col, anchors, [Agg("__u", "count")])
        value = F.col("__u")
    else:
        hist = _history(cfg, rows, [key_alias, "__v"], time_col, anchors, [Agg("__c", "count")], own_time=own_time).where("__c > 0")
        hist = hist.groupBy(key_alias, ANCHOR_IDX).agg(F.count(F.lit(1)).alias("__u"))
        value = F.col("__u")
    return hist.select(key_alias, ANCHOR_IDX, value.alias(spec.name))


def array_chain(spec: FeatureSpec) -> int:
    """Number of array aggregations along a feature's chain."""
    return (spec.kind == "array") + (array_chain(spec.inner) if spec.inner is not None else 0)


def drop_nested_arrays(specs: list[FeatureSpec]) -> list[FeatureSpec]:
    """Without the features that aggregate an aggregated array again."""
    return [s for s in specs if array_chain(s) + (s.kind == "stacked" and s.inner is not None and s.inner.kind == "array") < 2]


def _array_rows(rdb: Rdb, cfg: DfsConfig, specs: list[FeatureSpec], key_alias: str) -> tuple[DataFrame, str | None, str | None, list[Agg]]:
    """One row per element (key, ``__pos``, ``__x``) of the child's arrays, and the partial aggregates they need."""
    s0 = specs[0]
    rows, time_col, own_time = _child_rows(rdb, cfg, s0.child, s0.fk, [s0.column], "")
    rows = rows.select(F.col(s0.fk).alias(key_alias), *[F.col(c) for c in (time_col, own_time) if c],
                       F.posexplode(f"`{s0.column}`").alias("__pos", "__x"))
    return rows.withColumn("__x", F.col("__x").cast("double")), time_col, own_time, P.partials_for("__x", [s.primitive for s in specs])


def _packed_arrays(hist: DataFrame, specs: list[FeatureSpec], keys: list[str]) -> DataFrame:
    """Arrays rebuilt in order of position from one row per (keys, position)."""
    entry = F.struct("__pos", *[P.finish("__x", s.primitive).cast("double").alias(f"a{i}") for i, s in enumerate(specs)])
    packed = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__arr"))  # as many entries as the arrays have
    value = lambda i: lambda e: e[f"a{i}"]
    return packed.select(*keys, *[F.transform("__arr", value(i)).alias(s.name) for i, s in enumerate(specs)])


def _array_block(rdb: Rdb, cfg: DfsConfig, specs: list[FeatureSpec], anchors, key_alias: str) -> DataFrame:
    """G3j: element-wise aggregates of an array column; each position is an accumulator of its own in the slot plan."""
    rows, time_col, own_time, aggs = _array_rows(rdb, cfg, specs, key_alias)
    hist = _history(cfg, rows, [key_alias, "__pos"], time_col, anchors, aggs, own_time=own_time)
    return _packed_arrays(hist, specs, [key_alias, ANCHOR_IDX])


def _fill_counts(df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    fills = {s.name: F.coalesce(F.col(f"`{s.name}`"), F.lit(0)) for s in specs
             if s.kind == "unique" or s.kind in ("agg", "where") and s.primitive == "count"}
    return df.withColumns(fills) if fills else df


def _entity_blocks(rdb: Rdb, cfg: DfsConfig, table: str, specs: list[FeatureSpec], anchors,
                   key_alias: str, carry: DataFrame | None = None) -> list[tuple[DataFrame, list[FeatureSpec]]]:
    """(key_alias, [carry columns], __a) frames which together hold every backward feature in ``specs``."""
    blocks = []
    edges: dict[tuple, list[FeatureSpec]] = {}
    for s in specs:
        if s.kind in ("agg", "where", "tsl"):
            edges.setdefault((s.child, s.fk, _source_chain(s)), []).append(s)
    for _, es in edges.items():
        blocks.append((_edge_block(rdb, cfg, es, anchors, key_alias, carry), es))
    for s in specs:
        if s.kind == "mode":
            blocks.append((_mode_block(rdb, cfg, s, anchors, key_alias, carry), [s]))
    for s in specs:
        if s.kind == "unique":
            block = _unique_block(rdb, cfg, s, anchors, key_alias)
            blocks.append((block if carry is None else _at_anchors(block).join(carry, key_alias), [s]))
    for ss in _by(specs, lambda s: (s.child, s.fk, s.column) if s.kind == "array" else None).values():
        block = _array_block(rdb, cfg, ss, anchors, key_alias)
        blocks.append((block if carry is None else _at_anchors(block).join(carry, key_alias), ss))
    stacked: dict[tuple, list[FeatureSpec]] = {}
    for s in specs:
        if s.kind == "stacked":
            stacked.setdefault((s.child, s.fk), []).append(s)
    for (child, fk), ss in stacked.items():
        b = _stacked_block(rdb, cfg, child, fk, ss, anchors, key_alias)
        if carry is not None:
            b = _at_anchors(b).join(carry, key_alias)
        blocks.append((b, ss))
    return blocks


def _entity_features(rdb: Rdb, cfg: DfsConfig, table: str, specs: list[FeatureSpec], anchors,
                     key_alias: str, carry: DataFrame | None = None) -> DataFrame | None:
    """(key_alias, [carry columns], __a) frame with every backward feature in ``specs``."""
    blocks = _entity_blocks(rdb, cfg, table, specs, anchors, key_alias, carry)
    if not blocks:
        return None
    keys = [key_alias] + ([c for c in carry.columns if c != key_alias] if carry is not None else []) + [ANCHOR_IDX]
    frames = [b for b, _ in blocks]
    out = reduce(lambda a, b: a.join(b, keys, "full"), frames)
    return _fill_counts(out, [s for _, ss in blocks for s in ss])


def _countlike(s: FeatureSpec) -> bool:
    return s.kind in ("agg", "where") and s.primitive == "count"


def _pieces(children: DataFrame, parent: str, child: str) -> DataFrame:
    """Adds ``PIECE``: 0, and for a parent with more than ``PIECE_ROWS`` children the piece that the child's hash gives,
    so that no parent, however many children it has, becomes one task's burden.  Such parents are few: rows / PIECE_ROWS."""
    hot = children.groupBy(F.col(parent).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PIECE_ROWS)
    out = children.join(F.broadcast(hot), F.col(parent) == F.col("__hot"), "left")
    piece = F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64(child), F.ceil(F.col("__n") / PIECE_ROWS))).otherwise(0).cast("int")
    return out.withColumn(PIECE, piece).drop("__hot", "__n")


def _apart(children: DataFrame, parent: str, child: str, several: bool) -> DataFrame | None:
    """Parents that one task cannot do alone: those with more than ``PIECE_ROWS`` children and, where the children have
    ``several`` edges, those of a child whose key repeats; None where there are none."""
    out = children.groupBy(parent).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PIECE_ROWS).select(parent)
    if several:
        copies = F.count(F.lit(1)).over(Window.partitionBy(child))
        again = children.where(F.col(child).isNotNull()).withColumn("__copies", copies).where("__copies > 1")
        out = out.unionByName(again.select(parent)).distinct()
    out = materialize(out)
    return None if out.isEmpty() else out


def _child_features(rdb: Rdb, cfg: DfsConfig, child: str, inner: list[FeatureSpec], anchors, key_alias: str, carry: DataFrame) -> DataFrame:
    """The children's own features side by side, a row per child, anchor and edge, of the children in ``carry``: rows of a
    child whose key repeats do meet, each row of one edge with each of another."""
    again = None
    if len({(f.kind, f.child, f.fk, _source_chain(f)) for f in inner}) > 1:
        copies = carry.where(F.col("__ck").isNotNull()).withColumn("__copies", F.count(F.lit(1)).over(Window.partitionBy("__ck")))
        carry, again = copies.where("__copies = 1").drop("__copies"), copies.where("__copies > 1").drop("__copies")
    blocks = _entity_blocks(rdb, cfg, child, inner, anchors, "__ck", carry)
    if again is not None:
        blocks.append((_entity_features(rdb, cfg, child, inner, anchors, "__ck", again), inner))
    blocks = [_fill_counts(b, ss).where(F.col(ANCHOR_IDX) >= F.col("__cidx"))
              .select(key_alias, ANCHOR_IDX, *[F.col(f"`{s.name}`") for s in ss]) for b, ss in blocks]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)


def _per_parent(rows: DataFrame, key_alias: str, specs: list[tuple[int, FeatureSpec]]) -> DataFrame:
    """What the stacked features are made of, per parent and anchor."""
    aggs = []
    for i, s in specs:
        c = F.col(f"`{s.inner.name}`").cast("double") if _countlike(s.inner) else F.col(f"`{s.inner.name}`")
        if _countlike(s.inner):
            aggs += [F.sum(c).alias(f"__s{i}"), F.count(c).alias(f"__k{i}")]
            # only what the primitive is made of
            aggs += [(F.var_pop(c) * F.count(c)).alias(f"__q{i}")] if s.primitive == "std" else []
            aggs += [F.max(c).alias(f"__mx{i}")] if s.primitive == "max" else []
            aggs += [F.min(c).alias(f"__mn{i}")] if s.primitive == "min" else []
        else:
            aggs.append(P.stacked(s.primitive, c).alias(s.name))
    return rows.groupBy(key_alias, ANCHOR_IDX).agg(*aggs)


def _stacked_block(rdb: Rdb, cfg: DfsConfig, child: str, fk: str, specs: list[FeatureSpec], anchors,
                   key_alias: str) -> DataFrame:
    """Aggregate the child's own features, evaluated at each anchor, per parent key.

    The child's rows carry their parent key and creation slot into the inner
    aggregation, so inner feature rows already know their parent; children
    created but without rows of their own (count features = 0) are accounted for
    from a cumulative count of created children -- no (child x anchor) join.

    Only the changes of a child's features are shuffled, to its parent's task: a row per child and anchor exists
    between the running window and the aggregate of one task alone, and a row per parent and anchor is not moved either
    (it meets the other frames of the parent where it is made).  Features of different edges need not meet per child,
    so their rows are aggregated apart.  The few parents that need more (``_apart``) are dealt out in pieces."""
    child_t = rdb.schema.table(child)
    tcol = child_t.time_column
    if not (cfg.use_cutoff_time and tcol and cfg.lookback is None):
        return _stacked_block_join(rdb, cfg, child, fk, specs, anchors, key_alias)
    anchors = sorted(set(anchors))
    strict = cfg.closed == "left"
    cpk = child_t.primary_key
    inner = list({s.inner.name: s.inner for s in specs}.values())
    children = (rdb[child].where(F.col(tcol).isNotNull() & F.col(fk).isNotNull())
                .select(F.col(cpk).alias("__ck"), F.col(fk).alias(key_alias), first_anchor_index(F.col(tcol), anchors, strict).alias("__cidx")))
    apart = _apart(children, key_alias, "__ck", len({(f.kind, f.child, f.fk, _source_chain(f)) for f in inner}) > 1)
    whole = children if apart is None else children.join(apart, key_alias, "left_anti")
    frames = []  # (frame, its specs)
    for b, ss in _entity_blocks(rdb, cfg, child, inner, anchors, "__ck", whole):
        names = {s.name for s in ss}
        own = [(i, s) for i, s in enumerate(specs) if s.inner.name in names]
        frames.append((_per_parent(_fill_counts(b, ss).where(F.col(ANCHOR_IDX) >= F.col("__cidx")), key_alias, own), own))
    if apart is not None:
        rest = _pieces(children.join(apart, key_alias, "left_semi"), key_alias, "__ck")
        own = list(enumerate(specs))
        frames.append((_per_parent(_child_features(rdb, cfg, child, inner, anchors, key_alias, rest), key_alias, own), own))
    created = cumulative_aggregate(rdb[child].select(F.col(fk).alias(key_alias), tcol), [key_alias], tcol,
                                   anchors, [Agg("__nc", "count")], strict=strict)
    out, values = created.select(key_alias, ANCHOR_IDX, "__nc"), {}
    for k, (frame, own) in enumerate(frames):
        had = [c for c in frame.columns if c not in (key_alias, ANCHOR_IDX)]
        frame = frame.select(key_alias, ANCHOR_IDX, *[F.col(f"`{c}`").alias(f"__f{k}{c}") for c in had])
        out = out.join(_at_anchors(frame), [key_alias, ANCHOR_IDX], "left")
        for c in had:  # a parent has its values in one frame
            values.setdefault(c, []).append(F.col(f"`__f{k}{c}`"))
    out = out.select(key_alias, ANCHOR_IDX, "__nc", *[F.coalesce(*v).alias(c) for c, v in values.items()])
    nc = F.col("__nc")
    cols = [F.col(key_alias), F.col(ANCHOR_IDX)]
    for i, s in enumerate(specs):
        if not _countlike(s.inner):
            cols.append(F.col(f"`{s.name}`"))
            continue
        part = lambda c, i=i: F.col(f"{c}{i}") if f"{c}{i}" in values else F.lit(None).cast("double")
        sm, sq = F.coalesce(F.col(f"__s{i}"), F.lit(0.0)), F.coalesce(part("__q"), F.lit(0.0))
        mx, mn = part("__mx"), part("__mn")
        k = F.coalesce(F.col(f"__k{i}"), F.lit(0))
        missing = nc - k
        v = {"sum": sm, "mean": sm / nc,
             "max": F.when(missing > 0, F.greatest(F.coalesce(mx, F.lit(0.0)), F.lit(0.0))).otherwise(mx),
             "min": F.when(missing > 0, F.lit(0.0)).otherwise(mn),
             # squared deviations of the k children with rows and of the nc - k that count 0, taken together
             "std": F.when(nc > 1, F.sqrt((sq + F.when(k > 0, sm * sm / k * (nc - k) / nc).otherwise(0.0)) / (nc - 1))),
             "count": nc}[s.primitive]
        if s.primitive in ("sum", "max", "min"):
            v = v.cast(rdb_count_type())
        cols.append(v.alias(s.name))
    return out.select(*cols)


def rdb_count_type() -> str:
    """Stacked sum / min / max of counts stay integral (as summing counts would)."""
    return "long"


def _stacked_block_join(rdb: Rdb, cfg: DfsConfig, child: str, fk: str, specs: list[FeatureSpec], anchors,
                        key_alias: str) -> DataFrame:
    """General form (children without time column, lookback windows, no cutoff):
    child rows visible at each anchor left-joined to the child's features."""
    child_t = rdb.schema.table(child)
    cpk = child_t.primary_key
    inner = list({s.inner.name: s.inner for s in specs}.values())
    inner_df = _entity_features(rdb, cfg, child, inner, anchors, "__ck")
    # child rows visible at each anchor (cutoff applied to the child itself too)
    base = rdb[child].select(F.col(cpk).alias("__ck"), F.col(fk).alias(key_alias),
                             *([F.col(child_t.time_column)] if child_t.time_column else []))
    tcol = child_t.time_column if cfg.use_cutoff_time else None
    if tcol is not None and cfg.lookback is None:
        cand = expand_created(base, tcol, anchors, strict=(cfg.closed == "left"))
    elif tcol is not None:
        cand = expand_created(base, tcol, anchors, strict=(cfg.closed == "left"))
        lo = anchor_ts(F.col(ANCHOR_IDX), sorted(set(anchors))) - F.lit(cfg.lookback)
        cand = cand.where(F.col(tcol) >= lo if cfg.closed == "left" else F.col(tcol) > lo)
    else:
        cand = expand_created(base, None, anchors)
    cand = cand.select("__ck", key_alias, ANCHOR_IDX)
    joined = cand.join(_at_anchors(inner_df), ["__ck", ANCHOR_IDX], "left")
    joined = _fill_counts(joined, inner)
    aggs = [P.stacked(s.primitive, F.col(f"`{s.inner.name}`")).alias(s.name) for s in specs]
    return joined.groupBy(key_alias, ANCHOR_IDX).agg(*aggs)


def _direct_block(rdb: Rdb, cfg: DfsConfig, table: str, specs: list[FeatureSpec],
                  id_col: str) -> tuple[DataFrame, dict]:
    """Parent columns through the target table's FKs, keyed by the target id only
    (they do not depend on the cutoff).  For parents with a time column the latest
    time along the chain to each value is carried along as ``__pt<i>_<j>`` so the caller
    can mask values not yet known at a row's cutoff.  Returns (frame, {feature: time column})."""
    t = rdb.schema.table(table)
    pk = t.primary_key
    fks = sorted({s.fk for s in specs})
    out = rdb[table].select(F.col(pk).alias(id_col), *fks)
    masks: dict = {}
    for i, fk in enumerate(fks):
        ss = [s for s in specs if s.fk == fk]
        parent = ss[0].child
        ptab = rdb.schema.table(parent)
        ppk = ptab.primary_key
        extra = [ptab.time_column] if ptab.time_column and cfg.use_cutoff_time else []
        prow = _rows_with_parents(rdb, parent, [s.column for s in ss], [ppk] + extra)
        sel = [F.col(ppk).alias("__pk")]
        own = [F.col(extra[0]).cast("timestamp_ntz")] if extra else []
        for j, chain in enumerate(sorted({_chain(s.column) for s in ss})):
            known = own + [F.col(f"`{c}`") for c in prow.columns if cfg.use_cutoff_time and c == f"__vt:{chain}"]
            if known:
                sel.append(_latest(known).alias(f"__pt{i}_{j}"))
                masks.update({s.name: f"__pt{i}_{j}" for s in ss if _chain(s.column) == chain})
        sel += [F.col(f"`{s.column}`").alias(s.name) for s in ss]
        prow = prow.select(*sel)
        out = out.join(prow, out[fk] == prow["__pk"], "left").drop("__pk")
    return out.drop(*fks), masks


def _row_history(cfg: DfsConfig, cuts: DataFrame, rows: DataFrame, key: str, time_col: str | None, own_time: str | None,
                 aggs: list[Agg]) -> DataFrame:
    """(key, ``CUT``, aggregates) of the child rows visible at each of the (key, cutoff) pairs in ``cuts``."""
    names = [a.name for a in aggs]
    if time_col is None or not cfg.use_cutoff_time:
        return cuts.join(rows.groupBy(key).agg(*[_static(a) for a in aggs]), key)
    inclusive = cfg.closed != "left"
    if cfg.lookback is None:
        return prefix_aggregate(cuts, rows, [key], CUT, time_col, aggs, inclusive=inclusive)
    if own_time is None:
        return windowed_aggregate(cuts, rows, [key], CUT, time_col, aggs, cfg.lookback, cfg.closed)
    # visible by one time, in the window by another: rows meet the cutoffs of their own and the next bucket of the window's length
    span = int(cfg.lookback.total_seconds() * 1_000_000)
    bucket = lambda c: F.expr(f"{c} div {span}")
    of = cuts.withColumn("__ct", time_micros(F.col(CUT))).withColumn("__bk", F.explode(F.array(bucket("__ct"), bucket("__ct") - 1)))
    ev = rows.withColumns({"__vt": time_micros(F.col(time_col)), "__ot": time_micros(F.col(own_time))}).withColumn("__bk", bucket("__ot"))
    seen = F.col("__vt") <= F.col("__ct") if inclusive else F.col("__vt") < F.col("__ct")
    since = F.col("__ot") > F.col("__ct") - span if inclusive else F.col("__ot") >= F.col("__ct") - span
    return of.join(ev, [key, "__bk"]).where(seen & since).groupBy(key, CUT).agg(*[_static(a) for a in aggs]).select(key, CUT, *names)


def _row_features(rdb: Rdb, cfg: DfsConfig, table: str, specs: list[FeatureSpec], target: DataFrame, key: str, probe: bool = True) -> DataFrame:
    """The rows of ``target`` (key, ``CUT`` and any other columns) with every backward feature in ``specs``."""
    at_once = cfg.use_cutoff_time and cfg.lookback is None  # rows of the target meet those of the child in one pass, nothing is joined back
    out, cuts = target, _cuts(target, key)
    if not at_once or any(s.kind in ("unique", "array") for s in specs):
        cuts = materialize(cuts)  # read again by every block
    inclusive = cfg.closed != "left"
    for es in _by(specs, lambda s: (s.child, s.fk, _source_chain(s)) if s.kind in ("agg", "where", "tsl") else None).values():
        plan = _edge_plan(rdb, cfg, es, key)
        if at_once and plan.time_col is not None:
            had = [F.col(f"`{c}`") for c in out.columns]
            out = attach_prefix(out, plan.rows, [key], CUT, plan.time_col, plan.aggs, inclusive, probe=probe)
            out = out.select(*had, *plan.features(time_micros(F.col(CUT))))
            continue
        hist = _row_history(cfg, cuts, plan.rows, key, plan.time_col, plan.own_time, plan.aggs)
        out = out.join(hist.select(key, CUT, *plan.features(time_micros(F.col(CUT)))), [key, CUT], "left")
    for s in (s for s in specs if s.kind == "mode"):
        rows, time_col, own_time = _mode_rows(rdb, cfg, s, key)
        if at_once and time_col is not None:
            # each value's count from its own events' cutoffs on; the best (count, value) so far is the mode
            own = rows.select(key, "__v", F.col(time_col).alias(CUT)).distinct()
            counts = prefix_aggregate(own, rows, [key, "__v"], CUT, time_col, [Agg("__c", "count")], inclusive=True)
            best = counts.select(key, CUT, F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v")).alias("__best"))
            out = attach_prefix(out, best.withColumnRenamed(CUT, "__since"), [key], CUT, "__since", [Agg("__best", "min", "__best")], inclusive, probe=probe)
            out = out.withColumn(s.name, F.col("__best.v")).drop("__best")
            continue
        else:
            values = cuts.join(rows.select(key, "__v").distinct(), key)
            part = values.select(F.struct(key, "__v").alias("__kv"), CUT)
            ev = rows.withColumn("__kv", F.struct(F.col(key), F.col("__v"))).drop(key)
            hist = _row_history(cfg, part, ev, "__kv", time_col, own_time, [Agg("__c", "count")]).where(F.col("__c") > 0)
            hist = hist.groupBy(F.col(f"__kv.{key}").alias(key), CUT).agg(
                F.min_by(F.col("__kv.__v"), F.struct(-F.col("__c"), F.col("__kv.__v"))).alias(s.name))
        out = out.join(hist, [key, CUT], "left")
    for s in (s for s in specs if s.kind == "unique"):
        rows, time_col, own_time = _mode_rows(rdb, cfg, s, key)
        if cfg.use_approximate_aggregations:
            hist = _row_history(cfg, cuts, rows, key, time_col, own_time, [Agg("__u", "hll", "__v")])
            hist = hist.withColumn("__u", F.coalesce(F.hll_sketch_estimate("__u"), F.lit(0)))
        elif time_col is not None and cfg.use_cutoff_time and cfg.lookback is None:
            first = rows.groupBy(key, "__v").agg(F.min(time_col).alias(time_col))
            hist = _row_history(cfg, cuts, first, key, time_col, None, [Agg("__u", "count")])
        else:
            part = cuts.join(rows.select(key, "__v").distinct(), key).select(F.struct(key, "__v").alias("__kv"), CUT)
            ev = rows.withColumn("__kv", F.struct(F.col(key), F.col("__v"))).drop(key)
            hist = _row_history(cfg, part, ev, "__kv", time_col, own_time, [Agg("__c", "count")]).where(F.col("__c") > 0)
            hist = hist.groupBy(F.col(f"__kv.{key}").alias(key), CUT).agg(F.count(F.lit(1)).alias("__u"))
        out = out.join(hist.select(key, CUT, F.col("__u").alias(s.name)), [key, CUT], "left")
    for ss in _by(specs, lambda s: (s.child, s.fk, s.column) if s.kind == "array" else None).values():
        rows, time_col, own_time, aggs = _array_rows(rdb, cfg, ss, key)
        ev = rows.withColumn("__kp", F.struct(F.col(key), F.col("__pos"))).drop(key, "__pos")
        part = cuts.join(rows.select(key, "__pos").distinct(), key).select(F.struct(key, "__pos").alias("__kp"), CUT)
        hist = _row_history(cfg, part, ev, "__kp", time_col, own_time, [Agg("__any", "count"), *aggs]).where("__any > 0")
        hist = hist.select(F.col(f"__kp.{key}").alias(key), F.col("__kp.__pos").alias("__pos"), CUT, *[a.name for a in aggs])
        out = out.join(_packed_arrays(hist, ss, [key, CUT]), [key, CUT], "left")
    for (child, fk), ss in _by(specs, lambda s: (s.child, s.fk) if s.kind == "stacked" else None).items():
        ct = rdb.schema.table(child)
        tcol = ct.time_column if cfg.use_cutoff_time else None
        rows = rdb[child].select(F.col(ct.primary_key).alias("__ck"), F.col(fk).alias(key), *([F.col(tcol).alias("__born")] if tcol else []))
        own = cuts.join(rows, key)  # every child that a target row has by its cutoff: what a stacked feature is made of
        if tcol:
            born, cut = F.col("__born").cast("timestamp_ntz"), F.col(CUT)
            own = own.where(born < cut if cfg.closed == "left" else born <= cut)
            if cfg.lookback is not None:
                own = own.where(born >= cut - F.lit(cfg.lookback) if cfg.closed == "left" else born > cut - F.lit(cfg.lookback))
        inner = list({s.inner.name: s.inner for s in ss}.values())
        # a child has as many cutoffs as its parent at most
        busy = at_once and hot_keys(cuts.withColumn("__t", time_micros(F.col(CUT))), [key], "__t") is not None
        joined = _row_features(rdb, cfg, child, inner, own.select(key, CUT, "__ck"), "__ck", probe=busy)
        hist = joined.groupBy(key, CUT).agg(*[P.stacked(s.primitive, F.col(f"`{s.inner.name}`")).alias(s.name) for s in ss])
        out = out.join(hist, [key, CUT], "left")
    return _fill_counts(out, specs)


def _cuts(out: DataFrame, key: str) -> DataFrame:
    """The distinct (key, cutoff) pairs of the target rows."""
    return out.select(key, CUT).where(F.col(key).isNotNull() & F.col(CUT).isNotNull()).distinct()


def _steps(feats: DataFrame, key: str, values: list) -> DataFrame:
    """(key, ``__steps``): of a key's rows, one per anchor from its first on, those that differ from the row before, in order
    of the anchors, as (anchor index, v = the values)."""
    rows = feats.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ANCHOR_IDX, F.struct(*values).alias("v")))).alias("__rows"))
    changed = F.filter("__rows", lambda e, i: ~e["v"].eqNullSafe(F.get("__rows", i - 1)["v"]) | (i == 0))
    return rows.select(key, changed.alias("__steps"))


def _parent_aggregates(rdb: Rdb, cfg: DfsConfig, out: DataFrame, table: str, specs: list[FeatureSpec], anchors, id_col: str) -> DataFrame:
    """G2 over G1: what a target row's parent has done by the row's cutoff (forward along the FK, then backward), e.g.
    ``customer.MEAN(orders.o_totalprice)`` of an order.  NULL where the row has no parent; counts of a parent without
    rows are 0.  Evaluated once per distinct (parent, cutoff)."""
    pk = rdb.schema.table(table).primary_key
    for i, (fk, ss) in enumerate(_by(specs, lambda s: s.fk).items()):
        key, at = f"__fk{i}", ANCHOR_IDX
        rows = rdb[table].select(F.col(pk).alias(id_col), F.col(fk).alias(key))
        inner = [s.inner for s in ss]
        if anchors is not None and cfg.lookback is None and all(s.kind in ("agg", "where", "mode", "unique") for s in inner):
            # values that stay until the next change: a row gets its parent's few changes, whatever the number of its anchors
            feats = _entity_features(rdb, cfg, ss[0].child, inner, anchors, key)
            steps = _steps(feats, key, [F.col(f"`{s.inner.name}`").alias(f"f{j}") for j, s in enumerate(ss)])
            out = out.join(rows.join(steps, key, "left").hint("shuffle_hash"), id_col, "left")
            now = F.try_element_at(F.filter("__steps", lambda e: e[ANCHOR_IDX] <= F.col(ANCHOR_IDX)), F.lit(-1))
            out = out.withColumn("__now", now).select(*[F.col(f"`{c}`") for c in out.columns if c != "__steps"],
                                                      *[F.col(f"__now.v.f{j}").alias(s.name) for j, s in enumerate(ss)])
        elif anchors is not None:
            feats = _entity_features(rdb, cfg, ss[0].child, inner, anchors, key)
            feats = feats.select(key, at, *[F.col(f"`{s.inner.name}`").alias(s.name) for s in ss])
            out = out.join(rows, id_col, "left").join(_at_anchors(feats), [key, at], "left")
        else:
            had, apart = out.columns, [replace(s, name=f"__f{j}") for j, s in enumerate(inner)]
            out = _row_features(rdb, cfg, ss[0].child, apart, out.join(rows, id_col, "left"), key)
            # a target without a parent or a cutoff has no values at all
            value = lambda s, j: F.when(F.col(key).isNotNull() & F.col(CUT).isNotNull(), F.col(f"__f{j}")).alias(s.name)
            out = out.select(*[F.col(f"`{c}`") for c in had], key, *[value(s, j) for j, s in enumerate(ss)])
        counts = {s.name: F.when(F.col(key).isNotNull(), F.coalesce(F.col(f"`{s.name}`"), F.lit(0))) for s in ss if _countlike(s.inner)}
        out = out.withColumns(counts).drop(key)
    return out


def compute_features(rdb: Rdb, target: DataFrame, table: str, anchors=None, cfg: DfsConfig | None = None,
                     specs: list[FeatureSpec] | None = None, id_col: str = S.ID,
                     ts_col: str = TS, few: bool = False) -> DataFrame:
    """Features for the rows of ``target`` (``id_col`` -> ``table``'s PK,
    ``ts_col`` = cutoff).  With a list of shared ``anchors`` the slot plans are used and
    a cutoff outside the list fails the job instead of being shifted; with ``anchors=None``
    every row has its own cutoff, any number of them (G12; ``plans.asof``).  Rows are
    preserved (left joins).  ``few``: the target has a row per key and anchor or about so; it then goes to where the
    key's features are made, and no feature is moved.  Otherwise both sides are dealt out by key and anchor.
    G17: pass the train spec list again to get the same columns for test rows."""
    cfg = cfg or DfsConfig()
    specs = specs if specs is not None else enumerate_features(rdb.schema, table, cfg)
    nested = set(s.name for s in specs) - set(s.name for s in drop_nested_arrays(specs))
    if nested:
        raise ValueError(f"array aggregates of array aggregates: {sorted(nested)}")
    back = [s for s in specs if s.kind not in ("direct", "parent")]
    ts = F.col(ts_col).cast("timestamp_ntz")
    if anchors is None:
        out = target.withColumn(CUT, ts)
        if back:
            out = _row_features(rdb, cfg, table, back, out, id_col)
    else:
        anchors = sorted(set(anchors)) or [dt.datetime(1970, 1, 1)]
        idx = (F.array_position(anchor_array(anchors), ts) - 1).cast("int")
        exact = F.when(ts.isNull() | (idx >= 0), idx).otherwise(
            F.raise_error(F.lit(f"cutoff in {ts_col} is not one of the anchors")).cast("int"))
        out = target.withColumn(ANCHOR_IDX, exact)
        if back:
            if few:
                join_where_they_lie(out.sparkSession)
                out = out.repartition(id_col)
            # block by block: the target's partitioning lasts over all joins, a full join of the blocks would lose it
            for block, _ in _entity_blocks(rdb, cfg, table, back, anchors, id_col):
                if not few:  # the planner is not to see that it is dealt out by key: many rows of a key would follow it into one task
                    block = block.withColumn(id_col, F.when(F.col(ANCHOR_IDX) >= 0, F.col(id_col)))
                out = out.join(_at_anchors(block), [id_col, ANCHOR_IDX], "left")
            out = _fill_counts(out, back)
    direct = [s for s in specs if s.kind == "direct"]
    if direct:
        dframe, masks = _direct_block(rdb, cfg, table, direct, id_col)
        out = out.join(dframe, id_col, "left")
        if masks:
            cut = F.col(ts_col).cast("timestamp_ntz")
            repl = {}
            for name, tcol in masks.items():
                visible = F.col(tcol) < cut if cfg.closed == "left" else F.col(tcol) <= cut
                repl[name] = F.when(visible, F.col(f"`{name}`"))
            out = out.withColumns(repl).drop(*sorted(set(masks.values())))
    parents = [s for s in specs if s.kind == "parent"]
    if parents:
        out = _parent_aggregates(rdb, cfg, out, table, parents, anchors, id_col)
    for p in cfg.trans_primitives:
        out = out.withColumn(f"{p.upper()}({ts_col})", datetime_part(F.col(ts_col), p))
    return out.drop(ANCHOR_IDX, CUT)


def compute_dfs_features(rdb: Rdb, target: DataFrame, key_mappings: dict[str, str], cutoff_time_column: str | None = None,
                         config: DfsConfig | None = None, config_overrides: dict | None = None, transform=None, anchors=None) -> DataFrame:
    """Transforms and synthesis in one call, for a target frame with any number of keys.

    ``key_mappings`` maps target columns to primary keys (``{"user_id": "user.id", "item_id": "item.id"}``); each key's
    features are named ``<target column>.<feature>`` and all rows of the target are kept.  ``transform`` is a pipeline
    applied to the tables first (``transforms.Pipeline``).  Without a cutoff column all rows of the tables count."""
    cfg = (config or DfsConfig()).merged(config_overrides)
    if transform is not None:
        rdb = transform(rdb)
    out, ts = target, cutoff_time_column
    if ts is None:
        cfg, ts = replace(cfg, use_cutoff_time=False), "__no_cutoff"
        out = out.withColumn(ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    for column, link in key_mappings.items():
        table, key = link.split(".", 1)
        if rdb.schema.table(table).primary_key != key:
            raise ValueError(f"{link} is not the primary key of {table}")
        had = out.columns
        feats = compute_features(rdb, out, table, anchors, cfg, id_col=column, ts_col=ts)
        out = feats.select(*[F.col(f"`{c}`") for c in had], *[F.col(f"`{c}`").alias(f"{column}.{c}") for c in feats.columns if c not in had])
    return out.drop("__no_cutoff")


def transform_features(df: DataFrame, ts_col: str = "__timestamp__",
                       parts=P.DEFAULT_TRANS_PRIMITIVES) -> DataFrame:
    """YEAR/MONTH/DAY/DAYOFWEEK(ts) (Monday = 0) and TIMESTAMP_<ts> in ns."""
    cols = {f"{p.upper()}({ts_col})": datetime_part(F.col(ts_col), p) for p in parts}
    cols[f"TIMESTAMP_{ts_col}"] = epoch_nanos(F.col(ts_col))
    return df.withColumns(cols)


def array_aggregates(df: DataFrame, key: str, array_col: str, prims=("mean", "max", "min")) -> DataFrame:
    """G3j: element-wise MEAN / MAX / MIN of an array column per key.

    ``posexplode`` -> ``groupBy(key, pos)`` (map-side combined, so a hot key is
    reduced per position) -> arrays rebuilt in position order.  Ragged arrays
    aggregate over the rows that have the position; null elements are skipped.
    """
    fn = {"mean": F.avg, "max": F.max, "min": F.min}
    ex = df.select(key, F.posexplode(array_col).alias("__pos", "__x"))
    per = ex.groupBy(key, "__pos").agg(*[fn[p]("__x").cast("double").alias(p) for p in prims])
    packed = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__pos", *prims))).alias("__a"))
    def field_of(name):
        return lambda s: s.getField(name)
    return packed.select(key, *[F.transform("__a", field_of(p)).alias(f"{p.upper()}({array_col})")
                                for p in prims])


def drop_key_features(specs: list[FeatureSpec], schema: S.RdbSchema) -> list[FeatureSpec]:
    """Remove features whose base column is a PK or FK of its table."""
    def is_key(s: FeatureSpec) -> bool:
        if not s.column or not s.child:
            return False
        table, col = s.child, s.column
        while "." in col:
            table, col = col.split(".", 1)
            table = table.partition("[")[0]
        try:
            c = schema.table(table).column(col)
        except KeyError:
            return False
        return c.dtype in (S.PRIMARY_KEY, S.FOREIGN_KEY)
    return [s for s in specs if not is_key(s)]


def feature_name_map(specs: list[FeatureSpec]) -> dict[str, str]:
    """Readable name -> canonical ``prim__child__fk__column`` name."""
    out = {}
    for s in specs:
        parts = [s.primitive or s.kind, s.child or "", s.fk or "", (s.column or "").replace(".", "_")]
        if s.inner is not None:
            parts.append(feature_name_map([s.inner])[s.inner.name])
        out[s.name] = "__".join(p for p in parts if p)
    return out
