"""What tasks and shuffles hold must follow from the rows, not from rows x anchors or from a fixed number of partitions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from relcast.operators import features as G
from relcast.operators import sampling as C
from relcast.plans.history import TS, expand_created
from relcast.session import ADVISORY_BYTES, INPUT_BYTES, configure, size_shuffles
from relcast.sources import schema as S
from relcast.sources.rdb import Rdb

DAY = dt.datetime(2020, 1, 1)
ANCHORS = [DAY + dt.timedelta(days=d) for d in range(1, 30)]
ITEM = (S.ColumnSchema("i", S.PRIMARY_KEY), S.ColumnSchema("o", S.FOREIGN_KEY, "orders.o"), S.ColumnSchema("x", "float"), S.ColumnSchema("it", S.DATETIME))
SCHEMA = S.RdbSchema((
    S.TableSchema("users", (S.ColumnSchema("u", S.PRIMARY_KEY),)),
    S.TableSchema("orders", (S.ColumnSchema("o", S.PRIMARY_KEY), S.ColumnSchema("u", S.FOREIGN_KEY, "users.u"), S.ColumnSchema("ot", S.DATETIME)), time_column="ot"),
    S.TableSchema("items", ITEM, time_column="it"),
    S.TableSchema("gifts", ITEM, time_column="it")))


def shop(spark, orders, items, gifts):
    at = lambda d: DAY + dt.timedelta(days=d)
    item = "i long, o long, x double, it timestamp_ntz"
    return Rdb(spark, {
        "users": spark.createDataFrame([(u,) for u in sorted({u for _, u, _ in orders if u is not None})], "u long"),
        "orders": spark.createDataFrame([(o, u, at(d)) for o, u, d in orders], "o long, u long, ot timestamp_ntz"),
        "items": spark.createDataFrame([(k, o, x, at(d)) for k, (o, x, d) in enumerate(items)], item),
        "gifts": spark.createDataFrame([(k, o, x, at(d)) for k, (o, x, d) in enumerate(gifts)], item)}, SCHEMA)


def rows():
    orders = [(k, k % 3 if k % 7 else None, k % 11) for k in range(40)] + [(100 + k, 9, k % 5) for k in range(30)]
    items = [(o, float(o % 4 + j), d + j - 1) for o, _, d in orders for j in range(o % 4)]
    gifts = [(o, float(j - o % 3), d + 2 * j) for o, _, d in orders for j in range(o % 3)]
    return orders, items, gifts


def stacked(rdb):
    cfg = G.DfsConfig(max_depth=2, agg_primitives=("count", "sum", "time_since_last"), stack_primitives=("sum", "mean", "min", "max"))
    specs = [s for s in G.enumerate_features(SCHEMA, "users", cfg) if s.kind == "stacked"]
    return cfg, specs


def brute(orders, items, gifts, user, t, spec):
    """The feature from the rows before ``t``, child by child."""
    d = (t - DAY).days
    values = []
    for o, u, born in orders:
        if u != user or born >= d:
            continue
        mine = [(x, at) for oo, x, at in (items if spec.inner.child == "items" else gifts) if oo == o and at < d]
        if spec.inner.primitive == "count":
            values.append(len(mine))
        elif mine:
            values.append(sum(x for x, _ in mine) if spec.inner.primitive == "sum" else (d - max(a for _, a in mine)) * 86_400)
    if not values:
        return None
    return {"sum": sum, "min": min, "max": max, "mean": lambda v: sum(v) / len(v)}[spec.primitive](values)


@pytest.mark.parametrize("piece_rows", [100_000, 7])
def test_stacked_features_of_several_edges(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(G, "PIECE_ROWS", piece_rows)  # user 9's children in one piece and in several
    data = rows()
    rdb = shop(spark, *data)
    cfg, specs = stacked(rdb)
    tgt = expand_created(rdb["users"].withColumnRenamed("u", S.ID), None, ANCHORS[:8], keep_index=False)
    got = {(r[S.ID], r[TS]): r for r in G.compute_features(rdb, tgt, "users", ANCHORS[:8], cfg, specs).collect()}
    assert len(got) == 4 * 8 and len(specs) == 24
    for (u, t), r in got.items():
        for s in specs:
            want = brute(*data, u, t, s)
            assert (r[s.name] is None) == (want is None), (u, t, s.name)
            assert want is None or abs(r[s.name] - want) < 1e-9, (u, t, s.name, r[s.name], want)


def shuffled(df):
    """Rows that each exchange of the finished plan has moved."""
    node, out, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(node)
    while todo:
        n = todo.pop()
        name = n.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(n.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(n.plan())
        else:
            if name == "ShuffleExchangeExec":
                out.append(n.metrics().apply("shuffleRecordsWritten").value())
            kids = n.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_no_row_per_child_and_anchor_is_shuffled(spark):
    """300 children of 2 parents at 29 anchors are 8,700 pairs; only their changes may travel."""
    orders = [(k, k % 2, 0) for k in range(300)]
    rdb = shop(spark, orders, [(k, 1.0, 0) for k in range(300)], [])
    cfg, specs = stacked(rdb)
    specs = [s for s in specs if s.inner.child == "items"]
    tgt = rdb["users"].selectExpr("u AS __id", "timestamp_ntz'2020-01-20' AS __timestamp")
    out = G.compute_features(rdb, tgt, "users", ANCHORS, cfg, specs)
    assert len(out.collect()) == 2
    assert max(shuffled(out)) <= 600


def test_shuffles_follow_the_input(spark):
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        size_shuffles(spark, 0)
        assert spark.conf.get(names[0]) == spark.conf.get("spark.sql.shuffle.partitions")
        size_shuffles(spark, 500 * INPUT_BYTES + 1)
        assert int(spark.conf.get(names[0])) == 501 and int(spark.conf.get(names[1])) == ADVISORY_BYTES
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_rows_at_anchors_are_not_moved_to_their_parents(spark):
    """60 orders at 29 anchors are 1,740 rows; each order meets its user's changes before it becomes a row per anchor."""
    orders = [(k, k % 3 if k % 7 else None, k % 11) for k in range(60)]
    rdb = shop(spark, orders, [], [])
    cfg = G.DfsConfig(max_depth=2, direct_aggregates=True, agg_primitives=("count",), include_entities=("users", "orders"))
    specs = [s for s in G.enumerate_features(SCHEMA, "orders", cfg) if s.kind == "parent"]
    tgt = expand_created(rdb["orders"].repartition("o").selectExpr("o AS __id", "ot"), "ot", ANCHORS, keep_index=False).drop("ot")
    out = G.compute_features(rdb, tgt, "orders", ANCHORS, cfg, specs)
    rows = out.collect()
    of = {o: u for o, u, _ in orders}
    assert len(rows) == sum(29 - max(0, d - 1) for _, _, d in orders)
    for r in rows:
        u = of[r[S.ID]]
        want = None if u is None else sum(1 for _, v, d in orders if v == u and DAY + dt.timedelta(days=d) < r[TS])
        assert r["users.COUNT(orders)"] == want
    assert max(shuffled(out)) <= 3 * 29


def method_sizes(capsys, df):
    """Bytes of the largest method of each generated class of the finished plan."""
    df.collect()
    capsys.readouterr()
    df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_sampling_is_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes; 59 anchors are as many as the tables have."""
    anchors = [DAY + dt.timedelta(days=d) for d in range(59)]
    at = "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id % 50 as int))"
    posts = spark.range(200).selectExpr("id AS i", "id % 3 AS o", "double(id) AS x", f"{at} AS it")
    cands = expand_created(posts, "it", anchors).select(TS, "i", "o", "x")
    out = C.placeholder_label(C.proportional_sample(cands, "i", 0.3), "i")
    n = {a: sum(1 for k in range(200) if k % 50 <= d) for d, a in enumerate(anchors)}
    assert {r[TS]: r["n"] for r in out.groupBy(TS).agg(F.count("i").alias("n")).collect()} == {a: int(k * 0.3 + 0.5) for a, k in n.items()}
    sizes = method_sizes(capsys, out)
    assert sizes and max(sizes) < 8000


def test_features_of_several_keys_are_compiled(spark, capsys):
    anchors = [DAY + dt.timedelta(days=d) for d in range(59)]
    orders = [(k, k % 3, k % 11) for k in range(40)]
    rdb = shop(spark, orders, [(k % 40, 1.0, k % 13) for k in range(80)], [])
    out = expand_created(rdb["orders"], "ot", anchors).select(TS, F.col("u").alias("who"), F.col("o").alias("what"))
    for key, table, child in (("who", "users", "orders"), ("what", "orders", "items")):
        cfg = G.DfsConfig(max_depth=1, agg_primitives=("count",), include_entities=(child,))
        out = G.compute_features(rdb, out, table, anchors, cfg, id_col=key)
    days = {o: d for o, _, d in orders}
    for r in out.collect():
        d = (r[TS] - DAY).days
        assert r["COUNT(orders)"] == sum(1 for _, u, b in orders if u == r["who"] and b < d)
        assert r["COUNT(items)"] == sum(1 for k in range(80) if k % 40 == r["what"] and k % 13 < d)
    assert out.count() == sum(59 - d for d in days.values())
    sizes = method_sizes(capsys, out)
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("primitive", ["mode", "num_unique"])
def test_rows_per_anchor_are_not_broadcast(spark, tmp_path, primitive):
    """The planner takes a frame's size for that of the file it comes from; these have a row per key and anchor."""
    schema = S.RdbSchema((
        S.TableSchema("users", (S.ColumnSchema("u", S.PRIMARY_KEY),)),
        S.TableSchema("orders", (S.ColumnSchema("o", S.PRIMARY_KEY), S.ColumnSchema("u", S.FOREIGN_KEY, "users.u"),
                                 S.ColumnSchema("kind", "category"), S.ColumnSchema("ot", S.DATETIME)), time_column="ot")))
    spark.createDataFrame([(o, o % 5, "ab"[o % 2], DAY + dt.timedelta(days=o % 9)) for o in range(60)],
                          "o long, u long, kind string, ot timestamp_ntz").write.parquet(f"{tmp_path}/orders")
    rdb = Rdb(spark, {"users": spark.range(5).withColumnRenamed("id", "u"), "orders": spark.read.parquet(f"{tmp_path}/orders")}, schema)
    target = expand_created(spark.range(5).select(F.col("id").alias("__id")), None, ANCHORS, keep_index=False)
    out = G.compute_features(rdb, target, "users", ANCHORS, G.DfsConfig(max_depth=1, agg_primitives=(primitive,)))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 5 * len(ANCHORS)


def test_no_row_per_parent_and_anchor_is_shuffled(spark):
    """60 parents at 29 anchors are 1,740 pairs; the target has 60 of them, and a parent's features meet it where they are made."""
    orders = [(k, k % 60, 0) for k in range(120)]
    rdb = shop(spark, orders, [(k, 1.0, 0) for k in range(120)], [(k, 2.0, 1) for k in range(120)])
    cfg, specs = stacked(rdb)
    specs += [s for s in G.enumerate_features(SCHEMA, "users", cfg) if s.kind in ("agg", "tsl")]
    tgt = rdb["users"].selectExpr("u AS __id", "timestamp_ntz'2020-01-20' AS __timestamp")
    try:
        out = G.compute_features(rdb, tgt, "users", ANCHORS, cfg, specs, few=True)
        got = out.collect()
        assert len(got) == 60 and {r["SUM(orders.COUNT(items))"] for r in got} == {2} and {r["SUM(orders.SUM(gifts.x))"] for r in got} == {4.0}
        assert max(shuffled(out)) <= 120
    finally:
        configure(spark)
