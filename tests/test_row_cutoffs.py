"""Per-row cutoffs: the running plans against brute force, on hot keys, ties, window ends and large values."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from relcast.operators import features as G
from relcast.plans import asof
from relcast.plans.history import Agg, running_best
from relcast.sources import schema as S
from relcast.sources.rdb import Rdb

T0 = dt.datetime(2020, 1, 1)
DAY = dt.timedelta(days=1)
AGGS = [Agg("n", "count"), Agg("nn", "count_nonnull", "x"), Agg("s", "sum", "x"), Agg("lo", "min", "x"), Agg("hi", "max", "x"), Agg("m", "moments", "x")]


def data(seed, n=400):
    rng = random.Random(seed)
    at = lambda: T0 + dt.timedelta(hours=rng.randrange(240))
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])  # noqa: E731  key 1 holds half of the rows
    ev = [(key(), rng.choice([at(), at(), at(), None]), rng.choice([1e9 + rng.random(), 5.0, None])) for _ in range(n)]
    return ev, [(i, key(), rng.choice([at(), at(), at(), None])) for i in range(n // 2)]


def expect(ev, key, inside):
    xs = [x for k, t, x in ev if k == key and t is not None and inside(t)]
    v = [x for x in xs if x is not None]
    return (len(xs), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None),
            (len(v), statistics.mean(v) if v else 0.0, statistics.pvariance(v) * len(v) if v else 0.0))


def same(got, want):
    assert got[:2] == want[:2] and got[3:5] == want[3:5]
    assert got[2] == pytest.approx(want[2])
    assert got[5][0] == want[5][0] and got[5][1] == pytest.approx(want[5][1]) and got[5][2] == pytest.approx(want[5][2], rel=1e-6, abs=1e-3)


def frames(spark, ev, tg):
    return (spark.createDataFrame(ev, "k int, t timestamp_ntz, x double").repartition(4),
            spark.createDataFrame(tg, "i int, k int, c timestamp_ntz").repartition(3))


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_prefix_matches_brute_force(spark, inclusive, backward):
    ev, tg = data(1)
    e, t = frames(spark, ev, tg)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the hot key lies in several partitions
    try:
        rows = asof.prefix_aggregate(t, e, ["k"], "c", "t", AGGS, inclusive, backward).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted((r.k, r.c) for r in rows) == sorted({(k, c) for _, k, c in tg if k is not None and c is not None})
    before = (lambda a, b: a >= b if inclusive else a > b) if backward else (lambda a, b: a <= b if inclusive else a < b)
    for r in rows:
        same(tuple(r)[2:], expect(ev, r.k, lambda x: before(x, r.c)))


@pytest.mark.parametrize("closed", ["left", "right"])
def test_windows_match_brute_force(spark, closed):
    ev, tg = data(2)
    tg += [(10**6 + i, 1, T0 + i * 2 * DAY) for i in range(5)]  # cutoffs on bucket borders
    ev += [(1, T0 + i * DAY, 7.0) for i in range(10)]
    e, t = frames(spark, ev, tg)
    span = 2 * DAY
    rows = asof.windowed_aggregate(t, e, ["k"], "c", "t", AGGS, span, closed).collect()
    assert len(rows) == len({(k, c) for _, k, c in tg if k is not None and c is not None})
    for r in rows:
        inside = (lambda x: r.c - span <= x < r.c) if closed == "left" else (lambda x: r.c - span < x <= r.c)
        same(tuple(r)[2:], expect(ev, r.k, inside))


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("hot", [10**6, 60, 5])
def test_rows_with_their_columns_match_brute_force(spark, monkeypatch, inclusive, backward, hot):
    """No key, key 1 and every key cut into pieces; all target rows stay, also those without a key or cutoff."""
    monkeypatch.setattr(asof, "HOT_ROWS", hot)
    monkeypatch.setattr(asof, "PART", 1)
    ev, tg = data(4)
    ev += [(3, T0 + 30 * DAY, 2.0)] * 20
    tg += [(10**6 + i, 2, T0 + (40 + i) * DAY) for i in range(5)] + [(10**6 + 9, 2, T0 - DAY)]  # pieces without events
    e, t = frames(spark, ev, tg)
    out = asof.attach_prefix(t.withColumn("odd.name", F.col("i") * 2), e, ["k"], "c", "t", AGGS, inclusive, backward)
    assert out.columns == ["i", "k", "c", "odd.name"] + [a.name for a in AGGS]
    rows = out.collect()
    assert sorted((r.i, str(r.k), str(r.c)) for r in rows) == sorted((i, str(k), str(c)) for i, k, c in tg)
    before = (lambda a, b: a >= b if inclusive else a > b) if backward else (lambda a, b: a <= b if inclusive else a < b)
    for r in rows:
        assert r["odd.name"] == 2 * r.i
        same(tuple(r)[4:], expect(ev, r.k, lambda x: r.k is not None and r.c is not None and before(x, r.c)))


@pytest.mark.parametrize("depth", [1, 2])
def test_target_rows_are_moved_once(spark, depth):
    """400 targets and 400 events of one edge, a row each in one shuffle; nothing is joined back or written in between."""
    from tests.test_scale import SCHEMA as SHOP, shop, shuffled
    orders = [(k, k % 5, k % 11) for k in range(400)]
    rdb = shop(spark, orders, [(k, 1.0, k % 13) for k in range(400)] if depth == 2 else [], [])
    cfg = G.DfsConfig(max_depth=depth, agg_primitives=("count",), stack_primitives=("sum",), include_entities=("orders", "items"))
    specs = [s for s in G.enumerate_features(SHOP, "users", cfg) if s.kind == ("stacked" if depth == 2 else "agg")]
    tgt = rdb["orders"].select(F.col("o").alias("row"), F.col("u").alias(S.ID), F.col("ot").alias("__timestamp"))
    out = G.compute_features(rdb, tgt, "users", None, cfg, specs)
    rows = out.collect()
    assert len(rows) == 400
    for r in rows:
        day = (r["__timestamp"] - dt.datetime(2020, 1, 1)).days
        mine = [o for o, u, d in orders if u == r[S.ID] and d < day]
        want = len(mine) if depth == 1 else sum(o % 13 < day for o in mine) if mine else None
        assert r[specs[0].name] == want, r
    if depth == 1:
        assert sum(shuffled(out)) == 800


def test_no_rows(spark):
    e, t = frames(spark, *data(3, 40))
    assert asof.prefix_aggregate(t.limit(0), e, ["k"], "c", "t", AGGS).count() == 0
    rows = asof.prefix_aggregate(t, e.limit(0), ["k"], "c", "t", AGGS).collect()
    assert rows and all(tuple(r)[2:5] == (0, 0, None) and r.m.n == 0 for r in rows)


SCHEMA = S.RdbSchema((
    S.TableSchema("users", (S.ColumnSchema("u", S.PRIMARY_KEY),)),
    S.TableSchema("items", (S.ColumnSchema("i", S.PRIMARY_KEY), S.ColumnSchema("u", S.FOREIGN_KEY, "users.u"), S.ColumnSchema("t", S.DATETIME),
                            S.ColumnSchema("x", "float"), S.ColumnSchema("v", "category")), time_column="t"),
    S.TableSchema("parts", (S.ColumnSchema("p", S.PRIMARY_KEY), S.ColumnSchema("i", S.FOREIGN_KEY, "items.i"), S.ColumnSchema("at", S.DATETIME),
                            S.ColumnSchema("y", "float")), time_column="at")))


def rdb(spark, seed=5):
    rng = random.Random(seed)
    at = lambda: T0 + dt.timedelta(hours=rng.randrange(96))
    items = [(i, rng.choice([1, 1, 2, 3]), at(), float(rng.randrange(9)), rng.choice(["a", "b", "c", None])) for i in range(60)]
    parts = [(p, rng.randrange(70), at(), float(rng.randrange(9))) for p in range(150)]
    return Rdb(spark, {"users": spark.createDataFrame([(i,) for i in range(1, 5)], "u int"),
                       "items": spark.createDataFrame(items, "i int, u int, t timestamp_ntz, x double, v string"),
                       "parts": spark.createDataFrame(parts, "p int, i int, at timestamp_ntz, y double")}, SCHEMA)


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("lookback", [None, dt.timedelta(hours=30)])
def test_row_cutoffs_equal_shared_anchors(spark, closed, lookback):
    """Every feature kind: the running plans give what the slot plans give at the same cutoffs."""
    r = rdb(spark)
    cuts = [T0 + dt.timedelta(hours=h) for h in (0, 10, 24, 47, 48, 95, 96, 200)]
    tgt = spark.createDataFrame([(u, c) for u in (1, 2, 3, 4, 9) for c in cuts], "__id int, __timestamp timestamp_ntz")
    cfg = G.DfsConfig(max_depth=2, closed=closed, lookback=lookback, agg_primitives=("count", "sum", "mean", "min", "max", "std", "mode", "time_since_last"),
                      where_primitives=("count", "sum", "mean"), interesting_values={"items.v": ["a", "b"]})
    a = G.compute_features(r, tgt, "users", cuts, cfg).orderBy("__id", "__timestamp").toPandas()
    b = G.compute_features(r, tgt, "users", None, cfg).orderBy("__id", "__timestamp").toPandas()[list(a.columns)]
    for c in a.columns:
        for x, y in zip(a[c], b[c]):
            empty = [z is None or z != z for z in (x, y)]
            assert empty[0] == empty[1] and (empty[0] or x == y or x == pytest.approx(y)), c


def test_any_number_of_cutoffs_and_rows_without(spark):
    r = rdb(spark)
    tgt = spark.range(6000).select((F.col("id") % 4 + 1).cast("int").alias("__id"),
                                   F.when(F.col("id") % 100 > 0, F.timestamp_micros(F.col("id") + 1577836800000000).cast("timestamp_ntz")).alias("__timestamp"), "id")
    out = G.compute_features(r, tgt, "users", None, G.DfsConfig(max_depth=1, agg_primitives=("count", "max"))).toPandas()
    assert len(out) == 6000 and (out.loc[out["__timestamp"].isna(), "COUNT(items)"] == 0).all()


def test_running_best_keeps_a_row_per_value_and_slot(spark):
    """MODE on shared anchors carries no value to anchors where it has no event."""
    ev = spark.createDataFrame([(1, v, T0 + i * DAY) for i, v in enumerate("aabbbac")] + [(1, None, T0)], "k int, v string, t timestamp_ntz").where("v is not null")
    anchors = [T0 + i * DAY for i in range(9)]
    got = [r["__best"].v for r in running_best(ev, ["k"], "v", "t", anchors, strict=True).orderBy("__a").collect()]
    assert got == ["a", "a", "a", "a", "b", "a", "a", "a"]


ARRAYS = S.RdbSchema((
    S.TableSchema("users", (S.ColumnSchema("u", S.PRIMARY_KEY),)),
    S.TableSchema("items", (S.ColumnSchema("i", S.PRIMARY_KEY), S.ColumnSchema("u", S.FOREIGN_KEY, "users.u"), S.ColumnSchema("t", S.DATETIME),
                            S.ColumnSchema("v", S.ARRAY)), time_column="t")))


@pytest.mark.parametrize("lookback", [None, DAY * 2])
@pytest.mark.parametrize("anchored", [True, False])
def test_arrays_by_element_before_the_cutoff(spark, anchored, lookback):
    items = [(1, 1, T0, [1.0, None, 3.0]), (2, 1, T0 + DAY, [5.0]), (3, 1, T0 + 2 * DAY, None), (4, 2, T0 + DAY, []), (5, 1, T0 + 3 * DAY, [9.0, 2.0])]
    r = Rdb(spark, {"users": spark.createDataFrame([(1,), (2,)], "u int"), "items": spark.createDataFrame(items, "i int, u int, t timestamp_ntz, v array<double>")}, ARRAYS)
    cuts = [T0, T0 + DAY, T0 + 2 * DAY, T0 + 9 * DAY]
    tgt = spark.createDataFrame([(u, c) for u in (1, 2) for c in cuts], "__id int, __timestamp timestamp_ntz")
    cfg = G.DfsConfig(max_depth=1, agg_primitives=(), array_primitives=("mean", "max"), lookback=lookback)
    rows = G.compute_features(r, tgt, "users", cuts if anchored else None, cfg).collect()
    for x in rows:
        seen = [v for _, u, t, v in items if u == x["__id"] and t < x["__timestamp"] and (lookback is None or t >= x["__timestamp"] - lookback) and v]
        size = max(map(len, seen), default=0)
        at = [[v[k] for v in seen if len(v) > k and v[k] is not None] for k in range(size)]
        assert x["ARRAYMAX(items.v)"] == ([max(c, default=None) for c in at] or None)
        assert x["ARRAYMEAN(items.v)"] == ([sum(c) / len(c) if c else None for c in at] or None)


def test_nested_array_aggregates_are_refused(spark):
    inner = G.FeatureSpec("ARRAYMEAN(parts.v)", "array", "items", "parts", "i", "v", "mean")
    nested = G.FeatureSpec("MEAN(items.ARRAYMEAN(parts.v))", "stacked", "users", "items", "u", None, "mean", inner=inner)
    assert G.drop_nested_arrays([inner, nested]) == [inner]
    with pytest.raises(ValueError):
        G.compute_features(rdb(spark), spark.createDataFrame([(1, T0)], "__id int, __timestamp timestamp_ntz"), "users", None, G.DfsConfig(), [nested])


def test_entity_versions_as_of_each_row(spark):
    from relcast.operators.tasks import entity_as_of
    versions = [(1, T0, "a"), (1, T0 + DAY, None), (1, T0 + 2 * DAY, "c"), (1, T0 + 2 * DAY, "b"), (2, None, "x"), (None, T0, "y")]
    v = spark.createDataFrame(versions, "k int, since timestamp_ntz, val string")
    tgt = spark.createDataFrame([(k, T0 + d * DAY) for k in (1, 2, None) for d in range(4)] + [(1, None)], "__id int, __timestamp timestamp_ntz")
    got = {(r["__id"], r["__timestamp"]): r.val for r in entity_as_of(tgt, v, "k", "since", ["val"]).collect()}
    assert got == {**{(k, T0 + d * DAY): None for k in (2, None) for d in range(4)}, (1, None): None,
                   (1, T0): None, (1, T0 + DAY): "a", (1, T0 + 2 * DAY): None, (1, T0 + 3 * DAY): "c"}
    at = {r["__timestamp"]: r.val for r in entity_as_of(tgt.where("__id = 1"), v, "k", "since", ["val"], closed="right").collect()}
    assert at[T0] == "a" and at[T0 + 2 * DAY] == "c"


def test_several_keys_in_one_call(spark):
    r = rdb(spark)
    tgt = spark.createDataFrame([(u, i, T0 + 50 * dt.timedelta(hours=1), "q") for u in (1, 2, 9) for i in (0, 5)], "who int, what int, seen timestamp_ntz, note string")
    cfg = G.DfsConfig(max_depth=1, agg_primitives=("count",))
    out = G.compute_dfs_features(r, tgt, {"who": "users.u", "what": "items.i"}, "seen", cfg)
    assert out.columns[:4] == tgt.columns and out.count() == 6 and {"who.COUNT(items)", "what.COUNT(parts)"} <= set(out.columns)
    one = G.compute_features(r, tgt.select(F.col("who").alias("__id"), F.col("seen").alias("__timestamp")).distinct(), "users", None, cfg)
    assert ({(x.who, x["who.COUNT(items)"]) for x in out.collect()} == {(x["__id"], x["COUNT(items)"]) for x in one.collect()})
    static = G.compute_dfs_features(r, tgt.drop("seen"), {"who": "users.u"}, None, cfg)
    assert static.columns == ["who", "what", "note", "who.COUNT(items)"] and static.count() == 6
    with pytest.raises(ValueError):
        G.compute_dfs_features(r, tgt, {"who": "items.u"}, "seen", cfg)


@pytest.mark.parametrize("lookback", [None, DAY])
@pytest.mark.parametrize("approximate", [False, True])
def test_distinct_counts_on_both_engines(spark, approximate, lookback):
    r = rdb(spark, 8)
    cuts = [T0 + dt.timedelta(hours=h) for h in (0, 20, 48, 200)]
    tgt = spark.createDataFrame([(u, c) for u in (1, 2, 4) for c in cuts], "__id int, __timestamp timestamp_ntz")
    cfg = G.DfsConfig(max_depth=1, agg_primitives=("num_unique",), use_approximate_aggregations=approximate, lookback=lookback)
    items = r["items"].collect()
    for anchors in (cuts, None):  # few values: the sketches are exact
        for x in G.compute_features(r, tgt, "users", anchors, cfg).collect():
            seen = {i.v for i in items if i.u == x["__id"] and i.t < x["__timestamp"] and (lookback is None or i.t >= x["__timestamp"] - lookback)} - {None}
            assert x["NUM_UNIQUE(items.v)"] == len(seen)
