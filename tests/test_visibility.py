"""What a feature may know: parents of child rows, several keys to one parent, numerically
stable deviations, events that arrive late."""
import datetime as dt
import math
import os

import pytest

from relcast.operators import features as G
from relcast.plans.history import Agg
from relcast.sources import rdb as R
from relcast.sources import schema as S

D = dt.datetime
ANCH = [D(2020, 2, 1), D(2020, 4, 1)]


def _col(name, dtype, link=None):
    return S.ColumnSchema(name, dtype, link)


@pytest.fixture(scope="module")
def shop(spark):
    """item <- line -> order -> campaign: lines may be older than their order or its campaign."""
    schema = S.RdbSchema((
        S.TableSchema("i", (_col("i_id", S.PRIMARY_KEY),)),
        S.TableSchema("k", (_col("k_id", S.PRIMARY_KEY), _col("cost", "float"), _col("k_ts", S.DATETIME)), "k_ts"),
        S.TableSchema("o", (_col("o_id", S.PRIMARY_KEY), _col("k_id", S.FOREIGN_KEY, "k.k_id"),
                            _col("price", "float"), _col("kind", "category"), _col("o_ts", S.DATETIME)), "o_ts"),
        S.TableSchema("l", (_col("l_id", S.PRIMARY_KEY), _col("i_id", S.FOREIGN_KEY, "i.i_id"),
                            _col("o_id", S.FOREIGN_KEY, "o.o_id"), _col("qty", "float"),
                            _col("l_ts", S.DATETIME)), "l_ts")))
    return R.Rdb(spark, {
        "i": spark.createDataFrame([(1,), (2,)], "i_id long"),
        "k": spark.createDataFrame([(7, 5.0, D(2020, 3, 15))], "k_id long, cost double, k_ts timestamp_ntz"),
        "o": spark.createDataFrame([(1, 7, 99.0, "late", D(2020, 3, 1)), (2, None, 10.0, "early", D(2020, 1, 1)),
                                    (3, None, 20.0, "none", None)],
                                   "o_id long, k_id long, price double, kind string, o_ts timestamp_ntz"),
        "l": spark.createDataFrame([(1, 1, 1, 2.0, D(2020, 1, 5)), (2, 1, 2, 3.0, D(2020, 1, 6)),
                                    (3, 1, 3, 4.0, D(2020, 1, 7)), (4, 1, 55, 1.0, D(2020, 1, 8)),
                                    (5, 1, None, 1.0, D(2020, 1, 9))],
                                   "l_id long, i_id long, o_id long, qty double, l_ts timestamp_ntz")}, schema)


def _features(spark, rdb, table, cfg, ids=(1, 2), anchors=ANCH):
    tgt = spark.createDataFrame([(i, a) for i in ids for a in anchors], "__id long, __timestamp timestamp_ntz")
    rows = G.compute_features(rdb, tgt, table, anchors, cfg).collect()
    return {(r["__id"], r["__timestamp"]): r.asDict() for r in rows}


def test_parent_values_wait_for_the_parent(spark, shop):
    cfg = G.DfsConfig(max_depth=3, agg_primitives=("count", "sum", "mode"))
    got = _features(spark, shop, "i", cfg)
    early, late = got[(1, ANCH[0])], got[(1, ANCH[1])]
    assert early["COUNT(l)"] == 5 and early["SUM(l.qty)"] == 11.0
    assert early["SUM(l.o.price)"] == 10.0 and late["SUM(l.o.price)"] == 109.0   # order 3 has no time
    assert early["SUM(l.o.k.cost)"] is None and late["SUM(l.o.k.cost)"] == 5.0
    assert early["MODE(l.o.kind)"] == "early" and late["MODE(l.o.kind)"] == "early"
    assert got[(2, ANCH[1])]["COUNT(l)"] == 0 and got[(2, ANCH[1])]["SUM(l.o.price)"] is None


def test_lookback_is_about_the_child(spark, shop):
    cfg = G.DfsConfig(max_depth=2, agg_primitives=("count", "sum"), lookback=dt.timedelta(days=87))
    late = _features(spark, shop, "i", cfg)[(1, ANCH[1])]   # from 2020-01-05 on
    assert late["COUNT(l)"] == 5 and late["SUM(l.o.price)"] == 109.0
    cfg = G.DfsConfig(max_depth=2, agg_primitives=("count", "sum", "std"), lookback=dt.timedelta(days=86))
    late = _features(spark, shop, "i", cfg)[(1, ANCH[1])]   # line 1 is out
    assert late["COUNT(l)"] == 4 and late["SUM(l.o.price)"] == 10.0 and late["STD(l.o.price)"] is None


def test_direct_features_wait_for_every_parent(spark, shop):
    got = _features(spark, shop, "l", G.DfsConfig(max_depth=2), ids=(1,))
    early, late = got[(1, ANCH[0])], got[(1, ANCH[1])]
    assert early["o.price"] is None and early["o.k.cost"] is None
    assert late["o.price"] == 99.0 and late["o.k.cost"] == 5.0
    mid = _features(spark, shop, "l", G.DfsConfig(max_depth=2), ids=(1,), anchors=[D(2020, 3, 10)])
    row = mid[(1, D(2020, 3, 10))]
    assert row["o.price"] == 99.0 and row["o.k.cost"] is None   # order known, campaign not yet


def test_two_keys_to_one_parent(spark):
    schema = S.RdbSchema((
        S.TableSchema("u", (_col("u_id", S.PRIMARY_KEY), _col("age", "float"))),
        S.TableSchema("g", (_col("g_id", S.PRIMARY_KEY),)),
        S.TableSchema("e", (_col("e_id", S.PRIMARY_KEY), _col("g_id", S.FOREIGN_KEY, "g.g_id"),
                            _col("src", S.FOREIGN_KEY, "u.u_id"), _col("dst", S.FOREIGN_KEY, "u.u_id"),
                            _col("ts", S.DATETIME)), "ts")))
    rdb = R.Rdb(spark, {
        "u": spark.createDataFrame([(1, 10.0), (2, 30.0)], "u_id long, age double"),
        "g": spark.createDataFrame([(1,)], "g_id long"),
        "e": spark.createDataFrame([(1, 1, 1, 2, D(2020, 1, 1))],
                                   "e_id long, g_id long, src long, dst long, ts timestamp_ntz")}, schema)
    cfg = G.DfsConfig(max_depth=2, agg_primitives=("sum",))
    row = _features(spark, rdb, "g", cfg, ids=(1,))[(1, ANCH[0])]
    assert row["SUM(e.u[src].age)"] == 10.0 and row["SUM(e.u[dst].age)"] == 30.0


@pytest.mark.parametrize("lookback", [None, dt.timedelta(days=365)])
def test_std_of_large_values(spark, lookback):
    schema = S.RdbSchema((S.TableSchema("p", (_col("p_id", S.PRIMARY_KEY),)),
                          S.TableSchema("c", (_col("c_id", S.PRIMARY_KEY), _col("p_id", S.FOREIGN_KEY, "p.p_id"),
                                              _col("x", "float"), _col("ts", S.DATETIME)), "ts")))
    rows = [(1, 1, 1e9, D(2020, 1, 1)), (2, 1, None, D(2020, 1, 2)), (3, 1, 1e9 + 1, D(2020, 3, 1)),
            (4, 1, 1e9 + 2, D(2020, 3, 2)), (5, 2, None, D(2020, 1, 1)), (6, 2, 5.0, D(2020, 3, 1)),
            (7, 2, 1e9, D(2020, 3, 2))]
    rdb = R.Rdb(spark, {"p": spark.createDataFrame([(1,), (2,)], "p_id long"),
                        "c": spark.createDataFrame(rows, "c_id long, p_id long, x double, ts timestamp_ntz")}, schema)
    got = _features(spark, rdb, "p", G.DfsConfig(max_depth=1, agg_primitives=("std",), lookback=lookback))
    assert got[(1, ANCH[0])]["STD(c.x)"] is None and got[(2, ANCH[0])]["STD(c.x)"] is None
    assert math.isclose(got[(1, ANCH[1])]["STD(c.x)"], 1.0, rel_tol=1e-9)
    assert math.isclose(got[(2, ANCH[1])]["STD(c.x)"], (1e9 - 5.0) / math.sqrt(2), rel_tol=1e-9)


def test_late_events_count_over_several_runs(spark, tmp_path):
    """Four runs on one checkpoint, the later files months older than the first."""
    from relcast.plans.history import running_from_partials
    from relcast.streaming.incremental import read_slot_partials, start_slot_partials
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    aggs = [Agg("n", "count"), Agg("s", "sum", "v"), Agg("m", "moments", "v")]
    schema = "k long, v double, ts timestamp_ntz"
    days = [D(2020, 3, 30), D(2020, 3, 29), D(2020, 1, 2), D(2019, 6, 1)]
    os.makedirs(src)
    for i, day in enumerate(days):
        spark.createDataFrame([(1, float(i), day)], schema).write.mode("append").parquet(src)
        start_slot_partials(spark, src, spark.read.parquet(src).schema, ["k"], "ts", ANCH, aggs, sink,
                            ckpt).awaitTermination()
    out = running_from_partials(read_slot_partials(spark, sink, ["k"], aggs), ["k"], ANCH, aggs)
    rows = {r["__timestamp"]: r for r in out.collect()}
    assert rows[ANCH[0]]["n"] == 2 and rows[ANCH[1]]["n"] == 4 and rows[ANCH[1]]["s"] == 6.0
    assert math.isclose(rows[ANCH[1]]["m"]["m2"], 5.0)
