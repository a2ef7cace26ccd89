"""Hand-made boundary fixtures: keys, entities, ids to predict, numerics, modes,
arrays, sinks (FIXTURES.md section 4)."""
import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from relcast.operators import features as G
from relcast.operators import labels as L
from relcast.operators import tasks as E
from relcast.operators import transforms as T
from relcast.sources import rdb as R
from relcast.sources import schema as S

D = dt.datetime
ANCH = [D(2020, 1, 10), D(2020, 2, 10), D(2020, 3, 10)]


@pytest.fixture(scope="module")
def rdb(spark):
    """users <- posts (self-reference ParentId, NULL / dangling / -1 owners)."""
    users = spark.createDataFrame([(1, D(2019, 12, 1)), (2, D(2020, 2, 10)), (3, D(2020, 4, 1)), (-1, None)],
                                  "Id long, CreationDate timestamp_ntz")
    posts = spark.createDataFrame([
        (10, 1, None, "a", 1.0, D(2020, 1, 1)),
        (11, 1, 10, "b", 2.0, D(2020, 1, 10)),      # exactly at an anchor
        (12, 1, 10, "a", None, D(2020, 2, 1)),
        (13, 1, None, "b", 4.0, D(2020, 2, 5)),     # two-way mode tie at 2020-03-10
        (14, None, None, None, 5.0, D(2020, 1, 5)),  # NULL owner
        (15, 99, None, "c", 6.0, D(2020, 1, 6)),    # dangling owner
        (16, -1, None, "c", 7.0, D(2020, 1, 7)),    # id -1 owner
    ], "Id long, OwnerUserId long, ParentId long, Kind string, Score double, CreationDate timestamp_ntz")
    schema = S.RdbSchema((
        S.TableSchema("users", (S.ColumnSchema("Id", S.PRIMARY_KEY), S.ColumnSchema("CreationDate", S.DATETIME)),
                      "CreationDate"),
        S.TableSchema("posts", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                                S.ColumnSchema("OwnerUserId", S.FOREIGN_KEY, "users.Id"),
                                S.ColumnSchema("ParentId", S.FOREIGN_KEY, "posts.Id"),
                                S.ColumnSchema("Kind", "category"), S.ColumnSchema("Score", "float"),
                                S.ColumnSchema("CreationDate", S.DATETIME)), "CreationDate"),
    ))
    return R.Rdb(spark, {"users": users, "posts": posts}, schema)


def test_key_integrity_counts_null_and_dangling(rdb):
    rows = {(r.table_name, r.column_name): r for r in R.key_integrity(rdb).collect()}
    owner = rows[("posts", "OwnerUserId")]
    assert owner.n_null == 1 and owner.n_bad == 1          # 99 dangles; -1 exists in users
    parent = rows[("posts", "ParentId")]
    assert parent.n_null == 5 and parent.n_bad == 0
    assert rows[("users", "Id")].n_bad == 0


def test_strategies_and_self_reference(rdb):
    assert rdb.schema.strategies() == {"users": "creation_based", "posts": "creation_based"}
    specs = G.enumerate_features(rdb.schema, "posts", G.DfsConfig(max_depth=1))
    names = {s.name for s in specs}
    assert "COUNT(posts)" not in names                      # self-reference not aggregated
    assert "users.CreationDate" not in names                # datetime is not a value feature


def test_mode_tie_smallest_and_counts_without_history(spark, rdb):
    tgt = spark.createDataFrame([(1, a) for a in ANCH] + [(2, ANCH[2]), (3, ANCH[2])],
                                "__id long, __timestamp timestamp_ntz")
    cfg = G.DfsConfig(max_depth=1, agg_primitives=("count", "mode", "mean"))
    out = {(r["__id"], r["__timestamp"]): r for r in G.compute_features(rdb, tgt, "users", ANCH, cfg).collect()}
    # strict cutoff: post 11 created exactly at 2020-01-10 is not visible there
    assert out[(1, ANCH[0])]["COUNT(posts)"] == 1
    assert out[(1, ANCH[2])]["COUNT(posts)"] == 4
    assert out[(1, ANCH[2])]["MODE(posts.Kind)"] == "a"     # a:2, b:2 -> smallest
    assert out[(1, ANCH[2])]["MEAN(posts.Score)"] == pytest.approx((1 + 2 + 4) / 3)  # NULL skipped
    assert out[(2, ANCH[2])]["COUNT(posts)"] == 0             # no history -> 0, not NULL
    assert out[(2, ANCH[2])]["MODE(posts.Kind)"] is None


def test_creation_labels_exclude_future_entities(spark, rdb):
    ev = spark.createDataFrame([(1, D(2020, 1, 15)), (2, D(2020, 3, 12))], "UserId long, t timestamp_ntz")
    lab = L.forward_label(ev, "UserId", "t", ANCH, dt.timedelta(days=7), agg="exists", eligible="created",
                          entities=rdb["users"], entity_key="Id", entity_time="CreationDate")
    got = sorted((r["__id"], r["__timestamp"], r["__label"]) for r in lab.collect())
    # user 2 created exactly at 2020-02-10 is eligible there; user 3 (created after) never
    assert (2, ANCH[1], 0) in got and (2, ANCH[2], 1) in got
    assert not [g for g in got if g[0] == 3]
    assert (1, ANCH[0], 1) in got


def test_entity_ids_file_rules(spark):
    d = tempfile.mkdtemp(prefix="relcast-ids-")
    one, two = os.path.join(d, "one.csv"), os.path.join(d, "two.csv")
    with open(one, "w") as fh:
        fh.write("user\n1\n1\nabc\n42\n")
    with open(two, "w") as fh:
        fh.write("a,b\n1,2\n")
    ids = sorted((r["__id"] is None, r["__id"] or 0) for r in R.read_entity_ids(spark, one).collect())
    assert ids == [(False, 1), (False, 1), (False, 42), (True, 0)]   # duplicates kept, text id -> NULL
    with pytest.raises(ValueError):
        R.read_entity_ids(spark, two)


def test_predict_batch_keeps_duplicates_and_unknown_ids(spark):
    from relcast.operators import model as M
    from relcast.operators.predictive import predict_batch
    snaps = spark.createDataFrame([(i, D(2020, 1, 1) + dt.timedelta(days=d), float(i % 2), float(d))
                                   for i in range(40) for d in (0, 10)],
                                  "__id long, __timestamp timestamp_ntz, __label double, x double")
    fm = M.fit(snaps, "classification")
    ids = spark.createDataFrame([(1,), (1,), (999,)], "__id long")
    got = sorted((r["__id"], r["__pred"] is None) for r in predict_batch(fm, snaps, ids, D(2020, 2, 1)).collect())
    assert got == [(1, False), (1, False), (999, True)]


def test_numeric_edge_cases(spark):
    df = spark.createDataFrame([(1, 5.0, None, "x1"), (2, 5.0, None, "x2"), (3, 5.0, None, "x3")],
                               "k long, const double, empty double, txt string")
    assert set(T.redundant_columns(df, text_cols=["txt"], keep=["k"])) == {"const", "empty", "txt"}
    z = T.normalize_numeric(df, ["const"]).select("const").collect()
    assert all(r.const is None for r in z)                  # std 0 -> NULL
    one = spark.createDataFrame([(1.0,)], "v double")
    assert T.normalization_stats([one], ["v"])["v"] == (1.0, None)   # one row: std NULL


def test_array_aggregates_ragged_empty_and_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (1, []), (2, [None, 4.0]), (2, None)],
                               "g long, v array<double>")
    out = {r.g: r for r in G.array_aggregates(df, "g", "v").collect()}
    assert out[1]["MEAN(v)"] == [2.0, 2.0] and out[1]["MAX(v)"] == [3.0, 2.0]
    assert out[2]["MEAN(v)"][0] is None and out[2]["MEAN(v)"][1] == 4.0


def test_sinks_and_metadata_round_trip(spark, rdb):
    d = tempfile.mkdtemp(prefix="relcast-sinks-")
    train = spark.createDataFrame([(1, D(2020, 1, 10), 1.0)], "__id long, __timestamp timestamp_ntz, __label double")
    paths = R.write_task_tables(train, d, "users")
    assert spark.read.parquet(paths["test"]).count() == 0
    assert spark.read.parquet(paths["test"]).columns == train.columns
    R.write_predictions(train.withColumnRenamed("__label", "__pred"), os.path.join(d, "pred"))
    assert spark.read.option("header", True).csv(os.path.join(d, "pred")).count() == 1
    csv = os.path.join(d, "labels.csv")
    with open(csv, "w") as fh:
        fh.write("__id,__timestamp,__label\n1,2020-01-10 00:00:00,1\n")
    got = R.read_labels_csv(spark, csv).first()
    assert got["__timestamp"] == D(2020, 1, 10) and got["__label"] == 1.0
    meta = E.task_metadata(rdb, "users", train)
    assert meta["target_table"] == "users" and meta["columns"][0]["name"] == "__timestamp"
    with pytest.raises(ValueError):
        E.task_metadata(rdb, "users", train.limit(0))
    store = R.write_snapshots(train, os.path.join(d, "store"), "users")
    back = R.read_snapshots(spark, os.path.join(d, "store"), "users")
    assert back.schema["__timestamp"].dataType.simpleString() == "timestamp_ntz" and os.path.isdir(store)
    assert S.schema_from_dict(S.schema_to_dict(rdb.schema)) == rdb.schema


def test_external_target_with_arbitrary_cutoffs(spark, rdb):
    """Cutoffs that are not shared anchors use the target's own cutoff list."""
    cut = [(1, D(2020, 1, 6)), (1, D(2020, 2, 3, 12)), (2, D(2020, 3, 1)), (1, None)]
    tgt = spark.createDataFrame(cut, "__id long, __timestamp timestamp_ntz")
    cfg = G.DfsConfig(max_depth=1, agg_primitives=("count", "sum"))
    got = {(r["__id"], r["__timestamp"]): (r["COUNT(posts)"], r["SUM(posts.Score)"])
           for r in G.compute_features(rdb, tgt, "users", None, cfg).collect()}
    posts = [(1, 1.0, D(2020, 1, 1)), (1, 2.0, D(2020, 1, 10)), (1, None, D(2020, 2, 1)), (1, 4.0, D(2020, 2, 5))]
    for (uid, t) in [c for c in cut if c[1] is not None]:
        rows = [p for p in posts if p[0] == uid and p[2] < t]
        s = sum(p[1] for p in rows if p[1] is not None) if any(p[1] is not None for p in rows) else None
        assert got[(uid, t)] == (len(rows), s)
    with pytest.raises(Exception):
        G.compute_features(rdb, tgt.where("__timestamp IS NOT NULL"), "users", ANCH, cfg).collect()


def test_direct_feature_masked_until_parent_exists(spark):
    """A parent created at or after the cutoff contributes no direct feature value."""
    shops = spark.createDataFrame([(1, 10.0, D(2020, 2, 10)), (2, 20.0, D(2019, 1, 1))],
                                  "sid long, rating double, opened timestamp_ntz")
    items = spark.createDataFrame([(100, 1), (101, 2), (102, None)], "iid long, sid long")
    schema = S.RdbSchema((
        S.TableSchema("shops", (S.ColumnSchema("sid", S.PRIMARY_KEY), S.ColumnSchema("rating", "float"),
                                S.ColumnSchema("opened", S.DATETIME)), "opened"),
        S.TableSchema("items", (S.ColumnSchema("iid", S.PRIMARY_KEY),
                                S.ColumnSchema("sid", S.FOREIGN_KEY, "shops.sid"))),
    ))
    rdb2 = R.Rdb(spark, {"shops": shops, "items": items}, schema)
    tgt = spark.createDataFrame([(100, ANCH[1]), (100, ANCH[2]), (101, ANCH[0]), (102, ANCH[0])],
                                "__id long, __timestamp timestamp_ntz")
    got = {(r["__id"], r["__timestamp"]): r["shops.rating"]
           for r in G.compute_features(rdb2, tgt, "items", ANCH, G.DfsConfig(max_depth=1)).collect()}
    assert got == {(100, ANCH[1]): None, (100, ANCH[2]): 10.0, (101, ANCH[0]): 20.0, (102, ANCH[0]): None}


def test_fused_modes_keep_type_order(spark):
    """Two MODE features of one edge are computed together; an int category with a
    9 / 10 tie picks 9 (numeric order), the text one picks the smaller string."""
    users = spark.createDataFrame([(1,)], "uid long")
    ev = spark.createDataFrame([(1, 10, "b", D(2020, 1, 1)), (1, 9, "a", D(2020, 1, 2)),
                                (1, 10, "a", D(2020, 1, 3)), (1, 9, "b", D(2020, 1, 4))],
                               "uid long, code int, kind string, t timestamp_ntz")
    schema = S.RdbSchema((
        S.TableSchema("users", (S.ColumnSchema("uid", S.PRIMARY_KEY),)),
        S.TableSchema("ev", (S.ColumnSchema("uid", S.FOREIGN_KEY, "users.uid"),
                             S.ColumnSchema("code", "category"), S.ColumnSchema("kind", "category"),
                             S.ColumnSchema("t", S.DATETIME)), "t"),
    ))
    rdb3 = R.Rdb(spark, {"users": users, "ev": ev}, schema)
    tgt = spark.createDataFrame([(1, ANCH[0])], "__id long, __timestamp timestamp_ntz")
    r = G.compute_features(rdb3, tgt, "users", ANCH, G.DfsConfig(max_depth=1, agg_primitives=("mode",))).first()
    assert r["MODE(ev.code)"] == 9 and r["MODE(ev.kind)"] == "a"
    assert G.compute_features(rdb3, tgt, "users", ANCH, G.DfsConfig(max_depth=1, agg_primitives=("mode",))
                              ).schema["MODE(ev.code)"].dataType.typeName() == "integer"
