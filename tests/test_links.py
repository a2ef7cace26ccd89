"""Link candidates against brute force, with hubs cut into pieces, and parent aggregates of rows without a parent."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from relcast.functions.hashing import epoch_seconds, unit_hash
from relcast.operators import features as G
from relcast.operators import labels as L
from relcast.sources import rdb as R
from relcast.sources import schema as S
from relcast.sources.rdb import Rdb

T0 = dt.datetime(2021, 3, 1)
DAY = dt.timedelta(days=1)


@pytest.mark.parametrize("hub", [1000, 2])
def test_candidates_match_brute_force(spark, monkeypatch, hub):
    monkeypatch.setattr(L, "HUB", hub)
    rng = random.Random(3)
    src = [(u, T0 + rng.randrange(10) * DAY) for u in range(12)]
    dst = [(y, T0 + rng.randrange(25) * DAY) for y in range(30)]
    links = [(rng.randrange(12), rng.choice([0, 0, 0, rng.randrange(30)]) if rng.random() < 0.5 else rng.randrange(30), T0 + rng.randrange(40) * DAY)
             for _ in range(150)] + [(None, 3, T0), (2, None, T0 + DAY), (4, 5, None)]
    anchors = [T0 + d * DAY for d in (5, 12, 20, 33)]
    lf = spark.createDataFrame(links, "u int, y int, t timestamp_ntz")
    sf, df = spark.createDataFrame(src, "u int, b timestamp_ntz"), spark.createDataFrame(dst, "y int, b timestamp_ntz")
    got = L.link_candidates(lf, "u", "y", "t", anchors, 6 * DAY, 9 * DAY, sf, df, negatives=3, seed=5).collect()
    assert len(got) == len({tuple(r) for r in got})

    draws = spark.createDataFrame([(u, a, i) for u, _ in src for a in anchors for i in range(3)], "u int, a timestamp_ntz, i int")
    draws = draws.select("u", "a", F.floor(unit_hash(5, epoch_seconds(F.col("a")), F.col("u"), F.col("i")) * len(dst)).alias("b")).collect()
    at = {r.y: r.b for r in df.select("y", F.floor(unit_hash(6, F.col("y")) * len(dst)).alias("b")).collect()}
    good = [x for x in links if None not in x]
    want = set()
    for a in anchors:
        recent = {(u, y) for u, y, t in good if a - 6 * DAY < t <= a}
        pairs = {(u, z) for u, y in recent for v, x in recent if x == y and v != u for w, z in recent if w == v}
        pairs |= {(r.u, y) for r in draws if r.a == a for y in at if at[y] == r.b}
        for u, y in pairs:
            first = min((t for x, z, t in good if (x, z) == (u, y)), default=None)
            if dict(src)[u] <= a and dict(dst)[y] <= a and (first is None or first > a):
                want.add((a, u, y, int(first is not None and first <= a + 9 * DAY)))
    assert {tuple(r) for r in got} == want and any(r[3] for r in want)


def test_candidates_without_links(spark):
    lf = spark.createDataFrame([], "u int, y int, t timestamp_ntz")
    none = spark.createDataFrame([], "u int, b timestamp_ntz")
    assert L.link_candidates(lf, "u", "y", "t", [T0], DAY, DAY, none, none.withColumnRenamed("u", "y")).count() == 0


SCHEMA = S.RdbSchema((
    S.TableSchema("users", (S.ColumnSchema("u", S.PRIMARY_KEY),)),
    S.TableSchema("items", (S.ColumnSchema("i", S.PRIMARY_KEY), S.ColumnSchema("u", S.FOREIGN_KEY, "users.u"), S.ColumnSchema("t", S.DATETIME),
                            S.ColumnSchema("x", "float")), time_column="t")))


@pytest.mark.parametrize("anchored", [True, False])
def test_parent_aggregates(spark, anchored):
    items = spark.createDataFrame([(1, 1, T0, 2.0), (2, 1, T0 + DAY, 5.0), (3, None, T0, 9.0), (4, 2, T0 + DAY, 1.0)], "i int, u int, t timestamp_ntz, x double")
    r = Rdb(spark, {"users": spark.createDataFrame([(1,), (2,), (3,)], "u int"), "items": items}, SCHEMA)
    cuts = [T0 + DAY, T0 + 2 * DAY]
    tgt = spark.createDataFrame([(i, c) for i in (1, 2, 3, 4, 99) for c in cuts], "__id int, __timestamp timestamp_ntz")
    cfg = G.DfsConfig(max_depth=2, agg_primitives=("count", "sum"), datetime_primitives=("max",), direct_aggregates=True)
    specs = [s for s in G.enumerate_features(SCHEMA, "items", cfg) if s.kind == "parent"]
    rows = G.compute_features(r, tgt, "items", cuts if anchored else None, cfg, specs).collect()
    got = {(x["__id"], x["__timestamp"]): (x["users.COUNT(items)"], x["users.SUM(items.x)"], x["users.MAX(items.t)"]) for x in rows}
    a, b = cuts
    assert got == {(1, a): (1, 2.0, T0), (2, a): (1, 2.0, T0), (1, b): (2, 7.0, a), (2, b): (2, 7.0, a), (4, a): (0, None, None), (4, b): (1, 1.0, a),
                   (3, a): (None,) * 3, (3, b): (None,) * 3, (99, a): (None,) * 3, (99, b): (None,) * 3}


def test_sorted_sink(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    R.write_sorted(df, str(tmp_path / "s"), ["k", "v"])
    got = [(r.k, r.v) for r in R.read_sorted(spark, str(tmp_path / "s")).orderBy("position").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_labels_must_be_unique_on_request(spark):
    df = spark.createDataFrame([(1, T0, 1), (1, T0, 0)], "__id int, __timestamp timestamp_ntz, __label int")
    assert L.validate_labels(df).count() == 2
    with pytest.raises(ValueError):
        L.validate_labels(df, require_unique=True)
