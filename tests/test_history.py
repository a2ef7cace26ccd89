"""Slot plans against a brute-force Python evaluation on boundary fixtures."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from relcast.plans.history import Agg, Win, cumulative_aggregate, expand_created, expand_to_anchors, window_aggregate

ANCH = [dt.datetime(2020, 1, 10), dt.datetime(2020, 1, 20), dt.datetime(2020, 1, 21), dt.datetime(2020, 3, 1)]
H = dt.timedelta(days=10)
US = dt.timedelta(microseconds=1)


def _events():
    rows = []
    i = 0
    for k in (1, 2, 3):
        for t in ANCH:
            for d in (dt.timedelta(0), H, -H, US, -US, H + US, H - US, -H + US, -H - US):
                rows.append((k, t + d, float(i % 7)))
                i += 1
    rnd = random.Random(3)
    for _ in range(300):
        rows.append((rnd.choice([1, 2, 4, None]),
                     dt.datetime(2019, 12, 1) + dt.timedelta(seconds=rnd.randrange(0, 120 * 86400)),
                     rnd.choice([1.0, 2.5, None])))
    rows.append((5, None, 1.0))
    return rows


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(_events(), "k long, t timestamp_ntz, v double")


def _brute_window(rows, lo_off, hi_off, closed="right"):
    out = {}
    for ai, a in enumerate(ANCH):
        for k, t, v in rows:
            if t is None:
                continue
            lo = None if lo_off is None else a + lo_off
            hi = None if hi_off is None else a + hi_off
            if closed == "right":
                ok = (lo is None or t > lo) and (hi is None or t <= hi)
            else:
                ok = (lo is None or t >= lo) and (hi is None or t < hi)
            if ok:
                c, s, mx = out.get((k, a), (0, None, None))
                s = s if v is None else (v if s is None else s + v)
                mx = mx if v is None else (v if mx is None else max(mx, v))
                out[(k, a)] = (c + 1, s, mx)
    return out


@pytest.mark.parametrize("closed", ["right", "left"])
def test_window_aggregate_matches_brute_force(spark, ev, closed):
    wins = [Win("past", -H, dt.timedelta(0)), Win("future", dt.timedelta(0), H)]
    df = window_aggregate(ev, ["k"], "t", ANCH, wins,
                          [Agg("n", "count"), Agg("s", "sum", "v"), Agg("mx", "max", "v")], closed=closed)
    got = {(r.k, r["__timestamp"]): r for r in df.collect()}
    rows = _events()
    past = _brute_window(rows, -H, dt.timedelta(0), closed)
    fut = _brute_window(rows, dt.timedelta(0), H, closed)
    keys = set(past) | set(fut)
    assert set(got) == keys
    for key in keys:
        r = got[key]
        p = past.get(key, (0, None, None))
        f = fut.get(key, (0, None, None))
        assert r.past__n == p[0] and r.future__n == f[0]
        assert (r.past__s is None and p[1] is None) or abs(r.past__s - p[1]) < 1e-9
        assert r.future__mx == f[2]


@pytest.mark.parametrize("strict", [False, True])
def test_cumulative_matches_brute_force(spark, ev, strict):
    df = cumulative_aggregate(ev, ["k"], "t", ANCH, [Agg("n", "count"), Agg("s", "sum", "v")], strict=strict)
    got = {(r.k, r["__timestamp"]): (r.n, r.s) for r in df.collect()}
    want = _brute_window(_events(), None, dt.timedelta(0), "left" if strict else "right")
    assert set(got) == set(want)
    for key, (n, s, _) in want.items():
        assert got[key][0] == n
        assert (got[key][1] is None and s is None) or abs(got[key][1] - s) < 1e-9


def test_expand_to_anchors_matches_window(spark, ev):
    win = Win("w", -H, dt.timedelta(0))
    df = expand_to_anchors(ev, "t", ANCH, win).groupBy("k", "__timestamp").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.k, r["__timestamp"]): r.n for r in df.collect()}
    want = {k: v[0] for k, v in _brute_window(_events(), -H, dt.timedelta(0)).items()}
    assert got == want


def test_expand_created_boundaries(spark):
    df = spark.createDataFrame([(1, ANCH[0]), (2, ANCH[0] + US), (3, None), (4, ANCH[-1] + US)],
                               "id long, c timestamp_ntz")
    got = sorted((r.id, r["__timestamp"]) for r in expand_created(df, "c", ANCH).collect())
    assert [g for g in got if g[0] == 1] == [(1, a) for a in ANCH]
    assert [g for g in got if g[0] == 2] == [(2, a) for a in ANCH[1:]]
    assert not [g for g in got if g[0] in (3, 4)]
    strict = sorted((r.id, r["__timestamp"]) for r in expand_created(df, "c", ANCH, strict=True).collect())
    assert [g for g in strict if g[0] == 1] == [(1, a) for a in ANCH[1:]]


def test_no_leakage_future_rows_do_not_change_history(spark, ev):
    """Adding events after the last anchor never changes all-history aggregates."""
    late = spark.createDataFrame([(1, ANCH[-1] + dt.timedelta(days=1), 100.0)], ev.schema)
    a = cumulative_aggregate(ev, ["k"], "t", ANCH, [Agg("n", "count")]).collect()
    b = cumulative_aggregate(ev.unionByName(late), ["k"], "t", ANCH, [Agg("n", "count")]).collect()
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
