import datetime as dt

from relcast.operators.anchors import backoff_anchors, censor_filter, lookback_filter


def test_backoff_golden_shop():
    a = backoff_anchors("2001-08-01", dt.datetime(1995, 1, 1))
    assert len(a) == 59
    assert a[0] == dt.datetime(2001, 8, 1)
    assert a[6] == dt.datetime(2001, 7, 26)
    assert a[7] == dt.datetime(2001, 7, 25)
    assert a[8] == dt.datetime(2001, 7, 23)
    assert a[-1] == dt.datetime(1995, 4, 18)
    assert a == sorted(a, reverse=True)


def test_backoff_golden_forum_b_and_long_range():
    assert len(backoff_anchors("2024-01-31", dt.datetime(2024, 1, 1, 0, 0, 7))) == 17
    assert len(backoff_anchors("2021-01-01", dt.datetime(2008, 7, 1))) == 65


def test_backoff_empty_and_boundaries():
    assert backoff_anchors(None, dt.datetime(2000, 1, 1)) == []
    assert backoff_anchors("2000-01-01", None) == []
    assert backoff_anchors("2000-01-01", dt.datetime(2000, 1, 2)) == []  # earliest after today
    assert backoff_anchors("2000-01-08", dt.datetime(2000, 1, 1)) == [
        dt.datetime(2000, 1, d) for d in range(8, 0, -1)]  # 7-step boundary: 8th step is 2 days


def test_lookback_and_censor():
    a = sorted(backoff_anchors("2001-08-01", dt.datetime(1995, 1, 1)))
    lb = lookback_filter(a, "2001-08-01", 365)
    assert all(x >= dt.datetime(2000, 8, 1) for x in lb) and len(lb) == 40
    cz = censor_filter(a, dt.timedelta(days=91), "2001-08-01")
    assert all(x + dt.timedelta(days=91) <= dt.datetime(2001, 8, 1) for x in cz)


def test_plan_equals_the_list(spark):
    import datetime as dt

    from relcast.operators import anchors as A
    from relcast.sources import schema as S
    from relcast.sources.rdb import Rdb
    schema = S.RdbSchema((S.TableSchema("t", (S.ColumnSchema("k", S.PRIMARY_KEY), S.ColumnSchema("at", S.DATETIME)), time_column="at"),))
    today = dt.datetime(2021, 5, 6, 7, 8, 9, 10)
    for first in (dt.datetime(1903, 2, 1), dt.datetime(2021, 5, 6, 7, 8, 9, 10), dt.datetime(2020, 12, 31, 23, 59, 59, 999999), dt.datetime(2022, 1, 1), None):
        rdb = Rdb(spark, {"t": spark.createDataFrame([(1, first), (2, None)], "k int, at timestamp_ntz")}, schema)
        for more in ({}, {"lookback_days": 365.5}, {"horizon": dt.timedelta(days=30), "data_end": today}):
            want = A.make_anchors(rdb, today, **more)
            assert sorted(r[0] for r in A.anchors_plan(rdb, today, **more).collect()) == want
