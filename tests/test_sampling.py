import datetime as dt

from pyspark.sql import Window, functions as F

from relcast.operators.sampling import activity_biased_sample, proportional_sample, sample_size


def test_sample_size_rounds_half_up(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5, 15)], "n long")
    got = {r.n: r.k for r in df.select("n", sample_size(F.col("n"), 0.3).alias("k")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 5: 2, 15: 5}


def _cands(spark):
    rows = []
    # one hot anchor with many rows, others with 0..15 rows
    for i in range(20000):
        rows.append((dt.datetime(2020, 1, 1), i, float(i % 13)))
    for j, n in enumerate((1, 2, 3, 5, 15)):
        for i in range(n):
            rows.append((dt.datetime(2020, 2, 1 + j), 100000 + i, 1.0))
    return spark.createDataFrame(rows, "__timestamp timestamp_ntz, id long, act double")


def test_proportional_sample_equals_full_window_rank(spark):
    from relcast.functions.hashing import epoch_seconds, unit_hash
    c = _cands(spark)
    got = sorted((r["__timestamp"], r.id) for r in proportional_sample(c, "id", 0.3).collect())
    u = unit_hash(42, epoch_seconds(F.col("__timestamp")), F.col("id"))
    w = Window.partitionBy("__timestamp").orderBy(u, F.col("id"))
    ref = (c.withColumn("rn", F.row_number().over(w))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("__timestamp")))
            .where(F.col("rn") <= sample_size(F.col("n"), 0.3)))
    want = sorted((r["__timestamp"], r.id) for r in ref.collect())
    assert got == want
    assert len([g for g in got if g[0] == dt.datetime(2020, 1, 1)]) == 6000


def test_activity_biased_sample_equals_full_window_rank(spark):
    from relcast.functions.hashing import epoch_seconds, unit_hash
    c = _cands(spark)
    got = sorted((r["__timestamp"], r.id) for r in activity_biased_sample(c, "id", "act", 0.3, 2.0).collect())
    s = F.pow(F.coalesce(F.col("act"), F.lit(1.0)), F.lit(2.0)) * unit_hash(42, epoch_seconds(F.col("__timestamp")), F.col("id"))
    w = Window.partitionBy("__timestamp").orderBy(s.desc(), F.col("id"))
    ref = (c.withColumn("rn", F.row_number().over(w))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("__timestamp")))
            .where(F.col("rn") <= sample_size(F.col("n"), 0.3)))
    assert got == sorted((r["__timestamp"], r.id) for r in ref.collect())
