"""Chunked ordered operators against plain windows, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from silverbrook.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(7)
    base = dt.datetime(2024, 1, 1)
    data = [
        (i, "hot" if random.random() < 0.7 else f"k{random.randrange(5)}",
         base + dt.timedelta(minutes=random.randrange(20000)), random.randrange(100))
        for i in range(1500)
    ]
    return spark.createDataFrame(data, "id bigint, k string, ts timestamp_ntz, v int")


def same(a, b):
    key = lambda r: str(sorted(r.asDict().items()))
    assert sorted(a.collect(), key=key) == sorted(b.select(*a.columns).collect(), key=key)


DAY = lambda: F.date_trunc("day", "ts")


def test_running_total(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.running_total(skewed, ["k"], ["ts", "id"], F.col("v"), DAY(), "t"),
         skewed.withColumn("t", F.sum("v").over(w)))


def test_previous_value(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id")
    same(ordered.previous_value(skewed, ["k"], ["ts", "id"], "v", DAY(), "p"), skewed.withColumn("p", F.lag("v").over(w)))


def test_row_numbers(skewed):
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    same(ordered.row_numbers(skewed, ["k"], ["v"], ["id"], "n"), skewed.withColumn("n", F.row_number().over(w)))


def test_asof_join(skewed):
    left = skewed.filter("id % 2 = 0").select("id", "k", "ts")
    right = skewed.filter("id % 2 = 1").select("k", "ts", F.col("id").alias("rid"))
    got = ordered.asof_join(left, right, ["k"], "ts", ["rid"], lambda ts: F.date_trunc("day", ts))
    r = right.select(F.col("k").alias("rk"), F.col("ts").alias("rts"), "rid")
    best = left.join(r, (F.col("k") == F.col("rk")) & (F.col("rts") <= F.col("ts")), "left").groupBy("id", "k", "ts").agg(
        F.max(F.struct("rts", "rid")).alias("b")).select("id", "k", "ts", F.col("b.rts").alias("asof_ts"),
                                                         F.col("b.rid").alias("asof_rid"))
    same(got, best)


def test_range_join(skewed):
    points = skewed.select("k", "ts", "id")
    ranges = skewed.filter("v < 10").select(
        "k", F.col("ts").alias("s"), F.expr("ts + INTERVAL 5 HOUR").alias("e"), F.col("id").alias("rid"))
    got = ordered.range_join(points, ranges, ["k"], "ts", "s", "e").select("id", "rid")
    plain = points.join(ranges.withColumnRenamed("k", "rk"), F.expr("k = rk AND ts >= s AND ts < e")).select("id", "rid")
    same(got, plain)
    assert got.count() > 100


def nulls(spark):
    rows = [(None, None, 1), (None, 1, 2), (None, 5, None), ("a", None, None), ("a", 1, 4), ("a", 3, None), ("a", 12, 6),
            ("b", 2, None), ("b", 30, None), ("b", 31, 7)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, at int, v int")


def test_running_total_with_nulls(spark):
    df = nulls(spark)
    got = ordered.running_total(df, ["k"], ["at", "i"], F.col("v"), F.floor(F.col("at") / 10), "total")
    want = df.withColumn("total", F.expr("sum(v) OVER (PARTITION BY k ORDER BY at, i ROWS UNBOUNDED PRECEDING)"))
    assert sorted(got.select(want.columns).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_previous_value_and_row_numbers_with_nulls(spark):
    df = nulls(spark)
    got = ordered.previous_value(df, ["k"], ["at", "i"], "v", F.floor(F.col("at") / 10), "p")
    want = df.withColumn("p", F.expr("lag(v) OVER (PARTITION BY k ORDER BY at, i)"))
    assert sorted(got.select(want.columns).collect(), key=repr) == sorted(want.collect(), key=repr)
    got = ordered.row_numbers(df, ["k"], ["v"], ["i"], "n")
    want = df.withColumn("n", F.expr("row_number() OVER (PARTITION BY k ORDER BY v DESC, i)"))
    assert sorted((r.i, r.n) for r in got.collect()) == sorted((r.i, r.n) for r in want.collect())


def test_asof_join_keeps_every_left_row(spark):
    left = nulls(spark).select("i", "k", "at")
    right = spark.createDataFrame([("a", 0, 10), ("a", 2, 11), (None, 1, 12), ("a", None, 13), ("b", 29, None)], "k string, at int, v int")
    got = {r.i: (r.asof_at, r.asof_v) for r in ordered.asof_join(
        left, right, ["k"], "at", ["v"], lambda at: F.floor(at / 10)).collect()}
    assert got == {0: (None, None), 1: (None, None), 2: (None, None), 3: (None, None), 4: (0, 10), 5: (2, 11), 6: (2, 11),
                   7: (None, None), 8: (29, None), 9: (29, None)}


def test_ranges_from_microseconds_to_centuries(spark):
    rng, zero = random.Random(8), dt.datetime(1969, 12, 31, 23, 0)
    points = [(i, rng.choice("ab"), zero + dt.timedelta(microseconds=rng.choice([rng.randrange(10**7), rng.randrange(10**13)])))
              for i in range(300)] + [(900, None, zero), (901, "a", None)]
    ranges = []
    for i in range(200):
        s = zero + dt.timedelta(microseconds=rng.randrange(10**rng.randrange(3, 14)))
        ranges.append((i, rng.choice("ab"), s, s + dt.timedelta(microseconds=rng.randrange(10**rng.randrange(1, 16)))))
    ranges += [(900, "a", zero, zero), (901, "a", zero, zero - dt.timedelta(1)), (902, "a", None, zero), (903, None, zero, None)]
    p = spark.createDataFrame(points, "id int, k string, ts timestamp_ntz")
    r = spark.createDataFrame(ranges, "rid int, k string, s timestamp_ntz, e timestamp_ntz")
    got = ordered.range_join(p, r, ["k"], "ts", "s", "e").select("id", "rid").collect()
    want = [(i, j) for i, k, t in points for j, h, s, e in ranges if k and t and k == h and s and e and s <= t < e]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000
    assert ordered.range_join(p, r.limit(0), ["k"], "ts", "s", "e").count() == 0


def test_quantiles_of_hot_tied_and_null_values(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([1.5, rng.random(), -3.0])) for _ in range(5000)] + [("one", 7.0), (None, 2.0), (None, 4.0)]
    rows += [("gone", None), ("hot", None), ("two", 1.0), ("two", None), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: tuple(r)[1:] for r in ordered.quantiles(df, ["k"], "v", ps).collect()}

    def plain(values, p):
        values, at = sorted(values), (len(values) - 1) * p
        low, high = values[int(at)], values[-int(-at // 1)]
        return low if low == high else low * (1 - (at - int(at))) + high * (at - int(at))

    for key in ("hot", "one", "two", None):
        values = [v for k, v in rows if k == key and v is not None]
        assert got[key] == tuple(plain(values, p) for p in ps.values()), key
    assert got["gone"] == (None,) * 5 and len(got) == 5
    assert ordered.quantiles(df.limit(0), ["k"], "v", ps).count() == 0
