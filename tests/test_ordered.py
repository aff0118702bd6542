"""Sliced evaluation of hot groups equals the plain windows; quantiles and time joins equal brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import features as ft
from tapewatch.operators import joins
from tapewatch.operators import ordered as o
from tapewatch.operators import series as se

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    """One symbol with most of the rows, bursts of equal times included."""
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in (("HOT", 2600), ("A", 300), ("B", 20)):
        seconds = np.sort(rng.integers(0, 40_000, n))
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            rows.append((len(rows), "CRYPTO", symbol, START + dt.timedelta(seconds=int(seconds[i])), float(close[i]), float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "event_id BIGINT, market STRING, symbol STRING, ts TIMESTAMP, close DOUBLE, volume DOUBLE").cache()


def same(a, b, keys, tolerance=1e-9):
    x = a.toPandas().sort_values(keys).reset_index(drop=True)
    y = b.toPandas().sort_values(keys).reset_index(drop=True)[x.columns]
    pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=tolerance, atol=1e-9)


def test_measure_splits_only_hot_groups(ticks):
    assert o.measure(ticks, ["symbol"], ["ts"], rows=5000) is None
    s = o.measure(ticks, ["symbol"], ["ts"], rows=512)
    bucket = F.floor((F.unix_micros("ts") - s.origin) / s.width)
    assert ticks.groupBy("symbol", bucket).count().agg(F.max("count")).first()[0] <= 512


def test_positions(ticks):
    s = o.measure(ticks, ["symbol"], ["ts"], rows=512)
    a = o.numbered(ticks, ["symbol"], ["ts", "event_id"], slicing=None, total="n")
    b = o.numbered(ticks, ["symbol"], ["ts", "event_id"], slicing=s, total="n")
    same(a, b, ["event_id"])


def test_features_in_slices(ticks):
    plain = ft.engineered_features(ticks, slicing=None)
    cut = ft.engineered_features(ticks, slicing=o.measure(ticks, ["market", "symbol"], ["ts"], rows=512))
    assert cut.count() == ticks.count()
    same(plain, cut, ["event_id"], 1e-7)


@pytest.mark.parametrize("make", [
    lambda d, s: ft.wilder_rsi(d, slicing=s), lambda d, s: ft.sma_bollinger(d, slicing=s),
    lambda d, s: se.seasonal_comparison(d, 12, order=["ts", "event_id"], slicing=s),
    lambda d, s: se.stationarity_violations(d, order=["ts", "event_id"], slicing=s),
    lambda d, s: se.acf_pacf(d, lags=5, order=["ts", "event_id"], slicing=s).select("symbol", "n", F.get("acf", 3).alias("a"), F.get("pacf", 2).alias("p")),
    lambda d, s: se.differenced(d, "close", 2, order=["ts", "event_id"], slicing=s),
    lambda d, s: se.kpss(d, order=["ts", "event_id"], slicing=s),
], ids=["wilder", "bollinger", "seasonal", "halves", "acf", "difference", "kpss"])
def test_sliced_operators(ticks, make):
    s = o.measure(ticks, ["symbol"], ["ts"], rows=600)
    a, b = make(ticks, None), make(ticks, s)
    keys = ["event_id"] if "event_id" in a.columns else ["symbol"]
    same(a, b, keys, 1e-6)


def test_quantiles_with_ties_and_skewed_values(spark):
    x = np.concatenate([np.repeat(0.5, 700), np.random.default_rng(1).exponential(1, 311) ** 4])
    df = spark.createDataFrame([(float(v),) for v in x], "v DOUBLE").repartition(7)
    got = o.quantiles(df, "v", {"a": 0.0, "b": 0.33, "c": 0.95, "d": 1.0}, rows=16).first()
    np.testing.assert_allclose([got.a, got.b, got.c, got.d], np.quantile(x, [0, 0.33, 0.95, 1]), rtol=1e-12)


def test_asof_sliced(ticks):
    left = ticks.filter("event_id % 3 = 0").select("symbol", "event_id", "ts")
    right = ticks.filter("event_id % 7 = 0").groupBy("symbol", "ts").agg(F.max("close").alias("close"))
    for forward in (False, True):
        def run(s):
            return joins.asof(left, right, ["symbol"], "ts", "close", "found", forward=forward, **s).select(
                "event_id", F.col("found.value").alias("v"))
        same(run({"slicing": None}), run({"rows": 300}), ["event_id"])


def test_asof_ties_do_not_depend_on_partitions(spark):
    left = spark.createDataFrame([("a", START + dt.timedelta(seconds=5))], "symbol STRING, ts TIMESTAMP")
    right = spark.createDataFrame([("a", START, i, float(1000 - i)) for i in range(1000)], "symbol STRING, ts TIMESTAMP, id INT, close DOUBLE")
    for parts in (1, 3, 7):
        for s in ({"slicing": None}, {"rows": 100}):
            rows = right.repartition(parts)
            assert joins.asof(left, rows, ["symbol"], "ts", "close", "f", tie=["id"], **s).first().f.value == 1.0
            assert joins.asof(left, rows, ["symbol"], "ts", "close", "f", **s).first().f.value == 1000.0


def test_failover_by_hand(spark):
    rows = [(1, 0, "B"), (2, 10, "P"), (3, 35, "B"), (4, 41, "B"), (5, 41, "P"), (6, 71, "B"), (7, 72, "B")]
    df = spark.createDataFrame([(i, START + dt.timedelta(seconds=s), c) for i, s, c in rows], "event_id BIGINT, ts TIMESTAMP, source STRING")
    kept = [r.event_id for r in joins.failover(df, "P", "B").orderBy("event_id").collect()]
    assert kept == [2, 4, 5, 7]


def test_active_count(ticks):
    out = joins.active_count(ticks.select("event_id", "ts"), "ts", 15).toPandas().sort_values("event_id")
    at = out["ts"].to_numpy().astype("datetime64[us]").astype("int64")
    brute = [int(((at > t - 15_000_000) & (at <= t)).sum()) for t in at]
    assert out["active"].tolist() == brute


def test_newest_and_first(ticks):
    last = o.newest(ticks, ["symbol"], ["ts", "event_id"], 3, rank="k")
    assert last.count() == 9 and last.filter("k = 1").count() == 3
    one = o.first_per_key(ticks, ["symbol"], [-F.col("event_id")])
    assert sorted(r.event_id for r in one.collect()) == [2599, 2899, 2919]


def test_one_outlier_does_not_fill_a_bin(spark):
    """10,000 close values and one far away: every bin keeps to its bound, and ranks and quantiles are exact."""
    rows = spark.range(10_000).select(F.lit("g").alias("g"), (F.sqrt("id") / 1000).alias("v")).unionAll(
        spark.createDataFrame([("g", 1e12), ("h", 3.0)], "g string, v double"))
    binned = o.value_bins(rows, ["g"], "v", rows=100, ways=8)
    sizes = binned.groupBy("g", "_bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "lo").collect()
    assert max(r.n for r in sizes) <= 100 and sum(r.n for r in sizes) == 10_002
    for a, b in zip(sizes, sizes[1:]):
        assert a.g != b.g or (a._bin < b._bin and a.hi < b.lo)
    ranked = o.cumulative_by_value(rows.withColumn("n", F.lit(1)), ["g"], "v", ["n"], rows=100)
    got = [r.n_before for r in ranked.filter("g = 'g'").orderBy("v").collect()]
    assert got == list(range(10_001)) and {r.n_total for r in ranked.collect()} == {10_001, 1}
    q = o.quantiles(rows.filter("g = 'g'"), "v", {"half": 0.5, "top": 0.9999}, rows=100).first()
    assert abs(q.half - 5000 ** 0.5 / 1000) < 1e-12 and abs(q.top - 9999 ** 0.5 / 1000) < 1e-12


def test_tasks_of_windows_stay_small(spark, monkeypatch):
    """Many small groups: the number of tasks follows the rows, whatever the shuffle setting, and no value changes."""
    rows = spark.range(3000).select(
        F.col("id").alias("event_id"), F.lit("CRYPTO").alias("market"), F.concat(F.lit("S"), F.col("id") % 100).alias("symbol"),
        F.timestamp_seconds(F.col("id")).alias("ts"), (100 + F.col("id") * 7 % 13).cast("double").alias("close"), (F.col("id") % 11).cast("double").alias("volume"))
    plain = ft.engineered_features(rows)
    expected = plain.toPandas()
    monkeypatch.setattr(o, "TASK_ROWS", 200)
    assert o.surveyed(rows, ["symbol"], ["ts"]) == (None, 3000)
    small = ft.engineered_features(rows)
    per_task = small.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols")).collect()
    assert len(per_task) > 4 and sum(r.n for r in per_task) == 3000 and sum(r.symbols for r in per_task) == 100
    same(small, spark.createDataFrame(expected), ["event_id"])


def test_bars_are_dealt_by_their_lines(spark, data, monkeypatch):
    monkeypatch.setattr(o, "TASK_ROWS", 500)
    from tapewatch.sources import tables as t

    series, slicing = t.bar_series(spark, data)
    lines = t.read(spark, data, "lineitem").count()
    assert slicing is None and series.rdd.getNumPartitions() >= lines / 500
    same(series, t.bars(spark, data), ["symbol", "ts"])
