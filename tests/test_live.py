"""Streams over many files equal the batch result, and repeated input adds nothing."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.catalog.scoring import fixed_forest
from tapewatch.functions import text as tx
from tapewatch.operators import features as ft
from tapewatch.plans.registry import MarketModels
from tapewatch.schemas import FEATURES, TICK
from tapewatch.session import cut, workspace
from tapewatch.sources import tables as t
from tapewatch.streaming import live, state


@pytest.fixture(scope="module")
def folder(spark, data):
    """Ticks as JSON in three files in time order, a broken line among them."""
    path = workspace(spark) + "/in"
    x = t.ticks(spark, data).withColumn("notional_value", tx.notional("price", "volume", 8)).withColumn("is_buyer_maker", F.lit(None).cast("boolean"))
    x = x.withColumn("event_id", F.col("event_id").cast("string")).select(*TICK.fieldNames())
    edges = x.approxQuantile("timestamp_ms", [0.33, 0.66], 0.01)
    for i, cond in enumerate([F.col("timestamp_ms") < edges[0], F.col("timestamp_ms").between(edges[0], edges[1] - 1), F.col("timestamp_ms") >= edges[1]]):
        lines = x.filter(cond).orderBy("timestamp_ms", "event_id").select(F.to_json(F.struct(*TICK.fieldNames())).alias("value"))
        if i == 1:
            lines = lines.unionByName(spark.createDataFrame([('{"event_id": "broken"',)], "value STRING"))
        lines.coalesce(1).write.mode("append").text(path)
    return path


def run_features(spark, folder):
    stream = live.read_tick_files(spark, folder, files_per_trigger=1)
    valid, _ = live.checked(stream)
    return live.drain(live.tick_features(valid), workspace(spark) + "/out")


def test_stream_equals_batch(spark, folder, data):
    got = run_features(spark, folder).toPandas().set_index("event_id").sort_index()
    want = ft.engineered_features(t.ticks(spark, data), lookback=99).withColumn("event_id", F.col("event_id").cast("string"))
    want = want.select("event_id", *FEATURES).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(want)
    for f in FEATURES:
        a, b = got[f].astype(float), want[f].astype(float)
        assert ((a - b).abs().fillna(0) < 1e-6 * (1 + b.abs().fillna(0))).all() and (a.isna() == b.isna()).all(), f


def test_broken_lines_become_dead_letters(spark, folder):
    dead = live.drain(live.dead_letters(live.read_tick_files(spark, folder)), workspace(spark) + "/dead")
    assert dead.count() == 1 and "symbol" in dead.first().reasons


def test_replay_adds_nothing(spark, folder):
    root = workspace(spark) + "/live"
    models = [MarketModels("CRYPTO", forest=fixed_forest())]
    live.start_detection(live.read_tick_files(spark, folder), models, None, root, threshold=0.86, available_now=True).awaitTermination()
    first = spark.read.parquet(f"{root}/alerts")
    rows = cut(first.drop("day", "batch_id"))  # a copy, since the sink rewrites the files behind ``first``
    days = [r.day for r in first.select("day").distinct().collect()]
    stored = live._stored(spark, f"{root}/alerts", rows.schema, days[:1], -1)
    assert all(f"day={days[0]}" in f for f in stored.inputFiles()) and stored.count() == first.filter(F.col("day") == days[0]).count()
    n, bars, batch = first.count(), spark.read.parquet(f"{root}/anomalies").count(), first.select("batch_id").first().batch_id
    assert n > 0 and bars > 0
    sink = live.persist_and_publish(root)
    sink(rows, batch)          # the same batch again
    sink(rows, batch + 1000)   # the same ticks in a later batch
    assert spark.read.parquet(f"{root}/alerts").count() == n
    assert spark.read.parquet(f"{root}/anomalies").count() == bars


def plain_features(ms, close, volume, i):
    """Features of row i by pandas over its own history of 100 rows, rows of one time replaced by the last."""
    last = {}
    for k in range(max(0, i - 99), i + 1):
        last[ms[k]] = (close[k], volume[k])
    x = pd.DataFrame([last[k] for k in sorted(last)], columns=["c", "v"])
    c, v = x.c, x.v
    ret = (c / c.shift(1) - 1).where(c.shift(1) != 0)
    mean, step = v.rolling(20, min_periods=1).mean(), c.diff()
    tr = step.abs()
    gain, loss = step.clip(lower=0).fillna(0).rolling(14, min_periods=2).mean(), (-step).clip(lower=0).fillna(0).rolling(14, min_periods=2).mean()
    g, l = gain.iloc[-1], loss.iloc[-1]
    rsi = math.nan if math.isnan(g) else 50 if g == l == 0 else 100 if l == 0 else 100 - 100 / (1 + g / l)
    ema = [c.ewm(span=s, adjust=False).mean().iloc[-1] for s in (12, 26)]

    def back(k, f):
        return f(c.iloc[-1], c.iloc[-1 - k]) if len(c) > k else math.nan

    rate = lambda a, b: a / b - 1 if b else math.nan
    return len(x), [
        back(1, rate), back(1, lambda a, b: math.log(a / b) if a > 0 and b > 0 else math.nan), back(5, rate), back(10, rate), back(10, lambda a, b: a - b),
        v.iloc[-1] / mean.iloc[-1] if mean.iloc[-1] else math.nan, mean.iloc[-1], v.rolling(20, min_periods=2).std().iloc[-1], (np.sign(ret.fillna(0)) * v).sum(),
        ret.rolling(20, min_periods=2).std().iloc[-1] * math.sqrt(252), tr.iloc[-1], tr.rolling(14, min_periods=2).mean().iloc[-1], rsi,
        ema[0] - ema[1] if len(c) >= 26 else math.nan]


def test_window_features_equal_pandas():
    rnd = np.random.default_rng(8)
    ms = np.cumsum(rnd.integers(0, 3, 260))  # many rows of one time
    close, volume = np.round(rnd.uniform(0, 5, 260), 1), np.round(rnd.uniform(0, 3, 260), 0)
    volume[40:70] = 0
    at = np.arange(260)
    count, got = state.window_features(ms, close, volume, at)
    for i in at:
        n, want = plain_features(ms, close, volume, i)
        assert n == count[i] and np.allclose(got[i], want, equal_nan=True, atol=1e-9), (i, got[i], want)


def test_notices_wait_for_the_gap(spark):
    root = workspace(spark)
    runs = [[("a", 0), ("a", 0), ("a", 299_000), ("a", 300_000), ("b", 5), (None, 1), ("b", None)], [("a", 300_001), ("a", 100), ("a", 600_000), ("b", 300_005)],
            [("a", 600_002), ("a", 300_001), ("b", 300_006)]]
    for rows in runs:
        spark.createDataFrame(rows, "scope string, timestamp_ms long").repartition(3).write.mode("append").parquet(f"{root}/in")
        events = spark.readStream.schema(state.NOTICE).parquet(f"{root}/in")
        got = live.drain(state.throttled_notices(events, "scope"), f"{root}/out")
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("a", 300_001), ("a", 600_002), ("b", 5), ("b", 300_006)]


def test_late_and_repeated_ticks(spark):
    root = workspace(spark)
    schema = "event_id string, symbol string, market string, source string, timestamp_ms long, price double, volume double, reasons array<string>"

    def tick(i, ms, reasons=()):
        return (f"e{i}", "S", "CRYPTO", "BINANCE", ms, 10.0 + i, 1.0, list(reasons))

    runs = [[tick(i, 1_000_000 * i) for i in range(1, 6)] + [tick(99, -1, ["price", "market"])],
            [tick(4, 4_000_000), tick(7, 4_500_000), tick(8, 4_300_000), tick(9, 6_000_000)]]  # a redelivery, a tick out of order, a late one
    scores = [[("m1", "S", 1_500_000, 0.5)], [("m2", "S", 4_400_000, -0.25), ("m3", "S", 9_000_000, 1.0)]]
    for rows, moods in zip(runs, scores):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{root}/in")
        spark.createDataFrame(moods, "event_id string, symbol string, timestamp_ms long, sentiment_score double").write.mode("append").parquet(f"{root}/moods")
        ticks = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        moods = spark.readStream.schema(spark.read.parquet(f"{root}/moods").schema).parquet(f"{root}/moods")
        got = live.drain(state.live_rows(ticks, moods), f"{root}/out").collect()
    feats = {r.event_id: r for r in got if r.kind == "features"}
    assert sorted((r.event_id, r.reason) for r in got if r.kind == "quarantine") == [("e8", "late"), ("e99", "price,market")]
    assert sorted(feats) == ["e1", "e2", "e3", "e4", "e5", "e7", "e9"] and len(got) == 9
    assert [feats[f"e{i}"].sentiment_score for i in (1, 2, 7, 9)] == [0.0, 0.5, -0.25, -0.25] and feats["e1"].sentiment_ms is None
    assert feats["e7"].history == 5 and feats["e9"].history == 7 and abs(feats["e9"]["return"] - (19 / 15 - 1)) < 1e-12
