"""Series operators against direct computations on whole series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import series as se


def ar1(n, phi, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    return x


SERIES = {
    "walk": np.cumsum(np.random.default_rng(140).normal(size=500)),
    "noise": np.random.default_rng(200).normal(size=500),
    "ar": ar1(300, 0.7, 144),
    "ma": (lambda e: e[1:] + 0.6 * e[:-1])(np.random.default_rng(145).normal(size=301)),
    "trend": 0.5 * np.arange(200) + np.random.default_rng(1).normal(size=200),
}


@pytest.fixture(scope="module")
def table(spark):
    start = dt.datetime(2023, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), float(v)) for k, x in SERIES.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP, close DOUBLE").repartition(5).cache()


def direct_adf(x):
    def fit(lags, skip):
        d = np.diff(x)
        t = np.arange(skip, len(d))
        cols = [np.ones(len(t)), x[t]] + [d[t - i] for i in range(1, lags + 1)]
        z = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(z, d[t], rcond=None)
        sse = ((d[t] - z @ beta) ** 2).sum()
        return z, beta, sse
    limit = se._max_lag(len(x))
    best = min(range(limit + 1), key=lambda k: (lambda z, b, s: len(z) * math.log(s) + 2 * z.shape[1])(*fit(k, limit)))
    z, beta, sse = fit(best, best)
    se_ = math.sqrt(sse / (len(z) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    return beta[1] / se_, best


def test_adf_equals_direct_regression(table):
    got = {r.symbol: r for r in se.adf(table).collect()}
    for name, x in SERIES.items():
        tau, lag = direct_adf(x)
        assert got[name].used_lag == lag
        assert abs(got[name].statistic - tau) < 1e-6 * max(1, abs(tau))
    assert got["noise"].is_stationary and not got["walk"].is_stationary


def direct_kpss(x):
    e, n = x - x.mean(), len(x)
    k = int(n ** (2 / 9))
    prods = [e[i:] @ e[:-i] / (n / 2) for i in range(1, k + 1)]
    s0, s1 = e @ e / n + sum(prods), sum((i + 1) * p for i, p in enumerate(prods))
    lag = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = (e @ e + 2 * sum((1 - i / (lag + 1)) * (e[i:] @ e[:-i]) for i in range(1, lag + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n ** 2 / long_run


def test_kpss_equals_direct_sums(table):
    got = {r.symbol: r for r in se.kpss(table).collect()}
    for name, x in SERIES.items():
        assert abs(got[name].statistic - direct_kpss(x)) < 1e-8
    assert got["noise"].is_stationary and not got["trend"].is_stationary


def test_verdicts(table):
    got = {r.symbol: r.verdict for r in se.combined_verdict(table).collect()}
    assert got["noise"] == "confidently_stationary" and got["walk"] == "confidently_non_stationary"
    d = {r.symbol: r.d for r in se.recommended_difference(table).collect()}
    assert d["noise"] == 0 and d["walk"] == 1


def test_signatures(table):
    got = {r.symbol: r.signature for r in se.ar_or_ma(se.acf_pacf(table, lags=15)).collect()}
    assert got["ar"] == "AR-like" and got["ma"] == "MA-like"


def test_pacf_first_lags(table):
    got = {r.symbol: r for r in se.acf_pacf(table, lags=5).collect()}
    x = SERIES["ar"] - SERIES["ar"].mean()
    n = len(x)
    g = [x[k:] @ x[:n - k] / (n - k) for k in range(3)]
    r1, r2 = g[1] / g[0], g[2] / g[0]
    np.testing.assert_allclose(got["ar"].pacf[1:3], [r1, (r2 - r1 ** 2) / (1 - r1 ** 2)], rtol=1e-9)


def test_ar_recovers_coefficients(table):
    got = {r.symbol: r.coefficients for r in se.fit_ar(table, p=2).collect()}
    x = SERIES["ar"]
    z = np.column_stack([np.ones(len(x) - 2), x[1:-1], x[:-2]])
    np.testing.assert_allclose(got["ar"], np.linalg.lstsq(z, x[2:], rcond=None)[0], rtol=1e-8)


def test_forecast_beats_nothing_and_covers(table):
    split = se.chronological_split(table, 0.1).cache()
    f = se.arima_forecast(split.filter("part = 'train'"), 50, (1, 0, 1))
    assert f.groupBy("symbol").count().filter("count = 50").count() == len(SERIES)
    rows = se.horizon_rows(split).join(f, ["symbol", "step"]).filter("symbol = 'noise'")
    inside = rows.agg(F.avg(((F.col("actual") > F.col("lower")) & (F.col("actual") < F.col("upper"))).cast("int"))).first()[0]
    assert inside > 0.85


@pytest.mark.parametrize("d", [1, 2])
def test_forecast_of_plain_differences(table, d):
    x = SERIES["trend"]
    rows = se.arima_forecast(table.filter("symbol = 'trend'"), 3, (0, d, 0)).orderBy("step").collect()
    slope = x[-1] - x[-2] if d == 2 else 0.0
    np.testing.assert_allclose([r.forecast for r in rows], [x[-1] + slope * (i + 1) for i in range(3)], rtol=1e-9)
    assert all(r.lower < r.forecast < r.upper for r in rows)


def test_order_grid(table):
    grid = se.grid_search(table, [0, 1, 2], [0], [0, 1]).cache()
    assert grid.groupBy("symbol").count().filter("count = 6").count() == len(SERIES)
    best = {r.symbol: r for r in se.best_order(grid).collect()}
    assert best["noise"].p + best["noise"].q <= 1 and best["ar"].p >= 1
    with pytest.raises(RuntimeError):
        se.best_order(grid.limit(0))


def test_trend_forecast(table):
    split = se.chronological_split(table.filter("symbol = 'trend'"), 0.1)
    rows = se.trend_season_forecast(split, scales=(0.001, 0.5)).toPandas()
    rigid = rows[rows["scale"] == 0.001]
    assert np.sqrt(((rigid["actual"] - rigid["forecast"]) ** 2).mean()) < 5
    assert rigid["n_changepoints"].max() <= rows[rows["scale"] == 0.5]["n_changepoints"].max()


def test_event_signal(spark):
    rows = [("a", i, 1.0 + 0.1 * (i % 3) + (8.0 if 10 <= i < 17 else 0)) for i in range(30)] + [("flat", i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol STRING, step INT, error DOUBLE")
    got = {r.symbol: r for r in se.event_signal(df, (10, 17), [(0, 10), (17, 30)]).collect()}
    assert got["a"].strength == "clear" and got["flat"].strength == "no_variance"
    with pytest.raises(ValueError):
        se.event_signal(df, (10, 17), [])


def test_folds_never_look_ahead(table):
    f = se.expanding_folds(table, 4).groupBy("symbol", "fold").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).toPandas()
    for _, g in f.groupby("symbol"):
        g = g.assign(fold=g["fold"].fillna(-1)).sort_values("fold")
        assert (g["lo"].to_numpy()[1:] > g["hi"].to_numpy()[:-1]).all() and g["n"].sum() == len(SERIES[_])


def test_cross_products_hold_few_series_at_a_time(spark, monkeypatch):
    rows = spark.range(600).select(F.concat(F.lit("S"), F.col("id") % 40).alias("symbol"), (F.col("id") % 17).cast("double").alias("v"))

    def sums():
        xx = se.cross_products(rows, ["symbol"], ["v"], lambda c: np.column_stack([c[0], np.ones(len(c[0]))]), 2)
        return {r.symbol: r.xx for r in xx.collect()}

    whole = sums()
    monkeypatch.setattr(se, "HELD_CELLS", 8)  # two series
    assert sums() == whole and len(whole) == 40
