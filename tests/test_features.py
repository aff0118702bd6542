"""Features against pandas."""

import datetime as dt

import numpy as np
import pandas as pd

from tapewatch.operators import features as ft
from tapewatch.schemas import FEATURES
from tapewatch.streaming.state import window_features


def frame(n=400, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0.02, 1, n))
    volume = rng.lognormal(3, 0.3, n)
    volume[10:40] = 0.0
    return pd.DataFrame({"ts": [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)], "close": close, "volume": volume})


def expected(df):
    c, v = df["close"], df["volume"]
    out = pd.DataFrame(index=df.index)
    out["return"] = c.pct_change()
    out["rolling_return_5d"] = c.pct_change(5)
    out["volume_ratio_20d"] = v / v.rolling(20, min_periods=1).mean().replace(0, np.nan)
    out["rolling_volume_std"] = v.rolling(20, min_periods=2).std()
    out["volatility_20d"] = out["return"].rolling(20, min_periods=2).std() * np.sqrt(252)
    out["obv"] = (np.sign(out["return"].fillna(0)) * v).cumsum()
    out["atr_14d"] = c.diff().abs().rolling(14, min_periods=2).mean()
    out["macd"] = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    return out


def test_against_pandas(spark):
    df = frame()
    s = spark.createDataFrame(df.assign(market="CRYPTO", symbol="A"))
    got = ft.engineered_features(s, order=["ts"]).toPandas().sort_values("ts").reset_index(drop=True)
    want = expected(df)
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-8, atol=1e-9, err_msg=c)
    flat = got["rsi_14d"].dropna()
    assert flat.between(0, 100).all()


def test_single_history_equals_batch(spark):
    df = frame(100, 9)
    s = spark.createDataFrame(df.assign(market="CRYPTO", symbol="A"))
    got = ft.engineered_features(s, order=["ts"]).toPandas().sort_values("ts").iloc[[0, 1, 5, 24, 25, 99]]
    for at, row in zip([0, 1, 5, 24, 25, 99], got[FEATURES].to_numpy(dtype=float)):
        _, rows = window_features(np.arange(at + 1), df["close"].to_numpy()[:at + 1], df["volume"].to_numpy()[:at + 1], np.array([at]))
        mine = [None if np.isnan(v) else v for v in rows[0]]
        np.testing.assert_allclose(np.array([np.nan if v is None else v for v in mine]), row, rtol=1e-8, atol=1e-9)


def test_constant_prices(spark):
    df = frame(40)
    df["close"] = 10.0
    s = spark.createDataFrame(df.assign(market="CRYPTO", symbol="A"))
    got = ft.engineered_features(s, order=["ts"]).toPandas().sort_values("ts")
    assert (got["rsi_14d"].iloc[1:] == 50).all() and got["obv"].eq(0).all() and got["macd"].iloc[25:].abs().max() < 1e-9


def test_zscore_ignores_current_row(spark):
    df = frame(120)
    df.loc[100, "close"] *= 3
    s = spark.createDataFrame(df.assign(market="CRYPTO", symbol="A"))
    z = ft.rolling_zscores(ft.engineered_features(s, order=["ts"]), order=["ts"]).toPandas().sort_values("ts").reset_index(drop=True)
    r = expected(df)["return"]
    mean, std = r.rolling(60, min_periods=20).mean().shift(1), r.rolling(60, min_periods=20).std().shift(1)
    np.testing.assert_allclose(z["return_z"].astype(float), (r - mean) / std, rtol=1e-7)
    assert z["return_z"].iloc[100] > 20
