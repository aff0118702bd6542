"""Column lists and struct types shared by batch and streaming code."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature order, pattern names and allowed enum values.
PRICE_FEATURES = ["return", "log_return", "rolling_return_5d", "rolling_return_10d", "price_momentum"]
VOLUME_FEATURES = ["volume_ratio_20d", "rolling_volume_mean", "rolling_volume_std", "obv"]
VOLATILITY_FEATURES = ["volatility_20d", "true_range", "atr_14d"]
TREND_FEATURES = ["rsi_14d", "macd"]
FEATURES = PRICE_FEATURES + VOLUME_FEATURES + VOLATILITY_FEATURES + TREND_FEATURES
FEATURE_SCHEMA_VERSION = 2
MIN_HISTORY = 20
LIVE_HISTORY = 100
BATCH_LOOKBACK = 30
ZSCORED = ["return", "volatility_20d"]
ZSCORE_WINDOW = 60
ZSCORE_MIN_ROWS = 20

PATTERNS = ["pump_and_dump", "wash_trading", "spoofing", "layering"]
MARKETS = ["CRYPTO", "US_EQUITY"]
STREAMING_SOURCES = ["BINANCE", "BYBIT", "ALPACA", "FINNHUB"]
SENTIMENT_SOURCES = ["FINNHUB_NEWS", "REDDIT", "GDELT"]
IDENTITY_COLUMNS = ["symbol", "exchange", "market", "asset_id", "ticker"]

TICK = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("notional_value", T.DoubleType()),
    T.StructField("is_buyer_maker", T.BooleanType()),
])

BAR = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("open", T.DecimalType(15, 6)),
    T.StructField("high", T.DecimalType(15, 6)),
    T.StructField("low", T.DecimalType(15, 6)),
    T.StructField("close", T.DecimalType(15, 6)),
    T.StructField("volume", T.DecimalType(20, 2)),
])

EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("triggered", T.BooleanType()),
]))
