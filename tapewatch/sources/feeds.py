"""Raw exchange messages to unified ticks, kline arrays and CSV files to series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.text import event_id, notional
from tapewatch.operators import ordered as o
from tapewatch.operators.features import complete, engineered_features
from tapewatch.schemas import TICK

# Field names of the raw messages.
CRYPTO_A = "s STRING, p STRING, q STRING, T BIGINT, m BOOLEAN"
CRYPTO_B = "topic STRING, data ARRAY<STRUCT<p: STRING, v: STRING, T: BIGINT, S: STRING>>"
EQUITY_B = "type STRING, data ARRAY<STRUCT<p: DOUBLE, s: STRING, t: BIGINT, v: DOUBLE>>"


def _unified(df: DataFrame, source: str, market: str, digits: int) -> DataFrame:
    """symbol, price, volume, timestamp_ms, is_buyer_maker → tick columns plus the parse flag."""
    price, volume = F.col("price").try_cast("double"), F.col("volume").try_cast("double")
    out = df.withColumns({"price": price, "volume": volume})
    return out.withColumns({
        "event_id": event_id(F.lit(source), "symbol", "timestamp_ms", "price", "volume", "message_no"),
        "source": F.lit(source), "market": F.lit(market),
        "notional_value": notional("price", "volume", digits),
        "parsed": F.col("symbol").isNotNull() & F.col("timestamp_ms").isNotNull() & F.col("price").isNotNull()
        & F.col("volume").isNotNull(),
    }).select(*TICK.fieldNames(), "message_no", "parsed")


def crypto_a(raw: DataFrame) -> DataFrame:
    """``value`` = one aggregate trade per message."""
    m = raw.withColumn("m", F.from_json("value", CRYPTO_A))
    return _unified(m.select("message_no", F.col("m.s").alias("symbol"), F.col("m.p").alias("price"),
                             F.col("m.q").alias("volume"), F.col("m.T").alias("timestamp_ms"),
                             F.col("m.m").alias("is_buyer_maker")), "BINANCE", "CRYPTO", 8)


def crypto_b(raw: DataFrame) -> DataFrame:
    """One message holds many trades; the symbol is the last part of the topic."""
    m = raw.withColumn("m", F.from_json("value", CRYPTO_B))
    m = m.select("message_no", F.element_at(F.split("m.topic", r"\."), -1).alias("symbol"),
                 F.explode("m.data").alias("d"))
    return _unified(m.select("message_no", "symbol", F.col("d.p").alias("price"), F.col("d.v").alias("volume"),
                             F.col("d.T").alias("timestamp_ms"),
                             F.coalesce(F.col("d.S") == "Sell", F.lit(False)).alias("is_buyer_maker")),
                    "BYBIT", "CRYPTO", 8)


def equity_a(trades: DataFrame) -> DataFrame:
    """Trade objects with symbol, timestamp, price and size; the feed has no maker side."""
    return _unified(trades.select("message_no", "symbol", "price", F.col("size").alias("volume"),
                                  F.unix_millis("timestamp").alias("timestamp_ms"),
                                  F.lit(None).cast("boolean").alias("is_buyer_maker")), "ALPACA", "US_EQUITY", 6)


def equity_b(raw: DataFrame) -> DataFrame:
    """Only messages of type 'trade' carry data."""
    m = raw.withColumn("m", F.from_json("value", EQUITY_B)).filter(F.col("m.type") == "trade")
    m = m.select("message_no", F.explode("m.data").alias("d"))
    return _unified(m.select("message_no", F.col("d.s").alias("symbol"), F.col("d.p").alias("price"),
                             F.col("d.v").alias("volume"), F.col("d.t").alias("timestamp_ms"),
                             F.lit(None).cast("boolean").alias("is_buyer_maker")), "FINNHUB", "US_EQUITY", 6)


def klines(raw: DataFrame) -> DataFrame:
    """Arrays [open time, o, h, l, c, v, …] to (symbol, timestamp_ms, close, volume); last duplicate wins."""
    rows = raw.select("symbol", "message_no", F.posexplode(F.from_json("value", "ARRAY<ARRAY<STRING>>")).alias("n", "k"))
    flat = rows.select("symbol", "message_no", "n", F.get("k", 0).cast("bigint").alias("timestamp_ms"),
                       F.get("k", 4).cast("double").alias("close"), F.get("k", 5).cast("double").alias("volume"))
    last = o.first_per_key(flat, ["symbol", "timestamp_ms"], [-F.col("message_no"), -F.col("n")])
    return last.select("symbol", "timestamp_ms", "close", "volume")


def latest_duplicate(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Of rows with the same key, the one that arrived last."""
    return o.first_per_key(df, keys, [-F.col(arrival)])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").schema(schema).csv(path)


def _date_column(df: DataFrame) -> str:
    return "date" if "date" in df.columns else df.columns[0]


def _required(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"CSV lacks columns {missing}")


def load_bars_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV bars of many symbols with features, rows with an unknown feature dropped.

    The date column is ``date`` or else the first one; close and volume must exist.
    """
    df = read_csv(spark, path, schema)
    _required(df, ["close", "volume"])
    df = df.withColumn("ts", F.col(_date_column(df)).cast("timestamp"))
    by = [c for c in ("market", "symbol") if c in df.columns]
    return complete(engineered_features(df, by=by, order=["ts"]))


def load_prices_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = read_csv(spark, path, schema)
    _required(df, ["close"])
    by = [c for c in ("market", "symbol") if c in df.columns]
    return df.select(*by, F.col(_date_column(df)).cast("timestamp").alias("ts"), "close").filter(F.col("close").isNotNull())
