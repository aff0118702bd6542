"""Sources, validation and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.series_windows import BAR_FEATURES, rounded
from tapewatch.functions import text as tx
from tapewatch.operators import desk
from tapewatch.session import workspace
from tapewatch.sources import feeds, sinks, validate
from tapewatch.sources import tables as t

NOTIONAL8 = "round(price * volume, 8)"


def _csv_of(spark, df, name):
    path = f"{workspace(spark)}/{name}"
    df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


@query("csv_bars_with_features", "S1",
       f"WITH {BAR_FEATURES} SELECT symbol, epoch_ms(ts) AS ms, {sql.rounded(['return', 'volatility_20d', 'rsi_14d'])} FROM feats WHERE {sql.COMPLETE}")
def csv_bars_with_features(spark, d):
    bars = t.bars(spark, d).select(F.col("ts").alias("date"), "market", "symbol", "close", "volume")
    path = _csv_of(spark, bars, "bars_csv")
    out = feeds.load_bars_csv(spark, path, "date TIMESTAMP, market STRING, symbol STRING, close DOUBLE, volume DOUBLE")
    return out.select("symbol", F.unix_millis("ts").alias("ms"), *rounded(["return", "volatility_20d", "rsi_14d"]))


@query("csv_prices", "S2", f"WITH {sql.BARS} SELECT symbol, epoch_ms(ts) AS ms, close FROM bars")
def csv_prices(spark, d):
    path = _csv_of(spark, t.bars(spark, d).select(F.col("ts").alias("date"), "symbol", "close"), "prices_csv")
    out = feeds.load_prices_csv(spark, path, "date TIMESTAMP, symbol STRING, close DOUBLE")
    return out.select("symbol", F.unix_millis("ts").alias("ms"), "close")


@query("bar_scan", "S3 P11",
       f"""WITH {sql.TICKS} SELECT event_id AS market_data_id, symbol, timestamp_ms, close FROM ticks
       WHERE user_id IN (7, 0) AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'""")
def bar_scan(spark, d):
    out = desk.scan_bars(t.market_data(spark, d), me=7, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return out.select("market_data_id", "symbol", F.unix_millis("ts").alias("timestamp_ms"), "close")


def _raw(spark, d):
    return t.ticks(spark, d).withColumn("message_no", F.col("event_id"))


NORMALISED = "message_no, symbol, timestamp_ms, price, volume, notional_value, is_buyer_maker, parsed"


def _normalised(df):
    return df.select(*NORMALISED.split(", "))


@query("crypto_feed_a", "S6 F4 S4",
       f"""WITH {sql.TICKS} SELECT event_id AS message_no, symbol, timestamp_ms,
        CASE WHEN event_type <> 'error' THEN price END AS price, volume,
        CASE WHEN event_type <> 'error' THEN {NOTIONAL8} END AS notional_value, price > 200 AS is_buyer_maker,
        event_type <> 'error' AS parsed FROM ticks""")
def crypto_feed_a(spark, d):
    raw = _raw(spark, d).select("message_no", F.to_json(F.struct(
        F.col("symbol").alias("s"), F.when(F.col("event_type") != "error", F.col("price").cast("string")).alias("p"),
        F.col("volume").cast("string").alias("q"), F.col("timestamp_ms").alias("T"),
        (F.col("price") > 200).alias("m"))).alias("value"))
    return _normalised(feeds.crypto_a(raw))


@query("crypto_feed_b", "S7",
       f"""WITH {sql.TICKS}, two AS (SELECT *, 0 AS i FROM ticks UNION ALL SELECT *, 1 AS i FROM ticks)
       SELECT event_id AS message_no, symbol, timestamp_ms + i AS timestamp_ms, price + i AS price, volume,
        round((price + i) * volume, 8) AS notional_value, i = 0 AND event_type = 'purchase' AS is_buyer_maker, TRUE AS parsed FROM two""")
def crypto_feed_b(spark, d):
    def trade(i, side):
        return F.struct((F.col("price") + i).cast("string").alias("p"), F.col("volume").cast("string").alias("v"),
                        (F.col("timestamp_ms") + i).alias("T"), side.alias("S"))
    raw = _raw(spark, d).select("message_no", F.to_json(F.struct(
        F.concat(F.lit("publicTrade."), F.col("symbol")).alias("topic"),
        F.array(trade(0, F.when(F.col("event_type") == "purchase", "Sell").otherwise("Buy")),
                trade(1, F.lit(None).cast("string"))).alias("data"))).alias("value"))
    return _normalised(feeds.crypto_b(raw))


@query("equity_feed_a", "S8",
       f"""WITH {sql.TICKS} SELECT event_id AS message_no, symbol, timestamp_ms, price, volume,
        round(price * volume, 6) AS notional_value, CAST(NULL AS BOOLEAN) AS is_buyer_maker, TRUE AS parsed FROM ticks""")
def equity_feed_a(spark, d):
    raw = _raw(spark, d).select("message_no", "symbol", "price", F.col("volume").alias("size"), F.col("ts").alias("timestamp"))
    return _normalised(feeds.equity_a(raw))


@query("equity_feed_b", "S9",
       f"""WITH {sql.TICKS} SELECT event_id AS message_no, symbol, timestamp_ms, price, volume,
        round(price * volume, 6) AS notional_value, CAST(NULL AS BOOLEAN) AS is_buyer_maker, TRUE AS parsed FROM ticks
        WHERE event_type <> 'signup'""")
def equity_feed_b(spark, d):
    raw = _raw(spark, d).select("message_no", F.to_json(F.struct(
        F.when(F.col("event_type") == "signup", "ping").otherwise("trade").alias("type"),
        F.array(F.struct(F.col("price").alias("p"), F.col("symbol").alias("s"), F.col("timestamp_ms").alias("t"),
                         F.col("volume").alias("v"))).alias("data"))).alias("value"))
    return _normalised(feeds.equity_b(raw))


@query("kline_series", "S10 W27",
       f"""WITH {sql.TICKS}, k AS (SELECT symbol, timestamp_ms // 60000 * 60000 AS ms, event_id, close, volume FROM ticks),
       r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ms ORDER BY event_id DESC) AS rn FROM k)
       SELECT symbol, ms AS timestamp_ms, close + 1 AS close, volume FROM r WHERE rn = 1""")
def kline_series(spark, d):
    minute = (F.floor(F.col("timestamp_ms") / 60000) * 60000).cast("string")

    def kline(add):
        c = (F.col("close") + add).cast("string")
        return F.array(minute, c, c, c, c, F.col("volume").cast("string"))
    raw = _raw(spark, d).select("symbol", "message_no", F.to_json(F.array(kline(0), kline(1))).alias("value"))
    return feeds.klines(raw)


def _sentiment(spark, d):
    return t.ticks(spark, d).select("event_id", "symbol", "timestamp_ms", F.round(F.col("price") / 250 - 1, 4).alias("sentiment_score"))


SENTIMENT = "sentiment AS (SELECT event_id, symbol, timestamp_ms, round(price / 250 - 1, 4) AS sentiment_score FROM ticks)"


@query("latest_sentiment", "S11",
       f"""WITH {sql.TICKS}, {SENTIMENT}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms DESC, event_id DESC)
        AS rn FROM sentiment) SELECT symbol, sentiment_score, timestamp_ms FROM r WHERE rn = 1""")
def latest_sentiment(spark, d):
    return sinks.latest_sentiment(_sentiment(spark, d))


def _alerts(spark, d):
    """Alerts on minute stamps, so several alerts share a bar."""
    a = t.ticks(spark, d)
    return a.select("event_id", "user_id", "symbol", "market", F.date_trunc("hour", "ts").alias("ts"), "price", "volume",
                    F.round(F.col("price") / 500, 4).alias("anomaly_score"))


ALERTS = "alerts AS (SELECT event_id, user_id, symbol, market, date_trunc('hour', ts) AS ts, price, volume, round(price / 500, 4) AS anomaly_score FROM ticks)"


@query("alert_bars_persisted", "S12 R11",
       f"""WITH {sql.TICKS}, {ALERTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol, ts ORDER BY event_id) AS rn FROM alerts),
        f AS (SELECT * FROM r WHERE rn = 1), stored AS (SELECT DISTINCT user_id, symbol, ts FROM alerts WHERE anomaly_score >= 0.9)
       SELECT user_id, symbol, epoch_ms(ts) AS ms, price AS open, price AS high, price AS low, price AS close, volume, anomaly_score
       FROM f ANTI JOIN stored USING (user_id, symbol, ts)""")
def alert_bars_persisted(spark, d):
    alerts = _alerts(spark, d)
    key = ["user_id", "symbol", "ts"]
    fresh = sinks.new_keys(sinks.alert_bars(alerts), alerts.filter(F.col("anomaly_score") >= 0.9), key)
    return fresh.select("user_id", "symbol", F.unix_millis("ts").alias("ms"), "open", "high", "low", "close", "volume", "anomaly_score")


@query("newest_alerts", "S13 S14 U6 T-2",
       f"WITH {sql.TICKS} SELECT event_id, symbol, timestamp_ms FROM ticks ORDER BY timestamp_ms DESC, event_id DESC LIMIT 1000")
def newest_alerts(spark, d):
    a = t.ticks(spark, d).select("event_id", "symbol", "timestamp_ms")
    buffered, current = a.filter(F.col("event_id") % 2 == 0), a.filter(F.col("event_id") % 2 == 1)
    return sinks.newest_view(buffered.unionByName(current), [F.col("timestamp_ms").desc(), F.col("event_id").desc()], 1000)


@query("audit_export", "S17 F20 F26 J21",
       f"""WITH {sql.CASES}, {sql.USERS}, {sql.LINKS}, n AS (SELECT case_id, count(*) AS n FROM links GROUP BY case_id),
       l AS (SELECT case_id, concat_ws(',', '"' || case_id || '"', '"' || replace(title, '"', '""') || '"', '"' || status || '"',
        '"' || CASE WHEN assigned_to IS NULL THEN 'System' ELSE coalesce(username, 'User ' || assigned_to) END || '"',
        '"' || coalesce(n, 0) || '"', '"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"',
        '"' || strftime(make_timestamp(closed_s * 1000000), '%Y-%m-%dT%H:%M:%S') || '"',
        '"' || printf('%.2f', ((closed_s - created_s) * 200 + 3600) // 7200 / 100) || '"') AS line
       FROM cases LEFT JOIN users ON assigned_to = user_id LEFT JOIN n USING (case_id) WHERE status IN ('CLOSED', 'DISMISSED'))
       SELECT case_id, line, sha256(line) AS row_sha256 FROM l""")
def audit_export(spark, d):
    return sinks.audit_rows(t.cases(spark, d), t.users(spark, d), t.case_links(spark, d))


@query("audit_digest", "S17 A28")
def audit_digest(spark, d):
    return sinks.export_digest(sinks.audit_rows(t.cases(spark, d), t.users(spark, d), t.case_links(spark, d)))


def _dirty_ticks(spark, d):
    """Every event type breaks another rule."""
    e = t.ticks(spark, d)
    kind = F.col("event_type")
    return e.select(
        F.when((kind != "click") | (F.col("volume") > 50), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")).alias("symbol"), F.lower("market").alias("market"), "source",
        F.when(kind == "error", -F.col("timestamp_ms")).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"),
        F.when(kind == "signup", F.col("price") - 100).otherwise(F.col("price")).alias("price"),
        (F.col("volume") - 5).alias("volume"),
        tx.notional("price", "volume", 8).alias("notional_value"), F.col("event_id").alias("row_no"))


@query("tick_validation", "S18 P1 P9 R3",
       f"""WITH {sql.TICKS} SELECT event_id AS row_no, symbol, concat_ws(',',
         CASE WHEN event_type = 'click' AND volume <= 50 THEN 'event_id' END, CASE WHEN event_type = 'error' THEN 'timestamp_ms' END,
         CASE WHEN event_type = 'signup' AND price - 100 <= 0 THEN 'price' END, CASE WHEN volume - 5 < 0 THEN 'volume' END) AS reasons
       FROM ticks""")
def tick_validation(spark, d):
    out = validate.check_ticks(_dirty_ticks(spark, d))
    return out.select("row_no", "symbol", F.array_join("reasons", ",").alias("reasons"))


@query("sentiment_validation", "S19 F24",
       f"""SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 7 = 0 THEN 'sentiment_score' END,
         CASE WHEN source <> 'src0' THEN 'source' END, CASE WHEN length(text) > 500 THEN 'headline' END) AS reasons,
         length(left(text, 500)) AS cut_length FROM documents""")
def sentiment_validation(spark, d):
    docs = t.read(spark, d, "documents")
    rows = docs.select(
        "doc_id", F.lit(1).cast("bigint").alias("timestamp_ms"), F.concat(F.lit("d"), F.col("doc_id")).alias("symbol"),
        F.when(F.col("n_chars") % 7 == 0, 1.5).otherwise(0.25).alias("sentiment_score"),
        F.when(F.col("source") == "src0", "REDDIT").otherwise(F.col("source")).alias("source"), F.col("text").alias("headline"))
    out = validate.check_sentiment(rows)
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.length(tx.headline("headline")).cast("bigint").alias("cut_length"))


@query("bar_validation", "S20",
       f"""WITH {sql.BARS} SELECT symbol, day_no, concat_ws(',', CASE WHEN open - 1000 <= 0 THEN 'open' END,
        CASE WHEN volume - 30 < 0 THEN 'volume' END, CASE WHEN high < low + 2000 THEN 'high_low' END) AS reasons FROM bars""")
def bar_validation(spark, d):
    b = t.bars(spark, d).withColumns({"open": F.col("open") - 1000, "volume": F.col("volume") - 30, "low": F.col("low") + 2000})
    return validate.check_bars(b).select("symbol", "day_no", F.array_join("reasons", ",").alias("reasons"))


@query("insert_conflicts", "S21",
       f"""WITH {sql.TICKS}, {ALERTS}, k AS (SELECT DISTINCT user_id, symbol, ts FROM alerts WHERE anomaly_score >= 0.9),
       r AS (SELECT a.event_id AS row_no, k.user_id IS NOT NULL AS known, row_number() OVER (PARTITION BY a.user_id, a.symbol, a.ts
        ORDER BY a.event_id) AS rn FROM alerts a LEFT JOIN k ON a.user_id = k.user_id AND a.symbol = k.symbol AND a.ts = k.ts)
       SELECT row_no, CASE WHEN known OR rn > 1 THEN 'conflict' ELSE 'created' END AS status FROM r""")
def insert_conflicts(spark, d):
    alerts = _alerts(spark, d).withColumnRenamed("event_id", "row_no")
    key = ["user_id", "symbol", "ts"]
    return sinks.conflicts(alerts, alerts.filter(F.col("anomaly_score") >= 0.9), key).select("row_no", "status")


@query("content_fingerprint", "A28")
def content_fingerprint(spark, d):
    return desk.fingerprint(t.ticks(spark, d), ["event_id", "symbol", "timestamp_ms", "price", "volume"])
