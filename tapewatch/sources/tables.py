"""Surveillance tables read from the provided star-schema files.

ticks = events, bars = lineitem per supplier and day, cases = orders, users = customer,
notes = conversations, headlines = documents. Each function only selects and renames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{table}.parquet")


def mapped(key: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    """Value of a small fixed dictionary as a CASE expression."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


FEED_OF_EVENT = {"click": "BINANCE", "purchase": "BYBIT", "view": "ALPACA", "error": "YFINANCE", "signup": "FINNHUB"}


def market_of(number: Column) -> Column:
    return F.when(number % 2 == 0, "CRYPTO").otherwise("US_EQUITY")


def ticks_from(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        "event_id", F.concat(F.lit("S"), F.col("user_id")).alias("symbol"),
        market_of(F.col("user_id")).alias("market"), ts.alias("ts"),
        F.unix_millis(ts).alias("timestamp_ms"), F.col("value").alias("price"), k.alias("volume"),
        mapped(F.col("event_type"), FEED_OF_EVENT).alias("source"), "user_id", "event_type",
        F.col("value").alias("close"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return ticks_from(read(spark, folder, "events"))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    nth = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    daily = lines.groupBy("l_suppkey", F.col("l_shipdate").alias("day")).agg(
        F.min_by(price, nth).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, nth).alias("close"), F.sum("l_quantity").alias("volume"))
    ts = F.col("day").cast("timestamp")
    return daily.select(
        market_of(F.col("l_suppkey")).alias("market"), F.concat(F.lit("B"), F.col("l_suppkey")).alias("symbol"),
        ts.alias("ts"), F.floor(F.unix_millis(ts) / 86400000).cast("bigint").alias("day_no"),
        F.col("l_suppkey").alias("user_id"), "open", "high", "low", "close", "volume")


def bar_slicing(spark: SparkSession, folder: str):
    """Slicing of the bars by symbol and ts, measured on the raw lines (never fewer than the bars)."""
    from tapewatch.operators.ordered import measure

    lines = read(spark, folder, "lineitem")
    return measure(lines.select("l_suppkey", F.col("l_shipdate").alias("ts")), ["l_suppkey"], ["ts"])


def bar_series(spark: SparkSession, folder: str):
    """(bars, slicing): bars dealt by symbol to tasks of bounded size, unless a symbol has to be sliced."""
    from tapewatch.operators.ordered import dealt

    found, slicing = bars(spark, folder), bar_slicing(spark, folder)
    if slicing is None:
        found = dealt(found, ["symbol"], read(spark, folder, "lineitem").count())
    return found, slicing


def market_data(spark: SparkSession, folder: str) -> DataFrame:
    """Stored bars of the desk: each tick is a bar with open = high = low = close = price."""
    t = ticks(spark, folder)
    return t.select(F.col("event_id").alias("market_data_id"), "user_id", "symbol", "market", "ts",
                    F.col("price").alias("open"), F.col("price").alias("high"), F.col("price").alias("low"),
                    F.col("price").alias("close"), "volume")


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Stored anomalies: every event but views. Signups carry no pattern scores."""
    e = read(spark, folder, "events").filter(F.col("event_type") != "view")
    k = F.get_json_object("props", "$.k").cast("bigint")
    scores = F.create_map(F.lit("pump_and_dump"), k / 100.0, F.lit("wash_trading"), (k * 7) % 100 / 100.0,
                          F.lit("spoofing"), (k * 13) % 100 / 100.0, F.lit("layering"), (k * 29) % 100 / 100.0)
    has_patterns = F.col("event_type") != "signup"
    if_score = F.lit(0.5) + F.col("value") / 1001
    e = e.withColumn("pattern_scores", F.when(has_patterns, scores)).withColumn("if_score", if_score)
    e = e.withColumn("mp_score", F.array_max(F.map_values("pattern_scores")))
    combined = F.when(F.col("mp_score").isNotNull(), F.round(0.6 * F.col("if_score") + 0.4 * F.col("mp_score"), 4)) \
        .otherwise(F.round(F.col("if_score"), 4))
    return e.select(
        F.col("event_id").alias("anomaly_id"), F.col("event_id").alias("market_data_id"), "user_id",
        F.concat(F.lit("S"), F.col("user_id")).alias("symbol"), market_of(F.col("user_id")).alias("market"),
        F.col("ts").cast("timestamp").alias("detected_at"), "event_type", "if_score", "mp_score", "pattern_scores",
        combined.alias("anomaly_score"), (combined >= 0.7).alias("is_anomaly"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "customer")
    role = F.when(F.col("c_nationkey") == 0, "admin").when(F.col("c_mktsegment") == "BUILDING", "analyst") \
        .otherwise("viewer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), role.alias("role"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    status = (F.when((s == "F") & (p == "5-LOW"), "DISMISSED").when(s == "F", "CLOSED")
              .when((s == "P") & (p == "1-URGENT"), "ESCALATED").when(s == "P", "IN_REVIEW").otherwise("OPEN"))
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    total = F.floor("o_totalprice").cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("created_by"),
        F.when(p != "1-URGENT", F.col("o_custkey")).alias("assigned_to"),
        F.concat(F.lit("Review \""), p, F.lit("\" "), total.cast("string")).alias("title"),
        status.alias("status"), F.timestamp_seconds(created).alias("created_at"),
        F.when(status.isin("CLOSED", "DISMISSED"), F.timestamp_seconds(created + total)).alias("closed_at"),
        F.timestamp_seconds(created + F.floor(total / 2)).alias("updated_at"))


def case_links(spark: SparkSession, folder: str) -> DataFrame:
    l = read(spark, folder, "lineitem")
    return l.select(F.col("l_orderkey").alias("case_id"),
                    (F.col("l_partkey") * 5 + F.col("l_linenumber") % 5).alias("anomaly_id")).distinct()


def case_notes(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "conversations")
    return c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("note_no"), F.col("role").alias("author"),
                    F.col("text").alias("body"))


def case_events(spark: SparkSession, folder: str) -> DataFrame:
    """Status log of a case: one STATUS_CHANGE per line item, in shipping order."""
    l = read(spark, folder, "lineitem")
    target = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "IN_REVIEW")
              .when((F.col("l_returnflag") == "R"), "ESCALATED")
              .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "CLOSED")
              .when((F.col("l_returnflag") == "A"), "DISMISSED").otherwise("OPEN"))
    seq = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"),
                      F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
                      F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), F.col("l_extendedprice").cast("decimal(18,2)"))
    return l.select(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
                    seq.alias("seq"), target.alias("to_status"))


def watchlists(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "customer")
    return c.select(F.col("c_custkey").alias("watchlist_id"), F.col("c_nationkey").cast("bigint").alias("owner_id"),
                    F.col("c_mktsegment").alias("name"),
                    F.timestamp_seconds(F.floor(F.col("c_acctbal") * 100).cast("bigint") + 1000000).alias("created_at"))


def watchlist_symbols(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return o.filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("watchlist_id"),
        F.concat(F.lit("S"), F.col("o_orderkey") % 40).alias("symbol")).distinct()


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """API calls: endpoint path with ids, method, status, duration in seconds."""
    e = read(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("user_id"), F.lit("/items/"), F.col("event_id")).alias("path"),
        F.when(F.col("value") < 100, "POST").otherwise("GET").alias("method"),
        F.when(k < 90, "200").when(k < 97, "404").otherwise("500").alias("status"),
        (F.col("value") / 1000).alias("duration_s"))


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents")
    return d.select("doc_id", "text", "lang", "source")
