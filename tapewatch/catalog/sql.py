"""Common table expressions of the DuckDB side, mirroring sources.tables."""

MARKET = "CASE WHEN {0} % 2 = 0 THEN 'CRYPTO' ELSE 'US_EQUITY' END"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

TICKS = f"""ticks AS (SELECT event_id, 'S' || user_id AS symbol, {MARKET.format('user_id')} AS market, ts,
  epoch_us(ts) // 1000 AS timestamp_ms, value AS price, value AS close, CAST({K} AS DOUBLE) AS volume,
  CASE event_type WHEN 'click' THEN 'BINANCE' WHEN 'purchase' THEN 'BYBIT' WHEN 'view' THEN 'ALPACA'
    WHEN 'error' THEN 'YFINANCE' WHEN 'signup' THEN 'FINNHUB' END AS source, user_id, event_type FROM events)"""

BARS = f"""bars AS (SELECT {MARKET.format('l_suppkey')} AS market, 'B' || l_suppkey AS symbol, l_shipdate AS ts,
  epoch_ms(l_shipdate) // 86400000 AS day_no, l_suppkey AS user_id,
  arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY l_suppkey, l_shipdate)"""

ANOMALIES = f"""raw_anomalies AS (SELECT event_id AS anomaly_id, event_id AS market_data_id, user_id,
  'S' || user_id AS symbol, {MARKET.format('user_id')} AS market, ts AS detected_at, event_type, 0.5 + value / 1001 AS if_score,
  CASE WHEN event_type <> 'signup' THEN {K} / 100.0::DOUBLE END AS pump_and_dump,
  CASE WHEN event_type <> 'signup' THEN ({K} * 7) % 100 / 100.0::DOUBLE END AS wash_trading,
  CASE WHEN event_type <> 'signup' THEN ({K} * 13) % 100 / 100.0::DOUBLE END AS spoofing,
  CASE WHEN event_type <> 'signup' THEN ({K} * 29) % 100 / 100.0::DOUBLE END AS layering
  FROM events WHERE event_type <> 'view'),
scored_anomalies AS (SELECT *, greatest(pump_and_dump, wash_trading, spoofing, layering) AS mp_score FROM raw_anomalies),
anomalies0 AS (SELECT *, CASE WHEN mp_score IS NOT NULL THEN round(0.6::DOUBLE * if_score + 0.4::DOUBLE * mp_score, 4)
   ELSE round(if_score, 4) END AS anomaly_score,
  CASE mp_score WHEN pump_and_dump THEN 'pump_and_dump' WHEN wash_trading THEN 'wash_trading'
   WHEN spoofing THEN 'spoofing' WHEN layering THEN 'layering' END AS best_pattern FROM scored_anomalies),
anomalies AS (SELECT *, anomaly_score >= 0.7 AS is_anomaly,
  CASE WHEN anomaly_score >= 0.85 THEN 'CRITICAL' WHEN anomaly_score >= 0.65 THEN 'HIGH'
   WHEN anomaly_score >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN mp_score >= 0.5 THEN upper(replace(best_pattern, '_', ' ')) WHEN mp_score IS NOT NULL THEN 'ANOMALY'
   WHEN anomaly_score >= 0.5 THEN 'UNCLASSIFIED' ELSE 'NORMAL' END AS primary_signal FROM anomalies0)"""

USERS = """users AS (SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_nationkey = 0 THEN 'admin'
  WHEN c_mktsegment = 'BUILDING' THEN 'analyst' ELSE 'viewer' END AS role FROM customer)"""

CASES = """cases AS (SELECT o_orderkey AS case_id, o_custkey AS created_by,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS assigned_to,
  'Review "' || o_orderpriority || '" ' || CAST(floor(o_totalprice) AS BIGINT) AS title,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'DISMISSED' WHEN o_orderstatus = 'F' THEN 'CLOSED'
   WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'ESCALATED' WHEN o_orderstatus = 'P' THEN 'IN_REVIEW'
   ELSE 'OPEN' END AS status, o_orderdate AS created_at, epoch_ms(o_orderdate) // 1000 AS created_s,
  CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) // 1000 + CAST(floor(o_totalprice) AS BIGINT) END AS closed_s,
  epoch_ms(o_orderdate) // 1000 + CAST(floor(o_totalprice) AS BIGINT) // 2 AS updated_s FROM orders)"""

LINKS = "links AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey * 5 + l_linenumber % 5 AS anomaly_id FROM lineitem)"

NOTES = "notes AS (SELECT conv_id AS case_id, turn AS note_no, role AS author, text AS body FROM conversations)"

CASE_EVENTS = """case_events AS (SELECT l_orderkey AS case_id, l_shipdate AS created_at,
  lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' ||
  lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS seq,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'IN_REVIEW' WHEN l_returnflag = 'R' THEN 'ESCALATED'
   WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CLOSED' WHEN l_returnflag = 'A' THEN 'DISMISSED'
   ELSE 'OPEN' END AS to_status FROM lineitem)"""

WATCHLISTS = """watchlists AS (SELECT c_custkey AS watchlist_id, CAST(c_nationkey AS BIGINT) AS owner_id, c_mktsegment AS name,
  CAST(floor(c_acctbal * 100) AS BIGINT) + 1000000 AS created_s FROM customer),
watchlist_symbols AS (SELECT DISTINCT o_custkey AS watchlist_id, 'S' || (o_orderkey % 40) AS symbol FROM orders
  WHERE o_orderstatus = 'P')"""

REQUESTS = f"""requests AS (SELECT event_id, ts, '/' || event_type || '/{{id}}/items/{{id}}' AS endpoint,
  CASE WHEN value < 100 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN {K} < 90 THEN '200' WHEN {K} < 97 THEN '404' ELSE '500' END AS status, value / 1000 AS duration_s FROM events)"""


def features(src: str, order: str, out: str = "feats", high_low: bool = False) -> str:
    """The fourteen features over ``src``; EMA by folding the whole prefix."""
    tr = "greatest(high - low, abs(high - c1), abs(low - c1))" if high_low else "abs(close - c1)"
    part = "PARTITION BY market, symbol ORDER BY " + order
    return f"""{out}_0 AS (SELECT *, row_number() OVER w AS pos, lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5,
  lag(close, 10) OVER w AS c10 FROM {src} WINDOW w AS ({part})),
{out}_1 AS (SELECT *, close / nullif(c1, 0) - 1 AS "return", ln(close / nullif(c1, 0)) AS log_return,
  close / nullif(c5, 0) - 1 AS rolling_return_5d, close / nullif(c10, 0) - 1 AS rolling_return_10d,
  close - c10 AS price_momentum, {tr} AS true_range,
  CASE WHEN close - c1 > 0 THEN close - c1 ELSE 0 END AS gn, CASE WHEN close - c1 < 0 THEN c1 - close ELSE 0 END AS ls
  FROM {out}_0),
{out}_2 AS (SELECT *, avg(volume) OVER w20 AS rolling_volume_mean,
  CASE WHEN count(volume) OVER w20 >= 2 THEN stddev_samp(volume) OVER w20 END AS rolling_volume_std,
  CASE WHEN count("return") OVER w20 >= 2 THEN stddev_samp("return") OVER w20 * sqrt(252) END AS volatility_20d,
  CASE WHEN count(true_range) OVER w14 >= 2 THEN avg(true_range) OVER w14 END AS atr_14d,
  CASE WHEN count(gn) OVER w14 >= 2 THEN avg(gn) OVER w14 END AS g, CASE WHEN count(ls) OVER w14 >= 2 THEN avg(ls) OVER w14 END AS l,
  sum(sign(coalesce("return", 0)) * volume) OVER w AS obv, list(close) OVER w AS xs FROM {out}_1
  WINDOW w AS ({part} ROWS UNBOUNDED PRECEDING), w20 AS ({part} ROWS 19 PRECEDING), w14 AS ({part} ROWS 13 PRECEDING)),
{out} AS (SELECT * EXCLUDE (xs, c1, c5, c10, gn, ls, g, l), volume / nullif(rolling_volume_mean, 0) AS volume_ratio_20d,
  CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi_14d,
  CASE WHEN pos >= 26 THEN list_reduce(xs, lambda a, b: a * (1 - 2.0::DOUBLE / 13) + b * (2.0::DOUBLE / 13))
    - list_reduce(xs, lambda a, b: a * (1 - 2.0::DOUBLE / 27) + b * (2.0::DOUBLE / 27)) END AS macd FROM {out}_2)"""


def zscores(src: str, order: str, out: str = "zfeats") -> str:
    part = "PARTITION BY market, symbol ORDER BY " + order + " ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING"
    cols = ", ".join(
        f"""CASE WHEN count("{c}") OVER w >= 20 THEN ("{c}" - avg("{c}") OVER w) / greatest(stddev_samp("{c}") OVER w, 1e-8)
  END AS "{c}_z\"""" for c in ("return", "volatility_20d"))
    return f"{out} AS (SELECT *, {cols} FROM {src} WINDOW w AS ({part}))"


FEATURES = ["return", "log_return", "rolling_return_5d", "rolling_return_10d", "price_momentum", "volume_ratio_20d",
            "rolling_volume_mean", "rolling_volume_std", "obv", "volatility_20d", "true_range", "atr_14d", "rsi_14d",
            "macd"]
COMPLETE = " AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES)


# Added before rounding on both sides, so that exact decimal ties cannot round apart.
NUDGE = 0.037


def r(expression: str, digits: int = 5) -> str:
    return f"round({expression} + {NUDGE * 10 ** -digits:.3e}, {digits})"


def rounded(columns=FEATURES, digits: int = 5) -> str:
    quoted = [(c, f'"{c}"') for c in columns]
    return ", ".join(f"{r(q, digits)} AS {q}" for _, q in quoted)


def evidence(if_score: str | None = None, mp_score: str | None = None) -> str:
    """Names of the triggered signals joined by commas."""
    parts = [
        ('abs("return") > 0.02', "high_return"), ("abs(log_return) > 0.02", "high_log_return"),
        ("abs(rolling_return_5d) > 0.05", "high_rolling_return_5d"),
        ("abs(rolling_return_10d) > 0.10", "high_rolling_return_10d"),
        ("abs(price_momentum) > 0.05", "high_price_momentum"), ("volume_ratio_20d > 1.5", "volume_ratio_20d_spike"),
        ("volatility_20d > 0.05", "high_volatility_20d"), ("rsi_14d > 70", "rsi_14d_overbought"),
        ("rsi_14d < 30", "rsi_14d_oversold"),
    ]
    if if_score:
        parts.append((f"{if_score} > 0.65", "isolation_forest_outlier"))
    if mp_score:
        parts.append((f"{mp_score} > 0.65", "multi_pattern_classifier"))
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in parts) + ")"
