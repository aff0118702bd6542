"""Streams run over the available events; results must equal their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.edges import SENTIMENT, _sentiment
from tapewatch.catalog.scoring import FIXED_FEATURES, FIXED_SCORE, fixed_forest
from tapewatch.catalog.series_windows import rounded
from tapewatch.functions import text as tx
from tapewatch.operators import desk
from tapewatch.operators import features as ft
from tapewatch.operators.patterns import Scorecard
from tapewatch.plans.registry import MarketModels
from tapewatch.schemas import FEATURES
from tapewatch.session import cut, workspace
from tapewatch.sources import tables as t
from tapewatch.streaming import live, state


def event_stream(spark, d):
    schema = t.read(spark, d, "events").schema
    return live.read_tick_files(spark, d, schema, "parquet", pathGlobFilter="events.parquet")


def tick_stream(spark, d):
    x = t.ticks_from(event_stream(spark, d))
    return x.select(F.col("event_id").cast("string").alias("event_id"), "symbol", "market", "source", "timestamp_ms", "price", "volume",
                    tx.notional("price", "volume", 8).alias("notional_value"), F.lit(None).cast("boolean").alias("is_buyer_maker"))


@query("live_features", "R1 R2 S4 S18",
       f"""WITH {sql.TICKS}, {sql.features('ticks', 'ts, event_id')} SELECT CAST(event_id AS VARCHAR) AS event_id, symbol, CAST(pos AS INT) AS history,
        {sql.rounded([f for f in FEATURES])} FROM feats""")
def live_features(spark, d):
    valid, _ = live.checked(tick_stream(spark, d))
    out = live.drain(live.tick_features(valid), f"{workspace(spark)}/features")
    return out.select("event_id", "symbol", "history", *rounded())


LIVE_SCORED = f"""{sql.TICKS}, {sql.features('ticks', 'ts, event_id')},
  ready AS (SELECT * FROM feats WHERE pos >= 20 AND {sql.COMPLETE} AND market = 'CRYPTO'), scored AS (SELECT *, round({FIXED_SCORE}, 4) AS score FROM ready)"""


def _detected(spark, d):
    root = f"{workspace(spark)}/live"
    models = [MarketModels("CRYPTO", forest=fixed_forest(), trained_at="fixed")]
    live.start_detection(tick_stream(spark, d), models, None, root, threshold=0.86, available_now=True).awaitTermination()
    return root


@query("live_alerts", "E7 R2 R5 S12 S13 P7 P10 J8",
       f"""WITH {LIVE_SCORED}, a AS (SELECT CAST(event_id AS VARCHAR) AS event_id, symbol, timestamp_ms, score AS anomaly_score,
         CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(NULL AS VARCHAR) AS coverage
         FROM scored WHERE score >= 0.86)
       SELECT * FROM a""")
def live_alerts(spark, d):
    return spark.read.parquet(f"{_detected(spark, d)}/alerts").select("event_id", "symbol", "timestamp_ms", "anomaly_score", "severity", "coverage")


@query("live_stored_anomalies", "E7 R5 R11 S12",
       f"""WITH {LIVE_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp_ms ORDER BY event_id) AS k FROM scored WHERE score >= 0.86)
       SELECT symbol, timestamp_ms, price AS open, price AS high, price AS low, price AS close, volume, score AS anomaly_score FROM r WHERE k = 1""")
def live_stored_anomalies(spark, d):
    out = spark.read.parquet(f"{_detected(spark, d)}/anomalies")
    return out.select("symbol", "timestamp_ms", "open", "high", "low", "close", "volume", "anomaly_score")


@query("live_dead_letters", "R3 P9 S4",
       f"WITH {sql.TICKS} SELECT CAST(event_id AS VARCHAR) AS event_id, 'market' AS reasons FROM ticks WHERE event_type = 'error'")
def live_dead_letters(spark, d):
    x = t.ticks_from(event_stream(spark, d)).withColumn("market", F.when(F.col("event_type") != "error", F.col("market")))
    x = x.withColumns({"event_id": F.col("event_id").cast("string"), "notional_value": tx.notional("price", "volume", 8)})
    out = live.drain(live.dead_letters(x.drop("ts")), f"{workspace(spark)}/dead")
    return out.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("live_watchlist", "R6 J3",
       f"""WITH {sql.TICKS}, {sql.WATCHLISTS} SELECT CAST(event_id AS VARCHAR) AS event_id, symbol FROM ticks WHERE price > 20 AND symbol IN
        (SELECT symbol FROM watchlist_symbols JOIN watchlists USING (watchlist_id) WHERE owner_id = 3)""")
def live_watchlist(spark, d):
    watched = desk.watched_symbols(t.watchlists(spark, d), t.watchlist_symbols(spark, d), 3)
    alerts = tick_stream(spark, d).filter("price > 20")
    return live.drain(live.watchlist_feed(alerts, watched).select("event_id", "symbol"), f"{workspace(spark)}/watch")


@query("live_sentiment", "S11 R4",
       f"""WITH {sql.TICKS}, {SENTIMENT}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms DESC, event_id DESC) AS rn FROM sentiment)
       SELECT symbol, sentiment_score, timestamp_ms FROM r WHERE rn = 1""")
def live_sentiment(spark, d):
    x = t.ticks_from(event_stream(spark, d)).select("event_id", "symbol", "timestamp_ms", F.round(F.col("price") / 250 - 1, 4).alias("sentiment_score"))
    return live.drain_updates(live.latest_sentiment(x), f"{workspace(spark)}/sentiment", ["symbol"], "timestamp_ms")


# The times at which the live job is stopped and started again, and the weights of its classifier.
STEPS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]
GAP_MS = 300_000


def _step(at):
    """0, 1 or 2: the run of the job in which a row arrives."""
    ms = [F.unix_millis(F.to_timestamp(F.lit(b))) for b in STEPS]
    return F.when(at < ms[0], 0).when(at < ms[1], 1).otherwise(2)


def gap_rule(src: str, out: str) -> str:
    """Recursive SQL over ``src`` (scope, ms): a notice, then the first event more than GAP_MS later, and so on."""
    return f"""{out}_next AS MATERIALIZED (SELECT a.scope, a.ms, b.ms AS later FROM {src} a ASOF JOIN {src} b ON a.scope = b.scope AND a.ms + {GAP_MS} < b.ms),
  {out} AS (SELECT scope, min(ms) AS ms FROM {src} GROUP BY scope UNION ALL SELECT n.scope, n.later FROM {out} r JOIN {out}_next n ON n.scope = r.scope AND n.ms = r.ms)"""


@query("live_notices", "R7",
       f"""WITH RECURSIVE {sql.TICKS}, events_of AS MATERIALIZED (SELECT DISTINCT market AS scope, timestamp_ms AS ms FROM ticks), {gap_rule('events_of', 'sent')}
       SELECT scope, ms AS timestamp_ms FROM sent""")
def live_notices(spark, d):
    """At most one notice per market in five minutes, over three runs of the stream."""
    root = f"{workspace(spark)}/notices"
    x = t.ticks(spark, d).select("market", "timestamp_ms")
    for k in range(3):
        x.filter(_step(F.col("timestamp_ms")) == k).write.mode("append").parquet(f"{root}/in")
        out = live.drain(state.throttled_notices(spark.readStream.schema(x.schema).parquet(f"{root}/in"), "market", gap_ms=GAP_MS), f"{root}/out")
    return out


# --- the whole job -----------------------------------------------------------

CLASSIFIER = {
    "pump_and_dump": {"": -2.0, "return": 0.8, "volume_ratio_20d": 0.9},
    "wash_trading": {"": -1.5, "volume_ratio_20d": 1.1, "volatility_20d": -0.4},
    "spoofing": {"": -3.0, "rsi_14d": 0.04, "volatility_20d": 0.3},
    "layering": {"": -1.0, "return": -0.6, "rsi_14d": -0.02},
}


def fixed_classifier() -> Scorecard:
    return Scorecard(FIXED_FEATURES, CLASSIFIER)


Z_NAMES = {"return": "z_return", "volatility_20d": "z_volatility"}
Z_FOREST = FIXED_SCORE.replace('"return"', "z_return").replace('"volatility_20d"', "z_volatility")


def _logit(weights: dict[str, float]) -> str:
    return " + ".join([f"{weights['']!r}::DOUBLE", *[f"{w!r}::DOUBLE * {Z_NAMES.get(f, f)}" for f, w in weights.items() if f]])


def explained(src: str, model: str = "market = 'CRYPTO' AND has_baseline") -> str:
    """SQL of forest, classifier, combined score and labels of ``src`` with z_return, z_volatility and has_baseline, as table ``s``."""
    names = list(CLASSIFIER)
    probabilities = ", ".join(f"CASE WHEN {model} THEN 1 / (1 + exp(-({_logit(w)}))) END AS {p}" for p, w in CLASSIFIER.items())
    best = " ".join(f"WHEN {p} = mp_score THEN '{p.upper().replace('_', ' ')}'" for p in names)
    return f"""p0 AS (SELECT *, CASE WHEN {model} THEN {Z_FOREST} END AS if_score, {probabilities} FROM {src}),
  p1 AS (SELECT *, greatest({', '.join(names)}) AS mp_score FROM p0),
  p2 AS (SELECT *, round(0.6::DOUBLE * if_score + 0.4::DOUBLE * mp_score, 4) AS score FROM p1),
  s AS (SELECT *, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS severity,
    CASE WHEN mp_score IS NULL THEN 'NORMAL' WHEN mp_score >= 0.5 THEN CASE {best} END ELSE 'ANOMALY' END AS signal FROM p2)"""


BASELINES = """kept AS (SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY ts DESC, event_id DESC) AS back FROM {feats} WHERE {complete}),
  base AS (SELECT market, symbol, avg("return") AS rm, greatest(stddev_samp("return"), 1e-8) AS rs, avg(volatility_20d) AS vm, greatest(stddev_samp(volatility_20d), 1e-8) AS vs
    FROM kept WHERE back <= 60 GROUP BY market, symbol HAVING count(*) >= 20)"""

HELD_BACK = "event_id % 97 = 5 AND ts < TIMESTAMP '2024-01-15'"
BROKEN = "event_type = 'signup' AND user_id % 7 = 0"
LIVE_JOB = f"""{sql.TICKS},
  sent_in AS (SELECT * EXCLUDE (source), {HELD_BACK} AS held, {BROKEN} AS bad, CASE WHEN event_type = 'error' THEN 'YFINANCE' WHEN user_id % 2 = 0 THEN
    CASE WHEN event_id % 2 = 0 THEN 'BINANCE' ELSE 'BYBIT' END ELSE CASE WHEN event_id % 2 = 0 THEN 'ALPACA' ELSE 'FINNHUB' END END AS source FROM ticks),
  newest AS (SELECT symbol, max(timestamp_ms) AS ms FROM sent_in WHERE NOT held AND NOT bad AND ts < TIMESTAMP '{STEPS[1]}' GROUP BY symbol),
  placed AS (SELECT i.*, held AND NOT bad AND timestamp_ms < coalesce(n.ms, 0) - 600000 AS late FROM sent_in i LEFT JOIN newest n USING (symbol)),
  good AS (SELECT * FROM placed WHERE NOT bad AND NOT late),
  {sql.features('good', 'ts, event_id')}, {sql.features('ticks', 'ts, event_id', 'all_feats')}, {BASELINES.format(feats='all_feats', complete=sql.COMPLETE)},
  mood AS (SELECT symbol, timestamp_ms - 3600000 AS ms, round(price / 250 - 1, 4) AS mood FROM ticks WHERE event_type = 'view'),
  ready AS (SELECT f.*, coalesce(m.mood, 0) AS mood FROM feats f ASOF LEFT JOIN mood m ON f.symbol = m.symbol AND f.timestamp_ms >= m.ms WHERE pos >= 20 AND {sql.COMPLETE}),
  z AS (SELECT r.*, ("return" - rm) / rs AS z_return, (volatility_20d - vm) / vs AS z_volatility, rs IS NOT NULL AS has_baseline FROM ready r
    LEFT JOIN (SELECT * FROM base WHERE CAST(substr(symbol, 2) AS BIGINT) % 10 <> 4) b ON b.symbol = r.symbol),
  {explained('z')},
  off AS MATERIALIZED (SELECT DISTINCT CASE WHEN market <> 'CRYPTO' THEN market ELSE 'baseline_' || symbol END AS scope, timestamp_ms AS ms FROM s
    WHERE source <> 'YFINANCE' AND (market <> 'CRYPTO' OR NOT has_baseline)),
  {gap_rule('off', 'sent')}"""


def _messages(spark, d, root: str) -> None:
    """The ticks as raw messages of five feeds and sentiment rows, one folder per run of the job. Some messages lack a price, and
    some early ticks come with the last run."""
    x = t.ticks(spark, d)
    held = (F.col("event_id") % 97 == 5) & (F.col("timestamp_ms") < F.unix_millis(F.to_timestamp(F.lit("2024-01-15 00:00:00"))))
    x = x.withColumn("step", F.when(held, 2).otherwise(_step(F.col("timestamp_ms"))))
    x = x.withColumn("price", F.when(~((F.col("event_type") == "signup") & (F.col("user_id") % 7 == 0)), F.col("price")))
    crypto, even, polled = F.col("market") == "CRYPTO", F.col("event_id") % 2 == 0, F.col("event_type") == "error"
    price, volume = F.col("price").cast("string"), F.col("volume").cast("string")
    at = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    shapes = {
        "binance": (crypto & even & ~polled, F.struct(F.col("symbol").alias("s"), price.alias("p"), volume.alias("q"), F.col("timestamp_ms").alias("T"), F.lit(False).alias("m"))),
        "bybit": (crypto & ~even & ~polled, F.struct(F.concat(F.lit("publicTrade."), "symbol").alias("topic"), F.array(F.struct(
            price.alias("p"), volume.alias("v"), F.col("timestamp_ms").alias("T"), F.lit("Buy").alias("S"))).alias("data"))),
        "alpaca": (~crypto & even & ~polled, F.struct("symbol", "price", F.col("volume").alias("size"), at.alias("timestamp"))),
        "finnhub": (~crypto & ~even & ~polled, F.struct(F.lit("trade").alias("type"), F.array(F.struct(
            F.col("price").alias("p"), F.col("symbol").alias("s"), F.col("timestamp_ms").alias("t"), F.col("volume").alias("v"))).alias("data"))),
        "unified": (polled, F.struct(F.concat(F.lit("Y"), "event_id").alias("event_id"), "symbol", "market", F.lit("YFINANCE").alias("source"), "timestamp_ms", "price", "volume",
                                     F.round(F.col("price") * F.col("volume"), 8).alias("notional_value"))),
    }
    for name, (own, message) in shapes.items():
        x.filter(own).select("step", F.to_json(message).alias("value")).write.partitionBy("step").text(f"{root}/{name}")
    moods = x.filter("event_type = 'view'").select(F.concat(F.lit("m"), "event_id").alias("event_id"), "symbol", (F.col("timestamp_ms") - 3600000).alias("timestamp_ms"),
                                                   F.round(F.col("close") / 250 - 1, 4).alias("sentiment_score"))
    moods.withColumn("step", _step(F.col("timestamp_ms"))).write.partitionBy("step").parquet(f"{root}/sentiment")


FEEDS = ["binance", "bybit", "alpaca", "finnhub", "unified"]


def run_live_job(spark, d) -> str:
    """Feeds, sentiment, forest, classifier, baselines and notices, started three times on the same checkpoint; the folder of its outputs."""
    root = f"{workspace(spark)}/job"
    _messages(spark, d, f"{root}/all")
    have = ft.complete(ft.engineered_features(t.ticks(spark, d), order=["ts", "event_id"]))
    baselines = ft.trailing_baselines(have, order=["ts", "event_id"]).filter(F.substring("symbol", 2, 20).cast("bigint") % 10 != 4)
    baselines = cut(baselines.dropna(), "baselines")
    models = [MarketModels("CRYPTO", forest=fixed_forest(), detector=fixed_classifier(), trained_at="fixed")]
    moods = "event_id STRING, symbol STRING, timestamp_ms BIGINT, sentiment_score DOUBLE"
    for k in range(3):
        for name in [*FEEDS, "sentiment"]:
            rows = spark.read.schema(moods).parquet(f"{root}/all/{name}/step={k}") if name == "sentiment" else spark.read.text(f"{root}/all/{name}/step={k}")
            rows.write.mode("append").format("parquet" if name == "sentiment" else "text").save(f"{root}/in/{name}")
        raw = {name: spark.readStream.text(f"{root}/in/{name}") for name in FEEDS}
        sentiment = spark.readStream.schema(moods).parquet(f"{root}/in/sentiment")
        live.run_live(spark, live.feed_ticks(**raw), models, baselines, f"{root}/out", sentiment=sentiment, threshold=0.6, gap_ms=GAP_MS)
    return f"{root}/out"


@query("live_job", "E7 R1 R2 R3 R4 R5 R7 R11 P9 S4 S6 S7 S8 S9 J7",
       f"""WITH RECURSIVE {LIVE_JOB}
       SELECT 'alert' AS output, symbol AS scope, timestamp_ms, score, severity || ' ' || signal || ' ' || CAST(CAST(mood AS DECIMAL(10, 4)) AS VARCHAR) AS detail FROM s WHERE score >= 0.6
       UNION ALL SELECT 'anomaly', symbol, timestamp_ms, max(score), any_value(severity) FROM s WHERE score >= 0.6 GROUP BY symbol, timestamp_ms
       UNION ALL SELECT 'notice', scope, ms, NULL, NULL FROM sent
       UNION ALL SELECT 'quarantine', symbol, timestamp_ms, NULL, CASE WHEN bad THEN 'price,notional_value' ELSE 'late' END FROM placed WHERE bad OR late""")
def live_job(spark, d):
    """All outputs of one live job: alerts with sentiment, stored anomalies, notices and quarantine."""
    root = run_live_job(spark, d)
    none = F.lit(None)
    alerts, stored = (spark.read.parquet(f"{root}/{name}") for name in ("alerts", "anomalies"))
    notices, aside = spark.read.schema(state.NOTICE).parquet(f"{root}/notices"), spark.read.parquet(f"{root}/quarantine")
    said = F.concat_ws(" ", "severity", "primary_signal", F.col("sentiment_score").cast("decimal(10,4)").cast("string"))
    return (alerts.select(F.lit("alert").alias("output"), F.col("symbol").alias("scope"), "timestamp_ms", F.col("anomaly_score").alias("score"), said.alias("detail"))
            .unionAll(stored.select(F.lit("anomaly"), "symbol", "timestamp_ms", "anomaly_score", "severity"))
            .unionAll(notices.select(F.lit("notice"), "scope", "timestamp_ms", none.cast("double"), none.cast("string")))
            .unionAll(aside.select(F.lit("quarantine"), "symbol", "timestamp_ms", none.cast("double"), "reason")))


@query("live_failover", "R10 J15",
       f"""WITH {sql.TICKS}, p AS (SELECT DISTINCT ts AS pts FROM ticks WHERE source = 'BINANCE' UNION SELECT min(ts) FROM ticks),
       s AS (SELECT t.*, p.pts FROM ticks t ASOF LEFT JOIN p ON t.ts >= p.pts)
       SELECT event_id, source FROM s WHERE source = 'BINANCE' OR (source = 'BYBIT' AND epoch_us(ts) - epoch_us(pts) > 30000000)""")
def live_failover(spark, d):
    root = f"{workspace(spark)}/failover"
    x = t.ticks_from(event_stream(spark, d)).select("event_id", "symbol", "ts", "source", "price")
    (x.writeStream.option("checkpointLocation", f"{root}/_checkpoint").foreachBatch(live.failover_batch(root, "BINANCE", "BYBIT"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/ticks").select("event_id", "source")


@query("live_rate", "R9 W33")
def live_rate(spark, d):
    x = t.ticks_from(event_stream(spark, d)).select("ts")
    return live.drain(live.alert_rate(x), f"{workspace(spark)}/rate")


@query("live_throughput", "A38 S4")
def live_throughput(spark, d):
    q = live.write_stream(tick_stream(spark, d).select("event_id"), f"{workspace(spark)}/through")
    q.awaitTermination()
    return live.throughput(q)
