"""Windowed features, indicators and ordered-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.operators import features as ft
from tapewatch.operators import ordered as o
from tapewatch.schemas import FEATURES
from tapewatch.sources import tables as t

TICK_FEATURES = sql.TICKS + ", " + sql.features("ticks", "ts, event_id")
BAR_FEATURES = sql.BARS + ", " + sql.features("bars", "ts")


def rounded(columns=FEATURES, digits=5):
    return [F.round(F.col(c) + F.lit(float(f"{sql.NUDGE * 10 ** -digits:.3e}")), digits).alias(c) for c in columns]


def bar_features(spark, d, **kw):
    series, slicing = t.bar_series(spark, d)
    return ft.engineered_features(series, order=["ts"], slicing=slicing, **kw)


@query("tick_features", "W1 W2 W3 W4 W5 W6 W7 W8 W9 W10 W11 W12 W13 W14",
       f"WITH {TICK_FEATURES} SELECT event_id, symbol, {sql.rounded()} FROM feats")
def tick_features(spark, d):
    return ft.engineered_features(t.ticks(spark, d)).select("event_id", "symbol", *rounded())


@query("market_feature_table", "S16 U1 W1 W14",
       f"WITH {BAR_FEATURES} SELECT market, symbol, day_no, {sql.rounded()} FROM feats WHERE {sql.COMPLETE}")
def market_feature_table(spark, d):
    return ft.complete(bar_features(spark, d)).select("market", "symbol", "day_no", *rounded())


@query("high_low_true_range", "W11 W12",
       f"""WITH {sql.BARS}, {sql.features('bars', 'ts', high_low=True)}
       SELECT symbol, day_no, {sql.rounded(["true_range", "atr_14d"])} FROM feats""")
def high_low_true_range(spark, d):
    return bar_features(spark, d, use_high_low=True).select("symbol", "day_no", *rounded(["true_range", "atr_14d"]))


@query("trailing_history_features", "J9 W9 W14 R1",
       f"""WITH {sql.TICKS}, h AS (SELECT event_id, row_number() OVER w AS pos,
         list({{'c': close, 'v': volume}}) OVER (PARTITION BY market, symbol ORDER BY ts, event_id ROWS 30 PRECEDING) AS xs
         FROM ticks WINDOW w AS (PARTITION BY market, symbol ORDER BY ts, event_id)),
       p AS (SELECT event_id, pos, list_transform(xs, lambda r: r.c) AS cs,
         list_transform(range(2, len(xs) + 1), lambda i: sign(xs[i].c / xs[i - 1].c - 1) * xs[i].v) AS sv FROM h)
       SELECT event_id, {sql.r("coalesce(list_sum(sv), 0)")} AS obv, CASE WHEN pos >= 26 THEN
         {sql.r("list_reduce(cs, lambda a, b: a * (1 - 2.0::DOUBLE / 13) + b * (2.0::DOUBLE / 13)) - list_reduce(cs, lambda a, b: a * (1 - 2.0::DOUBLE / 27) + b * (2.0::DOUBLE / 27))")}
         END AS macd,
         least(pos, 31) AS rows_seen FROM p""")
def trailing_history_features(spark, d):
    out = ft.engineered_features(t.ticks(spark, d), lookback=30, keep_position=True)
    return out.select("event_id", *rounded(["obv", "macd"]), F.least(F.col("_pos"), F.lit(31)).alias("rows_seen"))


@query("causal_zscores", "W15",
       f"""WITH {BAR_FEATURES}, kept AS (SELECT * FROM feats WHERE {sql.COMPLETE}), {sql.zscores('kept', 'ts')}
       SELECT symbol, day_no, {sql.rounded(["return_z", "volatility_20d_z"])} FROM zfeats""")
def causal_zscores(spark, d):
    z = ft.rolling_zscores(ft.complete(bar_features(spark, d)), order=["ts"], slicing=t.bar_slicing(spark, d))
    return z.select("symbol", "day_no", *rounded(["return_z", "volatility_20d_z"]))


@query("trailing_baselines", "A24",
       f"""WITH {BAR_FEATURES}, kept AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM feats
         WHERE {sql.COMPLETE})
       SELECT market, symbol, {sql.r('avg("return")', 8)} AS return_mean, {sql.r('greatest(stddev_samp("return"), 1e-8)', 8)} AS return_std,
         {sql.r("avg(volatility_20d)", 7)} AS volatility_20d_mean, {sql.r("greatest(stddev_samp(volatility_20d), 1e-8)", 7)} AS volatility_20d_std
       FROM kept WHERE rn <= 60 GROUP BY market, symbol""")
def trailing_baselines(spark, d):
    b = ft.trailing_baselines(ft.complete(bar_features(spark, d)), order=["ts"])
    return b.select("market", "symbol", *rounded(["return_mean", "return_std"], 8),
                    *rounded(["volatility_20d_mean", "volatility_20d_std"], 7))


@query("sma_bollinger", "W16 W17",
       f"""WITH {sql.BARS}, s AS (SELECT symbol, day_no, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd
         FROM bars WINDOW w AS (PARTITION BY market, symbol ORDER BY ts ROWS 19 PRECEDING))
       SELECT symbol, day_no, CASE WHEN n >= 20 THEN {sql.r("m")} END AS sma, CASE WHEN n >= 20 THEN {sql.r("m + 2 * sd")} END
         AS bollinger_upper, CASE WHEN n >= 20 THEN {sql.r("m - 2 * sd")} END AS bollinger_lower FROM s""")
def sma_bollinger(spark, d):
    series, slicing = t.bar_series(spark, d)
    out = ft.sma_bollinger(series, order=["ts"], slicing=slicing)
    return out.select("symbol", "day_no", *rounded(["sma", "bollinger_upper", "bollinger_lower"]))


@query("wilder_rsi", "W18",
       f"""WITH {sql.TICKS}, c AS (SELECT *, row_number() OVER w AS pos, close - lag(close) OVER w AS ch FROM ticks
         WINDOW w AS (PARTITION BY market, symbol ORDER BY ts, event_id)),
       l AS (SELECT event_id, pos, list(CASE WHEN ch >= 0 THEN ch ELSE 0 END) FILTER (ch IS NOT NULL) OVER w AS g,
         list(CASE WHEN ch < 0 THEN -ch ELSE 0 END) FILTER (ch IS NOT NULL) OVER w AS s FROM c
         WINDOW w AS (PARTITION BY market, symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
       a AS (SELECT event_id, pos, list_reduce(list_concat([list_avg(g[1:14])], g[15:]), lambda x, y: (x * 13 + y) / 14) AS ag,
         list_reduce(list_concat([list_avg(s[1:14])], s[15:]), lambda x, y: (x * 13 + y) / 14) AS al FROM l WHERE pos > 14)
       SELECT t.event_id, CASE WHEN al = 0 THEN 100 ELSE {sql.r("100 - 100 / (1 + ag / nullif(al, 0))")} END AS rsi_wilder
       FROM ticks t LEFT JOIN a USING (event_id)""")
def wilder_rsi(spark, d):
    return ft.wilder_rsi(t.ticks(spark, d)).select("event_id", *rounded(["rsi_wilder"]))


@query("event_rate", "W33 R9",
       f"""WITH {sql.TICKS} SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW)
         AS active FROM ticks""")
def event_rate(spark, d):
    from tapewatch.operators.joins import active_count

    return active_count(t.ticks(spark, d).select("event_id", "ts"), "ts", seconds=900).select("event_id", "active")


@query("alerts_per_minute", "W33 R9",
       f"""WITH {sql.TICKS}, c AS (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 15 SECONDS PRECEDING AND CURRENT ROW)
         AS n FROM ticks) SELECT event_id, CAST(round(n / 15.0 * 60) AS BIGINT) AS per_minute FROM c""")
def alerts_per_minute(spark, d):
    from tapewatch.operators.joins import active_count

    out = active_count(t.ticks(spark, d).select("event_id", "ts"), "ts", seconds=15)
    return out.select("event_id", F.round(F.col("active") / 15 * 60).cast("bigint").alias("per_minute"))
