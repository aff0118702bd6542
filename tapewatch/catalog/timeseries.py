"""Splits, correlation structure, stationarity and forecasts over the daily bars of every symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.series_windows import BAR_FEATURES, bar_features, rounded
from tapewatch.operators import metrics
from tapewatch.operators import series as se
from tapewatch.session import cut
from tapewatch.sources import tables as t

POS = "row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, count(*) OVER (PARTITION BY symbol) AS n"


def prices(spark, d):
    """Daily closes, written once because several passes read them."""
    return cut(t.bars(spark, d).select("symbol", "ts", "day_no", "close"), "prices")


@query("chronological_split", "W25",
       f"""WITH {sql.BARS}, p AS (SELECT symbol, day_no, {POS} FROM bars) SELECT symbol, day_no, CASE WHEN pos <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM p""")
def chronological_split(spark, d):
    return se.chronological_split(t.bars(spark, d), slicing=t.bar_slicing(spark, d)).select("symbol", "day_no", "part")


@query("expanding_folds", "W26",
       f"""WITH {sql.BARS}, p AS (SELECT symbol, day_no, {POS} FROM bars), f AS (SELECT *, n // 6 AS size, n - n // 6 * 5 AS first FROM p)
       SELECT symbol, day_no, CASE WHEN pos > first THEN CAST((pos - 1 - first) // size AS INT) END AS fold FROM f""")
def expanding_folds(spark, d):
    return se.expanding_folds(t.bars(spark, d), 5, slicing=t.bar_slicing(spark, d)).select("symbol", "day_no", "fold")


@query("second_difference", "W19",
       f"""WITH {sql.BARS}, a AS (SELECT symbol, ts, day_no, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM bars),
       b AS (SELECT symbol, day_no, x - lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM a) SELECT symbol, day_no, x AS close FROM b WHERE x IS NOT NULL""")
def second_difference(spark, d):
    return se.differenced(t.bars(spark, d), "close", 2, slicing=t.bar_slicing(spark, d)).select("symbol", "day_no", "close")


@query("supervised_windows", "W23",
       f"""WITH {sql.BARS}, w AS (SELECT symbol, day_no, close AS target, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS xs FROM bars)
       SELECT symbol, day_no, target, xs[1] AS first, xs[30] AS last, {sql.r('list_avg(xs)')} AS mean FROM w WHERE len(xs) = 30""")
def supervised_windows(spark, d):
    s = se.sequences(t.bars(spark, d), "close", 30, slicing=t.bar_slicing(spark, d))
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 30
    return s.withColumn("mean", mean).select("symbol", "day_no", "target", F.get("window", 0).alias("first"), F.get("window", 29).alias("last"), *rounded(["mean"]))


@query("multivariate_windows", "W24",
       f"""WITH {sql.BARS}, w AS (SELECT symbol, day_no, close AS target, list([close, volume]) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS xs FROM bars)
       SELECT symbol, day_no, target, xs[1][2] AS first_volume, xs[10][1] AS last_close FROM w WHERE len(xs) = 10""")
def multivariate_windows(spark, d):
    s = se.multivariate_sequences(t.bars(spark, d), ["close", "volume"], "close", 10, slicing=t.bar_slicing(spark, d))
    return s.select("symbol", "day_no", "target", F.get(F.get("window", 0), 1).alias("first_volume"), F.get(F.get("window", 9), 0).alias("last_close"))


@query("half_violations", "A36",
       f"""WITH {sql.BARS}, p AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev, {POS} FROM bars),
       h AS (SELECT *, pos <= n // 2 AS f, CASE WHEN pos <> n // 2 + 1 THEN prev END AS pv FROM p),
       s AS (SELECT symbol, count(*) AS n, avg(close) FILTER (f) AS ma, avg(close) FILTER (NOT f) AS mb, stddev_samp(close) FILTER (f) AS sa,
         stddev_samp(close) FILTER (NOT f) AS sb, stddev_samp(close) AS sd, corr(close, pv) FILTER (f) AS ca, corr(close, pv) FILTER (NOT f) AS cb FROM h GROUP BY symbol)
       SELECT symbol, n, {sql.r('ma')} AS mean_first, {sql.r('mb')} AS mean_second, abs(ma - mb) / sd > 0.5 AS mean_violation, {sql.r('sa')} AS std_first, {sql.r('sb')} AS std_second,
        greatest(sa, sb) / greatest(least(sa, sb), 1e-10) > 1.5 AS variance_violation, {sql.r('ca', 8)} AS autocorr_first, {sql.r('cb', 8)} AS autocorr_second,
        abs(ca - cb) > 0.3 AS autocovariance_violation FROM s""")
def half_violations(spark, d):
    out = se.stationarity_violations(t.bars(spark, d), slicing=t.bar_slicing(spark, d))
    return out.select("symbol", "n", "mean_violation", "variance_violation", "autocovariance_violation",
                      *rounded(["mean_first", "mean_second", "std_first", "std_second"]), *rounded(["autocorr_first", "autocorr_second"], 8))


ACF_SQL = f"""m AS (SELECT symbol, ts, close - avg(close) OVER (PARTITION BY symbol) AS e, {POS} FROM bars),
  l AS (SELECT a.symbol, b.pos - a.pos AS lag, sum(a.e * b.e) AS s, any_value(a.n) AS n FROM m a JOIN m b ON a.symbol = b.symbol AND b.pos - a.pos BETWEEN 0 AND 15 GROUP BY 1, 2),
  acf AS (SELECT symbol, lag, n, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY symbol) AS acf FROM l)"""


@query("autocorrelation", "W20", f"WITH {sql.BARS}, {ACF_SQL} SELECT symbol, CAST(lag AS INT) AS lag, round(acf, 8) AS acf FROM acf")
def autocorrelation(spark, d):
    a = se.acf_pacf(t.bars(spark, d), lags=15, slicing=t.bar_slicing(spark, d))
    return a.select("symbol", F.posexplode("acf").alias("lag", "acf")).withColumn("acf", F.round("acf", 8))


@query("acf_cutoff", "M29",
       f"""WITH {sql.BARS}, {ACF_SQL}, w AS (SELECT symbol, lag, n, bool_and(abs(acf) < 1.96 / sqrt(n)) OVER f AS quiet, count(*) OVER f AS k FROM acf
         WINDOW f AS (PARTITION BY symbol ORDER BY lag ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
       SELECT symbol, CAST(coalesce(min(CASE WHEN quiet AND k = 4 AND lag >= 1 THEN lag END), 16) AS INT) AS acf_cutoff FROM w GROUP BY symbol""")
def acf_cutoff(spark, d):
    return se.ar_or_ma(se.acf_pacf(t.bars(spark, d), lags=15, slicing=t.bar_slicing(spark, d))).select("symbol", "acf_cutoff")


@query("partial_autocorrelation", "W21 M29")
def partial_autocorrelation(spark, d):
    a = se.ar_or_ma(se.acf_pacf(t.bars(spark, d), lags=15, slicing=t.bar_slicing(spark, d)))
    return a.select("symbol", F.get("pacf", 1).alias("pacf_1"), F.get("pacf", 2).alias("pacf_2"), "pacf_cutoff", "signature")


@query("seasonal_comparison", "W22",
       f"""WITH {sql.BARS}, p AS (SELECT symbol, ts, close, {POS} FROM bars),
       a AS (SELECT *, (pos - 1) % 12 AS ph, CASE WHEN pos > 6 AND pos <= n - 6 THEN (sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
         - 0.5::DOUBLE * (lag(close, 6) OVER w + lead(close, 6) OVER w)) / 12 END AS tr FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
       s AS (SELECT symbol, ph, avg(close - tr) AS sa, avg(close / tr) AS sm FROM a GROUP BY 1, 2), c AS (SELECT symbol, avg(sa) AS ca, avg(sm) AS cm FROM s GROUP BY 1),
       r AS (SELECT a.symbol, close - tr - (sa - ca) AS ra, close / tr / (sm / cm) AS rm FROM a JOIN s ON a.symbol = s.symbol AND a.ph = s.ph JOIN c ON a.symbol = c.symbol),
       f AS (SELECT symbol, stddev_samp(ra) AS x, stddev_samp(rm) AS y FROM r GROUP BY 1)
       SELECT symbol, {sql.r('x')} AS residual_std_additive, {sql.r('y', 8)} AS residual_std_multiplicative, CASE WHEN x < y THEN 'additive' ELSE 'multiplicative' END AS better_fit FROM f""")
def seasonal_comparison(spark, d):
    out = se.seasonal_comparison(t.bars(spark, d), 12, slicing=t.bar_slicing(spark, d))
    return out.select("symbol", *rounded(["residual_std_additive"]), *rounded(["residual_std_multiplicative"], 8), "better_fit")


@query("ar_one", "W28",
       f"""WITH {sql.BARS}, l AS (SELECT symbol, close AS y, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM bars)
       SELECT symbol, {sql.r('regr_intercept(y, x)', 4)} AS c, {sql.r('regr_slope(y, x)', 8)} AS phi FROM l WHERE x IS NOT NULL GROUP BY symbol""")
def ar_one(spark, d):
    a = se.fit_ar(t.bars(spark, d), p=1, slicing=t.bar_slicing(spark, d))
    a = a.select("symbol", F.get("coefficients", 0).alias("c"), F.get("coefficients", 1).alias("phi"))
    return a.select("symbol", *rounded(["c"], 4), *rounded(["phi"], 8))


@query("ar_three", "W28")
def ar_three(spark, d):
    a = se.fit_ar(t.bars(spark, d), p=3, slicing=t.bar_slicing(spark, d))
    return a.select("symbol", *[F.get("coefficients", i).alias(n) for i, n in enumerate(["c", "phi_1", "phi_2", "phi_3"])])


@query("adf_test", "M26")
def adf_test(spark, d):
    return se.adf(prices(spark, d))


@query("kpss_test", "M27")
def kpss_test(spark, d):
    return se.kpss(prices(spark, d))


@query("stationarity_verdict", "M28 E6")
def stationarity_verdict(spark, d):
    p = prices(spark, d)
    return se.combined_verdict(p).join(se.recommended_difference(p), "symbol")


@query("verdict_table", "M28",
       f"""WITH {sql.BARS}, s AS (SELECT symbol, avg(close) > 1650 AS a, avg(volume) > 25.5 AS k FROM bars GROUP BY symbol)
       SELECT symbol, CASE WHEN a AND k THEN 'confidently_stationary' WHEN NOT a AND NOT k THEN 'confidently_non_stationary'
        WHEN a THEN 'disagreement_likely_trend_stationary' ELSE 'disagreement_borderline_or_low_power' END AS verdict FROM s""")
def verdict_table(spark, d):
    s = t.bars(spark, d).groupBy("symbol").agg((F.avg("close") > 1650).alias("a"), (F.avg("volume") > 25.5).alias("k"))
    return s.select("symbol", se.verdict(F.col("a"), F.col("k")).alias("verdict"))


def _split(spark, d, test_size=0.1):
    return cut(se.chronological_split(t.bars(spark, d).select("symbol", "ts", "day_no", "close"), test_size,
                                      slicing=t.bar_slicing(spark, d)), "split")


def _errors(spark, d, forecasts, split):
    rows = se.horizon_rows(split).join(forecasts, ["symbol", "step"])
    return rows.withColumn("error", F.col("actual") - F.col("forecast"))


@query("arima_forecast", "M30 A29 E6")
def arima_forecast(spark, d):
    s = _split(spark, d)
    horizon = s.filter("part = 'test'").groupBy("symbol").count().agg(F.max("count").alias("n")).first().n
    f = se.arima_forecast(s.filter("part = 'train'"), horizon, (1, 1, 1))
    e = _errors(spark, d, f, s)
    cover = F.avg(((F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))).cast("double"))
    return metrics.forecast_errors(e, ["symbol"]).join(e.groupBy("symbol").agg(cover.alias("coverage")), "symbol")


@query("arima_order_grid", "M31 T-8 E6")
def arima_order_grid(spark, d):
    g = se.grid_search(_split(spark, d).filter("part = 'train'"), range(3), [0, 1], range(3))
    return se.best_order(cut(g, "grid"))


@query("trend_season_forecast", "M32 A29 E6")
def trend_season_forecast(spark, d):
    f = se.trend_season_forecast(_split(spark, d), scales=se.CHANGEPOINT_SCALES)
    return f.groupBy("symbol", "scale").agg(F.max("n_changepoints").alias("n_changepoints"),
                                           F.sqrt(F.avg(F.pow(F.col("actual") - F.col("forecast"), 2))).alias("test_rmse"))


@query("event_forecast_signal", "M33 W29 E6")
def event_forecast_signal(spark, d):
    s = _split(spark, d)
    f = se.arima_forecast(s.filter("part = 'train'"), 30, (1, 1, 1))
    return se.event_signal(_errors(spark, d, f, s), (10, 17), [(0, 10), (17, 30)])


NAIVE = f"""p AS (SELECT symbol, ts, close, {POS} FROM bars), k AS (SELECT *, floor(n * (1 - 0.1::DOUBLE)) AS edge FROM p),
  v AS (SELECT symbol, arg_max(close, pos) AS f FROM k WHERE pos <= edge GROUP BY symbol),
  e AS (SELECT symbol, pos - edge - 1 AS step, close - f AS err FROM k JOIN v USING (symbol) WHERE pos > edge)"""


@query("naive_event_signal", "W29 M33",
       f"""WITH {sql.BARS}, {NAIVE}, s AS (SELECT symbol, avg(abs(err)) FILTER (step < 10 OR step BETWEEN 17 AND 29) AS bm, stddev_pop(abs(err)) FILTER (step < 10 OR step BETWEEN 17 AND 29) AS bs,
         avg(abs(err)) FILTER (step BETWEEN 10 AND 16) AS em, max(abs(err)) FILTER (step BETWEEN 10 AND 16) AS hi, min(abs(err)) FILTER (step BETWEEN 10 AND 16) AS lo FROM e GROUP BY symbol),
       z AS (SELECT symbol, bm, bs, (em - bm) / bs AS mz, greatest(abs((hi - bm) / bs), abs((lo - bm) / bs)) AS tz FROM s)
       SELECT symbol, {sql.r('bm')} AS baseline_mean, {sql.r('bs')} AS baseline_std, {sql.r('mz', 8)} AS event_mean_z, {sql.r('tz', 8)} AS max_event_z,
        CASE WHEN tz > 3 THEN 'clear' WHEN tz > 2 THEN 'moderate' ELSE 'none' END AS strength FROM z""")
def naive_event_signal(spark, d):
    s = _split(spark, d)
    last = s.filter("part = 'train'").groupBy("symbol").agg(F.max_by("close", "ts").alias("forecast"))
    rows = se.horizon_rows(s).join(last, "symbol").withColumn("error", F.col("actual") - F.col("forecast"))
    out = se.event_signal(rows, (10, 17), [(0, 10), (17, 30)])
    return out.select("symbol", *rounded(["baseline_mean", "baseline_std"]), *rounded(["event_mean_z", "max_event_z"], 8), "strength")


@query("naive_forecast_errors", "A29",
       f"WITH {sql.BARS}, {NAIVE} SELECT symbol, {sql.r('sqrt(avg(err * err))')} AS rmse, {sql.r('avg(abs(err))')} AS mae FROM e GROUP BY symbol")
def naive_forecast_errors(spark, d):
    s = _split(spark, d)
    last = s.filter("part = 'train'").groupBy("symbol").agg(F.max_by("close", "ts").alias("forecast"))
    return metrics.forecast_errors(se.horizon_rows(s).join(last, "symbol"), ["symbol"]).select("symbol", *rounded(["rmse", "mae"]))
