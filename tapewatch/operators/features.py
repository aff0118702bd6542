"""The fourteen engineered features, causal z-scores and the chart indicators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators import ordered as o
from tapewatch.schemas import FEATURES, ZSCORE_MIN_ROWS, ZSCORE_WINDOW, ZSCORED

BY = ("market", "symbol")
ORDER = ("ts", "event_id")
REACH = 2 * o.RECURRENCE_BLOCK


def _ratio_change(close: Column, lagged: Column) -> Column:
    return F.try_divide(close, F.nullif(lagged, F.lit(0.0))) - 1


def _short_ema(close: str, span: int, frame, lookback: int) -> Column:
    """EMA that starts at the first row of a short frame."""
    a = 2.0 / (span + 1)
    xs = F.collect_list(F.col(close)).over(frame)
    return F.aggregate(F.slice(xs, 2, lookback + 1), F.element_at(xs, 1),
                       lambda acc, x: acc * (1 - a) + x * a)


def engineered_features(df: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER,
                        lookback: int | None = None, use_high_low: bool = False,
                        slicing="measure", rows: int = o.SLICE_ROWS, keep_position: bool = False) -> DataFrame:
    """Adds the fourteen features to rows with ``close`` and ``volume`` (and ``high``, ``low`` if used).

    ``lookback`` = number of earlier rows OBV and MACD may see; None means from the start of the series.
    """
    by, order = list(by), list(order)
    source = df
    if slicing == "measure":
        slicing, size = o.surveyed(df, by, order, rows)
        if slicing is None:
            source = o.dealt(df, by, size)

    def compute(d: DataFrame, part: list[str], key: list[str]) -> DataFrame:
        w = o.series_window(part, key)
        w14, w20 = o.trailing_frame(w, 14), o.trailing_frame(w, 20)
        close, volume = F.col("close"), F.col("volume")
        d = d.withColumns({"_c1": F.lag("close", 1).over(w), "_c5": F.lag("close", 5).over(w),
                           "_c10": F.lag("close", 10).over(w)})
        step = close - F.col("_c1")
        if use_high_low:
            high, low = F.col("high"), F.col("low")
            true_range = F.greatest(high - low, F.abs(high - F.col("_c1")), F.abs(low - F.col("_c1")))
        else:
            true_range = F.abs(step)
        d = d.withColumns({
            "return": _ratio_change(close, F.col("_c1")),
            "log_return": F.ln(F.try_divide(close, F.nullif(F.col("_c1"), F.lit(0.0)))),
            "rolling_return_5d": _ratio_change(close, F.col("_c5")),
            "rolling_return_10d": _ratio_change(close, F.col("_c10")),
            "price_momentum": close - F.col("_c10"),
            "true_range": true_range,
            "_gain": F.when(step > 0, step).otherwise(0.0),
            "_loss": F.when(step < 0, -step).otherwise(0.0),
        })
        d = d.withColumn("_signed", F.signum(F.coalesce(F.col("return"), F.lit(0.0))) * volume)
        seen = F.col("_pos") >= 2  # gains and losses are known on every row, zero on the first
        gain, loss = F.when(seen, F.avg("_gain").over(w14)), F.when(seen, F.avg("_loss").over(w14))
        d = d.withColumns({
            "rolling_volume_mean": F.avg("volume").over(w20),
            "rolling_volume_std": F.stddev_samp("volume").over(w20),
            "volatility_20d": F.stddev_samp("return").over(w20) * math.sqrt(252),
            "atr_14d": o.guarded(F.avg("true_range"), F.col("true_range"), w14, 2),
            "_g": gain, "_l": loss,
        })
        rs = F.try_divide(F.col("_g"), F.nullif(F.col("_l"), F.lit(0.0)))
        d = d.withColumns({
            "volume_ratio_20d": F.try_divide(volume, F.nullif(F.col("rolling_volume_mean"), F.lit(0.0))),
            "rsi_14d": F.when((F.col("_g") == 0) & (F.col("_l") == 0), 50.0)
            .when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + rs)),
        })
        if lookback is None:
            terms = {}
            for span in (12, 26):
                a = 2.0 / (span + 1)
                terms[f"_ema{span}"] = (F.when(F.col("_pos") == 1, close).otherwise(close * a), 1 - a)
            d = o.decayed(d, part, key, terms)
        else:
            frame = w.rowsBetween(-lookback, 0)
            d = d.withColumns({f"_ema{s}": _short_ema("close", s, frame, lookback) for s in (12, 26)})
            d = d.withColumn("obv", F.sum("_signed").over(o.trailing_frame(w, lookback)))
        return d.withColumn("macd", F.when(F.col("_pos") >= 26, F.col("_ema12") - F.col("_ema26")))

    out = o.framed(source, by, order, compute, back=max(REACH, lookback or 0), slicing=slicing)
    if lookback is None:
        out = o.running_sum(out, by, order, {"obv": F.col("_signed")}, slicing)
    extra = ["_pos"] if keep_position else []
    return out.select(*df.columns, *FEATURES, *extra)


def complete(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Rows whose own features are all known."""
    return df.dropna(subset=list(columns))


def feature_status(df: DataFrame, position: str = "_pos", minimum: int = 20) -> Column:
    """'ok', or 'insufficient_history' when the row lacks history or one of its own features."""
    known = F.lit(True)
    for f in FEATURES:
        known = known & F.col(f).isNotNull()
    return F.when((F.col(position) >= minimum) & known, "ok").otherwise("insufficient_history")


def rolling_zscores(df: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER,
                    columns: Sequence[str] = tuple(ZSCORED), window: int = ZSCORE_WINDOW,
                    least: int = ZSCORE_MIN_ROWS, slicing="measure", rows: int = o.SLICE_ROWS) -> DataFrame:
    """Adds ``<column>_z``: each value against the mean and std of the rows strictly before it."""

    def compute(d, part, key):
        frame = o.series_window(part, key).rowsBetween(-window, -1)
        for c in columns:
            x = F.col(c)
            mean = o.guarded(F.avg(x), x, frame, least)
            std = o.guarded(F.stddev_samp(x), x, frame, least)
            d = d.withColumn(f"{c}_z", (x - mean) / F.greatest(std, F.lit(1e-8)))
        return d

    out = o.framed(df, by, order, compute, back=window, slicing=slicing, rows=rows)
    return out.select(*df.columns, *[f"{c}_z" for c in columns])


def trailing_baselines(df: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER,
                       columns: Sequence[str] = tuple(ZSCORED), window: int = ZSCORE_WINDOW,
                       least: int = ZSCORE_MIN_ROWS) -> DataFrame:
    """Mean and std of the last ``window`` rows per symbol, taken at the last row that has them.

    Null values are dropped beforehand by the callers, so only the last rows of a symbol matter
    and Spark cuts every partition to them before the shuffle.
    """
    tail = o.newest(df, by, order, window)
    out = tail.groupBy(*by).agg(*[
        x for c in columns for x in (
            F.when(F.count(c) >= least, F.avg(c)).alias(f"{c}_mean"),
            F.when(F.count(c) >= least, F.greatest(F.stddev_samp(c), F.lit(1e-8))).alias(f"{c}_std"))])
    return out


def sma_bollinger(df: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, period: int = 20,
                  multiplier: float = 2.0, slicing="measure", rows: int = o.SLICE_ROWS) -> DataFrame:
    """Simple moving average and Bollinger bands with population std; null until the frame is full."""

    def compute(d, part, key):
        w = o.trailing_frame(o.series_window(part, key), period)
        d = d.withColumns({"sma": o.guarded(F.avg("close"), F.col("close"), w, period),
                           "_sd": o.guarded(F.stddev_pop("close"), F.col("close"), w, period)})
        return d.withColumns({"bollinger_upper": F.col("sma") + multiplier * F.col("_sd"),
                              "bollinger_lower": F.col("sma") - multiplier * F.col("_sd")})

    out = o.framed(df, by, order, compute, back=period, slicing=slicing, rows=rows)
    return out.select(*df.columns, "sma", "bollinger_upper", "bollinger_lower")


def wilder_rsi(df: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, period: int = 14,
               slicing="measure", rows: int = o.SLICE_ROWS) -> DataFrame:
    """RSI with Wilder smoothing, seeded by the mean of the first ``period`` changes."""
    q = (period - 1) / period

    def compute(d, part, key):
        w = o.series_window(part, key)
        d = d.withColumn("_d", F.col("close") - F.lag("close").over(w))
        d = d.withColumns({"_gain": F.when(F.col("_d") >= 0, F.col("_d")).otherwise(0.0),
                           "_loss": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})
        seed = o.trailing_frame(w, period)
        pos = F.col("_pos")
        d = d.withColumns({"_sg": F.avg("_gain").over(seed), "_sl": F.avg("_loss").over(seed)})

        def term(seeded, x):
            return (F.when(pos <= period, 0.0).when(pos == period + 1, F.col(seeded))
                    .otherwise(F.col(x) / period))

        return o.decayed(d, part, key, {"_ag": (term("_sg", "_gain"), q), "_al": (term("_sl", "_loss"), q)})

    out = o.framed(df, by, order, compute, back=REACH, slicing=slicing, rows=rows)
    rsi = F.when(F.col("_pos") > period, F.when(F.col("_al") == 0, 100.0).otherwise(
        100 - 100 / (1 + F.col("_ag") / F.nullif(F.col("_al"), F.lit(0.0)))))
    return out.select(*df.columns, rsi.alias("rsi_wilder"))


def min_max_by(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x − min)/(max − min) per group; the extremes are a small aggregate joined back."""
    by = list(by)
    ends = df.groupBy(*by).agg(*[e for c in columns for e in (
        F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    return joined.select(*df.columns, *[
        F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).alias(f"{c}_scaled")
        for c in columns])
