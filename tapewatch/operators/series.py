"""Many time series at once: splits, correlation structure, stationarity, ARMA-type and trend forecasts.

Regressions never gather a series. Lagged values come from bounded frames, tasks add up X'X per
series, the sums are merged by Spark, and only the small matrices are solved per series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import ordered as o

BY = ("symbol",)
ORDER = ("ts",)


# --- splits and windows ------------------------------------------------------

def positioned(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    return o.numbered(df, by, order, out="_pos", total="_total", **kw)


def chronological_split(df: DataFrame, test_size: float = 0.2, by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Adds ``part``: 'train' for the first int(n·(1 − test_size)) rows of a series, then 'test'."""
    p = positioned(df, by, order, **kw)
    edge = F.floor(F.col("_total") * (1 - test_size))
    return p.withColumn("part", F.when(F.col("_pos") <= edge, "train").otherwise("test")).drop("_pos", "_total")


def expanding_folds(df: DataFrame, splits: int = 5, by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Adds ``fold``: the split whose test part the row belongs to (0-based); null rows only train.

    Split i trains on every row of earlier folds, so one column describes all splits.
    """
    p = positioned(df, by, order, **kw)
    size = F.floor(F.col("_total") / (splits + 1))
    first = F.col("_total") - size * splits
    fold = F.when(F.col("_pos") > first, F.floor((F.col("_pos") - 1 - first) / F.nullif(size, F.lit(0))).cast("int"))
    return p.withColumn("fold", fold).drop("_pos", "_total")


def differenced(df: DataFrame, value: str, times: int = 1, by: Sequence[str] = BY, order: Sequence[str] = ORDER,
                out: str | None = None, **kw) -> DataFrame:
    """Replaces the value by its ``times``-th difference and drops the rows that lose it."""
    name = out or value

    def compute(d, part, key):
        w = o.series_window(part, key)
        d = d.withColumn(name, F.col(value))
        for _ in range(times):
            d = d.withColumn(name, F.col(name) - F.lag(name).over(w))
        return d.filter(F.col("_pos") > times)

    cols = df.columns if name in df.columns else [*df.columns, name]
    return o.framed(df, by, order, compute, back=max(times, 1), **kw).select(*cols)


def recent(df: DataFrame, value: str, length: int, out: str = "recent", by: Sequence[str] = BY,
           order: Sequence[str] = ORDER, include_current: bool = True, **kw) -> DataFrame:
    """Adds the last ``length`` values, oldest first; shorter at the start of a series."""

    def compute(d, part, key):
        w = o.series_window(part, key)
        frame = w.rowsBetween(-(length - 1), 0) if include_current else w.rowsBetween(-length, -1)
        return d.withColumn(out, F.collect_list(value).over(frame))

    return o.framed(df, by, order, compute, back=length, **kw).select(*df.columns, out)


def sequences(df: DataFrame, value: str, length: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """``length`` values and the value that follows them."""
    d = recent(df.filter(F.col(value).isNotNull()), value, length, "window", by, order, include_current=False, **kw)
    return d.filter(F.size("window") == length).withColumn("target", F.col(value))


def multivariate_sequences(df: DataFrame, values: Sequence[str], target: str, length: int, by: Sequence[str] = BY,
                           order: Sequence[str] = ORDER, **kw) -> DataFrame:
    d = df.withColumn("_v", F.array(*[F.col(v).cast("double") for v in values]))
    d = recent(d, "_v", length, "window", by, order, include_current=False, **kw)
    return d.filter(F.size("window") == length).withColumn("target", F.col(target)).drop("_v")


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[str], kw: dict) -> dict:
    """Measures once for all passes of an operator; rows dropped on the way cannot make a slice larger."""
    if kw.get("slicing", "measure") != "measure":
        return {"slicing": kw["slicing"]}
    return {"slicing": o.measure(df, list(by), list(order), kw.get("rows", o.SLICE_ROWS))}


# --- screening ---------------------------------------------------------------

def _corr(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(sx * sy, F.lit(0.0)))


def stationarity_violations(df: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Mean, std and lag-1 autocorrelation of both halves and three violation flags."""
    by = list(by)
    kw = _sliced(df, by, order, kw)
    p = positioned(df.filter(F.col(value).isNotNull()), by, order, **kw)
    half = F.floor(F.col("_total") / 2)

    def compute(d, part, key):
        return d.withColumn("_prev", F.lag(value).over(o.series_window(part, key)))

    p = o.framed(p, by, order, compute, back=1, numbered_already=True, **kw)
    first = F.col("_pos") <= half
    x, prev = F.col(value), F.col("_prev")
    same = F.when(F.col("_pos") != half + 1, prev)
    a, b = F.when(first, x), F.when(~first, x)
    s = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_first"), F.avg(b).alias("mean_second"),
        F.stddev_samp(a).alias("std_first"), F.stddev_samp(b).alias("std_second"), F.stddev_samp(x).alias("_std"),
        F.count(a).alias("_na"), F.count(b).alias("_nb"),
        _corr(a, F.when(first, same)).alias("_ca"), _corr(b, F.when(~first, same)).alias("_cb"))
    shift = F.coalesce(F.try_divide(F.abs(F.col("mean_first") - F.col("mean_second")), F.nullif("_std", F.lit(0.0))), F.lit(0.0))
    spread = F.greatest("std_first", "std_second") / F.greatest(F.least("std_first", "std_second"), F.lit(1e-10))
    ca, cb = F.when(F.col("_na") >= 3, F.col("_ca")), F.when(F.col("_nb") >= 3, F.col("_cb"))
    return s.select(*by, "n", "mean_first", "mean_second", (shift > 0.5).alias("mean_violation"), "std_first", "std_second",
                    (spread > 1.5).alias("variance_violation"), ca.alias("autocorr_first"), cb.alias("autocorr_second"),
                    F.coalesce(F.abs(ca - cb) > 0.3, F.lit(False)).alias("autocovariance_violation"))


def _lag_products(df: DataFrame, value: str, lags: int, by: list[str], order: Sequence[str], **kw) -> DataFrame:
    """Per series: n and Σ e_t·e_{t−k} for k = 0 … lags as ``_s0`` …, with e the centred value."""
    d = df.filter(F.col(value).isNotNull())
    means = d.groupBy(*by).agg(F.avg(value).alias("_mean"))
    d = d.join(means, by).withColumn("_e", F.col(value) - F.col("_mean"))

    def compute(x, part, key):
        w = o.series_window(part, key)
        return x.withColumns({f"_p{k}": F.col("_e") * (F.lag("_e", k).over(w) if k else F.col("_e")) for k in range(lags + 1)})

    x = o.framed(d.select(*by, *order, "_e"), by, order, compute, back=max(lags, 1), **kw)
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(lags + 1)])


def _levinson(cov: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of autocovariances cov[0..k] by the Durbin–Levinson recursion."""
    k = len(cov) - 1
    out, phi, err = np.ones(k + 1), np.zeros(0), cov[0]
    for m in range(1, k + 1):
        if not err > 0:
            out[m:] = np.nan
            break
        a = (cov[m] - phi @ cov[m - 1:0:-1]) / err if m > 1 else cov[1] / err
        phi = np.append(phi - a * phi[::-1], a)
        err *= 1 - a * a
        out[m] = a
    return out


def acf_pacf(df: DataFrame, value: str = "close", lags: int = 20, by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """One row per series with arrays ``acf`` (biased) and ``pacf`` (adjusted Yule–Walker), index = lag."""
    by = list(by)
    sums = _lag_products(df, value, lags, by, order, **kw)
    s = [F.col(f"_s{k}") for k in range(lags + 1)]
    n = F.col("n")
    acf = F.array(*[F.try_divide(F.coalesce(x, F.lit(0.0)), F.nullif(s[0], F.lit(0.0))) for x in s])
    cov = F.array(*[F.try_divide(F.coalesce(x, F.lit(0.0)), F.nullif((n - k).cast("double"), F.lit(0.0))) for k, x in enumerate(s)])

    @F.pandas_udf("array<double>")
    def pacf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cov_ in parts:
            yield cov_.map(lambda c: _levinson(np.asarray(c, dtype=float)).tolist())

    return sums.select(*by, "n", acf.alias("acf"), cov.alias("_cov")).withColumn("pacf", pacf("_cov")).drop("_cov")


def cutoff_lag(values: str, band: Column, settle: int = 4) -> Column:
    """First lag from which ``settle`` lags in a row stay inside the band; the length if none does."""
    v = F.col(values)
    starts = F.when(F.size(v) > settle, F.sequence(F.lit(1), F.greatest(F.size(v) - settle, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    quiet = F.filter(starts, lambda i: F.forall(F.slice(v, i + 1, settle), lambda x: F.abs(x) < band))
    return F.coalesce(F.get(quiet, 0), F.size(v))


def ar_or_ma(table: DataFrame) -> DataFrame:
    """AR-like when the partial correlations cut off first, MA-like when the plain ones do."""
    band = 1.96 / F.sqrt(F.col("n"))
    t = table.withColumns({"acf_cutoff": cutoff_lag("acf", band), "pacf_cutoff": cutoff_lag("pacf", band)})
    sign = F.when(F.col("pacf_cutoff") < F.col("acf_cutoff"), "AR-like").when(
        F.col("acf_cutoff") < F.col("pacf_cutoff"), "MA-like").otherwise("ambiguous")
    return t.withColumn("signature", sign)


def seasonal_comparison(df: DataFrame, period: int, value: str = "close", by: Sequence[str] = BY,
                        order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Residual std of additive and multiplicative decomposition; the smaller one is the better fit."""
    by, half = list(by), period // 2

    def compute(d, part, key):
        w = o.series_window(part, key)
        frame = w.rowsBetween(-half, half)
        total = F.sum(value).over(frame)
        if period % 2 == 0:
            total = total - 0.5 * (F.lag(value, half).over(w) + F.lead(value, half).over(w))
        return d.withColumn("_trend", F.when(F.count(value).over(frame) == 2 * half + 1, total / period))

    d = df.filter(F.col(value).isNotNull()).select(*by, *order, value)
    d = o.framed(d, by, order, compute, back=half, ahead=half, **kw)
    x, trend = F.col(value), F.col("_trend")
    d = d.withColumns({"_phase": ((F.col("_pos") - 1) % period).cast("int"), "_a": x - trend,
                       "_m": F.try_divide(x, F.nullif(trend, F.lit(0.0)))}).select(*by, "_phase", value, "_trend", "_a", "_m")
    season = d.groupBy(*by, "_phase").agg(F.avg("_a").alias("_sa"), F.avg("_m").alias("_sm"))
    centre = season.groupBy(*by).agg(F.avg("_sa").alias("_ca"), F.avg("_sm").alias("_cm"))
    season = season.join(centre, by).select(*by, "_phase", (F.col("_sa") - F.col("_ca")).alias("_sa"),
                                            F.try_divide("_sm", F.nullif("_cm", F.lit(0.0))).alias("_sm"))
    r = d.join(season, [*by, "_phase"])
    out = r.groupBy(*by).agg(F.stddev_samp(F.col("_a") - F.col("_sa")).alias("residual_std_additive"),
                             F.stddev_samp(F.try_divide("_m", F.nullif("_sm", F.lit(0.0)))).alias("residual_std_multiplicative"))
    better = F.when(F.col("residual_std_additive") < F.col("residual_std_multiplicative"), "additive").otherwise("multiplicative")
    return out.withColumn("better_fit", better)


# --- merged regressions ------------------------------------------------------

#: Numbers of open sums that a task holds at most, and of whole matrices that it hands on at a time.
HELD_CELLS = 1 << 23


def cross_products(df: DataFrame, by: Sequence[str], inputs: Sequence[str],
                   design: Callable[[list[np.ndarray]], np.ndarray], width: int) -> DataFrame:
    """Per series: ``xx`` = Σ z zᵀ (flat) over the rows z that ``design`` makes of the input columns.

    Tasks add their rows up, so the shuffle carries one small matrix per series and task.
    """
    by = list(by)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    most = max(1, HELD_CELLS // width ** 2)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            if not sums:
                return
            out = pd.DataFrame(list(sums), columns=by)
            out["xx"] = [m[np.triu_indices(len(m))] for m in sums.values()]
            sums.clear()
            yield out

        for pdf in parts:
            if pdf.empty:
                continue
            for key, rows in pdf.groupby(by, sort=False):
                z = design([np.vstack(rows[c].to_numpy()) if rows[c].dtype == object else rows[c].to_numpy(dtype=float)[:, None]
                            for c in inputs])
                sums[key] = sums.get(key, 0) + z.T @ z
            if len(sums) > most:
                yield from flush()
        yield from flush()

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds up the triangles of each series; a series' rows follow each other, so one sum is open at a time."""
        upper = np.triu_indices(width)
        key, total = None, None

        def whole(keys: list[tuple], sums: list[np.ndarray]) -> pd.DataFrame:
            out = pd.DataFrame(keys, columns=by)
            flat = np.zeros((len(sums), width, width))
            flat[:, upper[0], upper[1]] = flat[:, upper[1], upper[0]] = np.vstack(sums)
            out["xx"] = list(flat.reshape(len(sums), -1))
            return out

        for pdf in parts:
            if pdf.empty:
                continue
            keys, sums = [], []
            names = list(pdf[by].itertuples(index=False, name=None))
            first = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
            added = np.add.reduceat(np.vstack(pdf["xx"].to_numpy()), first, axis=0)
            for at, own in zip(first, added):
                if key is not None and names[at] != key:
                    keys.append(key)
                    sums.append(total)
                    total = None
                key, total = names[at], own if total is None else total + own
            for a in range(0, len(keys), most):
                yield whole(keys[a:a + most], sums[a:a + most])
        if key is not None:
            yield whole([key], [total])

    schema = f"{keys}, xx ARRAY<DOUBLE>"
    parts = df.select(*by, *inputs).mapInPandas(partial, schema)
    return _spread(parts, by).sortWithinPartitions(*by).mapInPandas(merged, schema)


def _spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Deals series to as many tasks as a shuffle has: rows are few and small, but each one means a fit."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _nested_residuals(g: np.ndarray, y: int, xs: list[int]) -> list[float] | None:
    """Residual sums of y on the first 1, 2, … columns of xs, from one Cholesky factor; None where they are too close to collinear."""
    a = g[np.ix_([*xs, y], [*xs, y])]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    an = a / np.outer(scale, scale)
    if not np.all(np.isfinite(an)) or np.linalg.cond(an) > 1e12:
        return None
    explained = np.cumsum(np.linalg.cholesky(an)[-1, :-1] ** 2)
    return ((1 - explained) * scale[-1] ** 2).tolist()


def _solve(g: np.ndarray, y: int, xs: list[int]) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Least squares of column y on columns xs from cross products: (coefficients, residual sum, inverse)."""
    a, b = g[np.ix_(xs, xs)], g[xs, y]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    an = a / np.outer(scale, scale)
    if not np.all(np.isfinite(an)) or np.linalg.cond(an) > 1e13:
        return None
    inv = np.linalg.inv(an)
    beta = inv @ (b / scale) / scale
    sse = float(g[y, y] - 2 * beta @ b + beta @ a @ beta)
    return beta, max(sse, 0.0), inv / np.outer(scale, scale)


def _centred(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds ``_e`` = value − series mean, which keeps the cross products well scaled."""
    d = df.filter(F.col(value).isNotNull())
    means = d.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    return d.join(means, by).withColumn("_e", F.col(value) - F.col("_mean"))


def fit_ar(df: DataFrame, value: str = "close", p: int = 1, by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Ordinary least squares of y_t on an intercept and p lags: ``coefficients`` = [c, φ_1 … φ_p]."""
    by = list(by)
    kw = _sliced(df, by, order, kw)
    d = recent(_centred(df, value, by), "_e", p + 1, "_r", by, order, **kw).filter(F.size("_r") == p + 1)

    def design(cols):
        r = cols[0]
        return np.column_stack([r[:, ::-1], np.ones(len(r))])  # y_t, y_{t−1} … y_{t−p}, 1

    xx = cross_products(d, by, ["_r"], design, p + 2)
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))

    @F.pandas_udf("array<double>")
    def solve(xx_: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for flat, m in zip(xx_, mean):
            fit = _solve(np.asarray(flat).reshape(p + 2, p + 2), 0, [p + 1, *range(1, p + 1)])
            if fit is None:
                out.append(None)
                continue
            c, phi = fit[0][0], fit[0][1:]
            out.append([c + m * (1 - phi.sum()), *phi])
        return pd.Series(out)

    return xx.join(means, by).select(*by, solve("xx", "_mean").alias("coefficients"))


# MacKinnon (1994) response surface for one series with a constant, and KPSS level critical values.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = [2.1659, 1.4412, 0.038269]
TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]


def _mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    surface = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    x = sum(c * tau ** i for i, c in enumerate(surface))
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _max_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)))


def adf(df: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Augmented Dickey–Fuller with a constant, lag order by AIC; stationary when p < .05.

    The candidates share one sample (rows with all lags known), the final fit uses every row its own
    lag order allows: the common sums plus the few rows at the head of the series.
    """
    by = list(by)
    kw = _sliced(df, by, order, kw)
    d = _centred(df, value, by)
    longest = d.agg(F.max("_n").alias("n")).first().n or 0
    k_max = _max_lag(longest)
    d = recent(d, "_e", k_max + 2, "_r", by, order, **kw)
    head = o.framed(d.select(*by, *order, "_e"), by, order, lambda x, a, b: x, back=1, **kw).filter(F.col("_pos") <= k_max + 2)
    head = head.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_e"))), lambda c: c["_e"]).alias("_head"))
    width = k_max + 3

    def rows_of(r: np.ndarray) -> np.ndarray:
        diff = np.diff(r, axis=1)[:, ::-1]  # Δy_t, Δy_{t−1} …
        return np.column_stack([diff[:, 0], np.ones(len(r)), r[:, -2], diff[:, 1:]])

    xx = cross_products(d.filter(F.size("_r") == k_max + 2), by, ["_r"], lambda c: rows_of(c[0]), width)
    n_of = d.groupBy(*by).agg(F.max("_n").alias("n"))

    @F.pandas_udf("statistic DOUBLE, p_value DOUBLE, used_lag INT")
    def solve(xx_: pd.Series, head_: pd.Series, n_: pd.Series) -> pd.DataFrame:
        out = []
        for flat, first, n in zip(xx_, head_, n_):
            base = np.zeros((width, width)) if flat is None else np.asarray(flat).reshape(width, width)
            first, limit = np.asarray(first, dtype=float), _max_lag(int(n))

            def extra(last_row: int, lags: int) -> np.ndarray:
                """Cross products of the rows whose 0-based time runs from lags + 1 to last_row − 1."""
                g = np.zeros((width, width))
                for t in range(lags + 1, min(last_row, len(first))):
                    r = first[t - lags - 1:t + 1][None, :]
                    z = np.zeros(width)
                    z[:lags + 3] = rows_of(r)[0]
                    g += np.outer(z, z)
                return g

            common = base + extra(k_max + 1, limit)
            best = None
            nested = _nested_residuals(common, 0, list(range(1, limit + 3)))
            for lags in range(limit + 1):
                if nested is None:
                    fit = _solve(common, 0, list(range(1, lags + 3)))
                    left = fit[1] if fit else 0.0
                else:
                    left = nested[lags + 1]
                if left <= 0:
                    continue
                rows = common[1, 1]
                aic = rows * math.log(left) + 2 * (lags + 2)
                if best is None or aic < best[0]:
                    best = (aic, lags)
            if best is None:
                out.append((None, None, None))
                continue
            lags = best[1]
            g = base + extra(k_max + 1, lags)
            fit = _solve(g, 0, list(range(1, lags + 3)))
            beta, sse, inv = fit
            freedom = g[1, 1] - (lags + 2)
            if sse <= 0 or freedom <= 0:
                out.append((None, None, None))
                continue
            tau = float(beta[1] / math.sqrt(sse / freedom * inv[1, 1]))
            out.append((tau, _mackinnon_p(tau), lags))
        return pd.DataFrame(out, columns=["statistic", "p_value", "used_lag"])

    j = _spread(head.join(n_of, by).join(xx, by, "left"), by)
    return j.select(*by, "n", solve("xx", "_head", "n").alias("_r")).select(
        *by, "n", "_r.*", (F.col("_r.p_value") < 0.05).alias("is_stationary"))


def kpss(df: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """KPSS level test with data-driven lag; stationary when p ≥ .05 (its null hypothesis)."""
    by = list(by)
    kw = _sliced(df, by, order, kw)
    d = _centred(df, value, by).select(*by, *order, "_e", "_n")
    longest = d.agg(F.max("_n").alias("n")).first().n or 1
    first = max(1, int(longest ** (2.0 / 9.0)))
    sums = _lag_products(d, "_e", first, by, order, **kw)
    n = F.col("n").cast("double")
    use = F.floor(F.pow(n, 2.0 / 9.0))
    prods = [(F.when(F.lit(k) <= use, F.coalesce(f"_s{k}", F.lit(0.0)) / (n / 2)).otherwise(0.0), k) for k in range(1, first + 1)]
    s0 = F.col("_s0") / n + sum((p for p, _ in prods), F.lit(0.0))
    s1 = sum((p * k for p, k in prods), F.lit(0.0))
    ratio = F.try_divide(s1, F.nullif(s0, F.lit(0.0)))
    lag = F.least(F.floor(1.1447 * F.pow(ratio * ratio, 1.0 / 3.0) * F.pow(n, 1.0 / 3.0)), n - 1).cast("int")
    lags = sums.select(*by, "n", F.coalesce(lag, F.lit(0)).alias("lags"))
    top = lags.agg(F.max("lags").alias("k")).first().k or 0
    wide = _lag_products(d, "_e", top, by, order, **kw).drop("n").join(lags, by)
    n = F.col("n").cast("double")
    long_run = F.col("_s0") + sum((F.when(F.lit(k) <= F.col("lags"), 2 * (1 - k / (F.col("lags") + 1)) * F.coalesce(f"_s{k}", F.lit(0.0)))
                                   .otherwise(0.0) for k in range(1, top + 1)), F.lit(0.0))
    placed = o.framed(d, by, order, lambda x, a, b: x, back=1, **kw)
    run = o.running_sum(placed, by, order, {"_run": F.col("_e")}, kw["slicing"])
    partial = run.groupBy(*by).agg(F.sum(F.col("_run") * F.col("_run")).alias("_eta"))
    j = wide.join(partial, by)
    statistic = F.try_divide(F.col("_eta") / (n * n), F.nullif(long_run / n, F.lit(0.0)))
    j = j.select(*by, "n", "lags", statistic.alias("statistic"))
    x = F.col("statistic")
    p = F.when(x <= KPSS_CRITICAL[0], KPSS_P[0])
    for i in range(3):
        lo, hi, a, b = KPSS_CRITICAL[i], KPSS_CRITICAL[i + 1], KPSS_P[i], KPSS_P[i + 1]
        p = p.when(x <= hi, a + (x - lo) / (hi - lo) * (b - a))
    p = p.when(x.isNotNull(), KPSS_P[-1])
    return j.withColumn("p_value", p).withColumn("is_stationary", F.col("p_value") >= 0.05)


def verdict(adf_stationary: Column, kpss_stationary: Column) -> Column:
    return (F.when(adf_stationary & kpss_stationary, "confidently_stationary")
            .when(~adf_stationary & ~kpss_stationary, "confidently_non_stationary")
            .when(adf_stationary & ~kpss_stationary, "disagreement_likely_trend_stationary")
            .when(~adf_stationary & kpss_stationary, "disagreement_borderline_or_low_power"))


def combined_verdict(df: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    by = list(by)
    kw = _sliced(df, by, order, kw)
    a = adf(df, value, by, order, **kw).select(*by, F.col("p_value").alias("adf_p"), F.col("is_stationary").alias("_a"))
    k = kpss(df, value, by, order, **kw).select(*by, F.col("p_value").alias("kpss_p"), F.col("is_stationary").alias("_k"))
    return a.join(k, by).select(*by, "adf_p", "kpss_p", verdict(F.col("_a"), F.col("_k")).alias("verdict"))


def recommended_difference(df: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Smallest d in 0, 1 whose ADF test is stationary, else 2."""
    by = list(by)
    kw = _sliced(df, by, order, kw)
    d0 = adf(df, value, by, order, **kw).select(*by, F.col("is_stationary").alias("_0"))
    d1 = adf(differenced(df, value, 1, by, order, **kw), value, by, order, **kw).select(*by, F.col("is_stationary").alias("_1"))
    return d0.join(d1, by).select(*by, F.when(F.col("_0"), 0).when(F.col("_1"), 1).otherwise(2).alias("d"))


# --- ARMA-type forecasts -----------------------------------------------------

LONG_AR = 12


def _arma_products(df: DataFrame, value: str, d: int, lags: int, by: list[str], order: Sequence[str], **kw) -> tuple[DataFrame, DataFrame]:
    """Two-stage (Hannan–Rissanen) set-up: innovations from a long autoregression, then the cross
    products of [y_t, 1, y lags, innovation lags], and the tail each forecast starts from."""
    w = differenced(df.filter(F.col(value).isNotNull()), value, d, by, order, out="_w", **kw) if d else df.withColumn("_w", F.col(value))
    long_ar = fit_ar(w, "_w", LONG_AR, by, order, **kw)
    r = recent(w, "_w", LONG_AR + 1, "_r", by, order, **kw).join(long_ar, by)
    c = F.col("coefficients")
    fitted = F.get(c, 0) + F.aggregate(F.zip_with(F.slice(F.reverse("_r"), 2, LONG_AR), F.slice(c, 2, LONG_AR), lambda x, y: x * y),
                                       F.lit(0.0), lambda s, v: s + v)
    r = r.withColumn("_e", F.when((F.size("_r") == LONG_AR + 1) & c.isNotNull(), F.col("_w") - fitted).otherwise(0.0))
    r = r.select(*by, *order, value, "_w", "_e", (F.size("_r") == LONG_AR + 1).alias("_ok"))

    def compute(x, part, key):
        win = o.series_window(part, key)
        frame = win.rowsBetween(-lags, 0)
        return x.withColumns({"_ws": F.collect_list("_w").over(frame), "_es": F.collect_list("_e").over(frame)})

    framed = o.framed(r, by, order, compute, back=lags, **kw)

    def design(cols):
        ws, es = cols
        return np.column_stack([ws[:, -1], np.ones(len(ws)), ws[:, -2::-1], es[:, -2::-1]])

    xx = cross_products(framed.filter((F.size("_ws") == lags + 1) & F.col("_ok") & (F.col("_pos") > LONG_AR + lags)),
                        by, ["_ws", "_es"], design, 2 + 2 * lags)
    tail = framed.groupBy(*by).agg(F.max(F.struct("_pos", "_ws", "_es")).alias("_t")).select(*by, "_t._ws", "_t._es")
    return xx, tail


def _arma_fit(flat, lags: int, p: int, q: int, constant: bool):
    """(c, φ, θ, σ², AIC, BIC) of one order from the shared cross products, or None."""
    size = 2 + 2 * lags
    g = np.asarray(flat, dtype=float).reshape(size, size)
    xs = ([1] if constant else []) + list(range(2, 2 + p)) + list(range(2 + lags, 2 + lags + q))
    n = g[1, 1]
    if n <= len(xs) + 2:
        return None
    if xs:
        fit = _solve(g, 0, xs)
        if fit is None:
            return None
        beta, sse = fit[0], fit[1]
    else:
        beta, sse = np.zeros(0), g[0, 0]
    if sse <= 0:
        return None
    s2 = sse / n
    c = beta[0] if constant else 0.0
    rest = beta[1:] if constant else beta
    k = len(xs) + 1
    ll = -n / 2 * (math.log(2 * math.pi * s2) + 1)
    return float(c), rest[:p], rest[p:], s2, 2 * k - 2 * ll, k * math.log(n) - 2 * ll


def grid_search(df: DataFrame, p_range: Sequence[int], d_range: Sequence[int], q_range: Sequence[int], value: str = "close",
                by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """AIC and BIC of every order per series, best first within a series; unsolvable orders are left out.

    All (p, q) of one d are solved from the same cross products, so the data is read once per d.
    """
    by, lags = list(by), max(1, *p_range, *q_range)
    kw = _sliced(df, by, order, kw)
    out = None
    for d in d_range:
        xx, _ = _arma_products(df, value, d, lags, by, order, **kw)
        orders = [(p, q) for p in p_range for q in q_range]

        constant = d == 0
        part = xx.select(*by, F.explode(_order_solver(orders, lags, constant)("xx")).alias("_o")).select(
            *by, F.col("_o.p").alias("p"), F.lit(d).alias("d"), F.col("_o.q").alias("q"), "_o.aic", "_o.bic")
        out = part if out is None else out.unionByName(part)
    return out


def _order_solver(orders, lags: int, constant: bool):
    @F.pandas_udf("array<struct<p: int, q: int, aic: double, bic: double>>")
    def solve(flat: pd.Series) -> pd.Series:
        rows = []
        for f in flat:
            fits = [(p, q, _arma_fit(f, lags, p, q, constant)) for p, q in orders]
            rows.append([{"p": p, "q": q, "aic": x[4], "bic": x[5]} for p, q, x in fits if x is not None])
        return pd.Series(rows)

    return solve


def best_order(grid: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Order with the least AIC per series; no order at all is an error."""
    if grid.isEmpty():
        raise RuntimeError("no order could be fitted; widen the ranges or check the series")
    return grid.groupBy(*by).agg(F.min(F.struct("aic", "p", "d", "q")).alias("_b")).select(*by, "_b.p", "_b.d", "_b.q", "_b.aic")


def arima_forecast(train: DataFrame, horizon: int, arma: tuple[int, int, int] = (1, 1, 1), value: str = "close",
                   by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Per series and step: forecast and 95 % interval."""
    by = list(by)
    kw = _sliced(train, by, order, kw)
    p, d, q = arma
    lags = max(1, p, q)
    if d > 2:
        raise ValueError("d may be 0, 1 or 2")
    xx, tail = _arma_products(train, value, d, lags, by, order, **kw)
    ends = o.newest(train.filter(F.col(value).isNotNull()), by, order, max(1, d), rank="_b").groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_b", value))), lambda c: c[value]).alias("_last"))

    @F.pandas_udf("array<struct<step: int, forecast: double, lower: double, upper: double>>")
    def run(flat_: pd.Series, ws_: pd.Series, es_: pd.Series, last_: pd.Series) -> pd.Series:
        out = []
        for flat, ws, es, last in zip(flat_, ws_, es_, last_):
            fit = _arma_fit(flat, lags, p, q, d == 0)
            if fit is None:
                out.append([])
                continue
            c, phi, theta, s2, _, _ = fit
            w, e = list(ws), list(es)
            psi = np.zeros(horizon)
            for h in range(horizon):
                w.append(c + sum(phi[i] * w[-1 - i] for i in range(p)) + sum(theta[i] * e[-1 - i] for i in range(q)))
                e.append(0.0)
                psi[h] = 1.0 if h == 0 else sum(phi[i] * psi[h - 1 - i] for i in range(min(p, h))) + (theta[h - 1] if h <= q else 0.0)
            y = np.array(w[-horizon:])
            level = list(last)
            if d == 2:
                y = (level[0] - level[1]) + np.cumsum(y)
            if d >= 1:
                y = level[0] + np.cumsum(y)
            for _ in range(d):
                psi = np.cumsum(psi)
            spread = 1.959963984540054 * np.sqrt(s2 * np.cumsum(psi * psi))
            out.append([{"step": h, "forecast": float(y[h]), "lower": float(y[h] - spread[h]), "upper": float(y[h] + spread[h])}
                        for h in range(horizon)])
        return pd.Series(out)

    j = xx.join(tail, by).join(ends, by)
    return j.select(*by, F.explode(run("xx", "_ws", "_es", "_last")).alias("_f")).select(*by, "_f.*")


def horizon_rows(split: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER, **kw) -> DataFrame:
    """Test rows with their 0-based step into the horizon."""
    test = split.filter("part = 'test'")
    return o.numbered(test, by, order, out="_pos", **kw).select(*by, *order, (F.col("_pos") - 1).cast("int").alias("step"),
                                                              F.col(value).alias("actual"))


def event_signal(errors: DataFrame, event: tuple[int, int], baselines: Sequence[tuple[int, int]], by: Sequence[str] = BY,
                 step: str = "step", error: str = "error") -> DataFrame:
    """z-score of the absolute forecast error in the event window against near baseline windows."""
    if not any(a < b for a, b in baselines):
        raise ValueError("baseline windows are empty")
    by = list(by)
    s, e = F.col(step), F.abs(F.col(error))
    near = F.lit(False)
    for a, b in baselines:
        near = near | ((s >= a) & (s < b))
    base, inside = F.when(near, e), F.when((s >= event[0]) & (s < event[1]), e)
    stats = errors.groupBy(*by).agg(F.avg(base).alias("baseline_mean"), F.stddev_pop(base).alias("baseline_std"),
                                    F.avg(inside).alias("_m"), F.max(inside).alias("_hi"), F.min(inside).alias("_lo"))
    sd = F.nullif("baseline_std", F.lit(0.0))
    z_mean = F.try_divide(F.col("_m") - F.col("baseline_mean"), sd)
    top = F.greatest(F.abs(F.try_divide(F.col("_hi") - F.col("baseline_mean"), sd)), F.abs(F.try_divide(F.col("_lo") - F.col("baseline_mean"), sd)))
    strength = F.when(top > 3, "clear").when(top > 2, "moderate").when(top.isNotNull(), "none").otherwise("no_variance")
    return stats.select(*by, "baseline_mean", "baseline_std", z_mean.alias("event_mean_z"), top.alias("max_event_z"), strength.alias("strength"))


# --- trend and season by ridge regression ------------------------------------

CHANGEPOINTS, WEEKLY, YEARLY = 25, 3, 10
CHANGEPOINT_SCALES = (0.001, 0.05, 0.5)
# A season is fitted only from this many days of training data on.
WEEKLY_FROM_DAYS, YEARLY_FROM_DAYS = 14, 730


def _trend_columns(t: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Intercept, slope, hinge terms over the first 80 % of the training span, weekly and yearly waves."""
    hinges = np.maximum(t[:, None] - np.linspace(0, 0.8, CHANGEPOINTS + 1)[1:][None, :], 0.0)
    waves = [f(2 * np.pi * (i + 1) * day / period) for period, k in ((7.0, WEEKLY), (365.25, YEARLY)) for i in range(k) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(t)), t, hinges, *waves])


TREND_WIDTH = 2 + CHANGEPOINTS + 2 * (WEEKLY + YEARLY)


def trend_season_forecast(split: DataFrame, value: str = "close", by: Sequence[str] = BY, order: Sequence[str] = ORDER,
                          scales: Sequence[float] = (0.05,), on: str = "ts") -> DataFrame:
    """Forecast of the test rows by a piecewise-linear trend with seasons; one result per scale.

    A ridge penalty takes the place of the prior of the reference's forecaster: small scales keep the
    trend rigid. All scales are solved from the same cross products.
    """
    by = list(by)
    day = F.unix_seconds(F.col(on).cast("timestamp")) / 86400.0
    train = F.col("part") == "train"
    span = split.groupBy(*by).agg(F.min(F.when(train, day)).alias("_d0"), F.max(F.when(train, day)).alias("_d1"),
                                  F.max(F.when(train, F.abs(value))).alias("_top"))
    rows = split.join(span, by).withColumns({
        "_day": day, "_t": F.try_divide(day - F.col("_d0"), F.nullif(F.col("_d1") - F.col("_d0"), F.lit(0.0))),
        "_y": F.try_divide(F.col(value), F.nullif("_top", F.lit(0.0)))})

    def design(cols):
        t, dd, y = (c[:, 0] for c in cols)
        return np.column_stack([y, _trend_columns(t, dd)])

    width = TREND_WIDTH + 1
    xx = cross_products(rows.filter((F.col("part") == "train") & F.col("_t").isNotNull() & F.col("_y").isNotNull()), by, ["_t", "_day", "_y"], design, width)
    options = [float(s) for s in scales]

    @F.pandas_udf("array<struct<scale: double, beta: array<double>, n_changepoints: int>>")
    def solve(flat_: pd.Series, days_: pd.Series) -> pd.Series:
        out = []
        for flat, days in zip(flat_, days_):
            g = np.asarray(flat).reshape(width, width)
            a, b = g[1:, 1:], g[1:, 0]
            noise = 0.05 ** 2
            fits = []
            for tau in options:
                ridge = np.full(TREND_WIDTH, noise / 100.0)
                waves = 2 + CHANGEPOINTS
                if days < WEEKLY_FROM_DAYS:
                    ridge[waves:waves + 2 * WEEKLY] = 1e12
                if days < YEARLY_FROM_DAYS:
                    ridge[waves + 2 * WEEKLY:] = 1e12
                ridge[0] = ridge[1] = noise / 25.0
                ridge[2:2 + CHANGEPOINTS] = noise / tau ** 2
                beta = np.linalg.solve(a + np.diag(ridge), b)
                fits.append({"scale": tau, "beta": beta.tolist(), "n_changepoints": int((np.abs(beta[2:2 + CHANGEPOINTS]) > 0.01).sum())})
            out.append(fits)
        return pd.Series(out)

    xx = xx.join(span.select(*by, (F.col("_d1") - F.col("_d0")).alias("_days")), by)
    models = xx.select(*by, F.explode(solve("xx", "_days")).alias("_m")).select(*by, "_m.*")

    @F.pandas_udf("double")
    def predict(t: pd.Series, dd: pd.Series, beta: pd.Series) -> pd.Series:
        x = _trend_columns(t.to_numpy(), dd.to_numpy())
        return pd.Series((x * np.vstack(beta.to_numpy())).sum(axis=1))

    test = rows.filter((F.col("part") == "test") & F.col("_t").isNotNull()).join(models, by)
    return test.select(*by, *order, "scale", "n_changepoints", F.col(value).alias("actual"),
                       (predict("_t", "_day", "beta") * F.col("_top")).alias("forecast"))
