"""Keyed state of the live job: tick history with its features, sentiment as of each tick, throttled notices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewatch.schemas import FEATURES, LIVE_HISTORY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: A tick that is this much older than the newest one of its symbol is put aside.
LATENESS_MS = 600_000
#: Sentiment scores that a symbol keeps; ticks are at most LATENESS_MS behind the newest tick.
HELD_SCORES = 64
#: Ticks whose windows are laid out at once.
ROWS = 4096


def _windows(ms: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For the ticks at the places ``at`` of a time-ordered series: the places of the rows up to and with each (right-aligned,
    ``size`` columns) and how many of them count. Of rows of one time only the last counts, before a tick's own."""
    last = np.flatnonzero(np.append(ms[1:] != ms[:-1], True))
    group = np.searchsorted(last, at)
    count = group - np.searchsorted(last, at - size + 1) + 1
    back = np.arange(size - 1, -1, -1)
    place = last[np.maximum(group[:, None] - back, 0)]
    place[:, -1] = at
    return place, count


def _tail_mean(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of the last ``n`` columns of each row, null values left out."""
    there = (np.arange(x.shape[1])[::-1] < n[:, None]) & ~np.isnan(x)
    size = there.sum(axis=1)
    return np.where(size > 0, np.where(there, x, 0).sum(axis=1) / np.maximum(size, 1), np.nan)


def _tail_std(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    there = (np.arange(x.shape[1])[::-1] < n[:, None]) & ~np.isnan(x)
    size, mean = there.sum(axis=1), _tail_mean(x, n)
    square = np.where(there, (x - mean[:, None]) ** 2, 0).sum(axis=1)
    return np.where(size >= 2, np.sqrt(square / np.maximum(size - 1, 1)), np.nan)


def _ema(x: np.ndarray, count: np.ndarray, span: int) -> np.ndarray:
    """Smoothing that starts at the first row of each window."""
    a, back = 2.0 / (span + 1), np.arange(x.shape[1])[::-1]
    weight = np.where(back[None, :] == count[:, None] - 1, (1 - a) ** back, a * (1 - a) ** back)
    return (np.where(back < count[:, None], x, 0) * weight).sum(axis=1)


def window_features(ms: np.ndarray, close: np.ndarray, volume: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows known, the fourteen features in schema order; NaN where unknown) of the ticks at ``at``, without a loop over ticks."""
    place, count = _windows(ms, at, LIVE_HISTORY)
    here = np.arange(LIVE_HISTORY)[::-1] < count[:, None]
    c, v = np.where(here, close[place], np.nan), np.where(here, volume[place], np.nan)
    diff = np.diff(c, axis=1, prepend=np.nan)
    before = np.concatenate([np.full((len(c), 1), np.nan), c[:, :-1]], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = np.where(before != 0, c / before - 1, np.nan)
        ret[np.isinf(ret)] = np.nan

        def change(k: int) -> np.ndarray:
            old = c[:, -1 - k]
            return np.where(old != 0, c[:, -1] / old - 1, np.nan)

        mean_v = _tail_mean(v, np.minimum(count, 20))
        fourteen = np.minimum(count, 14)
        first_row = count <= 14  # the step of a first row counts as none
        steps = np.where(first_row[:, None] & (np.arange(LIVE_HISTORY)[::-1] == count[:, None] - 1), 0.0, diff)
        gain, loss = _tail_mean(np.maximum(steps, 0), fourteen), _tail_mean(np.maximum(-steps, 0), fourteen)
        rsi = np.where((gain == 0) & (loss == 0), 50.0, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))
        out = {
            "return": change(1),
            "log_return": np.where((before[:, -1] > 0) & (c[:, -1] > 0), np.log(c[:, -1] / before[:, -1]), np.nan),
            "rolling_return_5d": change(5), "rolling_return_10d": change(10), "price_momentum": c[:, -1] - c[:, -11],
            "volume_ratio_20d": np.where(mean_v != 0, v[:, -1] / mean_v, np.nan), "rolling_volume_mean": mean_v,
            "rolling_volume_std": _tail_std(v, np.minimum(count, 20)),
            "obv": np.nansum(np.sign(np.nan_to_num(ret)) * np.nan_to_num(v), axis=1),
            "volatility_20d": _tail_std(ret, np.full(len(c), 20)) * np.sqrt(252), "true_range": np.abs(diff[:, -1]),
            "atr_14d": np.where(count > 2, _tail_mean(np.abs(diff), np.full(len(c), 14)), np.nan),
            "rsi_14d": np.where(count >= 2, rsi, np.nan),
            "macd": np.where(count >= 26, _ema(c, count, 12) - _ema(c, count, 26), np.nan),
        }
    return count, np.stack([out[f] for f in FEATURES], axis=1)


_TICK = [T.StructField("event_id", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("market", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("price", T.DoubleType()),
         T.StructField("volume", T.DoubleType())]
LIVE_ROW = T.StructType([
    T.StructField("kind", T.StringType()), *_TICK, T.StructField("history", T.IntegerType()),
    *[T.StructField(f, T.DoubleType()) for f in FEATURES],
    T.StructField("sentiment_score", T.DoubleType()), T.StructField("sentiment_ms", T.LongType()), T.StructField("reason", T.StringType()),
])
_NAMES = [f.name for f in _TICK]


class TickHistory(StatefulProcessor):
    """Keeps the newest ticks and sentiment scores of a symbol.

    Every new tick leaves as a row of kind ``features``, with the last sentiment at or before its time. A tick that comes later than
    LATENESS_MS behind the newest one known before the batch, or is older than a full history, leaves as ``quarantine``; so do rows that
    carry a reason already. A tick whose event id is still held is a redelivery and is dropped. The rows of a symbol in one micro-batch are
    ordered by time first, so the result does not depend on their order in it.
    """

    def __init__(self, ttl_ms: int | None = None, lateness_ms: int = LATENESS_MS, default: float = 0.0) -> None:
        self._ttl_ms, self._lateness_ms, self._default = ttl_ms, lateness_ms, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._ticks = handle.getListState("ticks", "ms BIGINT, event_id STRING, price DOUBLE, volume DOUBLE", ttlDurationMs=self._ttl_ms)
        self._scores = handle.getListState("scores", "ms BIGINT, event_id STRING, score DOUBLE", ttlDurationMs=self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        bad = pdf[pdf["kind"] == "bad"]
        if len(bad):
            yield self._aside(bad, bad["reason"])
        ticks = pdf[pdf["kind"] == "tick"]
        score_ms, score = self._sentiment(pdf[pdf["kind"] == "sentiment"])
        if not len(ticks):
            return
        held = pd.DataFrame([tuple(x) for x in self._ticks.get()], columns=["timestamp_ms", "event_id", "price", "volume"])
        ticks = ticks.drop_duplicates("event_id")
        ticks = ticks[~ticks["event_id"].isin(held["event_id"])]
        if len(held):
            limit = held["timestamp_ms"].max() - self._lateness_ms
            limit = max(limit, held["timestamp_ms"].min()) if len(held) >= LIVE_HISTORY else limit
            late = ticks["timestamp_ms"] < limit
            if late.any():
                yield self._aside(ticks[late], "late")
            ticks = ticks[~late]
        if not len(ticks):
            return
        both = pd.concat([held.assign(new=False), ticks[[*_NAMES]].assign(new=True)], ignore_index=True) if len(held) else ticks[[*_NAMES]].assign(new=True)
        both = both.sort_values(["timestamp_ms", "event_id"], kind="stable").reset_index(drop=True)
        ms, price, volume = (both[n].to_numpy() for n in ("timestamp_ms", "price", "volume"))
        new = np.flatnonzero(both["new"].to_numpy(dtype=bool))
        for a in range(0, len(new), ROWS):
            at = new[a:a + ROWS]
            count, values = window_features(ms.astype(np.int64), price.astype(float), volume.astype(float), at)
            own = both.iloc[at]
            known = np.searchsorted(score_ms, ms[at].astype(np.int64), side="right") - 1
            out = own[_NAMES].reset_index(drop=True)
            out["symbol"] = key[0]
            out.insert(0, "kind", "features")
            out["history"] = count.astype(np.int32)
            out[FEATURES] = values
            out["sentiment_score"] = np.where(known >= 0, np.append(score, self._default)[known], self._default)
            out["sentiment_ms"] = pd.array(np.where(known >= 0, np.append(score_ms, 0)[known], 0), dtype="Int64")
            out.loc[known < 0, "sentiment_ms"] = pd.NA
            out["reason"] = None
            yield out
        keep = both.tail(LIVE_HISTORY)
        self._ticks.put(list(zip(keep["timestamp_ms"].astype(int).tolist(), keep["event_id"].tolist(), keep["price"].astype(float).tolist(),
                                 keep["volume"].astype(float).tolist())))

    def _sentiment(self, fresh: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        known = [tuple(x) for x in self._scores.get()]
        if len(fresh):
            known += list(zip(fresh["timestamp_ms"].astype(int).tolist(), fresh["event_id"].tolist(), fresh["sentiment_score"].astype(float).tolist()))
            known.sort(key=lambda r: (r[0], r[1] or ""))
            self._scores.put(known[-HELD_SCORES:])
        return np.array([r[0] for r in known], dtype=np.int64), np.array([r[2] for r in known], dtype=float)

    @staticmethod
    def _aside(rows: pd.DataFrame, reason) -> pd.DataFrame:
        out = rows[_NAMES].assign(kind="quarantine", reason=reason)
        for name in (n for n in LIVE_ROW.fieldNames() if n not in out.columns):
            out[name] = pd.array([None] * len(out), dtype="Int64") if name in ("history", "sentiment_ms") else np.nan
        for name in ("timestamp_ms",):
            out[name] = out[name].astype("Int64")
        return out[LIVE_ROW.fieldNames()]

    def close(self) -> None:
        pass


def _tws(df: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType, expire: bool) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append",
                                                      timeMode="ProcessingTime" if expire else "None")


#: Rows that carry a reason pass through this many keys of their own, so that they do not gather in one task.
BAD_KEYS = 64


def live_rows(ticks: DataFrame, sentiment: DataFrame | None = None, expire: bool = False) -> DataFrame:
    """Rows of LIVE_ROW for a stream of ticks, and of a stream of sentiment scores that the ticks meet in the state.

    ``ticks`` may have a column ``reasons`` (of ``validate.checked``); rows with a reason go to the quarantine. ``expire`` drops the history
    of a symbol that was silent for a day. Expiry runs on processing time, which keeps a query alive, so runs over the available
    input only leave it off.
    """
    reason = F.array_join("reasons", ",") if "reasons" in ticks.columns else F.lit("")
    bad = reason != ""
    spread = F.concat(F.lit("\x00bad"), F.pmod(F.xxhash64("event_id", "timestamp_ms"), F.lit(BAD_KEYS)).cast("string"))
    rows = ticks.select(F.when(bad, spread).otherwise(F.col("symbol")).alias("key"), F.when(bad, "bad").otherwise("tick").alias("kind"), *_NAMES,
                        F.lit(None).cast("double").alias("sentiment_score"), F.when(bad, reason).alias("reason"))
    if sentiment is not None:
        none = {"market": "string", "source": "string", "price": "double", "volume": "double"}
        moods = sentiment.withColumns({n: F.lit(None).cast(k) for n, k in none.items()})
        rows = rows.unionByName(moods.select(F.col("symbol").alias("key"), F.lit("sentiment").alias("kind"), *_NAMES,
                                             F.col("sentiment_score").cast("double"), F.lit(None).cast("string").alias("reason")))
    return _tws(rows, "key", TickHistory(DAY_MS if expire else None), LIVE_ROW, expire)


NOTICE = T.StructType([T.StructField("scope", T.StringType()), T.StructField("timestamp_ms", T.LongType())])


class LastNotice(StatefulProcessor):
    """Lets an event through when more than ``gap_ms`` have passed since the last one that came through."""

    def __init__(self, gap_ms: int) -> None:
        self._gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([pdf["timestamp_ms"].to_numpy(dtype=np.int64) for pdf in rows]))
        last = self._last.get()[0] if self._last.exists() else None
        sent = []
        at = 0 if last is None else int(np.searchsorted(times, last + self._gap_ms, side="right"))
        while at < len(times):  # one step for each notice
            last = int(times[at])
            sent.append(last)
            at = int(np.searchsorted(times, last + self._gap_ms, side="right"))
        if sent:
            self._last.update((last,))
            yield pd.DataFrame({"scope": key[0], "timestamp_ms": sent})

    def close(self) -> None:
        pass


def _distinct(batches):
    """Drops repeated (scope, time) of a batch before the shuffle: a hot scope sends each millisecond once per batch."""
    for batch in batches:
        yield batch.drop_duplicates()


def throttled_notices(events: DataFrame, key: str, at: str = "timestamp_ms", gap_ms: int = 300_000) -> DataFrame:
    """(scope, timestamp_ms) of the events that come more than ``gap_ms`` after the last notice of their key; the first always does.

    Time is the events' own, in milliseconds, and one number per key is kept. An event older than the last notice gives none, so a batch
    that is delivered again adds nothing.
    """
    rows = events.select(F.col(key).alias("scope"), F.col(at).alias("timestamp_ms")).filter("scope is not null and timestamp_ms is not null")
    return _tws(rows.mapInPandas(_distinct, NOTICE), "scope", LastNotice(gap_ms), NOTICE, False)
