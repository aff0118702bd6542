"""Symbol, text, path and report-string expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Sentiment lexicon and watched symbols.
POSITIVE_WORDS = ["bullish", "moon", "buy", "calls", "long", "surge", "rally", "breakout", "pump", "up"]
NEGATIVE_WORDS = ["bearish", "short", "puts", "crash", "dump", "sell", "tank", "drop", "plummet", "down"]
WATCH_SYMBOLS = ["BTC", "ETH", "BTCUSDT", "AAPL", "TSLA", "NVDA", "SPY", "GME", "AMC", "RELIANCE", "HDFCBANK",
                 "TCS", "INFY"]
CRYPTO_MARKS = ["USDT", "BTC", "ETH", "-", "/"]


def normal_symbol(s) -> Column:
    return F.upper(F.trim(_c(s)))


def canonical_symbol(s) -> Column:
    """Symbol without separators, so BTC-USDT, BTC/USDT and BTC_USDT meet."""
    return F.translate(normal_symbol(s), "-/_", "")


def infer_market(s) -> Column:
    u = F.upper(_c(s))
    hit = F.lit(False)
    for mark in CRYPTO_MARKS:
        hit = hit | F.contains(u, F.lit(mark))
    return F.when(hit, "CRYPTO").otherwise("US_EQUITY")


def words(text) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != ""))


def sentiment(text, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    seen = words(text)
    pos = F.size(F.array_intersect(seen, F.array(*[F.lit(w) for w in positive])))
    neg = F.size(F.array_intersect(seen, F.array(*[F.lit(w) for w in negative])))
    return F.when(pos + neg == 0, 0.0).otherwise(
        F.round((pos - neg) / F.nullif(pos + neg, F.lit(0)), 3))


def watched_symbol(text, symbols: Sequence[str] = WATCH_SYMBOLS) -> Column:
    """First watched symbol inside the text: longest first, then alphabetical."""
    fixed = sorted(symbols, key=lambda s: (-len(s), s))
    u = F.upper(_c(text))
    return F.get(F.filter(F.array(*[F.lit(s) for s in fixed]), lambda s: F.contains(u, s)), 0)


def event_id(source, symbol, timestamp_ms, *salt) -> Column:
    """SOURCE_SYMBOL_ms_suffix; the suffix is a hash of the given columns, so retries repeat it."""
    parts = [_c(source), _c(symbol), _c(timestamp_ms).cast("string")]
    suffix = F.substring(F.sha2(F.concat_ws("|", *parts, *[_c(x).cast("string") for x in salt]), 256), 1, 8)
    return F.concat_ws("_", *parts, suffix)


def notional(price, volume, digits: int) -> Column:
    return F.round(_c(price) * _c(volume), digits)


def from_millis(ms) -> Column:
    return F.timestamp_millis(_c(ms))


def hashtags(body) -> Column:
    return F.regexp_extract_all(_c(body), F.lit("(#[A-Z_]+)"), 1)


def without_hashtags(body) -> Column:
    return F.trim(F.regexp_replace(_c(body), "#[A-Z_]+", ""))


def path_template(path) -> Column:
    return F.regexp_replace(_c(path), r"/\d+", "/{id}")


def headline(text, limit: int = 500) -> Column:
    return F.substring(_c(text), 1, limit)


def contains_ci(c, q: str) -> Column:
    """Case-insensitive containment; % and _ of the query mean themselves."""
    return F.contains(F.lower(_c(c)), F.lit(q.lower()))


def _fixed(numerator, denominator: int, digits: int) -> Column:
    """Integer quotient as text with fixed digits, halves rounded up."""
    scale = 10 ** digits
    units = F.floor((numerator * (2 * scale) + denominator) / (2 * denominator)).cast("bigint")
    whole, rest = F.floor(units / scale).cast("bigint"), units % scale
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


def case_duration(created, closed, updated) -> Column:
    end = F.coalesce(_c(closed), _c(updated))
    seconds = F.unix_seconds(end) - F.unix_seconds(_c(created))
    minutes = F.floor((seconds + 30) / 60).cast("bigint")
    return (F.when(seconds.isNull() | (seconds <= 0), "< 1m")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
            .otherwise(F.concat(_fixed(minutes, 60, 1), F.lit("h"))))


def duration_hours(created, closed) -> Column:
    seconds = F.unix_seconds(_c(closed)) - F.unix_seconds(_c(created))
    return F.coalesce(_fixed(seconds, 3600, 2), F.lit("-"))


def csv_field(c) -> Column:
    return F.concat(F.lit('"'), F.replace(_c(c), F.lit('"'), F.lit('""')), F.lit('"'))


def anomaly_hit_title(anomaly_id, symbol) -> Column:
    return F.format_string("Anomaly #%d (%s)", _c(anomaly_id), _c(symbol))


def anomaly_hit_subtitle(signal, score) -> Column:
    return F.format_string("%s (Score: %.2f)", _c(signal), _c(score))


def case_hit_title(case_id, title) -> Column:
    return F.format_string("Case #%d: %s", _c(case_id), _c(title))


def metric_line(name: str, labels: dict[str, Column | str], value) -> Column:
    """One exposition line: name{label="value",…} number."""
    pairs = [F.concat(F.lit(f'{k}="'), F.replace(_c(v), F.lit('"'), F.lit('\\"')), F.lit('"')) for k, v in labels.items()]
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), _c(value).cast("string"))
