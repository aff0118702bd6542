"""Edge validation: one predicate per rule, rows split in valid and quarantined with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.text import normal_symbol
from tapewatch.schemas import IDENTITY_COLUMNS, MARKETS, SENTIMENT_SOURCES


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def tick_rules() -> dict[str, Column]:
    return {
        "event_id": F.length("event_id") > 0,
        "timestamp_ms": F.col("timestamp_ms") > 0,
        "symbol": F.length("symbol").between(1, 30),
        "price": (F.col("price") > 0) & ~F.isnan("price"),
        "volume": (F.col("volume") >= 0) & ~F.isnan("volume"),
        "notional_value": (F.col("notional_value") >= 0) & ~F.isnan("notional_value"),
        "market": F.col("market").isin(*MARKETS),
    }


def sentiment_rules() -> dict[str, Column]:
    return {
        "timestamp_ms": F.col("timestamp_ms") > 0,
        "symbol": F.length("symbol").between(1, 30),
        "sentiment_score": F.col("sentiment_score").between(-1, 1),
        "source": F.col("source").isin(*SENTIMENT_SOURCES),
        "headline": F.col("headline").isNull() | (F.length("headline") <= 500),
    }


def bar_rules() -> dict[str, Column]:
    return {
        "symbol": F.length("symbol").between(1, 20),
        "open": F.col("open") > 0, "high": F.col("high") > 0, "low": F.col("low") > 0, "close": F.col("close") > 0,
        "volume": F.col("volume") >= 0, "high_low": F.col("high") >= F.col("low"),
    }


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: names of the broken rules, empty for a valid row."""
    broken = F.array(*[F.when(~_holds(rule), F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("reasons", F.array_compact(broken))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without ``reasons``, quarantined rows with it)."""
    ok = F.size("reasons") == 0
    return df.filter(ok).drop("reasons"), df.filter(~ok)


def check_ticks(df: DataFrame) -> DataFrame:
    return checked(df.withColumns({"symbol": normal_symbol("symbol"), "market": F.upper("market"),
                                   "source": F.upper("source")}), tick_rules())


def check_sentiment(df: DataFrame) -> DataFrame:
    return checked(df.withColumn("symbol", normal_symbol("symbol")), sentiment_rules())


def check_bars(df: DataFrame) -> DataFrame:
    return checked(df.withColumn("symbol", normal_symbol("symbol")), bar_rules())


def identity_leaks(columns: list[str]) -> list[str]:
    return sorted(set(c.lower() for c in columns) & set(IDENTITY_COLUMNS))


def refuse_identity(columns: list[str], context: str = "features") -> None:
    """No model may see which asset a row belongs to."""
    leaks = identity_leaks(columns)
    if leaks:
        raise ValueError(f"{context}: identity columns in the feature set: {leaks}")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
