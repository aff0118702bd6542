"""Writes that may be repeated: latest values, alerts, conflict splits, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.text import csv_field, duration_hours
from tapewatch.operators import ordered as o


def latest_sentiment(events: DataFrame) -> DataFrame:
    """Last score per symbol of an append-only log."""
    return events.groupBy("symbol").agg(
        F.max_by("sentiment_score", F.struct("timestamp_ms", "event_id")).alias("sentiment_score"),
        F.max("timestamp_ms").alias("timestamp_ms"))


def alert_bars(alerts: DataFrame) -> DataFrame:
    """One bar per (user, symbol, ts) with o = h = l = c = price of the first alert."""
    first = o.first_per_key(alerts, ["user_id", "symbol", "ts"], [F.col("event_id")])
    price = F.col("price")
    return first.select("user_id", "symbol", "market", "ts", "event_id", price.alias("open"), price.alias("high"),
                        price.alias("low"), price.alias("close"), "volume", "anomaly_score")


def new_keys(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def conflicts(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``status``: 'conflict' if the key is stored or came earlier in the same batch, else 'created'."""
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    first = rows.groupBy(*keys).agg(F.min("row_no").alias("_first"))
    joined = rows.join(known, keys, "left").join(first, keys)
    taken = F.col("_known").isNotNull() | (F.col("row_no") > F.col("_first"))
    return joined.withColumn("status", F.when(taken, "conflict").otherwise("created")).drop("_known", "_first")


def newest_view(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The capped view of an unbounded log; the log itself is kept whole."""
    return df.orderBy(*order).limit(limit)


def audit_rows(cases: DataFrame, users: DataFrame, links: DataFrame) -> DataFrame:
    """Closed cases as quoted CSV lines with the SHA-256 of each line."""
    closed = cases.filter(F.col("status").isin("CLOSED", "DISMISSED"))
    counts = links.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    named = (closed.join(counts, "case_id", "left")
             .join(users.select(F.col("user_id").alias("assigned_to"), "username"), "assigned_to", "left"))
    name = F.when(F.col("assigned_to").isNull(), "System").otherwise(
        F.coalesce("username", F.concat(F.lit("User "), F.col("assigned_to").cast("string"))))
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    fields = [F.col("case_id").cast("string"), F.col("title"), F.col("status"), name,
              F.coalesce("n", F.lit(0)).cast("string"), F.date_format("created_at", stamp),
              F.coalesce(F.date_format("closed_at", stamp), F.lit("-")), duration_hours("created_at", "closed_at")]
    line = F.concat_ws(",", *[csv_field(f) for f in fields])
    return named.select("case_id", line.alias("line")).withColumn("row_sha256", F.sha2("line", 256))


def export_digest(rows: DataFrame, parts: int = 4096) -> DataFrame:
    """SHA-256 over the row hashes in case order, in two levels so that no task holds them all.

    Rows are cut into runs of case ids; each run is hashed, then the run hashes.
    """
    span = rows.agg(F.max("case_id").alias("hi"))
    run = F.floor(F.col("case_id") * parts / (F.col("hi") + 1)).cast("int")
    keyed = rows.crossJoin(F.broadcast(span)).withColumn("run", run)
    first = keyed.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "row_sha256"))),
                                        lambda x: x["row_sha256"]), ""), 256).alias("h"))
    return first.agg(F.sum("n").alias("records"),
                     F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "h"))),
                                                     lambda x: x["h"]), ""), 256).alias("sha256"))


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: str | None = "market") -> list[str]:
    """Scored days, labelled days and evaluation rows as Parquet, partitioned by market if present."""
    written = []
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{folder}/{name}")
        written.append(f"{folder}/{name}")
    return written
