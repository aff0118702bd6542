"""Live detection: validated ticks, per-symbol history in state, scoring and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tapewatch.operators import joins
from tapewatch.plans import jobs
from tapewatch.plans.registry import MarketModels
from tapewatch.schemas import FEATURES, MIN_HISTORY, TICK
from tapewatch.session import existing
from tapewatch.sources import feeds, validate
from tapewatch.streaming import state

WATERMARK = "10 minutes"


def read_tick_files(spark: SparkSession, folder: str, schema: T.StructType = TICK, fmt: str = "json",
                    files_per_trigger: int | None = None, **options) -> DataFrame:
    """Tick stream from files; a broken JSON line becomes a row of nulls and is quarantined later."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(folder)


def from_messages(stream: DataFrame, column: str = "value") -> DataFrame:
    """Unified ticks from JSON text, as a message bus delivers them."""
    parsed = stream.withColumn("_t", F.from_json(F.col(column).cast("string"), TICK))
    return parsed.select("_t.*", F.col(column).cast("string").alias("raw"))


def checked(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid ticks, dead letters with reasons). Redelivered ticks are dropped in the state of their symbol."""
    return validate.split(validate.check_ticks(stream))


def feed_ticks(binance: DataFrame | None = None, bybit: DataFrame | None = None, alpaca: DataFrame | None = None, finnhub: DataFrame | None = None,
               unified: DataFrame | None = None) -> DataFrame:
    """Unified ticks of raw message streams (JSON text in ``value``), one per feed; ``unified`` brings ticks as they are."""
    number = F.abs(F.xxhash64("value"))  # messages of a stream have no number
    made = []
    for raw, read in ((binance, feeds.crypto_a), (bybit, feeds.crypto_b), (finnhub, feeds.equity_b)):
        if raw is not None:
            made.append(read(raw.select("value", number.alias("message_no"))))
    if alpaca is not None:
        trades = alpaca.select(number.alias("message_no"), F.from_json("value", "symbol STRING, price DOUBLE, size DOUBLE, timestamp TIMESTAMP").alias("t"))
        made.append(feeds.equity_a(trades.select("message_no", "t.*")))
    if unified is not None:
        made.append(from_messages(unified).drop("raw"))
    out = None
    for part in made:
        part = part.select(*TICK.fieldNames())
        out = part if out is None else out.unionByName(part)
    return out


def tick_features(ticks: DataFrame, expire: bool = False) -> DataFrame:
    """Streaming features; the batch twin is ``engineered_features(lookback=99)``."""
    return state.live_rows(ticks, expire=expire).filter("kind = 'features'").drop("kind", "sentiment_score", "sentiment_ms", "reason")


# --- sinks -------------------------------------------------------------------

def _append(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch under its own partition, so a repeated batch replaces itself."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch_id").parquet(path))


def _stored(spark: SparkSession, path: str, schema: T.StructType, days: list[str], batch_id: int) -> DataFrame:
    """Rows stored by other batches on the given days; the folders of other days are neither listed nor read."""
    have = T.StructType([*schema.fields, T.StructField("day", T.StringType()), T.StructField("batch_id", T.LongType())])
    folders = existing(spark, [f"{path}/day={d}" for d in days])
    if not folders:
        return spark.createDataFrame([], have)
    return spark.read.schema(have).option("basePath", path).parquet(*folders).filter(F.col("batch_id") != batch_id)


KEY = ["symbol", "timestamp_ms"]


def persist_and_publish(root: str) -> Callable[[DataFrame, int], None]:
    """Stores one bar and one anomaly per (symbol, time), then publishes alerts keyed by event id.

    Both writes are keyed by batch and skip keys that other batches already stored, so a replay of a
    batch, or of a tick in a later batch, adds nothing. The stream's checkpoint commits last.
    """

    def handle(alerts: DataFrame, batch_id: int) -> None:
        spark = alerts.sparkSession
        rows = alerts.filter("anomaly_score IS NOT NULL").withColumn("day", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd"))
        days = [r.day for r in rows.select("day").distinct().collect()]
        if not days:
            return
        price = F.col("price")
        bars = rows.groupBy(*KEY).agg(F.min_by(F.struct("event_id", "market", "price", "volume", "anomaly_score", "severity", "day"), "event_id").alias("_r"))
        bars = bars.select(*KEY, "_r.*").select(*KEY, "event_id", "market", price.alias("open"), price.alias("high"), price.alias("low"),
                                               price.alias("close"), "volume", "anomaly_score", "severity", "day")
        schema = T.StructType([f for f in bars.schema.fields if f.name != "day"])
        fresh = bars.join(_stored(spark, f"{root}/anomalies", schema, days, batch_id).select(*KEY), KEY, "left_anti")
        _append(fresh, f"{root}/anomalies", batch_id)
        feed = rows.dropDuplicates(["event_id"])
        schema = T.StructType([f for f in feed.schema.fields if f.name != "day"])
        feed = feed.join(_stored(spark, f"{root}/alerts", schema, days, batch_id).select("event_id"), "event_id", "left_anti")
        _append(feed, f"{root}/alerts", batch_id)

    return handle


#: Coverage codes of ticks of a streaming feed that no model could score.
DISARMED = ("no_model_high_confidence", "no_baseline_high_confidence")


def _whole(df: DataFrame, path: str) -> DataFrame:
    """Writes a batch under its own folder, which a repeated batch replaces, and reads it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_batch(models: list[MarketModels], baselines: DataFrame | None, root: str, threshold: float = 0.7) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: quarantine, history gate, scoring by forest and classifiers, alerts, and what could not be scored.

    The state's rows are written once and read by all that follows; scoring is planned once. Rows with a coverage code are neither
    stored nor published as anomalies; those of streaming feeds go to ``disarmed`` for the notices.
    """
    sink = persist_and_publish(root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = _whole(batch, f"{root}/rows/batch={batch_id}")
        aside = rows.filter("kind = 'quarantine'").select("event_id", "symbol", "market", "source", "timestamp_ms", "price", "volume", "reason")
        aside.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")
        known = (F.col("kind") == "features") & (F.col("history") >= MIN_HISTORY)
        for f in FEATURES:
            known = known & F.col(f).isNotNull()
        scored = jobs.score_rows(rows.filter(known).drop("kind", "reason"), models, baselines, threshold)
        wanted = F.col("is_anomaly") | F.coalesce(F.col("coverage").isin(*DISARMED), F.lit(False))
        scored = _whole(scored.filter(wanted), f"{root}/scored/batch={batch_id}")
        sink(scored.filter("is_anomaly"), batch_id)
        scope = F.when(F.col("coverage") == DISARMED[0], F.col("market")).otherwise(F.concat(F.lit("baseline_"), "symbol"))
        off = scored.filter(F.col("coverage").isin(*DISARMED)).select(scope.alias("scope"), "timestamp_ms")
        off.distinct().write.mode("overwrite").parquet(f"{root}/disarmed/batch={batch_id}")

    return handle


def _started(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def start_detection(ticks: DataFrame, models: list[MarketModels], baselines: DataFrame | None, root: str, *, sentiment: DataFrame | None = None,
                    threshold: float = 0.7, available_now: bool = False) -> StreamingQuery:
    """Validated ticks through state and scoring to ``rows``, ``quarantine``, ``scored``, ``anomalies``, ``alerts`` and ``disarmed`` below ``root``.

    ``sentiment`` is a stream of (symbol, timestamp_ms, event_id, sentiment_score); a tick carries the last score at or before its time.
    """
    rows = state.live_rows(validate.check_ticks(ticks), sentiment, expire=not available_now)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", f"{root}/_checkpoint").foreachBatch(score_batch(models, baselines, root, threshold))
    return _started(writer, available_now)


def start_notices(spark: SparkSession, root: str, gap_ms: int = 300_000, available_now: bool = False) -> StreamingQuery:
    """Notices that a market or symbol is ingested but not scored, from what the detection below ``root`` could not score."""
    off = spark.readStream.schema(state.NOTICE).option("recursiveFileLookup", True).parquet(f"{root}/disarmed")
    notices = state.throttled_notices(off, "scope", gap_ms=gap_ms)
    writer = notices.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/_notices_checkpoint").option("path", f"{root}/notices")
    return _started(writer, available_now)


def run_live(spark: SparkSession, ticks: DataFrame, models: list[MarketModels], baselines: DataFrame | None, root: str, *, sentiment: DataFrame | None = None,
             threshold: float = 0.7, gap_ms: int = 300_000) -> None:
    """The whole job over the available input: detection with its outputs, then the notices."""
    start_detection(ticks, models, baselines, root, sentiment=sentiment, threshold=threshold, available_now=True).awaitTermination()
    if existing(spark, [f"{root}/disarmed"]):
        start_notices(spark, root, gap_ms, available_now=True).awaitTermination()


def write_stream(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Parquet sink run to the end of the available input."""
    return (df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-checkpoint").option("path", path)
            .trigger(availableNow=True).start())


def drain(df: DataFrame, path: str) -> DataFrame:
    """Runs a streaming frame over everything available and returns what the sink holds."""
    query = write_stream(df, path)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain_updates(df: DataFrame, path: str, keys: Sequence[str], version: str) -> DataFrame:
    """Runs an aggregating stream in update mode; the newest version of each key is its state."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (df.writeStream.outputMode("update").option("checkpointLocation", f"{path}-checkpoint").foreachBatch(handle)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = df.sparkSession.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_batch", version)).alias("_r")).select(*keys, "_r.*")


# --- feeds -------------------------------------------------------------------

def dead_letters(ticks: DataFrame) -> DataFrame:
    return checked(ticks)[1]


def watchlist_feed(alerts: DataFrame, watched: DataFrame) -> DataFrame:
    """Alerts of the stream on watched symbols; no symbols, no alerts."""
    return alerts.join(watched.select("symbol").distinct(), "symbol", "left_semi")


def alert_rate(events: DataFrame, on: str = "ts", seconds: int = 15) -> DataFrame:
    """Events per minute over the last ``seconds`` seconds, every 1.5 seconds."""
    timed = events.withWatermark(on, WATERMARK)
    counts = timed.groupBy(F.window(on, f"{seconds} seconds", "1500 milliseconds")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.end").alias("at"), "n", F.round(F.col("n") * 60 / seconds).cast("bigint").alias("per_minute"))


def latest_sentiment(events: DataFrame) -> DataFrame:
    """Running latest score per symbol (update or complete output)."""
    return events.groupBy("symbol").agg(F.max_by("sentiment_score", F.struct("timestamp_ms", "event_id")).alias("sentiment_score"),
                                        F.max("timestamp_ms").alias("timestamp_ms"))


def failover_batch(root: str, primary: str, secondary: str, gap_s: int = 30) -> Callable[[DataFrame, int], None]:
    """Failover across micro-batches: the last primary tick of earlier batches enters as a mark."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, cols = batch.sparkSession, batch.columns
        marked = batch.withColumn("_mark", F.lit(False))
        if batch_id > 0:
            state = spark.read.schema(marked.schema).parquet(f"{root}/state/batch={batch_id - 1}")
            marked = marked.unionByName(state)
        kept = joins.failover(marked, primary, secondary, gap_s)
        kept.filter(~F.col("_mark")).select(*cols).write.mode("overwrite").parquet(f"{root}/ticks/batch={batch_id}")
        last = marked.filter((F.col("source") == primary) | F.col("_mark")).orderBy(F.col("ts").desc()).limit(1)
        first = marked.orderBy("ts").limit(1).withColumn("source", F.lit(primary))
        keep = last.unionByName(first).orderBy(F.col("ts").desc()).limit(1).withColumn("_mark", F.lit(True))
        keep.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    return handle


def throughput(query: StreamingQuery) -> DataFrame:
    """Rows, rates and backlog of the recent micro-batches."""
    from pyspark.sql import SparkSession as S

    rows = [(int(p["batchId"]), int(p["numInputRows"]), float(p.get("inputRowsPerSecond") or 0.0), float(p.get("processedRowsPerSecond") or 0.0))
            for p in query.recentProgress]
    return S.getActiveSession().createDataFrame(rows, "batch_id BIGINT, n_rows BIGINT, input_per_s DOUBLE, processed_per_s DOUBLE")
