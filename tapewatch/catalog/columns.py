"""Column functions over the tick, anomaly and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.series_windows import TICK_FEATURES, rounded
from tapewatch.functions import scoring as sc
from tapewatch.functions import text as tx
from tapewatch.operators import desk
from tapewatch.operators import features as ft
from tapewatch.operators import ordered as o
from tapewatch.sources import tables as t
from tapewatch.sources.sinks import newest_view

AN = sql.ANOMALIES


@query("symbol_market", "P1 P2 J17 F3",
       """SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS symbol, CASE WHEN contains(upper(p_name || s), 'USDT')
         OR contains(upper(p_name || s), 'BTC') OR contains(upper(p_name || s), 'ETH') OR contains(upper(p_name || s), '-')
         OR contains(upper(p_name || s), '/') THEN 'CRYPTO' ELSE 'US_EQUITY' END AS market,
        replace(upper(p_name || s), '-', '') AS canonical, 'BYBIT_' || p_name || '_' || p_partkey || '_' ||
         left(sha256('BYBIT|' || p_name || '|' || p_partkey), 8) AS event_id
       FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'usdt' WHEN 1 THEN '-x' ELSE '' END AS s FROM part)""")
def symbol_market(spark, d):
    p = t.read(spark, d, "part")
    suffix = F.when(F.col("p_size") % 4 == 0, "usdt").when(F.col("p_size") % 4 == 1, "-x").otherwise("")
    s = F.concat("p_name", suffix)
    return p.select("p_partkey", tx.normal_symbol(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("symbol"),
                    tx.infer_market(s).alias("market"), tx.canonical_symbol(s).alias("canonical"),
                    tx.event_id(F.lit("BYBIT"), "p_name", "p_partkey").alias("event_id"))


@query("tick_confidence", "P3 F5 F4",
       f"""WITH {sql.TICKS} SELECT event_id, source NOT IN ('BINANCE', 'BYBIT', 'ALPACA', 'FINNHUB') AS low_confidence,
        round(price * volume, 6) AS notional, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM ticks""")
def tick_confidence(spark, d):
    x = t.ticks(spark, d)
    return x.select("event_id", sc.low_confidence(F.lower("source")).alias("low_confidence"),
                    tx.notional("price", "volume", 6).alias("notional"),
                    F.date_format(tx.from_millis("timestamp_ms"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("anomaly_scores", "P4 P5 P6 P7 F6 F7 F8 T-6",
       f"""WITH {AN}, g AS (SELECT *, CASE WHEN if_score >= 0.6 AND mp_score >= 0.6 THEN 1.0 ELSE 0.5 END AS agreement,
         list_sort([pump_and_dump, wash_trading, spoofing, layering], 'DESC') AS v FROM anomalies)
       SELECT anomaly_id, anomaly_score, severity, primary_signal, is_anomaly, CAST(agreement AS DOUBLE) AS agreement,
        CASE WHEN mp_score IS NOT NULL THEN upper(replace(best_pattern, '_', ' ')) ELSE 'ANOMALY' END AS label,
        CASE WHEN mp_score IS NOT NULL THEN CAST(round(CAST(round(v[1] / (v[1] + v[2] + 1e-9), 4) AS DECIMAL(10, 4)) * CAST(agreement AS DECIMAL(2, 1)), 4) AS DOUBLE) END AS confidence,
        CASE WHEN mp_score IS NOT NULL THEN v[2] END AS runner_up FROM g""")
def anomaly_scores(spark, d):
    a = t.anomalies(spark, d).withColumn("agreement", sc.agreement_live("if_score", "mp_score"))
    return a.select("anomaly_id", sc.combined_score("if_score", "mp_score").alias("anomaly_score"),
                    sc.severity("anomaly_score").alias("severity"),
                    sc.primary_signal("pattern_scores", "anomaly_score").alias("primary_signal"),
                    sc.is_anomaly("anomaly_score").alias("is_anomaly"), "agreement",
                    sc.pattern_label("pattern_scores").alias("label"),
                    sc.label_confidence("pattern_scores", "agreement").alias("confidence"),
                    sc.top_scores("pattern_scores")[1].alias("runner_up"))


@query("pattern_scores_json", "F12 F11",
       f"""WITH {AN} SELECT anomaly_id, pump_and_dump, layering, coalesce(best_pattern, 'anomaly') AS label,
        CAST(CASE WHEN if_score >= 0.6 AND mp_score >= 0.6 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS agreement FROM anomalies""")
def pattern_scores_json(spark, d):
    a = t.anomalies(spark, d)
    as_text = F.when(F.col("event_type") == "signup", F.lit("{broken")).otherwise(F.to_json("pattern_scores"))
    a = a.withColumn("parsed", F.from_json(as_text, "MAP<STRING, DOUBLE>"))
    a = a.withColumn("parsed", F.when(F.size("parsed") > 0, F.col("parsed")))
    result = sc.detection_result(F.col("parsed"), F.lit(None).cast("double"), "anomaly_score",
                                 sc.agreement_live("if_score", "mp_score"), F.lit("desk"), F.array())
    a = a.withColumn("result", result)
    return a.select("anomaly_id", F.element_at("parsed", "pump_and_dump").alias("pump_and_dump"),
                    F.element_at("parsed", "layering").alias("layering"), F.col("result.label").alias("label"),
                    F.col("result.detector_agreement").alias("agreement"))


@query("coverage_codes", "P8 P10 P22",
       f"""WITH {sql.TICKS}, b AS (SELECT symbol, avg(price) AS m, CASE WHEN count(*) > 65 THEN stddev_samp(price) ELSE 0 END AS sd
         FROM ticks GROUP BY symbol),
       s AS (SELECT t.*, market = 'CRYPTO' OR user_id % 3 = 0 AS has_model, sd > 0 AS ok,
         source NOT IN ('BINANCE', 'BYBIT', 'ALPACA', 'FINNHUB') AS low, m, sd FROM ticks t JOIN b USING (symbol)),
       c AS (SELECT event_id, CASE WHEN NOT has_model AND low THEN 'model_unavailable' WHEN NOT has_model THEN 'no_model_high_confidence'
         WHEN NOT ok AND low THEN 'baseline_unavailable' WHEN NOT ok THEN 'no_baseline_high_confidence' END AS code,
         CASE WHEN ok THEN (price - m) / sd END AS z, has_model FROM s)
       SELECT event_id, code, {sql.r('CASE WHEN code IS NULL THEN z END')} AS z, code IS NULL AS scored FROM c""")
def coverage_codes(spark, d):
    x = t.ticks(spark, d)
    n = F.count(F.lit(1))
    b = x.groupBy("symbol").agg(F.avg("price").alias("m"), F.when(n > 65, F.stddev_samp("price")).otherwise(0.0).alias("sd"))
    x = x.join(b, "symbol").withColumn("has_model", (F.col("market") == "CRYPTO") | (F.col("user_id") % 3 == 0))
    x = x.withColumn("code", sc.coverage_code("has_model", sc.baseline_valid("m", "sd"), sc.low_confidence("source")))
    x = x.withColumn("z", F.when(F.col("code").isNull(), sc.against_baseline("price", "m", "sd")))
    return x.select("event_id", "code", *rounded(["z"]), sc.is_scored_alert("z", "code").alias("scored"))


@query("evidence_signals", "F9 P21 M36",
       f"""WITH {TICK_FEATURES}, s AS (SELECT *, 0.5 + value_ / 1000 AS if_score, volume / 100 AS mp_score FROM (SELECT *, price AS value_ FROM feats)),
       e AS (SELECT event_id, pos, ({sql.COMPLETE}) AS known, concat_ws(',', nullif({sql.evidence('if_score', 'mp_score')}, ''),
         CASE WHEN if_score >= 0.6 AND mp_score >= 0.6 THEN 'dual_detector_agreement' END) AS signals FROM s)
       SELECT event_id, signals, CASE WHEN pos >= 20 AND known THEN 'ok' ELSE 'insufficient_history' END AS status FROM e""")
def evidence_signals(spark, d):
    f = ft.engineered_features(t.ticks(spark, d), keep_position=True)
    f = f.withColumns({"if_score": 0.5 + F.col("price") / 1000, "mp_score": F.col("volume") / 100})
    dual = sc.agreement_live("if_score", "mp_score")
    return f.select("event_id", sc.evidence_names(sc.evidence("if_score", "mp_score", dual=dual)).alias("signals"),
                    ft.feature_status(f).alias("status"))


@query("evidence_strength", "F22 F10",
       f"""WITH {TICK_FEATURES}, e AS (SELECT event_id, 'volume_spike' AS name, volume_ratio_20d AS v, 1.5 AS th FROM feats WHERE volume_ratio_20d > 1.5
         UNION ALL SELECT event_id, 'high_volatility', volatility_20d, 0.8 FROM feats WHERE volatility_20d > 0.8
         UNION ALL SELECT event_id, 'large_return', "return", 0.05 FROM feats WHERE abs("return") > 0.05)
       SELECT event_id, name, {sql.r('(v - th) / (th / 2)')} AS z, {sql.r('least(99.9, 50 + (v - th) / (th / 2) * 15)')} AS percentile,
        CASE WHEN v / th >= 2.5 THEN 'HIGH' WHEN v / th >= 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM e""")
def evidence_strength(spark, d):
    f = ft.engineered_features(t.ticks(spark, d))
    e = f.select("event_id", F.explode(sc.training_evidence()).alias("e")).select("event_id", "e.*")
    e = e.withColumn("z", sc.z_estimate("value", "threshold"))
    e = e.withColumn("percentile", sc.percentile_estimate("z"))
    return e.select("event_id", "name", *rounded(["z", "percentile"]),
                    sc.multiple_band(sc.threshold_multiple("value", "threshold")).alias("band"))


POSITIVE = ["the", "la", "der", "el", "up", "buy"]
NEGATIVE = ["of", "de", "und", "los", "down", "sell"]


def _word_count(words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_intersect(w, [{listed}]))"


@query("headline_sentiment", "F1 U4",
       f"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents),
       c AS (SELECT doc_id, {_word_count(POSITIVE)} AS p, {_word_count(NEGATIVE)} AS n,
         {_word_count(tx.POSITIVE_WORDS)} AS dp, {_word_count(tx.NEGATIVE_WORDS)} AS dn FROM w)
       SELECT doc_id, CASE WHEN p + n = 0 THEN 0 ELSE round((p - n) / (p + n), 3) END AS custom_score,
        CASE WHEN dp + dn = 0 THEN 0 ELSE round((dp - dn) / (dp + dn), 3) END AS sentiment_score FROM c""")
def headline_sentiment(spark, d):
    h = t.headlines(spark, d)
    return h.select("doc_id", tx.sentiment("text", POSITIVE, NEGATIVE).alias("custom_score"),
                    tx.sentiment("text").alias("sentiment_score"))


def _watched(words):
    return "CASE " + " ".join(f"WHEN contains(upper(text), '{w}') THEN '{w}'" for w in
                              sorted(words, key=lambda s: (-len(s), s))) + " END"


WATCHED = [*tx.WATCH_SYMBOLS, "ETIO", "REAU", "TION", "ANAN"]


@query("headline_symbol", "F2",
       f"SELECT doc_id, {_watched(WATCHED)} AS symbol, {_watched(tx.WATCH_SYMBOLS)} AS default_symbol FROM documents")
def headline_symbol(spark, d):
    h = t.headlines(spark, d)
    return h.select("doc_id", tx.watched_symbol("text", WATCHED).alias("symbol"), tx.watched_symbol("text").alias("default_symbol"))


@query("note_hashtags", "F18",
       """WITH n AS (SELECT conv_id, turn, '#' || upper(role) || '_NOTE ' || text || ' #' || conv_id || ' #REVIEW' AS body FROM conversations)
       SELECT conv_id, turn, array_to_string(regexp_extract_all(body, '#[A-Z_]+'), ',') AS tags,
        trim(regexp_replace(body, '#[A-Z_]+', '', 'g')) AS body FROM n""")
def note_hashtags(spark, d):
    c = t.read(spark, d, "conversations")
    body = F.concat(F.lit("#"), F.upper("role"), F.lit("_NOTE "), "text", F.lit(" #"), F.col("conv_id").cast("string"), F.lit(" #REVIEW"))
    return c.withColumn("raw", body).select("conv_id", "turn", F.array_join(tx.hashtags("raw"), ",").alias("tags"),
                                            tx.without_hashtags("raw").alias("body"))


@query("page_path_templates", "F19",
       "SELECT page_id, regexp_replace(url, '/\\d+', '/{id}', 'g') AS template FROM pages")
def page_path_templates(spark, d):
    return t.read(spark, d, "pages").select("page_id", tx.path_template("url").alias("template"))


@query("request_metrics", "A7 F25 F19",
       f"""WITH {sql.REQUESTS}, c AS (SELECT endpoint, method, status, count(*) AS n FROM requests GROUP BY ALL)
       SELECT endpoint, method, status, n, 'http_requests_total{{endpoint="' || endpoint || '",method="' || method || '",status_code="' ||
        status || '"}} ' || n AS line FROM c""")
def request_metrics(spark, d):
    r = t.request_log(spark, d).withColumn("endpoint", tx.path_template("path"))
    c = desk.counts(r, ["endpoint", "method", "status"])
    return c.withColumn("line", tx.metric_line("http_requests_total", {
        "endpoint": F.col("endpoint"), "method": F.col("method"), "status_code": F.col("status")}, F.col("n")))


@query("case_durations", "F20",
       f"""WITH {sql.CASES}, m AS (SELECT case_id, coalesce(closed_s, updated_s) - created_s AS s, closed_s - created_s AS c FROM cases)
       SELECT case_id, CASE WHEN s <= 0 THEN '< 1m' WHEN (s + 30) // 60 < 60 THEN (s + 30) // 60 || 'm'
         ELSE printf('%.1f', ((s + 30) // 60 * 20 + 60) // 120 / 10) || 'h' END AS duration,
        coalesce(printf('%.2f', (c * 200 + 3600) // 7200 / 100), '-') AS hours FROM m""")
def case_durations(spark, d):
    c = t.cases(spark, d)
    return c.select("case_id", tx.case_duration("created_at", "closed_at", "updated_at").alias("duration"),
                    tx.duration_hours("created_at", "closed_at").alias("hours"))


@query("sigmoid_and_path", "F17 F14 F28",
       """SELECT event_id, round(1 / (1 + exp(-greatest(least(value - 250, 500), -500))), 9) AS sigmoid,
        CASE WHEN event_id <= 1 THEN 0 ELSE round(2 * (ln(event_id - 1) + 0.5772156649) - 2.0 * (event_id - 1) / event_id, 9) END AS path,
        round(CASE WHEN event_id <= 1 THEN 0 ELSE pow(2.0, -8.0 / nullif(2 * (ln(nullif(event_id - 1, 0)) + 0.5772156649)
          - 2.0 * (event_id - 1) / event_id, 0)) END, 9) AS score, round(sqrt((value - 1) * (value - 1) + 4.0), 9) AS distance FROM events WHERE event_id <> 2""")
def sigmoid_and_path(spark, d):
    e = t.read(spark, d, "events").filter("event_id <> 2")
    return e.select("event_id", F.round(sc.sigmoid(F.col("value") - 250), 9).alias("sigmoid"),
                    F.round(sc.average_path("event_id"), 9).alias("path"),
                    F.round(sc.isolation_score(F.lit(8.0), "event_id"), 9).alias("score"),
                    F.round(sc.euclidean(F.array("value", F.lit(3.0)), F.array(F.lit(1.0), F.lit(1.0))), 9).alias("distance"))


@query("scaled_values", "F15",
       """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT event_id, round((value - m) / sd, 8) AS standard, round((value - lo) / (hi - lo), 8) AS min_max,
        round((value - q2) / (q3 - q1), 8) AS robust FROM events, s""")
def scaled_values(spark, d):
    from tapewatch.operators.metrics import scale

    e = t.read(spark, d, "events").select("event_id", F.col("value").alias("x"))
    out = None
    for kind in ("standard", "min_max", "robust"):
        out = scale(e if out is None else out, ["x"], kind).withColumnRenamed(f"x_{kind}", f"_{kind}")
    return out.select("event_id", *[F.round(f"_{k}", 8).alias(k) for k in ("standard", "min_max", "robust")])
