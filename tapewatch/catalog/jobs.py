"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.live import BASELINES, explained, fixed_classifier
from tapewatch.catalog.scoring import AUC_SQL, FIXED_FEATURES, SCORED_TICKS, TRUE_PATTERN, WEAK, fixed_forest, scored_ticks, weak_ticks, with_truth
from tapewatch.catalog.series_windows import TICK_FEATURES, rounded
from tapewatch.functions import scoring as sc
from tapewatch.operators import desk
from tapewatch.operators import features as ft
from tapewatch.operators import forest as fo
from tapewatch.operators import ordered as o
from tapewatch.operators.patterns import Scorecard
from tapewatch.plans import jobs, registry
from tapewatch.plans.registry import MarketModels
from tapewatch.schemas import FEATURES, PATTERNS
from tapewatch.session import cut, workspace
from tapewatch.sources import sinks
from tapewatch.sources import tables as t

SHOWN = ["return", "volume_ratio_20d", "volatility_20d", "rsi_14d", "macd"]


@query("worst_ticks", "M35 T-5 T-6 W1 F9 P4",
       f"""WITH {SCORED_TICKS}, m AS (SELECT *, volume / 100 * 0.5 + price / 1001 AS mp_score FROM scored),
       c AS (SELECT *, round(0.6::DOUBLE * if_score + 0.4::DOUBLE * mp_score, 4) AS score, {sql.evidence('if_score', 'mp_score')} AS signals FROM m),
       r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, event_id) AS rank FROM c)
       SELECT market, symbol, event_id, {sql.rounded(SHOWN)}, len(string_split(signals, ',')) AS n_signals, score,
        CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, rank
       FROM r WHERE rank <= 10""")
def worst_ticks(spark, d):
    x = scored_ticks(spark, d).withColumn("mp_score", F.col("volume") / 100 * 0.5 + F.col("price") / 1001)
    x = x.withColumns({"score": sc.combined_score("if_score", "mp_score"), "_e": sc.evidence("if_score", "mp_score"),
                       "_last": -F.col("event_id")})
    top = o.newest(x, ["market"], ["score", "_last"], 10, rank="rank")
    return top.select("market", "symbol", "event_id", *rounded(SHOWN), F.size("_e").alias("n_signals"), "score",
                      sc.severity("score").alias("severity"), "rank")


@query("prepared_market", "E1 S16 W27",
       f"""WITH {TICK_FEATURES} SELECT event_id, market, symbol, {sql.rounded(['return', 'volume_ratio_20d', 'volatility_20d'])} FROM feats
        WHERE "return" IS NOT NULL AND volume_ratio_20d IS NOT NULL AND volatility_20d IS NOT NULL""")
def prepared_market(spark, d):
    out = jobs.prepare_market_features(t.ticks(spark, d), order=["ts", "event_id"])
    return out.select("event_id", "market", "symbol", *rounded(["return", "volume_ratio_20d", "volatility_20d"]))


BATCH = f"""{TICK_FEATURES}, {BASELINES.format(feats='feats', complete=sql.COMPLETE)},
  z AS (SELECT f.*, ("return" - rm) / rs AS z_return, (volatility_20d - vm) / vs AS z_volatility, rs IS NOT NULL AS has_baseline, source = 'YFINANCE' AS low,
    pos >= 20 AND {sql.COMPLETE} AS ok FROM feats f LEFT JOIN (SELECT * FROM base WHERE CAST(substr(symbol, 2) AS BIGINT) % 10 <> 4) b ON b.symbol = f.symbol),
  {explained('z', "ok AND market = 'CRYPTO' AND has_baseline")}"""


def detected_batch(spark, d):
    """All ticks as stored bars, by a fixed forest, a fixed classifier and the baselines of nine symbols in ten."""
    x = t.ticks(spark, d)
    f = ft.complete(ft.engineered_features(x, order=["ts", "event_id"]))
    baselines = ft.trailing_baselines(f, order=["ts", "event_id"]).filter(F.substring("symbol", 2, 20).cast("bigint") % 10 != 4).dropna()
    models = [MarketModels("CRYPTO", forest=fixed_forest(), detector=fixed_classifier(), trained_at="fixed")]
    return jobs.detect_batch(x, models, cut(baselines, "baselines"), order=["ts", "event_id"], threshold=0.6)


@query("batch_detection", "M35 F16 J6 J8 P4 P5 P7 P10 P21 P22 F6",
       f"""WITH {BATCH} SELECT event_id, market, CASE WHEN ok THEN 'ok' ELSE 'insufficient_history' END AS status, round(if_score, 9) AS if_score, round(mp_score, 9) AS mp_score,
        score AS anomaly_score, coalesce(score >= 0.6, FALSE) AS is_anomaly, severity, CASE WHEN ok THEN signal END AS primary_signal,
        CASE WHEN NOT ok THEN NULL WHEN market <> 'CRYPTO' AND low THEN 'model_unavailable' WHEN market <> 'CRYPTO' THEN 'no_model_high_confidence'
         WHEN NOT has_baseline AND low THEN 'baseline_unavailable' WHEN NOT has_baseline THEN 'no_baseline_high_confidence' END AS coverage, {sql.rounded(['return'])} FROM s""")
def batch_detection(spark, d):
    out = detected_batch(spark, d)
    return out.select("event_id", "market", "status", F.round("if_score", 9).alias("if_score"), F.round("mp_score", 9).alias("mp_score"), "anomaly_score", "is_anomaly",
                      "severity", "primary_signal", "coverage", *rounded(["return"]))


BROKEN_TEXT = "event_id % 50 = 7"


@query("stored_explanations", "M36 F8 F9 F11 F12",
       f"""WITH {BATCH}, g AS (SELECT *, {BROKEN_TEXT} AS broken, if_score >= 0.6 AND mp_score >= 0.6 AS dual, list_sort([{', '.join(PATTERNS)}], 'DESC') AS v,
         CASE {' '.join(f"WHEN {p} = mp_score THEN '{p}'" for p in PATTERNS)} END AS best, {sql.evidence('if_score', 'mp_score')} AS names FROM s WHERE score IS NOT NULL),
       h AS (SELECT *, CAST(round(CAST(round(v[1] / (v[1] + v[2] + 1e-9), 4) AS DECIMAL(10, 4)) * CAST(CASE WHEN dual THEN 1.0 ELSE 0.5 END AS DECIMAL(2, 1)), 4) AS DOUBLE) AS sure,
         concat_ws(',', nullif(names, ''), CASE WHEN dual THEN 'dual_detector_agreement' END) AS said FROM g)
       SELECT event_id AS anomaly_id, CASE WHEN NOT broken THEN nullif(said, '') END AS evidence, CASE WHEN NOT broken THEN CASE WHEN dual THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS detector_agreement,
        CASE WHEN NOT broken THEN sure END AS weak_label_confidence, CASE WHEN NOT broken THEN best END AS label, CASE WHEN NOT broken THEN score END AS detector_score,
        CASE WHEN NOT broken THEN 'stored' END AS source FROM h""")
def stored_explanations(spark, d):
    """Stored anomalies explained when read; one row in fifty has broken text."""
    stored = jobs.stored_form(detected_batch(spark, d), "event_id")
    stored = stored.withColumn("features", F.when(F.col("anomaly_id") % 50 == 7, F.lit("{broken")).otherwise(F.col("features")))
    path = sinks.write_tables({"anomalies": stored}, workspace(spark))[0]
    out = desk.explain_stored(spark.read.schema(stored.schema).parquet(path))
    return out.select("anomaly_id", sc.evidence_names("evidence").alias("evidence"), "detector_agreement", "weak_label_confidence", "detection_result.label",
                      "detection_result.detector_score", "detection_result.source")


# Weights over raw features; the second classifier knows three patterns only.
TRUE_WEIGHTS = {"pump_and_dump": {"": -0.5, "return": 0.3, "volume_ratio_20d": 0.7}, "wash_trading": {"": 0.2, "volume_ratio_20d": -0.6, "rsi_14d": 0.01},
                "spoofing": {"": -1.0, "rsi_14d": 0.02, "volatility_20d": 0.002}, "layering": {"": 0.3, "return": -0.2, "rsi_14d": -0.015}}
WEAK_WEIGHTS = {p: {f: w * (1 if f != "rsi_14d" else -1) for f, w in TRUE_WEIGHTS[p].items()} for p in ("pump_and_dump", "wash_trading", "spoofing")}


def _raw_logistic(weights):
    return "1 / (1 + exp(-(" + " + ".join([f"{weights['']!r}::DOUBLE", *[f'{w!r}::DOUBLE * "{f}"' for f, w in weights.items() if f]]) + ")))"


@query("weak_label_report", "M13 A13 A14 A15 J14",
       f"""WITH {WEAK}, truth AS (SELECT *, {TRUE_PATTERN} AS true_pattern FROM weak), test AS (SELECT * FROM truth WHERE event_id % 3 = 0),
       long AS ({' UNION ALL '.join(f"SELECT '{p}|{k}' AS pattern, {_raw_logistic(w)} AS score, (true_pattern IS NOT DISTINCT FROM '{p}')::INT AS label FROM test"
                                    for k, all_ in (('true', TRUE_WEIGHTS), ('weak', WEAK_WEIGHTS)) for p, w in all_.items())}), {AUC_SQL},
       pair AS (SELECT p.pattern, t.auc AS auc_true, coalesce(w.auc, 0.5) AS auc_weak FROM (SELECT unnest({PATTERNS!r}) AS pattern) p
         JOIN auc t ON t.pattern = p.pattern || '|true' LEFT JOIN auc w ON w.pattern = p.pattern || '|weak')
       SELECT 'detector_recall' AS section, true_pattern AS pattern, NULL AS other, count(*) AS n, round(avg(if_flag), 9) AS value FROM truth WHERE true_pattern IS NOT NULL GROUP BY true_pattern
       UNION ALL SELECT 'attribution_accuracy', NULL, NULL, count(*), round(avg((true_pattern = pattern)::INT), 9) FROM truth WHERE f AND true_pattern IS NOT NULL
       UNION ALL SELECT 'attribution', true_pattern, pattern, count(*), NULL FROM truth WHERE f AND true_pattern IS NOT NULL GROUP BY true_pattern, pattern
       UNION ALL SELECT 'auc_true_labels', pattern, NULL, NULL, round(auc_true, 9) FROM pair UNION ALL SELECT 'auc_weak_labels', pattern, NULL, NULL, round(auc_weak, 9) FROM pair
       UNION ALL SELECT 'auc_lost', pattern, NULL, NULL, round(auc_true - auc_weak, 9) FROM pair""")
def weak_label_report(spark, d):
    w = cut(with_truth(weak_ticks(spark, d)), "weak")
    out = jobs.weak_label_quality(w, w.filter("event_id % 3 = 0"), Scorecard(FIXED_FEATURES, TRUE_WEIGHTS), Scorecard(FIXED_FEATURES, WEAK_WEIGHTS))
    return out.withColumn("value", F.round("value", 9))


@query("unsupervised_training", "E4 T-5 M3")
def unsupervised_training(spark, d):
    """A forest over all markets and its ten worst rows."""
    f = cut(ft.complete(ft.engineered_features(t.ticks(spark, d))), "features")
    _, worst = jobs.unsupervised(f, "event_id")
    return worst.select("event_id", "market", "symbol", "if_score", "if_flag")


def _trained(spark, d):
    f = cut(ft.complete(ft.engineered_features(t.ticks(spark, d))), "features")
    return jobs.train_markets(f, "event_id", ["ts", "event_id"])


@query("zscored_training", "E2 E5 A1 A2 M1 M3 M4 U5 S15")
def zscored_training(spark, d):
    _, scored = _trained(spark, d)
    paths = sinks.write_tables({"scored_days": scored}, workspace(spark))
    return jobs.fairness_slice(spark.read.parquet(paths[0]))


@query("weak_supervision", "E3 M11 M12 A23 S15")
def weak_supervision(spark, d):
    _, scored = _trained(spark, d)
    _, stats = jobs.supervise_markets(scored)
    return stats


@query("supervised_training", "E4 W25 M6 A16")
def supervised_training(spark, d):
    f = ft.complete(ft.engineered_features(t.ticks(spark, d)))
    f = f.withColumns({"is_pump_and_dump": (F.col("volume_ratio_20d") > 1.6).cast("int"),
                       "is_wash_trading": (F.col("return") > 2).cast("int"),
                       "is_spoofing": ((F.col("volatility_20d") > 200) & (F.abs("return") < 0.5)).cast("int"),
                       "is_layering": (F.col("volume_ratio_20d").between(1.2, 1.6) & (F.abs("return") < 0.5)).cast("int")})
    _, out = jobs.supervised(f, "event_id", ["ts", "event_id"])
    return out


@query("stored_models", "M37 A31 J8")
def stored_models(spark, d):
    f = cut(ft.complete(ft.engineered_features(t.ticks(spark, d))), "features")
    root = workspace(spark)
    loaded = []
    for market in ("CRYPTO", "US_EQUITY"):
        rows = f.filter(F.col("market") == market)
        forest = fo.fit_forest(rows, FEATURES, "event_id")
        registry.save(spark, MarketModels(market, forest=forest, baselines=ft.trailing_baselines(rows), trained_at="round"), root)
        loaded.append(registry.load(spark, market, root))
    counts = registry.all_baselines(loaded).groupBy("market").agg(F.count(F.lit(1)).alias("n_baselines"))
    return registry.coverage(spark, loaded).drop("patterns").join(counts, "market")


@query("scored_table_written", "S15",
       f"WITH {SCORED_TICKS} SELECT market, symbol, count(*) AS n, round(avg(if_score), 9) AS mean_score FROM scored GROUP BY ALL")
def scored_table_written(spark, d):
    rows = scored_ticks(spark, d).select("market", "symbol", "event_id", "if_score")
    path = sinks.write_tables({"scored": rows}, workspace(spark))[0]
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("market", "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("if_score"), 9).alias("mean_score"))
