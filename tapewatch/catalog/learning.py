"""Fitted models on features and document labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.scoring import AUC_SQL, flagged_ticks, scored_ticks, weak_ticks, with_truth
from tapewatch.catalog.series_windows import bar_features, rounded
from tapewatch.operators import features as ft
from tapewatch.operators import forest as fo
from tapewatch.operators import ensembles, metrics, models, patterns
from tapewatch.operators import ordered as o
from tapewatch.schemas import FEATURES, PATTERNS
from tapewatch.session import cut, workspace
from tapewatch.sources import tables as t

SMALL = ["return", "volume_ratio_20d", "volatility_20d", "rsi_14d", "macd", "true_range"]


def labelled_bars(spark, d):
    """Bars with a label per pattern: large volume ratios of rising and of other days, and quiet days of high volatility
    or of raised volume."""
    f = ft.complete(bar_features(spark, d))
    y = (F.col("volume_ratio_20d") > 2.0).cast("int") * (F.col("return") > 0).cast("int")
    return f.withColumns({"is_pump_and_dump": y, "is_wash_trading": ((F.col("volume_ratio_20d") > 2.2) & (F.col("return") <= 0)).cast("int"),
                          "is_spoofing": ((F.col("volatility_20d") > 200) & (F.abs("return") < 0.5)).cast("int"),
                          "is_layering": (F.col("volume_ratio_20d").between(1.3, 1.8) & (F.abs("return") < 0.5)).cast("int"),
                          "row_id": F.concat_ws("-", "symbol", "day_no")})


def ml_rows(spark, d, features=SMALL):
    x = labelled_bars(spark, d)
    return cut(models.prepared(x, features, "is_pump_and_dump", keep=["row_id", "symbol", "ts"]), "ml")


def _share(train):
    return F.pmod(F.xxhash64(F.lit(3), "row_id"), F.lit(10)) < 7 if train else F.pmod(F.xxhash64(F.lit(3), "row_id"), F.lit(10)) >= 7


def _auc(model, df):
    return metrics.auc(models.probability(model, df))


@query("forest_fit", "M1 M2 M3 P17 T-5 E4")
def forest_fit(spark, d):
    f = ft.complete(ft.engineered_features(t.ticks(spark, d)))
    scored, _ = fo.fit_score_flag(f, FEATURES, "event_id", 0.05)
    return scored.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg("if_score").alias("mean_score"), F.min("if_score").alias("min_score"),
                                        F.max("if_score").alias("max_score"), F.avg("if_flag").alias("flag_rate"))


@query("pattern_detector", "M6 M7 M8 M9 A16 E4")
def pattern_detector(spark, d):
    x = cut(labelled_bars(spark, d).select(*FEATURES, "row_id", *[f"is_{p}" for p in PATTERNS]), "labelled")
    det = patterns.fit_patterns(x.filter(_share(True)), estimator=patterns.default_estimator())
    scored = cut(det.predict(x.filter(_share(False))), "proba")
    return metrics.evaluate(patterns.detector_rows(scored, PATTERNS))


@query("pattern_flags", "M8",
       """WITH p AS (SELECT doc_id, least(1, (n_chars % 97) / 96.0::DOUBLE) AS a, (n_chars % 31) / 30.0::DOUBLE AS b FROM documents)
       SELECT doc_id, CAST(a >= 0.7 AS INT) AS flag_spoofing, CAST(b >= 0.5 AS INT) AS flag_layering FROM p""")
def pattern_flags(spark, d):
    x = t.read(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") % 97 / 96.0).alias("proba_spoofing"),
                                             (F.col("n_chars") % 31 / 30.0).alias("proba_layering"))
    return patterns.flag_patterns(x, ["spoofing", "layering"], {"spoofing": 0.7}).select("doc_id", "flag_spoofing", "flag_layering")


@query("weak_label_training", "M12 M13 E3")
def weak_label_training(spark, d):
    w = cut(weak_ticks(spark, d), "weak")
    if not patterns.label_statistics(w).first().n_kept:  # no confident label, so no pattern to train
        none = w.limit(0).withColumns({f"proba_{p}": F.lit(0.0) for p in PATTERNS})
        return metrics.auc(patterns.detector_rows(none, PATTERNS), ["pattern"])
    det, marked = patterns.fit_on_weak_labels(w, estimator=patterns.default_estimator())
    scored = cut(with_truth(det.predict_proba(marked)), "proba")
    ps = list(det.models)
    return metrics.auc(patterns.detector_rows(scored, ps), ["pattern"])


@query("example_prototypes", "A37",
       f"""WITH {sql.BARS}, {sql.features('bars', 'ts')}, k AS (SELECT *, volume_ratio_20d > 2 AND "return" > 0 AS y FROM feats WHERE {sql.COMPLETE}),
       s AS (SELECT {', '.join(f'avg("{f}") AS m_{f}, stddev_samp("{f}") AS d_{f}' for f in FEATURES)} FROM k)
       SELECT 'pump_and_dump' AS pattern, {', '.join(f'round(avg(("{f}" - m_{f}) / d_{f}), 7) AS "{f}"' for f in FEATURES)} FROM k, s WHERE y""")
def example_prototypes(spark, d):
    p = patterns.prototypes_from_examples(cut(labelled_bars(spark, d), "labelled"), patterns=["pump_and_dump"])
    rows = [(name, *[float(c[f]) for f in FEATURES]) for name, c in p.items()]
    out = spark.createDataFrame(rows, "pattern STRING, " + ", ".join(f"`{f}` DOUBLE" for f in FEATURES))
    return out.select("pattern", *[F.round(f, 7).alias(f) for f in FEATURES])


@query("logistic_coefficients", "M14 M15 T-7")
def logistic_coefficients(spark, d):
    x = ml_rows(spark, d)
    return models.coefficient_ranking(models.logistic(50).fit(x), SMALL, spark)


@query("tree_models", "M16 M17 M18")
def tree_models(spark, d):
    x = ml_rows(spark, d)
    train, test = x.filter(_share(True)), x.filter(_share(False))
    models.base_rate_log_odds(train)
    rows = []
    for name, e in {"decision_tree": models.decision_tree(), "random_forest": models.random_forest(), "boosting": models.boosting(50)}.items():
        rows.append((name, float(_auc(e.fit(train), test).first().auc)))
    return metrics.ranked(spark.createDataFrame(rows, "model STRING, auc DOUBLE"), "auc")


@query("boosting_stages", "M18 M19 T-7")
def boosting_stages(spark, d):
    x = ml_rows(spark, d)
    m = models.early_stopping_boost(x)
    gain = models.importance_rows(spark, SMALL, m.featureImportances.toArray(), column="gain")
    return gain.join(models.split_counts(m, SMALL, spark), "feature")


@query("kmeans_selection", "M20 M21 T-8")
def kmeans_selection(spark, d):
    x = cut(models.vectors(t.read(spark, d, "embeddings"), "embedding"), "vectors")
    return models.choose_k(x)


@query("feature_elimination", "M22 M23")
def feature_elimination(spark, d):
    x = cut(labelled_bars(spark, d).select(*SMALL, "is_pump_and_dump"), "labelled")
    out = models.recursive_elimination(x, SMALL, "is_pump_and_dump", keep=4)
    return out.join(models.embedded_selection(x, SMALL, "is_pump_and_dump", trees=100), "feature", "left")


@query("model_comparison", "M24 T-8 W26")
def model_comparison(spark, d):
    x = ml_rows(spark, d)
    return models.compare_models(x, {"logistic": lambda: models.logistic(20), "tree": models.decision_tree}, splits=5,
                                 scale_for=["logistic"], by=["symbol"])


@query("isotonic_calibration", "M25 A20")
def isotonic_calibration(spark, d):
    x = ml_rows(spark, d)
    scored = models.probability(models.decision_tree().fit(x.filter(_share(True))), x.filter(_share(False)))
    return models.isotonic_calibration(scored, "row_id")


@query("learning_curve", "W32")
def learning_curve(spark, d):
    x = ml_rows(spark, d)
    return models.learning_curve(x, models.decision_tree, by=["symbol"])


@query("combined_vs_per_pattern", "A40")
def combined_vs_per_pattern(spark, d):
    x = labelled_bars(spark, d).withColumn("any", F.greatest("is_pump_and_dump", "is_wash_trading"))
    rows = models.VectorAssembler(inputCols=SMALL, outputCol="features").transform(x).select(
        "row_id", "features", "any", "is_pump_and_dump", "is_wash_trading")
    return models.combined_vs_per_pattern(rows, {"combined (blended)": "any", "pump_and_dump (per-pattern)": "is_pump_and_dump",
                                                 "wash_trading (per-pattern)": "is_wash_trading"}, "row_id")


@query("sequence_forecast", "M34 F15 W23 E6")
def sequence_forecast(spark, d):
    return models.sequence_forecast(t.bars(spark, d).select("symbol", "ts", "close"))


# Three small trees over the length of a labelled document, for an exact check.
STAGE_TREES = [[("n_chars", 900, 0.8, -0.6)], [("rest", 40, 0.3, -0.2)], [("rest", 70, -0.4, 0.5)]]
STAGE_WEIGHTS, STAGE_START = [1.0, 0.5, 0.25], 0.2


def fixed_stages() -> ensembles.Ensemble:
    names, rows = ["n_chars", "rest"], []
    for tree, [(feature, split, low, high)] in enumerate(STAGE_TREES):
        rows += [(tree, 0, names.index(feature), float(split), 1, 2, 0.0), (tree, 1, -1, 0.0, -1, -1, low), (tree, 2, -1, 0.0, -1, -1, high)]
    nodes = ensembles.pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "value"])
    return ensembles.Ensemble(names, nodes, STAGE_WEIGHTS, start=STAGE_START)


def _stage_sql(k: int) -> str:
    return " + ".join([f"{STAGE_START}::DOUBLE", *[f"{w}::DOUBLE * CASE WHEN {f} <= {s} THEN {a} ELSE {b} END" for w, [(f, s, a, b)] in zip(STAGE_WEIGHTS[:k], STAGE_TREES)]])


@query("staged_probabilities", "M18",
       f"""WITH doc AS (SELECT quality, n_chars, n_chars % 97 AS rest FROM labels JOIN documents USING (doc_id)),
       long AS ({' UNION ALL '.join(f"SELECT {k} AS pattern, round(1 / (1 + exp(-({_stage_sql(k)}))), 12) AS score, quality AS label FROM doc" for k in (1, 2, 3))}), {AUC_SQL}
       SELECT pattern AS stage, n_positive, round(auc, 9) AS auc, round(mean_probability, 9) AS mean_probability FROM auc
       JOIN (SELECT pattern, avg(score) AS mean_probability FROM long GROUP BY pattern) USING (pattern)""")
def staged_probabilities(spark, d):
    x = t.read(spark, d, "labels").join(t.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("rest", F.col("n_chars") % 97)
    scores = ensembles.staged_scores(x, fixed_stages(), "quality").withColumn("score", F.round("score", 12))
    out = ensembles.stage_report(scores)
    return out.select("stage", "n_positive", F.round("auc", 9).alias("auc"), F.round("mean_probability", 9).alias("mean_probability"))


@query("boosting_patience", "M19")
def boosting_patience(spark, d):
    """Boosting on document labels, cut at the best held-out AUC with 50 rounds of patience."""
    text = F.col("text")
    words = F.size(F.split(F.trim(text), r"\s+"))
    marks, capitals = (F.length(F.regexp_replace(text, pattern, "")) / (F.length(text) + 1) for pattern in (r"[\p{L}\p{N}\s]", r"[^\p{Lu}]"))
    names = ["n_chars", "marks", "capitals", "word_length"]
    x = t.read(spark, d, "documents").join(t.read(spark, d, "labels").filter("quality is not null"), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), marks.alias("marks"), capitals.alias("capitals"),
        (F.length(text) / words).alias("word_length"))
    x = cut(models.VectorAssembler(inputCols=names, outputCol="features").transform(x.dropna()).select("doc_id", "features", "label"), "rows")
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(10)) < 3
    _, _, stop = ensembles.boost_with_patience(x.filter(~held), x.filter(held), names, rounds=80, patience=50)
    return stop
