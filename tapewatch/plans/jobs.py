"""End-to-end jobs: prepare, train, weak supervision, evaluate, detect, forecast, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import scoring as sc
from tapewatch.operators import desk, features as ft, forest as fo, lof, metrics, patterns
from tapewatch.operators import series as se
from tapewatch.plans.registry import MarketModels
from tapewatch.schemas import FEATURES, MARKETS, PATTERNS, ZSCORED
from tapewatch.session import cut
from tapewatch.sources.validate import require_columns


def prepare_market_features(series: DataFrame, order: Sequence[str] = ("ts",), **kw) -> DataFrame:
    """Features of every symbol of every market in one pass, warm-up rows dropped."""
    return ft.complete(ft.engineered_features(series, order=order, **kw), ["return", "volume_ratio_20d", "volatility_20d"])


def causal(df: DataFrame, order: Sequence[str] = ("ts",), **kw) -> DataFrame:
    """Replaces return and volatility by their causal z-scores; rows without a baseline are dropped."""
    z = ft.rolling_zscores(df, order=order, **kw)
    for c in ZSCORED:
        z = z.withColumn(f"raw_{c}", F.col(c)).withColumn(c, F.col(f"{c}_z")).drop(f"{c}_z")
    return z.dropna(subset=list(FEATURES))


def train_market(df: DataFrame, market: str, key: str, order: Sequence[str] = ("ts",), contamination: float = 0.05,
                 trees: int = 100, lof_vector: Sequence[str] = tuple(FEATURES), with_lof: bool = True,
                 trained_at: str = "unknown", **kw) -> tuple[MarketModels, DataFrame]:
    """Baselines, causal z-scores, forest, outlier factors, strict agreement: (models, scored rows)."""
    require_columns(df, [*FEATURES, "symbol"])
    rows = df.filter(F.col("market") == market).dropna(subset=list(FEATURES))
    baselines = ft.trailing_baselines(rows, order=order)
    z = cut(causal(rows, order, **kw), "zscored")
    scored, forest = fo.fit_score_flag(z, FEATURES, key, contamination, trees)
    scored = scored.withColumnRenamed("threshold", "if_threshold")
    if with_lof:
        x = z.withColumn("_x", F.array(*[F.col(f).cast("double") for f in lof_vector]))
        flags = lof.fit_flag(x, key, "_x", 20, contamination).drop("threshold", "lof")
        scored = scored.join(flags, key).withColumn("detector_agreement", sc.agreement_strict("if_flag", "lof_flag"))
    return MarketModels(market, forest=forest, baselines=cut(baselines, "baselines"), trained_at=trained_at), cut(scored, "scored")


def train_markets(df: DataFrame, key: str, order: Sequence[str] = ("ts",), markets: Sequence[str] = tuple(MARKETS),
                  **kw) -> tuple[list[MarketModels], DataFrame]:
    """Every market by its own models: (models, scored rows of all markets)."""
    trained = [train_market(df, market, key, order, **kw) for market in markets]
    scored = trained[0][1]
    for _, rows in trained[1:]:
        scored = scored.unionByName(rows)
    return [models for models, _ in trained], scored


def weak_supervision(scored: DataFrame, patterns_: Sequence[str] = tuple(PATTERNS), trees: int = 200,
                     cutoff: float = patterns.CONFIDENCE_CUTOFF) -> tuple[patterns.PatternDetector, DataFrame, DataFrame]:
    """(detector, labelled rows, label statistics) from scored rows with both detectors' flags."""
    drop = [c for c in ("detector_agreement",) if c in scored.columns]
    labelled = cut(patterns.weak_labels(scored.drop(*drop)), "weak")
    detector, marked = patterns.fit_on_weak_labels(labelled, patterns=patterns_, cutoff=cutoff, estimator=patterns.default_estimator(trees))
    return detector, marked, patterns.label_statistics(labelled, cutoff)


def supervise_markets(scored: DataFrame, markets: Sequence[str] = tuple(MARKETS), **kw) -> tuple[dict[str, patterns.PatternDetector], DataFrame]:
    """(detectors, label statistics) per market. A market without a confident label has statistics but no detector."""
    detectors, out = {}, None
    for market in markets:
        rows = scored.filter(F.col("market") == market)
        stats = cut(patterns.label_statistics(patterns.weak_labels(rows.drop("detector_agreement"))), "label_statistics")
        if stats.first().n_kept:
            detectors[market], _, stats = weak_supervision(rows, **kw)
        stats = stats.select(F.lit(market).alias("market"), "*")
        out = stats if out is None else out.unionByName(stats)
    return detectors, out


FEW_POSITIVES = 10


def supervised(df: DataFrame, key: str, order: Sequence[str] = ("ts",), by: Sequence[str] = ("market", "symbol"),
               patterns_: Sequence[str] = tuple(PATTERNS), trees: int = 200, test_size: float = 0.2) -> tuple[patterns.PatternDetector, DataFrame]:
    """Chronological split, one classifier per pattern, evaluation with a warning for few positives."""
    split = cut(se.chronological_split(df.dropna(subset=list(FEATURES)), test_size, by, order), "split")
    detector = patterns.fit_patterns(split.filter("part = 'train'"), patterns=patterns_, estimator=patterns.default_estimator(trees))
    test = cut(detector.predict_proba(split.filter("part = 'test'")), "proba")
    out = metrics.evaluate(patterns.detector_rows(test, patterns_))
    return detector, out.withColumn("few_positives", F.col("n_positive") < FEW_POSITIVES)


def unsupervised(df: DataFrame, key: str, contamination: float = 0.05, trees: int = 100, worst: int = 10) -> tuple[fo.Forest, DataFrame]:
    scored, forest = fo.fit_score_flag(df, FEATURES, key, contamination, trees)
    return forest, scored.orderBy(F.col("if_score").desc(), F.col(key)).limit(worst)


def fairness_slice(scored: DataFrame, flag: str = "if_flag", score: str = "if_score") -> DataFrame:
    """Flag rate per symbol and whether it deviates from its market."""
    per = desk.flag_rate(scored, flag=flag, score=score)
    odd = desk.deviating(scored, flag=flag, score=score).select("market", "symbol", F.lit(True).alias("deviates"))
    return per.join(odd, ["market", "symbol"], "left").withColumn("deviates", F.coalesce("deviates", F.lit(False))).orderBy(F.col("flag_rate").desc())


def with_baseline(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """Joins the stored baselines; Spark broadcasts them where their size in bytes allows it."""
    return df.join(baselines, ["market", "symbol"], "left")


def normalised(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """``z_return`` and ``z_volatility_20d`` from stored baselines, and whether they are valid."""
    j = with_baseline(df, baselines)
    ok = F.lit(True)
    for c in ZSCORED:
        ok = ok & sc.baseline_valid(f"{c}_mean", f"{c}_std")
    out = j.withColumns({f"z_{c}": sc.against_baseline(c, f"{c}_mean", f"{c}_std") for c in ZSCORED}).withColumn("has_baseline", ok)
    return out.drop(*[f"{c}_{s}" for c in ZSCORED for s in ("mean", "std")])


def score_rows(df: DataFrame, models: list[MarketModels], baselines: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """Scores rows with raw features by their market's models; raw features are kept.

    Rows are z-scored with the stored baselines, routed by market, scored by forest and classifiers,
    and combined. Rows that cannot be scored carry a coverage code and a null score.
    """
    if baselines is not None:
        rows = normalised(df, baselines)
    else:
        rows = df.withColumns({f"z_{c}": F.col(c) for c in ZSCORED}).withColumn("has_baseline", F.lit(True))
    low = sc.low_confidence("source") if "source" in df.columns else F.lit(False)
    rows = rows.withColumn("low_confidence", low)
    empty_scores = F.lit(None).cast("map<string,double>")
    parts = []
    for m in models:
        part = rows.filter(F.col("market") == m.market)
        inputs = {c: f"z_{c}" for c in ZSCORED}
        if m.forest is not None:
            part = fo.score(part, m.forest, inputs=inputs)
        else:
            part = part.withColumn("if_score", F.lit(None).cast("double"))
        if m.detector is not None:
            zed = part.withColumns({f"_raw_{c}": F.col(c) for c in ZSCORED}).withColumns({c: F.col(f"z_{c}") for c in ZSCORED})
            known = zed.filter("has_baseline").dropna(subset=m.detector.features)
            scored = m.detector.predict_proba(known).withColumn("pattern_scores", m.detector.pattern_scores())
            rest = zed.filter(~F.col("has_baseline") | ~sum((F.col(f).isNotNull().cast("int") for f in m.detector.features), F.lit(0)).eqNullSafe(len(m.detector.features)))
            both = scored.drop(*[f"proba_{p}" for p in m.detector.models]).unionByName(rest.withColumn("pattern_scores", empty_scores))
            part = both.withColumns({c: F.col(f"_raw_{c}") for c in ZSCORED}).drop(*[f"_raw_{c}" for c in ZSCORED])
        else:
            part = part.withColumn("pattern_scores", empty_scores)
        parts.append(part.withColumns({"has_model": F.lit(m.loaded), "model_version": F.lit(m.trained_at)}))
    markets = [m.market for m in models]
    parts.append(rows.filter(~F.col("market").isin(*markets)).withColumns({
        "if_score": F.lit(None).cast("double"), "pattern_scores": empty_scores, "has_model": F.lit(False), "model_version": F.lit("unknown")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = F.col("has_model") & F.col("has_baseline")
    out = out.withColumns({"if_score": F.when(known, F.col("if_score")), "pattern_scores": F.when(known, F.col("pattern_scores"))})
    out = out.withColumn("mp_score", F.array_max(F.map_values("pattern_scores")))
    out = out.withColumns({"anomaly_score": sc.combined_score("if_score", "mp_score"),
                           "coverage": sc.coverage_code("has_model", "has_baseline", "low_confidence"),
                           "detector_agreement": sc.agreement_live("if_score", "mp_score")})
    return out.withColumns({
        "is_anomaly": F.coalesce(sc.is_anomaly("anomaly_score", threshold), F.lit(False)),
        "severity": F.when(F.col("anomaly_score").isNotNull(), sc.severity("anomaly_score")),
        "primary_signal": sc.primary_signal("pattern_scores", "anomaly_score"),
        "label_confidence": sc.label_confidence("pattern_scores", "detector_agreement"),
        "evidence": sc.evidence("if_score", "mp_score", dual=F.col("detector_agreement")),
    }).drop(*[f"z_{c}" for c in ZSCORED])


def detect_batch(bars: DataFrame, models: list[MarketModels], baselines: DataFrame | None, *, order: Sequence[str] = ("ts",),
                 by: Sequence[str] = ("user_id", "market", "symbol"), lookback: int = 30, threshold: float = 0.7, **kw) -> DataFrame:
    """One plan over all stored bars: trailing features, status, scores. Bars without the history for their features keep
    their status and have no score."""
    f = ft.engineered_features(bars, by=by, order=order, lookback=lookback, keep_position=True, **kw)
    f = f.withColumn("status", ft.feature_status(f)).drop("_pos")
    ready = score_rows(f.filter("status = 'ok'"), models, baselines, threshold)
    short = f.filter("status <> 'ok'").withColumns({"is_anomaly": F.lit(False), "has_baseline": F.lit(None).cast("boolean")})
    return ready.unionByName(short, allowMissingColumns=True)


def stored_form(scored: DataFrame, key: str) -> DataFrame:
    """Scored rows as they are stored: raw features and pattern scores as JSON text. Rows without a score are not stored."""
    return scored.filter("anomaly_score IS NOT NULL").select(
        F.col(key).alias("anomaly_id"), "market", "symbol", "anomaly_score", "is_anomaly", "if_score", "mp_score", "model_version",
        F.to_json("pattern_scores").alias("pattern_scores"), F.to_json(F.struct(*FEATURES)).alias("features"))


def weak_label_quality(weak: DataFrame, test: DataFrame, true_detector, weak_detector, true: str = "true_pattern", flag: str = "if_flag",
                       patterns_: Sequence[str] = tuple(PATTERNS)) -> DataFrame:
    """What weak labels cost, as one report (section, pattern, other, n, value).

    ``detector_recall``: share of the true rows of a pattern that were flagged at all; ``attribution_accuracy`` and
    ``attribution``: of flagged true rows, the share with the right pattern, and counts by true and attributed pattern;
    ``auc_true_labels``, ``auc_weak_labels``, ``auc_lost``: both detectors on the true labels of ``test``, .5 where the weak
    labels trained none. ``weak`` has the columns of ``patterns.weak_labels``, both tables the true pattern (null: none).
    """
    nothing = F.lit(None).cast("string")
    marks = {f"is_{p}": F.coalesce(F.col(true) == p, F.lit(False)).cast("int") for p in patterns_}
    recall = metrics.recall_by_pattern(weak.drop(*marks).withColumns(marks), {p: f"is_{p}" for p in patterns_}, flag)
    hit = weak.filter(F.col(true).isNotNull() & (F.col("is_manipulation") == 1))
    counts = hit.groupBy(F.col(true).alias("pattern"), F.col("attributed_pattern").alias("other")).agg(F.count("*").alias("n"))
    right = metrics.attribution_accuracy(weak, true, "attributed_pattern", "is_manipulation")

    def aucs(detector) -> DataFrame:
        known = [p for p in patterns_ if p in detector.models]
        scored = detector.predict_proba(test.drop(*marks).withColumns(marks))
        return metrics.auc(patterns.detector_rows(scored, known), ["pattern"])

    lost = cut(metrics.auc_lost(aucs(true_detector), aucs(weak_detector)), "auc_lost")
    sections = {"auc_true_labels": "auc_true", "auc_weak_labels": "auc_weak", "auc_lost": "auc_lost"}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.col(c).alias("value")) for k, c in sections.items()])).alias("c")
    return (recall.select(F.lit("detector_recall").alias("section"), "pattern", nothing.alias("other"), F.col("n_total").alias("n"), F.col("detection_rate").alias("value"))
            .unionAll(right.select(F.lit("attribution_accuracy"), nothing, nothing, "n", "accuracy"))
            .unionAll(counts.select(F.lit("attribution"), "pattern", "other", "n", F.lit(None).cast("double")))
            .unionAll(lost.select("pattern", cells).select("c.section", "pattern", nothing, F.lit(None).cast("long"), "c.value")))


def case_report(cases: DataFrame, links: DataFrame, anomalies: DataFrame, bars: DataFrame) -> DataFrame:
    return desk.evidence_text(desk.case_evidence(cases, links, anomalies, bars))
