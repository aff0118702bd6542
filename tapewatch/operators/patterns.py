"""Prototype attribution, weak labels and per-pattern classifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import scoring as sc
from tapewatch.operators import bagging, metrics
from tapewatch.schemas import FEATURES, PATTERNS
from tapewatch.sources.validate import refuse_identity

# Domain prototypes in z units, by feature; features not named are 0.
DOMAIN_PROTOTYPES = {
    "pump_and_dump": {"return": 2.5, "volume_ratio_20d": 2.5, "volatility_20d": 1.0},
    "wash_trading": {"return": 0.0, "volume_ratio_20d": 2.5, "volatility_20d": 0.5},
    "spoofing": {"return": 0.0, "volume_ratio_20d": 0.8, "volatility_20d": 1.8},
    "layering": {"return": 0.0, "volume_ratio_20d": 1.3, "volatility_20d": 1.5},
}
CONFIDENCE_CUTOFF = 0.40

Prototypes = dict[str, dict[str, float]]


def standardised(df: DataFrame, features: Sequence[str] = tuple(FEATURES), suffix: str = "_s") -> DataFrame:
    """Sample-std z-scores over all rows; one broadcast row of statistics."""
    stats = df.agg(*[e for f in features for e in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_d_{f}"))])
    joined = df.crossJoin(F.broadcast(stats))
    return joined.select(*df.columns, *[
        F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.nullif(f"_d_{f}", F.lit(0.0))).alias(f + suffix) for f in features])


def prototypes_from_examples(df: DataFrame, features: Sequence[str] = tuple(FEATURES),
                             patterns: Sequence[str] = tuple(PATTERNS)) -> Prototypes:
    """Mean z-vector of the labelled rows of each pattern; a pattern without rows is an error."""
    missing = [p for p in patterns if f"is_{p}" not in df.columns]
    if missing:
        raise ValueError(f"no label column for {missing}")
    z = standardised(df, features)
    wide = z.agg(*[e for p in patterns for e in (
        F.count_if(F.col(f"is_{p}") == 1).alias(f"n|{p}"),
        *[F.avg(F.when(F.col(f"is_{p}") == 1, F.col(f"{f}_s"))).alias(f"{p}|{f}") for f in features])]).first()
    empty = [p for p in patterns if wide[f"n|{p}"] == 0]
    if empty:
        raise ValueError(f"no confirmed examples of {empty}; use the domain prototypes for these")
    return {p: {f: wide[f"{p}|{f}"] for f in features} for p in patterns}


def attribute(df: DataFrame, flag: str, prototypes: Prototypes = DOMAIN_PROTOTYPES,
              features: Sequence[str] = tuple(FEATURES), suffix: str = "_s") -> DataFrame:
    """Nearest prototype, its softmax share over negative distances, and the distance, for flagged rows."""
    if not prototypes:
        raise ValueError("no prototypes")
    point = F.array(*[F.col(f + suffix) for f in features])
    for p, centre in prototypes.items():
        fixed = F.array(*[F.lit(float(centre.get(f, 0.0))) for f in features])
        df = df.withColumn(f"_d_{p}", sc.euclidean(point, fixed))
    ds = [F.col(f"_d_{p}") for p in prototypes]
    least = F.least(*ds) if len(ds) > 1 else ds[0]
    share = 1 / sum((F.exp(least - d) for d in ds), F.lit(0.0))
    best: Column = F.lit(None).cast("string")
    for p in reversed(list(prototypes)):
        best = F.when(F.col(f"_d_{p}") == least, F.lit(p)).otherwise(best)
    on = F.col(flag).cast("int") == 1
    return df.withColumns({"attributed_pattern": F.when(on, best), "confidence": F.when(on, share),
                           "centroid_distance": F.when(on, least)}).drop(*[f"_d_{p}" for p in prototypes])


def weak_labels(df: DataFrame, if_flag: str = "if_flag", lof_flag: str = "lof_flag",
                prototypes: Prototypes = DOMAIN_PROTOTYPES, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Label columns from two detectors' flags: is_<pattern>, agreement, confidence and evidence."""
    flagged = (F.col(if_flag).cast("int") + F.col(lof_flag).cast("int")) > 0
    z = standardised(df.withColumn("is_manipulation", flagged.cast("int")), features)
    out = attribute(z, "is_manipulation", prototypes, features).drop(*[f"{f}_s" for f in features])
    out = out.withColumns({"detector_agreement": sc.agreement_detectors(if_flag, lof_flag),
                           "attribution_confidence": F.coalesce("confidence", F.lit(0.0)),
                           "centroid_distance": F.coalesce("centroid_distance", F.lit(0.0))})
    labels = {f"is_{p}": F.coalesce((F.col("attributed_pattern") == p).cast("int"), F.lit(0)) for p in prototypes}
    return out.withColumns({
        **labels, "label_confidence": F.col("attribution_confidence") * F.col("detector_agreement"),
        "evidence": F.when(F.col("is_manipulation") == 1, sc.training_evidence()).otherwise(F.array()),
    }).drop("confidence")


def mark_training(df: DataFrame, cutoff: float = CONFIDENCE_CUTOFF) -> DataFrame:
    """Unflagged rows and confident labels are used for training."""
    keep = (F.col("is_manipulation") == 0) | (F.col("label_confidence") >= cutoff)
    return df.withColumn("used_in_training", keep)


def label_statistics(df: DataFrame, cutoff: float = CONFIDENCE_CUTOFF, patterns: Sequence[str] = tuple(PATTERNS)) -> DataFrame:
    flagged = F.col("is_manipulation") == 1
    kept = flagged & (F.col("label_confidence") >= cutoff)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(flagged).alias("n_flagged"), F.count_if(kept).alias("n_kept"),
        F.count_if(flagged & (F.col("label_confidence") < cutoff)).alias("n_discarded"),
        F.count_if(F.col("detector_agreement") == 1.0).alias("n_both"), F.count_if(F.col("detector_agreement") == 0.5).alias("n_single"),
        *[F.count_if(kept & (F.col(f"is_{p}") == 1)).alias(f"n_{p}") for p in patterns])


Estimator = Callable[..., bagging.Forest]


def default_estimator(trees: int = 200, depth: int = 6, seed: int = 42) -> Estimator:
    return lambda **columns: bagging.Forest(trees, depth, seed, **columns)


@dataclass
class PatternDetector:
    """One classifier per pattern over the same feature columns."""

    features: list[str]
    models: dict[str, bagging.ForestModel]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds a probability per pattern; null where a feature is null."""
        out = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)
        known = F.lit(True)
        for f in self.features:
            known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
        return out.withColumns({f"proba_{p}": F.when(known, m.score("_x")) for p, m in self.models.items()}).drop("_x")

    def predict(self, df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
        return flag_patterns(self.predict_proba(df), list(self.models), thresholds)

    def pattern_scores(self) -> Column:
        return F.create_map(*[e for p in self.models for e in (F.lit(p), F.col(f"proba_{p}"))])

    def save(self, path: str) -> None:
        for p, m in self.models.items():
            m.save(f"{path}/{p}")

    @staticmethod
    def load(path: str, patterns: Sequence[str], features: Sequence[str]) -> PatternDetector:
        return PatternDetector(list(features), {p: bagging.ForestModel.load(f"{path}/{p}") for p in patterns})


@dataclass
class Scorecard:
    """Logistic weights per pattern, scored as plain columns; it stands wherever a detector does.

    ``models`` has an intercept (under the empty name) and weights by feature name for each pattern.
    """

    features: list[str]
    models: dict[str, dict[str, float]]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds a probability per pattern; null where a feature is null."""
        out = {}
        for p, weights in self.models.items():
            total = F.lit(float(weights.get("", 0.0)))
            for f in self.features:
                if f in weights:
                    total = total + F.lit(float(weights[f])) * F.col(f)
            out[f"proba_{p}"] = 1 / (1 + F.exp(-total))
        return df.withColumns(out)

    def pattern_scores(self) -> Column:
        return F.create_map(*[e for p in self.models for e in (F.lit(p), F.col(f"proba_{p}"))])

    def save(self, path: str) -> None:
        rows = [(p, f, float(w)) for p, weights in self.models.items() for f, w in weights.items()]
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "pattern STRING, feature STRING, weight DOUBLE").coalesce(1).write.parquet(f"{path}/scorecard")

    @staticmethod
    def load(path: str, patterns: Sequence[str], features: Sequence[str]) -> Scorecard:
        from pyspark.sql import SparkSession

        models: dict[str, dict[str, float]] = {p: {} for p in patterns}
        for r in SparkSession.getActiveSession().read.parquet(f"{path}/scorecard").collect():  # a row for each weight
            models[r.pattern][r.feature] = r.weight
        return Scorecard(list(features), models)


def flag_patterns(df: DataFrame, patterns: Sequence[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    limits = thresholds or {}
    return df.withColumns({f"flag_{p}": (F.col(f"proba_{p}") >= limits.get(p, 0.5)).cast("int") for p in patterns})


def fit_patterns(df: DataFrame, features: Sequence[str] = tuple(FEATURES), patterns: Sequence[str] = tuple(PATTERNS),
                 estimator: Estimator | None = None, drop_empty: bool = False) -> PatternDetector:
    """Fits one class-balanced classifier per pattern. A missing label column or a pattern without
    positives is an error, unless ``drop_empty`` leaves such patterns out."""
    refuse_identity(list(features))
    missing = [p for p in patterns if f"is_{p}" not in df.columns]
    if missing:
        raise ValueError(f"no label column for {missing}")
    df = df.dropna(subset=list(features))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"is_{p}").cast("bigint")).alias(p) for p in patterns]).first()
    empty = [p for p in patterns if not counts[p]]
    if empty and not drop_empty:
        raise ValueError(f"no positive rows for {empty}")
    wanted = [p for p in patterns if p not in empty]
    if not wanted:
        raise ValueError("no pattern has a positive row")
    estimator = estimator or default_estimator()
    x = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)
    models = {}
    for p in wanted:
        pos, neg = counts[p], counts["n"] - counts[p]
        weight = F.when(F.col(f"is_{p}") == 1, counts["n"] / (2 * pos)).otherwise(counts["n"] / (2 * max(neg, 1)))
        rows = x.select("_x", F.col(f"is_{p}").cast("double").alias("_y"), weight.alias("_w"))
        models[p] = estimator(features="_x", label="_y", weight="_w").fit(rows)
    return PatternDetector(list(features), models)


def fit_on_weak_labels(df: DataFrame, features: Sequence[str] = tuple(FEATURES), patterns: Sequence[str] = tuple(PATTERNS),
                       cutoff: float = CONFIDENCE_CUTOFF, estimator: Estimator | None = None) -> tuple[PatternDetector, DataFrame]:
    """Trains on normal rows and confident weak labels; patterns left without positives are dropped."""
    marked = mark_training(df, cutoff)
    used = marked.filter("used_in_training")
    return fit_patterns(used, features, patterns, estimator, drop_empty=True), marked


def detector_rows(scored: DataFrame, patterns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return metrics.long_scores(scored, {p: (f"proba_{p}", f"is_{p}") for p in patterns}, keep)
