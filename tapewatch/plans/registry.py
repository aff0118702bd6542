"""Models and baselines per market: save, load each independently, report coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators.forest import Forest
from tapewatch.operators.patterns import PatternDetector, Scorecard
from tapewatch.session import existing


@dataclass
class MarketModels:
    market: str
    forest: Forest | None = None
    detector: PatternDetector | Scorecard | None = None
    baselines: DataFrame | None = None
    trained_at: str = "unknown"
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def loaded(self) -> bool:
        return self.forest is not None or self.detector is not None


def save(spark: SparkSession, models: MarketModels, root: str) -> None:
    path = f"{root}/{models.market}"
    if models.forest is not None:
        models.forest.save(spark, f"{path}/forest")
    if models.detector is not None:
        models.detector.save(f"{path}/patterns")
        meta = [(list(models.detector.models), models.detector.features)]
        spark.createDataFrame(meta, "patterns ARRAY<STRING>, features ARRAY<STRING>").write.parquet(f"{path}/pattern_meta")
    if models.baselines is not None:
        models.baselines.write.parquet(f"{path}/baselines")
    spark.createDataFrame([(models.market, models.trained_at)], "market STRING, trained_at STRING").write.parquet(f"{path}/meta")


def load(spark: SparkSession, market: str, root: str) -> MarketModels:
    """Loads what it can: a broken or missing artefact is noted and does not stop the others.

    A forest without baselines is an error, since it was trained on z-scores.
    """
    path, out = f"{root}/{market}", MarketModels(market)

    def attempt(name, load_it):
        try:
            return load_it()
        except Exception as e:  # the reason is kept for the coverage report
            out.errors[name] = type(e).__name__
            return None

    out.forest = attempt("forest", lambda: Forest.load(spark, f"{path}/forest"))

    def detector():
        meta = spark.read.parquet(f"{path}/pattern_meta").first()
        kind = Scorecard if existing(spark, [f"{path}/patterns/scorecard"]) else PatternDetector
        return kind.load(f"{path}/patterns", meta.patterns, meta.features)

    out.detector = attempt("patterns", detector)
    out.baselines = attempt("baselines", lambda: spark.read.parquet(f"{path}/baselines"))
    meta = attempt("meta", lambda: spark.read.parquet(f"{path}/meta").first())
    out.trained_at = meta.trained_at if meta else "unknown"
    if out.forest is not None and out.baselines is None:
        raise ValueError(f"{market}: a forest without baselines cannot score")
    return out


def coverage(spark: SparkSession, models: list[MarketModels]) -> DataFrame:
    rows = [(m.market, m.forest is not None, m.detector is not None, list(m.detector.models) if m.detector else [], m.trained_at) for m in models]
    return spark.createDataFrame(rows, "market STRING, has_isolation_forest BOOLEAN, has_multi_pattern BOOLEAN, patterns ARRAY<STRING>, trained_at STRING")


def all_baselines(models: list[MarketModels]) -> DataFrame | None:
    """Baselines of all markets in one table keyed by (market, symbol)."""
    parts = [m.baselines for m in models if m.baselines is not None]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
