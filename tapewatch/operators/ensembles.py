"""Additive tree ensembles read stage by stage: probabilities after every round, and the round to stop at."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators import metrics
from tapewatch.session import cut, workspace

#: Rows of a batch that are sent through all trees at once.
ROWS = 2048


@dataclass
class Ensemble:
    """Trees whose outputs are added up; ``nodes`` has (tree, node, feature, split, left, right, value).

    A row goes left where its feature is at most the split; a leaf has feature −1. The root of a tree is its node 0. The probability
    after k trees is the logistic function of ``steepness`` times (start + the first k weighted outputs).
    """

    features: list[str]
    nodes: pd.DataFrame
    weights: list[float]
    start: float = 0.0
    steepness: float = 1.0

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Nodes of all trees in one numbering, and the root of each tree."""
        n = self.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        at = {key: i for i, key in enumerate(zip(n["tree"], n["node"]))}
        child = [np.array([at.get((t, c), 0) for t, c in zip(n["tree"], n[side])]) for side in ("left", "right")]
        roots = np.array([at[t, 0] for t in range(len(self.weights))])
        value = n["value"].to_numpy(dtype=float) * np.array(self.weights)[n["tree"].to_numpy(dtype=int)]
        return n["feature"].to_numpy(dtype=int), n["split"].to_numpy(dtype=float), *child, value, roots


def from_boosting(model, features: Sequence[str], spark) -> Ensemble:
    """The trees of a fitted boosting classifier, from its saved node rows."""
    path = f"{workspace(spark)}/boosted"
    model.save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    leaf = F.col("leftChild") < 0
    nodes = rows.select(F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(leaf, -1).otherwise(F.col("split.featureIndex")).alias("feature"),
                        F.when(leaf, 0.0).otherwise(F.get("split.leftCategoriesOrThreshold", 0)).alias("split"), F.col("leftChild").alias("left"),
                        F.col("rightChild").alias("right"), F.col("prediction").alias("value")).toPandas()  # the model's nodes
    return Ensemble(list(features), nodes, list(model.treeWeights), steepness=2.0)


def staged_margins(df: DataFrame, ensemble: Ensemble, vector: str | None = None) -> DataFrame:
    """Adds ``margins``: the sum after each round, all rounds in one pass; null where a feature is null.

    Features are the ensemble's columns or the array column ``vector``.
    """
    x = F.col(vector).cast("array<double>") if vector else F.array(*[F.col(f).cast("double") for f in ensemble.features])
    feature, split, left, right, value, roots = ensemble.arrays()
    start = ensemble.start

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in parts:
            out: list = [None] * len(xs)
            known = [i for i, v in enumerate(xs) if v is not None and not any(u is None or u != u for u in v)]
            for a in range(0, len(known), ROWS):
                rows = known[a:a + ROWS]
                m = np.vstack([np.asarray(xs.iloc[i], dtype=float) for i in rows])
                at = np.tile(roots, (len(m), 1))
                while (inner := feature[at] >= 0).any():
                    smaller = m[np.arange(len(m))[:, None], np.maximum(feature[at], 0)] <= split[at]
                    at = np.where(inner, np.where(smaller, left[at], right[at]), at)
                for i, margin in zip(rows, start + np.cumsum(value[at], axis=1)):
                    out[i] = margin.tolist()
            yield pd.Series(out, dtype=object)

    return df.withColumn("margins", F.pandas_udf(run, "array<double>")(x))


def staged_scores(df: DataFrame, ensemble: Ensemble, label: str, vector: str | None = None, stages: Sequence[int] | None = None) -> DataFrame:
    """(stage, score, label): the probability of every row after each round, or after the given ones."""
    rows = staged_margins(df, ensemble, vector).select("margins", F.col(label).cast("int").alias("label"))
    rows = rows.select("label", F.posexplode("margins").alias("place", "margin")).withColumn("stage", F.col("place") + 1)
    if stages is not None:
        rows = rows.filter(F.col("stage").isin(*stages))
    return rows.select("stage", (1 / (1 + F.exp(-F.lit(ensemble.steepness) * F.col("margin")))).alias("score"), "label")


def stage_report(scores: DataFrame) -> DataFrame:
    """Per stage: AUC, positives and the mean probability."""
    scores = cut(scores, "stages")
    means = scores.groupBy("stage").agg(F.avg("score").alias("mean_probability"))
    return metrics.auc(scores, ["stage"]).select("stage", "n_positive", "auc").join(means, "stage")


def patience_stop(aucs: DataFrame, patience: int = 50) -> DataFrame:
    """(chosen_round, best_auc, rounds_seen): boosting ends when ``patience`` rounds in a row bring no better AUC than the best one, and is
    cut at that best one (the earliest of equal ones). ``aucs`` has a row per stage."""
    earlier = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    run = aucs.withColumn("_best", F.max(F.struct("auc", (-F.col("stage")).alias("at"))).over(earlier))
    ends = run.filter(F.col("stage") + F.col("_best.at") >= patience)
    last = ends.agg(F.min("stage").alias("_end"))
    kept = run.crossJoin(F.broadcast(last)).filter(F.col("_end").isNull() | (F.col("stage") <= F.col("_end")))
    best = F.max(F.struct("stage", "_best")).alias("_b")
    return kept.agg(best).select((-F.col("_b._best.at")).cast("int").alias("chosen_round"), F.col("_b._best.auc").alias("best_auc"), F.col("_b.stage").alias("rounds_seen"))


def boost_with_patience(train: DataFrame, held_out: DataFrame, names: Sequence[str], rounds: int = 1000, patience: int = 50, **kw):
    """(ensemble cut at the chosen round, stage report of ``held_out``, the stop). Both tables have ``features`` (a vector) and ``label``."""
    from pyspark.ml.functions import vector_to_array

    from tapewatch.operators.models import boosting

    model = boosting(rounds, **kw).fit(train)
    whole = from_boosting(model, names, train.sparkSession)
    report = cut(stage_report(staged_scores(held_out.withColumn("_x", vector_to_array("features")), whole, "label", "_x")), "report")
    stop = patience_stop(report, patience)
    chosen = stop.first().chosen_round
    nodes = whole.nodes[whole.nodes["tree"] < chosen]
    return Ensemble(whole.features, nodes, whole.weights[:chosen], whole.start, whole.steepness), report, stop
