"""Isolation forest: tree growth per tree in parallel, vectorised scoring with the broadcast node table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.functions.scoring import EULER_GAMMA
from tapewatch.operators import metrics
from tapewatch.session import cut
from tapewatch.sources.validate import refuse_identity

NODE_SCHEMA = "tree_id INT, node_id INT, feature INT, split DOUBLE, depth INT"


@dataclass
class Forest:
    """Node rows in heap order (children of i are 2i and 2i + 1); feature −1 marks a leaf."""

    features: list[str]
    sample_size: int
    nodes: pd.DataFrame

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = int(self.nodes["node_id"].max()) + 1
        trees = np.sort(self.nodes["tree_id"].unique())
        at = np.searchsorted(trees, self.nodes["tree_id"].to_numpy())
        ids = self.nodes["node_id"].to_numpy()
        feature = np.full((len(trees), width), -1, dtype=np.int32)
        split, depth = np.zeros((len(trees), width)), np.zeros((len(trees), width))
        feature[at, ids] = self.nodes["feature"].to_numpy()
        split[at, ids] = self.nodes["split"].fillna(0.0).to_numpy()
        depth[at, ids] = self.nodes["depth"].to_numpy()
        return feature, split, depth

    def save(self, spark: SparkSession, path: str) -> None:
        meta = spark.createDataFrame([(self.sample_size, self.features)], "sample_size INT, features ARRAY<STRING>")
        meta.write.parquet(f"{path}/meta")
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Forest(list(meta.features), meta.sample_size, spark.read.parquet(f"{path}/nodes").toPandas())


def path_constant(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def _grow(x: np.ndarray, max_depth: int, rng: np.random.Generator) -> list[tuple[int, int, float, int]]:
    """Splits at a uniform value of a random feature until a row is alone or the depth is reached."""
    rows, stack = [], [(1, 0, x)]
    while stack:
        node, depth, part = stack.pop()
        if depth < max_depth and len(part) > 1:
            f = int(rng.integers(part.shape[1]))
            lo, hi = part[:, f].min(), part[:, f].max()
            if lo < hi:
                split = float(rng.uniform(lo, hi))
                left = part[:, f] < split
                rows.append((node, f, split, depth))
                stack += [(2 * node, depth + 1, part[left]), (2 * node + 1, depth + 1, part[~left])]
                continue
        rows.append((node, -1, 0.0, depth))
    return rows


HASHES = 1 << 40


def fit_forest(df: DataFrame, features: Sequence[str], key: str, *, trees: int = 100, sample: int = 256,
               seed: int = 42) -> Forest:
    """``sample`` rows without replacement per tree, chosen by a hash of the tree and the row key.

    Every row can be drawn by every tree. A tree first takes the rows under a share of its hashes that should give
    three samples and 200 rows (fewer than a sample come out with a chance under e^-100), then the smallest hashes.
    So only drawn rows are shuffled, and the choice does not depend on partitioning. Trees grow in parallel.
    """
    features = list(features)
    refuse_identity(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    kept = df.dropna(subset=features).select(F.col(key).cast("string").alias("_key"), x.alias("x"))
    below = int(min(1.0, (3 * sample + 200) / max(kept.count(), 1)) * HASHES)
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                    lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("_key")), F.lit(HASHES)) < F.lit(below))
    drawn = kept.select("_key", "x", F.explode(mine).alias("tree_id"))
    place = F.pmod(F.xxhash64(F.lit(seed), "tree_id", "_key"), F.lit(HASHES))
    pick = Window.partitionBy("tree_id").orderBy(place, "_key")
    drawn = drawn.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        tree = int(pdf["tree_id"].iloc[0])
        m = np.vstack(pdf["x"].to_numpy())
        depth = math.ceil(math.log2(max(len(m), 2)))
        rows = _grow(m, depth, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(rows, columns=["node_id", "feature", "split", "depth"])
        out["tree_id"], out["size"] = tree, len(m)
        return out[["tree_id", "node_id", "feature", "split", "depth", "size"]]

    nodes = drawn.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA + ", size INT").toPandas()
    if nodes.empty:
        raise ValueError("no complete rows to grow trees from")
    size = int(nodes["size"].iloc[0])
    return Forest(features, size, nodes.drop(columns="size"))


def mean_depths(x: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Mean leaf depth of every row over all trees, one level of all rows at a time."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    levels = int(depth.max()) if depth.size else 0
    for t in range(len(feature)):
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(levels):
            f = feature[t, at]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] >= split[t, at]
            at = np.where(inner, 2 * at + right, at)
        total += depth[t, at]
    return total / len(feature)


def score(df: DataFrame, forest: Forest, out: str = "if_score", inputs: dict[str, str] | None = None) -> DataFrame:
    """Adds 2^(−mean depth / c(sample)); higher is more anomalous; null where a feature is null."""
    arrays = df.sparkSession.sparkContext.broadcast(forest.arrays())
    c = path_constant(forest.sample_size)

    @F.pandas_udf("double")
    def apply(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, split, depth = arrays.value
        for columns in parts:
            x = np.column_stack([s.to_numpy(dtype="float64", na_value=np.nan) for s in columns])
            known = ~np.isnan(x).any(axis=1)
            s = np.full(len(x), np.nan)
            if known.any():
                s[known] = 2.0 ** (-mean_depths(x[known], feature, split, depth) / c) if c else 0.0
            yield pd.Series(s).where(known, None).astype("Float64")

    inputs = inputs or {}
    cols = [F.col(inputs.get(f, f)).cast("double") for f in forest.features]
    return df.withColumn(out, apply(*cols))


def fit_score_flag(df: DataFrame, features: Sequence[str], key: str, contamination: float | str = 0.05,
                   trees: int = 100, seed: int = 42) -> tuple[DataFrame, Forest]:
    forest = fit_forest(df, features, key, trees=trees, seed=seed)
    scored = cut(score(df, forest), "scored")
    return metrics.flag_top(scored, "if_score", contamination, out="if_flag"), forest
