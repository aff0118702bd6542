"""Random forests of two classes on binned features, grown a level at a time from blocks of packed rows.

The rules are those of Spark's forest: bins of a feature at quantiles of the rows (64 at most), samples by a Poisson law, Gini gain
of class weights, a fresh draw of features for every node, and the mean of the leaves' shares as probability. Spark's own keeps a
count per tree with every cached row and visits rows one by one. Here a row is a byte per feature, samples are drawn again
from the block's number whenever they are needed, and a task counts a block of rows at once for every open node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.session import cut

#: Bins of a feature at most; twice a bin fits a byte.
BINS = 64
#: Rows of a batch that are sent through the trees at once.
ROWS = 4096
_TIMES = np.repeat(np.arange(9), np.diff(np.round(np.append(0, np.append(np.cumsum([exp(-1) / factorial(k) for k in range(8)]), 1)) * 65536)).astype(int)).astype(np.int8)


def times_drawn(n: int, *place: int) -> np.ndarray:
    """How often a sample has each of ``n`` rows (a Poisson law of mean 1, to 16 bits); the same for the same place."""
    raw = np.random.Generator(np.random.SFC64(list(place))).bytes(2 * n)
    return _TIMES.take(np.frombuffer(raw, dtype=np.uint16))


def _drawn_features(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    count = ceil(sqrt(width))
    return np.sort(np.random.default_rng([seed, 1, tree, node]).choice(width, count, replace=False))


def _packed(parts: Iterator[pd.DataFrame], cuts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Blocks of rows: their number, the bins of each feature, labels and weights as bytes."""
    here = TaskContext.get().partitionId()
    for k, pdf in enumerate(parts):
        x = np.vstack(pdf["x"].to_numpy())
        bins = np.array([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], dtype=np.uint8)
        yield pd.DataFrame({"part": [here], "number": [k], "bins": [bins.tobytes()], "y": [pdf["y"].to_numpy().astype(np.uint8).tobytes()],
                            "w": [pdf["w"].to_numpy(dtype=float).tobytes()]})


def _reached(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each of the rows has reached after some levels; a row passes a leaf on its left."""
    at, flat, start = np.zeros(len(rows), dtype=np.intp), bins.ravel(), np.maximum(feature, 0) * bins.shape[1]
    for _ in range(levels):
        right = flat.take(start.take(at) + rows) > split.take(at)
        at += at + 1
        at += right
    return at


def _counted(blocks: Iterator[pa.RecordBatch], nodes: tuple[np.ndarray, np.ndarray], chosen: list[np.ndarray], slots: np.ndarray,
             level: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sums of weights per open node, drawn feature, bin and class, an array for each tree."""
    feature, split = nodes
    sums = [np.zeros(2 * BINS * c.size) for c in chosen]
    for batch in blocks:
        for part, number, bins, y, w in zip(*(batch.column(k).to_pylist() for k in range(5))):
            y, w = np.frombuffer(y, dtype=np.uint8).astype(np.intp), np.frombuffer(w)
            bins = np.frombuffer(bins, dtype=np.uint8).reshape(-1, len(y))
            twice, n = 2 * bins.ravel(), len(y)
            for t, c in enumerate(chosen):
                if not c.size:
                    continue
                times = times_drawn(n, seed, t, part, number)
                rows = np.flatnonzero(times)
                slot = slots[t][_reached(bins, rows, feature[t], split[t], level)]
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                weight, width = times[rows] * w[rows], c.shape[1]
                cell = slot * (2 * BINS * width) + y[rows]
                for j in range(width):
                    sums[t] += np.bincount(cell + twice.take((c[:, j] * n).take(slot) + rows), weights=weight, minlength=len(sums[t]))
                    cell += 2 * BINS
    trees = [t for t, c in enumerate(chosen) if c.size]
    yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array([sums[t].tobytes() for t in trees], pa.binary())], ["tree", "sums"])


def _gini(one: np.ndarray, all_: np.ndarray) -> np.ndarray:
    p = np.divide(one, all_, out=np.zeros_like(one), where=all_ > 0)
    return 2 * p * (1 - p)


def _splits(chosen: list[np.ndarray], open_: list[np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a tree: the split with the largest gain of every open node; the first feature and the smallest bin of equal ones."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        c = chosen[t]
        s = sum(np.frombuffer(x) for x in pdf["sums"]).reshape(*c.shape, BINS, 2)
        left = s.cumsum(axis=2)
        total = left[:, :, -1:, :]
        n, p = left.sum(axis=3), left[..., 1]
        big, pos = total.sum(axis=3), total[..., 1]
        gain = _gini(pos, big) - (n * _gini(p, n) + (big - n) * _gini(pos - p, big - n)) / np.maximum(big, 1e-300)
        gain = np.where((n > 1e-9 * big) & (big - n > 1e-9 * big), np.round(gain, 12), -1.0).reshape(len(c), -1)
        at = gain.argmax(axis=1)
        best, (j, b), k = gain.max(axis=1), divmod(at, BINS), np.arange(len(c))
        return pd.DataFrame({"tree": t, "node": open_[t], "feature": np.where(best > 0, c[k, j], -1), "split": b, "gain": best, "n": big[k, 0, 0], "p": pos[k, 0, 0],
                             "nl": n[k, j, b], "pl": p[k, j, b]})
    return run


@dataclass
class ForestModel:
    """Trees in heap order (children of i are 2i + 1 and 2i + 2); a row goes left where its feature is at most the threshold."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    share: np.ndarray
    importances: np.ndarray

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def score(self, vector: str) -> Column:
        """The probability of class 1 for a vector column."""
        cuts, feature, split, share, depth = self.cuts, self.feature, self.split, self.share, self.depth

        @F.pandas_udf("double")
        def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in parts:
                out = np.zeros(len(xs))
                for a in range(0, len(xs), ROWS):
                    x = np.array([np.asarray(v, dtype=float) for v in xs.iloc[a:a + ROWS]]).reshape(-1, len(cuts))
                    bins = np.array([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], dtype=np.uint8)
                    rows = np.arange(len(x))
                    out[a:a + ROWS] = sum(share[t][_reached(bins, rows, feature[t], split[t], depth)] for t in range(len(feature))) / len(feature)
                yield pd.Series(out)

        return apply(vector_to_array(F.col(vector)))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        nodes = [(t, i, int(self.feature[t, i]), int(self.split[t, i]), float(self.share[t, i])) for t, i in np.ndindex(*self.feature.shape)]
        spark.createDataFrame(nodes, "tree INT, node INT, feature INT, split INT, share DOUBLE").coalesce(1).write.parquet(f"{path}/nodes")
        meta = [(f, c.tolist(), float(v)) for f, (c, v) in enumerate(zip(self.cuts, self.importances))]
        spark.createDataFrame(meta, "feature INT, cuts ARRAY<DOUBLE>, importance DOUBLE").coalesce(1).write.parquet(f"{path}/features")

    @staticmethod
    def load(path: str) -> ForestModel:
        spark = SparkSession.getActiveSession()
        meta = spark.read.parquet(f"{path}/features").orderBy("feature").collect()  # a row for each feature
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])  # the model's nodes
        shape = (int(nodes["tree"].max()) + 1, -1)
        return ForestModel([np.array(r.cuts) for r in meta], *(nodes[c].to_numpy().reshape(shape) for c in ("feature", "split", "share")),
                           np.array([r.importance for r in meta]))


@dataclass
class Forest:
    """The estimator: ``fit`` takes rows with a vector, a 0/1 label and, if named, a weight."""

    trees: int = 100
    depth: int = 6
    seed: int = 42
    features: str = "features"
    label: str = "label"
    weight: str | None = None

    def fit(self, df: DataFrame) -> ForestModel:
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("y"), weight.alias("w"))
        width = len(rows.select("x").first().x)
        shares = [k / BINS for k in range(1, BINS)]
        found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), shares, 100 * BINS).alias(f"q{f}") for f in range(width)],
                         *[F.max(F.get("x", F.lit(f))).alias(f"m{f}") for f in range(width)]).first()
        cuts = [np.unique([v for v in found[f"q{f}"] if v < found[f"m{f}"]]).astype(float) for f in range(width)]
        blocks = cut(rows.mapInPandas(lambda parts: _packed(parts, cuts), "part INT, number INT, bins BINARY, y BINARY, w BINARY"), "blocks")
        return self._grow(blocks, cuts)

    def _grow(self, blocks: DataFrame, cuts: list[np.ndarray]) -> ForestModel:
        size = (2 << self.depth) - 1
        feature, split = np.full((self.trees, size), -1), np.full((self.trees, size), BINS)
        share, worth = np.zeros((self.trees, size)), np.zeros((self.trees, len(cuts)))
        open_ = [np.array([0]) for _ in range(self.trees)]
        seed = self.seed
        for level in range(self.depth):
            chosen = [np.array([_drawn_features(seed, t, i, len(cuts)) for i in nodes.tolist()]) for t, nodes in enumerate(open_)]
            slots = np.full((self.trees, size), -1)
            for t, nodes in enumerate(open_):
                slots[t, nodes] = np.arange(len(nodes))
            state = (feature.copy(), split.copy())
            sums = blocks.mapInArrow(lambda b: _counted(b, state, chosen, slots, level, seed), "tree INT, sums BINARY")
            found = sums.groupBy("tree").applyInPandas(
                _splits(chosen, open_), "tree INT, node INT, feature INT, split INT, gain DOUBLE, n DOUBLE, p DOUBLE, nl DOUBLE, pl DOUBLE")
            nodes = cut(found, "nodes").collect()  # a row for each open node
            open_ = [[] for _ in range(self.trees)]
            for r in nodes:
                if r.n > 0:
                    share[r.tree, r.node] = r.p / r.n
                below = (2 * r.node + 1, 2 * r.node + 2)
                if r.feature < 0:
                    self._leaf(share, r.tree, r.node)
                    continue
                feature[r.tree, r.node], split[r.tree, r.node] = r.feature, r.split
                worth[r.tree, r.feature] += r.gain * r.n
                for child, n, p in zip(below, (r.nl, r.n - r.nl), (r.pl, r.p - r.pl)):
                    share[r.tree, child] = min(max(p / n, 0.0), 1.0)
                    if level + 1 < self.depth and 1e-9 * n < p < n * (1 - 1e-9):
                        open_[r.tree].append(child)
                    else:
                        self._leaf(share, r.tree, child)
            open_ = [np.array(sorted(nodes), dtype=int) for nodes in open_]
            if not any(len(nodes) for nodes in open_):
                break
        worth = worth / np.maximum(worth.sum(axis=1, keepdims=True), 1e-300)
        total = worth.sum(axis=0)
        return ForestModel(cuts, feature, split, share, total / total.sum() if total.sum() > 0 else total)

    @staticmethod
    def _leaf(share: np.ndarray, tree: int, node: int) -> None:
        """Rows pass a leaf on its left, down to the last level, and keep its share."""
        at = node
        while 2 * at + 1 < share.shape[1]:
            at = 2 * at + 1
            share[tree, at] = share[tree, node]
