"""Exact classification trees and bagged forests: every value is a candidate split, all nodes of a level of all trees are split at once.

A level is one aggregate over the rows: weights and positives per (tree, node, feature, value), read in the order of values for the
gain of every split. The driver sees one row per node, so what it holds is bounded by trees and depth and not by the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, factorial, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import metrics
from tapewatch.operators import ordered as o
from tapewatch.session import cut

#: Nodes of all trees together; they are sent to every task.
MOST_NODES = 1 << 20
LEAF, OPEN = -1, -2
NODES = "tree INT, node INT, feature STRING, split DOUBLE, gain DOUBLE, n_rows BIGINT, n_positive BIGINT, value INT"


@dataclass
class Forest:
    """``nodes`` maps (tree, node) to (feature place or LEAF, split, gain, rows, positives).

    The children of a node i are 2i + 1 (feature at most the split) and 2i + 2; the root is 0. A leaf votes for the class of most of
    its rows, for 0 on a tie.
    """

    features: list[str]
    trees: int
    depth: int
    nodes: dict[tuple[int, int], tuple[int, float, float, int, int]]
    seed: int | None = None

    def rows(self, spark) -> DataFrame:
        """One row per node."""
        out = [(t, i, None if f == LEAF else self.features[f], None if f == LEAF else s, None if f == LEAF else g, n, p, _vote(n, p) if f == LEAF else None)
               for (t, i), (f, s, g, n, p) in sorted(self.nodes.items())]
        return spark.createDataFrame(out, NODES)


def _vote(n: int, p: int) -> int:
    return int(2 * p > n)


def drawn_features(tree: int, features: Sequence[str], seed: int) -> list[int]:
    """The places of the features of a tree: the square root of all (rounded down, one at least), by the md5 of seed, tree and name."""
    by_hash = sorted(range(len(features)), key=lambda i: hashlib.md5(f"{seed}:{tree}:{features[i]}".encode()).hexdigest())
    return sorted(by_hash[:max(1, isqrt(len(features)))])


def draws() -> list[float]:
    """How a uniform number gives the times that a row is drawn: as many as there are values here that it reaches (a Poisson law of mean 1)."""
    out, total = [], 0.0
    for k in range(12):
        total += exp(-1) / factorial(k)
        out.append(round(total, 12))
    return out


def times_drawn(tree: Column, key: Column, seed: int) -> Column:
    """How often a tree's sample has a row: a draw with replacement whose count per row depends on tree and key alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), key.cast("string")).cast("binary")), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.size(F.filter(F.array(*[F.lit(c) for c in draws()]), lambda c: c <= u))


def _flat(forest: Forest) -> tuple[Column, Column, Column, int]:
    """Features, splits and votes of all nodes as arrays; node i of tree t is at t * size + i."""
    size = (2 << forest.depth) - 1
    feature, split, vote = [LEAF] * (size * forest.trees), [0.0] * (size * forest.trees), [0] * (size * forest.trees)
    for (t, i), (f, s, _, n, p) in forest.nodes.items():
        feature[t * size + i], split[t * size + i], vote[t * size + i] = f, s, _vote(n, p)
    return _constant(feature, "int"), _constant(split, "double"), _constant(vote, "int"), size


def _constant(values: Sequence[float], kind: str) -> Column:
    """An array as one literal, which is folded before the first row."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _descend(x: Column, tree: Column, forest: Forest) -> Column:
    """The node of a tree that a row has reached."""
    feature, split, _, size = _flat(forest)

    def step(at: Column, _) -> Column:
        f = F.get(feature, tree * size + at)
        right = (F.get(x, f) > F.get(split, tree * size + at)).cast("int")
        return F.when(f < 0, at).otherwise(2 * at + 1 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.lit(0), step)


def _best_splits(counts: DataFrame) -> DataFrame:
    """Per (tree, node): totals and the split with the largest gain, then the first feature, then the smallest value; no split where all
    features have one value."""
    run = o.cumulative_by_value(counts, ["tree", "node", "feature"], "value", ["n", "p"])
    nl, pl = F.col("n_before") + F.col("n"), F.col("p_before") + F.col("p")
    nr, pr = F.col("n_total") - nl, F.col("p_total") - pl
    weighted = nl / F.col("n_total") * metrics.entropy(pl / nl) + nr / F.col("n_total") * metrics.entropy(F.try_divide(pr, nr))
    gain = F.round(metrics.entropy(F.col("p_total") / F.col("n_total")) - weighted, 12)
    key = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"), nl.alias("nl"), pl.alias("pl"))
    out = run.groupBy("tree", "node").agg(F.max("n_total").alias("n"), F.max("p_total").alias("p"), F.max(F.when(nr > 0, key)).alias("b"))
    return out.select("tree", "node", "n", "p", "b.gain", (-F.col("b.f")).alias("feature"), (-F.col("b.v")).alias("split"), "b.nl", "b.pl")


def fit_trees(df: DataFrame, features: Sequence[str], label: str, trees: int = 1, depth: int = 5, min_rows: int = 10,
              key: str | None = None, seed: int | None = None) -> Forest:
    """Trees by information gain. With a ``seed`` every tree has its own sample of rows, drawn with replacement by ``key``, and its own
    features; without one the tree has all rows and features.

    A node is split unless it is at ``depth``, has fewer than ``min_rows`` rows or one class, or no feature has two values. A split
    without gain is taken too, as in the reference. Rows with a null or NaN feature or a null label (0 or 1) are left out; without rows every
    tree is one leaf that votes 0. ``df`` is read once for each level.
    """
    if seed is not None and key is None:
        raise ValueError("samples are drawn by a key")
    if depth < 1 or trees * (2 << depth) > MOST_NODES:
        raise ValueError(f"trees times nodes must be at most {MOST_NODES}, and the depth at least 1")
    features = list(features)
    forest = Forest(features, trees, depth, {(t, 0): (OPEN, 0.0, 0.0, 0, 0) for t in range(trees)}, seed)
    places = [list(range(len(features))) if seed is None else drawn_features(t, features, seed) for t in range(trees)]
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(x.alias("x"), F.col(label).cast("int").alias("y"), (F.lit(None) if key is None else F.col(key)).cast("string").alias("key"))
    rows = rows.filter(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    while any(v[0] == OPEN for v in forest.nodes.values()):
        for (t, i), (f, s, g, n, p), nl, pl in _level(rows, forest, places, min_rows):
            forest.nodes[t, i] = (f, s, g, n, p)
            if f == LEAF:
                continue
            for child, n_child, p_child in ((2 * i + 1, nl, pl), (2 * i + 2, n - nl, p - pl)):
                done = child + 1 >= 1 << depth or n_child < min_rows or p_child in (0, n_child)
                forest.nodes[t, child] = (LEAF if done else OPEN, 0.0, 0.0, n_child, p_child)
        for at, v in forest.nodes.items():  # no row reached it: an empty sample
            if v[0] == OPEN and v[3] == 0:
                forest.nodes[at] = (LEAF, *v[1:])
    return forest


def _level(rows: DataFrame, forest: Forest, places: list[list[int]], min_rows: int):
    """The splits of all open nodes: ((tree, node), values of the node, rows and positives at most the split)."""
    tree = F.col("tree")
    spread = rows.select("x", "y", "key", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    weight = F.lit(1) if forest.seed is None else times_drawn(tree, F.col("key"), forest.seed)
    spread = spread.select("x", "y", "tree", _descend(F.col("x"), tree, forest).alias("node"), weight.cast("bigint").alias("w")).filter("w > 0")
    feature, _, _, size = _flat(forest)
    spread = spread.filter(F.get(feature, tree * size + F.col("node")) == OPEN)
    own = F.get(F.array(*[F.array(*[F.lit(p) for p in chosen]) for chosen in places]), tree)
    cells = F.explode(F.transform(own, lambda p: F.struct(p.alias("feature"), F.get("x", p).alias("value"))))
    long = spread.select("tree", "node", "w", (F.col("w") * F.col("y")).alias("wy"), cells.alias("c")).select("tree", "node", "w", "wy", "c.*")
    counts = cut(long.groupBy("tree", "node", "feature", "value").agg(F.sum("w").alias("n"), F.sum("wy").alias("p")), "counts")
    for r in _best_splits(counts).collect():  # one row per open node
        if r.gain is None or r.n < min_rows or r.p in (0, r.n):
            yield (r.tree, r.node), (LEAF, 0.0, 0.0, r.n, r.p), 0, 0
        else:
            yield (r.tree, r.node), (r.feature, r.split + 0.0, r.gain, r.n, r.p), r.nl, r.pl


def vote(df: DataFrame, forest: Forest, key: str | None = None, out: str = "score") -> DataFrame:
    """Adds the share of trees that vote 1, and with ``key`` the share among the trees whose sample lacks the row (``<out>_unseen``,
    null if none lacks it). Null where a feature is null or NaN."""
    x = F.array(*[F.col(f).cast("double") for f in forest.features])
    _, _, votes, size = _flat(forest)
    known = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    each = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.get(votes, t * size + _descend(x, t, forest)))
    df = df.withColumn("_votes", F.when(known, each))

    def share(values: Column) -> Column:
        return F.try_divide(F.aggregate(values, F.lit(0), lambda a, v: a + v).cast("double"), F.size(values).cast("double"))

    df = df.withColumn(out, share(F.col("_votes")))
    if key is not None and forest.seed is not None:
        unseen = F.filter(F.transform("_votes", lambda v, t: F.when(times_drawn(t, F.col(key), forest.seed) == 0, v)), lambda v: v.isNotNull())
        df = df.withColumn(f"{out}_unseen", F.when(F.col("_votes").isNotNull(), share(unseen)))
    return df.drop("_votes")
