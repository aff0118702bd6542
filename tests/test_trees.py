"""Trees grown level by level against a plain recursion; samples do not depend on partitioning."""

import math
import random

import pytest

from tapewatch.operators import trees

FIELDS = ["a", "b", "c"]


def bits(ys):
    p = sum(ys) / len(ys)
    return 0.0 if p in (0, 1) else -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def grown(rows, depth, min_rows, at=0, level=0):
    """{node: (feature or None, split or None, rows, positives)} by trying every value of every feature."""
    ys = [y for _, y in rows]
    best = None
    if level < depth and len(rows) >= min_rows and 0 < sum(ys) < len(ys):
        for f in range(len(rows[0][0])):
            for v in sorted({x[f] for x, _ in rows})[:-1]:
                sides = [y for x, y in rows if x[f] <= v], [y for x, y in rows if x[f] > v]
                gain = round(bits(ys) - sum(len(s) / len(ys) * bits(s) for s in sides), 12)
                if best is None or gain > best[0]:
                    best = gain, f, v
    if best is None:
        return {at: (None, None, len(ys), sum(ys))}
    _, f, v = best
    out = {at: (f, v, len(ys), sum(ys))}
    out |= grown([r for r in rows if r[0][f] <= v], depth, min_rows, 2 * at + 1, level + 1)
    return out | grown([r for r in rows if r[0][f] > v], depth, min_rows, 2 * at + 2, level + 1)


def sample(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(6)), rng.choice([-1.5, 0.0, 2.25]), round(rng.gauss(0, 1), 1)]
        rows.append((i, *x, int(x[0] + x[2] + rng.gauss(0, 1) > 3)))
    return rows


def plain_nodes(forest):
    return {i: (None, None, n, p) if f == trees.LEAF else (f, s, n, p) for (_, i), (f, s, _, n, p) in forest.nodes.items()}


def test_tree_equals_recursion(spark):
    rows = sample(150)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    forest = trees.fit_trees(df, FIELDS, "y", depth=4, min_rows=10)
    expected = grown([(r[1:4], r[4]) for r in rows], 4, 10)
    assert plain_nodes(forest) == expected and len(expected) > 7
    got = {r.id: r.score for r in trees.vote(df, forest).collect()}
    for r in rows:
        at = 0
        while expected[at][0] is not None:
            at = 2 * at + 1 + (r[1 + expected[at][0]] > expected[at][1])
        assert got[r[0]] == float(2 * expected[at][3] > expected[at][2])


def test_samples_follow_keys_not_partitions(spark):
    rows = sample(120)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    fits = [trees.fit_trees(df.repartition(n), FIELDS, "y", trees=4, depth=3, key="id", seed=7) for n in (1, 5)]
    assert fits[0].nodes == fits[1].nodes
    forest = fits[0]
    assert len({tuple(sorted((i, v) for (u, i), v in forest.nodes.items() if u == t)) for t in range(4)}) > 1
    for t in range(4):  # one feature of three, and a sample of about as many rows as there are
        assert {f for (u, _), (f, *_) in forest.nodes.items() if u == t} <= {trees.LEAF, *trees.drawn_features(t, FIELDS, 7)}
        assert 80 <= forest.nodes[t, 0][3] <= 160
    scored = trees.vote(df, forest, key="id").collect()
    assert all(0 <= r.score <= 1 for r in scored)
    unseen = sum(r.score_unseen is not None for r in scored) / len(scored)
    assert 0.75 <= unseen <= 0.95  # 1 - (1 - 1/e)^4 = 0.84


def test_edges_of_trees(spark):
    kind = "x double, y double, tree double, node int, w string"  # names that the operator uses itself
    empty = spark.createDataFrame([], kind)
    forest = trees.fit_trees(empty, ["x", "y"], "node", trees=2, key="w", seed=1)
    assert {k: v[0] for k, v in forest.nodes.items()} == {(0, 0): trees.LEAF, (1, 0): trees.LEAF}
    assert trees.vote(empty, forest, key="w").columns == [*empty.columns, "score", "score_unseen"]
    rows = [(1.0, 5.0, 0.0, 0, "p")] * 6 + [(2.0, 5.0, 0.0, 1, None)] * 7 + [(None, 5.0, 0.0, 1, "q"), (float("nan"), 5.0, 0.0, 0, "r"), (1.0, 5.0, 0.0, None, "s")]
    df = spark.createDataFrame(rows, kind)
    forest = trees.fit_trees(df, ["y", "x"], "node", min_rows=2)
    assert plain_nodes(forest) == {0: (1, 1.0, 13, 7), 1: (None, None, 6, 0), 2: (None, None, 7, 7)}
    assert [r.score for r in trees.vote(df, forest).orderBy("w", "x").collect()].count(None) == 2
    one_value = trees.fit_trees(df, ["y"], "node", min_rows=2)
    assert plain_nodes(one_value) == {0: (None, None, 15, 8)}
    assert one_value.rows(spark).first().value == 1
    with pytest.raises(ValueError):
        trees.fit_trees(df, ["x"], "node", depth=25)
    with pytest.raises(ValueError):
        trees.fit_trees(df, ["x"], "node", seed=1)
