"""Exact trees and bagged forests on labelled documents; the SQL grows the same trees level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import metrics, trees
from tapewatch.session import cut
from tapewatch.sources import tables as t

# Characters of a text that are counted as its features.
CLASSES = {"spaces": "[ ]", "marks": "[.,;:!?]", "capitals": "[A-Z]", "digits": "[0-9]", "symbols": "[#*$%&|<>]"}
NAMES = ["chars", *CLASSES]
SEED, TREES, DEPTH, MIN_ROWS = 42, 20, 5, 10


def labelled_texts(spark, d):
    text = F.col("text")
    counts = {k: F.length(text) - F.length(F.regexp_replace(text, c, "")) for k, c in CLASSES.items()}
    docs = t.read(spark, d, "documents").select("doc_id", F.length(text).alias("chars"), *[c.alias(k) for k, c in counts.items()])
    return cut(docs.join(t.read(spark, d, "labels").select("doc_id", "quality").filter("quality is not null"), "doc_id"), "rows")


def _grown(n_trees: int, depth: int, min_rows: int, seed: int | None) -> str:
    """Common table expressions up to ``nodes``: the rows of every node, its best split, its totals."""
    counted = ", ".join(["length(text)", *[f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in CLASSES.values()]])
    own = [(i, f) for i in range(n_trees) for f in (range(len(NAMES)) if seed is None else trees.drawn_features(i, NAMES, seed))]
    u = f"(('0x' || substr(md5('{seed}:' || tree || ':' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE"
    u, drawn = ("1", "1") if seed is None else (u, " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in trees.draws()))

    def bits(p: str) -> str:
        return f"(CASE WHEN {p} IN (0, 1) THEN 0 ELSE -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) END)"

    parts = [f"doc AS MATERIALIZED (SELECT doc_id, quality AS y, [{counted}]::DOUBLE[] AS x FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)",
             f"own AS (SELECT * FROM (VALUES {', '.join(map(str, own))}) v(tree, feature))",
             f"drawn AS MATERIALIZED (SELECT tree, doc_id, y, x, {drawn} AS w FROM (SELECT *, {u} AS u FROM doc, range({n_trees}) r(tree)))",
             "r0 AS MATERIALIZED (SELECT *, 0 AS node FROM drawn WHERE w > 0)"]
    for k in range(depth + 1):
        parts.append(f"t{k} AS MATERIALIZED (SELECT tree, node, sum(w) AS n, sum(w * y) AS p FROM r{k} GROUP BY 1, 2)")
        if k == depth:
            break
        parts += [
            f"l{k} AS (SELECT tree, node, feature, x[feature + 1] AS v, sum(w) AS n, sum(w * y) AS p FROM r{k} JOIN own USING (tree) GROUP BY ALL)",
            f"c{k} AS (SELECT tree, node, feature, v, sum(n) OVER u AS nl, sum(p) OVER u AS pl, sum(n) OVER f AS n, sum(p) OVER f AS p FROM l{k} "
            "WINDOW u AS (PARTITION BY tree, node, feature ORDER BY v ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY tree, node, feature))",
            f"e{k} AS (SELECT *, p / n AS a, pl / nl AS b, (p - pl) / (n - nl) AS c FROM c{k} WHERE n > nl AND n >= {min_rows} AND p NOT IN (0, n))",
            f"g{k} AS (SELECT *, round({bits('a')} - nl / n * {bits('b')} - (n - nl) / n * {bits('c')}, 12) AS gain FROM e{k})",
            f"b{k} AS MATERIALIZED (SELECT tree, node, feature, v AS split, gain FROM g{k} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, v) = 1)",
            f"r{k + 1} AS MATERIALIZED (SELECT tree, doc_id, y, x, w, 2 * node + 1 + (x[feature + 1] > split)::INT AS node FROM r{k} JOIN b{k} USING (tree, node))"]
    levels = " UNION ALL ".join([f"SELECT t{k}.*, feature, split, gain FROM t{k} LEFT JOIN b{k} USING (tree, node)" for k in range(depth)]
                                + [f"SELECT *, NULL, NULL, NULL FROM t{depth}"])
    parts.append(f"nodes AS MATERIALIZED ({levels})")
    return "WITH " + ", ".join(parts)


def _node_rows() -> str:
    names = ", ".join(f"'{n}'" for n in NAMES)
    return (f"SELECT tree, node, [{names}][feature + 1] AS feature, split, round(gain, 9) AS gain, n AS n_rows, p AS n_positive, "
            "CASE WHEN feature IS NULL THEN (2 * p > n)::INT END AS value FROM nodes")


def _scores() -> str:
    parts = ["a0 AS (SELECT tree, doc_id, y, x, w, 0 AS node FROM drawn)"]
    for k in range(DEPTH):
        parts.append(f"a{k + 1} AS (SELECT tree, doc_id, y, x, w, CASE WHEN feature IS NULL THEN node ELSE 2 * node + 1 + (x[feature + 1] > split)::INT END AS node "
                     f"FROM a{k} LEFT JOIN nodes USING (tree, node))")
    votes = f"voted AS (SELECT doc_id, y, w, (2 * p > n)::INT AS vote FROM a{DEPTH} JOIN nodes USING (tree, node))"
    return (", " + ", ".join([*parts, votes]) + " SELECT doc_id, y AS quality, round(avg(vote), 9) AS score, round(avg(vote) FILTER (WHERE w = 0), 9) AS score_unseen "
            "FROM voted GROUP BY doc_id, y")


def _rounded_nodes(forest, spark):
    return forest.rows(spark).withColumn("gain", F.round("gain", 9))


@query("exact_tree", "M16 A32", _grown(1, DEPTH, MIN_ROWS, None) + " " + _node_rows())
def exact_tree(spark, d):
    return _rounded_nodes(trees.fit_trees(labelled_texts(spark, d), NAMES, "quality", depth=DEPTH, min_rows=MIN_ROWS), spark)


def _forest(rows):
    return trees.fit_trees(rows, NAMES, "quality", TREES, DEPTH, MIN_ROWS, key="doc_id", seed=SEED)


@query("bagged_forest", "M17", _grown(TREES, DEPTH, MIN_ROWS, SEED) + " " + _node_rows())
def bagged_forest(spark, d):
    return _rounded_nodes(_forest(labelled_texts(spark, d)), spark)


@query("bagged_forest_scores", "M17", _grown(TREES, DEPTH, MIN_ROWS, SEED) + _scores())
def bagged_forest_scores(spark, d):
    rows = labelled_texts(spark, d)
    scored = trees.vote(rows, _forest(rows), key="doc_id")
    return scored.select("doc_id", "quality", F.round("score", 9).alias("score"), F.round("score_unseen", 9).alias("score_unseen"))


@query("bagged_forest_auc", "M17 A17")
def bagged_forest_auc(spark, d):
    """AUC over all rows by all trees, and by the trees whose samples lack the row."""
    rows = labelled_texts(spark, d)
    scored = cut(trees.vote(rows, _forest(rows), key="doc_id"), "scored")
    return metrics.auc(metrics.long_scores(scored, {"all": ("score", "quality"), "unseen": ("score_unseen", "quality")}), ["pattern"])
