"""Forest, outlier factors, weak labels and metrics with exact references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.series_windows import BAR_FEATURES, TICK_FEATURES, bar_features, rounded
from tapewatch.functions import scoring as sc
from tapewatch.operators import features as ft
from tapewatch.operators import forest as fo
from tapewatch.operators import lof, metrics, patterns
from tapewatch.operators import ordered as o
from tapewatch.schemas import FEATURES, PATTERNS
from tapewatch.session import cut
from tapewatch.sources import tables as t

# A forest of three small trees over return, volume ratio, volatility and RSI, for exact checks.
FIXED_FEATURES = ["return", "volume_ratio_20d", "volatility_20d", "rsi_14d"]
FIXED_NODES = [
    (0, 1, 0, 1.5, 0), (0, 2, 1, 1.2, 1), (0, 3, -1, 0.0, 1), (0, 4, -1, 0.0, 2), (0, 5, 3, 60.0, 2), (0, 10, -1, 0.0, 3), (0, 11, -1, 0.0, 3),
    (1, 1, 2, 90.0, 0), (1, 2, 3, 45.0, 1), (1, 3, 0, 4.0, 1), (1, 4, -1, 0.0, 2), (1, 5, -1, 0.0, 2), (1, 6, -1, 0.0, 2), (1, 7, -1, 0.0, 2),
    (2, 1, 1, 0.9, 0), (2, 2, -1, 0.0, 1), (2, 3, 1, 1.6, 1), (2, 6, 2, 200.0, 2), (2, 7, -1, 0.0, 2), (2, 12, -1, 0.0, 3), (2, 13, -1, 0.0, 3),
]


def fixed_forest() -> fo.Forest:
    return fo.Forest(FIXED_FEATURES, 256, pd.DataFrame(FIXED_NODES, columns=["tree_id", "node_id", "feature", "split", "depth"]))


def _tree_sql(tree: int, node: int = 1) -> str:
    rows = {n: (f, s, dp) for tr, n, f, s, dp in FIXED_NODES if tr == tree}
    f, s, dp = rows[node]
    if f < 0:
        return str(dp)
    return f'CASE WHEN "{FIXED_FEATURES[f]}" < {s} THEN {_tree_sql(tree, 2 * node)} ELSE {_tree_sql(tree, 2 * node + 1)} END'


C256 = fo.path_constant(256)
FIXED_SCORE = "pow(2.0, -((" + ") + (".join(_tree_sql(i) for i in range(3)) + f")) / 3.0 / {C256!r}::DOUBLE)"
SCORED_TICKS = f"""{TICK_FEATURES}, kept AS (SELECT * FROM feats WHERE {sql.COMPLETE}),
  scored AS (SELECT *, {FIXED_SCORE} AS if_score FROM kept)"""


def scored_ticks(spark, d):
    """Scored rows are written once, because thresholds read them several times."""
    return cut(fo.score(ft.complete(ft.engineered_features(t.ticks(spark, d))), fixed_forest()), "scored")


@query("forest_scores", "M2 F14", f"WITH {SCORED_TICKS} SELECT event_id, round(if_score, 9) AS if_score FROM scored")
def forest_scores(spark, d):
    return scored_ticks(spark, d).select("event_id", F.round("if_score", 9).alias("if_score"))


# A continuous score in [0, 1) without ties at quantile borders, for threshold checks.
SOFT = "((if_score + (event_id * 7919) % 10007 / 10007.0::DOUBLE) / 2)"


def soft_ticks(spark, d):
    s = (F.col("if_score") + F.col("event_id") * 7919 % 10007 / 10007.0) / 2
    lof_score = (F.col("event_id") * 104729) % 10009 / 10009.0
    return scored_ticks(spark, d).withColumns({"soft": s, "lof_score": lof_score})


SOFT_TICKS = f"{SCORED_TICKS}, soft AS (SELECT *, {SOFT} AS soft, (event_id * 104729) % 10009 / 10009.0::DOUBLE AS lof_score FROM scored)"


@query("score_threshold", "M3 T-5",
       f"""WITH {SOFT_TICKS}, c AS (SELECT market, quantile_cont(soft, 0.95) AS threshold FROM soft GROUP BY market)
       SELECT event_id, round(soft, 9) AS soft, round(threshold, 9) AS threshold, CAST(soft >= threshold AS INT) AS flagged FROM soft JOIN c USING (market)""")
def score_threshold(spark, d):
    out = metrics.flag_top(soft_ticks(spark, d), "soft", 0.05, by=["market"])
    return out.select("event_id", F.round("soft", 9).alias("soft"), F.round("threshold", 9).alias("threshold"), "flagged")


@query("contamination_sweep", "A22",
       f"""WITH {SOFT_TICKS}, c AS (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.25]) AS contamination),
       q AS (SELECT contamination, quantile_cont(soft, [0.98, 0.95, 0.9, 0.85, 0.75]) AS qs FROM soft, c GROUP BY contamination),
       k AS (SELECT contamination, qs[CASE contamination WHEN 0.02 THEN 1 WHEN 0.05 THEN 2 WHEN 0.1 THEN 3 WHEN 0.15 THEN 4 ELSE 5 END] AS cut FROM q)
       SELECT CAST(contamination AS DOUBLE) AS contamination, CAST(sum((soft >= cut)::INT) AS BIGINT) AS n_flagged,
        round(sum((soft >= cut)::INT) / count(*) * 100, 6) AS pct_flagged FROM soft, k GROUP BY contamination""")
def contamination_sweep(spark, d):
    out = metrics.contamination_sweep(soft_ticks(spark, d), "soft")
    return out.select("contamination", "n_flagged", F.round("pct_flagged", 6).alias("pct_flagged"))


FLAGGED = f"""{SOFT_TICKS}, cuts AS (SELECT quantile_cont(soft, 0.9) AS ca, quantile_cont(lof_score, 0.9) AS cb FROM soft),
  flagged AS (SELECT *, CAST(soft >= ca AS INT) AS if_flag, CAST(lof_score >= cb AS INT) AS lof_flag FROM soft, cuts)"""


def flagged_ticks(spark, d):
    x = soft_ticks(spark, d)
    cuts = o.quantiles(x, "soft", {"_a": 0.9}).crossJoin(F.broadcast(o.quantiles(x, "lof_score", {"_b": 0.9})))
    return x.crossJoin(F.broadcast(cuts)).withColumns({
        "if_flag": (F.col("soft") >= F.col("_a")).cast("int"), "lof_flag": (F.col("lof_score") >= F.col("_b")).cast("int")}).drop("_a", "_b")


@query("detector_agreement", "A12 M5 U2",
       f"""WITH {FLAGGED} SELECT count(*) FILTER (if_flag = 1 AND lof_flag = 1) AS "both", count(*) FILTER (if_flag = 1 AND lof_flag = 0) AS only_a,
        count(*) FILTER (if_flag = 0 AND lof_flag = 1) AS only_b, count(*) FILTER (if_flag + lof_flag > 0) AS "either" FROM flagged""")
def detector_agreement(spark, d):
    return metrics.agreement_counts(flagged_ticks(spark, d), "if_flag", "lof_flag")


@query("detector_crosstab", "A12 M5", f"WITH {FLAGGED} SELECT if_flag, lof_flag, count(*) AS n FROM flagged GROUP BY ALL")
def detector_crosstab(spark, d):
    return metrics.agreement_table(flagged_ticks(spark, d), "if_flag", "lof_flag")


@query("detector_sets", "U2", f"""WITH {FLAGGED} SELECT event_id, CASE WHEN if_flag + lof_flag = 2 THEN 'both' WHEN if_flag = 1 THEN 'only_a' ELSE 'only_b' END AS kind
        FROM flagged WHERE if_flag + lof_flag > 0""")
def detector_sets(spark, d):
    return metrics.detector_sets(flagged_ticks(spark, d), ["event_id"], "if_flag", "lof_flag")


def _distance(p):
    c = patterns.DOMAIN_PROTOTYPES[p]
    return "sqrt(" + " + ".join(f'pow(("{f}" - m_{f}) / nullif(d_{f}, 0) - {c.get(f, 0.0)}, 2)' for f in FEATURES) + ")"


WEAK = f"""{FLAGGED}, st AS (SELECT {', '.join(f'avg("{f}") AS m_{f}, stddev_samp("{f}") AS d_{f}' for f in FEATURES)} FROM flagged),
  dist AS (SELECT flagged.*, if_flag + lof_flag > 0 AS f, {', '.join(f'{_distance(p)} AS dist_{p}' for p in PATTERNS)} FROM flagged, st),
  near AS (SELECT *, least({', '.join(f'dist_{p}' for p in PATTERNS)}) AS least_d FROM dist),
  weak AS (SELECT *, CASE WHEN f THEN CASE least_d {' '.join(f"WHEN dist_{p} THEN '{p}'" for p in PATTERNS)} END END AS pattern,
    CASE WHEN f THEN 1 / ({' + '.join(f'exp(least_d - dist_{p})' for p in PATTERNS)}) ELSE 0 END AS attribution,
    CASE WHEN if_flag + lof_flag = 2 THEN 1.0::DOUBLE WHEN f THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS agreement FROM near)"""


def weak_ticks(spark, d):
    return patterns.weak_labels(flagged_ticks(spark, d))


@query("weak_labels", "M10 M11 J10 F10 F13 A37",
       f"""WITH {WEAK} SELECT event_id, pattern AS attributed_pattern, CAST(f AS INT) AS is_manipulation, round(attribution, 7) AS attribution_confidence,
        agreement AS detector_agreement, round(attribution * agreement, 7) AS label_confidence, round(CASE WHEN f THEN least_d ELSE 0 END, 6) AS centroid_distance,
        CASE WHEN f THEN concat_ws(',', CASE WHEN volume_ratio_20d > 1.5 THEN 'volume_spike' END, CASE WHEN volatility_20d > 0.8 THEN 'high_volatility' END,
          CASE WHEN abs("return") > 0.05 THEN 'large_return' END) ELSE '' END AS evidence FROM weak""")
def weak_labels(spark, d):
    w = weak_ticks(spark, d)
    return w.select("event_id", "attributed_pattern", "is_manipulation", F.round("attribution_confidence", 7).alias("attribution_confidence"),
                    "detector_agreement", F.round("label_confidence", 7).alias("label_confidence"),
                    F.round("centroid_distance", 6).alias("centroid_distance"), sc.evidence_names("evidence").alias("evidence"))


@query("weak_label_statistics", "A23 M12",
       f"""WITH {WEAK}, k AS (SELECT *, f AND attribution * agreement >= 0.4 AS kept FROM weak)
       SELECT count(*) AS n_rows, count(*) FILTER (f) AS n_flagged, count(*) FILTER (kept) AS n_kept, count(*) FILTER (f AND NOT kept) AS n_discarded,
        count(*) FILTER (agreement = 1) AS n_both, count(*) FILTER (agreement = 0.5) AS n_single,
        {', '.join(f"count(*) FILTER (kept AND pattern = '{p}') AS n_{p}" for p in PATTERNS)} FROM k""")
def weak_label_statistics(spark, d):
    return patterns.label_statistics(weak_ticks(spark, d))


TRUE_PATTERN = "CASE event_type WHEN 'click' THEN 'pump_and_dump' WHEN 'error' THEN 'wash_trading' WHEN 'purchase' THEN 'spoofing' WHEN 'signup' THEN 'layering' END"


def with_truth(df):
    true = t.mapped(F.col("event_type"), {"click": "pump_and_dump", "error": "wash_trading", "purchase": "spoofing", "signup": "layering"})
    return df.withColumn("true_pattern", true)


@query("attribution_confusion", "A13 M13",
       f"""WITH {WEAK}, x AS (SELECT {TRUE_PATTERN} AS true_pattern, pattern FROM weak WHERE f AND event_type <> 'view')
       SELECT true_pattern, {', '.join(f"count(*) FILTER (pattern = '{p}') AS {p}" for p in PATTERNS)} FROM x GROUP BY true_pattern""")
def attribution_confusion(spark, d):
    w = with_truth(weak_ticks(spark, d)).filter((F.col("is_manipulation") == 1) & F.col("true_pattern").isNotNull())
    return metrics.confusion_matrix(w, "true_pattern", "attributed_pattern", PATTERNS)


@query("detector_recall", "A14 M13",
       f"""WITH {FLAGGED} SELECT {TRUE_PATTERN} AS pattern, count(*) AS n_total, CAST(sum(if_flag) AS BIGINT) AS n_flagged, round(avg(if_flag), 9) AS detection_rate
        FROM flagged WHERE event_type <> 'view' GROUP BY 1""")
def detector_recall(spark, d):
    x = with_truth(flagged_ticks(spark, d))
    x = x.withColumns({f"is_{p}": (F.coalesce("true_pattern", F.lit("")) == p).cast("int") for p in PATTERNS})
    out = metrics.recall_by_pattern(x, {p: f"is_{p}" for p in PATTERNS}, "if_flag")
    return out.withColumn("detection_rate", F.round("detection_rate", 9))


@query("attribution_accuracy", "A15 M13",
       f"""WITH {WEAK}, x AS (SELECT {TRUE_PATTERN} AS true_pattern, pattern FROM weak WHERE f AND event_type <> 'view')
       SELECT count(*) AS n, round(avg((true_pattern = pattern)::INT), 9) AS accuracy FROM x""")
def attribution_accuracy(spark, d):
    out = metrics.attribution_accuracy(with_truth(weak_ticks(spark, d)), "true_pattern", "attributed_pattern", "is_manipulation")
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query("detection_under_one_threshold", "A21",
       f"""WITH {SOFT_TICKS}, h AS (SELECT list(soft ORDER BY soft) AS xs, (count(*) - 1) * (1 - avg((event_type IN ('click', 'error') AND volume > 80)::INT)) AS h FROM soft),
       c AS (SELECT xs[floor(h)::INT + 1] + (h - floor(h)) * (xs[ceil(h)::INT + 1] - xs[floor(h)::INT + 1]) AS cut FROM h),
       x AS (SELECT CASE WHEN volume > 80 AND event_type IN ('click', 'error') THEN {TRUE_PATTERN} ELSE 'normal' END AS pattern, soft FROM soft)
       SELECT pattern, count(*) AS n_total, CAST(sum((soft >= cut)::INT) AS BIGINT) AS n_flagged, round(avg((soft >= cut)::INT), 9) AS detection_rate
       FROM x, c WHERE pattern <> 'normal' GROUP BY pattern""")
def detection_under_one_threshold(spark, d):
    hot = (F.col("volume") > 80) & F.col("event_type").isin("click", "error")
    x = with_truth(soft_ticks(spark, d)).withColumn("pattern", F.when(hot, F.col("true_pattern")).otherwise("normal"))
    out = metrics.detection_under_one_threshold(x, "soft", "pattern")
    return out.withColumn("detection_rate", F.round("detection_rate", 9))


# Two 0/1 labels with document scores: rows with ties on purpose (scores in hundredths).
DOC_SCORES = """doc AS (SELECT l.doc_id, quality, toxic, n_chars, least(1, (n_chars % 97) / 97.0::DOUBLE * 0.7 + quality * 0.3) AS s1,
  round((n_chars % 13) / 13.0::DOUBLE, 2) AS s2 FROM labels l JOIN documents d USING (doc_id)),
  long AS (SELECT 'quality' AS pattern, s1 AS score, quality AS label FROM doc UNION ALL SELECT 'toxic', s2, toxic FROM doc)"""


def doc_scores(spark, d):
    x = t.read(spark, d, "labels").join(t.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    s1 = F.least(F.lit(1.0), F.col("n_chars") % 97 / 97.0 * 0.7 + F.col("quality") * 0.3)
    return x.withColumns({"s1": s1, "s2": F.round(F.col("n_chars") % 13 / 13.0, 2)})


def long_docs(spark, d):
    return metrics.long_scores(doc_scores(spark, d), {"quality": ("s1", "quality"), "toxic": ("s2", "toxic")})


AUC_SQL = """r AS (SELECT *, rank() OVER (PARTITION BY pattern ORDER BY score) + (count(*) OVER (PARTITION BY pattern, score) - 1) / 2.0 AS mid FROM long),
  auc AS (SELECT pattern, CAST(sum(label) AS BIGINT) AS n_positive, CAST(count(*) - sum(label) AS BIGINT) AS n_negative,
   (sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY pattern)"""


@query("roc_auc", "A17", f"WITH {DOC_SCORES}, {AUC_SQL} SELECT pattern, n_positive, n_negative, round(auc, 9) AS auc FROM auc")
def roc_auc(spark, d):
    return metrics.auc(long_docs(spark, d), ["pattern"]).withColumn("auc", F.round("auc", 9))


RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"""


@query("pattern_evaluation", "A16 M9",
       f"""WITH {DOC_SCORES}, {AUC_SQL}, c AS (SELECT pattern, sum((score >= 0.5 AND label = 1)::INT) AS tp, sum((score >= 0.5 AND label = 0)::INT) AS fp,
         sum((score < 0.5 AND label = 1)::INT) AS fn FROM long GROUP BY pattern)
       SELECT pattern, n_positive, round(auc, 9) AS auc, {RATES} FROM c JOIN auc USING (pattern)""")
def pattern_evaluation(spark, d):
    out = metrics.evaluate(long_docs(spark, d))
    return out.select("pattern", "n_positive", *[F.round(c, 9).alias(c) for c in ("auc", "precision", "recall", "f1")])


SWEEP_SQL = """sums AS (SELECT pattern, t AS threshold, sum((score >= t AND label = 1)::INT) AS tp, sum((score >= t AND label = 0)::INT) AS fp,
  sum((score < t AND label = 1)::INT) AS fn FROM long, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) GROUP BY pattern, t)"""


@query("threshold_sweep", "A18", f"WITH {DOC_SCORES}, {SWEEP_SQL} SELECT pattern, threshold, {RATES} FROM sums")
def threshold_sweep(spark, d):
    out = metrics.threshold_sweep(long_docs(spark, d), ["pattern"])
    return out.select("pattern", "threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("best_threshold", "A19 A39",
       f"""WITH {DOC_SCORES}, {SWEEP_SQL}, s AS (SELECT pattern, threshold, {RATES} FROM sums),
       r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY f1 DESC, threshold) AS k FROM s)
       SELECT pattern, threshold, f1, precision, recall FROM r WHERE k = 1""")
def best_threshold(spark, d):
    sweep = metrics.threshold_sweep(long_docs(spark, d), ["pattern"])
    sweep = sweep.select("pattern", "threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
    return metrics.best_threshold(sweep, ["pattern"])


@query("blended_comparison", "A39 M9",
       f"""WITH {DOC_SCORES.replace('long AS', 'unused AS')}, long AS (SELECT 'quality|own' AS pattern, s1 AS score, quality AS label FROM doc UNION ALL
         SELECT 'toxic|own', s2, toxic FROM doc UNION ALL SELECT 'quality|blended', (s1 + s2) / 2, quality FROM doc UNION ALL SELECT 'toxic|blended', (s1 + s2) / 2, toxic FROM doc),
       {AUC_SQL}, {SWEEP_SQL}, s AS (SELECT pattern, threshold, {RATES} FROM sums),
       best AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY f1 DESC, threshold) AS k FROM s)
       SELECT split_part(pattern, '|', 1) AS pattern, split_part(pattern, '|', 2) AS model, n_positive, round(auc, 9) AS auc, threshold, f1, precision, recall
       FROM best JOIN auc USING (pattern) WHERE k = 1""")
def blended_comparison(spark, d):
    x = doc_scores(spark, d).withColumn("mixed", (F.col("s1") + F.col("s2")) / 2)
    out = metrics.compare_with_blended(x, {"quality": ("s1", "quality"), "toxic": ("s2", "toxic")}, "mixed")
    return out.select("pattern", "model", "n_positive", "threshold", *[F.round(c, 9).alias(c) for c in ("auc", "f1", "precision", "recall")])


@query("calibration_curve", "A20 M25",
       f"""WITH {DOC_SCORES} SELECT pattern, CAST(greatest(ceil(score * 5) - 1, 0) AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_predicted,
        round(avg(label), 9) AS fraction_positive FROM long GROUP BY 1, 2""")
def calibration_curve(spark, d):
    out = metrics.calibration(long_docs(spark, d), ["pattern"])
    return out.select("pattern", "bin", "n", F.round("mean_predicted", 9).alias("mean_predicted"), F.round("fraction_positive", 9).alias("fraction_positive"))


@query("auc_lost", "J14 M13",
       f"""WITH {DOC_SCORES}, {AUC_SQL}, t AS (SELECT pattern, auc FROM auc), w AS (SELECT pattern, auc * 0.9 AS auc FROM auc WHERE pattern = 'quality')
       SELECT pattern, round(t.auc, 9) AS auc_true, round(coalesce(w.auc, 0.5), 9) AS auc_weak, round(t.auc - coalesce(w.auc, 0.5), 9) AS auc_lost
       FROM t FULL JOIN w USING (pattern)""")
def auc_lost(spark, d):
    a = metrics.auc(long_docs(spark, d), ["pattern"])
    out = metrics.auc_lost(a, a.filter("pattern = 'quality'").withColumn("auc", F.col("auc") * 0.9))
    return out.select("pattern", *[F.round(c, 9).alias(c) for c in ("auc_true", "auc_weak", "auc_lost")])


GAIN_SQL = """d AS (SELECT quality AS y, n_chars::DOUBLE AS n_chars, (n_chars % 97)::DOUBLE AS rest FROM labels JOIN documents USING (doc_id)),
       l AS (SELECT 'n_chars' AS feature, n_chars AS v, y FROM d UNION ALL SELECT 'rest', rest, y FROM d),
       c AS (SELECT feature, v, count(*) AS n, sum(y) AS p FROM l GROUP BY 1, 2),
       k AS (SELECT feature, v, sum(n) OVER w AS nl, sum(p) OVER w AS pl, sum(n) OVER f AS n, sum(p) OVER f AS p FROM c
         WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)),
       e AS (SELECT *, n - nl AS nr, p - pl AS pr FROM k WHERE n > nl),
       h AS (SELECT *, p / n AS a, pl / nl AS b, pr / nr AS c FROM e),
       g AS (SELECT feature, v, round(
         (CASE WHEN a IN (0, 1) THEN 0 ELSE -a * log2(a) - (1 - a) * log2(1 - a) END)
         - nl / n * (CASE WHEN b IN (0, 1) THEN 0 ELSE -b * log2(b) - (1 - b) * log2(1 - b) END)
         - nr / n * (CASE WHEN c IN (0, 1) THEN 0 ELSE -c * log2(c) - (1 - c) * log2(1 - c) END), 12) AS gain FROM h),
       r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, v) AS i FROM g)"""


@query("information_gain", "A32", f"WITH {GAIN_SQL} SELECT feature, v AS split, round(gain, 9) AS gain FROM r WHERE i = 1")
def information_gain(spark, d):
    x = doc_scores(spark, d).withColumn("rest", F.col("n_chars") % 97)
    return metrics.best_split(x, ["n_chars", "rest"], "quality").withColumn("gain", F.round("gain", 9))


@query("overall_best_split", "A32 M16",
       f"WITH {GAIN_SQL} SELECT feature, v AS split, round(gain, 9) AS gain FROM r WHERE i = 1 ORDER BY r.gain DESC, feature <> 'n_chars' LIMIT 1")
def overall_best_split(spark, d):
    x = doc_scores(spark, d).withColumn("rest", F.col("n_chars") % 97)
    return metrics.best_overall_split(x, ["n_chars", "rest"], "quality").withColumn("gain", F.round("gain", 9))


@query("anova_f", "A33 T-7",
       """WITH d AS (SELECT quality AS y, n_chars::DOUBLE AS n_chars, (n_chars % 97)::DOUBLE AS rest FROM labels JOIN documents USING (doc_id)),
       l AS (SELECT 'n_chars' AS feature, n_chars AS v, y FROM d UNION ALL SELECT 'rest', rest, y FROM d),
       g AS (SELECT feature, avg(v) AS m FROM l GROUP BY 1), c AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY 1, 2)
       SELECT feature, round((sum(n * pow(c.m - g.m, 2)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f_statistic FROM c JOIN g USING (feature) GROUP BY feature""")
def anova_f(spark, d):
    x = doc_scores(spark, d).withColumn("rest", (F.col("n_chars") % 97).cast("double")).withColumn("n_chars", F.col("n_chars").cast("double"))
    return metrics.ranked(metrics.anova_f(x, ["n_chars", "rest"], "quality").withColumn("f_statistic", F.round("f_statistic", 6)), "f_statistic")


def _mi(label):
    return f"""SELECT feature, sum(c / t * ln(c * t / (cb * cy))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature, b) AS cb,
      sum(c) OVER (PARTITION BY feature, y) AS cy, sum(c) OVER (PARTITION BY feature) AS t FROM (SELECT feature, b, {label} AS y, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2, 3)) GROUP BY feature"""


MI_BASE = """d AS (SELECT doc_id, quality, toxic, greatest(quality, toxic) AS blended, n_chars::DOUBLE AS n_chars, (n_chars % 97)::DOUBLE AS rest FROM labels JOIN documents USING (doc_id)),
  l AS (SELECT 'n_chars' AS feature, n_chars AS v, * FROM d UNION ALL SELECT 'rest', rest, * FROM d),
  b AS (SELECT *, CAST(floor((rank() OVER (PARTITION BY feature ORDER BY v) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS INT) AS b FROM l)"""


@query("mutual_information", "A34 A35",
       f"""WITH {MI_BASE}, p AS ({_mi('quality')}), m AS ({_mi('blended')})
       SELECT feature, round(p.mi, 9) AS mi_pattern, round(m.mi, 9) AS mi_blended, round((p.mi - m.mi) / p.mi * 100, 6) AS pct_lost FROM p JOIN m USING (feature)""")
def mutual_information(spark, d):
    x = doc_scores(spark, d).withColumns({"rest": F.col("n_chars") % 97, "blended": F.greatest("quality", "toxic")})
    out = metrics.information_lost(x, ["n_chars", "rest"], "quality", "blended")
    return out.select("feature", F.round("mi_pattern", 9).alias("mi_pattern"), F.round("mi_blended", 9).alias("mi_blended"), F.round("pct_lost", 6).alias("pct_lost"))


LOF_SQL = """p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
  pairs AS (SELECT a.id, b.id AS nb, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.id <> b.id),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rk FROM pairs) WHERE rk <= 20),
  kd AS (SELECT id, max(d) AS kd FROM k GROUP BY id),
  lrd AS (SELECT k.id, 1 / (avg(greatest(k.d, kd.kd)) + 1e-10) AS lrd FROM k JOIN kd ON kd.id = k.nb GROUP BY k.id),
  lof AS (SELECT k.id AS vec_id, avg(n.lrd) / any_value(l.lrd) AS lof FROM k JOIN lrd n ON n.id = k.nb JOIN lrd l ON l.id = k.id GROUP BY k.id)"""


@query("nearest_neighbours", "J11", f"WITH {LOF_SQL} SELECT id AS vec_id, rk AS rank, nb AS neighbour, round(d, 7) AS distance FROM k")
def nearest_neighbours(spark, d):
    out = lof.knn(t.read(spark, d, "embeddings"), "vec_id", "embedding", 20)
    return out.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("distance", 7).alias("distance"))


@query("local_outlier_factor", "M4",
       f"""WITH {LOF_SQL}, m AS (SELECT min(lof) AS lo, max(lof) AS hi FROM lof), s AS (SELECT vec_id, lof, (lof - lo) / (hi - lo) AS lof_score FROM lof, m),
       c AS (SELECT quantile_cont(lof_score, 0.95) AS cut FROM s)
       SELECT vec_id, round(lof, 7) AS lof, round(lof_score, 7) AS lof_score, CAST(lof_score >= cut AS INT) AS lof_flag FROM s, c""")
def local_outlier_factor(spark, d):
    out = lof.fit_flag(t.read(spark, d, "embeddings"), "vec_id", "embedding", 20, 0.05)
    return out.select("vec_id", F.round("lof", 7).alias("lof"), F.round("lof_score", 7).alias("lof_score"), "lof_flag")
