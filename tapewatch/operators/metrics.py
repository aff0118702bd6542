"""Detector metrics as grouped sums: AUC, sweeps, calibration, agreement, information gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators import ordered as o


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b.cast("double"), F.lit(0.0)))


def long_scores(df: DataFrame, pairs: dict[str, tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, pattern) with its score and 0/1 label; ``pairs`` maps a pattern to both columns."""
    cells = [F.struct(F.lit(p).alias("pattern"), F.col(s).cast("double").alias("score"), F.col(l).cast("int").alias("label"))
             for p, (s, l) in pairs.items()]
    return df.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")


def auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC per group; ties count half; null without both classes.

    Rows are first counted per distinct score, so the ordered pass sees distinct scores only.
    """
    by = list(by)
    per = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))
    run = o.cumulative_by_value(per, by, score, ["p", "n"])
    wins = F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2))
    return run.groupBy(*by).agg(
        F.max("p_total").alias("n_positive"), F.max("n_total").alias("n_negative"),
        _ratio(wins, F.max(F.col("p_total").cast("double") * F.col("n_total"))).alias("auc"))


def _confusion(flag: Column, label: Column) -> dict[str, Column]:
    return {"tp": F.sum((flag & (label == 1)).cast("bigint")), "fp": F.sum((flag & (label == 0)).cast("bigint")),
            "fn": F.sum((~flag & (label == 1)).cast("bigint"))}


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Zero where undefined."""
    zero = F.lit(0.0)
    return {"precision": F.coalesce(_ratio(tp, tp + fp), zero), "recall": F.coalesce(_ratio(tp, tp + fn), zero),
            "f1": F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), zero)}


def evaluate(df: DataFrame, by: Sequence[str] = ("pattern",), threshold: float | Column = 0.5) -> DataFrame:
    """n_positive, AUC, precision, recall and F1 per group of (score, label) rows."""
    by = list(by)
    c = _confusion(F.col("score") >= threshold, F.col("label"))
    sums = df.groupBy(*by).agg(*[x.alias(k) for k, x in c.items()])
    rates = sums.select(*by, *[x.alias(k) for k, x in precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    return auc(df, by).select(*by, "n_positive", "auc").join(rates, by)


SWEEP = [round(0.1 * i, 1) for i in range(1, 10)]


def threshold_sweep(df: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Precision, recall and F1 at every threshold from one scan: a row falls in the last threshold it reaches."""
    by = list(by)
    reached = sum((F.col("score") >= F.lit(t)).cast("int") for t in thresholds)
    hist = df.groupBy(*by, reached.alias("_k")).agg(F.sum(F.col("label").cast("bigint")).alias("_p"),
                                                  F.sum(1 - F.col("label").cast("bigint")).alias("_n"))
    steps = hist.select(*by, "_k", "_p", "_n", F.posexplode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("_i", "threshold"))
    hit = F.col("_k") > F.col("_i")
    sums = steps.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_p")).otherwise(0)).alias("fn"))
    return sums.select(*by, "threshold", *[x.alias(k) for k, x in precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1, the first one on a tie."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("_t"), "precision", "recall")).alias("_b")
    return sweep.groupBy(*by).agg(best).select(*by, (-F.col("_b._t")).alias("threshold"), "_b.f1", "_b.precision", "_b.recall")


def calibration(df: DataFrame, by: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """Mean predicted and observed rate per uniform bin; an edge value belongs to the lower bin."""
    p = F.col("score")
    b = F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_predicted"),
                                             F.avg(F.col("label").cast("double")).alias("fraction_positive"))


def agreement_table(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b)).agg(F.count(F.lit(1)).alias("n"))


def agreement_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a).cast("int") == 1, F.col(b).cast("int") == 1
    return df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"),
                  F.count_if(x | y).alias("either"))


def detector_sets(df: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Keys flagged by either detector with the set they belong to."""
    x, y = F.col(a).cast("int") == 1, F.col(b).cast("int") == 1
    kind = F.when(x & y, "both").when(x, "only_a").when(y, "only_b")
    return df.select(*key, kind.alias("kind")).filter(F.col("kind").isNotNull())


def confusion_matrix(df: DataFrame, true: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Rows = true pattern, one count column per predicted pattern in the given order."""
    out = df.groupBy(F.col(true).alias("true_pattern")).pivot(predicted, list(labels)).agg(F.count(F.lit(1)))
    return out.na.fill(0)


def recall_by_pattern(df: DataFrame, labels: dict[str, str], flag: str) -> DataFrame:
    """Share of true rows of each pattern that the detector flagged."""
    cells = [F.struct(F.lit(p).alias("pattern"), F.col(c).cast("int").alias("y")) for p, c in labels.items()]
    long = df.select(flag, F.explode(F.array(*cells)).alias("_c")).filter(F.col("_c.y") == 1)
    return long.groupBy(F.col("_c.pattern").alias("pattern")).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col(flag).cast("bigint")).alias("n_flagged"),
        F.avg(F.col(flag).cast("double")).alias("detection_rate"))


def attribution_accuracy(df: DataFrame, true: str, predicted: str, flag: str) -> DataFrame:
    """On rows with a true pattern that were flagged: share attributed to that pattern."""
    hit = F.col(true).isNotNull() & (F.col(flag).cast("int") == 1)
    return df.filter(hit).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))


def auc_lost(true_auc: DataFrame, weak_auc: DataFrame) -> DataFrame:
    """AUC with true labels against AUC with weak labels; a pattern without weak labels counts as .5."""
    t = true_auc.select("pattern", F.col("auc").alias("auc_true"))
    w = weak_auc.select("pattern", F.col("auc").alias("auc_weak"))
    j = t.join(w, "pattern", "full").withColumn("auc_weak", F.coalesce("auc_weak", F.lit(0.5)))
    return j.withColumn("auc_lost", F.col("auc_true") - F.col("auc_weak"))


def compare_with_blended(df: DataFrame, own: dict[str, tuple[str, str]], blended: str) -> DataFrame:
    """Per pattern: AUC and recall at its own best threshold, own score against the blended score."""
    both = {f"{p}|own": v for p, v in own.items()} | {f"{p}|blended": (blended, l) for p, (_, l) in own.items()}
    rows = long_scores(df, both).withColumns({"model": F.element_at(F.split("pattern", r"\|"), 2),
                                              "pattern": F.element_at(F.split("pattern", r"\|"), 1)})
    keys = ["pattern", "model"]
    best = best_threshold(threshold_sweep(rows, keys), keys)
    return auc(rows, keys).select(*keys, "n_positive", "auc").join(best, keys)


def contamination_sweep(df: DataFrame, score: str, rates: Sequence[float] = (0.02, 0.05, 0.1, 0.15, 0.25)) -> DataFrame:
    """Rows at or above the (1 − rate) quantile of the score, for every rate."""
    cuts = o.quantiles(df, score, {f"q{i}": 1 - c for i, c in enumerate(rates)})
    cells = [F.struct(F.lit(float(c)).alias("contamination"), F.col(f"q{i}").alias("cut")) for i, c in enumerate(rates)]
    flags = df.crossJoin(F.broadcast(cuts)).agg(F.count(score).alias("_n"), *[
        F.sum((F.col(score) >= F.col(f"q{i}")).cast("bigint")).alias(f"_f{i}") for i in range(len(rates))])
    cells = [F.struct(F.lit(float(c)).alias("contamination"), F.col(f"_f{i}").alias("n_flagged"),
                      (F.col(f"_f{i}") / F.col("_n") * 100).alias("pct_flagged")) for i, c in enumerate(rates)]
    return flags.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def flag_top(df: DataFrame, score: str, contamination: float | str, by: Sequence[str] = (), out: str = "flagged") -> DataFrame:
    """Adds the threshold and the 0/1 flag. 'auto' and 'per_market' mean the fixed .5 of the reference."""
    if isinstance(contamination, str):
        if contamination not in ("auto", "per_market"):
            raise ValueError(contamination)
        return df.withColumn("threshold", F.lit(0.5)).withColumn(out, (F.col(score) >= 0.5).cast("int"))
    cut = o.quantiles(df, score, {"threshold": 1 - contamination}, by)
    joined = df.join(cut, list(by)) if by else df.crossJoin(F.broadcast(cut))
    return joined.withColumn(out, (F.col(score) >= F.col("threshold")).cast("int"))


def detection_under_one_threshold(df: DataFrame, score: str, pattern: str, normal: str = "normal") -> DataFrame:
    """One threshold at the true combined rate, then the detection rate of each pattern, rarest first."""
    anomalous = (F.col(pattern) != normal).cast("double")
    rate = df.agg(F.avg(anomalous).alias("r")).first().r
    flagged = flag_top(df, score, float(rate)).filter(F.col(pattern) != normal)
    return flagged.groupBy(F.col(pattern).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum("flagged").alias("n_flagged"), F.avg("flagged").alias("detection_rate")
    ).orderBy("n_total")


def entropy(p: Column) -> Column:
    """Bits of a 0/1 label with positive share p."""
    def part(x):
        return F.when(x > 0, -x * F.log2(F.nullif(x, F.lit(0.0)))).otherwise(0.0)
    return part(p) + part(1 - p)


def best_split(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Information gain of every split value ≤ t | > t per feature; the largest gain of each feature."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    long = df.select(F.col(label).cast("bigint").alias("_y"), F.explode(F.array(*cells)).alias("_c")).select("_y", "_c.*")
    per = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"))
    run = o.cumulative_by_value(per, ["feature"], "value", ["n", "p"])
    nl, pl = F.col("n_before") + F.col("n"), F.col("p_before") + F.col("p")
    nr, pr = F.col("n_total") - nl, F.col("p_total") - pl
    weighted = nl / F.col("n_total") * entropy(pl / nl) + nr / F.col("n_total") * entropy(_ratio(pr, nr))
    gain = entropy(F.col("p_total") / F.col("n_total")) - weighted
    splits = run.filter(nr > 0).select("feature", "value", F.round(gain, 12).alias("gain"))
    best = F.max(F.struct("gain", (-F.col("value")).alias("_v"))).alias("_b")
    return splits.groupBy("feature").agg(best).select("feature", (-F.col("_b._v")).alias("split"), F.col("_b.gain").alias("gain"))


def best_overall_split(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The split with the largest gain of all features; on a tie the feature that is listed first, then the smaller value."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return best_split(df, features, label).orderBy(F.col("gain").desc(), place, "split").limit(1)


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way F statistic per feature from one grouped pass over centred values."""
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    c = df.crossJoin(F.broadcast(means)).select(label, *[(F.col(f) - F.col(f"_m_{f}")).alias(f) for f in features])
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features]
    long = c.select(label, F.explode(F.array(*cells)).alias("_c")).select(label, "_c.*").filter(F.col("x").isNotNull())
    per = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    tot = per.groupBy("feature").agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"),
                                     F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                                     F.sum(F.col("n") * F.col("m")).alias("s"))
    between = (F.col("between") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    return tot.select("feature", _ratio(between, F.col("within") / (F.col("n") - F.col("k"))).alias("f_statistic"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Quantile-binned mutual information in nats (the reference uses a nearest-neighbour estimator)."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*cells)).alias("_c")).select("y", "_c.*")
    per = long.filter(F.col("value").isNotNull()).groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("c"))
    value_n = per.groupBy("feature", "value").agg(F.sum("c").alias("n"))
    ranked = o.cumulative_by_value(value_n, ["feature"], "value", ["n"])
    b = F.floor(F.col("n_before") * bins / F.col("n_total")).cast("int")
    joint = per.join(ranked.select("feature", "value", b.alias("b"), "n_total"), ["feature", "value"]).groupBy(
        "feature", "b", "y").agg(F.sum("c").alias("c"), F.max("n_total").alias("t"))
    wb, wy = Window.partitionBy("feature", "b"), Window.partitionBy("feature", "y")
    joint = joint.withColumns({"cb": F.sum("c").over(wb), "cy": F.sum("c").over(wy)})
    term = F.col("c") / F.col("t") * F.ln(F.col("c") * F.col("t") / (F.col("cb") * F.col("cy")))
    return joint.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def information_lost(df: DataFrame, features: Sequence[str], pattern_label: str, blended_label: str) -> DataFrame:
    """MI with the pattern's own label against MI with the blended label, and the loss in percent."""
    a = mutual_information(df, features, pattern_label).withColumnRenamed("mi", "mi_pattern")
    b = mutual_information(df, features, blended_label).withColumnRenamed("mi", "mi_blended")
    loss = F.when(F.col("mi_pattern") > 0, (F.col("mi_pattern") - F.col("mi_blended")) / F.nullif("mi_pattern", F.lit(0.0)) * 100)
    return a.join(b, "feature").withColumn("pct_lost", loss)


def scale(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """standard (population std), min_max or robust (IQR); a column without spread is an error."""
    names = {c: f"{c}_{kind}" for c in columns}
    if kind == "standard":
        stats = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_b_{c}"))])
    elif kind == "min_max":
        stats = df.agg(*[e for c in columns for e in (F.min(c).alias(f"_a_{c}"), (F.max(c) - F.min(c)).alias(f"_b_{c}"))])
    elif kind == "robust":
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
        q = o.quantiles(df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*"), "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["column"])
        stats = q.agg(*[e for c in columns for e in (F.max(F.when(F.col("column") == c, F.col("q2"))).alias(f"_a_{c}"),
                                                     F.max(F.when(F.col("column") == c, F.col("q3") - F.col("q1"))).alias(f"_b_{c}"))])
    else:
        raise ValueError(kind)
    spread = F.when(F.col("_s") == 0, F.raise_error(F.lit("column without spread"))).otherwise(F.col("_s"))
    joined = df.crossJoin(F.broadcast(stats))
    for c, n in names.items():
        joined = joined.withColumn("_s", F.col(f"_b_{c}")).withColumn(n, (F.col(c) - F.col(f"_a_{c}")) / spread)
    return joined.select(*df.columns, *names.values())


def forecast_errors(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "forecast") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def ranked(rows: DataFrame, by: str, descending: bool = True, top: int | None = None, absolute: bool = False) -> DataFrame:
    """Result rows in rank order: importances, coefficients, AUC, AIC, silhouette."""
    key = F.abs(F.col(by)) if absolute else F.col(by)
    out = rows.orderBy(key.desc() if descending else key.asc())
    return out.limit(top) if top else out
