"""Read-side questions of the investigation desk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.functions import scoring as sc
from tapewatch.functions import text as tx
from tapewatch.operators import ordered as o
from tapewatch.session import cut

SYSTEM_USER = 0
CLOSED = ("CLOSED", "DISMISSED")
# Allowed case transitions.
TRANSITIONS = {
    "OPEN": ["IN_REVIEW", "DISMISSED", "CLOSED"],
    "IN_REVIEW": ["ESCALATED", "DISMISSED", "CLOSED", "OPEN"],
    "ESCALATED": ["IN_REVIEW", "DISMISSED", "CLOSED"],
    "DISMISSED": ["OPEN"],
    "CLOSED": ["OPEN"],
}


# --- filters and pages -------------------------------------------------------

def scan_bars(bars: DataFrame, *, me: int | None = None, symbol: str | None = None, start=None, end=None) -> DataFrame:
    if me is not None:
        bars = visible_rows(bars, me)
    if symbol is not None:
        bars = bars.filter(F.col("symbol") == symbol.upper().strip())
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        bars = bars.filter(F.col("ts") <= F.lit(end))
    return bars


def visible_rows(df: DataFrame, me: int, system: int = SYSTEM_USER) -> DataFrame:
    return df.filter(F.col("user_id").isin(me, system))


def filter_anomalies(df: DataFrame, *, symbol: str | None = None, flagged: bool | None = None,
                     signal: str | None = None) -> DataFrame:
    if symbol:
        df = df.filter(F.col("symbol") == symbol.upper())
    if flagged is not None:
        df = df.filter(F.col("is_anomaly") == flagged)
    if signal:
        df = df.filter(F.col("primary_signal") == signal)
    return df


def visible_cases(cases: DataFrame, me: int, role: str) -> DataFrame:
    """Admins and analysts see every case, others those they created or hold."""
    if role in ("admin", "analyst"):
        return cases
    return cases.filter((F.col("created_by") == me) | (F.col("assigned_to") == me))


def visible_alerts(alerts: DataFrame, me: int, role: str) -> DataFrame:
    return alerts if role == "admin" else alerts.filter(F.col("user_id") == me)


def at_least_severity(df: DataFrame, floor: str) -> DataFrame:
    return df.filter(sc.severity_rank("severity") >= sc.SEVERITY_RANK[floor])


def open_cases(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("status").isin(*CLOSED))


def closed_cases(cases: DataFrame, q: str = "") -> DataFrame:
    hit = tx.contains_ci("title", q) | (F.col("case_id").cast("string") == q)
    return cases.filter(F.col("status").isin(*CLOSED) & hit)


def last_day(df: DataFrame, on: str, as_of: Column) -> DataFrame:
    return df.filter((F.col(on) >= as_of - F.expr("INTERVAL 24 HOURS")) & (F.col(on) <= as_of))


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


# --- joins -------------------------------------------------------------------

def with_bars(anomalies: DataFrame, bars: DataFrame) -> DataFrame:
    return anomalies.join(bars, "market_data_id")


def case_evidence(cases: DataFrame, links: DataFrame, anomalies: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per linked anomaly with its bar and its place in the case's timeline.

    Links meet anomalies and bars while they are narrow; the case's own columns come last, with the rows already dealt by case.
    """
    known = anomalies.join(bars.select("market_data_id", F.col("ts").alias("bar_ts"), "close", "volume"), "market_data_id")
    rows = links.join(known, "anomaly_id").join(cases, "case_id")
    first = ["market_data_id", "anomaly_id", "case_id"]
    named = [c for df in (links, cases, anomalies) for c in df.columns if c not in first]
    rows = rows.select(*first, *named, "bar_ts", "close", "volume")
    return o.numbered(rows, ["case_id"], ["bar_ts", "anomaly_id"], out="step")


def restrict_to_watchlist(alerts: DataFrame, lists: DataFrame, symbols: DataFrame, user: int) -> DataFrame:
    """Alerts on symbols of the user's watchlists; nothing when the user watches nothing."""
    return alerts.join(watched_symbols(lists, symbols, user), "symbol", "left_semi")


def watched_symbols(lists: DataFrame, symbols: DataFrame, user: int) -> DataFrame:
    mine = lists.filter(F.col("owner_id") == user).select("watchlist_id")
    return symbols.join(mine, "watchlist_id", "left_semi").select("symbol").distinct()


def cases_with_note(cases: DataFrame, notes: DataFrame, q: str) -> DataFrame:
    return cases.join(notes.filter(tx.contains_ci("body", q)), "case_id", "left_semi")


def with_assignee(cases: DataFrame, users: DataFrame, default: str) -> DataFrame:
    named = users.select(F.col("user_id").alias("assigned_to"), "username")
    name = F.when(F.col("assigned_to").isNull(), default).otherwise(
        F.coalesce("username", F.concat(F.lit("User "), F.col("assigned_to").cast("string"))))
    return cases.join(named, "assigned_to", "left").withColumn("assignee", name).drop("username")


def related(anomalies: DataFrame, n: int = 5) -> DataFrame:
    """Per anomaly, the newest ``n`` others of its symbol. The joined side holds n + 1 ids per symbol."""
    last = o.newest(anomalies.select("symbol", "detected_at", "anomaly_id"), ["symbol"], ["detected_at", "anomaly_id"],
                    n + 1, rank="_r")
    top = last.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_r", "anomaly_id"))).alias("_top"))
    others = F.filter(F.transform("_top", lambda x: x["anomaly_id"]), lambda i: i != F.col("anomaly_id"))
    return anomalies.join(top, "symbol").withColumn("related", F.slice(others, 1, n)).drop("_top")


def correlated(links: DataFrame, anomalies: DataFrame, n: int = 5) -> DataFrame:
    """Per case, the newest ``n`` anomalies with the signal of its first anomaly that are not in the case.

    Anomalies are ranked per signal. If r_1 < r_2 < … are the ranks a case already holds, its k-th free
    rank is k plus the number of held ranks with r_i − i < k, so n counts per case give the answer and
    the candidates are read by (signal, rank).
    """
    a = anomalies.select("anomaly_id", "primary_signal", (-F.unix_micros("detected_at")).alias("_age"))
    ranked = cut(o.numbered(a, ["primary_signal"], ["_age", "anomaly_id"], out="_rank").drop("_age"), "ranked")
    known = cut(links.join(ranked, "anomaly_id"), "known")
    first = known.groupBy("case_id").agg(F.min_by("primary_signal", "anomaly_id").alias("primary_signal"))
    held = known.join(first, ["case_id", "primary_signal"])
    held = o.numbered(held, ["case_id"], ["_rank"], out="_i")
    slack = F.col("_rank") - F.col("_i")
    counts = held.groupBy("case_id", "primary_signal").agg(*[
        F.count(F.when(slack < k, 1)).alias(f"_k{k}") for k in range(1, n + 1)])
    wanted = counts.select("case_id", "primary_signal", F.posexplode(F.array(*[
        F.col(f"_k{k}") + k for k in range(1, n + 1)])).alias("place", "_rank"))
    return wanted.join(ranked, ["primary_signal", "_rank"]).select(
        "case_id", "primary_signal", (F.col("place") + 1).alias("place"), "anomaly_id")


# --- aggregates --------------------------------------------------------------

def flag_rate(df: DataFrame, by: Sequence[str] = ("market", "symbol"), flag: str = "flagged", score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(flag).cast("double")).alias("flag_rate"),
                               F.avg(score).alias("mean_score"))


def deviating(df: DataFrame, factor: float = 2.0, min_rows: int = 30, flag: str = "flagged", score: str = "score") -> DataFrame:
    """Symbols with enough rows whose rate is ``factor`` times the market's or less than 1/``factor`` of it."""
    per_symbol = flag_rate(df, flag=flag, score=score)
    market = df.groupBy("market").agg(F.avg(F.col(flag).cast("double")).alias("market_rate"))
    rate, base = F.col("flag_rate"), F.col("market_rate")
    return per_symbol.join(market, "market").filter(
        (F.col("n_rows") >= min_rows) & ((rate >= base * factor) | (rate <= base / factor)))


def counts(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def watchlist_sizes(lists: DataFrame, symbols: DataFrame) -> DataFrame:
    n = symbols.groupBy("watchlist_id").agg(F.count("symbol").alias("n_symbols"))
    return lists.join(n, "watchlist_id", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int], newest: int = 1000,
                 order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Nearest-rank percentiles over the newest ``newest`` rows of each group."""
    last = o.newest(df, by, order, newest)
    w = Window.partitionBy(*by)
    ranked = last.withColumns({"_k": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *[
        F.max(F.when(F.col("_k") == F.greatest(F.lit(1), F.floor(F.col("_n") * p / 100)), F.col(value))).alias(f"p{p}")
        for p in percents])


def case_risk(links: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Roll-up risk and headline severity per case with known anomalies."""
    rows = links.join(anomalies, "anomaly_id")
    per = rows.groupBy("case_id").agg(
        F.max(sc.case_risk_rank("severity", "anomaly_score")).alias("_rank"),
        F.max("anomaly_score").alias("max_score"), F.count(F.lit(1)).alias("n_anomalies"))
    return per.select("case_id", "n_anomalies", "max_score", sc.rank_label("_rank").alias("risk"),
                      sc.case_headline_severity("max_score").alias("headline_severity"))


def volume_surge(points: DataFrame, bars: DataFrame, by: Sequence[str] = ("symbol",), on: str = "ts") -> DataFrame:
    """Volume of the bar nearest in time over the symbol's mean volume."""
    from tapewatch.operators.joins import nearest_bar

    means = bars.groupBy(*by).agg(F.avg("volume").alias("mean_volume"))
    near = nearest_bar(points, bars, by, on, "volume", "near_volume").join(means, list(by))
    surge = F.when(F.col("mean_volume") > 0, F.round(F.col("near_volume") / F.nullif("mean_volume", F.lit(0.0)), 1))
    return near.withColumn("surge", surge.otherwise(1.0))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint: row count and sum of 64-bit row hashes."""
    h = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("fingerprint"))


# --- cases -------------------------------------------------------------------

def transitions(spark: SparkSession) -> DataFrame:
    pairs = [(a, b) for a, targets in TRANSITIONS.items() for b in targets]
    return spark.createDataFrame(pairs, "from_status STRING, to_status STRING")


def audit_transitions(events: DataFrame, first_status: str = "OPEN", slicing="measure", rows: int = o.SLICE_ROWS) -> DataFrame:
    """Adds the status before each event and whether the step is allowed."""

    def compute(d, part, key):
        before = F.lag("to_status").over(o.series_window(part, key))
        return d.withColumn("from_status", F.coalesce(before, F.lit(first_status)))

    logged = o.framed(events, ["case_id"], ["created_at", "seq"], compute, back=1, slicing=slicing, rows=rows)
    logged = logged.select(*events.columns, "from_status", F.col("_pos").alias("step"))
    allowed = transitions(events.sparkSession).withColumn("allowed", F.lit(True))
    return logged.join(F.broadcast(allowed), ["from_status", "to_status"], "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(False)))


def case_state(events: DataFrame) -> DataFrame:
    """Current status from the log; closed_at only while closed or dismissed."""
    last = events.groupBy("case_id").agg(F.max(F.struct("created_at", "seq", "to_status")).alias("_last"))
    status = F.col("_last.to_status")
    return last.select("case_id", status.alias("status"),
                       F.when(status.isin(*CLOSED), F.col("_last.created_at")).alias("closed_at"))


def timeline(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Oldest first inside each case."""
    return o.numbered(df, ["case_id"], list(order), out="step")


def search(anomalies: DataFrame, cases: DataFrame, notes: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Anomaly and case hits in one shape; newest ids first, at most ``limit`` of each kind."""
    by_id = q.isdigit()
    a_hit = tx.contains_ci("symbol", q) | F.coalesce(tx.contains_ci(F.to_json("pattern_scores"), q), F.lit(False))
    c_hit = tx.contains_ci("title", q)
    if by_id:
        a_hit = a_hit | (F.col("anomaly_id") == int(q))
        c_hit = c_hit | (F.col("case_id") == int(q))
    a = anomalies.filter(a_hit).orderBy(F.col("anomaly_id").desc()).limit(limit)
    noted = notes.filter(tx.contains_ci("body", q)).select("case_id").distinct().withColumn("_noted", F.lit(True))
    c = (cases.join(noted, "case_id", "left").filter(c_hit | F.col("_noted").isNotNull())
         .orderBy(F.col("case_id").desc()).limit(limit))
    hits_a = a.select(
        F.concat(F.lit("anomaly-"), F.col("anomaly_id")).alias("id"), F.col("anomaly_id").alias("entity_id"),
        F.lit("anomaly").alias("type"), tx.anomaly_hit_title("anomaly_id", "symbol").alias("title"),
        tx.anomaly_hit_subtitle(sc.search_signal("pattern_scores"), "anomaly_score").alias("subtitle"),
        F.concat(F.lit("/anomalies?selected="), F.col("anomaly_id")).alias("route"))
    hits_c = c.select(
        F.concat(F.lit("case-"), F.col("case_id")).alias("id"), F.col("case_id").alias("entity_id"),
        F.lit("case").alias("type"), tx.case_hit_title("case_id", "title").alias("title"),
        F.concat(F.lit("Status: "), F.col("status")).alias("subtitle"),
        F.concat(F.lit("/investigations?selected="), F.col("case_id")).alias("route"))
    return hits_a.unionByName(hits_c)


def throttled(df: DataFrame, by: Sequence[str], on: str, gap_s: int = 300) -> DataFrame:
    """Times at which a notice goes out: the first, then the first later than ``gap_s`` after the last one.

    Rows are first reduced to distinct seconds per key, so a key's list is bounded by elapsed time.
    """
    seconds = df.select(*by, F.floor(F.unix_millis(on) / 1000).cast("bigint").alias("_s")).distinct()
    lists = seconds.groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("_ss"))
    sent = F.aggregate("_ss", F.array().cast("array<bigint>"), lambda acc, s: F.when(
        (F.size(acc) == 0) | (s - F.element_at(acc, -1) > gap_s), F.concat(acc, F.array(s))).otherwise(acc))
    return lists.select(*by, F.explode(sent).alias("notice_s"))


def model_status(models: DataFrame) -> DataFrame:
    """healthy when every market has a model, degraded when some has, else offline."""
    m = models.groupBy("market").agg(F.bool_or("has_isolation_forest").alias("f"), F.bool_or("has_multi_pattern").alias("m"))
    loaded = F.col("f") | F.col("m")
    return m.agg(F.count(F.lit(1)).alias("n_markets"), F.count(F.when(loaded, 1)).alias("n_loaded"),
                 F.when(F.bool_and(loaded), "healthy").when(F.bool_or(loaded), "degraded").otherwise("offline").alias("status"))


def evidence_text(pack: DataFrame) -> DataFrame:
    """Deterministic text block of each anomaly in a case report, in timeline order."""
    def num(c):
        return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c)))

    block = F.concat(
        F.lit("- Anomaly ID: "), F.col("anomaly_id").cast("string"), F.lit("\n- Symbol: "), F.col("symbol"),
        F.lit("\n- Timestamp: "), F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\n- Price: "), num("close"),
        F.lit(" | Volume: "), F.format_string("%.2f", "volume"), F.lit("\n- Overall Score: "), num("anomaly_score"),
        F.lit("\n- Isolation Forest Score: "), num("if_score"), F.lit("\n- Random Forest Score: "),
        F.coalesce(num("mp_score"), F.lit("N/A")))
    header = F.concat(F.lit("Case ID: "), F.col("case_id").cast("string"), F.lit("\nCase Title: "), F.col("title"),
                      F.lit("\nCase Status: "), F.col("status"), F.lit("\nCreated At: "),
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return pack.select("case_id", "step", F.when(F.col("step") == 1, header).alias("header"), block.alias("block"))


def explain_stored(anomalies: DataFrame) -> DataFrame:
    """Adds evidence, detector_agreement, weak_label_confidence and detection_result to stored anomalies, from what is stored.

    ``features`` and ``pattern_scores`` are JSON text; null or empty text holds nothing. A row whose text is not JSON keeps null
    in all four columns. Evidence without a signal is null, and so is the result of a row without signals and patterns.
    """
    texts = ("features", "pattern_scores")
    readable = F.lit(True)
    for c in texts:
        readable = readable & (F.coalesce(F.col(c), F.lit("")).isin("") | F.try_parse_json(c).isNotNull())
    rows = anomalies.withColumns({f"_{c}": F.from_json(c, "map<string,double>") for c in texts}).withColumn("_readable", readable)
    rows = rows.withColumn("_scores", F.when(F.size("_pattern_scores") > 0, F.col("_pattern_scores")))
    agreement = sc.agreement_live("if_score", "mp_score")
    rows = rows.withColumn("detector_agreement", F.when(F.col("_readable"), agreement))
    signals = sc.evidence("if_score", "mp_score", feature=lambda name: F.try_element_at("_features", F.lit(name)), dual=F.col("detector_agreement"))
    rows = rows.withColumns({"_signals": signals, "weak_label_confidence": F.when(F.col("_readable"), sc.label_confidence("_scores", "detector_agreement"))})
    result = sc.detection_result(F.col("_scores"), "weak_label_confidence", "anomaly_score", "detector_agreement", F.lit("stored"), "_signals")
    some = F.size("_signals") > 0
    rows = rows.withColumns({"evidence": F.when(F.col("_readable") & some, F.col("_signals")),
                             "detection_result": F.when(F.col("_readable") & (some | F.col("_scores").isNotNull()), result)})
    return rows.drop("_features", "_pattern_scores", "_scores", "_signals", "_readable")
