"""Desk queries: lists, joins, roll-ups, audit, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.catalog import query, sql
from tapewatch.catalog.series_windows import rounded
from tapewatch.functions import scoring as sc
from tapewatch.functions import text as tx
from tapewatch.operators import desk, joins
from tapewatch.operators import ordered as o
from tapewatch.sources import tables as t

AN = sql.ANOMALIES


def labelled(spark, d):
    a = t.anomalies(spark, d)
    return a.withColumns({"severity": sc.severity("anomaly_score"),
                          "primary_signal": sc.primary_signal("pattern_scores", "anomaly_score")})


@query("anomaly_page", "T-1 P12 A5 J1",
       f"""WITH {AN}, f AS (SELECT a.anomaly_id, a.symbol, anomaly_score, value AS close, count(*) OVER () AS total, detected_at FROM anomalies a
         JOIN events ON market_data_id = event_id WHERE is_anomaly AND primary_signal = 'PUMP AND DUMP')
       SELECT anomaly_id, symbol, anomaly_score, close, total FROM f ORDER BY detected_at DESC, anomaly_id DESC LIMIT 50 OFFSET 20""")
def anomaly_page(spark, d):
    bars = t.market_data(spark, d).select("market_data_id", "close")
    a = desk.with_bars(desk.filter_anomalies(labelled(spark, d), flagged=True, signal="PUMP AND DUMP"), bars)
    total = a.agg(F.count(F.lit(1)).alias("total"))
    rows = desk.page(a, [F.col("detected_at").desc(), F.col("anomaly_id").desc()], 20, 50)
    return rows.crossJoin(F.broadcast(total)).select("anomaly_id", "symbol", "anomaly_score", "close", "total")


@query("symbol_anomalies", "P12 P16 T-5",
       f"""WITH {AN} SELECT anomaly_id, anomaly_score, severity FROM anomalies WHERE symbol = 'S7' AND severity IN ('HIGH', 'CRITICAL')
       ORDER BY anomaly_score DESC, anomaly_id LIMIT 10""")
def symbol_anomalies(spark, d):
    a = desk.at_least_severity(desk.filter_anomalies(labelled(spark, d), symbol="s7"), "HIGH")
    return desk.page(a, [F.col("anomaly_score").desc(), F.col("anomaly_id")], 0, 10).select("anomaly_id", "anomaly_score", "severity")


@query("visible_cases", "P14 P24 T-3",
       f"""WITH {sql.CASES} SELECT case_id, status, title FROM cases WHERE (created_by = 11 OR assigned_to = 11)
        AND status NOT IN ('CLOSED', 'DISMISSED') ORDER BY created_at DESC, case_id DESC LIMIT 50""")
def visible_cases(spark, d):
    c = desk.open_cases(desk.visible_cases(t.cases(spark, d), 11, "viewer"))
    return desk.page(c, [F.col("created_at").desc(), F.col("case_id").desc()]).select("case_id", "status", "title")


@query("case_counts_by_role", "P14 P15 A27 P24",
       f"""WITH {sql.CASES}, {sql.USERS}, {AN} SELECT u.role, sum(CASE WHEN role <> 'viewer' THEN a.n ELSE 0 END)::BIGINT AS all_open,
         sum(coalesce(o.n, 0))::BIGINT AS own_open, sum(coalesce(al.n, 0))::BIGINT AS own_alerts FROM users u
         CROSS JOIN (SELECT count(*) AS n FROM cases WHERE status NOT IN ('CLOSED', 'DISMISSED')) a
         LEFT JOIN (SELECT created_by, count(*) AS n FROM cases WHERE status NOT IN ('CLOSED', 'DISMISSED') GROUP BY 1) o ON o.created_by = u.user_id
         LEFT JOIN (SELECT user_id, count(*) AS n FROM anomalies GROUP BY 1) al ON al.user_id = u.user_id GROUP BY u.role""")
def case_counts_by_role(spark, d):
    u = t.users(spark, d)
    open_ = desk.open_cases(t.cases(spark, d))
    everything = open_.agg(F.count(F.lit(1)).alias("n"))
    own = open_.groupBy(F.col("created_by").alias("user_id")).agg(F.count(F.lit(1)).alias("own"))
    alerts = desk.counts(t.anomalies(spark, d), ["user_id"], "al")
    x = u.join(own, "user_id", "left").join(alerts, "user_id", "left").crossJoin(F.broadcast(everything))
    return x.groupBy("role").agg(F.sum(F.when(F.col("role") != "viewer", F.col("n")).otherwise(0)).alias("all_open"),
                                 F.sum(F.coalesce("own", F.lit(0))).alias("own_open"),
                                 F.sum(F.coalesce("al", F.lit(0))).alias("own_alerts"))


@query("case_evidence_pack", "J2 F27 E8 W30",
       f"""WITH {AN}, {sql.CASES}, {sql.LINKS}, j AS (SELECT l.case_id, a.*, c.title, c.status, c.created_at, e.value AS close,
          CAST({sql.K} AS DOUBLE) AS volume, e.ts AS bar_ts FROM links l JOIN cases c USING (case_id) JOIN anomalies a USING (anomaly_id)
          JOIN events e ON e.event_id = a.market_data_id),
       n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY bar_ts, anomaly_id) AS step FROM j)
       SELECT case_id, step, CASE WHEN step = 1 THEN 'Case ID: ' || case_id || chr(10) || 'Case Title: ' || title || chr(10) || 'Case Status: ' ||
         status || chr(10) || 'Created At: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS header,
        '- Anomaly ID: ' || anomaly_id || chr(10) || '- Symbol: ' || symbol || chr(10) || '- Timestamp: ' ||
        strftime(bar_ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '- Price: ' || printf('%.4f', close) || ' | Volume: ' || printf('%.2f', volume) ||
        chr(10) || '- Overall Score: ' || printf('%.4f', anomaly_score) || chr(10) || '- Isolation Forest Score: ' ||
        printf('%.4f', if_score + 0.000001) || chr(10) || '- Random Forest Score: ' || coalesce(printf('%.4f', mp_score), 'N/A') AS block FROM n""")
def case_evidence_pack(spark, d):
    a = t.anomalies(spark, d).drop("market", "user_id").withColumn("if_score", F.col("if_score") + 0.000001)
    pack = desk.case_evidence(t.cases(spark, d), t.case_links(spark, d), a, t.market_data(spark, d))
    return desk.evidence_text(pack)


@query("watchlist_alerts", "J3 J4 R6",
       f"""WITH {AN}, {sql.WATCHLISTS} SELECT anomaly_id, symbol FROM anomalies WHERE symbol IN (SELECT symbol FROM watchlist_symbols
        JOIN watchlists USING (watchlist_id) WHERE owner_id = 3)""")
def watchlist_alerts(spark, d):
    out = desk.restrict_to_watchlist(t.anomalies(spark, d), t.watchlists(spark, d), t.watchlist_symbols(spark, d), 3)
    return out.select("anomaly_id", "symbol")


@query("cases_with_note", "J5 P13",
       f"""WITH {sql.CASES}, {sql.NOTES} SELECT case_id, status FROM cases WHERE EXISTS (SELECT 1 FROM notes n WHERE n.case_id = cases.case_id
        AND contains(lower(body), 'tion'))""")
def cases_with_note(spark, d):
    return desk.cases_with_note(t.cases(spark, d), t.case_notes(spark, d), "TION").select("case_id", "status")


@query("sentiment_at_tick", "J7 R4",
       f"""WITH {sql.TICKS}, s AS (SELECT symbol, ts, round(price / 250 - 1, 4) AS score FROM ticks WHERE event_type = 'view')
       SELECT t.event_id, coalesce(s.score, 0) AS sentiment, round((epoch_us(t.ts) // 1000 - epoch_us(s.ts) // 1000) / 1000, 3) AS age_s,
        coalesce((epoch_us(t.ts) // 1000 - epoch_us(s.ts) // 1000) / 1000 > 300, FALSE) AS stale FROM ticks t ASOF LEFT JOIN s ON t.symbol = s.symbol AND t.ts >= s.ts""")
def sentiment_at_tick(spark, d):
    x = t.ticks(spark, d)
    s = x.filter(F.col("event_type") == "view").select("symbol", "ts", F.round(F.col("price") / 250 - 1, 4).alias("score"))
    out = joins.latest_value(x.select("event_id", "symbol", "ts"), s, ["symbol"], "ts", "score", "sentiment")
    return out.select("event_id", "sentiment", F.round("sentiment_age_s", 3).alias("age_s"), F.col("sentiment_stale").alias("stale"))


@query("feed_failover", "J15 R10",
       f"""WITH {sql.TICKS}, p AS (SELECT DISTINCT ts AS pts FROM ticks WHERE source = 'BINANCE' UNION SELECT min(ts) FROM ticks),
       s AS (SELECT t.*, p.pts FROM ticks t ASOF LEFT JOIN p ON t.ts >= p.pts)
       SELECT event_id, source FROM s WHERE source = 'BINANCE' OR (source = 'BYBIT' AND epoch_us(ts) - epoch_us(pts) > 30000000)""")
def feed_failover(spark, d):
    return joins.failover(t.ticks(spark, d), "BINANCE", "BYBIT").select("event_id", "source")


@query("nearest_bar_surge", "J16 A30",
       f"""WITH {sql.TICKS}, b AS (SELECT symbol, ts AS bts, volume, avg(volume) OVER (PARTITION BY symbol) AS mv FROM ticks WHERE event_type <> 'view'),
       pts AS (SELECT event_id, symbol, ts FROM ticks WHERE event_type = 'view'),
       x AS (SELECT p.event_id, volume, mv, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(bts)), bts) AS rn
         FROM pts p JOIN b USING (symbol))
       SELECT event_id, volume AS near_volume, CASE WHEN mv > 0 THEN round(volume / mv, 1) ELSE 1 END AS surge FROM x WHERE rn = 1""")
def nearest_bar_surge(spark, d):
    x = t.ticks(spark, d)
    out = desk.volume_surge(x.filter("event_type = 'view'").select("event_id", "symbol", "ts"),
                            x.filter("event_type <> 'view'").select("symbol", "ts", "volume"))
    return out.select("event_id", "near_volume", "surge")


@query("requested_links", "J12",
       f"""WITH {sql.LINKS}, r AS (SELECT l_orderkey AS case_id, l_partkey * 5 AS anomaly_id FROM lineitem)
       SELECT DISTINCT case_id, anomaly_id FROM r ANTI JOIN links USING (case_id, anomaly_id)""")
def requested_links(spark, d):
    r = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") * 5).alias("anomaly_id"))
    return joins.new_links(r, t.case_links(spark, d), ["case_id", "anomaly_id"])


@query("links_not_visible", "J13",
       f"""WITH {AN}, {sql.LINKS} SELECT DISTINCT anomaly_id FROM links ANTI JOIN (SELECT anomaly_id FROM anomalies WHERE market = 'CRYPTO') USING (anomaly_id)""")
def links_not_visible(spark, d):
    seen = t.anomalies(spark, d).filter("market = 'CRYPTO'")
    return joins.not_visible(t.case_links(spark, d).select("anomaly_id"), seen, ["anomaly_id"])


@query("correlation_matrix", "J17 J18 A11 F23 T-4",
       f"""WITH {sql.TICKS}, r AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS k,
         count(*) OVER (PARTITION BY symbol) AS n FROM ticks), l AS (SELECT * FROM r WHERE k <= 60 AND n >= 3),
       c AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n,
         CASE WHEN var_pop(a.close) = 0 OR var_pop(b.close) = 0 THEN 0 ELSE round(round(corr(a.close, b.close), 4) + 0.0000037, 3) END AS r
         FROM l a JOIN l b ON a.k = b.k GROUP BY 1, 2)
       SELECT *, CASE WHEN r >= 0.7 THEN 'strong_positive' WHEN r >= 0.4 THEN 'positive' WHEN r >= 0.1 THEN 'weak_positive' WHEN r >= -0.1 THEN 'none'
         WHEN r >= -0.4 THEN 'weak_negative' ELSE 'negative' END AS band FROM c""")
def correlation_matrix(spark, d):
    x = t.ticks(spark, d)
    m = joins.correlation_matrix(x, x.select("symbol"), limit=60, order=["ts", "event_id"])
    m = m.withColumn("r", F.round(F.col("r") + 0.0000037, 3))
    return m.withColumn("band", sc.correlation_band("r"))


@query("related_anomalies", "J19",
       f"""WITH {AN}, k AS (SELECT symbol, anomaly_id, row_number() OVER (PARTITION BY symbol ORDER BY detected_at DESC, anomaly_id DESC) AS rn FROM anomalies),
       p AS (SELECT a.anomaly_id, k.anomaly_id AS other, k.rn, row_number() OVER (PARTITION BY a.anomaly_id ORDER BY k.rn) AS i
         FROM anomalies a JOIN k ON a.symbol = k.symbol AND k.rn <= 6 AND k.anomaly_id <> a.anomaly_id)
       SELECT anomaly_id, string_agg(other, ',' ORDER BY rn) AS related FROM p WHERE i <= 5 GROUP BY anomaly_id""")
def related_anomalies(spark, d):
    return desk.related(t.anomalies(spark, d)).select("anomaly_id", F.array_join("related", ",").alias("related"))


@query("correlated_anomalies", "J20",
       f"""WITH {AN}, {sql.LINKS}, l AS (SELECT * FROM links JOIN (SELECT anomaly_id, primary_signal FROM anomalies) USING (anomaly_id)),
       f AS (SELECT case_id, arg_min(primary_signal, anomaly_id) AS primary_signal FROM l GROUP BY 1),
       s AS (SELECT anomaly_id, primary_signal, row_number() OVER (PARTITION BY primary_signal ORDER BY detected_at DESC, anomaly_id) AS rk FROM anomalies),
       c AS (SELECT f.case_id, f.primary_signal, s.anomaly_id, s.rk FROM f JOIN s ON f.primary_signal = s.primary_signal AND s.rk <= 60
         ANTI JOIN l ON l.case_id = f.case_id AND l.anomaly_id = s.anomaly_id),
       n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rk) AS place FROM c)
       SELECT case_id, primary_signal, place, anomaly_id FROM n WHERE place <= 5""")
def correlated_anomalies(spark, d):
    return desk.correlated(t.case_links(spark, d), labelled(spark, d))


@query("case_assignees", "J21",
       f"""WITH {sql.CASES}, {sql.USERS} SELECT case_id, CASE WHEN assigned_to IS NULL THEN 'Unassigned' ELSE coalesce(username, 'User ' || assigned_to) END
        AS assignee FROM cases LEFT JOIN users ON assigned_to = user_id""")
def case_assignees(spark, d):
    return desk.with_assignee(t.cases(spark, d), t.users(spark, d), "Unassigned").select("case_id", "assignee")


@query("symbol_flag_rates", "A1 E5",
       f"""WITH {AN} SELECT market, symbol, count(*) AS n_rows, round(avg(is_anomaly::INT), 9) AS flag_rate, {sql.r('avg(anomaly_score)', 8)} AS mean_score
        FROM anomalies GROUP BY market, symbol ORDER BY flag_rate DESC""")
def symbol_flag_rates(spark, d):
    out = desk.flag_rate(t.anomalies(spark, d), flag="is_anomaly", score="anomaly_score").orderBy(F.col("flag_rate").desc())
    return out.select("market", "symbol", "n_rows", F.round("flag_rate", 9).alias("flag_rate"), *rounded(["mean_score"], 8))


@query("deviating_symbols", "A2 E5",
       f"""WITH {AN}, s AS (SELECT market, symbol, count(*) AS n_rows, avg(is_anomaly::INT) AS flag_rate FROM anomalies GROUP BY 1, 2),
       m AS (SELECT market, avg(is_anomaly::INT) AS market_rate FROM anomalies GROUP BY 1)
       SELECT market, symbol, n_rows, round(flag_rate, 9) AS flag_rate, round(market_rate, 9) AS market_rate FROM s JOIN m USING (market)
        WHERE n_rows >= 30 AND (flag_rate >= market_rate * 1.1 OR flag_rate <= market_rate / 1.1)""")
def deviating_symbols(spark, d):
    out = desk.deviating(t.anomalies(spark, d), factor=1.1, flag="is_anomaly", score="anomaly_score")
    return out.select("market", "symbol", "n_rows", F.round("flag_rate", 9).alias("flag_rate"), F.round("market_rate", 9).alias("market_rate"))


@query("last_day_counts", "A3 A4 P19",
       f"""WITH {AN}, {sql.TICKS}, z AS (SELECT max(ts) AS z FROM ticks) SELECT market, count(*) AS bars, count(a.anomaly_id) AS anomalies FROM
        (SELECT t.* FROM ticks t, z WHERE t.ts >= z.z - INTERVAL 24 HOURS) b LEFT JOIN (SELECT anomaly_id FROM anomalies) a ON a.anomaly_id = b.event_id GROUP BY market""")
def last_day_counts(spark, d):
    bars, a = t.market_data(spark, d), t.anomalies(spark, d)
    z = bars.agg(F.max("ts").alias("as_of"))
    recent_bars = desk.counts(desk.last_day(bars.crossJoin(F.broadcast(z)), "ts", F.col("as_of")), ["market"], "bars")
    recent = desk.last_day(a.crossJoin(F.broadcast(z)), "detected_at", F.col("as_of"))
    return recent_bars.join(desk.counts(recent, ["market"], "anomalies"), "market", "left").withColumn(
        "anomalies", F.coalesce("anomalies", F.lit(0)))


@query("watchlist_sizes", "A6 T-9",
       f"""WITH {sql.WATCHLISTS} SELECT w.watchlist_id, w.name, count(s.symbol) AS n_symbols FROM watchlists w LEFT JOIN watchlist_symbols s USING (watchlist_id)
        GROUP BY ALL""")
def watchlist_sizes(spark, d):
    out = desk.watchlist_sizes(t.watchlists(spark, d), t.watchlist_symbols(spark, d))
    return out.orderBy(F.col("created_at").desc()).select("watchlist_id", "name", "n_symbols")


@query("anomaly_counters", "A8 A9",
       f"""WITH {AN} SELECT market, primary_signal, severity, count(*) AS n FROM anomalies GROUP BY ALL
        UNION ALL SELECT {sql.MARKET.format('user_id')}, 'INGESTED', 'ALL', count(*) FROM events GROUP BY 1""")
def anomaly_counters(spark, d):
    a = desk.counts(labelled(spark, d), ["market", "primary_signal", "severity"])
    ticks = desk.counts(t.ticks(spark, d), ["market"]).select("market", F.lit("INGESTED").alias("primary_signal"), F.lit("ALL").alias("severity"), "n")
    return a.unionByName(ticks)


@query("request_percentiles", "A10",
       f"""WITH {sql.REQUESTS}, l AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS k FROM requests),
       r AS (SELECT endpoint, duration_s, row_number() OVER (PARTITION BY endpoint ORDER BY duration_s) AS i, count(*) OVER (PARTITION BY endpoint) AS n
         FROM l WHERE k <= 1000)
       SELECT endpoint, max(n) AS n, max(CASE WHEN i = greatest(1, n * 50 // 100) THEN duration_s END) AS p50,
        max(CASE WHEN i = greatest(1, n * 95 // 100) THEN duration_s END) AS p95, max(CASE WHEN i = greatest(1, n * 99 // 100) THEN duration_s END) AS p99
       FROM r GROUP BY endpoint""")
def request_percentiles(spark, d):
    r = t.request_log(spark, d).withColumn("endpoint", tx.path_template("path"))
    return desk.nearest_rank(r, ["endpoint"], "duration_s", [50, 95, 99])


@query("case_risk", "A25 A26",
       f"""WITH {AN}, {sql.LINKS} SELECT case_id, count(*) AS n_anomalies, max(anomaly_score) AS max_score,
        CASE max(CASE WHEN severity = 'CRITICAL' OR anomaly_score >= 0.85 THEN 3 WHEN severity = 'HIGH' OR anomaly_score >= 0.7 THEN 2
          WHEN severity = 'MEDIUM' OR anomaly_score >= 0.5 THEN 1 ELSE 0 END) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
        CASE WHEN max(anomaly_score) >= 0.85 THEN 'CRITICAL' WHEN max(anomaly_score) >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS headline_severity
       FROM links JOIN anomalies USING (anomaly_id) GROUP BY case_id""")
def case_risk(spark, d):
    return desk.case_risk(t.case_links(spark, d), labelled(spark, d))


@query("case_timeline", "W30",
       f"""WITH {sql.NOTES} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY note_no) AS step, author FROM notes""")
def case_timeline(spark, d):
    return desk.timeline(t.case_notes(spark, d), ["note_no"]).select("case_id", "step", "author")


@query("transition_audit", "W31 P18",
       f"""WITH {sql.CASE_EVENTS}, l AS (SELECT *, coalesce(lag(to_status) OVER w, 'OPEN') AS from_status, row_number() OVER w AS step FROM case_events
         WINDOW w AS (PARTITION BY case_id ORDER BY created_at, seq))
       SELECT case_id, step, from_status, to_status FROM l WHERE NOT ((from_status = 'OPEN' AND to_status IN ('IN_REVIEW', 'DISMISSED', 'CLOSED'))
        OR (from_status = 'IN_REVIEW' AND to_status IN ('ESCALATED', 'DISMISSED', 'CLOSED', 'OPEN'))
        OR (from_status = 'ESCALATED' AND to_status IN ('IN_REVIEW', 'DISMISSED', 'CLOSED')) OR (from_status IN ('DISMISSED', 'CLOSED') AND to_status = 'OPEN'))""")
def transition_audit(spark, d):
    return desk.audit_transitions(t.case_events(spark, d)).filter(~F.col("allowed")).select("case_id", "step", "from_status", "to_status")


@query("case_state", "W31",
       f"""WITH {sql.CASE_EVENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, seq DESC) AS rn FROM case_events)
       SELECT case_id, to_status AS status, CASE WHEN to_status IN ('CLOSED', 'DISMISSED') THEN epoch_ms(created_at) END AS closed_ms FROM l WHERE rn = 1""")
def case_state(spark, d):
    return desk.case_state(t.case_events(spark, d)).select("case_id", "status", F.unix_millis("closed_at").alias("closed_ms"))


def _search_sql(q, limit=20):
    digits = q.isdigit()
    return f"""WITH {AN}, {sql.CASES}, {sql.NOTES},
     a AS (SELECT * FROM anomalies WHERE contains(lower(symbol), '{q}') OR (mp_score IS NOT NULL AND contains('pump_and_dump wash_trading spoofing layering', '{q}'))
       {'OR anomaly_id = ' + q if digits else ''} {"OR (mp_score IS NOT NULL AND contains(concat_ws(',', pump_and_dump, wash_trading, spoofing, layering), '" + q + "'))" if digits else ''}
       ORDER BY anomaly_id DESC LIMIT {limit}),
     c AS (SELECT * FROM cases WHERE contains(lower(title), '{q}') OR case_id IN (SELECT case_id FROM notes WHERE contains(lower(body), '{q}'))
       {'OR case_id = ' + q if digits else ''} ORDER BY case_id DESC LIMIT {limit})
     SELECT 'anomaly-' || anomaly_id AS id, anomaly_id AS entity_id, 'anomaly' AS type, 'Anomaly #' || anomaly_id || ' (' || symbol || ')' AS title,
      CASE WHEN mp_score >= 0.5 THEN upper(replace(best_pattern, '_', ' ')) ELSE 'ANOMALY' END || ' (Score: ' || printf('%.2f', anomaly_score + 0.0000037) || ')' AS subtitle,
      '/anomalies?selected=' || anomaly_id AS route FROM a
     UNION ALL SELECT 'case-' || case_id, case_id, 'case', 'Case #' || case_id || ': ' || title, 'Status: ' || status, '/investigations?selected=' || case_id FROM c"""


@query("search_text", "P13 U3 F21", _search_sql("urgent"))
def search_text(spark, d):
    a = t.anomalies(spark, d).withColumn("anomaly_score", F.col("anomaly_score") + 0.0000037)
    return desk.search(a, t.cases(spark, d), t.case_notes(spark, d), "URGENT")


@query("search_id", "P13 U3 F21", _search_sql("77"))
def search_id(spark, d):
    a = t.anomalies(spark, d).withColumn("anomaly_score", F.col("anomaly_score") + 0.0000037)
    return desk.search(a, t.cases(spark, d), t.case_notes(spark, d), "77")


@query("closed_case_search", "P20",
       f"""WITH {sql.CASES} SELECT case_id, title, status FROM cases WHERE status IN ('CLOSED', 'DISMISSED') AND (contains(lower(title), 'medium') OR case_id::VARCHAR = 'medium')""")
def closed_case_search(spark, d):
    return desk.closed_cases(t.cases(spark, d), "MEDIUM").select("case_id", "title", "status")


@query("disarmed_notices", "R7",
       f"""WITH RECURSIVE {sql.TICKS}, s AS (SELECT DISTINCT market, timestamp_ms // 1000 AS s FROM ticks),
       n(market, notice_s) AS (SELECT market, min(s) FROM s GROUP BY market
         UNION ALL SELECT n.market, (SELECT min(s) FROM s WHERE s.market = n.market AND s.s > n.notice_s + 300) FROM n WHERE n.notice_s IS NOT NULL)
       SELECT market, notice_s FROM n WHERE notice_s IS NOT NULL""")
def disarmed_notices(spark, d):
    return desk.throttled(t.ticks(spark, d), ["market"], "ts")


@query("model_coverage", "A31 M37",
       f"""WITH {AN}, m AS (SELECT market, bool_or(severity = 'CRITICAL') AS f, bool_or(anomaly_score > 0.97) AS p FROM anomalies GROUP BY market)
       SELECT count(*) AS n_markets, count(*) FILTER (f OR p) AS n_loaded,
        CASE WHEN bool_and(f OR p) THEN 'healthy' WHEN bool_or(f OR p) THEN 'degraded' ELSE 'offline' END AS status FROM m""")
def model_coverage(spark, d):
    m = labelled(spark, d).select("market", (F.col("severity") == "CRITICAL").alias("has_isolation_forest"),
                                  (F.col("anomaly_score") > 0.97).alias("has_multi_pattern"))
    return desk.model_status(m)
