"""Hand-made cases for functions, validation and repeated writes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.functions import scoring as sc
from tapewatch.functions import text as tx
from tapewatch.operators import desk, joins
from tapewatch.sources import feeds, sinks, validate

AT = dt.datetime(2024, 1, 1, 12)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("out")).first().out


def test_combined_score(spark):
    def score(a, b):
        return one(spark, sc.combined_score(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert score(0.8, 0.5) == 0.68 and score(0.61234567, None) == 0.6123 and score(None, 0.4) == 0.4 and score(None, None) is None


@pytest.mark.parametrize("score,label", [(0.85, "CRITICAL"), (0.8499, "HIGH"), (0.65, "HIGH"), (0.40, "MEDIUM"), (0.1, "LOW")])
def test_severity(spark, score, label):
    assert one(spark, sc.severity(F.lit(score))) == label


def test_signals(spark):
    def m(**kw):
        return F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert one(spark, sc.primary_signal(m(wash_trading=0.7, spoofing=0.7), F.lit(0.9))) == "WASH TRADING"
    assert one(spark, sc.primary_signal(m(wash_trading=0.4), F.lit(0.9))) == "ANOMALY"
    none = F.lit(None).cast("map<string,double>")
    assert one(spark, sc.primary_signal(none, F.lit(0.5))) == "UNCLASSIFIED" and one(spark, sc.primary_signal(none, F.lit(0.2))) == "NORMAL"
    assert one(spark, sc.label_confidence(m(a=0.9, b=0.1), F.lit(0.5))) == pytest.approx(0.45)
    assert one(spark, sc.label_confidence(m(a=0.91234), F.lit(None).cast("double"))) == 0.9123


def test_three_agreements(spark):
    assert one(spark, sc.agreement_live(F.lit(0.6), F.lit(0.6))) == 1.0
    assert one(spark, sc.agreement_live(F.lit(0.6), F.lit(None).cast("double"))) == 0.5
    assert one(spark, sc.agreement_live(F.lit(None).cast("double"), F.lit(None).cast("double"))) is None
    assert one(spark, sc.agreement_detectors(F.lit(1), F.lit(0))) == 0.5 and one(spark, sc.agreement_strict(F.lit(1), F.lit(0))) == 0.0


def test_baselines(spark):
    for mean, std, ok in ((0.0, 1.0, True), (0.0, 0.0, False), (float("nan"), 1.0, False), (0.0, float("inf"), False)):
        assert one(spark, sc.baseline_valid(F.lit(mean), F.lit(std))) is ok
    assert one(spark, sc.baseline_valid(F.lit(None).cast("double"), F.lit(1.0))) is False


def test_text(spark):
    assert one(spark, tx.sentiment(F.lit("BUY buy the Dump now up"))) == 0.333
    assert one(spark, tx.sentiment(F.lit("nothing here"))) == 0.0
    assert one(spark, tx.infer_market(F.lit("seth"))) == "CRYPTO" and one(spark, tx.infer_market(F.lit("AAPL"))) == "US_EQUITY"
    assert one(spark, tx.watched_symbol(F.lit("long btcusdt"))) == "BTCUSDT"
    assert one(spark, tx.path_template(F.lit("/cases/12/notes/3"))) == "/cases/{id}/notes/{id}"
    assert one(spark, tx.without_hashtags(F.lit(" #A_B text #C "))) == "text"
    assert one(spark, tx.canonical_symbol(F.lit(" btc-usdt"))) == "BTCUSDT"
    assert one(spark, tx.csv_field(F.lit('a"b'))) == '"a""b"'


def test_durations(spark):
    def span(seconds):
        return one(spark, tx.case_duration(F.lit(AT), F.lit(AT + dt.timedelta(seconds=seconds)), F.lit(AT)))
    assert [span(0), span(10), span(90), span(3599), span(5400)] == ["< 1m", "0m", "2m", "1.0h", "1.5h"]


def test_broken_messages_are_flagged(spark):
    raw = spark.createDataFrame([(1, '{"s":"BTCUSDT","p":"2.5","q":"4","T":5,"m":true}'), (2, '{"s":"X","q":"1","T":5}'), (3, "{oops")],
                                "message_no BIGINT, value STRING")
    got = {r.message_no: r for r in feeds.crypto_a(raw).collect()}
    assert got[1].parsed and got[1].notional_value == 10.0 and got[1].event_id.startswith("BINANCE_BTCUSDT_5_")
    assert not got[2].parsed and not got[3].parsed


def test_tick_rules(spark):
    rows = [("e", " btc ", "crypto", "BINANCE", 1, 1.0, 0.0, 0.0, None), (None, "X" * 31, "FX", "B", 0, -1.0, -1.0, None, None)]
    df = spark.createDataFrame(rows, "event_id STRING, symbol STRING, market STRING, source STRING, timestamp_ms BIGINT, price DOUBLE, volume DOUBLE, notional_value DOUBLE, is_buyer_maker BOOLEAN")
    valid, bad = validate.split(validate.check_ticks(df))
    assert valid.first().symbol == "BTC"
    assert set(bad.first().reasons) == {"event_id", "timestamp_ms", "symbol", "price", "volume", "notional_value", "market"}


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C")], "row_no INT, k STRING")
    stored = spark.createDataFrame([("C",)], "k STRING")
    got = {r.row_no: r.status for r in sinks.conflicts(rows, stored, ["k"]).collect()}
    assert got == {1: "created", 2: "conflict", 3: "created", 4: "conflict"}


def test_audit_digest_changes_with_content(spark):
    rows = spark.createDataFrame([(i, f"h{i}") for i in range(50)], "case_id BIGINT, row_sha256 STRING")
    a = sinks.export_digest(rows.repartition(5)).first()
    b = sinks.export_digest(rows.repartition(2)).first()
    c = sinks.export_digest(rows.withColumn("row_sha256", F.when(F.col("case_id") == 7, "x").otherwise(F.col("row_sha256")))).first()
    assert a == b and a.records == 50 and a.sha256 != c.sha256


def test_transitions(spark):
    rows = [(1, AT, "a", "IN_REVIEW"), (1, AT, "b", "CLOSED"), (1, AT, "c", "ESCALATED"), (2, AT, "a", "OPEN")]
    log = spark.createDataFrame(rows, "case_id BIGINT, created_at TIMESTAMP, seq STRING, to_status STRING")
    got = {(r.case_id, r.step): r.allowed for r in desk.audit_transitions(log).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False}
    state = {r.case_id: r for r in desk.case_state(log.filter("seq <> 'c'")).collect()}
    assert state[1].status == "CLOSED" and state[1].closed_at == AT and state[2].closed_at is None


def test_correlated_skips_linked(spark):
    a = spark.createDataFrame([(i, "S" if i % 2 else "T", AT + dt.timedelta(minutes=i)) for i in range(30)], "anomaly_id BIGINT, primary_signal STRING, detected_at TIMESTAMP")
    links = spark.createDataFrame([(1, 1), (1, 29), (1, 25), (1, 28), (2, 2)], "case_id BIGINT, anomaly_id BIGINT")
    got = desk.correlated(links, a).orderBy("case_id", "place").collect()
    assert [r.anomaly_id for r in got] == [27, 23, 21, 19, 17, 28, 26, 24, 22, 20]


def test_empty_watchlist_shows_nothing(spark):
    alerts = spark.createDataFrame([("A",)], "symbol STRING")
    lists = spark.createDataFrame([(1, 5)], "watchlist_id INT, owner_id INT")
    symbols = spark.createDataFrame([(1, "A")], "watchlist_id INT, symbol STRING")
    assert desk.restrict_to_watchlist(alerts, lists, symbols, 5).count() == 1
    assert desk.restrict_to_watchlist(alerts, lists, symbols, 6).count() == 0


def test_correlation(spark):
    rows = [(s, AT + dt.timedelta(days=i), float(f(i))) for s, f in (("UP", lambda i: i), ("BTC-X", lambda i: 2 * i + 1), ("FLAT", lambda i: 3)) for i in range(5)]
    bars = spark.createDataFrame(rows + [("SHORT", AT, 1.0)], "symbol STRING, ts TIMESTAMP, close DOUBLE")
    got = {(r.symbol_a, r.symbol_b): r.r for r in joins.correlation_matrix(bars, ["up", "BTC-X", "FLAT", "SHORT"]).collect()}
    assert got[("UP", "BTCX")] == 1.0 and got[("UP", "FLAT")] == 0.0 and ("SHORT", "UP") not in got
    with pytest.raises(ValueError):
        joins.correlation_matrix(bars, ["UP", "SHORT"])


def test_correlation_of_many_symbols(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_SYMBOLS", 7)
    rng = np.random.default_rng(3)
    close = {f"S{k}": rng.normal(size=3 + k % 4) for k in range(40)}
    bars = spark.createDataFrame([(s, AT + dt.timedelta(days=i), float(v)) for s, x in close.items() for i, v in enumerate(x)],
                                 "symbol STRING, ts TIMESTAMP, close DOUBLE")
    got = {(r.symbol_a, r.symbol_b): (r.n, r.r) for r in joins.correlation_matrix(bars, bars.select("symbol")).collect()}
    assert len(got) == 1600
    for a, b in got:
        n = min(len(close[a]), len(close[b]))
        assert got[a, b][0] == n and abs(got[a, b][1] - np.corrcoef(close[a][-n:], close[b][-n:])[0, 1]) < 1e-4


def test_notices_are_throttled(spark):
    rows = [("a", AT + dt.timedelta(seconds=s)) for s in (0, 100, 300, 301, 500, 602, 2000)]
    df = spark.createDataFrame(rows, "market STRING, ts TIMESTAMP")
    start = int(df.agg(F.min(F.unix_seconds("ts"))).first()[0])
    assert sorted(r.notice_s - start for r in desk.throttled(df, ["market"], "ts").collect()) == [0, 301, 602, 2000]
