"""Evidence of cases."""

from pyspark.sql import functions as F

from tapewatch.operators import desk


def test_evidence_moves_wide_rows_once(spark):
    """Links of doubled cases, missing anomalies and missing bars; the case's columns are shuffled by case only."""
    cases = spark.createDataFrame([(1, "one"), (1, "one again"), (2, "two"), (3, "three")], "case_id BIGINT, title STRING")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (2, 13), (9, 10), (None, 10), (3, None)], "case_id BIGINT, anomaly_id BIGINT")
    anomalies = spark.createDataFrame([(10, 100, "A"), (11, 101, "B"), (12, 102, "C"), (13, None, "D")], "anomaly_id BIGINT, market_data_id BIGINT, symbol STRING")
    bars = spark.createDataFrame([(100, 50, 1.0, 2.0), (101, 40, 3.0, 4.0)], "market_data_id BIGINT, s BIGINT, close DOUBLE, volume DOUBLE").select(
        "market_data_id", F.timestamp_seconds("s").alias("ts"), "close", "volume")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = desk.case_evidence(cases, links, anomalies, bars)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.case_id, r.title, r.anomaly_id, r.symbol, r.close) for r in out.collect())
        assert rows == [(1, "one", 10, "A", 1.0), (1, "one", 11, "B", 3.0), (1, "one again", 10, "A", 1.0), (1, "one again", 11, "B", 3.0), (2, "two", 11, "B", 3.0)]
        assert sorted(r.step for r in out.filter("case_id = 1").collect()) == [1, 2, 3, 4]
        assert out.columns == ["market_data_id", "anomaly_id", "case_id", "title", "symbol", "bar_ts", "close", "volume", "step"]
        assert plan.count("Exchange hashpartitioning(case_id") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
