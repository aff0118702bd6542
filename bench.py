"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "worst_ticks", "tick_features", "market_feature_table", "causal_zscores", "wilder_rsi", "evidence_signals",
    "sentiment_at_tick", "feed_failover", "nearest_bar_surge", "correlation_matrix", "correlated_anomalies",
    "case_evidence_pack", "transition_audit", "request_percentiles", "symbol_flag_rates", "score_threshold",
    "weak_labels", "roc_auc", "threshold_sweep", "local_outlier_factor", "autocorrelation", "adf_test", "search_text",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tapewatch.catalog import load_all
    from tapewatch.session import build_session

    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    registry = load_all()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    registry[names[0]].build(spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
