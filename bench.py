"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the local cores. Every query runs in full into a no-op sink; streams and learners
include all of their jobs. A first untimed run of one query warms the session.
"""

import json
import os
import sys
import time

from pulsegrid.plans.catalog import QUERIES
from pulsegrid.session import clear_scratch, get_session

HEADLINE = [
    # features and labels
    "sliding_features", "horizon_labels", "temporal_features", "forward_fill",
    "fill_and_impute", "sequence_features", "sequence_table",
    # joins in time
    "pair_events", "assign_interval", "asof_fill", "hourly_score_table", "label_entities",
    # messages, split and streams
    "json_roundtrip", "split_roundtrip", "stream_features", "stream_labelled",
    "stream_multi_sink", "stream_forward_fill",
    # quality and metrics
    "null_rates", "latency_percentiles", "lofo_median", "metric_table", "bootstrap_ci",
    "lead_summary", "run_summary",
    # learners
    "oof_boosted", "oof_sequence", "stream_scored",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["horizon_labels"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
