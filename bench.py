"""Times the headline queries warm and prints one JSON line. Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES."""

from __future__ import annotations

import json
import os
import time

from tallyweave.queries import QUERIES
from tallyweave.session import build_session

HEADLINE = (
    "monthly_spend", "tag_breakdown", "card_spend_summary", "anomaly_large_txn", "date_range_filter", "monthly_consumption_summary", "compare_months",
    "pivot_month_category", "weekly_anomalies", "merchant_context", "recurring_obligations", "savings_rate", "gap_analysis", "tag_rules", "append_preview",
    "transfer_candidates", "networth_history", "row_hash", "query_page", "tpch_q1",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    timed: dict[str, float] = {}
    for name in names:
        best = None
        for k in range(3):  # the first run, untimed, compiles code and fills file caches
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if k and (best is None or took < best) else best
        timed[name] = round(best, 4)
    total = round(sum(timed.values()), 4)
    print(json.dumps({"metric": "headline queries, warm, total", "value": total, "unit": "sec", "queries": timed, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
