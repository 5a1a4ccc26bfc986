"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the cores; BENCH_QUERIES
may list other query names.
"""

from __future__ import annotations

import json
import os
import time

from bartide.plans import registry
from bartide.session import build_session

HEADLINE = ["price_bars", "back_adjusted_prices", "relative_strength", "directional_index", "technical_summary", "rolling_windows", "review_table",
            "selection_ranking", "single_index_table", "multi_factor_table", "value_at_risk", "window_metrics", "equal_risk_weights", "strategy_table",
            "book_sensitivity", "daily_values", "attribution_summary", "replacement_plan", "signal_scorecard", "conviction_outcomes",
            "stop_rule_outcomes", "universe_comparison", "company_page_metrics", "streamed_bars"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.by_name()
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    times = {}
    for name in names:
        begun = time.perf_counter()
        # a sink that reads every column of every row and keeps nothing
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
