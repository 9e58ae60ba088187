"""Wall-clock times of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labelspark.plans import catalog  # noqa: E402
from labelspark.session import build_session  # noqa: E402

HEADLINE = [
    "w2_snapshot", "q2_reconciliation", "j7_shared_hash", "x18_hash_duplicates", "j9_time_proximity", "j10_brand_tiers",
    "x14_link_rank", "q5_issues", "u1_archive_union", "j4_year_star", "s2_ledger_lines", "m1_upsert_deliveries",
    "m8_change_audit", "m11_foreign_plan", "x2_page_text", "x3_label_values", "x11_model_responses", "x12_page_links",
    "x13_link_scores", "r1_rate_limit", "r2_live_status", "s5_csv_lines",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    if names == ["all"]:
        names = list(catalog.PLANS)
    partitions = None if cpus == "*" else int(cpus)
    spark = build_session("bench", f"local[{cpus}]", partitions, {"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs, plans = {}, catalog.queries()
    for name in names:
        best = None
        for _ in range(2):  # the second run is warm
            start = time.perf_counter()
            plans[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        runs[name] = round(best, 3)
    total = round(sum(runs.values()), 3)
    print(json.dumps({"metric": "headline queries, warm wall clock", "value": total, "unit": "sec", "queries": runs,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
