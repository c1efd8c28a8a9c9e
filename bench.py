"""Headline queries, timed: one JSON line. BENCH_SF_DIR is the data set, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

from folioforge.plans import registry
from folioforge.session import build_session

HEADLINE = (
    "m0_account_costs",
    "agg07_statistics",
    "agg08_month_trend",
    "agg09_top_papers_by_cost",
    "agg12_cost_breakdown",
    "win01_latest_per_group",
    "win02_last_result_by_phase",
    "flt02_substring_search",
    "srt01_page",
    "rpt01_reports",
    "txt13_sections",
    "txt27_topic",
    "txt30_search",  # reads the written index, which is built before, untimed
    "txt31_phrase",
    "src08_changed_texts",
    "geo01_box_groups",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), "8g")
    queries = registry.queries()
    times = {}
    queries["txt30_search"](spark, sf_dir)
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    line = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    sys.stdout.write(json.dumps(line) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
