"""Headline queries, one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is drained into the ``noop`` sink, so all rows and columns are
computed and nothing is collected.  One small query warms the JVM up first.
"""
from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "P1_normalize_url", "X1_outlinks", "X2_external_scripts", "X3_forms", "X8_cookie_banner", "X10_main_text_monitor",
    "X12_visible_text", "P12_policy_flags", "P12_flags_other_language", "W3_site_scripts_first_seen",
    "W5_best_policy", "W9_crawl_frontier", "C13_C16_policy_checks", "A1_A2_score_and_counts",
    "J4_violations_with_fines", "A14_violation_groups", "W1_previous_snapshot", "W2_parse_warnings",
    "D1_unified_diff", "D3_change_class", "D5_legal_changes", "D7_A13_digest_text", "J9_affected_documents",
    "D9_S8_filled_templates", "ST1_snapshot_change_stream",
)


def main() -> None:
    from auditspan.session import local_session
    from workload import all_queries

    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    queries["P2_site_key"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    counts = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("pages", "documents", "events")}
    rates = {
        "pages_per_sec_reports": round(counts["pages"] / timings["A1_A2_score_and_counts"], 1),
        "pages_per_sec_visible_text": round(counts["pages"] / timings["X12_visible_text"], 1),
        "documents_per_sec_flags": round(counts["documents"] / timings["P12_flags_other_language"], 1),
        "snapshots_per_sec_previous": round(counts["events"] / timings["W1_previous_snapshot"], 1),
    }
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
