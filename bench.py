"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codestrata import plans
from codestrata.session import build_session

HEADLINE = [
    "filter_source_files", "scan_suspicious", "redact_text", "mask_fields", "explode_lines", "extract_functions", "extract_imports",
    "file_counts", "cyclomatic", "function_length", "file_summary", "rule_scan_security", "rule_scan_performance",
    "rule_scan_architecture", "legacy_obsolete_api", "legacy_rollup", "smell_feature_envy", "line_patterns", "dep_import_edges",
    "dep_impact", "dep_cycles", "peer_pairs", "contradictions", "project_totals", "preprocess_summary", "pack_batches", "batch_eta",
    "band_lookup", "architecture_assess", "token_estimate", "extract_json", "explode_analysis", "prose_findings", "keyword_scores",
    "validate_findings", "gt_match", "gt_metrics", "run_consistency", "run_similarity", "run_hash", "consensus", "title_conflicts",
    "team_report", "throttle_status", "rate_limit", "dedup_requests", "response_reuse", "usage_cost", "history_purge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    queries["detect_language"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not a query
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
