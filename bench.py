"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlight.plans import carriers, registry  # noqa: E402
from wardlight.session import local_session  # noqa: E402
from wardlight.sources.corpus import explode_lines, read_table  # noqa: E402

HEADLINE = [
    "scan_documents", "line_rule_pass", "score_by_source", "payload_findings", "server_findings",
    "correlated_chains", "step_sequence_text", "source_sink_events", "document_chains",
    "attack_paths", "policy_status", "baseline_annotate", "baseline_counts", "lab_summary",
    "benchmark_summary", "coverage_status", "whole_scan_findings", "whole_scan_targets",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    n_lines = explode_lines(read_table(spark, folder, "documents").select("doc_id", "text")).count()
    n_scanned = carriers.seeded_lines(spark, folder).count()

    def run(name: str) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    run("scan_documents")  # start the workers and compile once
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        run(name)
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        # the whole scan: findings, chains, graph, paths, checks and verdicts; then the line rules alone
        "lines": n_scanned, "lines_per_sec": round(n_scanned / seconds["whole_scan_targets"], 1),
        "rule_lines_per_sec": round(n_lines / seconds["scan_documents"], 1),
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
