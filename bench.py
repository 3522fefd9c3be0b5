"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the local cores.
Every query is run to its last row and column (``noop`` sink), after one run over
the smallest tables next to them, so that class loading and code generation are
not counted as throughput.  Tables that are stored once per application are timed
apart, as ``prepare_*``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from risklens.plans import views  # noqa: E402
from risklens.plans.queries import QUERIES, corpus_edges  # noqa: E402
from risklens.session import build_session  # noqa: E402

HEADLINE = [
    "scan_repository", "units_functions", "rule_scan", "import_edges", "dep_bfs", "dep_reverse", "context_bundle",
    "graph_stats", "rank_findings", "number_findings", "verify_budget", "risk_final", "summary_audit",
    "topk_per_band", "verify_merge", "issue_dedupe", "verdict_parse", "first_success", "chat_assemble",
    "stream_session_state",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            _run(QUERIES[name](spark, warm_dir))
    seconds: dict[str, float] = {}
    prepared = {"prepare_findings": views.findings, "prepare_graph": views.graph, "prepare_edges": corpus_edges}
    for name, view in prepared.items():
        start = time.perf_counter()
        view(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        _run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    n_files = views.files(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "graph_files_per_sec": round(n_files / seconds["import_edges"]),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
