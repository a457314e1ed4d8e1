"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores), ``BENCH_QUERIES``
(comma-separated names, default: the list below), ``BENCH_TIMES`` (how often the events
are repeated under new ids, default 1; the larger tables go to a temporary folder).  Every
query is built and run to the end over its whole tables; the result goes to a sink which
keeps nothing.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from seclake.plans.registry import QUERIES
from seclake.session import build_session

HEADLINE = [
    "parsed_events", "parsed_files", "severity_scored", "overview", "event_summary", "hourly_timeline",
    "top_sources", "attack_phases", "timeline_all", "timeline_top20", "mitre_tactics",
    "failed_login_bursts", "failed_login_bursts_cases", "failed_login_bursts_windowed", "attack_sessions",
    "privilege_escalation", "suspicious_ips", "correlate_logs", "port_scan_campaigns", "rules_builtin",
    "rules_thousand", "rules_thresholded", "baseline_stats", "baseline_source_port", "anomalies", "events_per_minute",
    "verdicts_normalized", "verdicts_aggregated", "enrich_events", "bulk_ndjson", "hec_payloads",
    "alerts_medium", "triage_summary", "port_scan_sliding", "dashboard_totals", "stream_alerts", "stream_bursts",
]

WARM_UP = ["parsed_events", "severity_scored", "attack_phases", "failed_login_bursts_windowed"]


def _repeated(spark, sf_dir: str, times: int) -> str:
    """A folder with the events table ``times`` over, ids going on and each copy half a minute later."""
    folder = tempfile.mkdtemp(prefix="seclake-bench-")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.agg(F.max("event_id")).first()[0] + 1
    events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumns({
        "event_id": F.col("event_id") + F.col("copy") * n, "ts": F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 30 * copy)")}).drop(
        "copy").repartitionByRange(32, "event_id").write.parquet(f"{folder}/events.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "seclake-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = int(os.environ.get("BENCH_TIMES", "1"))
    if times > 1:
        sf_dir = _repeated(spark, sf_dir, times)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in WARM_UP:  # not timed: starts the engine and compiles the common code
        run(name)
    seconds = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/").rsplit("sf", 1)[-1],
        "times": times,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
