"""Compositions: triage summary, incident report, dashboard.

Counts, distinct values, tactics, hours and phases come from one scan, as a narrow table of facets; no event is
copied.  Lists of single events are read from the events themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import q
from ..operators import bursts, correlate, detections, facets, intel, summary, timeline
from ..session import literal_table, materialize


def _facets(events: DataFrame) -> DataFrame:
    return materialize(facets.facet_counts(events), "facets")


def _overview(counts: DataFrame) -> DataFrame:
    return counts.selectExpr(
        f"coalesce(sum(events) filter (where facet = {q(facets.TOTAL)}), 0) as total_events",
        f"count_if(facet = {q(facets.SOURCE)}) as unique_ips",
        f"count_if(facet = {q(facets.USER)}) as unique_users",
    )


def triage(events: DataFrame, threshold: int = 5) -> dict[str, DataFrame]:
    """Result of every check, by name; the lists of single events are under ``findings``, with their check."""
    counts = _facets(events)
    sources = facets.of(counts, facets.SOURCE, "source_ip")
    return {
        "failed_logins": bursts.failed_login_bursts(events, threshold).orderBy(F.desc("attempts"), "source").limit(10),
        "findings": detections.findings(events),
        "suspicious_ips": detections.suspicious_ips(sources),
        "mitre_tactics": summary.described_tactics(facets.of(counts, facets.TACTIC)).withColumn(
            "item", F.format_string("%s: %d", "mitre_tactic", "events")),
        "mitre_samples": summary.mitre_samples(events).withColumnRenamed("sample", "item"),
        "unique_users": facets.of(counts, facets.USER, "item"),
        "unique_sources": facets.of(counts, facets.SOURCE, "item"),
        "event_summary": facets.of(counts, facets.TYPE).withColumn("item", F.format_string("%s: %d", "value", "events")),
    }


def triage_table(events: DataFrame, threshold: int = 5) -> DataFrame:
    """All checks in one table (check, item)."""
    parts = [
        rows.select("check" if name == "findings" else F.lit(name).alias("check"), "item")
        for name, rows in triage(events, threshold).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def incident_report(events: DataFrame) -> dict[str, DataFrame]:
    """The tables of an incident report."""
    counts = _facets(events)
    levels = [f"coalesce(sum(events) filter (where facet = {q(facets.SEVERITY)} and value = {q(level)}), 0) as {level}"
              for level in fixed.SEVERITIES]
    total = f"coalesce(sum(events) filter (where facet = {q(facets.TOTAL)}), 0) as total_events"
    brute = facets.of(counts, facets.FAILING, "source_ip").selectExpr("source_ip", "events as attempts")
    return {
        "summary": counts.selectExpr(total, *levels),
        "assets": _overview(counts),
        "threat_intel": intel.intel_lookup(facets.of(counts, facets.SOURCE, "source_ip")).where("reputation <> 'unknown'"),
        "correlations": correlate.campaigns(brute, correlate.listed_campaigns(events)),
        "tactics": summary.described_tactics(facets.of(counts, facets.TACTIC)),
        "timeline": timeline.timeline(events.drop("severity")).selectExpr(
            "seq", "timestamp", "upper(severity) as severity", "event_type", "source_ip", "user",
            "left(message, 50) as message"),
    }


def dashboard(events: DataFrame) -> dict[str, DataFrame]:
    """The tables of the dashboard, in display order, all from one scan."""
    counts = _facets(events)
    phases = literal_table(events.sparkSession, "position, phase", [
        f"({i}, {q(phase)})" for i, phase in enumerate(fixed.PHASE_WORDS, start=1)])
    return {
        "totals": _overview(counts),
        "hourly": summary.dense_hours(facets.of(counts, facets.HOUR, "hour").selectExpr("cast(hour as int) as hour", "events as n")),
        "severity": summary.shares(facets.of(counts, facets.STORED, "severity").selectExpr("severity", "events as n")),
        "top_sources": summary.top_counts(facets.of(counts, facets.SOURCE)),
        "top_users": summary.top_counts(facets.of(counts, facets.USER)),
        "event_types": summary.top_counts(facets.of(counts, facets.TYPE), 15, label=20),
        "attack_phases": facets.of(counts, facets.PHASE, "phase").join(F.broadcast(phases), "phase").select(
            "position", "phase", "events").orderBy("position"),
        "geography": detections.origins(facets.of(counts, facets.SOURCE, "source_ip")),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")
