"""Every job as a query over a directory of parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network, times
from ..functions.parsers import LineParser, default_parsers
from ..operators import (
    anomaly, bursts, correlate, detections, intel, parse, rules, series, summary, timeline,
)
from ..schema import CASE, EVENT_FIELDS, VERDICT
from ..session import materialize, scratch_path
from ..sinks import alerts, files, siem
from ..sources import derived
from ..sources import follow
from ..sources.cases import read_cases
from ..sources.lines import message_lines, read_lines
from ..sources.lines import stream_lines as follow_files
from ..sources.rulefile import load_rules
from ..streaming import live
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUSTOM_RULES = [
    {"id": "R101", "name": "Custom Brute Force", "severity": "high",
     "patterns": ["failed", "password"], "threshold": 3,
     "mitre_tactic": "Credential Access", "mitre_technique": "T1110"},
    {"id": "R102", "name": "Session By Root", "severity": "low",
     "patterns": [r"user\d+5 by", "*bad["]},
    {"id": "R001", "name": "Shadowed", "severity": "critical", "patterns": ["ssh"]},
    {"id": "R103", "name": "Switched Off", "severity": "high", "patterns": ["ssh"], "enabled": False},
    {"name": "Without Id", "severity": "notice", "patterns": ["cron", "useradd"]},
]


PATTERN_RULES = [
    {"id": "P1", "name": "Named Group", "severity": "high", "patterns": [r"from (?P<src_ip>\d+\.\d+)\.0\."]},
    {"id": "P2", "name": "Named Reference", "severity": "low", "patterns": [r"(?P<one_s>s)(?P=one_s)hd"]},
    {"id": "P3", "name": "Repeats From Zero", "severity": "low", "patterns": [r"port 1[0-9]{,3} ssh"]},
    {"id": "P4", "name": "Class With Bracket", "severity": "low", "patterns": [r"cron[[a]\d+", r"[]&&x]uid=0"]},
    {"id": "P5", "name": "Broken", "severity": "low", "patterns": ["(uid=0"]},
    {"id": "P6", "name": "Comment And Brace", "severity": "low", "patterns": [r"(?#note)(?u:sudo): user{?=\w+5\b"]},
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# The columns used of the events table; naming them saves reading the file footers first.
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING"


# --- inputs -----------------------------------------------------------------

#: Rows of events which a task parses.
TASK_ROWS = 50_000


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt out evenly whatever the files are like: a row group is read by one task, however large it is.

    By all columns, so rows without an id are spread as well.
    """
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    tasks = -(-events.count() // TASK_ROWS)
    return events.repartition(max(tasks, spark.sparkContext.defaultParallelism), *events.columns)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.log_lines(base(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_lines(lines(spark, sf_dir), derived.YEAR)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.score(events(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.case_rows(base(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = derived.intel_feed(base(spark, sf_dir))
    return intel.latest_verdicts(intel.normalize_verdicts(feed, ("seq",)), "seq")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _joined(*columns: str):
    return {c: F.array_join(c, ",") for c in columns}


# --- parsing ----------------------------------------------------------------

_EVENT_COLUMNS = [c for c in EVENT_FIELDS if c != "message"]


def _shown(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr(
        "file", "seq", "format", f"{times.clock('event_ts')} as event_time", *_EVENT_COLUMNS
    )


@query
def parsed_events(spark, d):
    return _shown(events(spark, d))


@query
def parsed_files(spark, d):
    """Whole files with the per-file fallback format."""
    return _shown(parse.parse_logs(lines(spark, d), "auto", derived.YEAR))


@query
def parsed_cloudtrail(spark, d):
    """Lines with groups, policies and responses."""
    full = lines(spark, d).withColumn("line", F.expr(derived.CLOUDTRAIL_SQL))
    return _shown(parse.parse_lines(full, derived.YEAR).where("format = 'cloudtrail'"))


@query
def parsed_as_auth(spark, d):
    return _shown(parse.parse_logs(lines(spark, d), "auth", derived.YEAR))


@query
def parsed_as_syslog(spark, d):
    return _shown(parse.parse_logs(lines(spark, d), "syslog", derived.YEAR))


@query
def rejected_as_ssh(spark, d):
    return parse.rejects(lines(spark, d), "ssh")


@query
def format_counts(spark, d):
    return parse.format_counts(lines(spark, d))


@query
def file_formats(spark, d):
    return parse.file_formats(lines(spark, d))


@query
def severity_scored(spark, d):
    return scored(spark, d).select("seq", "event_type", "severity")


@query
def severity_scored_cases(spark, d):
    return parse.score(cases(spark, d)).select("seq", "event_type", "severity")


# --- summaries --------------------------------------------------------------

@query
def severity_counts(spark, d):
    return summary.severity_counts(scored(spark, d))


@query
def severity_distribution(spark, d):
    return _rounded(summary.severity_distribution(scored(spark, d)), "percent")


@query
def overview(spark, d):
    return summary.overview(events(spark, d))


@query
def event_summary(spark, d):
    return summary.event_summary(events(spark, d))


@query
def unique_users(spark, d):
    return summary.distinct_values(events(spark, d), "user")


@query
def unique_sources(spark, d):
    return summary.distinct_values(events(spark, d), "source_ip")


@query
def mitre_tactics(spark, d):
    return summary.mitre_tactics(events(spark, d))


@query
def mitre_samples(spark, d):
    return summary.mitre_samples(events(spark, d))


@query
def hourly_timeline(spark, d):
    return summary.hourly_timeline(events(spark, d))


@query
def top_sources(spark, d):
    return summary.top_sources(events(spark, d))


@query
def top_users(spark, d):
    return summary.top_users(events(spark, d))


@query
def top_event_types(spark, d):
    return summary.top_event_types(events(spark, d))


@query
def geo_distribution(spark, d):
    return detections.geo_distribution(events(spark, d))


@query
def attack_phases(spark, d):
    return detections.attack_phases(events(spark, d))


@query
def attack_phases_cases(spark, d):
    return detections.attack_phases(cases(spark, d))


@query
def internal_sources(spark, d):
    return (
        events(spark, d)
        .selectExpr(f"int({network.is_internal('source_ip')}) as internal")
        .groupBy("internal")
        .agg(F.count("*").alias("events"))
    )


@query
def events_per_minute(spark, d):
    counts = summary.events_per_minute(events(spark, d))
    return counts.selectExpr(f"{times.clock('minute')} as minute", "events")


@query
def activity_levels(spark, d):
    """Events per minute reduced to fifty points on nine levels."""
    counts = summary.events_per_minute(events(spark, d))
    return series.levels(
        counts.selectExpr("unix_timestamp(minute) as minute", "events"), "minute", "events"
    )


@query
def timeline_all(spark, d):
    return timeline.timeline(events(spark, d)).drop("event_ts")


@query
def timeline_top20(spark, d):
    return timeline.timeline_by_severity(events(spark, d)).drop("event_ts")


@query
def display_view(spark, d):
    return summary.display_view(events(spark, d))


# --- detections -------------------------------------------------------------

@query
def failed_login_bursts(spark, d):
    return bursts.failed_login_bursts(events(spark, d))


@query
def failed_login_bursts_top10(spark, d):
    return bursts.failed_login_bursts(events(spark, d)).orderBy(F.desc("attempts"), "source").limit(10)


@query
def failed_login_bursts_cases(spark, d):
    """All rows share one user: the hot-group case."""
    return bursts.failed_login_bursts(cases(spark, d))


@query
def failed_login_bursts_windowed(spark, d):
    return bursts.failed_login_bursts_windowed(events(spark, d), threshold=2, minutes=600)


@query
def attack_sessions(spark, d):
    return bursts.attack_sessions(events(spark, d), gap_minutes=720)


def untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events parsed without a year: header times stay unknown."""
    return parse.parse_lines(lines(spark, sf_dir))


@query
def bursts_untimed(spark, d):
    return bursts.failed_login_bursts_windowed(untimed(spark, d), threshold=2, minutes=600)


@query
def attack_sessions_untimed(spark, d):
    return bursts.attack_sessions(untimed(spark, d), gap_minutes=720)


@query
def auth_failures(spark, d):
    return detections.auth_failures(events(spark, d)).select("seq", "source_ip", "user")


@query
def new_accounts(spark, d):
    return detections.new_accounts(events(spark, d))


@query
def suspicious_ips(spark, d):
    return detections.suspicious_ips(events(spark, d))


@query
def privilege_escalation(spark, d):
    return detections.privilege_escalation(events(spark, d))


@query
def privilege_escalation_cases(spark, d):
    return detections.privilege_escalation(cases(spark, d))


@query
def lateral_movement(spark, d):
    return detections.lateral_movement(cases(spark, d))


@query
def data_exfiltration(spark, d):
    return detections.data_exfiltration(events(spark, d))


@query
def data_exfiltration_cases(spark, d):
    return detections.data_exfiltration(cases(spark, d))


_CAMPAIGN = ("campaign", "key", "attempts", "position", "seq", *EVENT_FIELDS)


@query
def correlate_logs(spark, d):
    return correlate.correlate(events(spark, d)).select(*_CAMPAIGN)


@query
def correlate_cases(spark, d):
    return correlate.correlate(cases(spark, d)).select(*_CAMPAIGN)


@query
def port_scan_campaigns(spark, d):
    return correlate.port_scan_campaigns(events(spark, d), minutes=1440, min_targets=2)


@query
def port_scan_campaigns_cases(spark, d):
    return correlate.port_scan_campaigns(cases(spark, d), minutes=1440, min_targets=2)


@query
def port_scan_sliding(spark, d):
    return correlate.port_scan_sliding(events(spark, d), minutes=720, min_targets=2)


@query
def port_scan_sliding_cases(spark, d):
    return correlate.port_scan_sliding(cases(spark, d), minutes=720, min_targets=2)


# --- rules ------------------------------------------------------------------

def _rule_rows(result: DataFrame) -> DataFrame:
    seqs = F.transform("sample_records", lambda s: s["seq"].cast("string"))
    return result.withColumn("samples", F.array_join(seqs, ",")).drop("sample_records")


@query
def rules_builtin(spark, d):
    return _rule_rows(rules.run_rules(events(spark, d)))


@query
def rules_builtin_cases(spark, d):
    return _rule_rows(rules.run_rules(cases(spark, d)))


def _strict_rules() -> list[rules.Rule]:
    return [
        rules.Rule(**{**vars(r), "threshold": 2, "time_window": 43_200}) if r.id == "R001" else
        rules.Rule(**{**vars(r), "threshold": 10}) if r.id == "R007" else r
        for r in rules.builtin_rules()
    ]


@query
def rules_thresholded(spark, d):
    return rules.run_rules(events(spark, d), _strict_rules(), samples=0, thresholds=True)


@query
def rules_thresholded_untimed(spark, d):
    return rules.run_rules(untimed(spark, d), _strict_rules(), samples=0, thresholds=True)


@query
def rules_patterns(spark, d):
    """Patterns in the dialect of rule files."""
    return _rule_rows(rules.run_rules(events(spark, d), rules.merge_rules([], PATTERN_RULES)))


@query
def rules_custom_merge(spark, d):
    merged = rules.merge_rules(rules.builtin_rules(), CUSTOM_RULES)
    return _rule_rows(rules.run_rules(events(spark, d), merged))


def thousand_rules() -> list[rules.Rule]:
    """A rule for each of many users, addresses and ports."""
    kinds = (
        lambda i: [f"user{i} from"],
        lambda i: [rf"user=user{i}\s+COMMAND="],
        lambda i: [rf"(session opened|account created) for user{i} by"],
        lambda i: [rf"src 10\.0\.0\.{i % 200} dst", rf"port {1024 + i}\b"],
    )
    return [rules.Rule(f"G{i:04d}", f"Generated {i}", severity="low", patterns=tuple(kinds[i % 4](i))) for i in range(1000)]


@query
def rules_thousand(spark, d):
    return _rule_rows(rules.run_rules(events(spark, d), thousand_rules()))


UNICODE_RULES = [
    {"id": "U1", "name": "Class", "patterns": [r"USER\w+É by"]},
    {"id": "U2", "name": "Folded", "patterns": ["ren[É] "]},
    {"id": "U3", "name": "Edge", "patterns": [r"für\b", r"\büser\d*5\b"]},
]


@query
def rules_unicode(spark, d):
    """Patterns and text beyond ASCII."""
    foreign = events(spark, d).withColumn("raw_message", F.expr(
        "case seq % 5 when 0 then replace(raw_message, ' by', 'É by') when 1 then replace(raw_message, 'user', 'üser') "
        "when 2 then concat('René ', raw_message) when 3 then concat('für', raw_message) else raw_message end"))
    return _rule_rows(rules.run_rules(foreign, rules.merge_rules([], UNICODE_RULES)))


@query
def rules_summary(spark, d):
    return rules.rule_summary(rules.run_rules(events(spark, d), samples=0))


# --- anomalies --------------------------------------------------------------

_STATS = ("mean", "std_dev", "min_val", "max_val", "median", "p95", "p99")


@query
def baseline_stats(spark, d):
    return _rounded(anomaly.baselines(events(spark, d)), *_STATS)


@query
def baseline_source_port(spark, d):
    return _rounded(anomaly.baseline(events(spark, d), "source_port"), *_STATS)


@query
def baseline_infinite(spark, d):
    """A field with values which are not finite."""
    odd = events(spark, d).withColumn("source_port", F.expr(
        "case when coalesce(source_port, '') = '' then source_port when seq % 40 = 3 then 'Infinity' when seq % 40 = 23 then '-Infinity' "
        "when seq % 40 = 4 then '-' || source_port else source_port end"))
    return anomaly.baseline(odd, "source_port").select("metric", "min_val", "max_val", "median", "p95", "p99", "sample_count")


@query
def baseline_events_per_minute(spark, d):
    return _rounded(anomaly.baseline(events(spark, d), "events_per_minute"), *_STATS)


def _anomaly_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "metric", "severity", F.round("value", 6).alias("value"),
        F.round("expected_range.low", 6).alias("low"), F.round("expected_range.high", 6).alias("high"),
        F.round("deviation", 6).alias("deviation"), F.round("z_score", 2).alias("z_score"),
    )


@query
def anomalies(spark, d):
    return _anomaly_rows(anomaly.detect_anomalies(events(spark, d)))


@query
def anomalies_against_cases(spark, d):
    """Log events compared with the structured rows as baseline."""
    return _anomaly_rows(anomaly.metric_anomalies(events(spark, d), cases(spark, d)))


@query
def anomalies_empty_baseline(spark, d):
    """An empty baseline counts as none."""
    return _anomaly_rows(anomaly.metric_anomalies(events(spark, d), cases(spark, d).where("false")))


@query
def anomaly_summary(spark, d):
    found = anomaly.anomaly_summary(anomaly.detect_anomalies(events(spark, d)))
    return found.withColumns(_joined("metrics_affected"))


@query
def off_hours(spark, d):
    """On failed logins of the structured rows, whose hours are uneven enough."""
    return _anomaly_rows(anomaly.off_hours(cases(spark, d)))


@query
def single_source_flood(spark, d):
    return _anomaly_rows(anomaly.single_source_flood(events(spark, d)))


@query
def minute_rate_anomalies(spark, d):
    return _rounded(anomaly.minute_rate_anomalies(events(spark, d)), "z_score", digits=4)


@query
def minute_rate_anomalies_dense(spark, d):
    """Silent minutes counted as zeros."""
    return _rounded(anomaly.minute_rate_anomalies_dense(events(spark, d)), "z_score", digits=4)


# --- threat intelligence ----------------------------------------------------

@query
def intel_lookup(spark, d):
    return intel.intel_lookup(events(spark, d))


def _prefixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("185.220.", 0, "anonymizer"), ("185.220.101.", 1, "never reached"), ("10.", 2, "private"),
         ("192.168.1.", 3, "office"), ("45.33.32.10", 4, "one host"), ("45.", 5, "cloud")],
        "prefix STRING, priority INT, label STRING",
    )


@query
def prefix_lookup(spark, d):
    return intel.prefix_lookup(intel.source_ips(events(spark, d)), _prefixes(spark))


@query
def prefix_lookup_shuffled(spark, d):
    """As against a table too large to broadcast."""
    return intel.prefix_lookup(intel.source_ips(events(spark, d)), _prefixes(spark), broadcast_rows=0)


@query
def verdicts_normalized(spark, d):
    feed = derived.intel_feed(base(spark, d))
    return intel.normalize_verdicts(feed, ("seq",)).withColumns(_joined("categories", "tags"))


def _flat(aggregated: DataFrame) -> DataFrame:
    return aggregated.withColumns(_joined("providers_queried", "providers_available")).select(
        "*", "aggregated.*").drop("aggregated")


@query
def verdicts_aggregated(spark, d):
    return _flat(intel.enrich_ips(events(spark, d), verdicts(spark, d)))


@query
def verdict_details(spark, d):
    found = verdicts(spark, d)
    full = intel.with_details(intel.aggregate_verdicts(found.select("ip").distinct(), found), found)
    line = F.transform("details", lambda v: F.concat_ws(":", v["provider"], v["confidence"].cast("string")))
    return full.select("ip", F.array_join(line, ",").alias("details"))


@query
def ip_reputation(spark, d):
    found = verdicts(spark, d)
    return intel.ip_reputation(intel.aggregate_verdicts(found.select("ip").distinct(), found))


@query
def enrich_ips_local(spark, d):
    """Only the local table, as without any provider."""
    return _flat(intel.enrich_ips(events(spark, d))).select(
        "ip", F.when(F.col("is_malicious"), "MALICIOUS").otherwise("clean").alias("verdict"), "country")


@query
def enrich_events(spark, d):
    return _enriched(intel.enrich_events(events(spark, d), verdicts(spark, d)))


@query
def enrich_events_shuffled(spark, d):
    """As against a table too large to broadcast."""
    return _enriched(intel.enrich_events(events(spark, d), verdicts(spark, d), broadcast_rows=0))


def _enriched(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "source_ip", F.col("is_malicious").cast("int").alias("is_malicious"),
                       "malicious_votes", "max_confidence", "country")


# --- documents, alerts, tickets ---------------------------------------------

@query
def siem_docs(spark, d):
    docs = siem.to_siem_docs(scored(spark, d))
    return docs.toDF(*[c.replace("@", "").replace(".", "_") for c in docs.columns])


@query
def plain_docs(spark, d):
    return siem.to_docs(siem.to_siem_docs(scored(spark, d)))


@query
def bulk_ndjson(spark, d):
    return siem.to_bulk_ndjson(siem.to_siem_docs(events(spark, d)))


@query
def hec_payloads(spark, d):
    return siem.to_hec(siem.to_siem_docs(scored(spark, d)))


@query
def alerts_medium(spark, d):
    return alerts.to_alerts(scored(spark, d), "medium").drop("event_ts")


@query
def alerts_severe(spark, d):
    """What the live views show: the three upper levels, text cut after 80 characters."""
    return alerts.to_alerts(alerts.severe_only(scored(spark, d)), show_all=True, length=80).drop("event_ts")


@query
def alert_summary(spark, d):
    """Over the fifty newest alerts."""
    return alerts.alert_summary(alerts.last_alerts(alerts.to_alerts(scored(spark, d), "low")))


@query
def tickets(spark, d):
    rows = alerts.to_tickets(
        alerts.to_alerts(scored(spark, d), "high", length=None), tags=("triage",), workflow=True)
    return rows.withColumns(_joined("tags")).drop("created_at")


@query
def tickets_long(spark, d):
    """Of texts longer than an alert shows."""
    long = scored(spark, d).withColumn("raw_message", F.repeat("raw_message", F.lit(4))).where("length(raw_message) > 100")
    return alerts.to_tickets(alerts.to_alerts(long, show_all=True, length=None)).select(
        "seq", "description", "priority")


# --- compositions -----------------------------------------------------------

@query
def triage_summary(spark, d):
    return reports.triage_table(events(spark, d))


@query
def report_summary(spark, d):
    return reports.incident_report(events(spark, d))["summary"]


@query
def report_assets(spark, d):
    return reports.incident_report(events(spark, d))["assets"]


@query
def report_intel(spark, d):
    return reports.incident_report(events(spark, d))["threat_intel"]


@query
def report_correlations(spark, d):
    return reports.incident_report(events(spark, d))["correlations"].select(*_CAMPAIGN)


@query
def report_tactics(spark, d):
    return reports.incident_report(events(spark, d))["tactics"]


@query
def report_timeline(spark, d):
    return reports.incident_report(events(spark, d))["timeline"]


@query
def dashboard_totals(spark, d):
    return reports.dashboard(events(spark, d))["totals"]


@query
def dashboard_hourly(spark, d):
    return reports.dashboard(events(spark, d))["hourly"]


@query
def dashboard_severity(spark, d):
    return _rounded(reports.dashboard(scored(spark, d))["severity"], "percent")


@query
def dashboard_top_sources(spark, d):
    return reports.dashboard(events(spark, d))["top_sources"]


@query
def dashboard_top_users(spark, d):
    return reports.dashboard(events(spark, d))["top_users"]


@query
def dashboard_event_types(spark, d):
    return reports.dashboard(events(spark, d))["event_types"]


@query
def dashboard_attack_phases(spark, d):
    return reports.dashboard(events(spark, d))["attack_phases"]


@query
def dashboard_geography(spark, d):
    return reports.dashboard(events(spark, d))["geography"]


# --- streams ----------------------------------------------------------------

def stream_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.log_lines(stream_base(spark, sf_dir))


@query
def stream_events(spark, d):
    parsed = live.stream_events(stream_lines(spark, d), derived.YEAR)
    return live.catch_up(parsed.select("seq", "event_type", "source_ip", "user", "severity"), "events")


@query
def stream_alerts(spark, d):
    found = live.stream_alerts(stream_lines(spark, d), "high", derived.YEAR).drop("event_ts")
    return live.catch_up(found, "alerts")


@query
def stream_bursts(spark, d):
    parsed = parse.parse_lines(stream_lines(spark, d), derived.YEAR)
    return live.catch_up_closed(
        parsed, lambda rows: live.stream_bursts(rows, threshold=2, minutes=60, slide_minutes=30), "bursts")


@query
def stream_sessions(spark, d):
    parsed = parse.parse_lines(stream_lines(spark, d), derived.YEAR)
    return live.catch_up_closed(parsed, lambda rows: live.stream_sessions(rows, gap_minutes=120), "sessions")


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    """The lines as text below the shared folder, one folder per log file."""
    path = scratch_path(spark, "texts")
    lines(spark, sf_dir).selectExpr("file as name", "line as value").repartition("name").write.partitionBy(
        "name").text(path)
    return path


@query
def stream_text_alerts(spark, d):
    """Text files followed as a stream, four files to a batch."""
    followed = follow_files(spark, f"{written_lines(spark, d)}/*", files_per_trigger=4)
    return live.catch_up(live.stream_alerts(followed, "high", derived.YEAR).drop("event_ts"), "text-alerts")


# --- files ------------------------------------------------------------------

@query
def text_files_parsed(spark, d):
    """Text files read, parsed by line."""
    read = parse.parse_lines(read_lines(spark, written_lines(spark, d)), derived.YEAR)
    return read.selectExpr("format", f"{times.clock('event_ts')} as event_time", *_EVENT_COLUMNS)


@query
def case_files_scored(spark, d):
    """Case files read, with their severity."""
    path = scratch_path(spark, "cases")
    cases(spark, d).select(*CASE.fieldNames()).write.option("header", True).option("escape", '"').csv(path)
    return parse.score(read_cases(spark, path, derived.YEAR)).selectExpr(
        f"{times.clock('event_ts')} as event_time", *CASE.fieldNames(), "severity")


_WRITTEN = ("timestamp", "host", "user", "source_ip", "event_type", "raw_message", "severity")


@query
def csv_files(spark, d):
    """Scored events written as CSV and read back; missing and empty fields are alike there."""
    path = scratch_path(spark, "csv")
    files.write_csv(scored(spark, d), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.selectExpr("cast(seq as bigint) as seq", *[f"coalesce({c}, '') as {c}" for c in _WRITTEN])


@query
def json_files(spark, d):
    """Scored events written as JSON lines and read back."""
    path = scratch_path(spark, "json")
    files.write_json(scored(spark, d), path)
    schema = ", ".join(["seq BIGINT", *[f"{c} STRING" for c in _WRITTEN]])
    return spark.read.schema(schema).json(path)


@query
def table_files(spark, d):
    """Events written as a table with a folder for each day and read back; those without a time have no day."""
    path = scratch_path(spark, "table")
    files.write_table(untimed(spark, d), path)
    day = F.date_format(F.col("event_date").cast("date"), "yyyy-MM-dd").alias("event_date")
    return spark.read.parquet(path).select(day, "seq", "event_type", "source_ip", "user")


@query
def exported_hec(spark, d):
    """Payloads as the export writes them."""
    path = scratch_path(spark, "export")
    siem.export(scored(spark, d), "splunk", path)
    return spark.read.text(path)


@query
def stream_deduped(spark, d):
    """Each line arrives twice; the copies are dropped."""
    parsed = parse.parse_lines(stream_lines(spark, d), derived.YEAR).where(F.col("event_ts").isNotNull())
    twice = parsed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return live.catch_up(live.dedupe_replays(twice, ["seq"]).select("seq", "event_type"), "deduped")


# --- streams over several batches -------------------------------------------

def _write_texts(rows: DataFrame, folder: str) -> None:
    """Write ``file, seq, value`` as one file for each ``file``, its values in order.  Files are written anew."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name, out = None, None
        for batch in batches:
            for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if file != name:
                    if out:
                        out.close()
                    name, out = file, system.open_output_stream(f"{path}/{file}")
                out.write(value.encode())
        if out:
            out.close()
        yield pa.record_batch({"done": pa.array([1], pa.int32())})

    rows.repartition(derived.FILES, "file").sortWithinPartitions("file", "seq").select("file", "value").mapInArrow(
        run, "done int").write.format("noop").mode("overwrite").save()


@query
def stream_appended(spark, d):
    """Files followed by bytes, which grow between two runs; the first run ends inside a line of each."""
    folder = scratch_path(spark, "appended")
    text = lines(spark, d)
    half = base(spark, d).agg(F.expr("max(event_id) div 2")).scalar()
    broken = text.where(F.col("seq") > half).groupBy("file").agg(F.min("seq").alias("broken"))  # one row for each file
    first = text.join(F.broadcast(broken), "file", "left").where((F.col("seq") <= half) | (F.col("seq") == F.col("broken")))
    target = scratch_path(spark, "followed")
    for rows in (first.selectExpr("file", "seq", "if(seq <=> broken, left(line, 7), line || '\n') as value"),
                 text.selectExpr("file", "seq", "line || '\n' as value")):
        _write_texts(rows, folder)
        parsed = parse.parse_lines(follow.follow_lines(spark, folder, partition_bytes=1 << 16), derived.YEAR)
        live.append_to_table(parsed, f"{target}/table", f"{target}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{target}/table").selectExpr(
        "element_at(split(file, '/'), -1) as file", "format", f"{times.clock('event_ts')} as event_time", *_EVENT_COLUMNS)


PARTS = 4


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Scored events and the conditions of their parts in time order."""
    rows = materialize(scored(spark, sf_dir), "scored")
    second = "unix_timestamp(event_ts)"
    cuts = rows.selectExpr(f"percentile_approx({second}, array({', '.join(str(i / PARTS) for i in range(1, PARTS))}))").first()[0] or []
    lower = ["true", *[f"{second} >= {c}" for c in cuts]]
    upper = [*[f"{second} < {c}" for c in cuts], "true"]
    return rows, [f"{a} and {b}" for a, b in zip(lower, upper)]


class _Arriving:
    """A folder in which rows arrive in steps, and the stream of it."""

    def __init__(self, rows: DataFrame):
        self.rows, self.path = rows, scratch_path(rows.sparkSession, "arriving")
        rows.limit(0).write.parquet(self.path)

    def add(self, condition: str) -> None:
        self.rows.where(condition).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.rows.sparkSession.readStream.schema(self.rows.schema).parquet(self.path)


@query
def stream_replays(spark, d):
    """Events which are sent again in later files, within the delay and beyond it."""
    rows, conditions = parts(spark, d)
    arriving, target = _Arriving(rows), scratch_path(spark, "replays")
    for i, condition in enumerate(conditions):
        arriving.add(condition)
        for again in conditions[max(i - 2, 0):i]:
            arriving.add(f"{again} and seq % 3 = {i % 3}")
        once = live.dedupe_replays(arriving.stream(), ["seq"], "1 hour").select("seq", "event_type")
        live.append_to_table(once, f"{target}/table", f"{target}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{target}/table")


@query
def stream_recent_alerts(spark, d):
    """The fifty newest alerts after four batches, the last of which is repeated."""
    rows, conditions = parts(spark, d)
    arriving, target = _Arriving(rows), scratch_path(spark, "recent")
    recent = live.RecentAlerts(f"{target}/recent")
    for condition in conditions:
        arriving.add(condition)
        live.run_batches(alerts.to_alerts(arriving.stream(), "low"), recent, f"{target}/checkpoint")
    last = alerts.to_alerts(rows.where(conditions[-1]), "low")
    recent(last, PARTS - 1)
    return recent.read(spark, PARTS, last.schema).drop("event_ts")


@query
def stream_groups(spark, d):
    """Groups of ten events which go over four batches, the last one shorter."""
    rows = materialize(scored(spark, d).select("seq", "event_type", "source_ip"), "scored")
    part = (rows.agg(F.max("seq")).first()[0] or 0) // PARTS + 1
    arriving, target = _Arriving(rows.withColumn("part", F.floor(F.col("seq") / part))), scratch_path(spark, "groups")
    groups = live.RowGroups(target)
    for i in range(PARTS):
        arriving.add(f"part = {i}")
        live.run_batches(arriving.stream().drop("part"), groups, f"{target}/checkpoint")
    groups.flush(spark, rows.schema, PARTS)
    return groups.read(spark, rows.schema)


# --- own parts --------------------------------------------------------------

@query
def stream_callback(spark, d):
    """A function of one's own on each batch."""
    arriving, target = _Arriving(scored(spark, d).select("seq", "event_type", "severity")), scratch_path(spark, "callback")
    arriving.add("true")

    def callback(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("event_type", "severity").agg(F.count("*").alias("events")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    live.run_batches(arriving.stream(), callback, f"{target}-checkpoint")
    found = spark.read.schema("event_type string, severity string, events bigint").parquet(target)
    return found.groupBy("event_type", "severity").agg(F.sum("events").alias("events"))


@query
def messages_parsed(spark, d):
    """Messages as bytes, some not UTF-8, with their senders."""
    messages = lines(spark, d).selectExpr(
        "seq", "concat(encode(line, 'utf-8'), if(seq % 3 = 0, unhex('FF0A'), unhex('')) ) as value", "'10.9.0.' || seq % 5 as sender")
    received = message_lines(messages, source="sender")
    return parse.parse_lines(received, derived.YEAR, keep=("source_address",)).selectExpr(
        "source_address", "format", f"{times.clock('event_ts')} as event_time", *_EVENT_COLUMNS)


@query
def rules_from_file(spark, d):
    """Rules read from a JSON file below the shared folder."""
    import json

    path = f"{scratch_path(spark, 'rules')}.json"
    spark.createDataFrame([(json.dumps({"rules": CUSTOM_RULES}),)], "value string").coalesce(1).write.text(path)
    return _rule_rows(rules.run_rules(events(spark, d), load_rules(spark, path)))


@query
def own_parser(spark, d):
    """A parser of one's own for one format, the others as they are."""
    door = "case when contains({0}, 'Failed') then 'door_closed' when contains({0}, 'Accepted') then 'door_open' end"
    own = LineParser(lambda line, _: {"event_type": door.format(line), "raw_message": f"upper({line})"})
    return parse.parse_lines(lines(spark, d), derived.YEAR, {**default_parsers(), "ssh": own}).select(
        "seq", "format", "event_type", "raw_message", "host")


@query
def own_provider(spark, d):
    """A provider of one's own beside the known ones."""
    listed = {"provider": "'Blocklist'", "is_malicious": "true", "confidence": "99", "country": "'Nowhere'", "country_code": "'NO'"}
    defaults = {"boolean": "false", "int": "0", "string": "''", "array<string>": "cast(array() as array<string>)"}
    blocked = base(spark, d).where("user_id % 10 = 3").selectExpr(f"{derived.IP_SQL} as ip").distinct().selectExpr(
        "ip", *[f"{listed.get(f.name, defaults[f.dataType.simpleString()])} as {f.name}" for f in VERDICT.fields if f.name != "ip"])
    return _flat(intel.enrich_ips(events(spark, d), verdicts(spark, d).unionByName(blocked)))


@query
def own_target(spark, d):
    """An export target of one's own, as its files read."""
    siem.register_target("keyvalue", lambda docs: docs.selectExpr(
        "concat_ws(' ', 'type=' || `event.type`, 'src=' || `source.ip`, 'user=' || `user.name`) as value"))
    path = scratch_path(spark, "export")
    siem.export(scored(spark, d), "keyvalue", path)
    return spark.read.text(path)


@query
def exported_bulk(spark, d):
    """Payloads as the export writes them: action lines and documents."""
    path = scratch_path(spark, "export")
    siem.export(scored(spark, d), "elasticsearch", path)
    return spark.read.text(path)


@query
def exported_docs(spark, d):
    path = scratch_path(spark, "export")
    siem.export(scored(spark, d), "sumologic", path)
    return spark.read.text(path)
