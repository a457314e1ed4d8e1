import json

import pytest
from pyspark.sql import functions as F

from seclake.operators import parse
from seclake.plans import reports
from seclake.sinks import alerts, files, siem
from seclake.sources.cases import read_cases
from seclake.sources.lines import read_lines, stream_lines
from seclake.streaming import live

LOG = """\
Apr 10 14:23:05 s sshd[1]: Failed password for root from 10.0.0.55 port 1 ssh2
Apr 10 14:23:10 s sshd[1]: Failed password for root from 10.0.0.55 port 2 ssh2
Apr 10 14:23:15 s sshd[1]: Accepted password for user=amy from 185.220.101.4 port 3 ssh2
hello
Apr  9 14:23:15 s sudo: user=amy COMMAND=/bin/cat /etc/shadow
"""

CASES = '''\
timestamp,host,process,event_type,message,source_ip,destination_ip,user
Apr 22 08:00:00,h,fw,exfil,"sent ""big"" file, 2 GB",45.1.1.1,10.0.0.1,
Apr 22 08:00:09,h,fw,,,,,;
'''


@pytest.fixture
def logs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(LOG)
    return str(tmp_path / "logs")


@pytest.fixture
def scored(spark, logs):
    return parse.score(parse.parse_lines(read_lines(spark, logs), 2024))


def test_case_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CASES)
    rows = read_cases(spark, str(tmp_path / "c.csv"), 2024).orderBy("seq").collect()
    assert rows[0].message == 'sent "big" file, 2 GB' and rows[0].user == "" and rows[0].raw_message is None
    assert (rows[1].event_type, rows[1].message, rows[1].user) == ("", "", ";")
    assert str(rows[0].event_ts) == "2024-04-22 08:00:00"


def test_documents(scored):
    docs = siem.to_siem_docs(scored)
    doc = json.loads(siem.to_docs(docs).first().value)
    assert doc["source.ip"] == "10.0.0.55" and doc["event.kind"] == "event" and doc["mitre_tactic"] == ""
    assert list(doc)[:3] == ["@timestamp", "event.kind", "event.category"]
    action, body = siem.to_bulk_ndjson(docs, "i").first().value.split("\n")
    assert json.loads(action) == {"index": {"_index": "i"}} and json.loads(body) == doc
    assert json.loads(siem.to_hec(docs).first().value)["event"] == doc
    unscored = siem.to_siem_docs(scored.drop("severity", "host").withColumn("host", F.lit(None).cast("string")))
    row = unscored.first()
    assert row["log.level"] == "info" and row["log.source.name"] == "unknown" and row["host.name"] == ""


def test_export(spark, scored, tmp_path):
    path = str(tmp_path / "out")
    assert siem.export(scored, "Elasticsearch", path) == {"status": "success", "exported": 4, "failed": 0}
    assert spark.read.text(path).count() == 8
    assert siem.export(scored, "nowhere", path)["status"] == "unknown_provider"
    assert siem.export(scored.where("false"), "splunk", str(tmp_path / "none")) == {"status": "no_events", "exported": 0}
    siem.register_target("lines", lambda docs: docs.selectExpr("message as value"))
    assert siem.export(scored, "lines", str(tmp_path / "l"))["exported"] == 4


def test_files(spark, scored, tmp_path):
    files.write_csv(scored, str(tmp_path / "csv"))
    files.write_json(scored, str(tmp_path / "json"))
    files.write_table(scored, str(tmp_path / "table"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert spark.read.json(str(tmp_path / "json")).where("source_ip = '10.0.0.55'").count() == 2
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.where("event_date = date'2024-04-09'").count() == 1


def test_table_of_days(spark, events, tmp_path):
    days = ["2024-04-09 10:00:00", "2024-04-10 10:00:00", "1970-01-01 00:00:00", None]
    rows = events([{"seq": i, "event_ts": days[i % 4], "raw_message": "x"} for i in range(800)]).repartition(8)
    files.write_table(rows, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*/*.parquet"))) == 4  # not one for each day and task
    table = spark.read.parquet(str(tmp_path / "t"))
    counts = {str(r.event_date): r["count"] for r in table.groupBy("event_date").count().collect()}
    assert counts == {"2024-04-09": 200, "2024-04-10": 200, "1970-01-01": 200, "None": 200}
    assert table.where("event_date is null and event_ts is not null").count() == 0
    files.write_table(rows.limit(0), str(tmp_path / "none"))


def test_alerts_and_tickets(scored):
    rows = alerts.to_alerts(scored, "medium").orderBy("seq").collect()
    assert [r.severity for r in rows] == ["MEDIUM", "MEDIUM", "CRITICAL"]
    assert alerts.to_alerts(scored, "bogus").count() == 3 + 0 + scored.where("severity = 'low'").count()
    assert alerts.to_alerts(scored, "critical", show_all=True).count() == 4
    assert {(r.severity, r.alerts) for r in alerts.alert_summary(alerts.to_alerts(scored, "medium")).collect()} == {
        ("MEDIUM", 2), ("CRITICAL", 1), ("TOTAL", 3)}
    assert [r.message for r in alerts.last_alerts(alerts.to_alerts(scored), 1).collect()][0].endswith("shadow")
    ticket = alerts.to_tickets(alerts.to_alerts(scored, "critical"), tags=("a", "seclake"), workflow=True).first()
    assert (ticket.priority, ticket.category, ticket.status, ticket.tags) == (
        "P1", "security_incident", "open", ["seclake", "a"])
    odd = scored.limit(1).withColumn("severity", F.lit("odd"))
    plain = alerts.to_tickets(alerts.to_alerts(odd, show_all=True)).first()
    assert plain.priority == "P3" and "status" not in plain.asDict()


def test_reports(spark, scored, tmp_path):
    report = reports.incident_report(scored)
    summary = report["summary"].first()
    assert (summary.total_events, summary.critical, summary.medium) == (4, 1, 2)
    assert [(r.ip, r.reputation) for r in report["threat_intel"].collect()] == [("185.220.101.4", "malicious")]
    # Text order: "Apr  9" before "Apr 10".
    assert report["timeline"].first().severity == "CRITICAL"
    checks = reports.triage_table(scored, threshold=2).collect()
    assert ("failed_logins", "10.0.0.55: 2 failed attempts") in [tuple(r) for r in checks]
    board = reports.dashboard(scored)
    reports.write_tables(board, str(tmp_path / "board"))
    assert list(board)[:3] == ["totals", "hourly", "severity"]
    assert spark.read.parquet(str(tmp_path / "board" / "hourly")).count() == 24


# --- streams ----------------------------------------------------------------

def test_stream_equals_batch(spark, logs, scored):
    columns = ["event_type", "source_ip", "user", "severity"]
    streamed = live.catch_up(live.stream_events(stream_lines(spark, logs), 2024).select(*columns), "t")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, scored.select(*columns).collect()))
    found = live.catch_up(live.stream_alerts(stream_lines(spark, logs), "medium", 2024), "t")
    assert found.count() == 3


def test_follow_from_now_on(spark, logs):
    later = stream_lines(spark, logs, process_existing=False, started_at="2999-01-01 00:00:00")
    assert live.catch_up(later, "t").count() == 0
    earlier = stream_lines(spark, logs, process_existing=False, started_at="2000-01-01 00:00:00")
    assert live.catch_up(earlier, "t").count() == 5


def test_micro_batches_and_recent_alerts(spark, logs, tmp_path):
    import os

    os.utime(f"{logs}/a.log", (1, 1))
    (tmp_path / "logs" / "b.log").write_text(LOG.replace("14:", "15:"))
    rows = live.stream_alerts(stream_lines(spark, logs, files_per_trigger=1), "medium", 2024)
    recent = live.RecentAlerts(str(tmp_path / "recent"), keep=2)
    sizes = []

    def callback(batch, batch_id):
        sizes.append(batch.count())
        recent(batch, batch_id)

    query = live.micro_batches(rows, callback, str(tmp_path / "cp"), seconds=0.1)
    query.processAllAvailable()
    query.stop()
    assert sizes == [3, 3]
    kept = recent.read(spark, 1, rows.schema).collect()
    assert sorted(r.timestamp for r in kept) == ["Apr 10 15:23:05", "Apr 10 15:23:10"]


def test_recent_alerts_start_at_any_batch(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "seq BIGINT, event_ts STRING").selectExpr("seq", "cast(event_ts as timestamp) as event_ts")

    recent = live.RecentAlerts(str(tmp_path / "recent"), keep=2)
    recent(batch((1, "2024-01-01 00:00:01"), (2, None), (3, None)), 7)
    recent(batch((4, None)), 9)
    recent(batch((4, None)), 9)  # repeated
    schema = batch().schema
    assert sorted(r.seq for r in recent.read(spark, 8, schema).collect()) == [1, 3]
    assert sorted(r.seq for r in recent.read(spark, 9, schema).collect()) == [1, 4]


def test_streams_end_with_nothing_open(spark, tmp_path):
    from seclake.operators import bursts

    events = spark.createDataFrame(
        [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:05:00", "a"), ("2024-01-01 09:00:00", "b"), ("2024-01-01 09:01:00", "b")],
        "at STRING, source_ip STRING").selectExpr(
        "cast(at as timestamp) as event_ts", "'fail' as event_type", "source_ip", "cast(null as string) as user")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    found = live.catch_up_closed(stream, lambda rows: live.stream_sessions(rows, 10, delay="1 day"), "t").collect()
    whole = bursts.attack_sessions(events, 10).collect()
    assert sorted((r.source, r.started_at, r.attempts) for r in found) == sorted(
        (r.source, r.started_at, r.attempts) for r in whole)


def test_tickets_have_the_whole_text(scored):
    long = scored.limit(1).withColumn("raw_message", F.lit("x" * 500))
    whole = alerts.to_tickets(alerts.to_alerts(long, show_all=True, length=None)).first()
    assert whole.description == "x" * 500
