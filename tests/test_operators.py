import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seclake.operators import anomaly, bursts, correlate, detections, intel, joins, ordering, rules, series, summary
from seclake.sources.rulefile import load_rules


def collect(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_BITS", 3)


def failed_rows(n, seed=1):
    rnd = random.Random(seed)
    return [
        {
            "seq": i * 3,
            "event_type": rnd.choice(["ssh_login_fail", "LOGIN_FAILED", "other"]),
            "source_ip": rnd.choice(["", None, "1.1.1.1", "2.2.2.2", "2.2.2.2", "2.2.2.2"]),
            "user": rnd.choice(["", "", None, "amy", "bob"]),
            "event_ts": f"2024-01-01 {rnd.randrange(24):02d}:{rnd.randrange(60):02d}:{rnd.randrange(60):02d}",
        }
        for i in range(n)
    ]


def is_failed(row):
    return "fail" in row["event_type"].lower()


@pytest.mark.parametrize("blocked", [True, False])
def test_bursts_against_all_pairs(events, small_blocks, monkeypatch, blocked):
    if not blocked:
        monkeypatch.setattr(ordering, "BLOCK_BITS", 20)
    rows = failed_rows(200)
    failed = [r for r in rows if is_failed(r)]
    expected = set()
    for i, r in enumerate(failed):
        src = r["source_ip"] or r["user"]
        n = 1 + sum(
            (o["source_ip"] or "") == (r["source_ip"] or "") or (o["user"] or "") == (r["user"] or "")
            for o in failed[i + 1:]
        )
        if src and n >= 5:
            expected.add((src, n, f"{src}: {n} failed attempts"))
    assert set(collect(bursts.failed_login_bursts(events(rows)))) == expected


def test_count_ahead_on_text_order(spark, small_blocks):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), (f"f{f}", b * 100, r)) for f in range(3) for b in range(2) for r in range(40)]
    schema = "k STRING, seq STRUCT<file_path: STRING, block_start: BIGINT, row_id: BIGINT>"
    df = spark.createDataFrame(rows, schema)
    for later in (True, False):
        got = {(r.k, tuple(r.seq)): r.n for r in ordering.count_ahead(df, ["k"], "n", later=later).collect()}
        for k, seq in rows:
            assert got[k, seq] == sum(o == k and (s > seq if later else s < seq) for o, s in rows)


def test_order_value_at(spark, small_blocks):
    df = spark.createDataFrame([(v * 7,) for v in range(100)], "seq BIGINT")
    assert ordering.order_value_at(df, "floor(n / 2)").first()[0] == 49 * 7
    assert ordering.order_value_at(df, "n").first()[0] == 99 * 7
    assert ordering.order_value_at(df, "n + 1").first()[0] is None


def seconds(row):
    h, m, s = map(int, row["event_ts"].split()[1].split(":"))
    return h * 3600 + m * 60 + s


@pytest.mark.parametrize("day", [86_400, 3_600])
def test_windowed_bursts_against_pairs(events, monkeypatch, day):
    monkeypatch.setattr(bursts, "DAY", day)  # small blocks put block ends inside the data
    rows = failed_rows(300, seed=3)
    failed = [(r["source_ip"] or r["user"] or "", seconds(r)) for r in rows if is_failed(r)]
    best = {}
    for src, at in failed:
        n = sum(s == src and at - 1800 <= t <= at for s, t in failed)
        if src and n >= 3:
            peak, first, over = best.get(src, (0, 10**9, 0))
            best[src] = (max(peak, n), min(first, at), over + 1)
    got = {r.source: (r.peak, seconds({"event_ts": r.first_at}), r.attempts_over)
           for r in bursts.failed_login_bursts_windowed(events(rows), 3, 30).collect()}
    assert got == best and best


def test_sessions_equal_session_windows(events):
    df = events(failed_rows(400, seed=4))
    builtin = (
        detections.failed_logins(df).selectExpr(f"{bursts.SOURCE} as source", "event_ts").where("source <> ''")
        .groupBy(F.session_window("event_ts", "20 minutes").alias("w"), "source").count()
        .selectExpr("source", "date_format(w.start, 'yyyy-MM-dd HH:mm:ss')",
                    "date_format(w.end - interval 20 minutes, 'yyyy-MM-dd HH:mm:ss')", "count")
    )
    assert sorted(collect(bursts.attack_sessions(df, 20))) == sorted(collect(builtin))


def test_field_statistics(events):
    rnd = random.Random(5)
    values = [rnd.choice([rnd.randrange(100), rnd.random() * 1e6, -5, 0, 7]) for _ in range(501)]
    df = events([{"pid": str(v)} for v in values] + [{"pid": ""}, {"pid": "abc"}, {}])
    row = anomaly.baseline(df, "pid").first()
    ordered = sorted(float(str(v)) for v in values)
    assert row.sample_count == 501 and row.min_val == ordered[0] and row.max_val == ordered[-1]
    assert row.mean == pytest.approx(statistics.mean(ordered))
    assert row.std_dev == pytest.approx(statistics.stdev(ordered))
    assert row.median == statistics.median(ordered)
    assert (row.p95, row.p99) == (ordered[int(501 * 0.95)], ordered[int(501 * 0.99)])
    assert anomaly.baseline(df.where("false"), "pid").count() == 0


def test_values_are_found_by_their_bits(spark):
    rnd = random.Random(8)
    inf = float("inf")
    odd = [0.0, 1e9, -1e9, inf, -inf, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2 ** -52]
    counts = Counter(round(rnd.random() * 100, 3) for _ in range(400)) + Counter(odd + [inf, -inf, -2.5])
    ordered = sorted(counts.elements())
    table = spark.createDataFrame(list(counts.items()), "value DOUBLE, n BIGINT")
    wanted = set(range(0, len(ordered), 19)) | {0, 1, 2, 3, len(ordered) - 1, len(ordered) - 2, len(ordered) - 3}
    assert anomaly.values_at(table, wanted) == {p: ordered[p] for p in wanted}
    last = table.union(spark.createDataFrame([(float("nan"), 2)], "value DOUBLE, n BIGINT"))
    assert str(anomaly.values_at(last, {len(ordered)})[len(ordered)]) == "nan" and anomaly.values_at(last, {len(ordered) - 1})[len(ordered) - 1] == inf
    assert anomaly.values_at(spark.createDataFrame([(7.0, 3)], "value DOUBLE, n BIGINT"), {0, 2}) == {0: 7.0, 2: 7.0}


def test_percentile_position_on_whole_products(events):
    df = events([{"pid": str(i)} for i in range(20)])
    assert anomaly.baseline(df, "pid").first().p95 == 19.0


def test_anomalies_of_a_burst(events):
    quiet = [{"event_type": "ok", "raw_message": "fine", "source_ip": f"1.1.1.{i}", "user": "u",
              "timestamp": f"Jan  1 {8 + i % 8:02d}:00:00"} for i in range(6)]
    burst = [{"event_type": "ssh_login_fail", "raw_message": "Failed", "source_ip": "9.9.9.9", "user": "",
              "timestamp": "Jan  1 03:00:00"} for _ in range(60)]
    found = {r.metric: r for r in anomaly.detect_anomalies(events(quiet + burst)).collect()}
    assert found["failed_logins"].severity == "high" and found["failed_logins"].z_score == 999
    assert found["failed_logins"].value == 60 and found["failed_logins"].expected_range.high == 2
    assert found["off_hours_activity"].description == "Unusual activity at 3:00 (off hours)"
    flood = found["single_source_flood"]
    assert flood.value == 60 and "IP 9.9.9.9 responsible for 60 events" in flood.description
    whole = anomaly.anomaly_summary(anomaly.detect_anomalies(events(quiet + burst))).first()
    assert whole.total_anomalies == len(found) and "off_hours_activity" in whole.metrics_affected


def test_flood_tie_goes_to_first_seen(events):
    ips = ["b", "a"] * 20 + [f"x{i}" for i in range(30)]
    row = anomaly.single_source_flood(events([{"source_ip": ip} for ip in ips])).first()
    assert "IP b responsible for 20 events" in row.description


def test_baseline_events_are_used(events):
    now = events([{"event_type": "x_fail", "raw_message": "x", "source_ip": "1.1.1.1"}] * 3)
    before = events([{"event_type": "x_fail", "raw_message": "denied", "source_ip": "1.1.1.1"}] * 30)
    found = {r.metric: r.value for r in anomaly.metric_anomalies(now, before).collect()}
    assert found == {"failed_logins": 3.0}


def test_top_values_order_and_bars(events):
    df = events([{"user": u} for u in ["b", "a", "a", "b", "c", "", None]])
    assert collect(summary.top_users(df, 2)) == [("b", 2, 30), ("a", 2, 30)]


def test_hours(events):
    df = events([{"timestamp": t} for t in ["Jan 1 07:00:00", "Jan 1 25:00:00", "2024-01-01T07:00:00Z", "", " ", "x"]])
    rows = {r.hour: (r.events, r.bar) for r in summary.hourly_timeline(df).collect()}
    assert len(rows) == 24 and rows[7] == (1, 60) and rows[0] == (1, 60) and rows[1] == (0, 0)


def test_distribution_ignores_unknown_levels(events):
    df = events([{}] * 4).selectExpr("*", "element_at(array('HIGH', 'odd', null, 'low'), int(seq) + 1) as severity")
    rows = {r.severity: (r.events, round(r.percent, 1)) for r in summary.severity_distribution(df).collect()}
    assert rows == {"critical": (0, 0.0), "high": (1, 33.3), "medium": (0, 0.0), "low": (1, 33.3), "info": (1, 33.3)}


def test_detection_lists(events):
    df = events([
        {"event_type": "suspicious", "message": "Sudoers changed", "timestamp": "t", "user": "amy"},
        {"event_type": "wmi_call", "message": "x", "source_ip": None},
        {"event_type": "x", "raw_message": "Large File copied " + "z" * 80, "timestamp": "t", "source_ip": "1.1.1.1"},
        {"event_type": "account_created", "timestamp": "t"},
        {"event_type": "x", "source_ip": "185.220.9.9"},
        {"event_type": "x", "source_ip": "185.220.101.9"},
        {"event_type": "x", "source_ip": "77.1.1.1"},
    ])
    assert [r.item for r in detections.privilege_escalation(df).collect()] == ["t - amy - Sudoers changed"]
    assert [r.item for r in detections.lateral_movement(df).collect()] == ["? - ? -> x"]
    assert [len(r.item) for r in detections.data_exfiltration(df).collect()] == [len("t - 1.1.1.1 - ") + 60]
    assert [r.item for r in detections.new_accounts(df).collect()] == ["unknown created on t"]
    assert {r.item for r in detections.suspicious_ips(df).collect()} == {
        "185.220.101.9 (Tor exit node)", "77.1.1.1 (Eastern Europe)"}


def test_mitre_samples_only_look_up_missing_fields(events):
    df = events([
        {"mitre_tactic": "T1110", "mitre_technique": ""}, {"mitre_tactic": "T1110"},
        {"mitre_tactic": "T9999"}, {"mitre_tactic": "T1", "mitre_technique": "own"},
    ])
    assert [r.sample for r in summary.mitre_samples(df).collect()] == ["T1110: Initial Access", "T1: own"]
    assert collect(summary.mitre_tactics(df)) == [
        ("T1", 1, "Unknown"), ("T1110", 2, "Initial Access"), ("T9999", 1, "Unknown")]


def test_listed_campaigns_keep_first_ten(events):
    df = events([{"event_type": "lateral_exfil", "message": f"m{i}", "source_ip": "s"} for i in range(25)])
    rows = correlate.correlate(df).collect()
    assert Counter(r.campaign for r in rows) == {"lateral_movement_chains": 10, "exfiltration_campaigns": 10}
    assert [r.message for r in rows if r.campaign == "exfiltration_campaigns"] == [f"m{i}" for i in range(10)]


def test_port_scan(events):
    df = events([
        {"event_type": "port_scan", "message": f"Connection attempt to 10.0.0.1:{p} from 6.6.6.6",
         "event_ts": "2024-01-01 00:01:00", "source_ip": "10.0.0.1"} for p in range(100, 130)
    ] + [{"event_type": "ok", "message": "port scan src 7.7.7.7 dst 8.8.8.8", "event_ts": "2024-01-01 00:02:00"}])
    assert collect(correlate.port_scan_campaigns(df)) == [("6.6.6.6", "2024-01-01 00:00:00", 1, 30, 30)]


# --- rules ------------------------------------------------------------------

def test_rule_engine(spark, events):
    df = events([
        {"event_type": "ssh_login_fail", "raw_message": "a.c FAILED", "source_ip": "185.220.1.1"},
        {"event_type": "x", "raw_message": "abc", "source_ip": None},
        {"event_type": "wave*[", "raw_message": "", "message": "exfil", "source_ip": "45.1.1.1"},
    ])
    own = rules.merge_rules(rules.builtin_rules(), [
        {"id": "A", "severity": "odd", "patterns": [r"a\.c"]},
        {"id": "B", "severity": "low", "patterns": ["*["]},   # no valid pattern: taken literally
        {"id": "R001", "patterns": ["abc"]},
        {"id": "C", "patterns": ["abc"], "enabled": False},
        {"id": "D", "condition": "other"},
        {"id": "E", "severity": "low", "patterns": [r"zz(.)\1", r"(?P<word>w[a-z]+e)\*"]},
    ])
    assert len(own) == 15
    rows = rules.run_rules(df, own).collect()
    assert [(r.rule_id, r["count"]) for r in rows] == [
        ("R010", 1), ("R001", 1), ("R004", 2), ("R007", 1), ("R006", 1), ("B", 1), ("E", 1), ("A", 1)]
    by_id = {r.rule_id: r for r in rows}
    assert [s.seq for s in by_id["R004"].sample_records] == [0, 2]
    assert by_id["R004"].message == "Suspicious IP Range: 2 matches"
    totals = rules.rule_summary(rules.run_rules(df, own, samples=0), own).first()
    assert (totals.rules_evaluated, totals.matches, totals.critical, totals.high) == (15, 8, 1, 3)


def test_thresholds(events):
    rule = rules.Rule(id="T", patterns=("fail",), threshold=3, time_window=60)
    at = [0, 30, 60, 61, 300, 310, 320]
    df = events([
        {"event_type": "fail", "source_ip": ip, "event_ts": f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"}
        for ip, times in (("a", at), ("b", [0, 100])) for s in times
    ])
    assert [r["count"] for r in rules.run_rules(df, [rule], samples=0, thresholds=True).collect()] == [3]
    total = rules.Rule(id="T", patterns=("fail",), threshold=3)
    assert [r["count"] for r in rules.run_rules(df, [total], samples=0, thresholds=True).collect()] == [7]


def test_rule_files(spark, tmp_path):
    (tmp_path / "many.json").write_text('{"rules": [{"id": "X", "condition": "ip_is_tor"}, {"name": "n"}, {"id": "X"}]}')
    (tmp_path / "one.json").write_text('{"id": "Y", "patterns": ["a"]}')
    (tmp_path / "none.json").write_text('{"name": "Y"}')
    many = load_rules(spark, str(tmp_path / "many.json"))
    assert [r.id for r in many[10:]] == ["X", "R011"] and many[10].condition == "ip_is_tor"
    assert load_rules(spark, str(tmp_path / "one.json"))[-1].patterns == ("a",)
    assert len(load_rules(spark, str(tmp_path / "none.json"))) == 10
    with pytest.raises(ValueError):
        load_rules(spark, "rules.txt")
    assert rules.rules_table(spark, many).count() == 12


@pytest.mark.parametrize("pattern", [
    r"from (?P<src_ip>\d+)\.(?P<b_2>\d+)", r"(?P<a_b>s+)x(?P=a_b)", r"a{,3}b", r"a{2,}b", r"x{,}y", "a{b", "a{}",
    "[[a]b", "[]a]+", "[^]a]+z", "[a&&b]c", r"[\]x]", r"[\b]", r"end\Z", "(?#no)ab", "(?u:a)b", "(?i)AB", "a.c$", "*bad[", "(x",
])
def test_patterns_match_as_in_rule_files(spark, pattern):
    texts = ["from 10.2", "ssxss", "sxs", "aab", "b", "xxy", "a{b", "a{}", "[b", "ab", "]a", "qz", "az", "&c", "bc", "]",
             "the end", "end.", "a\nc", "a\rc", "abc", "abc\n", "*bad[", "(x", "\x08", ""]
    try:
        own = re.compile(pattern, re.IGNORECASE)
    except re.error:
        own = re.compile(re.escape(pattern), re.IGNORECASE)
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r.t for r in rows.where(F.col("t").rlike("(?id)" + rules.to_java(pattern))).collect()}
    assert got == {t for t in texts if own.search(t)}


def test_conditional_groups_are_refused():
    with pytest.raises(ValueError):
        rules.to_java("(a)?(?(1)b|c)")


def test_events_without_a_time_are_kept(events):
    df = events([{"event_type": "fail", "source_ip": "a"}] * 3 + [{"event_type": "fail", "source_ip": "b"}] + [
        {"event_type": "fail", "source_ip": "a", "event_ts": "2024-01-01 00:00:00"}])
    rule = rules.Rule(id="T", patterns=("fail",), threshold=3, time_window=60)
    assert [r["count"] for r in rules.run_rules(df, [rule], samples=0, thresholds=True).collect()] == [3]
    assert collect(bursts.failed_login_bursts_windowed(df, threshold=3)) == [("a", 3, None, 3)]
    assert sorted(map(str, collect(bursts.attack_sessions(df)))) == sorted(map(str, [
        ("a", None, None, 3), ("b", None, None, 1), ("a", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 1)]))


def test_order_value_over_wide_order_values(spark):
    df = spark.range(5000).selectExpr("1700000000000000000L + id * 1000000007L * 1000 as seq")
    cut = ordering.order_value_at(df, "floor(n / 2)").first().cut
    assert cut == sorted(r.seq for r in df.collect())[2499]


def test_empty_baseline_is_none(events):
    df = events([{"event_type": "fail" if i % 3 else "ok", "source_ip": f"10.0.0.{i % 7}"} for i in range(60)])
    assert collect(anomaly.metric_anomalies(df, df.where("false"))) == collect(anomaly.metric_anomalies(df))


# --- intel ------------------------------------------------------------------

def test_prefix_lookup_against_startswith(spark):
    rnd = random.Random(6)
    ips = [".".join(str(rnd.choice([1, 10, 101, 185])) for _ in range(4)) for _ in range(200)]
    ips += ["10", "10.1", "1.x.host", "host"]
    table = [("10.", 3, "x"), ("10.1.", 2, "y"), ("185.10.1.", 5, "z"), ("1.", 9, "w"), ("101.1.1.1", 0, "v")]
    df = intel.prefix_lookup(spark.createDataFrame([(i,) for i in set(ips)], "ip STRING"),
                             spark.createDataFrame(table, "prefix STRING, priority INT, label STRING"))
    for row in df.collect():
        hits = [(p, label) for prefix, p, label in table
                if (row.ip.startswith(prefix) if prefix.endswith(".") else row.ip == prefix)]
        assert row.label == (min(hits)[1] if hits else None)


def test_read_feed(spark, tmp_path):
    from seclake.sources.feeds import read_feed

    (tmp_path / "f.json").write_text('{"ip": "1.1.1.1", "provider": "Shodan", "payload": {"tags": ["vpn"], "isp": "x"}}\n')
    row = intel.normalize_verdicts(read_feed(spark, str(tmp_path))).first()
    assert (row.ip, row.isp, row.is_vpn, row.tags) == ("1.1.1.1", "x", True, ["vpn"])


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_with_hot_key(spark, limit):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) as k")
    left = left.unionByName(spark.range(2).selectExpr("id + 5000 as id", "cast(null as string) as k"))
    table = spark.range(40).selectExpr("concat('k', id) as k", "id as v").unionByName(
        spark.range(1).selectExpr("'hot' as k", "-1L as v"))
    got = sorted((r.id, r.k, r.v) for r in joins.lookup_join(left, table, "k", limit).collect())
    expected = sorted((r.id, r.k, r.v) for r in left.join(table, "k", "left").collect())
    assert got == expected


def test_verdict_whitelist_and_errors(spark):
    def abuse(extra):
        return f'{{"data": {{"totalReports": 2, "reports": [{{"c": 1}}, 2], "isp": "i"{extra}}}}}'

    feed = [
        ("1", "AbuseIPDB", abuse("")), ("2", "AbuseIPDB", abuse(', "isWhitelisted": null')),
        ("3", "AbuseIPDB", abuse(', "isWhitelisted": false')), ("4", "AbuseIPDB", abuse(', "isWhitelisted": true')),
        ("5", "Shodan", '{"tags": ["vpn"]}'), ("6", "Other", "{}"), ("7", "VirusTotal", "oops"),
    ]
    df = intel.normalize_verdicts(spark.createDataFrame(feed, "ip STRING, provider STRING, payload STRING"))
    rows = {r.ip: r for r in df.collect()}
    assert [rows[i].is_malicious for i in "1234567"] == [True, False, True, False, False, False, False]
    assert rows["1"].categories == ['{"c":1}', "2"] and rows["5"].is_vpn and rows["7"].tags == []


def test_reputation_ladder(spark):
    base = ("is_malicious BOOLEAN, confidence INT, country STRING, country_code STRING, isp STRING, "
            "is_tor BOOLEAN, is_proxy BOOLEAN, is_vpn BOOLEAN, is_datacenter BOOLEAN")

    def verdict(ip, provider, bad=False, confidence=0, country="", isp="", tor=False, proxy=False, vpn=False, dc=False):
        return (ip, provider, bad, confidence, country, country + "!", isp, tor, proxy, vpn, dc)

    rows = [
        verdict("8.0.0.1", "Shodan", True, country="S"), verdict("8.0.0.1", "VirusTotal", True, isp="vt"),
        verdict("8.0.0.2", "Shodan", True), verdict("8.0.0.3", "Shodan", confidence=50),
        verdict("8.0.0.4", "Shodan", tor=True), verdict("8.0.0.5", "Shodan", vpn=True, proxy=True),
        verdict("8.0.0.6", "Shodan", proxy=True), verdict("8.0.0.7", "Shodan", dc=True), verdict("8.0.0.8", "Shodan"),
        verdict("185.220.1.1", "Own", country="O"), verdict("103.45.67.8", "Shodan", True), verdict("91.121.1.1", "Shodan"),
    ]
    verdicts = spark.createDataFrame(rows, f"ip STRING, provider STRING, {base}")
    combined = intel.aggregate_verdicts(verdicts.select("ip").distinct(), verdicts)
    words = {r.ip: r.reputation for r in intel.ip_reputation(combined).collect()}
    assert words == {
        "8.0.0.1": "malicious", "8.0.0.2": "suspicious", "8.0.0.3": "concerning", "8.0.0.4": "tor_exit_node",
        "8.0.0.5": "vpn", "8.0.0.6": "proxy", "8.0.0.7": "datacenter", "8.0.0.8": "clean",
        "185.220.1.1": "tor_exit_node", "103.45.67.8": "neutral", "91.121.1.1": "suspicious"}
    first = {r.ip: r for r in combined.collect()}
    assert first["8.0.0.1"].aggregated.country == "S" and first["8.0.0.1"].aggregated.isp == "vt"
    assert first["8.0.0.1"].providers_queried == ["VirusTotal", "Shodan"]
    assert first["185.220.1.1"].malicious_votes == 1 and first["185.220.1.1"].providers_queried == ["Own"]
    assert first["91.121.1.1"].aggregated.country == "France"


@pytest.mark.parametrize("n, width", [(7, 50), (137, 50), (100, 10)])
def test_levels(spark, small_blocks, n, width):
    rnd = random.Random(n)
    values = [rnd.randrange(1000) for _ in range(n)]
    df = spark.createDataFrame([(i * 60, v) for i, v in enumerate(values)], "t BIGINT, v BIGINT")
    picked = values if n <= width else [values[int(i * (n / width))] for i in range(width)]
    low, span = min(picked), max(picked) - min(picked)
    expected = [(i, v, int((v - low) / span * 8)) for i, v in enumerate(picked)]
    assert sorted(collect(series.levels(df, "t", "v", width))) == expected


def test_hot_keys_without_a_match_are_spread(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(20000).selectExpr(
            "id", "case when id % 2 = 0 then '' when id % 10 = 1 then null else concat('k', id) end as k")
        table = spark.range(10000).selectExpr("concat('k', id) as k", "id as v")
        joined = joins.lookup_join(left, table, "k", 0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) <= 2 * 20000 / 8
        assert joined.where("v is not null").count() == left.join(table, "k").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- many rules -------------------------------------------------------------

@pytest.mark.parametrize("pattern, texts", [
    ("Failed Login", [["failed login"]]), (r"user=user7\s+COMMAND=", [["user=user7"], ["command="]]),
    ("(opened|closed) by", [["opened", "closed"], [" by"]]), (r"(?:ab)+c", [["abc"]]), ("a?bc*", [["b"]]), (r"\d+", []),
    ("x(y(z))w", [["x"], ["y", ], ["z"], ["w"]]), ("(a|)b", [["b"]]), ("fürst", [["f"], ["rst"]]), ("(broken", [["(broken"]]),
    (r"(?i:ab)c", [["abc"]]), ("[ab]cd{2}e", [["c"], ["d"], ["e"]]),
])
def test_texts_which_a_match_contains(pattern, texts):
    from seclake.operators import ruleindex

    got = ruleindex.required(pattern)
    try:
        compiled = re.compile(pattern, re.IGNORECASE)
    except re.error:
        assert got == texts
        return
    for text in ("failed login", "user=user7  command=", "closed by", "opened by", "ababc", "bc", "b", "17", "xyzw", "fürst", "abc", "acdde", "bcdde"):
        if compiled.search(text):
            assert all(any(t in text for t in alternatives) for alternatives in got)
    assert {t for alternatives in got for t in alternatives} <= {t for alternatives in texts for t in alternatives} | {"abc", "ab", "c", "xyzw", "xyz", "yz"}


def test_looked_up_rules_hit_the_same_lines(events):
    rnd = random.Random(9)
    words = ["Failed", "login", "root", "session", "opened", "ſudo", "sudo", "KELVIN", "über", "x1", "x2", "(a", "port 22"]
    rows = [{"raw_message": " ".join(rnd.choices(words, k=4)), "event_type": rnd.choice(["ssh_login_fail", "syslog", "", None])} for _ in range(200)]
    patterns = [["failed"], ["Root", "login"], [r"session\s+opened"], ["(root|sudo) x[12]", "x1 x2"], [r"\bsudo\b"], ["kelvin"], ["ÜBER x"],
                [r"x\d"], [r"\w+"], ["(a"], ["ssh_login"], ["p[o]rt 2{2}"], ["login", "login"], [""], ["(fail|ssh|port)"], ["it", "ot"]]
    own = [rules.Rule(f"T{i}", patterns=tuple(p)) for i, p in enumerate(patterns)]
    own += [rules.Rule("C", condition="ip_is_tor", patterns=("failed",)), rules.Rule("N"), rules.Rule("D", patterns=("root",), enabled=False)]
    df = events(rows)
    direct = sorted(map(tuple, rules.rule_hits(df, own, index=False).collect()))
    assert sorted(map(tuple, rules.rule_hits(df, own, index=True).collect())) == direct
    expected = sorted((i, j) for i, p in enumerate(patterns) for j, r in enumerate(rows)
                      if any(re.search(x if x != "(a" else r"\(a", t, re.IGNORECASE) for x in p for t in (r["raw_message"].lower(), (r["event_type"] or "").lower())))
    assert direct == expected


def test_samples_come_from_few_blocks(events, monkeypatch):
    monkeypatch.setattr(rules, "SAMPLE_BITS", 2)
    df = events([{"raw_message": "failed" if i % 7 == 3 or i > 90 else "rare" if i in (40, 77) else "x", "event_type": "a"} for i in range(100)])
    seen = []
    inner = rules._in_blocks
    monkeypatch.setattr(rules, "_in_blocks", lambda e, b: seen.append(b) or inner(e, b))
    got = rules.run_rules(df, [rules.Rule("F", patterns=("failed",)), rules.Rule("R", patterns=("rare",)), rules.Rule("Z", patterns=("none",))]).collect()
    assert {r.rule_id: [s.seq for s in r.sample_records] for r in got} == {"F": [3, 10, 17], "R": [40, 77]}
    assert seen == [[0, 2, 4, 10, 19]]
    assert rules.run_rules(df, [rules.Rule("Z", patterns=("none",))]).count() == 0


# --- sliding scans ----------------------------------------------------------

@pytest.mark.parametrize("day", [86_400, 600])
def test_sliding_scans_against_pairs(events, monkeypatch, day):
    monkeypatch.setattr(correlate, "DAY", day)
    rnd = random.Random(day)
    rows = []
    for _ in range(300):
        second = rnd.randrange(7200)
        rows.append({"event_type": "port_scan", "event_ts": f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}",
                     "message": f"to 10.0.0.{rnd.randrange(8)}:{rnd.randrange(20, 26)} from 9.9.9.{rnd.choice([1, 1, 1, 2, 3])}"})
    rows += [{"event_type": "port_scan", "message": "to 10.0.0.99:99 from 9.9.9.1"}, {"event_type": "scan", "message": "nobody"},
             {"event_type": "x", "event_ts": "2024-01-01 00:00:00", "message": "to 10.0.0.98:98 from 9.9.9.1"}]
    seen = [(r["message"].split()[3], int(r["event_ts"][11:13]) * 3600 + int(r["event_ts"][14:16]) * 60 + int(r["event_ts"][17:]),
             *r["message"].split()[1].split(":")) for r in rows[:300]]
    expected = {}
    for scanner in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == scanner]
        per = {t: (len({h for _, u, h, _ in own if t - 300 <= u <= t}), len({p for _, u, _, p in own if t - 300 <= u <= t})) for _, t, _, _ in own}
        first = min((t for t, n in per.items() if max(n) >= 4), default=None)
        if first is not None:
            expected[scanner] = (f"2024-01-01 {first // 3600:02d}:{first // 60 % 60:02d}:{first % 60:02d}",
                                 max(n[0] for n in per.values()), max(n[1] for n in per.values()), len(own))
    got = {r.scanner: (r.first_at, r.hosts, r.ports, r.probes) for r in correlate.port_scan_sliding(events(rows), 5, 4).collect()}
    assert got == expected and expected


def test_scan_over_the_edge_of_a_window(events):
    """Ten ports in a minute, half of them before the full hour."""
    rows = [{"event_type": "scan", "event_ts": f"2024-01-01 0{1 if i < 5 else 2}:{59 if i < 5 else 0:02d}:{(30 + i) if i < 5 else i:02d}",
             "message": f"to 10.0.0.1:{i + 1} from 9.9.9.9"} for i in range(10)]
    assert correlate.port_scan_campaigns(events(rows), 10, 10).count() == 0
    assert [(r.ports, r.first_at) for r in correlate.port_scan_sliding(events(rows), 10, 10).collect()] == [(10, "2024-01-01 02:00:09")]


def test_events_are_dealt_out_whatever_the_files_are(spark, tmp_path):
    from seclake.plans import registry

    def part(n, ids):
        spark.range(n).selectExpr(f"{ids} as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts", "id as user_id",
                                  "'view' as event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    part(60_000, "cast(null as bigint)")  # one row group
    for _ in range(8):
        part(1, "id")
    got = registry.base(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 60_008
    assert max(r["count"] for r in got) < 10_000


def test_facets_are_counted_in_generated_code(events):
    from seclake.operators import facets

    got = facets.facet_counts(events([
        {"event_type": "login_fail", "source_ip": "1.1.1.1", "user": "", "timestamp": "2024-01-01T10:00:00Z", "raw_message": "ssh"},
        {"event_type": None, "source_ip": "", "user": "amy", "timestamp": "Jan 01 07:00:00", "mitre_tactic": "T1"},
        {"event_type": "login_fail", "source_ip": "1.1.1.1", "timestamp": ""},
    ]))
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.facet, r.value): (r.events, r.first) for r in got.collect()} == {
        ("total", ""): (3, 0), ("severity", "info"): (3, 0), ("stored", "info"): (3, 0),
        ("type", "login_fail"): (2, 0), ("source", "1.1.1.1"): (2, 0), ("user", "amy"): (1, 1), ("tactic", "T1"): (1, 1),
        ("hour", "7"): (1, 1), ("phase", "initial_access"): (2, 0), ("phase", "lateral_movement"): (1, 0), ("failing", "1.1.1.1"): (2, 0),
    }


def test_pieces_of_a_line_are_looked_up_in_generated_code(events):
    from seclake.operators import ruleindex

    found = [rules.Rule("A", patterns=("alpha", "beta+")), rules.Rule("B", patterns=("(gamma|delta) x",)), rules.Rule("C", patterns=("zeta",))]
    got = rules.rule_hits(events([{"raw_message": m} for m in ("alpha beta", "", "BETA gamma x delta x", "none", None)]), found, index=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line for line in plan.splitlines() if "Join" in line or "explode(_pieces" in line)
    assert plan.count("transform(") == len({len(k) for keys in ruleindex.keys(["alpha", "beta+", "(gamma|delta) x", "zeta"]) for k in keys})
    assert sorted((r.position, r.seq) for r in got.collect()) == [(0, 0), (0, 2), (1, 2)]
