import json

import pytest
from pyspark.sql import functions as F

from seclake.functions import formats
from seclake.operators import parse
from seclake.sources.lines import message_lines, read_lines

SSH_FAIL = "Mar  3 04:05:06 web1 sshd[77]: Failed password for invalid user bob from 10.1.2.3 port 2222 ssh2"
SYSLOG = "Mar  3 04:05:06 web1 kernel[12]: [TACTIC:T1046] scan user=eve src 1.2.3.4 dst 5.6.7.8"


def cloudtrail(**fields):
    base = {
        "eventVersion": "1.08", "eventTime": "2024-05-06T07:08:09Z", "eventName": "CreateUser",
        "userIdentity": {"type": "IAMUser", "arn": "arn:aws:iam::1:user/ann"},
        "sourceIPAddress": "9.9.9.9", "awsRegion": "eu-west-1", "eventSource": "iam.amazonaws.com",
    }
    return json.dumps({**base, **fields})


@pytest.mark.parametrize(
    "line, expected",
    [
        (SSH_FAIL, "ssh"),
        ("x SSH session started", "ssh"),
        ("sshd accepted", None),
        ("Mar 3 04:05:06 h p: session opened", "auth"),
        ("Mar 3 04:05:06 h p: hello", "syslog"),
        ("AUTHENTICATION problem", "auth"),
        ("hello", None),
        (cloudtrail(), "cloudtrail"),
        (cloudtrail() + " tail}", None),
        (cloudtrail() + "," + cloudtrail(), None),
        ('{"eventVersion": null, "eventTime": null}', "cloudtrail"),
        ('{"eventVersion": 1}', None),
        ("{broken", None),
        ("[TACTIC:T1]Mar 3 04:05:06 h p: x", None),
    ],
)
def test_detect_format(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line STRING")
    assert df.selectExpr(formats.detect_format("line")).first()[0] == expected


def one(lines, text, **options):
    return parse.parse_logs(lines(text), options.pop("format", "auto"), 2024, **options).first()


def test_ssh_fields(lines):
    row = one(lines, SSH_FAIL)
    assert (row.event_type, row.user, row.source_ip, row.source_port, row.host) == (
        "ssh_login_fail", "", "10.1.2.3", "2222", "sshd")
    assert row.timestamp == "Mar  3 04:05:06" and str(row.event_ts) == "2024-03-03 04:05:06"
    assert row.raw_message == SSH_FAIL and row.process is None and row.mitre_tactic is None
    from seclake.functions.parsers import default_parsers

    assert one(lines, SSH_FAIL, parsers=default_parsers(extended_user=True)).user == "bob"
    assert one(lines, "sshd Invalid user  amy from=1.1.1.1 port=9").user == "amy"
    assert one(lines, "sshd Accepted user=joe from 1.1.1.1").user == "joe"


def test_syslog_fields(lines):
    row = one(lines, SYSLOG)
    assert (row.event_type, row.host, row.process, row.pid, row.user) == ("syslog", "web1", "kernel", "12", "eve")
    assert (row.source_ip, row.destination_ip) == ("1.2.3.4", "5.6.7.8")
    assert row.raw_message == "scan user=eve src 1.2.3.4 dst 5.6.7.8"
    assert (row.mitre_tactic, row.mitre_technique) == ("T1046", "Service Discovery")
    bare = one(lines, "Mar 3 04:05:06 h cron: for amy from tty", format="syslog")
    assert (bare.pid, bare.user, bare.source_ip, bare.mitre_tactic) == (None, "amy", "", "")
    assert one(lines, "Mar 3 04:05:06 no colon here", format="syslog") is None


def test_auth_fields(lines):
    row = one(lines, "Mar 3 04:05:06 h su: session opened for root by amy(uid=0) at 7.7.7.7")
    assert (row.event_type, row.user, row.source_ip, row.host) == ("session_open", "root", "7.7.7.7", "auth")
    kinds = {
        "session closed": "session_close", "password changed": "password_change", "new password": "password_set",
        "new account": "account_created", "account password": "account_password",
    }
    for text, kind in kinds.items():
        assert one(lines, text.upper(), format="auth").event_type == kind
    assert one(lines, "authentication", format="auth") is None


def test_cloudtrail_fields(lines):
    row = one(lines, cloudtrail(requestParameters={"userName": "new", "policyName": None, "x": 1},
                                responseElements={"z": {"q": 1}, "a": 2}))
    assert row.raw_message == "CreateUser user=new policy=None -> ['z', 'a']"
    assert (row.user, row.host, row.event_type, row.mitre_tactic) == ("ann", "aws:eu-west-1", "iam_create", "T1078")
    assert str(row.event_ts) == "2024-05-06 07:08:09" and row.process == "iam.amazonaws.com"
    plain = one(lines, cloudtrail(userIdentity={"type": "Root"}, awsRegion="", eventName="Other",
                                  eventSource=None, requestParameters=None, responseElements={}))
    assert (plain.user, plain.host, plain.event_type, plain.process, plain.raw_message) == (
        "Root", "aws", "aws_other", "cloudtrail", "Other")
    assert one(lines, cloudtrail(userIdentity=None)).user == "unknown"
    assert one(lines, "{bad", format="cloudtrail") is None


def test_file_fallback_and_rejects(spark, lines, monkeypatch):
    text = ["hello", "new account for bob by root", SYSLOG, "password changed for joe by root"]
    both = lines("account created for ann by root", "AUTHENTICATION x", file="a").unionByName(
        lines(*text, file="b")).unionByName(lines("nothing known", file="c"))
    expected = {("a", 0, "account_created"), ("b", 2, "syslog"), ("b", 3, "password_change")}

    def seen():
        return {(r.file, r.seq, r.event_type) for r in parse.parse_logs(both, "auto", 2024).collect()}

    # File a starts with an auth line, so its first, unrecognised line is parsed as auth.
    assert seen() == expected
    monkeypatch.setattr(parse, "BROADCAST_FILES", 0)
    assert seen() == expected
    rejected = {(r.file, r.seq): r.reason for r in parse.rejects(both).collect()}
    assert rejected == {("a", 1): "no_match", ("b", 0): "no_match", ("b", 1): "no_match",
                        ("c", 0): "unknown_format"}
    with pytest.raises(ValueError):
        parse.parse_logs(both, "xml")


def test_read_lines_keeps_order(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "a.log").write_text("\n \n".join(f"  {t}\t" for t in texts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_lines(spark, str(tmp_path))
        got = [r.line for r in df.orderBy("seq").collect()]
        parts = df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [t.strip() for t in texts]
    assert parts > 3


def test_message_bytes(spark):
    df = spark.createDataFrame([(bytearray(b" Mar 3 ok\xff "), "1.1.1.1"), (bytearray(b"  "), "2")],
                               "value BINARY, sender STRING")
    rows = message_lines(df, source="sender").collect()
    assert [(r.source_address, r.line) for r in rows] == [("1.1.1.1", "Mar 3 ok")]


def test_user_parser(spark, lines):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from seclake.functions.parsers import default_parsers, struct_parser

    @pandas_udf("event_type string, user string")
    def own(line: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"event_type": "own", "user": line.str.upper()})

    parsers = {**default_parsers(), "own": struct_parser(own, ("event_type", "user"))}
    row = parse.parse_logs(lines("abc"), "own", parsers=parsers).first()
    assert (row.format, row.event_type, row.user, row.host) == ("own", "own", "ABC", None)


def test_severity(spark, events):
    rows = parse.score(events([
        {"event_type": "x", "raw_message": "SUDOERS edited in ETC/SHADOW"},
        {"event_type": "x", "raw_message": "", "message": "ssl strip"},
        {"event_type": "failed", "raw_message": "login"},  # found across the joining blank
        {"event_type": "session", "raw_message": "open"},
        {"event_type": None, "raw_message": None},
    ])).orderBy("seq").collect()
    assert [r.severity for r in rows] == ["critical", "high", "medium", "low", "info"]


def test_parse_reads_only_needed_columns(spark, tmp_path, lines):
    path = str(tmp_path / "t")
    lines(SSH_FAIL, SYSLOG).withColumn("other", F.lit(1)).write.parquet(path)
    plan = (
        parse.parse_lines(spark.read.parquet(path), 2024).where("seq > 0").select("event_type")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "GreaterThan(seq,0)" in plan and "struct<seq:bigint,line:string>" in plan
