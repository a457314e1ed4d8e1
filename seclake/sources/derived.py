"""Log lines derived from a generic ``events`` table.

Turns product events (event_id, ts, user_id, event_type) into syslog, sshd, PAM
and CloudTrail lines, one line per event, so that the jobs can run on any size of
that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

YEAR = 2024
FILES = 16

# The expressions below are plain SQL which other engines read as well, so the same
# text can define the rows a result is checked against.

IP_SQL = (
    "case user_id % 8 when 0 then '185.220.101.' when 1 then '91.121.45.' when 2 then '10.0.0.' "
    "when 3 then '192.168.1.' when 4 then '103.45.67.' when 5 then '45.33.32.' "
    "when 6 then '77.88.8.' else '172.16.4.' end || cast(user_id % 200 as varchar(9))"
)
_USER_SQL = "'user' || cast(user_id as varchar(20))"
_TARGET_SQL = "'10.1.0.' || cast(event_id % 250 as varchar(9))"

# Structured rows: one per event, all text in ``message``.
CASE_SQL = {
    "host": "'host' || cast(event_id % 5 as varchar(9))",
    "process": (
        "case event_id % 10 when 0 then 'smbd' when 1 then 'wmi' when 2 then 'sudo' when 3 then 'chmod' "
        "when 4 then 'network' when 5 then 'kernel' when 6 then 'ARP' when 7 then 'sshd' "
        "when 8 then 'system' else 'rdp' end"
    ),
    "event_type": (
        "case event_id % 10 when 1 then 'lateral' when 2 then 'priv_esc' when 4 then 'exfil' "
        "when 5 then 'port_scan' when 6 then 'mitm_suspicious' when 7 then 'ssh_login_fail' "
        "when 8 then '' else 'suspicious' end"
    ),
    "message": (
        f"case event_id % 10 when 0 then 'SMB session: user=' || {_USER_SQL} || ' from ' || {IP_SQL} "
        f"when 1 then 'WMI: provider call from ' || {IP_SQL} || ' user=administrator' "
        f"when 2 then 'Sudoers file changed by ' || {_USER_SQL} "
        "when 3 then 'changing permissions of /etc/shadow to 0644' "
        f"when 4 then 'Unusual outbound connection to ' || {IP_SQL} || ' port 443, archive upload of 2 GB' "
        f"when 5 then 'Connection attempt to ' || {_TARGET_SQL} || ':' || "
        f"cast(20 + event_id % 4000 as varchar(9)) || ' from ' || {IP_SQL} "
        f"when 6 then 'ARP spoofing detected: ' || {IP_SQL} || ' claims 192.168.1.1' "
        f"when 7 then 'Failed password for root from ' || {IP_SQL} || ' port ' || "
        "cast(1024 + event_id % 60000 as varchar(9)) || ' ssh2' "
        "when 8 then 'heartbeat ok' "
        f"else 'RDP connection established: ' || {_TARGET_SQL} || ' <- ' || {IP_SQL} end"
    ),
    "source_ip": f"case when event_id % 10 in (2, 3, 8) then '' else {IP_SQL} end",
    "destination_ip": f"case when event_id % 10 in (0, 5, 9) then {_TARGET_SQL} else '' end",
    "user": (
        f"case event_id % 10 when 0 then {_USER_SQL} when 1 then 'administrator' when 2 then {_USER_SQL} "
        "when 7 then 'root' else '' end"
    ),
}

# Provider payloads: one per event, about the address of its user.
FEED_SQL = {
    "seq": "event_id",
    "ip": IP_SQL,
    "provider": (
        "case event_id % 4 when 0 then 'VirusTotal' when 1 then 'AbuseIPDB' "
        "when 2 then 'AlienVaultOTX' else 'Shodan' end"
    ),
    "payload": (
        "case when event_id % 97 = 5 then 'no json' else case event_id % 4 "
        "when 0 then '{\"data\":{\"attributes\":{\"country\":\"' || "
        "case when user_id % 3 = 0 then '' else 'C' || cast(user_id % 10 as varchar(9)) end || "
        "'\",\"network\":\"net' || cast(user_id % 7 as varchar(9)) || '\",\"tags\":[\"t' || "
        "cast(event_id % 5 as varchar(9)) || '\",\"scan\"],\"last_analysis_date\":' || "
        "cast(event_id % 3 as varchar(9)) || ',\"last_analysis_stats\":{\"malicious\":' || "
        "cast(user_id % 12 as varchar(9)) || ',\"suspicious\":' || cast(event_id % 5 as varchar(9)) || '}}}}' "
        "when 1 then '{\"data\":{' || case event_id % 3 when 0 then '\"isWhitelisted\":null,' "
        "when 1 then '\"isWhitelisted\":false,' else '' end || '\"totalReports\":' || "
        "cast(user_id % 6 as varchar(9)) || ',\"confidenceScore\":' || cast(user_id % 90 as varchar(9)) || "
        "',\"abuseConfidenceScore\":' || cast(user_id % 80 as varchar(9)) || ',\"countryName\":\"N' || "
        "cast(user_id % 10 as varchar(9)) || '\",\"countryCode\":\"K' || cast(user_id % 10 as varchar(9)) || "
        "'\",\"isp\":\"isp' || cast(user_id % 9 as varchar(9)) || '\",\"lastReportedAt\":' || "
        "case when user_id % 2 = 0 then 'null' else '\"2024-01-02\"' end || ',\"isTor\":' || "
        "case when user_id % 8 = 0 then 'true' else 'false' end || ',\"isProxy\":' || "
        "case when user_id % 8 = 3 then 'true' else 'false' end || "
        "',\"reports\":[\"r1\",\"r2\",\"r3\",\"r4\",\"r5\",\"r6\"]}}' "
        "when 2 then '{\"pulse_info\":{\"count\":' || cast(user_id % 13 as varchar(9)) || "
        "',\"pulses\":[{\"name\":\"p1\"},{\"id\":2},{\"name\":\"p3\"}]},\"country_code\":\"' || "
        "case when user_id % 4 = 0 then '' else 'O' || cast(user_id % 10 as varchar(9)) end || "
        "'\",\"categories\":{\"a\":\"malware\",\"b\":\"malware\",\"c\":\"scan\"}}' "
        "else '{\"country_name\":\"S' || cast(user_id % 10 as varchar(9)) || '\",\"country_code\":\"SC\",\"isp\":\"' || "
        "case when user_id % 5 = 0 then '' else 'sisp' end || '\",\"tags\":[' || "
        "case user_id % 3 when 0 then '\"datacenter\"' when 1 then '\"cloud\",\"vpn\"' else '' end || ']}' end end"
    ),
}


# Log lines: one per event.
_HEAD = "date_format(ts, 'MMM dd HH:mm:ss')"
_PARTS = {
    "head": _HEAD,
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "ip": IP_SQL,
    "usr": _USER_SQL,
    "id": "cast(event_id as varchar(20))",
    "port": "' port ' || cast(1024 + event_id % 60000 as varchar(9)) || ' ssh2'",
    "api": "case event_id % 7 when 0 then 'CreateUser' when 1 then 'AssumeRole' else 'DeleteBucket' end",
}
_LINE_SQL = """case
  when event_type = 'error' and event_id % 7 = 0
    then concat(head, ' server01 sshd[', id, ']: Invalid user ', usr, ' from ', ip, port)
  when event_type = 'error'
    then concat(head, ' server01 sshd[', id, ']: Failed password for user=', usr, ' from ', ip, port)
  when event_type = 'click'
    then concat(head, ' server01 sshd[', id, ']: Accepted password for ', usr, ' from ', ip, port)
  when event_type = 'view'
    then concat(head, ' server01 CRON[', id, ']: pam_unix(cron:session): session opened for ', usr, ' by (uid=0)')
  when event_type = 'signup' and event_id % 7 < 3
    then concat('{"eventVersion":"1.08","eventTime":"', iso, '","eventName":"', api,
      '","awsRegion":"us-east-1","eventSource":"iam.amazonaws.com","sourceIPAddress":"', ip,
      '","userIdentity":{"type":"IAMUser","arn":"arn:aws:iam::1:user/', usr,
      '"},"requestParameters":{"userName":"u', cast(user_id as string), '"}}')
  when event_type = 'signup'
    then concat(head, ' server02 useradd[', id, ']: account created for ', usr, ' by root, password set')
  when event_id % 7 < 3
    then concat(head, ' fw01 kernel[TACTIC:T1046]: port scan src ', ip, ' dst 10.9.8.', cast(event_id % 250 as string))
  when event_id % 7 < 5
    then concat(head, ' server03 sudo: user=', usr, ' COMMAND=/bin/cat /etc/shadow')
  else concat(head, ' server03 net[TACTIC:T1048]: outbound connection exfil from ', ip, ' to 185.220.9.9')
end"""


# CloudTrail lines with the optional parts of a request and a response; other lines as they are.
CLOUDTRAIL_SQL = (
    "case when left(line, 1) = '{' then replace(line, '\"requestParameters\":{', '\"responseElements\":' || "
    "case seq % 3 when 0 then '{\"z\":{\"q\":[1,2]},\"a\":2}' when 1 then 'null' else '{}' end || ',\"requestParameters\":{' || "
    "case when seq % 2 = 0 then '\"groupName\":\"g' || cast(seq % 9 as varchar(9)) || '\",' else '' end || "
    "case seq % 5 when 0 then '\"policyName\":null,' when 1 then '\"policyName\":\"p1\",' else '' end) else line end"
)


def log_lines(events: DataFrame) -> DataFrame:
    """``file, seq, line``: one line per event, in event order."""
    parts = [f"{sql} as {name}" for name, sql in _PARTS.items()]
    return events.selectExpr("event_id", "user_id", "event_type", *parts).selectExpr(
        f"'log-' || cast(event_id % {FILES} as varchar(9)) as file", "event_id as seq", f"{_LINE_SQL} as line"
    )


def case_rows(events: DataFrame) -> DataFrame:
    """Structured event rows (no raw message), one per event."""
    from ..functions.times import event_time
    from ..schema import EVENT_FIELDS

    known = {**CASE_SQL, "timestamp": _HEAD}
    rows = events.selectExpr(
        "event_id as seq", *[f"{known.get(n, 'cast(null as string)')} as {n}" for n in EVENT_FIELDS]
    )
    return rows.selectExpr(
        "seq", "'case' as format", f"{event_time('timestamp', YEAR)} as event_ts", *EVENT_FIELDS
    )


def intel_feed(events: DataFrame) -> DataFrame:
    """``seq, ip, provider, payload``: one provider answer per event."""
    return events.selectExpr(*[f"{sql} as {name}" for name, sql in FEED_SQL.items()])
