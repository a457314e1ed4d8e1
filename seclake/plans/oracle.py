"""The SQL twin of every query, for a second engine.

Written against the ``events`` view on its own: lines, formats, fields and results
are expressed in plain SQL, using the fixed values but none of the job code.
"""

from __future__ import annotations

from .. import fixed
from ..schema import CASE, EVENT_FIELDS
from ..sources.derived import CASE_SQL, CLOUDTRAIL_SQL, FEED_SQL, IP_SQL


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {_s(w)})" for w in words) + ")"


def _map(key: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"when {_s(k)} then {_s(v)}" for k, v in mapping.items())
    return f"case {key} {arms} else {default} end"


def _prefix(ip: str, mapping: dict, default: str, pick=lambda v: v) -> str:
    arms = " ".join(f"when starts_with({ip}, {_s(k)}) then {_s(pick(v))}" for k, v in mapping.items())
    return f"case {arms} else {default} end"


_HDR = r"'^(\w{3}\s+\d+\s+\d+:\d+:\d+)'"
_SYS = r"'^(\w{3}\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$'"
_IP = r"'\b(?:\d{1,3}\.){3}\d{1,3}\b'"

# --- lines ------------------------------------------------------------------

_LINES = r"""
core as (
  select event_id as seq, strftime(ts, '%b %d %H:%M:%S') as hdr,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, user_id::varchar as uid, event_type as et,
    event_id % 7 as m7, event_id::varchar as id,
    case user_id % 8 when 0 then '185.220.101.' when 1 then '91.121.45.' when 2 then '10.0.0.'
      when 3 then '192.168.1.' when 4 then '103.45.67.' when 5 then '45.33.32.'
      when 6 then '77.88.8.' else '172.16.4.' end || (user_id % 200)::varchar as ip
  from events),
lines as (
  select 'log-' || (seq % 16)::varchar as file, seq, case
    when et = 'error' and m7 = 0 then hdr || ' server01 sshd[' || id || ']: Invalid user user' || uid || ' from ' || ip || ' port ' || (1024 + seq % 60000)::varchar || ' ssh2'
    when et = 'error' then hdr || ' server01 sshd[' || id || ']: Failed password for user=user' || uid || ' from ' || ip || ' port ' || (1024 + seq % 60000)::varchar || ' ssh2'
    when et = 'click' then hdr || ' server01 sshd[' || id || ']: Accepted password for user' || uid || ' from ' || ip || ' port ' || (1024 + seq % 60000)::varchar || ' ssh2'
    when et = 'view' then hdr || ' server01 CRON[' || id || ']: pam_unix(cron:session): session opened for user' || uid || ' by (uid=0)'
    when et = 'signup' and m7 < 3 then '{"eventVersion":"1.08","eventTime":"' || iso || '","eventName":"' || case m7 when 0 then 'CreateUser' when 1 then 'AssumeRole' else 'DeleteBucket' end || '","awsRegion":"us-east-1","eventSource":"iam.amazonaws.com","sourceIPAddress":"' || ip || '","userIdentity":{"type":"IAMUser","arn":"arn:aws:iam::1:user/user' || uid || '"},"requestParameters":{"userName":"u' || uid || '"}}'
    when et = 'signup' then hdr || ' server02 useradd[' || id || ']: account created for user' || uid || ' by root, password set'
    when m7 < 3 then hdr || ' fw01 kernel[TACTIC:T1046]: port scan src ' || ip || ' dst 10.9.8.' || (seq % 250)::varchar
    when m7 < 5 then hdr || ' server03 sudo: user=user' || uid || ' COMMAND=/bin/cat /etc/shadow'
    else hdr || ' server03 net[TACTIC:T1048]: outbound connection exfil from ' || ip || ' to 185.220.9.9' end as line
  from core)"""

_FORMAT = rf"""
own as (
  select *, case
    when starts_with(line, '{{') and json_valid(line) then
      case when list_contains(json_keys(line), 'eventVersion') and list_contains(json_keys(line), 'eventTime') then 'cloudtrail' end
    when contains(line, 'sshd') and (contains(line, 'Accepted') or contains(line, 'Failed') or contains(line, 'Invalid')) then 'ssh'
    when contains(lower(line), 'ssh') and (contains(lower(line), 'session') or contains(lower(line), 'login')) then 'ssh'
    when regexp_matches(line, {_HDR}) then
      case when contains(lower(line), 'session') or contains(lower(line), 'password') then 'auth' else 'syslog' end
    when regexp_matches(lower(line), 'failed|password|authentication|session') then 'auth' end as own_format
  from lines)"""


def _parsed(format_sql: str) -> str:
    """CTEs ``fmt`` and ``p`` (all lines with fields) and ``ev`` (lines with an event)."""
    ssh_type = " ".join(f"when contains(line, {_s(k)}) then {_s(v)}" for k, v in fixed.SSH_EVENTS.items())
    auth_type = " ".join(f"when contains(lower(line), {_s(k)}) then {_s(v)}" for k, v in fixed.AUTH_EVENTS.items())
    user = "coalesce(" + ", ".join(f"nullif(regexp_extract(msg, '{p}', 1), '')" for p in fixed.USER_PATTERNS) + ", '')"
    return rf"""
fmt as (
  select file, seq, line, {format_sql} as format,
    regexp_replace(line, '\[TACTIC:[A-Z0-9]+\]', '', 'g') as clean from own),
pre as (
  select *, case when format = 'syslog' and regexp_matches(clean, {_SYS}) then trim(regexp_extract(clean, {_SYS}, 5)) end as msg,
    case when format = 'cloudtrail' then json_extract_string(line, '$.eventName') end as ev_name,
    regexp_extract(line, '\[TACTIC:([A-Z0-9]+)\]', 1) as tag from fmt),
p as (
  select file, seq, line, format,
    case format when 'syslog' then regexp_extract(clean, {_SYS}, 1) when 'cloudtrail' then coalesce(json_extract_string(line, '$.eventTime'), '') else regexp_extract(line, {_HDR}, 1) end as "timestamp",
    case format when 'syslog' then regexp_extract(clean, {_SYS}, 2) when 'ssh' then 'sshd' when 'auth' then 'auth'
      when 'cloudtrail' then case when coalesce(json_extract_string(line, '$.awsRegion'), '') = '' then 'aws' else 'aws:' || json_extract_string(line, '$.awsRegion') end end as host,
    case format when 'syslog' then {user}
      when 'ssh' then case when contains(line, 'Accepted') or contains(line, 'Failed') then regexp_extract(line, 'user=(\S+)', 1) else regexp_extract(line, 'Invalid user\s+(\S+)', 1) end
      when 'auth' then regexp_extract(line, 'for\s+(\S+)\s+by', 1)
      when 'cloudtrail' then coalesce(nullif(json_extract_string(line, '$.userIdentity.userName'), ''),
        case when contains(json_extract_string(line, '$.userIdentity.arn'), 'arn:aws:iam::') then split_part(json_extract_string(line, '$.userIdentity.arn'), '/', -1) end,
        json_extract_string(line, '$.userIdentity.type'), 'unknown') end as "user",
    case format when 'syslog' then regexp_extract(msg, {_IP}) when 'ssh' then regexp_extract(line, 'from[ =](\S+)', 1)
      when 'auth' then regexp_extract(line, '(\d{{1,3}}\.){{3}}\d{{1,3}}') when 'cloudtrail' then coalesce(json_extract_string(line, '$.sourceIPAddress'), '') end as source_ip,
    case format when 'ssh' then regexp_extract(line, 'port[ =](\d+)', 1) when 'auth' then '' end as source_port,
    case when format = 'syslog' then coalesce(regexp_extract_all(msg, {_IP})[-1], '') when format is not null then '' end as destination_ip,
    case format when 'syslog' then case when msg is not null then 'syslog' end when 'ssh' then case {ssh_type} end when 'auth' then case {auth_type} end
      when 'cloudtrail' then {_map('ev_name', fixed.CLOUDTRAIL_CATEGORY, "'aws_other'")} end as event_type,
    case format when 'syslog' then regexp_extract(clean, {_SYS}, 3) when 'cloudtrail' then coalesce(nullif(json_extract_string(line, '$.eventSource'), ''), 'cloudtrail') end as process,
    case format when 'syslog' then nullif(regexp_extract(clean, {_SYS}, 4), '') end as pid,
    case format when 'syslog' then msg when 'cloudtrail' then ev_name || case when json_exists(line, '$.requestParameters.userName') then ' user=' || coalesce(json_extract_string(line, '$.requestParameters.userName'), 'None') else '' end
      || case when json_exists(line, '$.requestParameters.groupName') then ' group=' || coalesce(json_extract_string(line, '$.requestParameters.groupName'), 'None') else '' end
      || case when json_exists(line, '$.requestParameters.policyName') then ' policy=' || coalesce(json_extract_string(line, '$.requestParameters.policyName'), 'None') else '' end
      || case when len(json_keys(line, '$.responseElements')) > 0 then ' -> [''' || array_to_string(json_keys(line, '$.responseElements'), ''', ''') || ''']' else '' end
      else line end as raw_message,
    case format when 'syslog' then tag when 'cloudtrail' then {_map('ev_name', fixed.CLOUDTRAIL_MITRE, "''")} end as mitre_tactic,
    case format when 'syslog' then {_map('tag', fixed.MITRE_TEXT, "''")} end as mitre_technique
  from pre),
ev as (
  select *, coalesce(raw_message, '') as text,
    case when format = 'cloudtrail' then try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ')
      else try_strptime('2024 ' || "timestamp", '%Y %b %d %H:%M:%S') end as event_ts
  from p where event_type is not null)"""


def _severity(text: str) -> str:
    arms = " ".join(
        f"when {_any(text, fixed.SEVERITY_KEYWORDS[level])} then {_s(level)}" for level in fixed.SEVERITIES[:-1]
    )
    return f"case {arms} else 'info' end"


def _scored(table: str) -> str:
    return f"""
sc as (select *, {_severity('lower(event_type || chr(32) || text)')} as severity from {table})"""


_CASES = """
cs as (
  select event_id as seq, strftime(ts, '%b %d %H:%M:%S') as "timestamp",
    date_trunc('second', ts) as event_ts, """ + ", ".join(
    f'{sql} as "{name}"' for name, sql in CASE_SQL.items()
) + """, null::varchar as raw_message from events),
ca as (select *, message as text from cs)"""

_FEED = """
feed as (select """ + ", ".join(f"{sql} as {name}" for name, sql in FEED_SQL.items()) + """ from events)"""

_AUTO = "coalesce(own_format, 'syslog')"
LOGS = "with" + ",".join([_LINES, _FORMAT, _parsed(_AUTO)])
SCORED = LOGS + "," + _scored("ev")
# Header times say nothing without a year.
UNTIMED = LOGS + ", tv as (select * replace (case when format = 'cloudtrail' then event_ts end as event_ts) from ev)"
CASES = "with" + _CASES
CASES_SCORED = CASES + "," + _scored("ca")

_CLOCK = "'%Y-%m-%d %H:%M:%S'"
_FIELDS = (
    'file, seq, format, strftime(event_ts, ' + _CLOCK + ') as event_time, "timestamp", host, "user", source_ip, '
    "source_port, destination_ip, event_type, process, pid, raw_message, mitre_tactic, mitre_technique"
)

_RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"


# --- pieces -----------------------------------------------------------------

def _top(column: str, limit: int, label: str = "value") -> str:
    return f"""
    , g as (select {column} as value, count(*) as events, min(seq) as first from ev where {column} <> '' group by 1),
    t as (select * from g order by events desc, first limit {limit})
    select {label} as value, events, floor(events::double / (select max(events) from t) * 30)::bigint as bar from t"""


def _bursts(table: str) -> str:
    # Literally: each failed row against every later one.
    return f"""
    , f as (select seq, coalesce(source_ip, '') as ip, coalesce("user", '') as u from {table} where contains(lower(event_type), 'fail')),
    n as (select a.seq, case when a.ip <> '' then a.ip else a.u end as source, 1 + count(b.seq) as attempts
      from f a left join f b on b.seq > a.seq and (b.ip = a.ip or b.u = a.u) group by all)
    select distinct source, attempts, source || ': ' || attempts || ' failed attempts' as item
    from n where source <> '' and attempts >= 5"""


_LOW = "lower(text)"
_TYPE = "lower(event_type)"


def _words(words) -> str:
    return f"({_any(_TYPE, words[0])} or {_any(_LOW, words[1])})"


def _phases(table: str) -> str:
    arms = " union all ".join(
        f"select {i}::int as position, {_s(phase)} as phase, count(*) as events from {table} "
        f"where {_any(_LOW, words)} or {_any(_TYPE, words)}"
        for i, (phase, words) in enumerate(fixed.PHASE_WORDS.items(), start=1)
    )
    return f" select * from ({arms}) where events > 0"


# Event columns which the CTE does not have.
_MISSING = {"ev": ("message",), "ca": ("source_port", "pid", "mitre_tactic", "mitre_technique")}


def _correlate(table: str) -> str:
    record = ", ".join(f"null::varchar as {c}" if c in _MISSING[table] else f'"{c}"' for c in EVENT_FIELDS)
    lists = " union all ".join(
        f"""select '{name}' as campaign, coalesce(source_ip, '') as key, 1::bigint as attempts,
        row_number() over (order by seq)::int as position, seq, {record}
        from {table} where contains({_TYPE}, '{word}') qualify position <= 10"""
        for name, word in (("privilege_escalation_attempts", "priv_esc"), ("lateral_movement_chains", "lateral"),
                           ("exfiltration_campaigns", "exfil"))
    )
    nothing = ", ".join(f'null::varchar as "{c}"' for c in EVENT_FIELDS)
    return f""" select 'brute_force_campaigns' as campaign, source_ip as key, count(*) as attempts, null::int as position,
      null::bigint as seq, {nothing}
      from {table} where contains({_TYPE}, 'fail') and source_ip <> '' group by source_ip union all {lists}"""


def _scans(table: str) -> str:
    host = r"((?:\d{1,3}\.){3}\d{1,3})"
    return rf"""
    , sp as (select time_bucket(interval 1 day, event_ts) as started,
        coalesce(nullif(regexp_extract({_LOW}, '(?:from|src)\s+{host}', 1), ''), source_ip, '') as scanner,
        nullif(coalesce(nullif(regexp_extract({_LOW}, '(?:to|dst)\s+{host}', 1), ''), destination_ip, ''), '') as host,
        nullif(regexp_extract({_LOW}, '(?:\d{{1,3}}\.){{3}}\d{{1,3}}:(\d+)', 1), '') as port
      from {table} where contains({_TYPE}, 'scan') or contains({_LOW}, 'port scan'))
    select scanner, strftime(started, {_CLOCK}) as started_at, count(distinct host) as hosts, count(distinct port) as ports,
      count(*) as probes from sp where scanner <> '' group by scanner, started
    having greatest(count(distinct host), count(distinct port)) >= 2"""


def _sliding(table: str) -> str:
    # Literally: the different targets of the twelve hours before each probe.
    host = r"((?:\d{1,3}\.){3}\d{1,3})"
    return rf"""
    , sp as (select epoch(date_trunc('second', event_ts))::bigint as t,
        coalesce(nullif(regexp_extract({_LOW}, '(?:from|src)\s+{host}', 1), ''), source_ip, '') as scanner,
        nullif(coalesce(nullif(regexp_extract({_LOW}, '(?:to|dst)\s+{host}', 1), ''), destination_ip, ''), '') as host,
        nullif(regexp_extract({_LOW}, '(?:\d{{1,3}}\.){{3}}\d{{1,3}}:(\d+)', 1), '') as port
      from {table} where event_ts is not null and (contains({_TYPE}, 'scan') or contains({_LOW}, 'port scan'))),
    pt as (select a.scanner, a.t, count(distinct b.host) as hosts, count(distinct b.port) as ports
      from (select distinct scanner, t from sp where scanner <> '') a
      join sp b on b.scanner = a.scanner and b.t between a.t - 43200 and a.t group by all),
    pp as (select scanner, max(hosts) as hosts, max(ports) as ports, min(t) filter (greatest(hosts, ports) >= 2) as first from pt group by scanner)
    select scanner, strftime(make_timestamp(first * 1000000), {_CLOCK}) as first_at, hosts, ports, n as probes
    from pp join (select scanner, count(*) as n from sp group by 1) using (scanner) where first is not null"""


# Rules as (id, name, severity, tactic, technique, predicate), in rule order.
def _rule_test(condition: str, patterns) -> str:
    if condition == "source_ip_starts_with":
        return "(" + " or ".join(f"starts_with(source_ip, {_s(p)})" for p in fixed.SUSPICIOUS_PREFIXES) + ")"
    if condition == "ip_is_tor":
        return "starts_with(source_ip, '185.220.')"
    return "(" + " or ".join(f"regexp_matches({c}, {_s(p)}, 'i')" for p in patterns for c in (_LOW, _TYPE)) + ")"


_BUILTIN = [(r[0], r[1], r[3], r[8], r[9], _rule_test(r[4], r[5])) for r in fixed.BUILTIN_RULES]
_CUSTOM = [
    ("R101", "Custom Brute Force", "high", "Credential Access", "T1110", _rule_test("", ["failed", "password"])),
    ("R102", "Session By Root", "low", "", "", _rule_test("", [r"user\d+5 by", r"\*bad\["])),
    ("R013", "Without Id", "notice", "", "", _rule_test("", ["cron", "useradd"])),
]
# The patterns of PATTERN_RULES, written for this engine by hand.
_PATTERNS = [
    ("P1", "Named Group", "high", "", "", _rule_test("", [r"from [0-9]+\.[0-9]+\.0\."])),
    ("P2", "Named Reference", "low", "", "", _rule_test("", ["sshd"])),
    ("P3", "Repeats From Zero", "low", "", "", _rule_test("", ["port 1([0-9]([0-9]([0-9])?)?)? ssh"])),
    ("P4", "Class With Bracket", "low", "", "", _rule_test("", [r"cron(\[|a)[0-9]+", r"(\]|&|x)uid=0"])),
    ("P5", "Broken", "low", "", "", f"contains({_LOW}, '(uid=0')"),
    ("P6", "Comment And Brace", "low", "", "", _rule_test("", [r"sudo: user\{?=[a-z0-9_]+5\b"])),
]


def _hits(table: str, rules) -> str:
    return " union all ".join(
        f"""select {i} as pos, {_s(r[0])} as rule_id, {_s(r[1])} as rule_name, {_s(r[2])} as severity,
        {_s(r[3])} as mitre_tactic, {_s(r[4])} as mitre_technique, seq, event_ts,
        case when coalesce(source_ip, '') <> '' then source_ip else coalesce("user", '') end as source
        from {table} where {r[5]}""" for i, r in enumerate(rules)
    )


_RULE_COLUMNS = """rule_id, rule_name, severity, count(*) as "count",
      rule_name || ': ' || count(*) || ' matches' as message, mitre_tactic, mitre_technique"""


def _rules(table: str, rules) -> str:
    return f"""
    , h as ({_hits(table, rules)}),
    k as (select *, row_number() over (partition by pos order by seq) as rn from h)
    select {_RULE_COLUMNS}, string_agg(seq::varchar, ',' order by seq) filter (rn <= 3) as samples from k
    group by rule_id, rule_name, severity, mitre_tactic, mitre_technique"""


# The generated rules, by the number which a line holds at their place.
_THOUSAND = rf"""
    , h as (
      select try_cast(regexp_extract({_LOW}, 'user(\d+) from', 1) as int) as pos, seq, 0 as kind from ev
      union select try_cast(regexp_extract({_LOW}, 'user=user(\d+)\s+command=', 1) as int), seq, 1 from ev
      union select try_cast(regexp_extract({_LOW}, '(?:session opened|account created) for user(\d+) by', 1) as int), seq, 2 from ev
      union select unnest(range(try_cast(regexp_extract({_LOW}, 'src 10\.0\.0\.(\d+) dst', 1) as int), 1000, 200)), seq, 3 from ev
      union select try_cast(regexp_extract({_LOW}, 'port (\d+)\b', 1) as int) - 1024, seq, 3 from ev),
    k as (select *, row_number() over (partition by pos order by seq) as rn from h where pos between 0 and 999 and pos % 4 = kind)
    select 'G' || lpad(pos::varchar, 4, '0') as rule_id, 'Generated ' || pos as rule_name, 'low' as severity, count(*) as "count",
      'Generated ' || pos || ': ' || count(*) || ' matches' as message, '' as mitre_tactic, '' as mitre_technique,
      string_agg(seq::varchar, ',' order by seq) filter (rn <= 3) as samples from k group by pos"""


def _thresholded(table: str = "ev") -> str:
    return f"""
    , h as ({_hits(table, _BUILTIN)}),
    k as (select *, case when event_ts is null then count(*) over (partition by pos, source, event_ts is null)
        else count(*) over (partition by pos, source, event_ts is null order by epoch(event_ts)::bigint
        range between 43200 preceding and current row) end as recent,
        count(*) over (partition by pos, source) as total from h)
    select {_RULE_COLUMNS} from k
    where case rule_id when 'R001' then recent >= 2 when 'R007' then total >= 10 else true end
    group by rule_id, rule_name, severity, mitre_tactic, mitre_technique"""


# --- statistics -------------------------------------------------------------

_FAILING = _any(_LOW, fixed.AUTH_FAILURE_WORDS)


def _bucket(col: str) -> str:
    return f"(('0x' || substr(md5({col}), 1, 8))::bigint % 1000)::double"


def _metric_values(table: str) -> str:
    return f"""
      select 'failed_logins' as metric, 1.0::double as value, seq from {table} where contains({_TYPE}, 'fail')
      union all select 'auth_failures', 1.0, seq from {table} where {_FAILING}
      union all select 'unique_ips', {_bucket('source_ip')}, seq from {table} where source_ip <> ''
      union all select 'unique_users', {_bucket('"user"')}, seq from {table} where "user" <> ''"""


def _stats(source: str) -> str:
    return f"""select metric, avg(value) as mean, coalesce(stddev_samp(value), 0) as std_dev, min(value) as min_val,
      max(value) as max_val, median(value) as median,
      list_sort(list(value))[(floor(count(*) * 0.95) + 1)::int] as p95,
      list_sort(list(value))[(floor(count(*) * 0.99) + 1)::int] as p99, count(*) as sample_count
      from {source} group by metric"""


_ROUNDED = ", ".join(
    f"round({c}, 6) as {c}" for c in ("mean", "std_dev", "min_val", "max_val", "median", "p95", "p99")
) + ", sample_count"

_ANOMALY = """metric, severity, round(value, 6) as value, round(low, 6) as low, round(high, 6) as high,
  round(deviation, 6) as deviation, round(z, 2) as z_score"""


def _metric_anomalies(base: str) -> str:
    """CTE ``ma`` from a CTE ``b0`` of baseline values."""
    return f"""
    , mv as ({_metric_values('ev')}),
    b0 as ({base}),
    bs as ({_stats('b0')} union all {_stats("(select * from mv where metric not in (select metric from b0))")}),
    cur as (select 'failed_logins' as metric, count(*) filter (contains({_TYPE}, 'fail')) as value from ev
      union all select 'auth_failures', count(*) filter ({_FAILING}) from ev
      union all select 'unique_ips', count(distinct nullif(source_ip, '')) from ev),
    cmp as (select metric, value::double as value, mean, std_dev,
      case when std_dev = 0 then 999.0 else (value - mean) / nullif(std_dev, 0) end as z from cur join bs using (metric)),
    ma as (select metric, value, case when std_dev = 0 then 0.0 else mean - 2 * std_dev end as low,
      case when std_dev = 0 then mean * 2 else mean + 2 * std_dev end as high, value - mean as deviation, z,
      case when std_dev = 0 then 'high' when abs(z) > 4 then 'critical' when abs(z) > 3 then 'high' else 'medium' end as severity
      from cmp where case when std_dev = 0 then value > mean * 2 else abs(z) > 2 end)"""


_FAILED_AT = f"""select event_ts, case when coalesce(source_ip, '') <> '' then source_ip else coalesce("user", '') end as source
            from {{0}} where contains({_TYPE}, 'fail')"""


def _windowed(table: str) -> str:
    return f""", f as ({_FAILED_AT.format(table)}),
            w as (select *, case when event_ts is null then count(*) over (partition by source, event_ts is null)
              else count(*) over (partition by source, event_ts is null order by epoch(event_ts)::bigint
              range between 36000 preceding and current row) end as recent
            from f where source <> '') select source, max(recent) as peak, strftime(min(event_ts), {_CLOCK}) as first_at, count(*) as attempts_over
            from w where recent >= 2 group by source"""


def _sessions(table: str) -> str:
    return f""", f as ({_FAILED_AT.format(table)}),
            l as (select *, case when event_ts - lag(event_ts) over w < interval 12 hour then 0 else 1 end as starts
            from f where source <> '' and event_ts is not null window w as (partition by source order by event_ts)),
            s as (select *, sum(starts) over (partition by source order by event_ts range unbounded preceding) as session from l)
            select source, strftime(min(event_ts), {_CLOCK}) as started_at, strftime(max(event_ts), {_CLOCK}) as last_at, count(*) as attempts
            from s group by source, session
            union all select source, null, null, count(*) from f where source <> '' and event_ts is null group by source"""


_HALF = """select * from mv where seq in (select seq from (select seq, row_number() over (order by seq) as rn,
   count(*) over () as n from ev) where n <= 10 or rn <= n // 2)"""


def _off_hours(table: str) -> str:
    """CTE ``oh``."""
    hour = r"""try_cast(list_extract(string_split_regex(trim(split_part("timestamp", ':', 1)), '\s+'), -1) as int)"""
    return f"""
    , hc as (select hour, count(*) as n from (select case when contains("timestamp", ':') then {hour} else 0 end as hour
        from {table} where "timestamp" <> '') where hour is not null group by hour),
    hs as (select *, avg(n) over () as mean, coalesce(stddev_samp(n) over (), 0) as std from hc),
    oh as (select 'off_hours_activity' as metric, n::double as value, 0.0::double as low, mean * 1.5 as high, n - mean as deviation,
      case when std = 0 then 0 else (n - mean) / std end as z, 'medium' as severity
      from hs where (hour < 6 or hour > 22) and n > mean * 1.5)"""


_FLOOD = """
    , fc as (select source_ip, count(*) as n from ev where source_ip <> '' group by 1),
    fs as (select max(n) as n, avg(n) as mean from fc),
    fl as (select 'single_source_flood' as metric, n::double as value, 0.0::double as low, mean * 5 as high, n - mean as deviation,
      999.0::double as z, 'high' as severity from fs where n > mean * 5)"""

_ALL_ANOMALIES = _metric_anomalies(_HALF) + _off_hours("ev") + _FLOOD + """
    , an as (select * from ma union all by name select * from oh union all by name select * from fl)"""


# --- threat intelligence ----------------------------------------------------

def _jt(path: str) -> str:
    return f"coalesce(json_extract_string(j, '{path}'), '')"


def _ji(path: str) -> str:
    return f"coalesce(json_extract_string(j, '{path}')::int, 0)"


def _jb(path: str) -> str:
    return f"coalesce(json_extract_string(j, '{path}')::boolean, false)"


def _list(path: str) -> str:
    return f"coalesce(array_to_string(json_extract_string(j, '{path}'), ','), '')"


_VT, _AB = "$.data.attributes", "$.data"
_MAL, _SUS = _ji(f"{_VT}.last_analysis_stats.malicious"), _ji(f"{_VT}.last_analysis_stats.suspicious")
_VERDICTS = f"""
fj as (select *, case when json_valid(payload) then payload end as j from feed),
v as (select seq, ip, provider,
  case provider when 'VirusTotal' then {_MAL} > 0 or {_SUS} > 0
    when 'AbuseIPDB' then coalesce(json_type(j, '{_AB}.isWhitelisted') is null or json_extract_string(j, '{_AB}.isWhitelisted') = 'false', false) and {_ji(_AB + '.totalReports')} > 0
    when 'AlienVaultOTX' then {_ji('$.pulse_info.count')} > 0 else false end as is_malicious,
  (case provider when 'VirusTotal' then least({_MAL} * 10 + {_SUS} * 5, 100) when 'AbuseIPDB' then {_ji(_AB + '.confidenceScore')}
    when 'AlienVaultOTX' then least({_ji('$.pulse_info.count')} * 10, 100) else 0 end)::int as confidence,
  case provider when 'VirusTotal' then {_jt(_VT + '.country')} when 'AbuseIPDB' then {_jt(_AB + '.countryName')}
    when 'AlienVaultOTX' then {_jt('$.country_code')} else {_jt('$.country_name')} end as country,
  case provider when 'VirusTotal' then {_jt(_VT + '.country')} when 'AbuseIPDB' then {_jt(_AB + '.countryCode')}
    else {_jt('$.country_code')} end as country_code,
  case provider when 'VirusTotal' then {_jt(_VT + '.network')} when 'AbuseIPDB' then {_jt(_AB + '.isp')}
    when 'Shodan' then {_jt('$.isp')} else '' end as isp,
  provider = 'AbuseIPDB' and {_jb(_AB + '.isTor')} as is_tor, provider = 'AbuseIPDB' and {_jb(_AB + '.isProxy')} as is_proxy,
  case provider when 'AbuseIPDB' then {_jb(_AB + '.isVpn')} when 'Shodan' then contains({_list('$.tags[*]')}, 'vpn') else false end as is_vpn,
  case provider when 'AbuseIPDB' then {_jb(_AB + '.isDatacenter')} when 'Shodan' then contains({_list('$.tags[*]')}, 'datacenter') else false end as is_datacenter,
  case provider when 'AbuseIPDB' then {_ji(_AB + '.abuseConfidenceScore')} else 0 end as abuse_score,
  case provider when 'AbuseIPDB' then {_ji(_AB + '.totalReports')} else 0 end as report_count,
  case provider when 'VirusTotal' then coalesce(nullif({_jt(_VT + '.last_analysis_date')}, '0'), '') when 'AbuseIPDB' then {_jt(_AB + '.lastReportedAt')} else '' end as last_reported,
  case provider when 'AbuseIPDB' then coalesce(array_to_string(json_extract_string(j, '{_AB}.reports[*]')[1:5], ','), '')
    when 'AlienVaultOTX' then coalesce(array_to_string(list_sort(list_distinct(json_extract_string(j, '$.categories.*'))), ','), '') else '' end as categories,
  case provider when 'VirusTotal' then {_list(_VT + '.tags[*]')} when 'AlienVaultOTX' then coalesce(array_to_string(list_transform(json_extract(j, '$.pulse_info.pulses[*]'), lambda x: coalesce(json_extract_string(x, '$.name'), '')), ','), '')
    when 'Shodan' then {_list('$.tags[*]')} else '' end as tags
  from fj)"""

_PLACE = "case provider when 'VirusTotal' then 1 when 'AbuseIPDB' then 2 when 'AlienVaultOTX' then 3 else 4 end"
_LATEST = f"""
lv as (select *, {_PLACE} as place from v qualify row_number() over (partition by ip, provider order by seq desc) = 1)"""


def _fallback(index: int) -> str:
    return _prefix("ip", fixed.FALLBACK_INTEL, "null", lambda v: v[index])


def _aggregated(ips: str) -> str:
    """CTE ``ag`` over a table of ``ip``."""
    return f"""
    , c as (select ip, count(*) filter (is_malicious) as votes, max(confidence) as conf,
      first(country order by place) filter (country <> '') as country,
      first(country_code order by place) filter (country <> '') as country_code,
      first(isp order by place) filter (isp <> '') as isp, bool_or(is_tor) as is_tor, bool_or(is_proxy) as is_proxy,
      bool_or(is_vpn) as is_vpn, bool_or(is_datacenter) as is_datacenter,
      string_agg(provider, ',' order by place) as queried from lv group by ip),
    ag as (select i.ip, coalesce(queried, '') as providers_queried,
      array_to_string(list_filter(['VirusTotal', 'AbuseIPDB', 'AlienVaultOTX', 'Shodan'], lambda x: not contains(coalesce(queried, ''), x)), ',') as providers_available,
      coalesce(votes, 0) + case when {_fallback(1).replace('ip,', 'i.ip,')} in ('malicious', 'suspicious') then 1 else 0 end as malicious_votes,
      coalesce(conf, 0) as max_confidence,
      coalesce(nullif(country, ''), {_fallback(2).replace('ip,', 'i.ip,')}, '') as country, coalesce(country_code, '') as country_code,
      coalesce(isp, '') as isp, coalesce(is_tor, false) as is_tor, coalesce(is_proxy, false) as is_proxy,
      coalesce(is_vpn, false) as is_vpn, coalesce(is_datacenter, false) as is_datacenter
      from ({ips}) i left join c on c.ip = i.ip)"""


_EV_IPS = "select distinct source_ip as ip from ev where source_ip <> ''"
_FEED_IPS = "select distinct ip from lv"
INTEL = LOGS + "," + _FEED + "," + _VERDICTS + "," + _LATEST
FEED = "with" + ",".join([_FEED, _VERDICTS, _LATEST])

# --- documents --------------------------------------------------------------

_DOC = """json_object('@timestamp', "timestamp", 'event.kind', 'event', 'event.category', 'authentication',
  'event.type', event_type, 'log.level', {severity}, 'message', text, 'source.ip', source_ip,
  'destination.ip', destination_ip, 'user.name', "user", 'host.name', host, 'log.source.name', host,
  'mitre_tactic', coalesce(mitre_tactic, ''), 'mitre_technique', coalesce(mitre_technique, ''))"""

_ALERT = """seq, "timestamp", upper(severity) as severity, source_ip, "user", text[1:100] as message"""


def _triage() -> str:
    item = "text[1:60]"
    return f"""
    , bu as (select distinct source, attempts, item from ({LOGS} {_bursts('ev')})),
    tt as (select mitre_tactic, mitre_technique, seq, {_map('mitre_tactic', fixed.MITRE_TEXT, "''")} as known from ev where mitre_tactic <> '')
    select 'failed_logins' as "check", item from (select * from bu order by attempts desc, source limit 10)
    union all select 'new_accounts', "user" || ' created on ' || "timestamp" from ev where event_type in ('account_created', 'new_account', 'account_password')
    union all select 'suspicious_ips', item from ({LOGS} {_ORIGINS})
    union all select 'privilege_escalation', "timestamp" || ' - ' || "user" || ' - ' || {item} from ev where {_words(fixed.PRIVILEGE_WORDS)}
    union all select 'lateral_movement', "timestamp" || ' - ' || source_ip || ' -> ' || {item} from ev where {_words(fixed.LATERAL_WORDS)}
    union all select 'data_exfiltration', "timestamp" || ' - ' || source_ip || ' - ' || {item} from ev where {_words(fixed.EXFIL_WORDS)}
    union all select 'mitre_tactics', mitre_tactic || ': ' || count(*) from tt group by mitre_tactic
    union all select 'mitre_samples', item from (select seq, mitre_tactic || ': ' || coalesce(mitre_technique, known) as item
      from tt where coalesce(mitre_technique, known) <> '' order by seq limit 5)
    union all select distinct 'unique_users', "user" from ev where "user" <> ''
    union all select distinct 'unique_sources', source_ip from ev where source_ip <> ''
    union all select 'event_summary', event_type || ': ' || count(*) from ev group by event_type"""


_ORIGINS = f""", og as (select distinct source_ip, {_prefix('source_ip', fixed.SUSPICIOUS_ORIGIN, 'null')} as origin
    from ev where regexp_matches(source_ip, '^(185\\.220\\.|91\\.121\\.|103\\.|45\\.|77\\.)'))
    select source_ip, origin, source_ip || ' (' || origin || ')' as item from og where origin is not null"""

_HOUR = r"""try_cast(split_part(list_extract(string_split_regex(trim("timestamp"), '\s+'), -1), ':', 1) as int)"""


def all_sql() -> dict[str, str]:
    minute = "select date_trunc('minute', event_ts) as minute, count(*) as events from ev group by 1"
    levels = [f"count(*) filter (severity = '{s}') as {s}" for s in fixed.SEVERITIES]
    four = [f"count(*) filter (severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low")]
    file_format = "coalesce(own_format, first_value(own_format) over (partition by file order by own_format is null, seq))"
    by_file = "with" + ",".join([_LINES, _FORMAT, _parsed(file_format)])
    as_auth = "with" + ",".join([_LINES, _FORMAT, _parsed("'auth'")])
    as_syslog = "with" + ",".join([_LINES, _FORMAT, _parsed("'syslog'")])
    as_ssh = "with" + ",".join([_LINES, _FORMAT, _parsed("'ssh'")])
    counted = "count(*) as events from ev where {0} <> '' group by 1"
    empty, written = "''", ("timestamp", "host", "user", "source_ip", "event_type", "raw_message", "severity")
    prefixes = f"""{LOGS} , i as ({_EV_IPS}), t as (select * from (values ('185.220.', 0, 'anonymizer'), ('185.220.101.', 1, 'never reached'),
            ('10.', 2, 'private'), ('192.168.1.', 3, 'office'), ('45.33.32.10', 4, 'one host'), ('45.', 5, 'cloud')) t(prefix, priority, label))
            select ip, prefix, label from i left join t on case when ends_with(prefix, '.') then starts_with(ip, prefix) else ip = prefix end
            qualify row_number() over (partition by ip order by priority) = 1"""
    enriched = f"""{INTEL} {_aggregated(_EV_IPS)} select seq, source_ip, (malicious_votes > 0)::int as is_malicious, malicious_votes,
            max_confidence, ag.country from ev left join ag on ag.ip = ev.source_ip"""
    hec = f"""{SCORED} select json_object('event', {_DOC.format(severity='severity')}, 'host', host, 'index', 'security',
            'source', 'seclake', 'sourcetype', 'seclake:json')::varchar as value from sc"""
    twins = {
        # parsing
        "parsed_events": f"{LOGS} select {_FIELDS} from ev",
        "parsed_cloudtrail": f"""{LOGS.replace('lines as (', 'l0 as (').replace('own as (', f'lines as (select file, seq, {CLOUDTRAIL_SQL} as line from l0), own as (')}
            select {_FIELDS} from ev where format = 'cloudtrail'""",
        "parsed_files": f"{by_file} select {_FIELDS} from ev",
        "parsed_as_auth": f"{as_auth} select {_FIELDS} from ev",
        "parsed_as_syslog": f"{as_syslog} select {_FIELDS} from ev",
        "rejected_as_ssh": f"{as_ssh} select file, seq, line, format, 'no_match' as reason from p where event_type is null",
        "format_counts": f"with {_LINES}, {_FORMAT} select coalesce(own_format, 'none') as format, count(*) as n from own group by 1",
        "file_formats": f"with {_LINES}, {_FORMAT} select file, min_by(own_format, seq) as file_format from own where own_format is not null group by 1",
        "severity_scored": f"{SCORED} select seq, event_type, severity from sc",
        "severity_scored_cases": f"{CASES_SCORED} select seq, event_type, severity from sc",
        # summaries
        "severity_counts": f"{SCORED} select count(*) as total_events, {', '.join(levels)} from sc",
        "severity_distribution": f"""{SCORED} , lv as (select * from (values (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'info')) t(position, severity)),
            n as (select severity, count(*) as events from sc group by 1),
            d as (select position::int as position, severity, coalesce(events, 0) as events, sum(events) over () as total from lv left join n using (severity))
            select position, severity, events, round(events * 100.0::double / total, 6) as percent,
            floor(events::double / total::double * 40)::bigint as bar from d""",
        "overview": f"""{LOGS} select count(*) as total_events, count(distinct nullif(source_ip, '')) as unique_ips,
            count(distinct nullif("user", '')) as unique_users from ev""",
        "event_summary": f"{LOGS} select event_type, {counted.format('event_type')}",
        "unique_users": f"""{LOGS} select "user" as value, {counted.format('"user"')}""",
        "unique_sources": f"{LOGS} select source_ip as value, {counted.format('source_ip')}",
        "mitre_tactics": f"""{LOGS} select mitre_tactic, count(*) as events, {_map('mitre_tactic', fixed.MITRE_TEXT, "'Unknown'")} as description
            from ev where mitre_tactic <> '' group by 1""",
        "mitre_samples": f"""{LOGS} , t as (select seq, mitre_tactic, coalesce(mitre_technique, {_map('mitre_tactic', fixed.MITRE_TEXT, "''")}) as tx
            from ev where mitre_tactic <> '') select seq, mitre_tactic || ': ' || tx as sample from t where tx <> '' order by seq limit 5""",
        "hourly_timeline": f"""{LOGS} , n as (select {_HOUR} as hour, count(*) as n from ev where "timestamp" <> '' group by 1),
            m as (select max(n) as top from n where hour is not null)
            select h.hour::int as hour, coalesce(n.n, 0) as events, floor(coalesce(n.n, 0)::double / (select top from m) * 60)::bigint as bar
            from range(24) h(hour) left join n on n.hour = h.hour""",
        "top_sources": LOGS + _top("source_ip", 10),
        "top_users": LOGS + _top('"user"', 10),
        "top_event_types": LOGS + _top("event_type", 15, "value[1:20]"),
        "geo_distribution": f"""{LOGS} select {_prefix('source_ip', fixed.GEO_CLASS, "'Other'")} as origin, count(*) as events
            from ev where source_ip <> '' group by 1""",
        "attack_phases": LOGS + _phases("ev"),
        "attack_phases_cases": CASES + _phases("ca"),
        "internal_sources": rf"""{LOGS} select regexp_matches(coalesce(source_ip, ''), '^(10\.|172\.(1[6-9]|2[0-9]|3[0-1])\.|192\.168\.)')::int as internal,
            count(*) as events from ev group by 1""",
        "events_per_minute": f"{LOGS} , m as ({minute}) select strftime(minute, {_CLOCK}) as minute, events from m",
        "activity_levels": f"""{LOGS} , m as ({minute}), i as (select events, row_number() over (order by minute) - 1 as pos, count(*) over () as n from m),
            w as (select range as point from range(50)),
            c as (select point, events from i, w where case when n <= 50 then pos = point else pos = floor(point * (n / 50.0::double)) end),
            b as (select min(events) as lo, case when max(events) = min(events) then 1 else max(events) - min(events) end as span from c)
            select point::int as point, events as value, floor((events - lo) / span::double * 8)::int as level from c, b""",
        "timeline_all": f"""{SCORED} select seq, "timestamp", host, source_ip, "user", event_type, severity, text[1:100] as message from sc""",
        "timeline_top20": f"""{SCORED} select seq, "timestamp", host, source_ip, "user", event_type, severity, text[1:100] as message,
            ({_RANK})::int as rank from sc order by rank, "timestamp", seq limit 20""",
        "display_view": f"""{LOGS} select seq, "timestamp", host, "user", source_ip, event_type,
            case when length(text) > 50 then text[1:50] || '...' else text end as details from ev""",
        # detections
        "failed_login_bursts": LOGS + _bursts("ev"),
        "failed_login_bursts_top10": LOGS + _bursts("ev") + " order by attempts desc, source limit 10",
        "failed_login_bursts_cases": CASES + _bursts("ca"),
        "failed_login_bursts_windowed": LOGS + _windowed("ev"),
        "bursts_untimed": UNTIMED + _windowed("tv"),
        "attack_sessions": LOGS + _sessions("ev"),
        "attack_sessions_untimed": UNTIMED + _sessions("tv"),
        "auth_failures": f"""{LOGS} select seq, source_ip, "user" from ev where {_FAILING}""",
        "new_accounts": f"""{LOGS} select seq, "timestamp", "user", "user" || ' created on ' || "timestamp" as item from ev
            where event_type in ('account_created', 'new_account', 'account_password')""",
        "suspicious_ips": LOGS + _ORIGINS,
        "privilege_escalation": f"""{LOGS} select seq, "timestamp", "user", "timestamp" || ' - ' || "user" || ' - ' || text[1:60] as item
            from ev where {_words(fixed.PRIVILEGE_WORDS)}""",
        "privilege_escalation_cases": f"""{CASES} select seq, "timestamp", "user", "timestamp" || ' - ' || "user" || ' - ' || text[1:60] as item
            from ca where {_words(fixed.PRIVILEGE_WORDS)}""",
        "lateral_movement": f"""{CASES} select seq, "timestamp", source_ip, "timestamp" || ' - ' || source_ip || ' -> ' || text[1:60] as item
            from ca where {_words(fixed.LATERAL_WORDS)}""",
        "data_exfiltration": f"""{LOGS} select seq, "timestamp", source_ip, "timestamp" || ' - ' || source_ip || ' - ' || text[1:60] as item
            from ev where {_words(fixed.EXFIL_WORDS)}""",
        "data_exfiltration_cases": f"""{CASES} select seq, "timestamp", source_ip, "timestamp" || ' - ' || source_ip || ' - ' || text[1:60] as item
            from ca where {_words(fixed.EXFIL_WORDS)}""",
        "correlate_logs": LOGS + _correlate("ev"),
        "correlate_cases": CASES + _correlate("ca"),
        "port_scan_campaigns": LOGS + _scans("ev"),
        "port_scan_campaigns_cases": CASES + _scans("ca"),
        "port_scan_sliding": LOGS + _sliding("ev"),
        "port_scan_sliding_cases": CASES + _sliding("ca"),
        # rules
        "rules_builtin": LOGS + _rules("ev", _BUILTIN),
        "rules_builtin_cases": CASES + _rules("ca", _BUILTIN),
        "rules_thresholded": LOGS + _thresholded(),
        "rules_thresholded_untimed": UNTIMED + _thresholded("tv"),
        "rules_patterns": LOGS + _rules("ev", _PATTERNS),
        "rules_thousand": LOGS + _THOUSAND,
        "rules_unicode": f"""{LOGS.replace('ev as (', 'e0 as (')}, ev as (select * replace (case seq % 5 when 0 then replace(text, ' by', 'É by')
            when 1 then replace(text, 'user', 'üser') when 2 then 'René ' || text when 3 then 'für' || text else text end as text) from e0)
            {_rules('ev', [(i, n, 'medium', '', '', test) for i, n, test in (
                ('U1', 'Class', f"regexp_matches({_LOW}, 'user[a-z0-9=]+é by')"), ('U2', 'Folded', f"contains({_LOW}, 'rené ')"),
                ('U3', 'Edge', f"regexp_matches({_LOW}, 'für($|[^a-z0-9_é])') or regexp_matches({_LOW}, '(^|[^a-z0-9_é])üser[0-9]*5($|[^a-z0-9_é])')"))])}""",
        "rules_custom_merge": LOGS + _rules("ev", _BUILTIN + _CUSTOM),
        "rules_summary": f"""{LOGS} , h as ({_hits('ev', _BUILTIN)}), r as (select distinct rule_id, severity from h)
            select 10::int as rules_evaluated, count(*) as matches, {', '.join(four)} from r""",
        # anomalies
        "baseline_stats": f"{LOGS} , mv as ({_metric_values('ev')}), st as ({_stats('mv')}) select metric, {_ROUNDED} from st",
        "baseline_source_port": f"""{LOGS} , mv as (select 'source_port' as metric, try_cast(source_port as double) as value from ev where source_port <> ''),
            st as ({_stats('(select * from mv where value is not null)')}) select metric, {_ROUNDED} from st""",
        "baseline_infinite": f"""{LOGS} , mv as (select 'source_port' as metric, try_cast(case when seq % 40 = 3 then 'Infinity' when seq % 40 = 23 then '-Infinity'
            when seq % 40 = 4 then '-' || source_port else source_port end as double) as value from ev where source_port <> '')
            select metric, min(value) as min_val, max(value) as max_val, median(value) as median, list_sort(list(value))[(floor(count(*) * 0.95) + 1)::int] as p95,
            list_sort(list(value))[(floor(count(*) * 0.99) + 1)::int] as p99, count(*) as sample_count from mv group by metric""",
        "baseline_events_per_minute": f"""{LOGS} , m as ({minute}), mv as (select 'events_per_minute' as metric, events::double as value from m),
            st as ({_stats('mv')}) select metric, {_ROUNDED} from st""",
        "anomalies": f"{LOGS} {_ALL_ANOMALIES} select {_ANOMALY} from an",
        "anomalies_against_cases": f"""{LOGS},{_CASES} {_metric_anomalies(f"select * from ({_metric_values('ca')})")} select {_ANOMALY} from ma""",
        "anomalies_empty_baseline": f"{LOGS} {_metric_anomalies(_HALF)} select {_ANOMALY} from ma",
        "anomaly_summary": f"""{LOGS} {_ALL_ANOMALIES} select count(*) as total_anomalies, {', '.join(four)},
            string_agg(distinct metric, ',' order by metric) as metrics_affected from an""",
        "off_hours": f"{CASES} {_off_hours('ca')} select {_ANOMALY} from oh",
        "single_source_flood": f"{LOGS} {_FLOOD} select {_ANOMALY} from fl",
        "minute_rate_anomalies": f"""{LOGS} , m as ({minute}), s as (select avg(events) as mean, stddev_samp(events) as std from m)
            select strftime(minute, {_CLOCK}) as minute, events, round((events - mean) / std, 4) as z_score from m, s where abs((events - mean) / std) > 2""",
        "minute_rate_anomalies_dense": f"""{LOGS} , m as ({minute}), g as (select unnest(generate_series(min(minute), max(minute), interval 1 minute)) as minute from m),
            d as (select g.minute, coalesce(events, 0) as events from g left join m using (minute)),
            s as (select avg(events) as mean, stddev_samp(events) as std from d)
            select strftime(minute, {_CLOCK}) as minute, events, round((events - mean) / std, 4) as z_score from d, s where events > 0 and abs((events - mean) / std) > 2""",
        # intel
        "intel_lookup": f"""{LOGS} , i as ({_EV_IPS}) select ip, {_prefix('ip', fixed.LOCAL_INTEL, "'unknown'", lambda v: v[0])} as type,
            {_prefix('ip', fixed.LOCAL_INTEL, "'info'", lambda v: v[1])} as severity,
            {_prefix('ip', fixed.LOCAL_INTEL, "'unknown'", lambda v: v[2])} as reputation from i""",
        "prefix_lookup": prefixes,
        "prefix_lookup_shuffled": prefixes,
        "verdicts_normalized": f"{FEED} select * from v",
        "verdicts_aggregated": f"{INTEL} {_aggregated(_EV_IPS)} select *, malicious_votes > 0 as is_malicious from ag",
        "verdict_details": f"{FEED} select ip, string_agg(provider || ':' || confidence, ',' order by place) as details from lv group by ip",
        "ip_reputation": f"""{FEED} {_aggregated(_FEED_IPS)} select ip, coalesce(case when {_fallback(1)} = 'malicious' then
            case when contains({_fallback(0)}, 'Tor') then 'tor_exit_node' else 'malicious' end else {_fallback(1)} end,
            case when malicious_votes >= 2 then 'malicious' when malicious_votes = 1 then 'suspicious' when max_confidence >= 50 then 'concerning'
            when is_tor then 'tor_exit_node' when is_vpn then 'vpn' when is_proxy then 'proxy' when is_datacenter then 'datacenter' else 'clean' end) as reputation from ag""",
        "enrich_ips_local": f"""{LOGS} , i as ({_EV_IPS}) select ip, case when {_fallback(1)} in ('malicious', 'suspicious') then 'MALICIOUS' else 'clean' end as verdict,
            coalesce({_fallback(2)}, '') as country from i""",
        "enrich_events": enriched,
        "enrich_events_shuffled": enriched,
        # documents
        "siem_docs": f"""{SCORED} select "timestamp", 'event' as event_kind, 'authentication' as event_category, event_type, severity as log_level,
            text as message, source_ip, destination_ip, "user" as user_name, host as host_name, host as log_source_name,
            coalesce(mitre_tactic, '') as mitre_tactic, coalesce(mitre_technique, '') as mitre_technique from sc""",
        "plain_docs": f"{SCORED} select {_DOC.format(severity='severity')}::varchar as value from sc",
        "bulk_ndjson": f"""{LOGS} select '{{"index":{{"_index":"security-logs"}}}}' || chr(10) || {_DOC.format(severity="'info'")}::varchar as value from ev""",
        "hec_payloads": hec,
        "exported_hec": hec,
        "alerts_medium": f"{SCORED} select {_ALERT} from sc where {_RANK} <= 2",
        "alerts_severe": f"{SCORED} select {_ALERT.replace('100', '80')} from sc where severity in ('critical', 'high', 'medium')",
        "alert_summary": f"""{SCORED} , a as (select upper(severity) as severity from sc where {_RANK} <= 3 order by seq desc limit 50)
            select coalesce(severity, 'TOTAL') as severity, count(*) as alerts from a group by rollup (severity)""",
        "tickets": f"""{SCORED} select seq, 'Security alert' as title, text as description, upper(severity) as severity,
            case severity when 'critical' then 'P1' when 'high' then 'P2' when 'medium' then 'P3' else 'P4' end as priority, source_ip, "user",
            'seclake,triage' as tags, 'seclake' as source, {_map('severity', fixed.TICKET_CATEGORY, "'other'")} as category, 'open' as status
            from sc where {_RANK} <= 1""",
        "tickets_long": f"""{SCORED} select seq, repeat(text, 4) as description,
            case severity when 'critical' then 'P1' when 'high' then 'P2' when 'medium' then 'P3' else 'P4' end as priority
            from sc where length(repeat(text, 4)) > 100""",
        # files
        "text_files_parsed": f"{LOGS} select {_FIELDS.replace('file, seq, ', '')} from ev",
        "case_files_scored": f"""{CASES_SCORED} select strftime(event_ts, {_CLOCK}) as event_time, {', '.join(f'"{c}"' for c in CASE.fieldNames())},
            severity from sc""",
        "csv_files": f"""{SCORED} select seq, {', '.join(f'coalesce("{c}", {empty}) as "{c}"' for c in written)} from sc""",
        "json_files": f"""{SCORED} select seq, {', '.join(f'"{c}"' for c in written)} from sc""",
        "table_files": f"""{UNTIMED} select strftime(event_ts, '%Y-%m-%d') as event_date, seq, event_type, source_ip, "user" from tv""",
        # compositions
        "triage_summary": LOGS + _triage(),
        "report_summary": f"{SCORED} select count(*) as total_events, {', '.join(levels)} from sc",
        "report_intel": f"""{LOGS} , i as ({_EV_IPS}), r as (select ip, {_prefix('ip', fixed.LOCAL_INTEL, "'unknown'", lambda v: v[0])} as type,
            {_prefix('ip', fixed.LOCAL_INTEL, "'info'", lambda v: v[1])} as severity,
            {_prefix('ip', fixed.LOCAL_INTEL, "'unknown'", lambda v: v[2])} as reputation from i) select * from r where reputation <> 'unknown'""",
        "dashboard_event_types": LOGS + _top("event_type", 15, "value[1:20]"),
        # streams, to their end
        "stream_events": f"""{SCORED} select seq, event_type, source_ip, "user", severity from sc""",
        "stream_alerts": f"{SCORED} select {_ALERT} from sc where {_RANK} <= 1",
        "stream_bursts": f"""{LOGS} , fl as (select event_ts, case when coalesce(source_ip, '') <> '' then source_ip else coalesce("user", '') end as source
            from ev where contains({_TYPE}, 'fail')),
            w as (select source, time_bucket(interval 30 minute, event_ts) - to_minutes(30 * k) as started from fl, range(2) r(k) where source <> '')
            select source, strftime(started, {_CLOCK}) as started_at, strftime(started + interval 60 minute, {_CLOCK}) as ended_at, count(*) as attempts
            from w group by source, started having count(*) >= 2""",
        "stream_sessions": f"""{LOGS} , fl as (select event_ts, case when coalesce(source_ip, '') <> '' then source_ip else coalesce("user", '') end as source
            from ev where contains({_TYPE}, 'fail')),
            l as (select *, case when event_ts - lag(event_ts) over w < interval 120 minute then 0 else 1 end as starts from fl where source <> ''
            window w as (partition by source order by event_ts)),
            s as (select *, sum(starts) over (partition by source order by event_ts range unbounded preceding) as session from l)
            select source, strftime(min(event_ts), {_CLOCK}) as started_at, strftime(max(event_ts) + interval 120 minute, {_CLOCK}) as ended_at, count(*) as attempts
            from s group by source, session""",
        "stream_text_alerts": f"{SCORED} select {_ALERT.replace('seq, ', '', 1)} from sc where {_RANK} <= 1",
        "stream_deduped": f"{LOGS} select seq, event_type from ev",
        "stream_appended": f"{LOGS} select {_FIELDS.replace('seq, ', '')} from ev",
        "stream_replays": f"{LOGS} select seq, event_type from ev",
        "stream_recent_alerts": f"{SCORED} select {_ALERT} from (select * from sc where {_RANK} <= 3 order by event_ts desc nulls last, seq desc limit 50)",
        "stream_groups": f"""{LOGS} select seq, event_type, source_ip, (n // 10)::bigint as group_id, (n % 10)::bigint as position
            from (select *, row_number() over (order by seq) - 1 as n from ev)""",
        # own parts
        "stream_callback": f"{SCORED} select event_type, severity, count(*) as events from sc group by all",
        "messages_parsed": f"""{LOGS} select '10.9.0.' || seq % 5 as source_address, {_FIELDS.replace('file, seq, ', '')} from ev""",
        "rules_from_file": LOGS + _rules("ev", _BUILTIN + _CUSTOM),
        "own_parser": f"""{LOGS} select seq, format, event_type, raw_message, host from ev where format <> 'ssh' union all
            select seq, format, case when contains(line, 'Failed') then 'door_closed' else 'door_open' end, upper(line), null
            from fmt where format = 'ssh' and (contains(line, 'Failed') or contains(line, 'Accepted'))""",
        "own_provider": f"""{INTEL.replace('lv as (', 'lk as (')}, lv as (select * from lk union all by name
            select distinct {IP_SQL} as ip, 'Blocklist' as provider, true as is_malicious, 99 as confidence, 'Nowhere' as country, 'NO' as country_code, '' as isp,
            false as is_tor, false as is_proxy, false as is_vpn, false as is_datacenter, 5 as place from events where user_id % 10 = 3)
            {_aggregated(_EV_IPS)} select *, malicious_votes > 0 as is_malicious from ag""",
        "own_target": f"""{SCORED} select concat_ws(' ', 'type=' || event_type, 'src=' || source_ip, 'user=' || "user") as value from sc""",
        "exported_bulk": f"""{SCORED} select unnest(['{{"index":{{"_index":"security-logs"}}}}', {_DOC.format(severity='severity')}::varchar]) as value from sc""",
        "exported_docs": f"{SCORED} select {_DOC.format(severity='severity')}::varchar as value from sc",
    }
    same = {"report_assets": "overview", "report_correlations": "correlate_logs", "report_tactics": "mitre_tactics", "dashboard_totals": "overview",
            "dashboard_hourly": "hourly_timeline", "dashboard_severity": "severity_distribution", "dashboard_top_sources": "top_sources",
            "dashboard_top_users": "top_users", "dashboard_attack_phases": "attack_phases", "dashboard_geography": "geo_distribution"}
    twins |= {name: twins[other] for name, other in same.items()}
    twins["report_timeline"] = f"""{SCORED} select seq, "timestamp", upper(severity) as severity, event_type, source_ip, "user", text[1:50] as message from sc"""
    return twins
