"""Line parsers as expressions.

A parser gives one SQL expression per event field.  Fields a parser does not name
stay NULL, so every field of every format can be computed in one projection over
one scan.  Work several fields share (the syslog split, the JSON struct) is
declared as a helper and evaluated once per line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from .. import fixed
from . import network
from .formats import is_json_object
from .severity import mitre_text
from .text import first_case, first_group, has_any, lookup, q, strip

Fields = dict[str, str]


@dataclass(frozen=True)
class LineParser:
    """``helper`` is evaluated once per line; ``fields`` reads the line and its result.

    Both work on column names and return SQL text; a helper may also be a function
    of the line column which returns a column, such as a pandas UDF.  A line yields
    an event when ``event_type`` is not NULL.
    """

    fields: Callable[[str, str], Fields]
    helper: Callable[[str], str] | None = None
    column_helper: Callable[[Column], Column] | None = None


# --- syslog -----------------------------------------------------------------

def _syslog_parts(line: str) -> str:
    """[ "", host, process, pid, message, time ] of a matching line.

    One regex pass: the groups are written back separated by line feeds, which
    none of the first four can contain.  A line without a match comes back
    unchanged, that is, with another first element or fewer of them.
    """
    untagged = f"regexp_replace({line}, {q(r'\[TACTIC:[A-Z0-9]+\]')}, '')"
    clean = f"if(contains({line}, '[TACTIC:'), {untagged}, {line})"
    spread = f"regexp_replace({clean}, {q(fixed.SYSLOG_LINE)}, {q(chr(10) + chr(10).join(('$2', '$3', '$4', '$5', '$1')))})"
    return f"split({spread}, {q(chr(10))}, 6)"


def _syslog_fields(line: str, parts: str) -> Fields:
    def part(index: int) -> str:
        return f"get({parts}, {index})"

    message = part(4)
    tactic = f"regexp_extract({line}, {q(fixed.TACTIC_TAG)}, 1)"
    users = ", ".join(first_group(message, p) for p in fixed.USER_PATTERNS)
    return {
        "timestamp": part(5),
        "host": part(1),
        "user": f"coalesce({users}, '')",
        "source_ip": network.first_ip(message),
        "destination_ip": network.last_ip(message),
        "event_type": f"case when size({parts}) = 6 and {part(0)} = '' then 'syslog' end",
        "process": part(2),
        "pid": f"nullif({part(3)}, '')",
        "raw_message": strip(message),
        "mitre_tactic": tactic,
        "mitre_technique": f"coalesce({mitre_text(tactic)}, '')",
    }


# --- sshd -------------------------------------------------------------------

def ssh_parser(extended_user: bool = False) -> LineParser:
    """sshd lines.

    ``user=`` is where the name of an accepted or failed login is looked for; with
    ``extended_user`` the wording "for [invalid user] NAME from" is read as well.
    """

    def fields(line: str, _helper: str) -> Fields:
        login_user = first_group(line, fixed.SSH_USER)
        if extended_user:
            login_user = f"coalesce({login_user}, {first_group(line, r'for (?:invalid user )?(\S+) from')})"
        invalid_user = first_group(line, fixed.SSH_INVALID_USER)
        is_login = has_any(line, ("Accepted", "Failed"))
        return {
            "timestamp": f"regexp_extract({line}, {q(fixed.HEADER_TIME)}, 1)",
            "host": "'sshd'",
            "user": f"coalesce(if({is_login}, {login_user}, {invalid_user}), '')",
            "source_ip": f"regexp_extract({line}, {q(fixed.SSH_SOURCE)}, 1)",
            "source_port": f"regexp_extract({line}, {q(fixed.SSH_PORT)}, 1)",
            "destination_ip": "''",
            "event_type": first_case(
                (f"contains({line}, {q(marker)})", q(kind)) for marker, kind in fixed.SSH_EVENTS.items()
            ),
            "raw_message": line,
        }

    return LineParser(fields)


# --- PAM --------------------------------------------------------------------

def _auth_fields(line: str, low: str) -> Fields:
    return {
        "timestamp": f"regexp_extract({line}, {q(fixed.HEADER_TIME)}, 1)",
        "host": "'auth'",
        "user": f"regexp_extract({line}, {q(fixed.AUTH_USER)}, 1)",
        "source_ip": f"regexp_extract({line}, {q(fixed.IP_LOOSE)}, 0)",
        "source_port": "''",
        "destination_ip": "''",
        "event_type": first_case(
            (f"contains({low}, {q(marker)})", q(kind)) for marker, kind in fixed.AUTH_EVENTS.items()
        ),
        "raw_message": line,
    }


# --- CloudTrail -------------------------------------------------------------

_CLOUDTRAIL = (
    "eventTime STRING, eventName STRING, "
    "userIdentity STRUCT<userName: STRING, type: STRING, arn: STRING>, "
    "sourceIPAddress STRING, awsRegion STRING, eventSource STRING, "
    "requestParameters STRING, responseElements STRING"
)


def _cloudtrail_values() -> Fields:
    """Event fields from the parsed document ``d``."""

    def text(name: str) -> str:
        return f"coalesce(d.{name}, '')"

    def request_part(key: str, label: str) -> str:
        """`` label=value`` when the key is present; a JSON null reads ``None``."""
        value = f"coalesce(get_json_object(d.requestParameters, '$.{key}'), 'None')"
        has_key = f"array_contains(json_object_keys(d.requestParameters), '{key}')"
        return f"if(coalesce({has_key}, false), concat(' {label}=', {value}), '')"

    name = text("eventName")
    who = "d.userIdentity"
    arn_user = f"case when contains({who}.arn, 'arn:aws:iam::') then element_at(split({who}.arn, '/'), -1) end"
    keys = "json_object_keys(d.responseElements)"
    response = (
        f"if(coalesce(size({keys}), 0) > 0, concat(' -> [\\'', array_join({keys}, '\\', \\''), '\\']'), '')"
    )
    category = f"coalesce({lookup(fixed.CLOUDTRAIL_CATEGORY, name)}, {q(fixed.CLOUDTRAIL_CATEGORY_DEFAULT)})"
    request = ", ".join(
        request_part(key, label)
        for key, label in (("userName", "user"), ("groupName", "group"), ("policyName", "policy"))
    )
    return {
        "timestamp": text("eventTime"),
        "host": f"if({text('awsRegion')} <> '', concat('aws:', d.awsRegion), 'aws')",
        "user": f"coalesce(nullif({who}.userName, ''), nullif({arn_user}, ''), nullif({who}.type, ''), 'unknown')",
        "source_ip": text("sourceIPAddress"),
        "destination_ip": "''",
        "event_type": category,
        "process": "coalesce(nullif(d.eventSource, ''), 'cloudtrail')",
        "raw_message": f"concat({name}, {request}, {response})",
        "mitre_tactic": f"coalesce({lookup(fixed.CLOUDTRAIL_MITRE, name)}, '')",
    }


def _cloudtrail_event(line: str) -> str:
    """Struct of the event fields, NULL when the line is no JSON object."""
    values = ", ".join(f"{sql} as {name}" for name, sql in _cloudtrail_values().items())
    documents = f"array(from_json({line}, {q(_CLOUDTRAIL)}))"
    return f"case when {is_json_object(line)} then get(transform({documents}, d -> struct({values})), 0) end"


def _cloudtrail_fields(_line: str, event: str) -> Fields:
    return {name: f"{event}.{name}" for name in _cloudtrail_values()}


# --- user parsers -----------------------------------------------------------

def struct_parser(make: Callable[[Column], Column], names: tuple[str, ...]) -> LineParser:
    """A parser from any ``line -> struct`` column function, a pandas UDF included."""
    return LineParser(
        fields=lambda _line, parsed: {name: f"{parsed}.{name}" for name in names}, column_helper=make
    )


def default_parsers(extended_user: bool = False) -> dict[str, LineParser]:
    return {
        "syslog": LineParser(_syslog_fields, _syslog_parts),
        "ssh": ssh_parser(extended_user),
        "auth": LineParser(_auth_fields, lambda line: f"lower({line})"),
        "cloudtrail": LineParser(_cloudtrail_fields, _cloudtrail_event),
    }
