"""Line format detection."""

from __future__ import annotations

from .. import fixed
from .text import first_case, has_any, q

FORMATS = ("syslog", "ssh", "auth", "cloudtrail")


def is_json_object(line: str) -> str:
    """True for exactly one JSON object.

    The JSON functions ignore text after the first value; wrapped in brackets such
    a line is either no array or an array of more than one element.
    """
    wrapped = f"json_array_length(concat('[', {line}, ']'))"
    return f"coalesce(startswith({line}, '{{') and {wrapped} = 1, false)"


def is_cloudtrail(line: str) -> str:
    found = f"size(array_intersect(json_object_keys({line}), array('eventVersion', 'eventTime')))"
    return f"coalesce({is_json_object(line)} and {found} = 2, false)"


def detect_format(line: str) -> str:
    """Format of one line, NULL when it is not recognised."""
    low = f"lower({line})"
    return first_case([
        (is_cloudtrail(line), "'cloudtrail'"),
        (f"contains({line}, 'sshd') and {has_any(line, ('Accepted', 'Failed', 'Invalid'))}", "'ssh'"),
        (f"contains({low}, 'ssh') and {has_any(low, ('session', 'login'))}", "'ssh'"),
        (f"rlike({line}, {q(fixed.HEADER_TIME)})",
         f"if({has_any(low, ('session', 'password'))}, 'auth', 'syslog')"),
        (f"rlike({line}, {q(fixed.AUTH_HINT)})", "'auth'"),
    ])
