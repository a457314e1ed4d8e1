"""Severity scoring."""

from __future__ import annotations

from .. import fixed
from .text import EVENT_TEXT, first_case, has_any, lookup, q

# The text keywords are looked for in; the joining blank is part of it.
SEVERITY_TEXT = f"lower(concat(coalesce(event_type, ''), ' ', {EVENT_TEXT}))"


def severity_of(text: str) -> str:
    """First level with a keyword in the (lower-case) text, ``info`` when none has."""
    return first_case(
        ((has_any(text, fixed.SEVERITY_KEYWORDS[level]), q(level)) for level in fixed.SEVERITIES[:-1]),
        default="'info'",
    )


def severity_rank(severity: str, unknown: int = 4) -> str:
    """0 for critical up to 4 for info; unknown names get ``unknown``."""
    return first_case(
        ((f"{severity} = {q(level)}", str(rank)) for level, rank in fixed.SEVERITY_RANK.items()), str(unknown)
    )


def stored_severity(df) -> str:
    """The severity column when the table has one, else ``info``."""
    return "coalesce(severity, 'info')" if "severity" in df.columns else "'info'"


def mitre_text(code: str) -> str:
    return lookup(fixed.MITRE_TEXT, code)
