"""Address expressions."""

from __future__ import annotations

from .. import fixed
from .text import first_case, present, q


def starts_with_any(ip: str, prefixes) -> str:
    return "coalesce(" + " or ".join(f"startswith({ip}, {q(p)})" for p in prefixes) + ", false)"


def by_prefix(ip: str, mapping: dict[str, object], pick=lambda value: value, default: str = "null") -> str:
    """Payload of the first prefix which starts the address.

    For a handful of fixed prefixes: a ``case`` per row needs neither a join nor a
    shuffle.  Large prefix tables go through ``operators.intel``.
    """
    return first_case(
        ((f"startswith({ip}, {q(prefix)})", q(pick(value))) for prefix, value in mapping.items()), default
    )


def is_internal(ip: str) -> str:
    """RFC 1918 address test; missing and empty addresses are not internal."""
    return f"coalesce(rlike({ip}, {q(fixed.INTERNAL_IP)}), false)"


def geo_class(ip: str) -> str:
    """Coarse origin of an address; NULL when there is no address."""
    known = by_prefix(ip, fixed.GEO_CLASS, default=q(fixed.GEO_CLASS_DEFAULT))
    return f"case when {present(ip)} then {known} end"


def suspicious_origin(ip: str) -> str:
    """Label of a suspicious address, NULL for all others."""
    suspicious = starts_with_any(ip, fixed.SUSPICIOUS_PREFIXES)
    return f"case when {suspicious} then {by_prefix(ip, fixed.SUSPICIOUS_ORIGIN)} end"


def first_ip(text: str) -> str:
    """First address in a text, empty when there is none."""
    return f"regexp_extract({text}, {q(fixed.IP_BOUNDED)}, 0)"


def last_ip(text: str) -> str:
    """Last address in a text, empty when there is none."""
    return f"coalesce(try_element_at(regexp_extract_all({text}, {q(fixed.IP_BOUNDED)}, 0), -1), '')"
