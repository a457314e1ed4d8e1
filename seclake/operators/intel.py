"""Threat intelligence: prefix tables, provider verdicts, reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.network import by_prefix
from ..functions.pin import pin
from ..functions.text import first_case, present, q
from ..schema import VERDICT
from ..session import materialize
from .joins import BROADCAST_ROWS, lookup_join


def source_ips(events: DataFrame) -> DataFrame:
    """Distinct non-empty source addresses."""
    return events.where(present("source_ip")).selectExpr("source_ip as ip").distinct()


# --- prefix tables ----------------------------------------------------------

def prefix_lookup(
    ips: DataFrame, table: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """First matching prefix per address, ``ips(ip)`` against ``table(prefix, priority, ...)``.

    Prefixes end at an octet dot (or are whole addresses), so an address can only
    match its own leading octets: an equality join instead of a comparison with
    every prefix.  Addresses without a match stay, with NULLs.
    """
    leading = ", ".join(f"concat(substring_index(ip, '.', {n}), '.')" for n in (1, 2, 3))
    payload = [c for c in table.columns if c not in ("prefix", "priority")]
    candidates = (
        ips.selectExpr("ip", f"explode(array({leading}, ip)) as prefix")
        # Texts of fewer octets (host names, for instance) do not have all of them.
        .where("startswith(ip, prefix)")
        .distinct()
    )
    hits = lookup_join(candidates, table, "prefix", broadcast_rows)
    return (
        hits.groupBy("ip")
        .agg(F.min_by(F.struct("prefix", *payload), "priority").alias("_p"))
        .select("ip", "_p.prefix", *[f"_p.{c}" for c in payload])
    )


def intel_lookup(events: DataFrame) -> DataFrame:
    """Local table entry per source address; unknown ones read ``unknown`` / ``info``."""

    def part(index: int, default: str) -> str:
        return by_prefix("ip", fixed.LOCAL_INTEL, lambda e: e[index], q(default))

    return source_ips(events).selectExpr(
        "ip", f"{part(0, 'unknown')} as type", f"{part(1, 'info')} as severity",
        f"{part(2, 'unknown')} as reputation",
    )


# --- provider payloads ------------------------------------------------------

# How each provider's payload maps to the common shape; fields left out keep their
# default.  Paths are read from the payload as a VARIANT ``v``.
def _get(path: str, kind: str) -> str:
    return f"try_variant_get(v, '{path}', '{kind}')"


def _text(path: str) -> str:
    return f"coalesce({_get(path, 'string')}, '')"


def _number(path: str) -> str:
    return f"coalesce({_get(path, 'int')}, 0)"


def _flag(path: str) -> str:
    return f"coalesce({_get(path, 'boolean')}, false)"


def _items(path: str) -> str:
    return f"coalesce({_get(path, 'array<string>')}, cast(array() as array<string>))"


_VT, _AB = "$.data.attributes", "$.data"
_MALICIOUS = _number(f"{_VT}.last_analysis_stats.malicious")
_SUSPICIOUS = _number(f"{_VT}.last_analysis_stats.suspicious")
_ANALYSED = _get(f"{_VT}.last_analysis_date", "string")
# A whitelist flag which is null is neither true nor false.
_NOT_LISTED = (
    f"({_get(_AB + '.isWhitelisted', 'variant')} is null or coalesce(not {_get(_AB + '.isWhitelisted', 'boolean')}, false))"
)
_PULSES = _number("$.pulse_info.count")
_PULSE_NAMES = (
    f"transform(slice(coalesce({_get('$.pulse_info.pulses', 'array<variant>')}, cast(array() as array<variant>)), 1, 5), "
    "p -> coalesce(try_variant_get(p, '$.name', 'string'), ''))"
)
_TOPICS = f"slice(array_distinct(map_values({_get('$.categories', 'map<string,string>')})), 1, 5)"
_TAGS = _items("$.tags")

_MAPPINGS = {
    "VirusTotal": {
        "is_malicious": f"{_MALICIOUS} > 0 or {_SUSPICIOUS} > 0",
        "confidence": f"least({_MALICIOUS} * 10 + {_SUSPICIOUS} * 5, 100)",
        "country": _text(f"{_VT}.country"),
        "country_code": _text(f"{_VT}.country"),
        "isp": _text(f"{_VT}.network"),
        "last_reported": f"coalesce(nullif({_ANALYSED}, '0'), '')",
        "tags": _items(f"{_VT}.tags"),
    },
    "AbuseIPDB": {
        "is_malicious": f"{_NOT_LISTED} and {_number(_AB + '.totalReports')} > 0",
        "confidence": _number(f"{_AB}.confidenceScore"),
        "country": _text(f"{_AB}.countryName"),
        "country_code": _text(f"{_AB}.countryCode"),
        "isp": _text(f"{_AB}.isp"),
        "is_tor": _flag(f"{_AB}.isTor"),
        "is_proxy": _flag(f"{_AB}.isProxy"),
        "is_vpn": _flag(f"{_AB}.isVpn"),
        "is_datacenter": _flag(f"{_AB}.isDatacenter"),
        "abuse_score": _number(f"{_AB}.abuseConfidenceScore"),
        "report_count": _number(f"{_AB}.totalReports"),
        "last_reported": _text(f"{_AB}.lastReportedAt"),
        "categories": f"slice({_items(_AB + '.reports')}, 1, 5)",
    },
    "AlienVaultOTX": {
        "is_malicious": f"{_PULSES} > 0",
        "confidence": f"least({_PULSES} * 10, 100)",
        "country": _text("$.country_code"),
        "country_code": _text("$.country_code"),
        "categories": f"coalesce({_TOPICS}, cast(array() as array<string>))",
        "tags": _PULSE_NAMES,
    },
    "Shodan": {
        "country": _text("$.country_name"),
        "country_code": _text("$.country_code"),
        "isp": _text("$.isp"),
        "is_vpn": f"array_contains({_TAGS}, 'vpn')",
        "is_datacenter": f"array_contains({_TAGS}, 'datacenter')",
        "tags": _TAGS,
    },
}
_DEFAULTS = {"boolean": "false", "int": "0", "string": "''", "array<string>": "cast(array() as array<string>)"}


def normalize_verdicts(feed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Provider payloads ``(ip, provider, payload JSON)`` in the common verdict shape.

    A payload which is no JSON gives an empty verdict.  Reports become their JSON text.
    """

    def field(name: str, kind: str) -> str:
        arms = [
            (f"provider = {q(provider)}", mapping[name])
            for provider, mapping in _MAPPINGS.items() if name in mapping
        ]
        return f"{first_case(arms, _DEFAULTS[kind])} as {name}"

    parsed = pin(feed, v="try_parse_json(payload)")
    own = [f for f in VERDICT.fields if f.name not in ("ip", "provider")]
    return parsed.selectExpr(
        "ip", "provider", *keep, *[field(f.name, f.dataType.simpleString()) for f in own]
    )


def latest_verdicts(verdicts: DataFrame, order: str) -> DataFrame:
    """Newest verdict per address and provider."""
    fields = [c for c in verdicts.columns if c not in ("ip", "provider", order)]
    return (
        verdicts.groupBy("ip", "provider")
        .agg(F.max_by(F.struct(*fields), order).alias("_v"))
        .select("ip", "provider", "_v.*")
    )


# Providers in their fixed order, any others after them by name.
_PLACE = (
    "struct(coalesce(nullif(array_position(array("
    + ", ".join(q(p) for p in fixed.PROVIDERS)
    + f"), provider), 0), {len(fixed.PROVIDERS) + 1}) as place, provider as name)"
)
_FLAGS = ("is_tor", "is_proxy", "is_vpn", "is_datacenter")


def _local(index: int) -> str:
    return by_prefix("ip", fixed.FALLBACK_INTEL, lambda e: e[index])


def aggregate_verdicts(ips: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One opinion per address from all providers and the local prefix table.

    ``verdicts`` holds one row per address and provider (see ``latest_verdicts``).
    Votes, best confidence and flags are combined; country and operator come from
    the first provider which knows them.  A bad local prefix adds a vote.
    """
    first_country = f"min_by(struct(country, country_code), if({present('country')}, {_PLACE}, null))"
    combined = verdicts.groupBy("ip").agg(
        F.expr("count_if(is_malicious) as _votes"),
        F.expr("greatest(max(confidence), 0) as _confidence"),
        F.expr(f"{first_country} as _country"),
        F.expr(f"min_by(isp, if({present('isp')}, {_PLACE}, null)) as _isp"),
        *[F.expr(f"bool_or({flag}) as {flag}") for flag in _FLAGS],
        # As many entries as there are providers.
        F.expr(f"transform(array_sort(collect_set({_PLACE})), s -> s.name) as _queried"),
    )
    providers = "array(" + ", ".join(q(p) for p in fixed.PROVIDERS) + ")"
    flags = ", ".join(f"coalesce({flag}, false) as {flag}" for flag in _FLAGS)
    return (
        ips.join(combined, "ip", "left")
        .selectExpr(
            "*",
            "coalesce(_queried, cast(array() as array<string>)) as providers_queried",
            f"coalesce(_votes, 0) + if({_local(1)} in ('malicious', 'suspicious'), 1, 0) as malicious_votes",
        )
        .selectExpr(
            "ip",
            "providers_queried",
            f"array_except({providers}, providers_queried) as providers_available",
            "malicious_votes > 0 as is_malicious",
            "malicious_votes",
            "coalesce(_confidence, 0) as max_confidence",
            f"struct(coalesce(nullif(_country.country, ''), {_local(2)}, '') as country, "
            "coalesce(_country.country_code, '') as country_code, "
            f"coalesce(_isp, '') as isp, {flags}) as aggregated",
        )
    )


def with_details(aggregated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add the single verdicts, in provider order, as an array (one entry per provider)."""
    columns = ", ".join(c for c in verdicts.columns if c != "ip")
    entries = f"collect_list(struct({_PLACE} as p, struct({columns}) as v))"
    details = verdicts.groupBy("ip").agg(
        F.expr(f"transform(array_sort({entries}), s -> s.v) as details")
    )
    return aggregated.join(details, "ip", "left")


def ip_reputation(aggregated: DataFrame) -> DataFrame:
    """Reputation word per address: the local table first, then the combined verdict."""
    local = (
        f"case when {_local(1)} = 'malicious' then if(contains({_local(0)}, 'Tor'), 'tor_exit_node', 'malicious') "
        f"else {_local(1)} end"
    )
    ladder = first_case([
        ("malicious_votes >= 2", "'malicious'"),
        ("malicious_votes = 1", "'suspicious'"),
        ("max_confidence >= 50", "'concerning'"),
        ("aggregated.is_tor", "'tor_exit_node'"),
        ("aggregated.is_vpn", "'vpn'"),
        ("aggregated.is_proxy", "'proxy'"),
        ("aggregated.is_datacenter", "'datacenter'"),
    ], "'clean'")
    return aggregated.selectExpr("ip", f"coalesce({local}, {ladder}) as reputation")


def enrich_ips(events: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Combined opinion on every distinct source address.

    Without ``verdicts`` only the local prefix table speaks.
    """
    ips = source_ips(events)
    if verdicts is None:
        verdicts = events.sparkSession.createDataFrame([], VERDICT)
    return aggregate_verdicts(ips, verdicts)


def enrich_events(
    events: DataFrame, verdicts: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Events with the verdict on their source address."""
    # One reading gives the addresses and how often each occurs.
    counts = materialize(
        events.groupBy("source_ip").agg(F.count("*").alias("_n")), "source-counts"
    )
    table = materialize(
        enrich_ips(counts, verdicts).selectExpr(
            "ip as source_ip", "is_malicious", "malicious_votes", "max_confidence",
            "aggregated.country as country",
        ),
        "enriched-ips",
    )
    return lookup_join(events, table, "source_ip", broadcast_rows, counts)
